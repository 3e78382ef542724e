"""Topics, rules and overlays as data. Longer lexicons are files of the same shape, given as a parameter."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

#: Topic names by short code.
TOPICS = {
    "AI": "AI法、模型評估、演算法問責、自動化決策、AI與著作權",
    "DATA": "跨境資料流通、資料主權、資料開放與再利用",
    "PRIVACY": "隱私框架（含個人資料保護）",
    "IDENTITY": "數位身份",
    "COPYRIGHT": "著作權",
    "PLATFORM": "平台責任、內容審查、推薦演算法",
    "INFO": "媒體多元與資訊操縱",
    "COMPETITION": "競爭規範面向（平台責任的市場結構面）",
    "NIS2": "NIS2、關鍵基礎設施保護",
    "PRODUCT": "產品資安、漏洞揭露義務、SBOM",
    "SUPPLY": "供應鏈安全",
    "CERT": "資安產品認證",
    "HYBRID": "關鍵基礎設施的實體與數位融合保護",
    "CHIPS": "半導體",
    "QUANTUM": "量子技術",
}


@dataclass(frozen=True)
class Signal:
    """A topic that a rule adds when the whole text contains one of the signals."""

    topic: str
    words: tuple[str, ...]


@dataclass(frozen=True)
class Rule:
    """Keywords of one weight. A hit emits `topics`; signals, where given, decide on the whole text, with a default.

    by_hit gives a topic to the hits themselves: it is emitted when one of its words is among them.
    """

    name: str
    weight: int
    keywords: tuple[str, ...]
    topics: tuple[str, ...] = ()
    signals: tuple[Signal, ...] = ()
    default: str | None = None
    by_hit: tuple[Signal, ...] = ()


@dataclass(frozen=True)
class Acronym:
    """A short form that counts only near one of its context words."""

    word: str
    topic: str
    score: int
    contexts: tuple[str, ...]


@dataclass(frozen=True)
class Lexicon:
    rules: tuple[Rule, ...]
    acronyms: tuple[Acronym, ...] = ()


#: Guarded short forms.
ACRONYMS = (
    Acronym("cra", "PRODUCT", 2, ("cyber", "security", "digital product", "logiciel", "produit numérique", "software", "hardware")),
    Acronym("csa", "CERT", 2, ("cyber", "security", "certification", "sécurité", "sicherheit", "enisa")),
    Acronym("ai", "AI", 1, ("model", "algorithm", "artificial", "intelligence", "modèle", "algorith", "künstliche")),
    Acronym("ia", "AI", 1, ("modèle", "algorith", "intelligence", "générative", "système", "sécurité")),
    Acronym("ki", "AI", 1, ("modell", "algorithm", "künstliche", "generativ", "system", "sicherheit")),
)

#: A short lexicon of the main acts and terms; give a file for a full one.
DEFAULT = Lexicon(
    (
        Rule("product", 4, ("cyber resilience act", "règlement sur la cyberrésilience", "cyberresilienzverordnung", "products with digital elements", "secure by design"), ("PRODUCT",)),
        Rule("certification", 4, ("cybersecurity act", "cybersecurity certification", "certification de cybersécurité", "eucc"), ("CERT",)),
        Rule("nis2", 4, ("nis2", "nis 2", "nis-2-richtlinie", "essential entities", "entités essentielles", "wesentliche einrichtungen"), ("NIS2",)),
        Rule("critical", 2, ("critical entities resilience", "critical infrastructure", "critical networks", "infrastructures critiques", "réseaux critiques", "kritische netze"), ("NIS2",)),
        Rule("chain", 2, ("sbom", "vulnerability", "vulnérabilité", "schwachstelle", "product safety", "supply chain", "chaînes d'approvisionnement", "lieferketten"), by_hit=(Signal("PRODUCT", ("sbom", "vulnerability", "vulnérabilité", "schwachstelle", "product safety")), Signal("SUPPLY", ("supply chain", "chaînes d'approvisionnement", "lieferketten")))),
        Rule("incident", 1, ("cyber incident", "incident reporting", "notification des incidents", "meldung von störfällen", "ransomware"), ("NIS2",)),
        Rule("ai", 1, ("artificial intelligence", "intelligence artificielle", "künstliche intelligenz", "ai act"), ("AI",)),
        Rule("data", 1, ("data protection", "open data", "digital identity", "data transfers", "gdpr", "protection des données", "identité numérique", "datenschutz", "digitaler ausweis"), (), (Signal("IDENTITY", ("identity", "identité", "ausweis")), Signal("PRIVACY", ("data protection", "gdpr", "protection des données", "datenschutz")), Signal("DATA", ("open data", "data transfers"))), "DATA"),
        Rule("platform", 1, ("online platforms", "digital services act", "digital markets act", "plateformes en ligne", "große plattformen", "gatekeeper"), (), (Signal("COMPETITION", ("digital markets act", "competition", "gatekeeper")), Signal("PLATFORM", ("online platform", "digital services act", "plateformes en ligne"))), "PLATFORM"),
        Rule("chips", 1, ("semiconductor", "chip production", "production de puces", "fertigung von chips", "quantum"), (), (Signal("CHIPS", ("semiconductor", "chip", "puces")), Signal("QUANTUM", ("quantum",)))),
        Rule("copyright", 1, ("copyright", "droit d'auteur", "urheberrecht"), ("COPYRIGHT",)),
        Rule("media", 1, ("media pluralism", "disinformation", "pluralisme des médias"), ("INFO",)),
        Rule("hybrid", 2, ("hybrid threat", "menace hybride", "hybride bedrohung"), ("HYBRID",)),
    ),
    ACRONYMS,
)


@dataclass(frozen=True)
class Term:
    """One word or phrase of an overlay; language * means any. Without a concept of its own, a term is its own."""

    text: str
    weight: float = 1.0
    language: str = "*"
    concept: str | None = None


@dataclass(frozen=True)
class OverlayTopic:
    name: str
    keywords: tuple[Term, ...] = ()
    synonyms: tuple[Term, ...] = ()
    penalties: tuple[Term, ...] = ()
    excludes: tuple[Term, ...] = ()
    enabled: bool = True
    legacy: str | None = None
    inherit: bool = True
    owner: str | None = None


@dataclass(frozen=True)
class Overlay:
    topics: tuple[OverlayTopic, ...]
    digest: str = field(default="", compare=False)


def load_lexicon(path: str | Path) -> Lexicon:
    """A lexicon from JSON, schema 1: rules and guarded short forms in their order, topics by code or by name.

    Rejected are unknown topics, empty words, weights below 1, a rule name used twice and a rule that can emit nothing.
    """
    payload = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    if payload.get("schema_version") != 1:
        raise ValueError("unsupported lexicon header")
    code = {**{k: k for k in TOPICS}, **{v: k for k, v in TOPICS.items()}}

    def topic(name: str) -> str:
        if name not in code:
            raise ValueError(f"unknown topic: {name!r}")
        return code[name]

    def words(values: list[str]) -> tuple[str, ...]:
        if not values or not all(isinstance(v, str) and v.strip() for v in values):
            raise ValueError(f"words are missing: {values!r}")
        return tuple(dict.fromkeys(values))

    signals = lambda rows: tuple(Signal(topic(r["topic"]), words(r["words"])) for r in rows)
    rules = tuple(Rule(r["name"], int(r["weight"]), words(r["keywords"]), tuple(map(topic, r.get("topics", []))), signals(r.get("signals", [])), topic(r["default"]) if r.get("default") else None, signals(r.get("by_hit", []))) for r in payload.get("rules", []))
    acronyms = tuple(Acronym(a["word"], topic(a["topic"]), int(a["score"]), words(a["contexts"])) for a in payload.get("acronyms", []))
    if len({r.name for r in rules}) != len(rules) or any(r.weight < 1 or not (r.topics or r.signals or r.by_hit or r.default) for r in rules):
        raise ValueError("a rule is named twice, weightless or without a topic")
    return Lexicon(rules, acronyms)


def save_lexicon(lexicon: Lexicon, path: str | Path) -> None:
    """The file that load_lexicon reads."""
    Path(path).write_text(json.dumps({"schema_version": 1, "rules": [asdict(r) for r in lexicon.rules], "acronyms": [asdict(a) for a in lexicon.acronyms]}, ensure_ascii=False, indent=1), encoding="utf-8")


def _terms(values: list, weighted: bool) -> tuple[Term, ...]:
    out = []
    for v in values:
        row = {"term": v} if isinstance(v, str) else v
        if not str(row.get("term", "")).strip() or (weighted and not 0 < float(row.get("weight", 0)) <= 100):
            raise ValueError(f"invalid term: {v!r}")
        out.append(Term(row["term"], float(row.get("weight", 1)), row.get("language", "*"), row.get("concept")))
    return tuple(out)


def load_overlay(path: str | Path, base: Overlay | None = None) -> Overlay:
    """An overlay from JSON, schema 1 or 2. In merge mode its topics replace those of `base` by name, after removals."""
    payload = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    version, mode, removed = payload.get("schema_version"), payload.get("mode", "replace"), payload.get("remove_topics", [])
    if version not in (1, 2) or mode not in ("replace", "merge") or (version == 1 and (removed or "mode" in payload)) or (mode == "replace" and removed):
        raise ValueError("unsupported overlay header")
    names = [t["name"] for t in payload["topics"]]
    if len({*names}) != len(names) or {*removed} & {*names}:
        raise ValueError("a topic is listed twice")
    topics = {t.name: t for t in (base.topics if base and mode == "merge" else ())}
    if missing := [r for r in removed if r not in topics]:
        raise ValueError(f"no such topics: {missing}")
    for r in removed:
        del topics[r]
    for t in payload["topics"]:
        topics[t["name"]] = OverlayTopic(t["name"], _terms(t.get("keywords", []), True), *(_terms(t.get(k, []), False) for k in ("synonyms", "penalties", "excludes")), t.get("enabled", True), t.get("legacy_name"), t.get("inherit_legacy", True), t.get("responsibility_owner"))
    if not any(t.enabled for t in topics.values()):
        raise ValueError("no topic is enabled")
    return Overlay(tuple(topics.values()), hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True).encode()).hexdigest())

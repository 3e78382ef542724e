"""What a run leaves behind: JSON lines, workbooks, manifests, published as one bundle and verified."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import zipfile
from collections.abc import Iterable, Sequence
from pathlib import Path
from typing import Any
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswell.functions.text import safe_cell, shortened

SCHEMA_VERSION = 6
#: Keys of an article line, in their order.
LINE = (
    "source_id", "country", "source_name", "institution_type", "language", "published_at", "published_at_raw", "published_date_local", "published_timezone", "date_precision", "date_source", "date_confidence", "date_conflict", "date_candidates", "title", "title_zh_tw",
    "summary", "url", "alternate_urls", "matched_topics", "matched_keywords", "relevance_score", "boolean_score", "bm25_score", "bm25_topic_scores", "matched_synonyms", "publisher_organisation", "responsibility_owner", "confidence_level", "fetched_via", "discovered_by", "authority_level", "content_kind",
)
#: Columns of the library under the names that a line gives them.
RENAMED = {"matched_topics": "topics", "matched_keywords": "keywords", "relevance_score": "score", "bm25_score": "bm25", "bm25_topic_scores": "bm25_topics", "confidence_level": "confidence", "publisher_organisation": "source_name", "matched_synonyms": "keywords"}
LISTS = ("alternate_urls", "matched_topics", "matched_keywords", "matched_synonyms", "responsibility_owner", "discovered_by", "date_candidates")
MANIFEST = "run.json"


def iso(ts: Column) -> Column:
    """An instant as ISO text in UTC, with microseconds only where there are any."""
    base = F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(ts) % 1_000_000
    return F.when(ts.isNotNull(), F.concat(base, F.when(micros != 0, F.format_string(".%06d", micros)).otherwise(""), F.lit("+00:00")))


def article_lines(articles: DataFrame, run_id: str = "") -> DataFrame:
    """value: one JSON object per article with every key in its order; absent texts are empty, absent lists empty lists."""
    kinds = dict(articles.dtypes)

    def column(name: str) -> Column:
        own = name if name in kinds else RENAMED.get(name, name)
        if own not in kinds:
            if name in LISTS:
                return F.array().cast("array<string>")
            if name in ("relevance_score", "boolean_score"):
                return F.lit(0)
            if name == "bm25_score":
                return F.lit(0.0)
            if name == "date_conflict":
                return F.lit(False)
            return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")) if name == "bm25_topic_scores" else F.lit(None).cast("string") if name == "published_at" else F.lit("")
        if kinds[own].startswith("timestamp"):
            return iso(F.col(own))
        return F.coalesce(F.col(own), F.array().cast(kinds[own]) if kinds[own].startswith("array") else F.lit("") if kinds[own] == "string" else F.col(own))

    fields = [F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(run_id).alias("run_id"), *[column(n).alias(n) for n in LINE]]
    return articles.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(articles: DataFrame, path: str, run_id: str = "") -> None:
    """JSON lines in as many files as the data has parts."""
    article_lines(articles, run_id).write.mode("overwrite").text(path)


def sheet_rows(articles: DataFrame, limit: int = 500) -> DataFrame:
    """Articles as a sheet shows them: joined lists, cut summaries, texts that no spreadsheet takes for formulas."""
    kinds = dict(articles.dtypes)
    out = []
    for c in articles.columns:
        col = F.col(c)
        if kinds[c].startswith("array"):
            col = F.array_join(col.cast("array<string>"), "；")
        elif kinds[c].startswith("map"):
            col = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(col))))
        elif kinds[c].startswith("timestamp"):
            col = iso(col)
        if c == "summary":
            col = shortened(col, limit)
        out.append((safe_cell(F.coalesce(col, F.lit(""))) if not kinds[c] in ("int", "bigint", "double", "boolean") else col).alias(c))
    return articles.select(*out)


def shade(confidence: Column, topics: Column, keywords: Column) -> Column:
    """The fill of a row: by confidence, only where topics and keywords were found."""
    found = (F.size(topics) > 0) & (F.size(keywords) > 0)
    return F.when(found & (confidence == "高"), "C6EFCE").when(found & (confidence == "中"), "FFEB9C").when(found & (confidence == "低"), "FCE4D6")


def _cell(ref: str, value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'
    return f'<c r="{ref}"><v>{value}</v></c>'


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def write_workbook(path: str | Path, sheets: dict[str, tuple[Sequence[str], Iterable[Sequence[Any]]]]) -> Path:
    """An XLSX file of (header, rows) sheets, rows written as they come. A workbook is a report: give it selected rows."""
    path = Path(path)
    temporary = path.with_suffix(".part")
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    ns = "http://schemas.openxmlformats.org"
    with zipfile.ZipFile(temporary, "w", zipfile.ZIP_DEFLATED) as z:
        for i, (header, rows) in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'{head}<worksheet xmlns="{ns}/spreadsheetml/2006/main"><sheetData>'.encode())
                for r, row in enumerate([header, *[]], 1):
                    f.write(f'<row r="{r}">{"".join(_cell(f"{_letters(c)}{r}", v) for c, v in enumerate(row, 1))}</row>'.encode())
                for r, row in enumerate(rows, 2):
                    f.write(f'<row r="{r}">{"".join(_cell(f"{_letters(c)}{r}", v) for c, v in enumerate(row, 1))}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
        names = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{ns}/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Type="{ns}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{ns}/package/2006/relationships">{rels}</Relationships>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="rId1" Type="{ns}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{ns}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
    os.replace(temporary, path)
    return path


def workbook_sheets(path: str | Path) -> list[str]:
    """The names of a workbook's sheets."""
    import re

    with zipfile.ZipFile(path) as z:
        return re.findall(r'<sheet name="([^"]*)"', z.read("xl/workbook.xml").decode())


def sheet_data(df: DataFrame) -> tuple[list[str], Iterable[Sequence[Any]]]:
    """Header and rows of a sheet, streamed part by part to the driver."""
    shown = sheet_rows(df)
    return shown.columns, (tuple(r) for r in shown.toLocalIterator())


def checksum(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def publish(staged: str | Path, target: str | Path, manifest: dict[str, Any]) -> Path:
    """Move staged files into target with a manifest of sizes and checksums written last; on failure, what was there returns."""
    staged, target = Path(staged), Path(target)
    files = sorted(p for p in staged.iterdir() if p.is_file() and p.name != MANIFEST)
    listed = [{"name": p.name, "size": p.stat().st_size, "sha256": checksum(p)} for p in files]
    (staged / MANIFEST).write_text(json.dumps({**manifest, "artifacts": listed, "artifact_bundle_complete": True}, ensure_ascii=False, indent=2, sort_keys=True), encoding="utf-8")
    target.mkdir(parents=True, exist_ok=True)
    backup = target / ".previous"
    shutil.rmtree(backup, ignore_errors=True)
    backup.mkdir()
    moved: list[Path] = []
    try:
        for p in [*files, staged / MANIFEST]:
            to = target / p.name
            if to.exists():
                os.replace(to, backup / p.name)
            os.replace(p, to)
            moved.append(to)
    except OSError:
        for to in moved:
            to.unlink(missing_ok=True)
        for p in backup.iterdir():
            os.replace(p, target / p.name)
        raise
    shutil.rmtree(backup)
    return target / MANIFEST


def bundle_problems(target: str | Path) -> list[str]:
    """What a published bundle lacks or has too much, file by file."""
    target = Path(target)
    try:
        manifest = json.loads((target / MANIFEST).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        return [f"manifest: {e}"]
    declared = {a["name"]: a for a in manifest.get("artifacts", [])}
    if any("/" in n or n.startswith(".") for n in declared):
        return ["unsafe name"]
    actual = {p.name for p in target.iterdir() if p.is_file() and p.name != MANIFEST}
    out = [f"missing {n}" for n in sorted(declared.keys() - actual)] + [f"extra {n}" for n in sorted(actual - declared.keys())]
    for n in sorted(declared.keys() & actual):
        if (target / n).stat().st_size != declared[n]["size"]:
            out.append(f"size {n}")
        elif checksum(target / n) != declared[n]["sha256"]:
            out.append(f"checksum {n}")
    return out


def event_line(event: str, **values: Any) -> str:
    """One log line: JSON with sorted keys."""
    return json.dumps({"event": event, **values}, ensure_ascii=False, sort_keys=True, default=str)


def markdown_table(header: Sequence[str], rows: Iterable[Sequence[Any]]) -> str:
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    line = lambda r: f"| {' | '.join(map(cell, r))} |"
    return "\n".join([line(header), line(["---"] * len(header)), *map(line, rows)]) + "\n"

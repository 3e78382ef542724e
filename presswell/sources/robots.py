"""Decisions of robots files by RFC 9309: merged groups, the longest rule wins, allowing wins ties."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame

TOKEN = "presswell"
#: A line of a robots file: a field name, a colon, a value, and perhaps a comment.
_FIELD = re.compile(r"^\s*([A-Za-z-]+)\s*:\s*([^#]*?)\s*(?:#.*)?$", re.MULTILINE)
_DECIMAL = re.compile(r"\d+(?:\.\d+)?")
_OCTET = re.compile(rb"%([0-9A-Fa-f]{2})|(.)", re.DOTALL)
#: Fixed value: the octets that mean the same whether escaped or not (RFC 3986, unreserved).
UNRESERVED = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
STAR, END = -1, -2


def octets(path: str) -> list[int]:
    """path as octets, each written in one way: below 256 as it stands, from 256 on escaped. Octets outside ASCII count as escaped."""
    out = []
    for escaped, plain in _OCTET.findall(path.encode("utf-8", "surrogatepass")):
        value = int(escaped, 16) if escaped else plain[0]
        out.append(value if value in UNRESERVED or (not escaped and value < 128) else 256 + value)
    return out


def pattern(value: str) -> list[int]:
    """A rule's path as octets, with STAR for any stretch and END for a closing dollar sign."""
    closed = value.endswith("$")
    signs = [STAR if o == ord("*") else o for o in octets(value[:-1] if closed else value)]
    return [*signs, END] if closed else signs


def matches(rule: list[int], target: list[int]) -> bool:
    """Whether target begins with rule, a star standing for any stretch; the last star alone is ever tried again."""
    i = j = 0
    star, resume = -1, 0
    while i < len(rule):
        if rule[i] == STAR:
            star, resume, i = i, j, i + 1
        elif (rule[i] == END and j == len(target)) or (j < len(target) and rule[i] == target[j]):
            i, j = i + 1, j + (rule[i] != END)
        elif star >= 0 and resume < len(target):
            i, j, resume = star + 1, resume + 1, resume + 1
        else:
            return False
    return True


def rules(text: str, token: str = TOKEN) -> tuple[list[tuple[bool, list[int]]], float]:
    """(allow, pattern) of all groups that name the token, else of those for everyone; and the longest crawl delay."""
    fields = [(k.casefold(), v) for k, v in _FIELD.findall(text.lstrip("\ufeff"))]
    fields = [f for f in fields if f[0] in ("user-agent", "allow", "disallow", "crawl-delay")]
    runs = [(agents, [v if agents else (k, v) for k, v in run]) for agents, run in groupby(fields, lambda f: f[0] == "user-agent")]
    if runs and not runs[0][0]:
        del runs[0]  # rules before any agent belong to nobody
    groups = [({a.casefold() for a in runs[i][1]}, runs[i + 1][1] if i + 1 < len(runs) else []) for i in range(0, len(runs), 2)]
    named = [g for agents, g in groups if token.casefold() in agents] or [g for agents, g in groups if "*" in agents]
    lines = [line for g in named for line in g]
    delays = [float(v) for k, v in lines if k == "crawl-delay" and _DECIMAL.fullmatch(v)]
    return [(k == "allow", pattern(v)) for k, v in lines if k != "crawl-delay" and v.startswith("/")], max(delays, default=0.0)


def allows(policy: list[tuple[bool, list[int]]], url: str) -> bool:
    """The decision of the most specific rule, by octets; the robots file itself is always allowed."""
    at = urlsplit(url)
    target = octets(f"{at.path or '/'}?{at.query}" if at.query else at.path or "/")
    weights = {(sum(o >= 0 for o in rule), allow) for allow, rule in policy if matches(rule, target)}
    return at.path == "/robots.txt" or max(weights, default=(0, True))[1]


def decisions(urls: DataFrame, files: DataFrame, token: str = TOKEN) -> DataFrame:
    """url and allowed for urls (host, url) against the robots files (host, body) of their hosts; no file allows all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = {b: rules(b or "", token)[0] for b in pdf["body"].unique()}
            yield pd.DataFrame({"url": pdf["url"], "allowed": [allows(known[b], u) for u, b in zip(pdf["url"], pdf["body"], strict=True)]})

    return urls.join(files, "host", "left").select("url", "body").mapInPandas(run, "url string, allowed boolean")

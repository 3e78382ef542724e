"""Canonical addresses and address predicates."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query keys that only track.
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid")


def canonical(url: str | None, *, sort_query: bool = False, tracking: tuple[str, ...] = TRACKING_KEYS) -> str | None:
    """One address: scheme and host in small letters, no tracking keys, no fragment, single slashes, none at the end.

    An address that can't be split (an open bracket in the host) is returned stripped.
    """
    if url is None:
        return None
    try:
        p = urlsplit(url.strip())
    except ValueError:
        return url.strip()
    keep = [(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if not (f := k.casefold()).startswith("utm_") and f not in tracking]
    path = re.sub("/{2,}", "/", p.path).rstrip("/") or "/"
    return urlunsplit((p.scheme.casefold(), p.netloc.casefold(), path, urlencode(sorted(keep) if sort_query else keep), ""))


@F.pandas_udf(T.StringType())
def canonical_url(urls: pd.Series) -> pd.Series:
    """Column form of canonical; each distinct address of a batch is parsed once."""
    known: dict = {}
    return urls.map(lambda u: known[u] if u in known else known.setdefault(u, canonical(u)), na_action="ignore")


@F.pandas_udf(T.StringType())
def listing_url(urls: pd.Series) -> pd.Series:
    """As canonical_url, with sorted parameters and only utm_ keys removed."""
    known: dict = {}
    return urls.map(lambda u: known[u] if u in known else known.setdefault(u, canonical(u, sort_query=True, tracking=())), na_action="ignore")


def host_of(url: Column) -> Column:
    """The host in small letters, without port and user."""
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_query_of(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)


def identity_key(url: Column) -> Column:
    """Host without www. and the decoded path; the query plays no part."""
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(path, "\\+", "%2B")), path)
    return F.concat(F.regexp_replace(host_of(url), "^www\\.", ""), F.coalesce(F.nullif(F.regexp_replace(decoded, "/+$", ""), F.lit("")), F.lit("/")))


def host_in(host: Column, domains: Column) -> Column:
    """Whether host is one of the domains or a subdomain of one."""
    return F.exists(domains, lambda d: (host == F.lower(d)) | host.endswith(F.concat(F.lit("."), F.lower(d))))


def allowed_url(url: Column, domains: Column, include: Column, exclude: Column) -> Column:
    """The address policy of a source: web scheme, host in scope, some include pattern (if there are any) and no exclude pattern."""
    target = path_query_of(url)
    hit = lambda patterns: F.exists(patterns, lambda p: F.regexp_like(target, F.concat(F.lit("(?i)"), p)))
    return (
        F.coalesce(F.lower(url).rlike("^https?://"), F.lit(False))
        & F.coalesce(host_in(host_of(url), domains), F.lit(False))
        & ((F.coalesce(F.size(include), F.lit(0)) <= 0) | F.coalesce(hit(include), F.lit(False)))
        & ~F.coalesce(hit(exclude), F.lit(False))
    )

"""Names, identifiers and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """Trimmed text, NULL when blank."""
    return F.nullif(F.trim(c), F.lit(""))


def url_basename(url: Column) -> Column:
    """Last path segment, percent-decoded; else the host; else the raw text."""
    parts = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)"
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, parts, 1), r"^[^@]*@", ""), r":\d*$", "")
    segments = F.filter(F.split(F.regexp_extract(url, parts, 2), "/"), lambda s: s != "")
    # url_decode turns '+' into a space, which a path segment must not do.
    plain = F.replace(F.element_at(segments, -1), F.lit("+"), F.lit("%2B"))
    named = F.when(F.size(segments) > 0, F.try_url_decode(plain))
    found = url.rlike(parts)
    return F.when(found & (F.size(segments) > 0), F.coalesce(named, url)).when(found, F.coalesce(F.nullif(host, F.lit("")), url)).otherwise(url)


def qualify_id(native: Column, source: Column) -> Column:
    """``length|native|source``; the length keeps the pair recoverable."""
    return F.concat_ws("|", F.length(native).cast("string"), native, source)

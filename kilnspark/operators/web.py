"""Routes and plain text of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEME_HOST = r"^[a-z]+://[^/]*"
UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def normalized_path(path: Column) -> Column:
    """Identifiers in a path replaced by {id}; twice, as neighbouring numbers share a slash."""
    out = F.regexp_replace(path, f"(?i){UUID}", "{id}")
    for _ in range(2):
        out = F.regexp_replace(out, "/[0-9]+(/|$)", "/{id}$1")
    return F.regexp_replace(out, "/+", "/")


def normalized_urls(pages: DataFrame) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), SCHEME_HOST, "")
    return pages.select("path", normalized_path(path).alias("route"))


def plain_text(pages: DataFrame) -> DataFrame:
    return pages.select("path", F.trim(F.regexp_replace(F.regexp_replace("content", "<[^>]+>", ""), r"\s+", " ")).alias("plain"))

"""Chunks of source for retrieval: by structure (imports, classes, functions, what lies between) and by characters."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pyast import _tree

#: Most characters and lines of a chunk, lines that windows share, and lines with something to say that a chunk needs.
MOST_CHARS, MOST_LINES, OVERLAP, LEAST_LINES = 2200, 120, 4, 2
_SPAN = "struct<name:string,owner:string,first:int,last:int>"


def _spans(source: str | None) -> tuple[list, list]:
    tree = _tree(source)
    if tree is None:
        return [], []
    imports = [x.lineno for x in ast.walk(tree) if isinstance(x, ast.Import | ast.ImportFrom)]
    spans = [{"name": "imports", "owner": "imports", "first": min(imports), "last": max(imports)}] if imports else []
    owners = {y: x.name for x in ast.walk(tree) if isinstance(x, ast.ClassDef) for y in x.body}
    named = [(x, "class" if isinstance(x, ast.ClassDef) else owners.get(x)) for x in ast.walk(tree) if isinstance(x, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef)]
    return spans, [{"name": x.name, "owner": o, "first": x.lineno, "last": x.end_lineno, "is_class": isinstance(x, ast.ClassDef)} for x, o in named]


def structures(files: DataFrame) -> DataFrame:
    """path, lines, and the spans of imports (one or none), classes and functions (with the class they are methods of), from one parse; a text that does not parse has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = lambda x: {k: x[k] for k in ("name", "owner", "first", "last")}
        for batch in batches:
            found = [_spans(c) for c in batch.content]
            yield pd.DataFrame({
                "path": batch.path,
                "lines": [(c or "").splitlines() for c in batch.content],
                "imports": [i for i, _ in found],
                "classes": [[plain(x) for x in n if x["is_class"]] for _, n in found],
                "functions": [[plain(x) for x in n if not x["is_class"]] for _, n in found],
            })

    kind = files.schema["path"].dataType.simpleString()
    return files.select("path", "content").mapInPandas(run, f"path {kind}, lines array<string>, imports array<{_SPAN}>, classes array<{_SPAN}>, functions array<{_SPAN}>")


def slice_lines(lines: Column, first: Column, last: Column) -> Column:
    """Lines first to last, both included and held within 1 and their number."""
    start = F.greatest(first, F.lit(1))
    return F.slice(lines, start, F.greatest(F.least(last, F.size(lines)) - start + 1, F.lit(0)))


def meaningful(lines: Column, least: int = LEAST_LINES) -> Column:
    """Whether so many lines are neither blank nor a comment alone."""
    return F.size(F.filter(lines, lambda x: F.trim(x, F.lit(" \t")).rlike(r"^(?!#|//).+"))) >= least


def _fits(first: Column, last: Column) -> Column:
    return (F.length(F.array_join(slice_lines(F.col("lines"), first, last), "\n")) <= MOST_CHARS) & (last - first + 1 <= MOST_LINES)


def _chunk(kind, name, first, last) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(kind).alias("chunk_type"), lit(name).alias("name"), first.cast("int").alias("line_start"), last.cast("int").alias("line_end"))


_NONE = "array<struct<chunk_type:string,name:string,line_start:int,line_end:int>>"


def _windows(kind: str, name, first: Column, last: Column) -> Column:
    """Windows of MOST_LINES lines that share OVERLAP of them."""
    starts = F.sequence(first, F.greatest(first, last - OVERLAP), F.lit(MOST_LINES - OVERLAP))
    return F.transform(starts, lambda a: _chunk(f"{kind}_part", name, a, F.least(a + MOST_LINES - 1, last)))


def _region(kind: str, name, first: Column, last: Column) -> Column:
    whole = F.when(_fits(first, last), F.array(_chunk(kind, name, first, last))).otherwise(_windows(kind, name, first, last))
    return F.when(meaningful(slice_lines(F.col("lines"), first, last)), whole).otherwise(F.array().cast(_NONE))


def _of_class(c: Column) -> Column:
    methods = F.array_sort(F.filter("functions", lambda f: f["owner"] == c["name"]), lambda a, b: a["first"] - b["first"])
    head_end = methods[0]["first"] - 1
    header = F.when(head_end >= c["first"], F.array(_chunk("class_header", c["name"], c["first"], head_end))).otherwise(F.array().cast(_NONE))
    split = F.concat(header, F.flatten(F.transform(methods, lambda m: _region("method", F.concat(c["name"], F.lit("."), m["name"]), m["first"], m["last"]))))
    large = F.when(F.size(methods) > 0, split).otherwise(_windows("class", c["name"], c["first"], c["last"]))
    return F.when(_fits(c["first"], c["last"]), F.array(_chunk("class", c["name"], c["first"], c["last"]))).otherwise(large)


def gaps(spans: Column, total: Column) -> Column:
    """Spans of lines from 1 to total that none of the spans covers, by one fold over them in order."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        free = F.array(F.struct(acc["at"].alias("first"), (x["first"] - 1).alias("last")))
        found = F.when(acc["at"] < x["first"], F.concat(acc["found"], free)).otherwise(acc["found"])
        return F.struct(F.greatest(acc["at"], x["last"] + 1).alias("at"), found.alias("found"))

    last = lambda acc: F.when(acc["at"] <= total, F.concat(acc["found"], F.array(F.struct(acc["at"].alias("first"), total.alias("last"))))).otherwise(acc["found"])
    return F.aggregate(F.array_sort(spans), start, step, last)


def code_chunks(files: DataFrame) -> DataFrame:
    """path, chunk_type, name, line_start, line_end, chars, tokens of each chunk of Python sources.

    Imports are one chunk, small classes one each, large ones a header and their
    methods; functions that lie in no class, and module code between all these, where
    they say something. What is too large goes in windows; a file that gives no chunk is
    cut into windows whole. Chunks that agree in type, name and lines are one.
    """
    span = lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"))
    outside = F.filter("functions", lambda f: f["owner"].isNull() & ~F.exists("classes", lambda c: (c["first"] <= f["first"]) & (f["first"] <= c["last"])))
    rows = structures(files).withColumn("free", outside).withColumn("total", F.size("lines"))
    taken = F.concat(F.transform("imports", span), F.transform("classes", span), F.transform("free", span))
    rows = rows.withColumn("gaps", F.when(F.col("total") > 0, gaps(taken, F.col("total"))).otherwise(F.array().cast("array<struct<first:int,last:int>>")))
    between = F.filter("gaps", lambda g: meaningful(slice_lines(F.col("lines"), g["first"], g["last"])))
    named = F.concat(
        F.transform("imports", lambda i: _chunk("imports", "imports", i["first"], i["last"])),
        F.flatten(F.transform("classes", _of_class)),
        F.flatten(F.transform("free", lambda f: _region("function", f["name"], f["first"], f["last"]))),
        F.flatten(F.transform(between, lambda g: _windows("module", "module", g["first"], g["last"]))),
    )
    rows = rows.withColumn("named", named)
    whole = F.when(F.col("total") > 0, _windows("module", "file", F.lit(1), F.col("total"))).otherwise(F.array().cast(_NONE))
    every = F.array_distinct(F.when(F.size("named") > 0, F.col("named")).otherwise(whole))
    rows = rows.select("path", "lines", F.explode(every).alias("c"))
    chars = F.length(F.array_join(slice_lines(F.col("lines"), F.col("c.line_start"), F.col("c.line_end")), "\n"))
    return rows.select("path", "c.*", chars.cast("long").alias("chars")).withColumn("tokens", F.greatest(F.floor(F.col("chars") / 4), F.lit(1)).cast("long"))


def character_chunks(files: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """path, chunk, line_start, line_end, content: whole lines gathered until they have `size` characters; the next chunk begins with the last `overlap` of them.

    Where a chunk ends depends on the one before it, so each text is walked once.
    """

    def cut(lines: list[str]) -> Iterator[tuple[int, int, str]]:
        held, first = "", 1
        for at, line in enumerate(lines, 1):
            held += line
            if len(held) >= size:
                yield first, at, held
                held, first = held[-overlap:] if overlap else "", max(1, at - 5)
        if held.strip():
            yield first, len(lines), held

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, *c) for p, text in zip(batch.path, batch.content, strict=True) for i, c in enumerate(cut((text or "").splitlines(keepends=True)))]
            yield pd.DataFrame(rows, columns=["path", "chunk", "line_start", "line_end", "content"])

    kind = files.schema["path"].dataType.simpleString()
    return files.select("path", "content").mapInPandas(run, f"path {kind}, chunk int, line_start int, line_end int, content string")


def without_overlaps(ranked: DataFrame, most: float = 0.5) -> DataFrame:
    """query, place, path, first, last of the ranked chunks of each query that no better kept chunk of the same file covers by more than the given part.

    A query has few chunks (its top k), which one fold goes through in order.
    """
    row = F.struct("place", "path", "first", "last")
    kind = ranked.select(row.alias("r")).schema["r"].dataType.simpleString()

    def step(kept: Column, x: Column) -> Column:
        shared = lambda k: F.least(k["last"], x["last"]) - F.greatest(k["first"], x["first"])
        covered = F.exists(kept, lambda k: (k["path"] == x["path"]) & (shared(k) > 0) & (shared(k) > most * F.greatest(x["last"] - x["first"], F.lit(1))))
        return F.when(covered, kept).otherwise(F.concat(kept, F.array(x)))

    rows = ranked.groupBy("query").agg(F.array_sort(F.collect_list(row)).alias("all"))
    return rows.select("query", F.explode(F.aggregate("all", F.array().cast(f"array<{kind}>"), step)).alias("r")).select("query", "r.*")

"""What a line of source is (blank, comment, docstring, code) and whether it lies in a loop.

These depend on the lines before, so a small helper walks each file's lines once; all
that is made of them are expressions on its arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PY_LOOP = re.compile(r"\s*(?:for|while)\s+")
_PY_GOES_ON = re.compile(r"\s*(?:for|while|if|else|elif|try|except|finally|with)\s*")
_JS_LOOP = re.compile(r"for\s*\(|for\s+\w+\s+of\s+|for\s+\w+\s+in\s+|\bwhile\s*\(")


def python_kinds(lines: list[str]) -> list[str]:
    """A docstring is whatever stands in triple quotes; a comment that holds them stays a comment."""
    out, quote = [], None
    for line in map(str.strip, lines):
        if not line:
            out.append("blank")
        elif quote:
            out.append("docstring")
            quote = None if quote in line else quote
        elif mark := next((q for q in ('"""', "'''") if q in line), None):
            is_comment = line[: line.find(mark)].strip().startswith("#")
            out.append("comment" if is_comment else "docstring")
            quote = mark if not is_comment and line.count(mark) == 1 else None
        else:
            out.append("comment" if line.startswith("#") else "code")
    return out


def script_kinds(lines: list[str]) -> list[str]:
    out, inside = [], False
    for line in map(str.strip, lines):
        if not line:
            out.append("blank")
        elif inside:
            out.append("comment")
            inside = "*/" not in line
        elif line.startswith(("//", "/*")):
            out.append("comment")
            inside = line.startswith("/*") and "*/" not in line[2:]
        else:
            out.append("code")
    return out


def python_loops(lines: list[str]) -> list[bool]:
    """By indentation: a loop ends at the first statement no further in than its latest loop line that is not a block of its own."""
    out, inside, column = [], False, 0
    for at, line in enumerate(lines):
        bare, indent = line.strip(), len(line) - len(line.lstrip())
        if _PY_LOOP.match(line):
            inside, column = True, indent
        if inside and at and bare and indent <= column and not bare.startswith("#") and not _PY_GOES_ON.match(line):
            inside = False
        out.append(inside)
    return out


def script_loops(lines: list[str]) -> list[bool]:
    """By lines that are a closing brace alone: each takes one open loop away."""
    out, depth = [], 0
    for line in lines:
        depth += bool(_JS_LOOP.search(line))
        depth -= depth > 0 and line.strip() == "}"
        out.append(depth > 0)
    return out


def line_context(files: DataFrame) -> DataFrame:
    """path, language, content, and by line: lines, kinds, in_loop. Null contents have no lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [(c or "").splitlines() for c in batch.content]
            python = [x == "python" for x in batch.language]
            yield batch.assign(
                lines=lines,
                kinds=[python_kinds(x) if p else script_kinds(x) for x, p in zip(lines, python, strict=True)],
                in_loop=[python_loops(x) if p else script_loops(x) for x, p in zip(lines, python, strict=True)],
            )

    kind = lambda c: files.schema[c].dataType.simpleString()
    return files.select("path", "language", "content").mapInPandas(run, f"path {kind('path')}, language string, content string, lines array<string>, kinds array<string>, in_loop array<boolean>")


def line_counts(files: DataFrame) -> DataFrame:
    """Lines of each kind and the share of comments and docstrings among those that are not blank, in per cent."""
    of = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long")
    rows = line_context(files).select("path", F.size("lines").cast("long").alias("total_lines"), *[of(k).alias(f"{k}_lines") for k in ("code", "comment", "docstring", "blank")])
    told = F.col("comment_lines") + F.col("docstring_lines")
    return rows.withColumn("comment_ratio", F.round(told * 100.0 / F.greatest(F.col("total_lines") - F.col("blank_lines"), F.lit(1)), 1))

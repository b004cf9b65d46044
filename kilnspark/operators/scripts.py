"""Functions of JavaScript sources and their approximate metrics, from one pass over braces and one over lines."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import maintainability
from .pyast import complexity_grade, halstead_columns, maintainability_grade

#: What starts a function, branches, nests, and counts as operator or operand: fixed values.
FUNCTION = re.compile(r"(?:function\s+(\w+)|const\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[\w]+)\s*=>)")
BRANCH = re.compile(r"\b(if|else\s+if|for|while|do\s*\{|switch|case|catch|\?\s*:|&&|\|\|)\b")
NESTING = re.compile(r"\b(if|for|while|switch)\b")
OPERATOR = re.compile(r"\b(if|else|for|while|return|function|const|let|var|class|new|this|typeof|instanceof|in|of|async|await|try|catch|throw|import|export)\b|[+\-*/%=<>!&|^~?:]+")
OPERAND = re.compile(r"""\b[a-zA-Z_$]\w*\b|\b\d+\.?\d*\b|"[^"]*"|'[^']*'""")
#: Characters that stand for a body whose brace is never closed: a fixed value.
OPEN_BODY = 500
_ASYNC = re.compile(r"\basync\s*\Z")


class Script:
    """Places of a source that functions are measured by, each found once."""

    def __init__(self, source: str) -> None:
        self.source, self.closed, opened = source, {}, []
        for brace in re.finditer("[{}]", source):
            if brace[0] == "{":
                opened.append(brace.start())
            elif opened:
                self.closed[opened.pop()] = brace.end()
        self.opening = sorted([*self.closed, *opened])
        self.branches = [m.start() for m in BRANCH.finditer(source)]
        self.breaks = [m.start() for m in re.finditer("\n", source)]
        self.lines = [0, *(b + 1 for b in self.breaks)]
        ends = [*self.breaks, len(source)]
        self.marks = [self._marks(source[a:b]) for a, b in zip(self.lines, ends, strict=True)]

    @staticmethod
    def _marks(line: str) -> tuple[bool, bool, bool]:
        """Whether a line nests, starts with a closing brace, and joins conditions."""
        bare = line.strip()
        return NESTING.search(bare) is not None, bare.startswith("}"), "&&" in bare or "||" in bare

    def line_of(self, place: int) -> int:
        return bisect_left(self.breaks, place)

    def cognitive(self, start: int, end: int) -> int:
        """A point for each line that nests and for each level around it, and one for a line that joins conditions.

        The body's first and last lines are judged by what the body has of them.
        """
        first, last = self.line_of(start), self.line_of(end)
        if first == last:
            marks = [self._marks(self.source[start:end])]
        else:
            marks = [self._marks(self.source[start : self.breaks[first]]), *self.marks[first + 1 : last], self._marks(self.source[self.lines[last] : end])]
        points = level = 0
        for nests, closes, joins in marks:
            points += joins + (1 + level if nests else 0)
            level = level + 1 if nests else max(0, level - closes)
        return points

    def functions(self) -> Iterator[dict]:
        for found in FUNCTION.finditer(self.source):
            at = bisect_left(self.opening, found.start())
            if at == len(self.opening):
                continue
            start = self.opening[at]
            end = self.closed.get(start, min(len(self.source), start + OPEN_BODY))
            head, body = self.source[found.start() : start], self.source[start:end]
            given = re.search(r"\(([^)]*)\)", head)
            inner = given[1].strip() if given else ""
            operators, operands = [m[1] or "" for m in OPERATOR.finditer(body)], OPERAND.findall(body)  # signs are one kind
            inside = bisect_right(self.branches, end - 1) - bisect_left(self.branches, start)
            yield {
                "name": found[1] or found[2], "line_start": self.line_of(found.start()) + 1, "line_end": self.line_of(found.start()) + 1 + self.line_of(end) - self.line_of(start),
                "complexity": max(1, inside), "cognitive": self.cognitive(start, end), "parameters": inner.count(",") + 1 if inner else 0,
                "is_async": "async" in head.split("=>")[0].split() or _ASYNC.search(self.source, max(0, found.start() - 20), found.start()) is not None,
                "operator_kinds": len(set(operators)), "operand_kinds": len(set(operands)), "operators": len(operators), "operands": len(operands),
            }


def script_functions(files: DataFrame) -> DataFrame:
    """path, name, line_start, line_end, complexity, cognitive, parameters, is_async, volume, difficulty, effort, maintainability, grades of each function in files(path, content).

    Complexity is the number of branches in the body, at least 1; the index is that of the
    body's volume and lines. Null contents hold no functions; repeated files give theirs
    again. Files are read one at a time.
    """
    counts = ["operator_kinds", "operand_kinds", "operators", "operands"]
    columns = ["path", "name", "line_start", "line_end", "complexity", "cognitive", "parameters", "is_async", *counts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"path": path, **f} for path, text in zip(batch.path, batch.content, strict=True) for f in Script(text or "").functions()]
            yield pd.DataFrame(rows, columns=columns)

    kind = files.schema["path"].dataType.simpleString()
    rows = files.select("path", "content").mapInPandas(run, f"path {kind}, name string, line_start int, line_end int, complexity int, cognitive int, parameters int, is_async boolean, " + ", ".join(f"{c} int" for c in counts))
    made = halstead_columns()
    rows = rows.withColumns({c: made[c] for c in ("volume", "difficulty", "effort")})
    rows = rows.withColumn("maintainability", maintainability(F.col("volume"), F.col("complexity"), F.greatest(F.col("line_end") - F.col("line_start"), F.lit(1)).cast("double")))
    return rows.select(*[c for c in columns if c not in counts], "volume", "difficulty", "effort", "maintainability", complexity_grade(F.col("complexity")).alias("grade"), maintainability_grade(F.col("maintainability")).alias("maintainability_grade"))

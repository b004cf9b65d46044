"""Functions, classes and imports of sources in several languages by patterns over whole texts, with their lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A sign that stands before each match while lines are counted; texts lose it before.
MARK = "\x01"


@dataclass(frozen=True)
class Declaration:
    """A pattern, the groups of which the first that matched is the name, and the group with the rest, if any."""

    language: str
    kind: str
    pattern: str
    names: tuple[int, ...] = (1,)
    detail: int | None = None


#: What declares in which language; OTHER stands for all that are not listed: fixed values.
OTHER = "other"
DECLARATIONS = [
    Declaration("python", "function", r"(?m)^( *)def (\w+)\s*\(([^)]*)\)(?:\s*->\s*([^:]+))?:", (2,), 3),
    Declaration("python", "class", r"(?m)^class (\w+)(?:\(([^)]*)\))?:", (1,), 2),
    Declaration("python", "import", r"(?m)^(?:from ([\w.]+) import (.*)|import ([\w., ]+))", (1, 3), 2),
    Declaration("javascript", "function", r"(?:function (\w+)|(?:const|let|var) (\w+)\s*=\s*(?:async\s*)?\()", (1, 2)),
    Declaration("javascript", "class", r"class (\w+)"),
    Declaration("typescript", "function", r"(?:function (\w+)|(?:const|let|var) (\w+)\s*=\s*(?:async\s*)?\()", (1, 2)),
    Declaration("typescript", "class", r"class (\w+)"),
    Declaration("java", "function", r"(?:public|private|protected|static|\s)+[\w<>\[\]]+\s+(\w+)\s*\("),
    Declaration("java", "class", r"(?:public\s+)?class (\w+)"),
    Declaration(OTHER, "function", r"\bfunc(?:tion)?\s+(\w+)\s*\("),
]
LANGUAGES = sorted({d.language for d in DECLARATIONS} - {OTHER})


def declared(files: DataFrame, d: Declaration) -> DataFrame:
    """path, name, detail, line of each match in files(path, content): its line is one more than the line breaks before it.

    Each text is cut before its matches; what goes on is the pieces' line breaks and what
    their heads name. A file's path is unique.
    """
    text = F.translate(F.coalesce("content", F.lit("")), MARK, "")
    pieces = F.split(F.regexp_replace(text, d.pattern, MARK + "$0"), MARK)
    rows = files.select("path", F.posexplode(pieces).alias("at", "piece"))
    head = lambda g: F.regexp_extract("piece", d.pattern, g)
    name = F.coalesce(*[F.when(head(g) != "", head(g)) for g in d.names])
    breaks = F.length("piece") - F.length(F.replace("piece", F.lit("\n")))
    rows = rows.select("path", "at", name.alias("name"), (head(d.detail) if d.detail else F.lit("")).alias("detail"), breaks.alias("breaks"))
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("line", (F.sum("breaks").over(before) + 1).cast("int")).where("at > 0").select("path", "name", "detail", "line")


def declarations(files: DataFrame) -> DataFrame:
    """path, kind, name, detail, line of what files(path, language, content) declare.

    detail is a Python function's parameters without self and cls, annotations and
    defaults, a Python class's bases, or the names imported from a module; several modules
    of one import are a row each. Null and empty contents declare nothing.
    """
    lang = F.lower(F.trim(F.coalesce("language", F.lit("unknown"))))
    parts = lambda c: F.transform(F.split(c, ","), lambda p: F.trim(p, F.lit(" \n\t\r")))
    out = None
    for d in DECLARATIONS:
        own = lang == d.language if d.language != OTHER else ~lang.isin(LANGUAGES)
        rows = declared(files.where(own).select("path", "content"), d)
        detail = F.filter(parts("detail"), lambda p: p != "")
        if (d.language, d.kind) == ("python", "function"):
            bare = F.transform(F.filter(detail, lambda p: ~p.isin("self", "cls")), lambda p: F.trim(F.regexp_replace(p, "[:=](?s:.*)$", "")))
            rows = rows.withColumn("detail", F.array_join(bare, ","))
        else:
            rows = rows.withColumn("detail", F.array_join(detail, ","))
        if d.kind == "import":
            rows = rows.withColumn("name", F.explode(parts("name")))
        rows = rows.select("path", F.lit(d.kind).alias("kind"), "name", "detail", "line")
        out = rows if out is None else out.union(rows)
    return out

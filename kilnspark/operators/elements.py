"""What a source has to document and to test: elements with their comments, and targets with a score."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .declarations import MARK
from .pyast import _FUNCTION, Flat, _each, _tree, _written

#: Elements of scripts: kind, pattern, the groups of arguments and of a base: fixed values.
SCRIPT_ELEMENTS = [
    ("function", r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)", 2, None),
    ("arrow_function", r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(([^)]*)\)\s*(?::\s*\w+)?\s*=>", 2, None),
    ("class", r"(?:export\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?", None, 2),
    ("interface", r"(?:export\s+)?interface\s+(\w+)", None, None),
]
#: What starts a comment that documents, how far before an element it may start, and the length of a text that does: fixed values.
COMMENT, REACH, LEAST_DOC = "/**", 200, 20
ELEMENTS = "path {path}, kind string, name string, is_async boolean, args string, return_type string, bases string, methods string, line int, needs_doc boolean"
TARGETS = "path {path}, kind string, name string, class_name string, is_async boolean, args string, return_type string, conditions boolean, loops boolean, raises boolean, tries boolean, score int, line int"


def _places(files: DataFrame, pieces, *more) -> DataFrame:
    """path, at, place, line and more of each piece of a text: the characters before it, and its line."""
    rows = files.select("path", F.posexplode(pieces).alias("at", "piece"))
    rows = rows.select("path", "at", F.length("piece").alias("chars"), (F.length("piece") - F.length(F.replace("piece", F.lit("\n")))).alias("breaks"), *more)
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({"place": F.sum("chars").over(before), "line": (F.sum("breaks").over(before) + 1).cast("int")}).where("at > 0").drop("chars", "breaks")


def script_elements(files: DataFrame) -> DataFrame:
    """path, kind, name, args, base, line, needs_doc of functions, arrow functions, classes and interfaces in files(path, content).

    An element is documented if a documenting comment starts in the 200 characters before
    it: both are places in a text, and the nearest comment before an element is found by
    one sort of both. args are names without types. Null contents have no elements; a
    path is unique.
    """
    text = F.translate(F.coalesce("content", F.lit("")), MARK, "")
    nothing = F.lit(None).cast("string")
    found = None
    for kind, pattern, args, base in SCRIPT_ELEMENTS:
        head = lambda g, p=pattern: F.regexp_extract("piece", p, g)
        names = F.filter(F.split(head(args), ","), lambda a: F.trim(a, F.lit(" \n\t\r")) != "") if args else None
        given = F.array_join(F.transform(names, lambda a: F.trim(F.split_part(a, F.lit(":"), F.lit(1)), F.lit(" \n\t\r"))), ",") if args else F.lit("")
        rows = _places(files, F.split(F.regexp_replace(text, pattern, MARK + "$0"), MARK), F.lit(kind).alias("kind"), head(1).alias("name"), given.alias("args"), (head(base) if base else F.lit("")).alias("base"))
        found = rows if found is None else found.union(rows)
    # cut after each comment's start, so that a piece begins where the comment's sign has ended
    comments = _places(files, F.split(F.replace(text, F.lit(COMMENT), F.lit(COMMENT + MARK)), MARK), F.lit("comment").alias("kind"), nothing.alias("name"), nothing.alias("args"), nothing.alias("base"))
    both = found.union(comments.select(found.columns))
    is_comment = F.col("kind") == "comment"
    nearest = F.max(F.when(is_comment, F.col("place"))).over(Window.partitionBy("path").orderBy("place").rangeBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("nearest", nearest).where(~is_comment)
    documented = F.coalesce(F.col("place") - (F.col("nearest") - len(COMMENT)) <= REACH, F.lit(False))
    return rows.select("path", "kind", "name", "args", "base", "line", (~documented).alias("needs_doc"))


def _typed(args: list[ast.arg], source: str, skip: tuple[str, ...] = ()) -> str:
    return ", ".join(f"{a.arg}: {_written(a.annotation, source) if a.annotation else 'Any'}" for a in args if a.arg not in skip)


def _returned(x, source: str) -> str:
    return _written(x.returns, source) if x.returns else "None"


def _elements(path, source):
    tree = _tree(source)
    for x in ast.walk(tree) if tree else ():
        if isinstance(x, (*_FUNCTION, ast.ClassDef)):
            lacking = len((ast.get_docstring(x, clean=False) or "").strip()) < LEAST_DOC
            if isinstance(x, ast.ClassDef):
                methods = ",".join(y.name for y in x.body if isinstance(y, _FUNCTION))
                yield path, "class", x.name, None, None, None, ",".join(_written(b, source) for b in x.bases), methods, x.lineno, lacking
            else:
                yield path, "function", x.name, isinstance(x, ast.AsyncFunctionDef), _typed(x.args.args, source), _returned(x, source), None, None, x.lineno, lacking


def python_elements(files: DataFrame) -> DataFrame:
    """path, kind, name, is_async, args, return_type, bases, methods, line, needs_doc of functions and classes; a docstring under 20 characters does not document."""
    return _each(files, _elements, ELEMENTS)


def _targets(path, source):
    tree = _tree(source)
    if tree is None:
        return
    flat = Flat(tree)
    sums = [flat.sums(lambda x, k=kinds: isinstance(x, k)) for kinds in ((ast.If, ast.IfExp), (ast.For, ast.While), (ast.Raise,), (ast.Try,))]
    owner: list[str | None] = []
    for at, parent in enumerate(flat.parents):  # the innermost class around a node
        above = flat.nodes[parent] if parent >= 0 else None
        owner.append(above.name if isinstance(above, ast.ClassDef) else owner[parent] if parent >= 0 else None)
        x, end = flat.nodes[at], flat.ends[at]
        if isinstance(x, ast.ClassDef):
            own = [y for y in x.body if isinstance(y, _FUNCTION)]
            made = next((y for y in own if y.name == "__init__" and isinstance(y, ast.FunctionDef)), None)
            args = _typed(made.args.args, source, ("self",)) if made else None
            yield path, "class", x.name, None, None, args, None, None, None, None, None, 1 + sum(not y.name.startswith("__") for y in own), x.lineno
        elif isinstance(x, _FUNCTION) and not (x.name.startswith("__") and x.name != "__init__"):
            has = [s[end] > s[at] for s in sums]
            kind = "method" if owner[at] else "function"
            yield path, kind, x.name, owner[at], isinstance(x, ast.AsyncFunctionDef), _typed(x.args.args, source, ("self",)), _returned(x, source), *has, 1 + 2 * has[0] + sum(has[1:]), x.lineno


def test_targets(files: DataFrame) -> DataFrame:
    """path, kind, name, class_name, is_async, args, return_type, conditions, loops, raises, tries, score, line of what a Python source has to test.

    A function's score is 1, and 2 more for a condition, 1 each for a loop, a raise and a
    try in it; a class's is 1 and its methods without leading underscores. Private names
    with two underscores are left out but for initializers.
    """
    return _each(files, _targets, TARGETS)


test_targets.__test__ = False

#: Signs of what a script's function has to test, in so many characters from its start, and points of each kind: fixed values.
SIGNS = {"conditions": re.compile(r"\bif\b|\bswitch\b", re.ASCII), "loops": re.compile(r"\bfor\b|\bwhile\b", re.ASCII), "raises": re.compile(r"\bthrow\b", re.ASCII)}
SIGN_REACH, SCRIPT_POINTS = 500, {"function": 2, "arrow_function": 1, "class": 2}
_SCRIPT_TARGETS = [(kind, re.compile(pattern, re.ASCII), args, base) for kind, pattern, args, base in SCRIPT_ELEMENTS if kind in SCRIPT_POINTS]
SCRIPT_TARGETS = "path {path}, kind string, name string, base string, is_async boolean, args string, conditions boolean, loops boolean, raises boolean, score int, line int"


def _script_targets(path, source):
    text = source or ""
    breaks = [m.start() for m in re.finditer("\n", text)]
    for kind, pattern, args, base in _SCRIPT_TARGETS:
        for m in pattern.finditer(text):
            ahead = text[m.start() : m.start() + SIGN_REACH] if kind == "function" else ""
            names = ",".join(a.split(":")[0].strip() for a in m[args].split(",") if a.strip()) if args else None
            is_async = None if kind == "class" else re.search(r"\basync\b", m[0].split("(")[0] if kind == "function" else m[0].split("=>")[0]) is not None
            yield path, kind, m[1], m[base] if base else None, is_async, names, *(s.search(ahead) is not None for s in SIGNS.values()), SCRIPT_POINTS[kind], bisect_left(breaks, m.start()) + 1


def script_targets(files: DataFrame) -> DataFrame:
    """path, kind, name, base, is_async, args, conditions, loops, raises, score, line of functions, arrow functions and classes of scripts.

    Signs are looked for in the 500 characters from a function's start. Null contents have no targets.
    """
    return _each(files, _script_targets, SCRIPT_TARGETS)

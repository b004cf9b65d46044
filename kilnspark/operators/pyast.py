"""Metrics of Python sources that need a syntax tree: one parse of a file, one row for each fact.

No walk recurses, so that a long expression or chain of branches is a file like any
other. Points that add up over a subtree are summed once, in the order of the walk, and a
function's are a difference of two sums.
"""

from __future__ import annotations

import ast
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnspark.functions.tables import materialize

from .files import maintainability
from .lines import python_kinds, python_loops

FACTS = (
    "path {path}, kind string, name string, owner string, line long, lines long, args array<string>, mutable_defaults int, annotated boolean, documented boolean, complexity int, cognitive int, plain_complexity int, nesting int, unreachable boolean, "
    "methods int, bases array<string>, creates string, silent boolean, operator_kinds int, operand_kinds int, operators int, operands int, code_lines int"
)
IMPORTS = "path {path}, module string, name string, level long, line long"
LOOPS = "path {path}, kind string, seq int, line int, line_end int, depth int, lookups int, database boolean, sleeps boolean, requests boolean, texts array<string>, in_loop array<boolean>"
#: Names that arguments should not hide, words of flag-like arguments, numbers that need no name: fixed values.
BUILTINS = [
    "list", "dict", "set", "tuple", "str", "int", "float", "bool",
    "type", "object", "len", "range", "map", "filter", "zip", "sum",
    "min", "max", "abs", "round", "open", "input", "print", "id",
]
FLAG_WORDS = ["flag", "is_", "use_", "enable", "disable", "mode"]
PLAIN_NUMBERS = [0, 1, -1, 2, 100]
_BRANCHES = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.Try)
_NESTS = frozenset((ast.If, ast.While, ast.For, ast.AsyncFor, ast.With, ast.AsyncWith, ast.Try))
#: Nodes of a parse are of these very types, so that a look into a set tells what they are.
_POINTS = frozenset((*_BRANCHES, ast.IfExp))


_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
_LOOP_OR_TRY = (ast.For, ast.AsyncFor, ast.While, ast.Try)
_PLAIN = frozenset((ast.If, ast.While, ast.For, ast.ExceptHandler, ast.With, ast.Assert))
_LOOPS = (ast.For, ast.While)
_LOOP_OR_ASYNC = frozenset((*_LOOPS, ast.AsyncFunctionDef))
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Statements that count as operators by their own name.
_STATEMENTS = frozenset((ast.If, ast.For, ast.While, ast.With, ast.Try, ast.Return, ast.Yield, ast.Raise, ast.Import, ast.ImportFrom, *_FUNCTION, ast.ClassDef, ast.Assign))
_ONE_SIGN = frozenset((ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.AugAssign))
_WITHS, _ASIDE = (ast.With, ast.AsyncWith), (*_COMPREHENSIONS, ast.Lambda)


#: Nodes without children or points of their own: contexts and the signs of operators, which their parents name.
_MARKS = (ast.expr_context, ast.operator, ast.cmpop, ast.unaryop, ast.boolop)


#: Fields that hold names, signs or constants, but no nodes to walk to.
_NO_NODES = frozenset(("ctx", "op", "ops", "id", "attr", "arg", "asname", "type_comment", "kind", "level", "module", "is_async", "simple", "conversion", "kwd_attrs", "rest"))


class _Below(dict):
    """The fields of a kind of node that may hold nodes, last first; None for what is no node to walk to."""

    def __missing__(self, kind: type) -> tuple[str, ...] | None:
        node = issubclass(kind, ast.AST) and not issubclass(kind, _MARKS)
        self[kind] = tuple(f for f in reversed(kind._fields) if f not in _NO_NODES and kind is not ast.Constant) if node else None
        return self[kind]


_BELOW = _Below()


def _inner(x: ast.AST) -> list[ast.AST]:
    """The nodes right below that may hold nodes themselves."""
    out = []
    for name in _BELOW[type(x)]:
        y = getattr(x, name, None)
        if type(y) is list:
            out += [z for z in y if _BELOW[type(z)]]
        elif _BELOW[type(y)]:
            out.append(y)
    return out


class Flat:
    """A tree's nodes (but contexts and signs) with their children after them, and where each one's descendants end."""

    def __init__(self, tree: ast.AST) -> None:
        self.nodes, self.parents, stack, above = [], [], [tree], [-1]
        while stack:
            x, parent = stack.pop(), above.pop()
            names = _BELOW[type(x)]
            if names is None:
                continue
            at = len(self.nodes)
            self.nodes.append(x)
            self.parents.append(parent)
            for name in names:
                y = getattr(x, name, None)
                if type(y) is list:
                    if y:
                        stack += y[::-1]
                        above += [at] * len(y)
                elif y is not None:
                    stack.append(y)
                    above.append(at)
        self.ends = ends = list(range(1, len(self.nodes) + 1))
        for at in range(len(ends) - 1, 0, -1):
            parent = self.parents[at]
            if ends[at] > ends[parent]:
                ends[parent] = ends[at]

    def sums(self, points) -> list[int]:
        """Running totals of the nodes' points, with 0 before the first."""
        return [0, *accumulate(map(points, self.nodes))]

    def deepest(self, kinds: tuple) -> tuple[list[int], list[int]]:
        """How many of these kinds are around each node, itself included, and the most in its subtree."""
        around: list[int] = []
        for x, parent in zip(self.nodes, self.parents, strict=True):
            around.append((around[parent] if parent >= 0 else 0) + (type(x) in kinds))
        most = list(around)
        for at in range(len(most) - 1, 0, -1):
            parent = self.parents[at]
            if most[at] > most[parent]:
                most[parent] = most[at]
        return around, most


def branch_points(x: ast.AST) -> int:
    """A point for a branch or conditional expression, for each operand of and/or beyond the first and each comprehension filter."""
    kind = type(x)
    if kind is ast.BoolOp:
        return len(x.values) - 1
    return len(x.ifs) if kind is ast.comprehension else kind in _POINTS


def plain_points(x: ast.AST) -> int:
    """The narrower count of the refactoring rules: no try, conditional expressions or comprehensions."""
    return len(x.values) - 1 if type(x) is ast.BoolOp else type(x) in _PLAIN


def cognitive(function: ast.FunctionDef | ast.AsyncFunctionDef) -> int:
    """Points for branches, loops, tries and withs, each deeper one worth one more; one each for an else, a change
    between and and or, a comprehension, a lambda and a call of the function itself. Conditions and what is opened
    by a with are not looked into."""
    total, todo = 0, [(x, 0, None) for x in function.body if _BELOW[type(x)]]
    while todo:
        x, depth, chain = todo.pop()
        kind = type(x)
        if kind is ast.If:
            # an elif is worth a point whatever its depth, like an else
            total += 1 + depth + len(x.orelse) - sum(depth + 2 for y in x.orelse if isinstance(y, ast.If))
            todo += [(y, depth + 1, None) for y in (*x.body, *x.orelse)]
        elif kind in _WITHS:
            total += 1 + depth
            todo += [(y, depth + 1, None) for y in x.body]
        elif kind in _LOOP_OR_TRY:
            total += 1 + depth
            todo += [(y, depth + 1, None) for y in _inner(x)]
        elif kind in _ASIDE:
            total += 1
        elif kind is ast.BoolOp:
            total += type(x.op) is not chain
            todo += [(y, depth, type(x.op)) for y in x.values if isinstance(y, ast.BoolOp)]
        else:
            total += kind is ast.Call and type(x.func) is ast.Name and x.func.id == function.name
            todo += [(y, depth, chain) for y in _inner(x)]
    return total


def _spelled(value) -> str:
    """A constant as Python spells it; a whole number of thousands of digits, which it would not spell, in hexadecimal."""
    try:
        return str(value)
    except ValueError:
        return hex(value)


def signs(x: ast.AST) -> tuple[list[str], list[str]]:
    """What a node adds to the operators and to the operands of a source."""
    kind = type(x)
    if kind is ast.Name:
        return _NOTHING, [x.id]
    if kind is ast.Attribute:
        return _NOTHING, [x.attr]
    if kind is ast.Constant:
        return _NOTHING, [_spelled(x.value)]
    if kind in _ONE_SIGN:
        return [type(x.op).__name__], _NOTHING
    if kind is ast.Compare:
        return [type(op).__name__ for op in x.ops], _NOTHING
    return ([kind.__name__] if kind in _STATEMENTS else _NOTHING), _NOTHING


_NOTHING: list[str] = []


def vocabulary(said: list[tuple[list[str], list[str]]]) -> dict[str, int]:
    """Kinds and numbers of operators and operands of nodes, from the signs of each."""
    operators, operands = [y for a, _ in said for y in a], [y for _, b in said for y in b]
    return {"operator_kinds": len(set(operators)), "operand_kinds": len(set(operands)), "operators": len(operators), "operands": len(operands)}


def _tree(source: str | None) -> ast.Module | None:
    try:
        return ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _written(x: ast.expr, source: str) -> str:
    """An expression in the usual spelling, or as it stands where it nests too deep for that."""
    try:
        return ast.unparse(x)
    except RecursionError:
        return ast.get_source_segment(source, x) or ""


def _function(x: ast.FunctionDef | ast.AsyncFunctionDef, owner: str | None, wanted: frozenset[str]) -> dict:
    a = x.args
    out = {"name": x.name, "owner": owner, "annotated": x.returns is not None}
    if "args" in wanted:
        out["args"] = [y.arg for y in (*a.posonlyargs, *a.args, *a.kwonlyargs)]
    if "mutable_defaults" in wanted:
        out["mutable_defaults"] = sum(isinstance(d, ast.List | ast.Dict | ast.Set) for d in a.defaults)
    if "documented" in wanted:
        out["documented"] = ast.get_docstring(x) is not None
    if "cognitive" in wanted:
        out["cognitive"] = cognitive(x)
    if "unreachable" in wanted:
        stops = [i for i, y in enumerate(x.body[:-1]) if isinstance(y, ast.Return)]
        out["unreachable"] = bool(stops) and any(not isinstance(y, ast.Pass | ast.Expr) for y in x.body[stops[0] + 1 :])
    return out


#: Names with a capital that an initializer may call: fixed values.
PLAIN_CALLS = ["Exception", "ValueError"]


def _created(x: ast.ClassDef) -> str | None:
    """The first other class that the class's initializer makes an instance of."""
    calls = (y.func.id for f in x.body if isinstance(f, ast.FunctionDef) and f.name == "__init__" for y in ast.walk(f) if isinstance(y, ast.Call) and isinstance(y.func, ast.Name))
    return next((n for n in calls if n[0].isupper() and n != x.name and n not in PLAIN_CALLS), None)


_NAMES = tuple(c.split()[0] for c in FACTS.split(", "))
VOCABULARY = ("operator_kinds", "operand_kinds", "operators", "operands")
#: Kinds of facts, each with all of its columns.
ALL = {
    "error": frozenset(("line", "lines")),
    "file": frozenset(("line", "lines", "code_lines", *VOCABULARY)),
    "function": frozenset(("name", "owner", "line", "lines", "args", "mutable_defaults", "annotated", "documented", "complexity", "cognitive", "plain_complexity", "nesting", "unreachable", *VOCABULARY)),
    "class": frozenset(("name", "line", "lines", "bases", "creates", "methods")),
    "handler": frozenset(("line", "lines", "silent")),
    "number": frozenset(("name", "line", "lines")),
}
#: What a text holds that holds such facts: words of the language, which cannot be spelled otherwise.
_WORDS = {"function": "def", "class": "class", "handler": "except"}


def _facts(path, source, wanted: dict[str, frozenset[str]] = ALL, names: tuple[str, ...] = _NAMES):
    """A row for a text that parses, each function, class, exception handler without a type and unusual number in it; one for a text that does not parse.

    wanted: the kinds of rows and what of each is worked out; names: the columns of a row.
    """

    def row(x, kind, **more):
        line = getattr(x, "lineno", 0)
        all_of = {"path": path, "kind": kind, "line": line, "lines": (getattr(x, "end_lineno", None) or line) - line + 1} | more
        return tuple(map(all_of.get, names))

    tree = _tree(source)
    if tree is None:
        if "error" in wanted:
            yield row(None, "error")
        return
    nothing = frozenset()
    of_file, of_function, of_class = (wanted.get(k, nothing) for k in ("file", "function", "class"))
    flat = Flat(tree)
    branches = flat.sums(branch_points) if "complexity" in of_function else None
    plain = flat.sums(plain_points) if "plain_complexity" in of_function else None
    around, most = flat.deepest(_NESTS) if "nesting" in of_function else (None, None)
    in_functions = not of_function.isdisjoint(VOCABULARY)
    said = list(map(signs, flat.nodes)) if in_functions or not of_file.isdisjoint(VOCABULARY) else None
    if "file" in wanted:
        kinds = python_kinds((source or "").splitlines())
        yield row(None, "file", lines=len(kinds), code_lines=kinds.count("code"), **(vocabulary(said) if said is not None else {}))
    owners = {y: x.name for x in flat.nodes if type(x) is ast.ClassDef for y in x.body} if "owner" in of_function else {}
    looked_at = {t for k, types in (("function", _FUNCTION), ("class", (ast.ClassDef,)), ("handler", (ast.ExceptHandler,)), ("number", (ast.Constant,))) if k in wanted for t in types}
    for at, x in enumerate(flat.nodes):
        kind = type(x)
        if kind not in looked_at:
            continue
        if kind in _FUNCTION:
            end, points = flat.ends[at], {}
            if branches:
                points["complexity"] = 1 + branches[end] - branches[at]
            if plain:
                points["plain_complexity"] = 1 + plain[end] - plain[at]
            if most:
                points["nesting"] = most[at] - around[at]
            if in_functions:
                outside = set(x.decorator_list)
                # decorators stand above a function and are no words of it
                skipped = [range(i, flat.ends[i]) for i in range(at + 1, end) if flat.parents[i] == at and flat.nodes[i] in outside] if outside else []
                points |= vocabulary([said[i] for i in range(at, end) if not any(i in r for r in skipped)] if skipped else said[at:end])
            yield row(x, "function", **_function(x, owners.get(x), of_function), **points)
        elif kind is ast.ClassDef:
            bases = [_written(b, source) for b in x.bases] if "bases" in of_class else None
            creates = _created(x) if "creates" in of_class else None
            yield row(x, "class", name=x.name, bases=bases, creates=creates, methods=sum(isinstance(y, _FUNCTION) for y in x.body))
        elif kind is ast.ExceptHandler:
            if x.type is None:
                yield row(x, "handler", silent=len(x.body) == 1 and isinstance(x.body[0], ast.Pass))
        elif isinstance(x.value, (int, float)) and x.value not in PLAIN_NUMBERS:
            yield row(x, "number", name=_spelled(x.value))


def _imports(path, source):
    tree = _tree(source)
    for x in ast.walk(tree) if tree else ():
        if isinstance(x, ast.Import):
            for n in x.names:
                yield path, n.name, None, 0, x.lineno
        elif isinstance(x, ast.ImportFrom):
            for n in x.names:
                yield path, x.module, n.name, x.level, x.lineno


#: Calls of a database, of a wait and of a request, which performance rules look for in loops and asynchronous functions: fixed values.
DATABASE_CALL = r"(?i)(?:\.query\s*\(|\.execute\s*\(|\.find\s*\(|\.get\s*\(|session\.query|db\.query)"
SLEEP, REQUEST = r"time\.sleep\s*\(", r"requests\.(get|post|put|delete)\s*\("


def _lines_of(pattern: str, text: str) -> list[tuple[int, int]]:
    """First and last line of each match."""
    return [(text.count("\n", 0, m.start()) + 1, text.count("\n", 0, m.end()) + 1) for m in re.finditer(pattern, text, re.ASCII)]


def _loops(path, source):
    """A row for a text that parses, with its lines, and one for each loop and asynchronous function, in the order of the walk."""
    tree = _tree(source)
    if tree is None:
        return
    lines = (source or "").splitlines()
    yield path, "parsed", -1, 0, 0, 0, 0, False, False, False, lines, python_loops(lines)
    flat = Flat(tree)
    found = [at for at, x in enumerate(flat.nodes) if type(x) in _LOOP_OR_ASYNC]
    if not found:
        return
    around, most = flat.deepest(_LOOPS)
    levels: list[int] = []
    for parent in flat.parents:
        levels.append(levels[parent] + 1 if parent >= 0 else 0)
    text = "\n".join(lines)
    calls = [_lines_of(p, text) for p in (DATABASE_CALL, SLEEP, REQUEST)]
    # level by level, as ast.walk goes
    for seq, at in enumerate(sorted(found, key=lambda at: (levels[at], at))):
        x = flat.nodes[at]
        names = Counter(y.value.id for y in flat.nodes[at : flat.ends[at]] if isinstance(y, ast.Subscript) and isinstance(y.value, ast.Name))
        kind, depth = ("loop", min(3, 1 + most[at] - around[at])) if isinstance(x, _LOOPS) else ("async", 0)
        within = [any(x.lineno <= a and b <= x.end_lineno for a, b in found) for found in calls]
        yield path, kind, seq, x.lineno, x.end_lineno, depth, max(names.values(), default=0), *within, None, None


#: Files whose rows go on together, so that a worker holds no more than those beside its batch of texts.
FILES_AT_ONCE = 256


def _frames(batches: Iterator[pd.DataFrame], rows_of, names: list[str]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), FILES_AT_ONCE):
            some = batch.iloc[at : at + FILES_AT_ONCE]
            rows = [r for p, c in zip(some.path, some.content, strict=True) for r in rows_of(p, c)]
            yield pd.DataFrame(rows, columns=names, dtype=object)


def _each(files: DataFrame, rows_of, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    run = lambda batches: _frames(batches, rows_of, names)
    return files.select("path", "content").mapInPandas(run, schema.format(path=files.schema["path"].dataType.simpleString()))


def facts(files: DataFrame, **wanted: str) -> DataFrame:
    """path, kind and the facts of each kind of row, in the columns of FACTS; all, or the kinds and columns that are named: function="name line".

    Where only kinds are named that a word of the language goes with, texts without it are not parsed.
    """
    if not wanted:
        return _each(files, _facts, FACTS)
    asked = {kind: frozenset(columns.split()) for kind, columns in wanted.items()}
    unknown = [f"{kind}.{c}" for kind, columns in asked.items() for c in columns - ALL[kind]]
    if unknown:
        raise ValueError(f"no such facts: {', '.join(unknown)}")
    own = ", ".join(c for c in FACTS.split(", ") if c.split()[0] in {"path", "kind"}.union(*asked.values()))
    names = tuple(c.split()[0] for c in own.split(", "))
    if asked.keys() <= _WORDS.keys():
        files = files.where(reduce(or_, [F.col("content").contains(_WORDS[kind]) for kind in asked]))
    return _each(files, lambda path, source: _facts(path, source, asked, names), own)


def functions(files: DataFrame) -> DataFrame:
    """One row for each function or method; files that do not parse give none."""
    return functions_of(facts(files, function="name owner line lines args complexity cognitive nesting documented"))


def functions_of(found: DataFrame) -> DataFrame:
    return found.where("kind = 'function'").select("path", "name", F.col("owner").alias("class_name"), F.col("line").alias("line_start"), (F.col("line") + F.col("lines") - 1).alias("line_end"), F.size("args").alias("args"), "complexity", "cognitive", "nesting", "documented")


#: Grades by complexity (most points of a grade) and by maintainability (least index): fixed values.
COMPLEXITY_GRADES = [("A", 5), ("B", 10), ("C", 15), ("D", 20)]
MAINTAINABILITY_GRADES = [("A", 85), ("B", 75), ("C", 65), ("D", 50)]


def complexity_grade(points: Column) -> Column:
    return F.coalesce(*[F.when(points <= most, grade) for grade, most in COMPLEXITY_GRADES], F.lit("F"))


def maintainability_grade(index: Column) -> Column:
    return F.coalesce(*[F.when(index >= least, grade) for grade, least in MAINTAINABILITY_GRADES], F.lit("F"))


def halstead_columns() -> dict[str, Column]:
    """vocabulary, length, volume, difficulty, effort, time_s, bugs from the four counts; zero where the vocabulary is at most 1."""
    n1, n2, ops, opds = (F.col(c) for c in ("operator_kinds", "operand_kinds", "operators", "operands"))
    some = n1 + n2 > 1
    of = lambda c: F.when(some, c).otherwise(0.0)
    volume = of(F.round((ops + opds) * F.log2((n1 + n2).cast("double")), 2))
    difficulty = of(F.round(n1 / 2 * (opds / F.greatest(n2, F.lit(1))), 2))
    effort = F.round(volume * difficulty, 2)
    whole = lambda c: F.when(some, c).otherwise(0).cast("long")
    return {"vocabulary": whole(n1 + n2), "length": whole(ops + opds), "volume": volume, "difficulty": difficulty, "effort": effort, "time_s": F.round(effort / 18, 2), "bugs": F.round(volume / 3000, 4)}


def halstead_functions(files: DataFrame) -> DataFrame:
    """path, name, line_start, Halstead metrics by the syntax tree, maintainability index and grades of each function and method."""
    rows = facts(files, function=f"name line lines complexity {' '.join(VOCABULARY)}").withColumns(halstead_columns())
    index = maintainability(F.col("volume"), F.col("complexity"), F.col("lines").cast("double"))
    rows = rows.withColumn("maintainability", index)
    return rows.select("path", "name", F.col("line").alias("line_start"), *halstead_columns(), "maintainability", complexity_grade(F.col("complexity")).alias("complexity_grade"), maintainability_grade(F.col("maintainability")).alias("maintainability_grade"))


def file_quality(files: DataFrame) -> DataFrame:
    """path, code_lines, functions, classes, average and largest complexity, average cognitive points, maintainability and grades of each file that parses.

    The index is that of the whole text's volume, its worst function and its lines of code.
    """
    is_a, own = lambda kind: F.col("kind") == kind, lambda c: F.when(F.col("kind") == "function", F.col(c))
    whole = F.first(F.when(is_a("file"), F.struct("code_lines", "operator_kinds", "operand_kinds", "operators", "operands")), ignorenulls=True)
    mean = lambda c: F.round(F.coalesce(F.avg(own(c)), F.lit(0.0)), 2)
    rows = facts(files, file=f"code_lines {' '.join(VOCABULARY)}", function="complexity cognitive", **{"class": ""}).groupBy("path").agg(
        whole.alias("w"), F.count_if(is_a("function")).alias("functions"), F.count_if(is_a("class")).alias("classes"), mean("complexity").alias("avg_complexity"), F.coalesce(F.max(own("complexity")), F.lit(0)).alias("max_complexity"), mean("cognitive").alias("avg_cognitive"))
    rows = rows.select("*", "w.*").withColumn("volume", halstead_columns()["volume"])
    worst = F.greatest("max_complexity", F.lit(1))
    rows = rows.withColumn("maintainability", maintainability(F.col("volume"), worst, F.greatest("code_lines", F.lit(1)).cast("double")))
    return rows.select("path", "code_lines", "functions", "classes", "avg_complexity", "max_complexity", "avg_cognitive", "volume", "maintainability", maintainability_grade(F.col("maintainability")).alias("maintainability_grade"), complexity_grade(worst).alias("grade"))


def tree_findings(files: DataFrame) -> DataFrame:
    """path, line, rule, severity, name of each finding of the syntax-tree rules.

    The parse gives facts; the rules are conditions on them.
    """
    f, is_a = F.col, lambda kind: F.col("kind") == kind
    own = F.filter("args", lambda a: a != "self")
    shadows = F.size(F.filter("args", lambda a: a.isin(BUILTINS)))
    flags = F.size(F.filter("args", lambda a: a.rlike("|".join(FLAG_WORDS))))
    rules = [
        ("PY000", "CRITICAL", is_a("error"), None),
        ("PY002", "HIGH", is_a("handler"), None),
        ("SEC-PY-012", "MEDIUM", is_a("handler") & f("silent"), None),
        ("PY003", "HIGH", is_a("function") & (f("mutable_defaults") > 0), f("mutable_defaults")),
        ("PY004", "LOW", is_a("number"), None),
        ("PY007", "MEDIUM", is_a("function") & f("lines").between(51, 100), None),
        ("PY015", "HIGH", is_a("function") & (f("lines") > 100), None),
        ("PY008", "MEDIUM", is_a("class") & (f("lines") > 200), None),
        ("PY009", "MEDIUM", is_a("function") & (F.size("args") > 5), None),
        ("PY010", "MEDIUM", is_a("function") & (shadows > 0), shadows),
        ("PY011", "LOW", is_a("function") & ~f("annotated") & (f("name") != "__init__"), None),
        ("REF-PY-001", "HIGH", is_a("function") & (f("lines") > 40) & ((f("plain_complexity") > 5) | (f("lines") > 60)), None),
        ("REF-PY-002", "HIGH", is_a("class") & ((f("methods") > 10) | (f("lines") > 300)), None),
        ("REF-PY-003", "MEDIUM", is_a("function") & (F.size(own) > 4), None),
        ("REF-PY-005", "MEDIUM", is_a("function") & (f("nesting") > 3), None),
        ("REF-PY-008", "LOW", is_a("function") & f("unreachable"), None),
        ("REF-PY-009", "LOW", is_a("function") & (flags > 0), flags),
        ("REF-PY-DI", "MEDIUM", is_a("class") & f("creates").isNotNull(), None),
    ]
    hit = lambda rule, severity: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))
    none = F.array().cast("array<struct<rule:string,severity:string>>")
    found = F.concat(*[F.when(when, F.array_repeat(hit(rule, severity), F.lit(1) if times is None else times)).otherwise(none) for rule, severity, when, times in rules])
    wanted = {"function": "name line lines args mutable_defaults annotated plain_complexity nesting unreachable", "class": "name line lines methods creates", "handler": "line silent", "number": "name line", "error": "line"}
    return facts(files, **wanted).select("path", "line", "name", F.explode(found).alias("h")).select("path", "line", "h.rule", "h.severity", "name")


def loops(files: DataFrame) -> DataFrame:
    return _each(files, _loops, LOOPS)


def imports(files: DataFrame) -> DataFrame:
    """One row for each imported name; files that do not parse give none."""
    return _each(files, _imports, IMPORTS)


def file_complexity(files: DataFrame) -> DataFrame:
    """Functions of each file, their mean and largest complexity, mean cognitive points, and how many exceed 10."""
    return facts(files, function="complexity cognitive").groupBy("path").agg(F.count("*").alias("functions"), F.round(F.avg("complexity"), 2).alias("avg_complexity"), F.max("complexity").alias("max_complexity"), F.round(F.avg("cognitive"), 2).alias("avg_cognitive"), F.count_if(F.col("complexity") > 10).alias("complex_functions"))


def class_complexity(files: DataFrame) -> DataFrame:
    """Methods of each class, mean and largest complexity, and its bases; a class without methods has 0."""
    rows = with_classes(files, function="owner complexity", **{"class": "name bases"}).where("kind = 'class' or owner is not null")
    name = F.when(F.col("kind") == "class", F.col("name")).otherwise(F.col("owner"))
    own = F.when(F.col("kind") == "function", F.col("complexity"))
    out = rows.groupBy("path", name.alias("class_name")).agg(F.count(own).alias("methods"), F.coalesce(F.round(F.avg(own), 2), F.lit(0.0)).alias("avg_complexity"), F.coalesce(F.max(own), F.lit(0)).alias("max_complexity"), F.first("bases", ignorenulls=True).alias("bases"))
    return out.withColumn("bases", F.array_join("bases", ","))


def class_edges(files: DataFrame) -> DataFrame:
    """path, class_name, base of each base that is a class of the corpus, by its last name."""
    return class_edges_of(materialize(facts(files, **{"class": "name bases"}), "classes"))


def with_classes(files: DataFrame, **wanted: str) -> DataFrame:
    """Facts of the files that may hold classes."""
    return facts(files.where(F.col("content").contains(_WORDS["class"])), **wanted)


def class_edges_of(found: DataFrame) -> DataFrame:
    """The same from facts; a written table, as it is read for the classes and for their bases."""
    classes = found.where("kind = 'class'").select("path", F.col("name").alias("class_name"), "bases")
    bases = classes.select("path", "class_name", F.explode("bases").alias("base")).withColumn("base", F.regexp_extract("base", r"([^.\[\(]*)(?:[\[\(].*)?$", 1))
    return bases.join(classes.select(F.col("class_name").alias("base")).distinct(), "base", "left_semi").select("path", "class_name", "base")


def project_complexity(files: DataFrame, digits: int = 2) -> DataFrame:
    """For each project the averages of its files' averages, its functions, and its worst file; files without functions count as 0."""
    by_file = files.select("path", "project").join(file_complexity(files), "path", "left").na.fill(0)
    worst = F.max_by("path", F.struct("max_complexity", "avg_complexity", "path"))
    # averages of files have two places: whole hundredths add up to the same number in any order
    mean = lambda c: F.round(F.sum(F.round(F.col(c) * 100)) / (F.count("*") * 100), digits).alias(c)
    return by_file.groupBy("project").agg(F.count("*").alias("files"), F.sum("functions").alias("functions"), mean("avg_complexity"), mean("avg_cognitive"), F.max("max_complexity").alias("max_complexity"), worst.alias("worst_file"))


def magic_numbers(files: DataFrame, most: int = 3) -> DataFrame:
    """path, value, line of the first distinct unusual numbers of each file, as REF-PY-004 reports them."""
    rows = facts(files, number="name line").groupBy("path", F.col("name").alias("value")).agg(F.min("line").alias("line"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("line", "value"))
    return rows.withColumn("place", place).where(F.col("place") <= most).drop("place")

from __future__ import annotations

import ast

import pandas as pd
import pytest

from kilnspark.operators import performance, pyast, scripts
from kilnspark.sources.samples import SAMPLES, SCRIPT

SUM = "def add(" + "a0" + "):\n    return " + " + ".join(f"a{i}" for i in range(5000)) + "\n"
CHAIN = "def pick(x):\n    if x == 0:\n        return 0\n" + "".join(f"    elif x == {i}:\n        return {i}\n" for i in range(1, 1201))
ATTRIBUTES = "class A(" + "b" + ".b" * 3000 + "):\n    pass\n"
SUBSCRIPTS = "def f(d):\n" + "".join("    " * (i + 1) + f"for x{i} in d:\n" for i in range(15)) + "    " * 16 + "y = " + " + ".join("d[0]" for _ in range(3000)) + "\n"
NUMBER = "x = 0x" + "f" * 20000 + "\n"


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "path long, content string").selectExpr("path", "content", "'python' AS language", "'p' AS project")


def test_no_source_kills_a_job(spark):
    df = frame(spark, [SUM, CHAIN, ATTRIBUTES, SUBSCRIPTS, NUMBER, "def (", None, "", "\x00", "(" * 5000])
    rows = {(r.path, r.name): r for r in pyast.functions(df).collect()}
    assert rows[0, "add"].complexity == 1 and rows[1, "pick"].complexity == 1202 and rows[1, "pick"].nesting == 1201 and rows[3, "f"].nesting == 15
    assert rows[1, "pick"].cognitive == 1201  # the if and each elif; returns are worth nothing
    for query in (pyast.file_complexity, pyast.class_complexity, pyast.class_edges, pyast.project_complexity, pyast.magic_numbers, pyast.tree_findings, pyast.halstead_functions, pyast.file_quality, performance.python_findings, pyast.imports):
        query(df).collect()
    assert {r.path for r in pyast.tree_findings(df).where("rule = 'PY000'").collect()} == {5, 8, 9}


def points_by_recursion(function):
    """The cognitive rules as a plain recursion over the tree."""

    def of(x, depth, chain):
        if isinstance(x, ast.If):
            total = 1 + depth + sum(of(y, depth + 1, None) for y in x.body)
            for y in x.orelse:
                total += 1 + of(y, depth + 1, None) - (depth + 2 if isinstance(y, ast.If) else 0)
            return total
        if isinstance(x, ast.With):
            return 1 + depth + sum(of(y, depth + 1, None) for y in x.body)
        if isinstance(x, ast.For | ast.AsyncFor | ast.While | ast.Try):
            return 1 + depth + sum(of(y, depth + 1, None) for y in ast.iter_child_nodes(x))
        if isinstance(x, ast.Lambda | ast.ListComp | ast.SetComp | ast.DictComp | ast.GeneratorExp):
            return 1
        if isinstance(x, ast.BoolOp):
            return (type(x.op) is not chain) + sum(of(y, depth, type(x.op)) for y in x.values if isinstance(y, ast.BoolOp))
        own = isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and x.func.id == function.name
        return own + sum(of(y, depth, chain) for y in ast.iter_child_nodes(x))

    return sum(of(x, 0, None) for x in function.body)


MIXED = '''
@outer(1 + 2)
def f(a, b=[1, 2], *, c: int = 3) -> int:
    """Text."""
    with a as x, b as y:
        for i in range(3):
            if a and b or (c and not a):
                continue
            elif a < i <= 4:
                a += i ** 2
            else:
                while True:
                    f(1)
                    break
    try:
        return [k for k in b if k if k > 1] and (lambda z: z if z else 0)
    except (ValueError, TypeError):
        raise
    finally:
        def inner():
            if a:
                return a.b.c[0]
class K(f.G[int], metaclass=M):
    async def g(self):
        async for t in self.u:
            yield t
'''


@pytest.mark.parametrize("text", [MIXED, CHAIN[:3000].rsplit("\n    elif", 1)[0] + "\n", *[t for e, t in SAMPLES if e == "py"]])
def test_metrics_equal_plain_walks(text):
    try:
        tree = ast.parse(text)
    except SyntaxError:
        assert [r[1] for r in pyast._facts("p", text)] == ["error"]
        return
    names = [c.split()[0] for c in pyast.FACTS.split(", ")]
    found = {(r["name"], r["line"]): r for r in (dict(zip(names, row, strict=True)) for row in pyast._facts("p", text)) if r["kind"] == "function"}
    functions = [x for x in ast.walk(tree) if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef)]
    assert len(found) == len(functions)

    def depth(x, d=0):
        return max([d, *(depth(y, d + isinstance(y, ast.If | ast.While | ast.For | ast.AsyncFor | ast.With | ast.AsyncWith | ast.Try)) for y in ast.iter_child_nodes(x))])

    for x in functions:
        row = found[x.name, x.lineno]
        assert row["cognitive"] == points_by_recursion(x) and row["nesting"] == depth(x)
        assert row["complexity"] == 1 + sum(pyast.branch_points(y) for y in ast.walk(x)) and row["plain_complexity"] == 1 + sum(pyast.plain_points(y) for y in ast.walk(x))
        bare = ast.parse(ast.unparse(x)).body[0]
        bare.decorator_list = []
        pairs = [pyast.signs(y) for y in ast.walk(bare)]
        ops, opds = [o for a, _ in pairs for o in a], [o for _, b in pairs for o in b]
        assert (row["operator_kinds"], row["operand_kinds"], row["operators"], row["operands"]) == (len(set(ops)), len(set(opds)), len(ops), len(opds))


def test_halstead_of_a_known_function(spark):
    """x = a + b; return x: operators FunctionDef, Assign, Add, Return; operands x, a, b, x."""
    (row,) = pyast.halstead_functions(frame(spark, ["def f(a, b):\n    x = a + b\n    return x\n"])).collect()
    assert (row.vocabulary, row.length, row.volume, row.difficulty, row.effort) == (7, 8, 22.46, 2.67, 59.97)
    assert (row.complexity_grade, row.maintainability, row.maintainability_grade) == ("A", 80.0, "B")
    rows = {r.path: r for r in pyast.file_quality(frame(spark, ["", "import os\n", "def f(:"])).collect()}
    assert set(rows) == {0, 1} and rows[0].maintainability == 100.0 and rows[1].grade == "A"


def test_scripts_by_counting_braces():
    """Bodies found by counting from each opening brace anew."""
    texts = [SCRIPT, "function a(x, y) { if (x) { y } else { function b() { while (1) { } } } }\n} const c = async (q) => { return q && q }", "const d = x => { for (;;) {", "function e() {}" * 3 + "{" * 50, "", "}}}{", "async function g() {\n  switch (a) {\n  case 1:\n  }\n}"]
    for text in texts:
        got = list(scripts.Script(text).functions())
        want = []
        for m in scripts.FUNCTION.finditer(text):
            start = text.find("{", m.start())
            if start < 0:
                continue
            depth, end = 0, min(len(text), start + scripts.OPEN_BODY)
            for i in range(start, len(text)):
                depth += {"{": 1, "}": -1}.get(text[i], 0)
                if depth == 0:
                    end = i + 1
                    break
            body, first = text[start:end], text[: m.start()].count("\n") + 1
            points = level = 0
            for line in map(str.strip, body.split("\n")):
                if scripts.NESTING.search(line):
                    points, level = points + 1 + level, level + 1
                elif line.startswith("}") and level:
                    level -= 1
                points += "&&" in line or "||" in line
            want.append((m[1] or m[2], first, first + body.count("\n"), max(1, len(scripts.BRANCH.findall(body))), points, len(set(scripts.OPERAND.findall(body)))))
        assert [(f["name"], f["line_start"], f["line_end"], f["complexity"], f["cognitive"], f["operand_kinds"]) for f in got] == want
    by_name = {f["name"]: f["is_async"] for f in scripts.Script(texts[1] + texts[6]).functions()}
    assert by_name == {"a": False, "b": False, "c": True, "g": True}


def test_many_open_functions_are_read_fast(spark):
    rows = scripts.script_functions(frame(spark, ["function f(a) {\n" * 3000, None])).collect()
    assert len(rows) == 3000


def test_rows_of_a_batch_go_on_in_pieces():
    """A worker holds the rows of at most 256 files, however many are in its batch; contexts and signs are no nodes."""
    batch = pd.DataFrame({"path": range(1000), "content": ["def f(a):\n    return a + 1\n"] * 1000})
    names = [c.split()[0] for c in pyast.FACTS.split(", ")]
    frames = list(pyast._frames(iter([batch]), pyast._facts, names))
    assert [f.path.nunique() for f in frames] == [256, 256, 256, 232]
    assert sum(len(f) for f in frames) == 2000
    assert not any(isinstance(x, ast.expr_context | ast.operator) for x in pyast.Flat(ast.parse("a = b + c")).nodes)


def test_queries_work_out_only_what_they_use(monkeypatch):
    """What is not named is not worked out, and what is named is as in the whole rows."""
    names = [c.split()[0] for c in pyast.FACTS.split(", ")]
    whole = [dict(zip(names, row, strict=True)) for row in pyast._facts("p", MIXED)]
    for name in ("signs", "cognitive", "plain_points", "python_kinds", "_created"):
        monkeypatch.setattr(pyast, name, None)
    wanted = {"function": frozenset(("name", "complexity")), "class": frozenset(("name", "bases"))}
    own = ("kind", "name", "complexity", "bases")
    assert list(pyast._facts("p", MIXED, wanted, own)) == [tuple(r[c] for c in own) for r in whole if r["kind"] in wanted]


def test_texts_without_classes_are_not_parsed(spark):
    """Files that cannot hold what is asked for do not reach a parser, even where they are broken."""
    df = frame(spark, ["def f(:", "x = 1", None, "class A(B): pass\nclass B:\n    def m(self):\n        pass\n", "# class\ndef g(): pass"])
    assert sorted((r.path, r["class_name"], r.base) for r in pyast.class_edges(df).collect()) == [(3, "A", "B")]
    plan = pyast.facts(df, **{"class": "name bases"})._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(content" in plan and "Contains(content" not in pyast.facts(df, number="name", function="line")._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.path, r.kind) for r in pyast.with_classes(df, function="owner").collect()) == [(3, "function"), (4, "function")]
    with pytest.raises(ValueError):
        pyast.facts(df, function="silent")


def test_tasks_of_texts_do_not_grow_with_the_table(spark, sf_dir, monkeypatch):
    from kilnspark.sources import samples

    n = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    monkeypatch.setattr(samples, "TEXTS_A_TASK", 7)
    assert samples.code_files(spark, sf_dir).rdd.getNumPartitions() == -(-n // 7)

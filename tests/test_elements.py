from __future__ import annotations

import ast
import random
import re

from kilnspark.operators import elements

PIECES = [
    "export async function load{n}(url: string, tries) {\n  return 1;\n}\n", "const run{n} = async (x,\n  y: number): T => {\n};\n", "export class View{n} extends Base {\n}\n", "class Bare{n} {\n}\n", "interface Shape{n} {\n}\n",
    "/** says what it does */\n", "// plain\n", "let n{n} = 4;\n" * 3, "x" * 150 + ";\n", "/***/", "function f{n}() { }\n",
]


def plain(text):
    out = []
    for kind, pattern, args, base in elements.SCRIPT_ELEMENTS:
        for m in re.finditer(pattern, text, re.ASCII):
            names = ",".join(a.split(":")[0].strip() for a in (m[args] or "").split(",") if a.strip()) if args else ""
            out.append((kind, m[1], names, (m[base] or "") if base else "", text.count("\n", 0, m.start()) + 1, "/**" not in text[max(0, m.start() - 200) : m.start()]))
    return sorted(out)


def test_elements_of_scripts_and_their_comments(spark):
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice(PIECES).replace("{n}", str(rng.randrange(50))) for _ in range(rng.randrange(25)))) for i in range(50)] + [(90, None), (91, ""), (92, "/**" + " " * 197 + "class A {}"), (93, "/**" + " " * 198 + "class A {}"), (94, "/**class A {}")]
    df, got = spark.createDataFrame(rows, "path long, content string"), {}
    for r in elements.script_elements(df).collect():
        got.setdefault(r.path, []).append((r.kind, r.name, r.args, r.base, r.line, r.needs_doc))
    for path, text in rows:
        assert sorted(got.get(path, [])) == plain(text or ""), path
    assert elements.script_elements(df.limit(0)).collect() == []


SOURCE = '''
class A(Base, m.B[int]):
    """Long enough to document a class."""
    def __init__(self, a: int, b=1):
        self.a = a if a else b
    async def go(self) -> list[int]:
        "short"
        def inner(x):
            raise x
        for i in x:
            try:
                pass
            except E:
                raise
    def __repr__(self):
        return ""
    def _own(self): pass
    class Inner:
        def deep(self): pass
def top(x: str, *rest, y=2) -> None:
    """Says at length what it is there for."""
    while x: pass
'''


def brute_targets(tree):
    """By a walk from each class and each function anew."""
    owner = {}
    for c in ast.walk(tree):
        if isinstance(c, ast.ClassDef):
            owner |= {id(f): c.name for f in ast.walk(c) if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef)}
    for x in ast.walk(tree):
        if isinstance(x, ast.ClassDef):
            yield "class", x.name, None, 1 + sum(isinstance(y, ast.FunctionDef | ast.AsyncFunctionDef) and not y.name.startswith("__") for y in x.body)
        elif isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef) and (not x.name.startswith("__") or x.name == "__init__"):
            has = lambda *k: any(isinstance(y, k) for y in ast.walk(x))  # noqa: B023, E731
            score = 1 + 2 * has(ast.If, ast.IfExp) + has(ast.For, ast.While) + has(ast.Raise) + has(ast.Try)
            yield ("method" if id(x) in owner else "function"), x.name, owner.get(id(x)), score


def test_elements_and_targets_of_python(spark):
    df = spark.createDataFrame([(1, SOURCE), (2, "def ("), (3, None), (4, "x = " + " + ".join("a" * 9 for _ in range(5000)))], "path long, content string")
    got = {(r.kind, r.name): r for r in elements.python_elements(df).collect()}
    assert {k: r.needs_doc for k, r in got.items()} == {("class", "A"): False, ("class", "Inner"): True, ("function", "__init__"): True, ("function", "go"): True, ("function", "inner"): True, ("function", "__repr__"): True, ("function", "_own"): True, ("function", "deep"): True, ("function", "top"): False}
    assert (got["class", "A"].bases, got["class", "A"].methods) == ("Base,m.B[int]", "__init__,go,__repr__,_own")
    assert (got["function", "top"].args, got["function", "top"].return_type, got["function", "go"].is_async) == ("x: str", "None", True)
    found = elements.test_targets(df).collect()
    assert sorted(((r.kind, r.name, r.class_name, r.score) for r in found), key=str) == sorted(brute_targets(ast.parse(SOURCE)), key=str)
    assert {r.name: r.args for r in found}["A"] == "a: int, b: Any" and {r.name for r in found if r.score == 4} == {"go"}


def test_targets_of_scripts(spark):
    far = "function far(a, b: T) {" + " " * 480 + "if (a) { throw a; } for (;;) {} }\n"
    text = "export async function near() {\n  switch (x) { }\n  while (1) { throw y; }\n}\n" + " " * 500 + "\nfunction bare(iffy, form) {}" + " " * 500 + far + "const run = async (q) => 1; class A extends B {} class C {}"
    df = spark.createDataFrame([(1, text), (2, None)], "path long, content string")
    got = {r.name: (r.kind, r.base, r.is_async, r.args, r.conditions, r.loops, r.raises, r.score, r.line) for r in elements.script_targets(df).collect()}
    assert got == {
        "near": ("function", None, True, "", True, True, True, 2, 1), "bare": ("function", None, False, "iffy,form", False, False, False, 2, 6), "far": ("function", None, False, "a,b", False, False, False, 2, 6),
        "run": ("arrow_function", None, True, "q", False, False, False, 1, 7), "A": ("class", "B", None, None, False, False, False, 2, 7), "C": ("class", None, None, None, False, False, False, 2, 7),
    }

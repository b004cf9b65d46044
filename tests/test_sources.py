from __future__ import annotations

import datetime

from kilnspark.operators import pyast
from kilnspark.sources import gitlog

LOG = """abc1234|a@x.org|Ann|2024-01-15 10:00:00 +0000|fix: a|b bug
5\t2\tsrc/main.py
-\t-\tlogo.png

def5678|b@x.org|Bob|2024-01-16 11:00:00 +0100|rename
1\t0\tsrc/{old => new}/x.py
0\t3\ta.py => b.py
"""


def test_log_is_parsed(spark):
    commits = gitlog.parse_commits(spark.createDataFrame([(LOG,), (None,), ("",)], "raw string"))
    rows = {r.hash: r for r in commits.collect()}
    assert set(rows) == {"abc1234", "def5678"}
    assert rows["abc1234"].message == "fix: a|b bug" and rows["abc1234"].author_name == "Ann"
    assert rows["def5678"].day == datetime.datetime(2024, 1, 16, 10, 0)
    assert [tuple(c) for c in rows["abc1234"].changes] == [("src/main.py", 5, 2, False), ("logo.png", 0, 0, False)]
    assert [c.path for c in rows["def5678"].changes] == ["src/new/x.py", "b.py"] and all(c.is_rename for c in rows["def5678"].changes)
    assert gitlog.file_changes(commits).count() == 4


SOURCE = '''
import os
from . import b as c

class A:
    def m(self, x, *, y=1):
        "doc"
        if x and y or x:
            return [i for i in x if i]
        for i in x:
            while i:
                pass

def plain():
    return 1
'''


def test_syntax_trees(spark):
    files = spark.createDataFrame([(1, SOURCE), (2, "def ("), (3, None)], "path long, content string")
    got = {r.name: r for r in pyast.functions(files).collect()}
    assert set(got) == {"m", "plain"}
    assert (got["m"].class_name, got["m"].args, got["m"].documented) == ("A", 3, True)
    # if, and, or, filter, for, while
    assert (got["m"].complexity, got["plain"].complexity, got["m"].nesting) == (7, 1, 2)
    assert {(r.module, r.name, r.level) for r in pyast.imports(files).collect()} == {("os", None, 0), (None, "b", 1)}
    assert pyast.file_complexity(files).first().max_complexity == 7


def test_tree_rules(spark):
    long = "def big(a, b, c, d, e, mode=[], *, id=0):\n" + "    x = a\n" * 60 + "    return 7\n    x = 1\n"
    files = spark.createDataFrame([(1, long), (2, "try:\n    f()\nexcept:\n    pass\n"), (3, "def ok(x) -> int:\n    return 1\n"), (4, "(")], "path long, content string")
    got = {}
    for r in pyast.tree_findings(files).collect():
        got.setdefault(r.path, set()).add(r.rule)
    assert got == {
        1: {"PY003", "PY004", "PY007", "PY009", "PY010", "PY011", "REF-PY-001", "REF-PY-003", "REF-PY-008", "REF-PY-009"},
        2: {"PY002", "SEC-PY-012"},
        4: {"PY000"},
    }

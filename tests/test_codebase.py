"""Operators over code, held against plain passes and cases worked out by hand."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from kilnspark.operators import checks, chunks, files, graph, history, lines, paths, performance, pyast, rules, similarity, summaries, telemetry, vectors
from kilnspark.sources import gitlog

LOG = """abcdef1234|ann@x.org|Ann|2024-01-15 10:00:00 +0000|fix crash
3\t1\tsrc/a.py
-\t-\timg.png

abcdef5678|bob@x.org|Bob|2024-01-16 10:00:00 +0000|add b
5\t0\tsrc/b.py
2\t2\tsrc/{a.py => c.py}
"""


def code(spark, *texts, language="python"):
    return spark.createDataFrame([(f"f{i}", t, language) for i, t in enumerate(texts)], "path string, content string, language string")


def test_branches_beside_each_other_count(spark):
    got = files.complexity_estimate(code(spark, "if if if", "else\nelse\nelse", "iffy elif_x", "a && b || c ? d", None)).orderBy("path").collect()
    assert [r.cc for r in got] == [4, 4, 1, 4, 1]


def test_git_log_with_string_paths_to_summary(spark):
    parsed = gitlog.parse_commits(spark.createDataFrame([(LOG,), (None,)], "raw string"))
    commits = parsed.selectExpr("hash", "author_name AS author", "day", "message")
    changes = gitlog.file_changes(parsed)
    got = history.git_summary(commits, changes, history.BUG_KEYWORDS).first()
    assert (got.commits, got.authors, got.files, got.additions, got.most_active_file, got.most_active_author, got.bug_commits) == (2, 2, 4, 10, "img.png", "Ann", 1)
    empty = history.git_summary(commits.limit(0), changes.limit(0), history.BUG_KEYWORDS).first()
    assert (empty.commits, empty.additions, empty.most_active_file, empty.bug_ratio) == (0, 0, None, 0.0)


def test_commit_names(spark):
    rows = spark.createDataFrame([("h", None, "a@x", "now"), ("", "s", None, None)], "hash string, sha string, email string, timestamp string")
    assert [tuple(r) for r in gitlog.from_aliases(rows).collect()] == [("h", "a@x", "", "now", ""), ("s", "", "", "", "")]


def test_string_ids_go_through(spark):
    edges = spark.createDataFrame([("a.py", "b.py"), ("b.py", "c.py"), ("c.py", "a.py"), ("d.py", "a.py")], "src string, dst string")
    reached = graph.transitive(edges, spark.createDataFrame([("d.py",)], "node string")).collect()
    assert {(r.node, r.steps) for r in reached} == {("a.py", 1), ("b.py", 2), ("c.py", 3)}
    vecs = spark.createDataFrame([("v0", [1.0, 0.0]), ("v1", [0.9, 0.1]), ("v2", [0.0, 1.0])], "chunk string, embedding array<float>")
    assert [r.chunk for r in vectors.cosine_topk(vecs, vecs.where("chunk = 'v0'"), 2).orderBy("place").collect()] == ["v1", "v2"]
    asked = spark.createDataFrame([(f"r{i}", "u", i) for i in range(4)], "id string, user_id string, s long").selectExpr("id", "user_id", "timestamp_seconds(s) AS ts")
    assert [r.allowed for r in telemetry.rate_limit_decisions(asked, 3, 60).orderBy("id").collect()] == [True, True, True, False]
    assert pyast.functions(code(spark, "def f(a): pass", None)).first().path == "f0"


def test_strong_components_equal_mutual_reach(spark):
    rng = random.Random(5)
    for n, m in ((12, 14), (15, 30), (8, 6)):
        edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)} | {(100, 101), (101, 102)})
        nodes = {x for e in edges for x in e}
        reach = {a: {a} for a in nodes}
        for _ in nodes:
            for s, d in edges:
                for a in nodes:
                    if s in reach[a]:
                        reach[a].add(d)
        want = {a: min(b for b in nodes if b in reach[a] and a in reach[b]) for a in nodes if (a, a) in edges or any(b != a and b in reach[a] and a in reach[b] for b in nodes)}
        frame = spark.createDataFrame(edges, "src long, dst long")
        assert {r.node: r.component for r in graph.strong_components(frame).collect()} == want
        marked = {(r.src, r.dst): r.in_cycle for r in graph.edges_in_cycles(frame).collect()}
        assert marked == {(s, d): s in want and want.get(s) == want.get(d) for s, d in edges}
    assert graph.strong_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_every_script_rule_fires_on_its_line_only(spark):
    cases = {
        "SEC-JS-001": "apiKey: 'abcdef1'", "SEC-JS-002": "eval(x)", "SEC-JS-003": "document.write(x)", "SEC-JS-004": "query(`select ${x}`)",
        "SEC-JS-005": "Math.random()", "SEC-JS-006": "jwt.sign(a, 'sixsix')", "SEC-JS-009": "location.href = x", "SEC-JS-010": "localStorage.setItem('auth', x)",
        "SEC-JS-011": "fetch(x)", "SEC-JS-013": "execSync(x)", "SEC-JS-015": "dangerouslySetInnerHTML",
    }
    got = rules.findings(code(spark, *[f"clean(1)\n{v}\nretrieval('x')" for v in cases.values()]), rules.JS_SECURITY).collect()
    assert {(r.path, r.rule) for r in got} >= {(f"f{i}", k) for i, k in enumerate(cases)} and {r.line_number for r in got} == {2}
    found = rules.script_suggestions(code(spark, "on(function(a) { go(function(b) {}) })", "var x", "x: any; y: any", "company")).collect()
    assert {(r.path, r.rule) for r in found} == {("f0", "REF-JS-003"), ("f1", "REF-JS-002"), ("f2", "REF-JS-007")}


def test_counts_by_severity_are_those_of_the_findings(spark):
    texts = ["x = 1\n# TODO: a\nprint(x)\n" + "y" * 130, "password = 'abcd'\n\nprint(1)\nprint(2)", "", None, "éclair # todo"]
    found = rules.findings(code(spark, *texts), rules.PYTHON_REVIEW).groupBy("path", "severity").count().collect()
    got = {r.path: r for r in rules.severity_counts(code(spark, *texts), rules.PYTHON_REVIEW).collect()}
    assert {(p, s): r[s.lower()] for p, r in got.items() for s in rules.SEVERITIES if r[s.lower()]} == {(r.path, r.severity): r["count"] for r in found}


def test_line_kinds_and_loops():
    source = 'def f():\n    """One.\n\n    Two"""\n    x = 1  # y\n    # """ no\n\n    """a""" \n'.splitlines()
    assert lines.python_kinds(source) == ["code", "docstring", "blank", "docstring", "code", "comment", "blank", "docstring"]
    assert lines.script_kinds(["/* a", "b", "c */", "", "// d", "x();", "/* e */"]) == ["comment"] * 3 + ["blank", "comment", "code", "comment"]
    assert lines.python_loops(["for a in b:", "    x", "    if y:", "z", "w"]) == [True, True, True, False, False]
    assert lines.script_loops(["for (;;) {", "while (x) {", "}", "a", "}", "b"]) == [True, True, True, True, False, False]


def test_performance_limits_and_files_that_do_not_parse(spark):
    loop = "for a in b:\n    for c in d:\n        pass\n"
    got = performance.python_findings(code(spark, loop * 6, "for (:\n  x.sort()", "", None)).collect()
    assert {r.path for r in got} == {"f0"} and sorted(r.line for r in got) == [1, 4, 7, 10]
    graded = {r.path: r for r in performance.performance_rollup(code(spark, loop, "x = 1"), performance.python_findings(code(spark, loop))).collect()}
    assert graded["f0"].score == 20 and graded["f1"].grade.startswith("GOOD")


def test_chunks_cover_and_cut(spark):
    big = "class Big(object):\n    x = 1\n" + "".join(f"    def m{i}(self):\n" + "".join(f"        a{j} = {j}\n" for j in range(20)) for i in range(9)) + "\n" + "".join(f"v{i} = {i}\n" for i in range(300))
    got = [(r.chunk_type, r.name, r.line_start, r.line_end) for r in chunks.code_chunks(code(spark, big, "", None)).orderBy("line_start").collect()]
    methods = [("method", f"Big.m{i}", 3 + 21 * i, 23 + 21 * i) for i in range(9)]
    assert got == [("class_header", "Big", 1, 2), *methods, ("module_part", "module", 192, 311), ("module_part", "module", 308, 427), ("module_part", "module", 424, 492)]
    text = "".join(f"line {i:03d}\n" for i in range(100))
    cut = chunks.character_chunks(code(spark, text, "", " \n "), 200, 40).orderBy("chunk").collect()
    assert {r.path for r in cut} == {"f0"} and cut[0].content == text[:207] and cut[0].line_end == 23
    rebuilt = cut[0].content + "".join(r.content[40:] for r in cut[1:])
    assert rebuilt == text and (cut[1].line_start, cut[1].content[:40]) == (18, text[167:207])


def test_overlaps_leave_the_better_chunk(spark):
    rows = [(1, 1, "a", 1, 10), (1, 2, "a", 6, 12), (1, 3, "a", 9, 30), (1, 4, "b", 1, 10), (2, 1, "a", 2, 9), (1, 5, "a", 29, 31)]
    got = chunks.without_overlaps(spark.createDataFrame(rows, "query int, place int, path string, first int, last int")).collect()
    assert {(r["query"], r.place) for r in got} == {(1, 1), (1, 3), (1, 4), (2, 1), (1, 5)}


def test_lsh_finds_what_the_exact_join_finds(spark):
    rng, base, texts = random.Random(2), [f"w{i:03d}" for i in range(60)], []
    for _ in range(60):
        words = list(base[rng.randrange(10) :])
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(99)}"
        texts.append(" ".join(words))
    docs = code(spark, *texts, "", None)
    exact = {(r.path_a, r.path_b, r.similarity) for r in similarity.jaccard_pairs(docs).collect()}
    got = {(r.path_a, r.path_b, r.similarity): r.estimate for r in similarity.lsh_pairs(docs).collect()}
    assert set(got) <= exact and len(got) >= 0.98 * len(exact) > 50
    assert sum(abs(e - s) for (_, _, s), e in got.items()) / len(got) < 0.06
    assert similarity.compare_two(code(spark, "alpha beta gamma # x", "alpha beta gamma"), "f0", "f1").first().identical


def test_comments_do_not_part_files(spark):
    words = " ".join(f"w{i}" for i in range(30))
    pair = similarity.jaccard_pairs(code(spark, words, "# some licence text of many words here\n" + words + " more", "/* other */ nothing alike at all")).collect()
    assert [(r.path_a, r.path_b) for r in pair] == [("f0", "f1")]
    block = "\n".join(f"step_{i}()" for i in range(8))
    got = similarity.repeated_blocks(code(spark, block + "\nother()\n" + block.upper().replace("STEP_3()", "STEP_3()  # note"))).collect()
    assert [(r.occurrences, r.first_at, r.second_at) for r in got] == [(2, 0, 9)]


def test_language_steps(spark):
    rows = [("Makefile", "x"), ("a/b.PY", ""), ("run", "#!/usr/bin/env node18\n"), ("go", "#!/bin/zsh -x"), ("lisp", "#!/bin/zsh"), ("n", None), ("t", "public class A { } " + "x" * 60), ("s", "public class A")]
    got = {r.path: (r.language, r.confidence, r.method) for r in paths.detected_languages(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got["Makefile"] == ("makefile", "high", "filename") and got["a/b.PY"] == ("python", "high", "extension")
    assert got["run"] == ("javascript", "high", "shebang") and got["lisp"] == ("bash", "high", "shebang") and got["go"][2] == "none"
    assert got["n"] == ("unknown", "none", "none") and got["s"][2] == "none" and got["t"][::2] == ("java", "heuristics")


def test_reports(spark):
    text = "BUGS_FOUND: 2\n### BUG-001\n- **Title**: Null use\n- **Severity**: HIGH\n- **File**: src/a.py:12\n- **Description**: It\nbreaks\n- **Fix**: Check\n### BUG-2\n- **Title**: Odd\n- **File**: b.py\n### BUG-3\nnothing\n"
    bugs = summaries.report_bugs(spark.createDataFrame([("r", text), ("none", None)], "report string, content string"))
    got = [tuple(r) for r in bugs.orderBy("bug").collect()]
    assert got == [("r", 1, "Null use", "high", "", "It\nbreaks", "Check", "src/a.py", 12), ("r", 2, "Odd", "medium", "", "", "", "b.py", 0)]
    assert summaries.report_summary(bugs).first().summary == "Found 2 bug(s): 1 high, 1 medium."


def test_credentials_go(spark):
    assert spark.createDataFrame([("redis://u:p@h:1/0",), ("redis://h",)], "u string").select(checks.without_credentials("u")).collect() == [("h:1/0",), ("redis://h",)]


def test_signatures_are_those_of_spark_hashes(spark):
    """Minima of xxhash64(hash, number) as Spark takes them, outside its row-by-row expressions."""
    sets = spark.createDataFrame([(1, [3, -5, 2**62, -(2**63)]), (2, [7])], "path long, hashes array<long>").withColumn("n", F.size("hashes"))
    signed = similarity.signatures(sets, 8)
    want = sets.select("path", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.array_min(F.transform("hashes", lambda h: F.xxhash64(h, i)))).alias("s"))
    assert {r.path: list(r.signature) for r in signed.collect()} == {r.path: list(r.s) for r in want.collect()}
    assert "MapInArrow" in signed._jdf.queryExecution().toString()


def test_tokens_of_a_set_are_cut_once_and_lone_shingles_stay_home(spark):
    docs = code(spark, " ".join(f"w{j:02d}" for j in range(40)), " ".join(f"w{j:02d}" for j in range(1, 41)), "")
    plan = similarity.hashed_sets(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert len(similarity.jaccard_pairs(docs).collect()) == 1

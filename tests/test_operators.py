from __future__ import annotations

from kilnspark.operators import graph, rules, similarity, telemetry, vectors
from kilnspark.streaming import requests as stream


def test_every_rule_fires_on_its_line_only(spark):
    cases = {
        "SEC-PY-001": "password = 'hunter22'", "SEC-PY-002": "cursor.execute(f'select {x}')", "SEC-PY-003": "os.system(cmd)",
        "SEC-PY-004": "x = eval(y)", "SEC-PY-005": "pickle.loads(b)", "SEC-PY-005b": "yaml.load(f)", "SEC-PY-006": "hashlib.md5(x)",
        "SEC-PY-007": "host = '10.0.0.1'", "SEC-PY-009": "random.choice(xs)", "SEC-PY-010": "DEBUG = True", "SEC-PY-011": "requests.get(url)",
        "SEC-PY-013": "assert user.role", "SEC-PY-014": "tempfile.mktemp()", "SEC-PY-015": "import xml.etree",
    }
    files = spark.createDataFrame([(k, f"clean line\n{v}\nretrieval(x)") for k, v in cases.items()] + [("none", None)], "path string, content string")
    got = rules.findings(files, rules.PYTHON_SECURITY).collect()
    assert {(r.path, r.rule) for r in got} == {(k, k) for k in cases} and {r.line_number for r in got} == {2}
    risk = {r.path: r for r in rules.security_risk(files, rules.PYTHON_SECURITY).collect()}
    assert (risk["SEC-PY-001"].risk_score, risk["SEC-PY-001"].risk_level, risk["none"].risk_score) == (40, "MEDIUM", 0)


def test_duplicates(spark):
    files = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha  beta gamma delta # note"), (3, "alpha beta gamma omega"), (4, None)], "path long, content string")
    got = {r.path: r for r in similarity.exact_duplicates(files).collect()}
    assert set(got) == {1, 2} and got[2].class_path == 1
    pairs = similarity.jaccard_pairs(spark.createDataFrame([(i, " ".join(f"w{j:02d}" for j in range(i, i + 40))) for i in range(4)], "path long, content string"), 0.9).collect()
    assert {(r.path_a, r.path_b) for r in pairs} == {(0, 1), (1, 2), (2, 3), (0, 2), (1, 3)}


def test_rate_limit_counts_accepted_only(spark):
    rows = [(i, s, 1, "e", 1, 200) for i, s in enumerate([0, 10, 20, 30, 61, 62, 75])]
    df = spark.createDataFrame(rows, "id long, s long, user_id long, endpoint string, duration_ms long, status int").selectExpr("id", "timestamp_seconds(s) AS ts", "user_id", "endpoint", "duration_ms", "status")
    got = [r.allowed for r in telemetry.rate_limit_decisions(df, 3, 60).orderBy("id").collect()]
    assert got == [True, True, True, False, True, False, True]


def test_cycles_and_closure(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5)], "src long, dst long")
    assert [r.cycle for r in graph.short_cycles(edges).collect()] == ["1>2>3"]
    assert {(r.node, r.steps) for r in graph.transitive(edges, spark.createDataFrame([(4,)], "node long")).collect()} == {(1, 1), (2, 2), (3, 3)}
    kinds = {r.node: r.kind for r in graph.node_types(spark.createDataFrame([(i,) for i in range(1, 7)], "node long"), edges).collect()}
    assert kinds[4] == "entry_point" and kinds[6] == "orphan" and kinds[1] == "module"


def test_topk_leaves_the_query_out(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(6)], "chunk long, embedding array<float>, label int")
    got = vectors.cosine_topk(rows, rows.where("chunk = 0"), 2).orderBy("place").collect()
    assert [r.chunk for r in got] == [1, 2] and got[0].cosine == 0.707107


def run(df, spark, mode):
    name = f"q{abs(hash((mode, tuple(df.columns)))) % 10**8}"
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_streams_agree_with_batches(spark, sf_dir):
    requests = stream.read_requests(spark, f"{sf_dir}/events*.parquet")
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    days = run(stream.tumbling(requests, "1 day"), spark, "complete")
    assert days.groupBy().sum("requests").first()[0] == batch.count()
    newest = run(stream.latest_progress(requests), spark, "complete")
    assert newest.count() == batch.select("user_id").distinct().count()
    decided = run(stream.rate_limits(requests, 3, 86400), spark, "append")
    # what the watermark has not passed waits
    passed = batch.selectExpr("max(ts) - INTERVAL 10 MINUTES AS passed").first()["passed"]
    assert decided.count() == batch.where(batch["ts"] <= passed).count()


def test_batches_and_questions_have_limits(spark):
    from kilnspark.operators import checks

    files = spark.createDataFrame([("a", f"p{i}", "x") for i in range(501)] + [("b", " ", None), ("b", "p", "é"), ("c", "p", "x"), (None, None, None)], "batch string, path string, content string")
    got = {r.batch: (r.files, r.bytes, r.fault) for r in checks.batch_guards(files).collect()}
    assert got == {"a": (501, 501, "too many files"), "b": (2, 2, "file without a path"), "c": (1, 1, None), None: (1, 0, "file without a path")}
    asked = spark.createDataFrame([(1, None, "p", None), (2, "x" * 4001, "p", 0), (3, " q ", " ", 21), (4, "q", "p", 5)], "id int, query string, project string, sources int")
    found = {r.id: (r.fault, r.sources) for r in checks.question_checks(asked).collect()}
    assert found == {1: ("query is empty", 8), 2: ("query is too long", 1), 3: ("project is missing", 20), 4: (None, 5)}


def test_windows_that_repeat(spark):
    from kilnspark.operators import similarity

    block = "alpha = 1\n\nbeta = 2  # note\ngamma\n"
    files = spark.createDataFrame([("a", block + "other\n" + block.replace("# note", "// b")), ("short", "x\n" * 7), ("brief", "a\nb\n" * 8), ("none", None)], "path string, content string")
    got = [(r.path, r.occurrences, r.first_line, r.second_line) for r in similarity.duplicate_windows(files).collect()]
    assert got == [("a", 2, 1, 6)]


def test_uploads_meet_what_is_stored(spark):
    from kilnspark.operators import paths

    stored = spark.createDataFrame([("a", "1"), ("b", None), ("b", "2")], "path string, content string")
    incoming = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "9"), ("b", ""), ("b", "2"), ("c", "1"), ("d", "new"), (None, "new")], "path string, content string")
    got = sorted((r.path or "", r.action) for r in paths.upload_actions(incoming, stored).collect())
    assert got == [("", "add"), ("a", "replace"), ("a", "unchanged"), ("a", "unchanged"), ("b", "unchanged"), ("b", "unchanged"), ("c", "duplicate"), ("d", "add")]
    assert paths.upload_actions(incoming.where("false"), stored).count() == 0

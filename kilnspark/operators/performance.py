"""Performance rules for Python (loops of the syntax tree, and lines) and JavaScript (lines), and their roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lines import line_context
from .pyast import loops
from .rules import Rule, stepped

#: Line rules: id, impact, pattern; the second list of each pair holds only inside a loop: fixed values.
PYTHON_ANYWHERE = [
    Rule("PERF-PY-002", "MEDIUM", r"(^|[^A-Za-z0-9_])in\s+\["),
    Rule("PERF-PY-012", "LOW", r"for\s+\w+\s+in\s+range\s*\(\s*len\s*\("),
]
PYTHON_IN_LOOP = [
    Rule("PERF-PY-003", "HIGH", r"""^\s+\w+\s*\+=\s*["']|^\s+\w+\s*=\s*\w+\s*\+\s*["']"""),
    Rule("PERF-PY-004", "HIGH", r"\.sort\s*\(|sorted\s*\("),
    Rule("PERF-PY-014", "MEDIUM", r"re\.compile\s*\("),
]
SCRIPT_ANYWHERE = [
    Rule("PERF-JS-002", "CRITICAL", r"""XMLHttpRequest|\.open\s*\(\s*["']GET"""),
    Rule("PERF-JS-003", "MEDIUM", r"""addEventListener\s*\(\s*["'](?:input|keyup|scroll|resize)["']"""),
    Rule("PERF-JS-009", "LOW", r"\.filter\s*\([^)]*\)\s*\.map\s*\("),
]
SCRIPT_IN_LOOP = [
    Rule("PERF-JS-001", "HIGH", r"document\.(?:querySelector|getElementById|getElementsByClassName|getElementsByTagName)\s*\("),
    Rule("PERF-JS-005", "MEDIUM", r"""\w+\s*\+=\s*["']|\w+\s*=\s*\w+\s*\+\s*["']"""),
    Rule("PERF-JS-008", "MEDIUM", r"JSON\.parse\s*\("),
]
TIMER = Rule("PERF-JS-010", "HIGH", r"setInterval\s*\(")
TIMER_CLEARED = r"clearInterval\s*\("
#: Points of a finding by impact, and grades by the sum: fixed values.
IMPACT_POINTS = {"CRITICAL": 40, "HIGH": 20, "MEDIUM": 8, "LOW": 2}
GRADES = [(80, "CRITICAL — Major bottlenecks detected"), (40, "HIGH — Significant performance issues"), (15, "MEDIUM — Some inefficiencies found"), (5, "LOW — Minor issues only")]
BEST_GRADE = "GOOD — No significant issues detected"
#: Findings that a file reports of nested loops, of calls in loops, of blocking calls and of repeated lookups.
MOST = {"nested": 4, "database": 2, "blocking": 3, "lookup": 2}


def _hit(rule: str, impact: str):
    return F.struct(F.lit(rule).alias("rule"), F.lit(impact).alias("impact"))


def _line_hits(text: Column, looped: Column, anywhere: list[Rule], in_loop: list[Rule]) -> list[Column]:
    return [F.when(text.rlike(r.pattern), _hit(r.id, r.severity)) for r in anywhere] + [F.when(looped & text.rlike(r.pattern), _hit(r.id, r.severity)) for r in in_loop]


def _by_line(files: DataFrame, anywhere: list[Rule], in_loop: list[Rule], *more) -> DataFrame:
    rows = line_context(files).select("path", "content", F.posexplode(F.arrays_zip("lines", "in_loop")).alias("at", "x"))
    rows = rows.select("path", "content", (F.col("at") + 1).cast("long").alias("line"), F.col("x.lines").alias("text"), F.col("x.in_loop").alias("looped"))
    found = F.array_compact(F.array(*_line_hits(F.col("text"), F.col("looped"), anywhere, in_loop), *more))
    return rows.select("path", "line", F.explode(found).alias("h")).select("path", "h.rule", "h.impact", "line", F.col("line").alias("line_end"))


def script_findings(files: DataFrame) -> DataFrame:
    """path, rule, impact, line, line_end. A timer counts once for a file, where nothing clears one."""
    timer = F.when(F.col("text").rlike(TIMER.pattern) & ~F.col("content").rlike(TIMER_CLEARED), _hit(TIMER.id, TIMER.severity))
    found = _by_line(files, SCRIPT_ANYWHERE, SCRIPT_IN_LOOP, timer)
    once = found.where(F.col("rule") == TIMER.id).groupBy("path", "rule", "impact").agg(F.min("line").alias("line")).withColumn("line_end", F.col("line"))
    return found.where(F.col("rule") != TIMER.id).unionByName(once)


def python_findings(files: DataFrame) -> DataFrame:
    """path, rule, impact, line, line_end. Files that do not parse have none.

    The parse gives a row for each loop and asynchronous function; the rules are
    conditions on them. Within a file each kind keeps its first few, as MOST says:
    that is the report's own limit.
    """
    rows = loops(files).select("*", F.posexplode_outer(F.arrays_zip("texts", "in_loop")).alias("at", "x"))
    loop, waits = F.col("kind") == "loop", F.col("kind") == "async"
    hit = lambda group, when, rule, impact: F.when(when, F.struct(F.lit(group).alias("g"), F.lit(rule).alias("rule"), F.lit(impact).alias("impact")))
    tree = [
        F.coalesce(hit("nested", loop & (F.col("depth") >= 3), "PERF-PY-015", "CRITICAL"), hit("nested", loop & (F.col("depth") == 2), "PERF-PY-001", "HIGH")),
        hit("database", loop & F.col("database"), "PERF-PY-007", "CRITICAL"),
        hit("blocking", waits & F.col("sleeps"), "PERF-PY-008", "HIGH"),
        hit("blocking", waits & F.col("requests"), "PERF-PY-008b", "HIGH"),
        hit("lookup", loop & (F.col("lookups") >= 3), "PERF-PY-011", "LOW"),
    ]
    on_line = F.array_compact(F.array(*_line_hits(F.col("x.texts"), F.col("x.in_loop"), PYTHON_ANYWHERE, PYTHON_IN_LOOP)))
    on_line = F.transform(on_line, lambda h: F.struct(F.lit("line").alias("g"), h["rule"].alias("rule"), h["impact"].alias("impact")))
    found = F.when(F.col("kind") == "parsed", on_line).otherwise(F.array_compact(F.array(*tree)))
    first, last = F.coalesce(F.when(F.col("kind") == "parsed", F.col("at") + 1), F.col("line")), F.coalesce(F.when(F.col("kind") == "parsed", F.col("at") + 1), F.col("line_end"))
    found = rows.select("path", "seq", first.cast("long").alias("line"), last.cast("long").alias("line_end"), F.explode(found).alias("h")).select("path", "seq", "line", "line_end", "h.*")
    # nested loops: the worst of a line, the worst of a file first; the others in the order of the tree
    rank = (F.col("g") == "nested") & (F.col("impact") != "CRITICAL")
    of_line = F.row_number().over(Window.partitionBy("path", "g", "line").orderBy(rank, "seq", "rule"))
    found = found.withColumn("of_line", F.when(F.col("g") == "nested", of_line).otherwise(1)).where("of_line = 1")
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("path", "g").orderBy(rank, "seq", "line", "rule")))
    most = F.create_map(*[F.lit(x) for pair in MOST.items() for x in pair])
    return found.where((F.col("g") == "line") | (F.col("place") <= most[F.col("g")])).select("path", "rule", "impact", "line", "line_end")


def performance_rollup(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of each file by impact, their score and its grade; files without any are good."""
    counts = [F.count_if(F.col("impact") == i).alias(i.lower()) for i in IMPACT_POINTS]
    rows = files.select("path").join(findings.groupBy("path").agg(*counts), "path", "left").na.fill(0)
    score = sum((F.col(i.lower()) * n for i, n in IMPACT_POINTS.items()), F.lit(0)).cast("long")
    return rows.withColumn("score", score).withColumn("grade", stepped(F.col("score"), GRADES, BEST_GRADE))

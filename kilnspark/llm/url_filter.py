"""URL filter: rules by host and path, and trust propagated over host edges.

Hosts that allow rules fit are trusted seeds and hosts that block rules fit are
blocked seeds, each by the part of its pages so judged. Trust walks along host edges
and distrust against them as personalised PageRank, both in one join and one
aggregation for each step. Edges are links between hosts in the pages, and a host
and its parent domain where both have pages. A host whose distrust exceeds its trust
is blocked; without evidence it is allowed. Steps go on until a job of them moves no
host's trust or distrust by TOLERANCE; what later steps could still add is then under half
of that, far below the margin of the verdict.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, forget, materialize, table

#: (verdict, host, path): fixed values of the contract.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
DAMPING, TOLERANCE, PARENT_WEIGHT, MARGIN = 0.85, 1e-10, 1.0, 1e-9
#: Steps in one job; then the ranks are written, so that plans stay short, and compared with those before.
STEPS_A_JOB = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits as a struct (rule, verdict), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0], r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, hosts: DataFrame, html_col: str, parent_weight: float) -> DataFrame:
    """src, dst, weight over different hosts that have pages."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    names = hosts.select("host")
    links = links.join(names.withColumnRenamed("host", "dst"), "dst", "left_semi")
    up = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.(.+)$", 1).alias("dst")).join(names.withColumnRenamed("host", "dst"), "dst", "left_semi").select("src", "dst")
    parents = up.union(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(parent_weight))
    return links.select("src", "dst", "weight").union(parents).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust from hosts(host, trusted, blocked) and edges(src, dst, weight); every host has a row."""
    out_sum = edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("total"))
    in_sum = edges.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("total"))
    forth = edges.join(out_sum, F.col("src") == F.col("node")).select(F.col("src").alias("origin"), F.col("dst").alias("target"), (F.col("weight") / F.col("total")).alias("trust_part"), F.lit(0.0).alias("distrust_part"))
    back = edges.join(in_sum, F.col("dst") == F.col("node")).select(F.col("dst").alias("origin"), F.col("src").alias("target"), F.lit(0.0).alias("trust_part"), (F.col("weight") / F.col("total")).alias("distrust_part"))
    flows = materialize(forth.union(back), "flows")
    seeds = hosts.select("host", ((1 - damping) * F.col("trusted")).alias("trust"), ((1 - damping) * F.col("blocked")).alias("distrust"))
    if flows.isEmpty():
        return seeds
    written, change = materialize(seeds, "ranks"), None
    while change is None or change >= tolerance:
        ranks = written
        for _ in range(STEPS_A_JOB):
            moved = flows.join(ranks, F.col("origin") == F.col("host")).select(F.col("target").alias("host"), (damping * F.col("trust_part") * F.col("trust")).alias("trust"), (damping * F.col("distrust_part") * F.col("distrust")).alias("distrust"))
            ranks = seeds.union(moved).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        before, written = written, materialize(ranks, "ranks")
        both = written.join(before.toDF("host", "old_trust", "old_distrust"), "host")
        change = both.agg(F.max(F.greatest(F.abs(F.col("trust") - F.col("old_trust")), F.abs(F.col("distrust") - F.col("old_distrust"))))).first()[0] or 0.0
        forget(before)
    return written


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: list[tuple[str, str, str]] | None = None, damping: float = DAMPING, tolerance: float = TOLERANCE, parent_weight: float = PARENT_WEIGHT, margin: float = MARGIN) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, trust, distrust.

    A null url, or one without ://, has an empty host and path; the empty host takes
    part in no edge. Null html has no links. Repeated rows are judged alike, each
    counting for its host. Other columns are not looked at; no rows give no rows.
    """
    rules = RULES if rules is None else rules
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html")).withColumn("found", by_rule(F.col("host"), F.col("path"), rules))
    share = lambda v: F.coalesce(F.avg(F.when(F.col("found.verdict") == v, 1.0).otherwise(0.0)), F.lit(0.0))
    hosts = materialize(judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), share("allow").alias("trusted"), share("block").alias("blocked")), "hosts")
    edges = materialize(host_edges(judged, hosts, "html", parent_weight), "edges")
    ranks = broadcast_if_small(propagate(hosts, edges, damping, tolerance))
    out = judged.drop("html").join(ranks, "host", "left").na.fill(0.0, ["trust", "distrust"])
    bad = F.round(F.col("distrust") - F.col("trust"), 9) > margin
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    fits = [(h + p, v, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))") for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    case = lambda i: "CASE " + " ".join(f"WHEN {f[2]} THEN '{f[i]}'" for f in fits) + " END"
    link = r"""(?i)href\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)"""
    steps = ""
    count = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))  # after so many, no step moves a host by the tolerance
    for i in range(count):
        steps += f""", r{i + 1} AS MATERIALIZED (
  SELECT host, sum(t) AS t, sum(d) AS d FROM (
    SELECT * FROM r0 UNION ALL
    SELECT target, {DAMPING} * tp * t, {DAMPING} * dp * d FROM flows JOIN r{i} ON origin = host
  ) GROUP BY host)"""
    return rf"""
WITH u AS (
  SELECT page_id, html, lower(coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')) AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), j AS MATERIALIZED (SELECT *, {case(0)} AS rule, {case(1)} AS found FROM u
), hosts AS MATERIALIZED (
  SELECT host, avg(CASE WHEN found = 'allow' THEN 1.0 ELSE 0.0 END)::DOUBLE AS trusted, avg(CASE WHEN found = 'block' THEN 1.0 ELSE 0.0 END)::DOUBLE AS blocked
  FROM j WHERE host <> '' GROUP BY host
), links AS (
  SELECT host AS src, lower(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1))) AS dst FROM j
), up AS (
  SELECT host AS src, regexp_extract(host, '^[^.]+\.(.+)$', 1) AS dst FROM hosts WHERE regexp_extract(host, '^[^.]+\.(.+)$', 1) IN (SELECT host FROM hosts)
), edges AS MATERIALIZED (
  SELECT src, dst, sum(weight) AS weight FROM (
    SELECT src, dst, 1.0::DOUBLE AS weight FROM links WHERE src <> '' AND src <> dst AND dst IN (SELECT host FROM hosts)
    UNION ALL SELECT src, dst, {PARENT_WEIGHT}::DOUBLE FROM up UNION ALL SELECT dst, src, {PARENT_WEIGHT}::DOUBLE FROM up
  ) GROUP BY src, dst
), flows AS MATERIALIZED (
  SELECT src AS origin, dst AS target, weight / sum(weight) OVER (PARTITION BY src) AS tp, 0.0::DOUBLE AS dp FROM edges
  UNION ALL SELECT dst, src, 0.0::DOUBLE, weight / sum(weight) OVER (PARTITION BY dst) FROM edges
), r0 AS MATERIALIZED (SELECT host, {1 - DAMPING} * trusted AS t, {1 - DAMPING} * blocked AS d FROM hosts){steps}
SELECT page_id, j.host, path, rule, coalesce(found, CASE WHEN round(coalesce(d, 0) - coalesce(t, 0), 9) > {MARGIN} THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN r{count} r ON j.host = r.host
"""


ORACLE_SQL = _oracle()

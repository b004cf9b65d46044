"""Sources assembled row by row: an order is a file, each of its lines a piece of code, so that lengths, order and repeats vary with the data.

Spark and SQL put the same pieces together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pieces by language; {p} becomes the line's part, {q} its number.
PIECES = {
    "python": [
        "import mod{p}, os\n\n", "from pkg.m{p} import a, b as c\n", "def load_{p}(a, b: int = {q}, *rest) -> dict:\n    return a\n\n",
        "class Item{p}(Base, mixins.M{q}):\n    def total(self,\n              tax=1):\n        return tax\n\n", "# def not_{p}(x):\n",
    ],
    "javascript": ["function draw{p}(a) {\n  return a;\n}\n", "const run{p} = async (x) => {\n};\n", "export class View{p} extends Base {\n}\n", "let n{p} = 4;\n", "import x from 'y{q}';\n"],
    "java": ["public class Box{p} {\n", "  private static int sum{p}(int a) {\n    return a;\n  }\n", "  List<String> names{p} (String[] of) { return null; }\n", "}\n\n", "  int field{p};\n"],
    "go": ["func Ship{p}(n int) error {\n  return nil\n}\n", "package p{q}\n", "function Other{p}  (x)\n", "// func\n", "type T{p} struct {}\n"],
}
LANGUAGES = list(PIECES)
EACH = 5


def assembled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, language, content."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    language = F.element_at(F.array(*map(F.lit, LANGUAGES)), (F.col("l_orderkey") % len(LANGUAGES)).cast("int") + 1)
    pieces = F.array(*[F.lit(x) for name in LANGUAGES for x in PIECES[name]])
    pick = (F.col("l_orderkey") % len(LANGUAGES) * EACH + (F.col("l_partkey") + F.col("l_suppkey")) % EACH).cast("int") + 1
    piece = F.replace(F.replace(F.element_at(pieces, pick), F.lit("{p}"), F.col("l_partkey").cast("string")), F.lit("{q}"), F.col("l_linenumber").cast("string"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", piece.alias("piece"))
    rows = li.select(F.col("l_orderkey").alias("path"), language.alias("language"), order.alias("o")).groupBy("path", "language").agg(F.array_sort(F.collect_list("o")).alias("all"))
    return rows.select("path", "language", F.array_join(F.transform("all", lambda o: o["piece"]), "").alias("content"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The same as the table expression `assembled`.
ASSEMBLED_SQL = f"""assembled AS MATERIALIZED (
  SELECT l_orderkey AS path, ({LANGUAGES})[l_orderkey % {len(LANGUAGES)} + 1] AS language, string_agg(replace(replace(([{", ".join(_sql(x) for name in LANGUAGES for x in PIECES[name])}])[l_orderkey % {len(LANGUAGES)} * {EACH} + (l_partkey + l_suppkey) % {EACH} + 1], '{{p}}', l_partkey::VARCHAR), '{{q}}', l_linenumber::VARCHAR), '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS content
  FROM lineitem GROUP BY l_orderkey)"""

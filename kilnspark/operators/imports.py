"""Imports of Python and JavaScript sources by pattern, and the files they resolve to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PYTHON_IMPORT = r"^\s*import\s+([A-Za-z0-9_., ]+)"
PYTHON_FROM = r"^\s*from\s+(\.*[A-Za-z0-9_.]*)\s+import\s"
JS_IMPORT = r"""(?:from\s+|import\s+|import\s*\(\s*|require\s*\(\s*)["']([^"']+)["']"""
JS_ENDINGS = ["", ".js", ".jsx", ".ts", ".tsx", "/index.js", "/index.ts"]


def python_imports(files: DataFrame) -> DataFrame:
    """path, module of each import statement, each once; relative modules keep their dots."""
    lines = files.select("path", F.explode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("line"))
    plain = F.transform(F.split(F.regexp_extract("line", PYTHON_IMPORT, 1), ","), lambda x: F.regexp_replace(F.trim(x), r"\s.*$", ""))
    one = F.array(F.regexp_extract("line", PYTHON_FROM, 1))
    return lines.select("path", F.explode(F.concat(plain, one)).alias("module")).where("module <> ''").distinct()


def js_imports(files: DataFrame) -> DataFrame:
    """path, module of each import, export-from, dynamic import and require, each once."""
    return files.select("path", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(JS_IMPORT), F.lit(1)))).alias("module"))


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def lexical(path: Column) -> Column:
    """The path with `.` and `..` parts taken out."""
    up = lambda s, p: F.when((p == "") | (p == "."), s).when(p == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), up), "/")


def _resolved(imports: DataFrame, candidates: Column, files: DataFrame, keys: Column) -> DataFrame:
    """Each import's file under the key that comes first among its candidates.

    Candidates and keys meet by an equi-join; the first key and then the least path wins.
    """
    wanted = imports.select("path", "module", F.posexplode(candidates).alias("rank", "key"))
    held = files.select(F.col("path").alias("target"), F.explode(keys).alias("key"))
    found = wanted.join(held, "key").where("target <> path").groupBy("path", "module").agg(F.min(F.struct("rank", "target")).alias("best"))
    return imports.join(found, ["path", "module"], "left").select("path", "module", F.col("best.target").alias("target"))


def resolve_python(imports: DataFrame, files: DataFrame) -> DataFrame:
    """path, module, target: the module's file, its package, or else a file of the same stem; null when external."""
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    base = lexical(F.concat(folder_of(F.col("path")), F.when(dots > 0, F.repeat(F.lit("/.."), dots - 1)).otherwise("")))
    tail = F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/"))
    full = F.when(dots > 0, F.regexp_replace(F.concat(base, F.lit("/"), tail), "^/|/$", "")).otherwise(tail)
    stem = F.regexp_extract(full, r"([^/]*)$", 1)
    candidates = F.array(F.concat(full, F.lit(".py")), F.concat(full, F.lit("/__init__.py")), F.concat(F.lit("*"), stem))
    keys = F.array("path", F.concat(F.lit("*"), F.regexp_extract("path", r"([^/]*)\.py$", 1)))
    return _resolved(imports, candidates, files, keys)


def resolve_js(imports: DataFrame, files: DataFrame) -> DataFrame:
    """path, module, target: relative modules against the importing file's folder; null when external."""
    full = lexical(F.concat(folder_of(F.col("path")), F.lit("/"), F.col("module")))
    candidates = F.when(F.col("module").startswith("."), F.array(*[F.concat(full, F.lit(e)) for e in JS_ENDINGS])).otherwise(F.array().cast("array<string>"))
    return _resolved(imports, candidates, files, F.array("path"))


def external_packages(resolved: DataFrame, most: int = 5) -> DataFrame:
    """The first top-level packages by name that each file imports from outside."""
    top = F.regexp_extract("module", r"^(@[^/]+/[^/]+|[^./]+)", 1)
    return resolved.where("target IS NULL").select("path", top.alias("package")).where("package <> ''").groupBy("path").agg(F.slice(F.array_sort(F.collect_set("package")), 1, most).alias("packages"))

"""File-level roll-ups: project totals, languages, parse coverage, line and size metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Languages that configure rather than program: fixed values.
CONFIG_LANGUAGES = ["json", "yaml", "toml", "markdown", "html", "css", "xml", "ini", "text"]


def lines_of(content: Column) -> Column:
    return F.split(F.coalesce(content, F.lit("")), "\n")


def line_count(content: Column) -> Column:
    """Newlines, and one more for an unfinished last line; none for an empty text."""
    text = F.coalesce(content, F.lit(""))
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (newlines + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)).cast("long")


def project_stats(files: DataFrame) -> DataFrame:
    """Files, lines and bytes of each project, by language and in all, from one scan."""
    slim = files.select("project", "language", line_count(F.col("content")).alias("lines"), F.octet_length("content").cast("long").alias("bytes"))
    return slim.groupingSets([["project", "language"], ["project"]], "project", "language").agg(F.grouping("language").cast("int").alias("is_total"), F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))


def status_rollup(rows: DataFrame, status: str, amount: str) -> DataFrame:
    """Count and sum by status, and in all."""
    return rows.rollup(status).agg(F.grouping(status).cast("int").alias("is_total"), F.count("*").alias("n"), F.round(F.sum(amount), 2).alias("amount"))


def language_stats(files: DataFrame, samples: int = 3) -> DataFrame:
    """Share of files and bytes by language, with sample paths; the largest language that is not for configuration is primary."""
    rows = files.groupBy("language").agg(F.count("*").alias("files"), F.sum(F.octet_length("content").cast("long")).alias("bytes"))
    newest = F.row_number().over(Window.partitionBy("language", "shard").orderBy("path"))
    # the first paths are found by shard, then by language, so that no task sorts a whole language
    few = files.select("language", "path", F.pmod(F.xxhash64("path"), F.lit(64)).alias("shard")).withColumn("r", newest).where(F.col("r") <= samples)
    few = few.groupBy("language").agg(F.slice(F.array_sort(F.collect_list("path")), 1, samples).alias("sample_paths"))
    totals = rows.agg(F.sum("files").alias("all_files"), F.sum("bytes").alias("all_bytes"), F.max_by("language", F.when(~F.col("language").isin(CONFIG_LANGUAGES), F.struct("files", "language"))).alias("primary"))
    return rows.join(few, "language").join(F.broadcast(totals)).select("language", "files", F.round(F.col("files") * 100 / F.col("all_files"), 1).alias("percent_files"), "bytes", F.round(F.col("bytes") * 100 / F.col("all_bytes"), 1).alias("percent_bytes"), F.array_join(F.col("sample_paths").cast("array<string>"), ",").alias("sample_paths"), (F.col("language") == F.col("primary")).alias("is_primary"))


def parse_coverage(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Parsed and unparsed files of each project."""
    marks = parsed.select("path").distinct().withColumn("done", F.lit(1))
    rows = files.select("path", "project").join(marks, "path", "left")
    return rows.groupBy("project").agg(F.count("*").alias("files"), F.count("done").alias("parsed"), F.round(F.count("done") * 100 / F.count("*"), 1).alias("percent"))


def unparsed_files(files: DataFrame, parsed: DataFrame) -> DataFrame:
    return files.select("path", "project", "size").join(parsed.select("path"), "path", "left_anti")


def total_and_blank(content: Column) -> tuple[Column, Column]:
    lines = lines_of(content)
    return F.size(lines).cast("long"), F.size(F.filter(lines, lambda x: F.trim(x) == "")).cast("long")


def loc_metrics(files: DataFrame) -> DataFrame:
    """Total, blank and other lines of each file."""
    total, blank = total_and_blank(F.col("content"))
    return files.select("path", total.alias("total_lines"), blank.alias("blank_lines"), (total - blank).alias("code_lines"))


#: Tokens that stand for branches, counted over whole contents: fixed values.
BRANCH_WORDS = ["if", "elif", "else", "for", "while", "except", "with", "and", "or", "case", "switch"]
BRANCH_SIGNS = [r"\?[ \t\n]", "&&", r"\|\|"]


#: Word borders are in ASCII, as the oracle's engine has them; a match takes no neighbour with it.
BRANCH_WORD = rf"(?<![A-Za-z0-9_])(?:{'|'.join(BRANCH_WORDS)})(?![A-Za-z0-9_])"
BRANCH_SIGN = "|".join(BRANCH_SIGNS)


def branch_complexity(content: Column, most: int = 50) -> Column:
    """1 and the branch tokens of a text, at most 50: one pass for all words and one for all signs."""
    text = F.coalesce(content, F.lit(""))
    return F.least(1 + F.regexp_count(text, F.lit(BRANCH_WORD)) + F.regexp_count(text, F.lit(BRANCH_SIGN)), F.lit(most)).cast("long")


def complexity_estimate(files: DataFrame, most: int = 50) -> DataFrame:
    """1 and the branch tokens of a file, at most 50, with maintainability and a grade."""
    rows = files.select("path", branch_complexity(F.col("content"), most).alias("cc"), F.size(lines_of(F.col("content"))).cast("long").alias("lines"))
    mi = F.greatest(F.lit(0.0), 171 - 5.2 * F.ln(F.greatest("lines", F.lit(1)).cast("double")) - 0.23 * F.col("cc"))
    grade = F.when(F.col("cc") <= 5, "A").when(F.col("cc") <= 10, "B").when(F.col("cc") <= 15, "C").when(F.col("cc") <= 20, "D").otherwise("F")
    return rows.select("path", "cc", "lines", F.round(mi / 171 * 100, 2).alias("maintainability"), grade.alias("grade"))


#: Operator words and signs, and operands, of the token-based Halstead metrics: fixed values.
OPERATOR = r"[+\-*/%=<>!&|^~?:]+"
OPERAND = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+"


def halstead(files: DataFrame, *more: Column) -> DataFrame:
    """Vocabulary, length, volume, difficulty, effort, time and bugs from regular tokens; zero when the vocabulary is at most 1.

    More columns of the same rows go along, so that what is made of several metrics needs no join.
    """
    text = F.coalesce("content", F.lit(""))
    rows = files.select("path", F.struct(F.lit(1).alias("row"), *more).alias("more"), F.regexp_extract_all(text, F.lit(OPERATOR), F.lit(0)).alias("ops"), F.regexp_extract_all(text, F.lit(OPERAND), F.lit(0)).alias("opds"))
    n = lambda c: F.size(c).cast("long")
    rows = rows.select("path", "more", n(F.array_distinct("ops")).alias("n1"), n(F.array_distinct("opds")).alias("n2"), n("ops").alias("total_operators"), n("opds").alias("total_operands"))
    vocabulary, length = F.col("n1") + F.col("n2"), F.col("total_operators") + F.col("total_operands")
    some = lambda c: F.when(vocabulary > 1, c).otherwise(0.0)
    volume = some(length * F.log2(vocabulary.cast("double")))
    difficulty = some(F.coalesce(F.try_divide(F.col("n1") * F.col("total_operands"), 2 * F.col("n2")), F.lit(0.0)))
    return rows.select("path", "n1", "n2", "total_operators", "total_operands", vocabulary.alias("vocabulary"), length.alias("length"), F.round(volume, 2).alias("volume"), F.round(difficulty, 2).alias("difficulty"), F.round(volume * difficulty, 2).alias("effort"), F.round(volume * difficulty / 18, 2).alias("time_s"), F.round(volume / 3000, 4).alias("bugs"), *(["more.*"] if more else [])).drop("row")


def maintainability(volume: Column, complexity: Column, loc: Column) -> Column:
    """0 to 100; 100 where volume or lines are not positive."""
    raw = (171 - 5.2 * F.ln(volume) - 0.23 * complexity - 16.2 * F.ln(loc)) * 100 / 171
    return F.when((volume <= 0) | (loc <= 0), 100.0).otherwise(F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)), 2))


def maintainability_index(files: DataFrame) -> DataFrame:
    total, blank = total_and_blank(F.col("content"))
    rows = halstead(files, branch_complexity(F.col("content")).alias("cc"), (total - blank).alias("code_lines"))
    return rows.select("path", maintainability(F.col("volume"), F.col("cc"), F.col("code_lines").cast("double")).alias("mi"))


def chunk_windows(files: DataFrame, size: int = 120, overlap: int = 4) -> DataFrame:
    """Overlapping windows of lines: start, end, character count and token estimate of each chunk."""
    lines = F.col("lines")
    rows = files.select("path", lines_of(F.col("content")).alias("lines"))
    rows = rows.select("path", "lines", F.explode(F.sequence(F.lit(1), F.greatest(F.size(lines) - overlap, F.lit(1)), F.lit(size - overlap))).alias("start"))
    end = F.least(F.col("start") + size - 1, F.size(lines))
    chars = F.length(F.array_join(F.slice(lines, F.col("start"), end - F.col("start") + 1), "\n"))
    return rows.select("path", F.col("start").cast("long").alias("line_start"), end.cast("long").alias("line_end"), chars.cast("long").alias("chars")).withColumn("tokens", F.greatest(F.floor(F.col("chars") / 4), F.lit(1)).cast("long"))

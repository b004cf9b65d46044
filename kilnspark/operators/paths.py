"""Paths and keys of files: parts, filters, languages by extension and by content, tiers, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import layer_of

#: Languages by extension: fixed values.
LANGUAGE_OF_EXTENSION = {
    "py": "python", "pyw": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "typescript", "java": "java", "kt": "kotlin", "kts": "kotlin", "cpp": "cpp", "cc": "cpp", "cxx": "cpp",
    "c": "c", "h": "c", "hpp": "cpp", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "cs": "csharp", "swift": "swift",
    "scala": "scala", "r": "r", "sh": "bash", "bash": "bash", "zsh": "bash", "ps1": "powershell", "sql": "sql", "html": "html",
    "htm": "html", "css": "css", "scss": "css", "sass": "css", "less": "css", "json": "json", "yaml": "yaml", "yml": "yaml",
    "toml": "toml", "xml": "xml", "md": "markdown", "rst": "rst", "txt": "text", "env": "text", "gitignore": "text", "dockerfile": "dockerfile",
}
#: Languages by whole file name, and by the interpreter of a first line: fixed values.
LANGUAGE_OF_NAME = {
    "Makefile": "makefile", "makefile": "makefile", "GNUmakefile": "makefile", "Dockerfile": "docker", "dockerfile": "docker",
    "Jenkinsfile": "groovy", "Vagrantfile": "ruby", "Gemfile": "ruby", "Rakefile": "ruby", "Guardfile": "ruby", "Podfile": "ruby",
    ".gitignore": "gitignore", ".env": "env", ".env.example": "env", ".env.local": "env", "requirements.txt": "text",
    "package.json": "json", "tsconfig.json": "json", "pyproject.toml": "toml", "Cargo.toml": "toml", "go.mod": "go", "go.sum": "text",
    "pom.xml": "xml", "build.gradle": "groovy", "build.gradle.kts": "kotlin", "CMakeLists.txt": "cmake", "MANIFEST.in": "text",
    "setup.cfg": "ini", "tox.ini": "ini", ".eslintrc": "json", ".babelrc": "json", ".prettierrc": "json",
}
LANGUAGE_OF_INTERPRETER = {
    "python": "python", "python3": "python", "python2": "python", "node": "javascript", "nodejs": "javascript", "deno": "typescript",
    "ruby": "ruby", "perl": "perl", "php": "php", "bash": "bash", "sh": "bash", "zsh": "bash", "fish": "bash", "lua": "lua",
    "rscript": "r", "groovy": "groovy", "kotlin": "kotlin", "swift": "swift",
}
#: Extensions and folders that are left out, and hidden names that are not: fixed values.
SKIP_EXTENSIONS = [
    "pyc", "pyo", "pyd", "class", "jar", "war", "ear", "exe", "dll", "so", "dylib", "lib", "a", "o", "obj",
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "svg", "webp", "mp3", "mp4", "avi", "mov", "wav",
    "pdf", "doc", "docx", "xls", "xlsx", "zip", "tar", "gz", "bz2", "7z", "rar", "node_modules", "git",
]
SKIP_FOLDERS = ["node_modules", ".git", "__pycache__", ".venv", "venv", "env", ".env", "dist", "build", "target", ".idea", ".vscode", "vendor", "Pods", ".gradle"]
SHOWN_HIDDEN = [".github", ".gitignore", ".env.example"]
#: Rate tiers by path prefix, first fit first: fixed values.
TIERS = [
    ("/api/v1/auth/", "auth"), ("/api/v1/agents", "agents"), ("/api/v1/tasks", "tasks"), ("/api/v1/indexing", "indexing"),
    ("/api/v1/analytics", "analytics"), ("/api/v1/files", "uploads"), ("/api/v1/ws/", "websocket"), ("/api/v1/", "api_default"),
]
LONGEST_PATH = 500
#: What speaks for a language in the first 3000 characters, each up to three times: fixed values.
CONTENT_SIGNS = [
    ("python", 3, r"(?m)^import\s+\w|^from\s+\w+\s+import"),
    ("python", 4, r"(?m)^def\s+\w+\s*\(|^async\s+def\s+\w+"),
    ("python", 2, r"(?m)^class\s+\w+.*:$"),
    ("python", 2, r'(?s)""".*?"""'),
    ("python", 2, r"""print\(|__name__\s*==\s*["']__main__["']"""),
    ("python", 1, r"(?m):\s*$"),
    ("javascript", 2, r"const\s+\w+\s*=|let\s+\w+\s*=|var\s+\w+\s*="),
    ("javascript", 3, r"function\s+\w+\s*\(|=>\s*\{"),
    ("javascript", 4, r"require\s*\(|module\.exports"),
    ("javascript", 2, r"console\.(log|error|warn)\s*\("),
    ("javascript", 3, r"document\.|window\.|navigator\."),
    ("javascript", 2, r"""import\s+\w+\s+from\s+["']"""),
    ("typescript", 3, r":\s*\w+(\[\])?\s*[=;,)\n]"),
    ("typescript", 4, r"interface\s+\w+\s*\{|type\s+\w+\s*="),
    ("typescript", 3, r"<\w+>|Array<|Promise<|Optional<"),
    ("typescript", 4, r":\s*(string|number|boolean|void|any)([^A-Za-z0-9_]|$)"),
    ("typescript", 2, r"as\s+\w+|as\s+unknown"),
    ("java", 5, r"public\s+class\s+\w+|private\s+\w+\s+\w+;"),
    ("java", 4, r"@Override|@Autowired|@Service|@Component"),
    ("java", 3, r"System\.out\.println|throws\s+\w+"),
    ("java", 5, r"import\s+java\.|import\s+org\.spring"),
    ("java", 5, r"public\s+static\s+void\s+main"),
    ("go", 5, r"(?m)^package\s+\w+"),
    ("go", 4, r"(?m)^func\s+\w+\s*\("),
    ("go", 3, r":=\s*|fmt\.Print|log\.Fatal"),
    ("go", 4, r"make\(|chan\s+\w+|go\s+func"),
    ("go", 4, r"""import\s+\(\s*"fmt\""""),
    ("rust", 4, r"(?m)^fn\s+\w+|^pub\s+fn"),
    ("rust", 4, r"let\s+mut\s+\w+|impl\s+\w+"),
    ("rust", 4, r"use\s+std::|use\s+\w+::\{"),
    ("rust", 3, r"Option<|Result<|Vec<|HashMap<"),
    ("rust", 5, r"#\[derive\(|#\[cfg\("),
    ("cpp", 4, r"""#include\s+<\w+>|#include\s+"\w+"""),
    ("cpp", 3, r"std::|cout\s*<<|cin\s*>>"),
    ("cpp", 4, r"template\s*<|namespace\s+\w+"),
    ("cpp", 3, r"nullptr|auto\s+\w+\s*="),
    ("sql", 5, r"(?i)SELECT\s+\w|INSERT\s+INTO|UPDATE\s+\w+\s+SET"),
    ("sql", 5, r"(?i)CREATE\s+TABLE|DROP\s+TABLE|ALTER\s+TABLE"),
    ("sql", 3, r"(?i)WHERE\s+\w+\s*=|JOIN\s+\w+|GROUP\s+BY"),
    ("ruby", 4, r"""(?m)^require\s+["']\w|^gem\s+["']"""),
    ("ruby", 4, r"(?s)def\s+\w+.*\nend([^A-Za-z0-9_]|$)"),
    ("ruby", 3, r"\.each\s*do\s*\||\.map\s*\{"),
    ("ruby", 4, r"puts\s+|attr_accessor|Rails\.|ActiveRecord"),
]


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension_of(path: Column) -> Column:
    """Lower-case extension without its dot; none for names that only begin with one."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def looked_up(key: Column, values: dict[str, str]) -> Column:
    """The key's value in a map literal, null without one."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def language_by_extension(path: Column) -> Column:
    return F.coalesce(looked_up(extension_of(path), LANGUAGE_OF_EXTENSION), F.lit("unknown"))


def language_by_shebang(content: Column) -> Column:
    """The language of the interpreter that the first line names, its version cut off; null without one."""
    line = F.trim(F.regexp_extract(content, r"^#!([^\r\n]*)", 1))
    called = F.regexp_extract(line, r"/env\s+(\S+)", 1)
    name = F.lower(F.regexp_extract(F.when(called != "", F.concat(F.lit("/"), called)).otherwise(line), r"/([^/\s]+)\s*$", 1))
    return F.coalesce(looked_up(F.regexp_replace(name, r"[0-9.]+$", ""), LANGUAGE_OF_INTERPRETER), looked_up(name, LANGUAGE_OF_INTERPRETER))


def is_skipped(path: Column) -> Column:
    """A skipped folder or hidden part, a skipped extension, or an overlong path."""
    hidden = lambda p: p.isin(SKIP_FOLDERS) | (p.startswith(".") & ~p.isin(SHOWN_HIDDEN))
    return F.exists(F.split(path, "/"), hidden) | extension_of(path).isin(SKIP_EXTENSIONS) | (F.length(path) > LONGEST_PATH)


def tier_of(path: Column) -> Column:
    out = F.lit("api_default")
    for prefix, tier in reversed(TIERS):
        out = F.when(path.startswith(prefix), tier).otherwise(out)
    return out


def path_facts(files: DataFrame) -> DataFrame:
    """Name, extension, stem, parent, package, language, layer, tier and whether a path is left out."""
    path = F.col("path")
    package = F.regexp_extract(path, r"^/*([^/]+)/", 1)
    return files.select(
        "id",
        name_of(path).alias("name"),
        extension_of(path).alias("extension"),
        F.regexp_replace(name_of(path), r"(.)\.[^.]+$", "$1").alias("stem"),
        F.regexp_replace(path, r"/?[^/]*$", "").alias("parent"),
        F.when(package == "", "root").otherwise(package).alias("package"),
        language_by_extension(path).alias("language"),
        layer_of(path).alias("layer"),
        tier_of(path).alias("tier"),
        is_skipped(path).alias("skipped"),
    )


def keys(files: DataFrame, most: int = 60) -> DataFrame:
    """Digests and identifiers under which a file is stored."""
    project, path = F.col("project"), F.col("path").cast("string")
    safe = F.substring(F.regexp_replace(F.concat_ws("/", project, path), "[^a-zA-Z0-9_.-]", "_"), 1, most)
    return files.select("path", F.md5(F.concat_ws(":", project, path, F.lit("0"))).alias("chunk_id"), F.sha2(F.concat_ws("::", project, path, "language"), 256).alias("cache_key"), safe.alias("safe_name"), F.concat(F.lit("project_"), F.substring(F.replace(project, F.lit("-"), F.lit("")), 1, 40)).alias("collection"))


def content_best(content: Column, sample: int = 3000) -> Column:
    """The language with most points, the first of the best, as a struct (points, first, language)."""
    text = F.substring(F.coalesce(content, F.lit("")), 1, sample)
    points: dict[str, Column] = {}
    for language, weight, pattern in CONTENT_SIGNS:
        points[language] = points.get(language, F.lit(0)) + F.least(F.regexp_count(text, F.lit(pattern)), F.lit(3)) * weight
    return F.array_max(F.array(*[F.struct(p.cast("long").alias("points"), F.lit(-i).alias("first"), F.lit(name).alias("language")) for i, (name, p) in enumerate(points.items())]))


def confidence_of(points: Column) -> Column:
    return F.when(points >= 10, "high").when(points >= 4, "medium").when(points >= 2, "low").otherwise("none")


def language_by_content(files: DataFrame, sample: int = 3000) -> DataFrame:
    """The language with most points, the first of the best; unknown without any."""
    rows = files.select("path", content_best(F.col("content"), sample).alias("best"))
    return rows.select("path", F.when(F.col("best.points") > 0, F.col("best.language")).otherwise("unknown").alias("language"), F.col("best.points").alias("points"), confidence_of(F.col("best.points")).alias("confidence"))


def detected_languages(files: DataFrame) -> DataFrame:
    """path, language, confidence, method: by name, else extension, else first line, else (over 50 characters) content with two points or more."""
    path, text = F.col("path"), F.coalesce("content", F.lit(""))
    named, extended, called = looked_up(name_of(path), LANGUAGE_OF_NAME), looked_up(extension_of(path), LANGUAGE_OF_EXTENSION), language_by_shebang(text)
    rows = files.select("path", named.alias("n"), extended.alias("e"), called.alias("s"), F.when(F.length(F.trim(text, F.lit(" \t\n\r"))) > 50, content_best(text)).alias("best"))
    told = F.col("best.points") >= 2
    method = F.when(F.col("n").isNotNull(), "filename").when(F.col("e").isNotNull(), "extension").when(F.col("s").isNotNull(), "shebang").when(told, "heuristics").otherwise("none")
    language = F.coalesce("n", "e", "s", F.when(told, F.col("best.language")), F.lit("unknown"))
    sure = F.coalesce("n", "e", "s").isNotNull()
    return rows.select("path", language.alias("language"), F.when(sure, "high").when(told, confidence_of(F.col("best.points"))).otherwise("none").alias("confidence"), method.alias("method"))


def merged_intervals(rows: DataFrame) -> DataFrame:
    """key, first, last, merged: unions of intervals (key, first, last) that overlap or touch."""
    order = Window.partitionBy("key").orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("first") <= F.col("before") + 1, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("before", before).withColumn("island", island).groupBy("key", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("merged")).drop("island")


def packed_context(chunks: DataFrame, budget: int) -> DataFrame:
    """key, included, skipped, used: chunks (key, place, chars) taken in order while they fit; what does not fit is passed over.

    Later, smaller chunks may fit, so the choice is a fold over one key's ordered sizes.
    """
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("place", "chars"))), lambda x: x["chars"])
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("n"))
    take = lambda s, c: F.when(s["used"] + c <= budget, F.struct((s["used"] + c).alias("used"), (s["n"] + 1).alias("n"))).otherwise(s)
    rows = chunks.groupBy("key").agg(F.count("*").alias("chunks"), F.aggregate(sizes, zero, take).alias("s"))
    return rows.select("key", F.col("s.n").alias("included"), (F.col("chunks") - F.col("s.n")).alias("skipped"), F.col("s.used").alias("used"))


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of the ordered rows, with the total, the pages and whether more follow."""
    total = rows.agg(F.count("*").alias("total"))
    few = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    return few.join(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / size)).withColumn("has_more", F.col("total") > number * size)


def upload_actions(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """path, action for files (path, content) that come to a store of such: unchanged, replace (the path holds another content), duplicate (the content lies under other paths) or add.

    Null contents count as empty. Repeated rows are judged alike; where a path is stored
    more than once, one stored row with the same content suffices.
    """
    digest = F.sha2(F.coalesce("content", F.lit("")), 256)
    rows, kept = incoming.select("path", digest.alias("digest")), stored.select("path", digest.alias("digest"))
    paths = kept.select("path").distinct().withColumn("known_path", F.lit(True))
    texts = kept.select("digest").distinct().withColumn("known_text", F.lit(True))
    same = kept.distinct().withColumn("same", F.lit(True))
    joined = rows.join(same, ["path", "digest"], "left").join(paths, "path", "left").join(texts, "digest", "left")
    action = F.when(F.col("same"), "unchanged").when(F.col("known_path"), "replace").when(F.col("known_text"), "duplicate").otherwise("add")
    return joined.select("path", action.alias("action"))

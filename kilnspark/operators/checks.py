"""Conditions that decide what is taken in: uploads, indexing, requests, accounts, projects, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paths import LANGUAGE_OF_EXTENSION, extension_of, name_of

#: Names without an extension that may be uploaded: fixed values.
UPLOAD_NAMES = ["dockerfile", "containerfile", "makefile", "procfile"]
#: Extensions and parts of names that are not indexed: fixed values.
INDEX_SKIP_EXTENSIONS = [
    "pyc", "pyo", "pyd", "so", "dll", "exe", "jpg", "jpeg", "png", "gif", "ico", "svg",
    "pdf", "doc", "docx", "xls", "xlsx", "zip", "tar", "gz", "rar", "7z", "lock", "log",
]
GENERATED_NAMES = ["package-lock.json", "yarn.lock", "poetry.lock", "Pipfile.lock", ".min.js", ".min.css"]
INDEX_MOST_BYTES = 2 * 1024 * 1024
#: Paths that no limit holds for, and parts of a request that block it: fixed values.
BYPASS_PATHS = ["/health", "/docs", "/redoc", "/openapi.json", "/favicon.ico"]
BLOCKED_PARTS = ["../", "..\\", "<script", "javascript:", "vbscript:", "%2e%2e", "%00", "etc/passwd", "win.ini"]
EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
USERNAME = r"^[a-zA-Z0-9_\-]{3,30}$"
#: What a password must hold, in the order in which it is looked for, and the first complaint: fixed values.
PASSWORD_RULES = [
    (r"(?s)^.{8,}$", "Password must be at least 8 characters long."),
    (r"[A-Z]", "Password must contain at least one uppercase letter."),
    (r"[a-z]", "Password must contain at least one lowercase letter."),
    (r"[0-9]", "Password must contain at least one number."),
    (r"[!@#$%^&*()_+\-=\[\]{}|;:,.<>?]", "Password must contain at least one special character."),
]


def may_upload(path: Column) -> Column:
    """A known extension, an archive, or one of the names that need none."""
    return F.lower(name_of(path)).isin(UPLOAD_NAMES) | extension_of(path).isin([*LANGUAGE_OF_EXTENSION, "zip"])


def index_skip_reason(path: Column, content: Column) -> Column:
    """Why a file is not indexed, the first of: extension, empty, too large, generated; null if it is."""
    text, name = F.coalesce(content, F.lit("")), F.lower(name_of(path))
    generated = F.exists(F.array(*map(F.lit, GENERATED_NAMES)), lambda g: F.contains(name, g))
    return (
        F.when(extension_of(path).isin(INDEX_SKIP_EXTENSIONS), "extension")
        .when(F.trim(text, F.lit(" \t\n\r\x0b\x0c")) == "", "empty")
        .when(F.octet_length(text) > INDEX_MOST_BYTES, "too large")
        .when(generated, "generated")
    )


def bypasses_limits(path: Column, method: Column) -> Column:
    """Paths that are always free, preflights, and whatever is no interface path."""
    free = F.lit(False)
    for p in BYPASS_PATHS:
        free = free | path.startswith(p)
    return free | (method == "OPTIONS") | ~path.startswith("/api/")


def is_blocked(path: Column, query: Column) -> Column:
    whole = F.lower(F.concat(path, F.lit("?"), query))
    return F.exists(F.array(*map(F.lit, BLOCKED_PARTS)), lambda b: F.contains(whole, b))


def request_checks(requests: DataFrame) -> DataFrame:
    """id, may_upload, skip_reason, bypasses, blocked, of requests(id, path, query, method, content)."""
    c = F.col
    return requests.select("id", may_upload(c("path")).alias("may_upload"), index_skip_reason(c("path"), c("content")).alias("skip_reason"), bypasses_limits(c("path"), c("method")).alias("bypasses"), is_blocked(c("path"), c("query")).alias("blocked"))


def account_checks(accounts: DataFrame) -> DataFrame:
    """id, whether e-mail and username are well formed once trimmed, and the first complaint about the password, null if there is none."""
    complaint = F.lit(None).cast("string")
    for pattern, words in reversed(PASSWORD_RULES):
        complaint = F.when(~F.col("password").rlike(pattern), words).otherwise(complaint)
    return accounts.select("id", F.lower(F.trim("email")).rlike(EMAIL).alias("email_ok"), F.trim("username").rlike(USERNAME).alias("username_ok"), complaint.alias("password_complaint"))


def without_credentials(url: Column | str) -> Column:
    """What follows the last @ of a connection address."""
    return F.element_at(F.split(url, "@"), -1)


def project_search(projects: DataFrame, needle: str, language: str | None = None) -> DataFrame:
    """Projects whose name or description holds the needle, any case, and whose language is the given one."""
    low = needle.lower()
    holds = F.contains(F.lower("name"), F.lit(low)) | F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit(low))
    return projects.where(holds if language is None else holds & (F.col("language") == language))


def alerts(counts: DataFrame) -> DataFrame:
    """Rows that are worth an alert: a critical finding, or three high ones."""
    return counts.where((F.col("critical") > 0) | (F.col("high") >= 3))


#: Limits of a batch of files, in files and bytes, and of a question, in characters and sources: fixed values.
BATCH_FILES, BATCH_BYTES, QUESTION_CHARS, MOST_SOURCES, USUAL_SOURCES = 500, 50 << 20, 4000, 20, 8


def batch_guards(files: DataFrame) -> DataFrame:
    """batch, files, bytes, fault of files(batch, path, content): the first of too many files, too many bytes of content and files without a path; null if there is none.

    Null contents have no bytes; a null or blank path is none. Batches without files have no row.
    """
    sums = files.groupBy("batch").agg(F.count("*").alias("files"), F.sum(F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")).alias("bytes"), F.count_if(F.coalesce(F.trim(F.col("path").cast("string")), F.lit("")) == "").alias("nameless"))
    fault = F.when(F.col("files") > BATCH_FILES, "too many files").when(F.col("bytes") > BATCH_BYTES, "too many bytes").when(F.col("nameless") > 0, "file without a path")
    return sums.select("batch", "files", "bytes", fault.alias("fault"))


def question_checks(questions: DataFrame) -> DataFrame:
    """id, fault, sources of questions(id, query, project, sources): what is wrong, null if nothing is, and how many sources are looked up, within 1 and 20 (8 where null)."""
    query, project = F.trim(F.coalesce("query", F.lit(""))), F.trim(F.coalesce(F.col("project").cast("string"), F.lit("")))
    fault = F.when(query == "", "query is empty").when(F.length(query) > QUESTION_CHARS, "query is too long").when(project == "", "project is missing")
    return questions.select("id", fault.alias("fault"), F.greatest(F.lit(1), F.least(F.coalesce("sources", F.lit(USUAL_SOURCES)), F.lit(MOST_SOURCES))).alias("sources"))

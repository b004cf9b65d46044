"""Source files from ZIP archives: what is wrong with an archive, and the files of sound ones."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnspark.operators.checks import may_upload
from kilnspark.operators.paths import is_skipped, language_by_extension

#: Limits of an archive and a file, of bytes looked at for binary content, and of contents that are kept: fixed values.
MOST_BYTES, MOST_FILES, MOST_FILE_BYTES, SAMPLE, MOST_CONTENT = 100 << 20, 1000, 10 << 20, 8192, 500_000


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive (its path) and data of each *.zip under a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("archive"), F.col("content").alias("data"))


def _fault(data: bytes | None, names: list[str]) -> str | None:
    if len(data or b"") > MOST_BYTES:
        return "archive too large"
    if len(names) > MOST_FILES:
        return "too many files"
    if any(n.startswith("/") or ".." in n for n in names):
        return "unsafe path"
    return None


def _root(names: list[str]) -> str:
    """The one folder that all files in folders share, if it holds more than one."""
    first = {n.split("/")[0] for n in names if "/" in n}
    root = f"{first.pop()}/" if len(first) == 1 else ""
    return root if root and sum(n.startswith(root) for n in names) > 1 else ""


def _entries(archive: str, data: bytes | None) -> Iterator[tuple]:
    """A row (archive, fault, path, data) for each file; one with a fault and no path for an archive that is not sound."""
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as opened:
            names = opened.namelist()
            fault = _fault(data, names)
            if fault:
                yield archive, fault, None, None
                return
            files = [n for n in names if not n.endswith("/")]
            root = _root(files)
            for n in files:
                at = n[len(root) :] if n.startswith(root) else n
                if opened.getinfo(n).file_size > MOST_FILE_BYTES:
                    yield archive, "file too large", at, None
                    continue
                try:
                    yield archive, None, at, opened.read(n)
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError):
                    yield archive, "unreadable file", at, None
    except zipfile.BadZipFile:
        yield archive, "not an archive", None, None


def is_binary(data: Column, sample: int = SAMPLE) -> Column:
    """A null byte, or over 30 % of control bytes, at the beginning."""
    head = F.decode(F.substring(data, 1, sample), "ISO-8859-1")
    control = F.regexp_count(head, F.lit(r"[\x00-\x08\x0E-\x1F]"))
    return F.contains(head, F.lit("\x00")) | (control > 0.3 * F.length(head))


def extract(archives: DataFrame) -> DataFrame:
    """archive, fault, path, size, language, lines, is_binary, digest, content of every entry of archives(archive, data).

    Faults are given as rows with `fault`; without one are the files that may be taken
    in (no skipped folders, allowed extensions). Contents of binary files and of those of
    500 000 bytes or more are left out. A null archive is not an archive. One archive is
    opened at a time and its files are passed on one by one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, data in zip(batch.archive, batch.data, strict=True):
                for row in _entries(archive, data):
                    yield pd.DataFrame([row], columns=["archive", "fault", "path", "data"])

    rows = archives.select("archive", "data").mapInPandas(run, "archive string, fault string, path string, data binary")
    rows = rows.where(F.col("fault").isNotNull() | (~is_skipped(F.col("path")) & may_upload(F.col("path"))))
    binary, text = is_binary(F.col("data")), F.make_valid_utf8(F.col("data").cast("string"))
    lines = F.regexp_count(text, F.lit("\n")) + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)
    return rows.select(
        "archive", "fault", "path", F.length("data").cast("long").alias("size"), language_by_extension(F.col("path")).alias("language"), F.when(binary, 0).otherwise(lines).alias("lines"),
        binary.alias("is_binary"), F.sha2("data", 256).alias("digest"), F.when(~binary & (F.length("data") < MOST_CONTENT), text).alias("content"),
    )

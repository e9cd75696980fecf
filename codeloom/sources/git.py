"""The git command line as a source; it runs on the driver, its output becomes DataFrames."""

from __future__ import annotations

import itertools
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Marks between records and fields of the log, and its format.
RECORD, FIELD = "␝", "␞"
FORMAT = FIELD.join(["%H", "%s", "%b", "%an", "%ae", "%aI"]) + RECORD
_COLUMNS = ["hash", "subject", "body", "author_name", "author_email", "author_date"]


def run(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, check=True).stdout


def parse_log(raw: DataFrame) -> DataFrame:
    """Commits of (output): records with fewer than six fields are skipped."""
    records = raw.select(F.explode(F.split("output", RECORD)).alias("r")).select(F.split(F.trim(F.regexp_replace("r", r"^\s+|\s+$", "")), FIELD).alias("f")).where(F.size("f") >= 6)
    fields = [F.regexp_replace(F.col("f")[k], r"^\s+|\s+$", "").alias(n) for k, n in enumerate(_COLUMNS)]
    return records.select(*fields).withColumn("author_date", F.to_timestamp("author_date"))


def _records(repo: str, *args: str) -> Iterator[str]:
    """The output of git, read as it comes and cut behind each RECORD, so that a long log is never one string."""
    with subprocess.Popen(["git", "-C", repo, *args], stdout=subprocess.PIPE, text=True) as process:
        rest = ""
        while piece := process.stdout.read(1 << 16):
            *whole, rest = (rest + piece).split(RECORD)
            yield from (w + RECORD for w in whole)
        if rest.strip():
            yield rest
    if process.returncode:
        raise subprocess.CalledProcessError(process.returncode, process.args)


def _rows(spark: SparkSession, records: Iterator[str], column: str, batch: int = 10_000) -> DataFrame:
    """Records as rows, handed over in batches."""
    out = None
    while part := [(r,) for r in itertools.islice(records, batch)]:
        df = spark.createDataFrame(part, f"{column} string")
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], f"{column} string")


def log(spark: SparkSession, repo: str, limit: int = 500, path: str | None = None, grep: str | None = None) -> DataFrame:
    args = ["log", f"--format={FORMAT}", f"-n{limit}"] + (["--all", "-i", f"--grep={grep}"] if grep else []) + (["--", path] if path else [])
    return parse_log(_rows(spark, _records(repo, *args), "output"))


def files(spark: SparkSession, repo: str, limit: int = 500) -> DataFrame:
    """(hash, status, path): the files each commit changed; of a renamed one the new path."""
    blocks = _rows(spark, _records(repo, "log", f"-n{limit}", "--name-status", f"--format={RECORD}%H"), "block").select(F.split(F.trim(F.translate("block", RECORD, "")), "\n").alias("l"))
    rows = blocks.where("l[0] <> ''").select(F.col("l")[0].alias("hash"), F.explode("l").alias("line")).where("line <> '' AND line <> hash")
    parts = F.split("line", "\t")
    return rows.select("hash", F.substring(parts[0], 1, 1).alias("status"), F.element_at(parts, -1).alias("path"))


def show_stat(spark: SparkSession, repo: str, commit: str) -> DataFrame:
    """(path, added, removed) of a commit; null lines for binary files."""
    lines = [x.split("\t") for x in run(repo, "show", "--numstat", "--format=", commit).splitlines() if x.count("\t") == 2]
    return spark.createDataFrame([(p, int(a) if a.isdigit() else None, int(r) if r.isdigit() else None) for a, r, p in lines], "path string, added int, removed int")


def show_message(repo: str, commit: str) -> str:
    return run(repo, "show", "-s", "--format=%B", commit).strip()


def diff(spark: SparkSession, repo: str, a: str, b: str) -> DataFrame:
    """(status, path) between two commits."""
    lines = [x.split("\t") for x in run(repo, "diff", "--name-status", a, b).splitlines() if x]
    return spark.createDataFrame([(x[0][0], x[-1]) for x in lines], "status string, path string")


def head(repo: str) -> dict[str, str]:
    return {"branch": run(repo, "rev-parse", "--abbrev-ref", "HEAD").strip(), "commit": run(repo, "rev-parse", "HEAD").strip(), "git_dir": run(repo, "rev-parse", "--absolute-git-dir").strip()}


def blame(spark: SparkSession, repo: str, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """(line, hash) of a file, or of its lines from ``start`` to ``end``."""
    span = ["-L", f"{start},{end}"] if start is not None and end is not None else []
    rows = [x.split() for x in run(repo, "blame", "--line-porcelain", *span, "--", path).splitlines() if len(x.split()) >= 3 and len(x.split()[0]) == 40]
    return spark.createDataFrame([(int(x[2]), x[0]) for x in rows], "line int, hash string")

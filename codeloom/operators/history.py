"""Mining a commit history into notes, and searching it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import rules

#: Patterns that may become notes.
MINED = ["BugFix", "ArchitecturalDecision", "BreakingChange", "Deprecation", "Revert", "Feature"]


def classify(commits: DataFrame) -> DataFrame:
    """Commits with pattern, confidence, issue, reverted hash and the fields their bodies spell out."""
    s, b = F.col("subject"), F.col("body")
    return (
        commits.withColumn("_p", rules.commit_pattern(s, b))
        .select("*", "_p.pattern", "_p.confidence")
        .drop("_p")
        .withColumns(
            {
                "issue": rules.issue_reference(s),
                "reverts": rules.revert_hash(s),
                "problem": F.coalesce(rules.body_field(b, "problem|issue|bug"), s),
                "cause": rules.body_field(b, "cause|root cause|reason"),
                "workaround": rules.body_field(b, "workaround|migration"),
                "kind": rules.memory_kind_of_commit(F.col("pattern"), b),
            }
        )
    )


def mine(commits: DataFrame, commit_files: DataFrame, nodes: DataFrame, known: DataFrame, most: int = 500, least: float = 0.7, enabled: list[str] | None = None) -> DataFrame:
    """(hash, pattern, confidence, kind, title, severity, links): notes from the latest ``most`` commits.

    Commits whose hash is among ``known`` (hash; notes no longer valid included) are skipped, as are disabled patterns, those below ``least`` and those
    that make no note. A note is linked to at most five nodes, by id, of each file its commit changed.
    """
    recent = commits.orderBy(F.desc("author_date"), "hash").limit(most).join(known.select("hash").distinct(), "hash", "left_anti")
    found = classify(recent).where(F.col("pattern").isin(enabled or MINED) & (F.col("confidence") >= least) & F.col("kind").isNotNull())
    w = Window.partitionBy("hash", "path").orderBy("node_id")
    touched = commit_files.join(found.select("hash"), "hash", "left_semi").join(nodes.select("path", "node_id"), "path").withColumn("_n", F.row_number().over(w)).where("_n <= 5")
    links = touched.groupBy("hash").agg(F.array_sort(F.collect_set("node_id")).alias("links"))
    title = F.when(F.col("pattern") == "Deprecation", F.concat(F.lit("Deprecated: "), "subject")).when(F.col("pattern") == "Revert", F.concat(F.lit("Reverted: "), "subject")).otherwise(F.col("subject"))
    severity = F.when(F.col("pattern") == "BreakingChange", "high").when(F.col("kind") == "known_issue", "medium")
    return found.join(links, "hash", "left").select("hash", "pattern", "confidence", "kind", title.alias("title"), severity.alias("severity"), F.coalesce("links", F.array().cast("array<bigint>")).alias("links"))


def mining_summary(commits: DataFrame, mined: DataFrame, most: int = 500) -> DataFrame:
    """(processed, created, skipped)."""
    processed = F.least(F.count("*"), F.lit(most))
    return commits.agg(processed.alias("processed")).crossJoin(mined.agg(F.count("*").alias("created"))).withColumn("skipped", F.col("processed") - F.col("created"))


def of_file(commits: DataFrame, commit_files: DataFrame, path: str) -> DataFrame:
    return commits.join(commit_files.where(F.col("path") == path).select("hash"), "hash", "left_semi")


def grep(commits: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """Commits whose message matches, whatever the case, latest first."""
    hit = F.concat_ws("\n", "subject", "body").rlike("(?i)" + pattern)
    out = commits.where(hit).orderBy(F.desc("author_date"), "hash")
    return out.limit(limit) if limit else out


def search(commits: DataFrame, notes: DataFrame | None, words: str, since=None, limit: int = 10, least: float | None = 0.5, stages: int = 3) -> DataFrame:
    """(hash, subject, stage): similar notes with a commit, then messages with the words, then, with ``since``, any commit after it.

    ``notes`` is (hash, score), null for none; each stage fills what those before left free; a commit comes once, at its first stage.
    """
    recent = commits if since is None else commits.where(F.col("author_date") >= F.lit(since))
    parts = []
    if notes is not None:
        near = notes.where("hash IS NOT NULL") if least is None else notes.where((F.col("score") >= least) & F.col("hash").isNotNull())
        ranked = near.groupBy("hash").agg(F.max("score").alias("score")).select("hash", F.lit(1).alias("stage"), (-F.col("score")).alias("rank"))
        parts.append(ranked.orderBy("rank", "hash").limit(limit))
    age = -F.unix_seconds(F.col("author_date").cast("timestamp")).cast("double")
    parts.append(grep(recent, words, limit).select("hash", F.lit(2).alias("stage"), age.alias("rank")))
    if since is not None and stages > 2:
        parts.append(recent.orderBy(F.desc("author_date"), "hash").limit(limit).select("hash", F.lit(3).alias("stage"), age.alias("rank")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    first = every.groupBy("hash").agg(F.min(F.struct("stage", "rank")).alias("f"))
    return first.join(commits.select("hash", "subject"), "hash").orderBy("f.stage", "f.rank", "hash").limit(limit).select("hash", "subject", "f.stage")

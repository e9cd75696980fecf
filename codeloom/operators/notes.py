"""Bi-temporal notes: an append-only log of versions, what is current or was valid when, search and context.

A note is (id, kind, title, content, tags, code_links, valid_at, invalid_at, created_at, superseded_at, commit_hash, confidence, embedding);
code_links is an array of struct<node_id: bigint, relevance: double>.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.rules import was_current_at, was_valid_at
from codeloom.operators.search import bm25, memory_tokens
from codeloom.operators.vectors import cosine_to

#: Shares of words, vectors and code links in a note's score.
WORDS, VECTORS, LINKS = 0.3, 0.5, 0.2
#: Kinds of notes and the defaults of what is stored of each.
KINDS = {
    "debug_context": {"problem_description": "", "solution": "", "root_cause": None, "symptoms": [], "related_errors": []},
    "architectural_decision": {"decision": "", "rationale": "", "alternatives_considered": None, "stakeholders": []},
    "known_issue": {"description": "", "severity": "medium", "workaround": None, "tracking_id": None},
    "convention": {"name": "", "description": "", "pattern": None, "anti_pattern": None},
    "project_context": {"topic": "", "description": "", "tags": []},
}


SCHEMA = (
    "id string, kind string, kind_data string, title string, content string, tags array<string>, code_links array<struct<node_id:bigint,relevance:double>>, valid_at timestamp, invalid_at timestamp, "
    "created_at timestamp, superseded_at timestamp, commit_hash string, confidence double, embedding array<float>"
)


def make(spark: SparkSession, kind: str, title: str, content: str, tags: list[str] | None = None, links: dict[int, float] | None = None, confidence: float = 1.0, commit: str | None = None, moment: datetime | None = None, note: str | None = None, **data) -> DataFrame:
    """One note of a known kind; fields of the kind that are not given have its defaults. Raises ValueError for an unknown kind or field."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of note: {kind}")
    unknown = set(data) - set(KINDS[kind])
    if unknown:
        raise ValueError(f"a {kind} has no {', '.join(sorted(unknown))}")
    now = moment or datetime.now(timezone.utc)
    row = (note or str(uuid.uuid4()), kind, json.dumps(KINDS[kind] | data), title, content, tags or [], [(n, float(r)) for n, r in (links or {}).items()], now, None, now, None, commit, float(confidence), None)
    return spark.createDataFrame([row], SCHEMA)


def is_current() -> Column:
    return F.col("invalid_at").isNull() & F.col("superseded_at").isNull()


def latest(log: DataFrame) -> DataFrame:
    """The last version of each note of a log with ``version``; deleted ones (``deleted`` true) are gone."""
    w = Window.partitionBy("id").orderBy(F.desc("version"))
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1 AND NOT coalesce(deleted, false)").drop("_n")


def put(log: DataFrame, notes: DataFrame, version: int) -> DataFrame:
    """The log with new versions of ``notes``; an update clears the vector, which is made anew."""
    return log.unionByName(notes.withColumns({"version": F.lit(version).cast("bigint"), "deleted": F.lit(False)}), allowMissingColumns=True)


def delete(log: DataFrame, ids: DataFrame, version: int) -> DataFrame:
    gone = latest(log).join(ids.select("id").distinct(), "id", "left_semi").withColumns({"version": F.lit(version).cast("bigint"), "deleted": F.lit(True)})
    return log.unionByName(gone)


def invalidate(log: DataFrame, ids: DataFrame, moment: Column, version: int) -> DataFrame:
    """Notes that end at ``moment``; unknown ids and those ended before change nothing."""
    ended = latest(log).where(is_current()).join(ids.select("id").distinct(), "id", "left_semi").withColumns({"invalid_at": moment, "version": F.lit(version).cast("bigint")})
    return log.unionByName(ended)


def get(log: DataFrame, note: str) -> DataFrame:
    return latest(log).where((F.col("id") == note) & is_current())


def as_of(notes: DataFrame, moment: Column) -> DataFrame:
    """What was valid at a moment and known then."""
    return notes.where(was_valid_at(F.col("valid_at"), F.col("invalid_at"), moment) & was_current_at(F.col("created_at"), F.col("superseded_at"), moment))


def valid_seconds(notes: DataFrame) -> DataFrame:
    """(id, seconds): how long each note that ended was valid."""
    return notes.where("invalid_at IS NOT NULL").select("id", (F.unix_seconds("invalid_at") - F.unix_seconds("valid_at")).alias("seconds"))


def by_code(notes: DataFrame, node: int) -> DataFrame:
    return notes.where(F.exists("code_links", lambda x: x["node_id"] == node))


def by_tag(notes: DataFrame, tag: str) -> DataFrame:
    return notes.where(F.array_contains("tags", tag))


def by_kind(notes: DataFrame) -> DataFrame:
    """(kind, notes, current, invalidated)."""
    return notes.groupBy("kind").agg(F.count("*").alias("notes"), F.count_if(is_current()).alias("current"), F.count_if(~is_current()).alias("invalidated"))


def tag_counts(notes: DataFrame) -> DataFrame:
    return notes.where(is_current()).select(F.explode("tags").alias("tag")).where("tag IS NOT NULL").groupBy("tag").agg(F.count("*").alias("notes"))


def once_each(notes: DataFrame, *order: Column) -> DataFrame:
    """One note for each commit, then one for each title; the first by ``order``."""
    by_commit = Window.partitionBy(F.coalesce("commit_hash", F.concat(F.lit("\0"), "id"))).orderBy(*order)
    by_title = Window.partitionBy(F.coalesce("title", F.concat(F.lit("\0"), "id"))).orderBy(*order)
    return notes.withColumn("_n", F.row_number().over(by_commit)).where("_n = 1").withColumn("_n", F.row_number().over(by_title)).where("_n = 1").drop("_n")


def listed(notes: DataFrame, kinds: list[str] | None = None, tags: list[str] | None = None, limit: int = 50, offset: int = 0, current_only: bool = True) -> DataFrame:
    """(id, kind, title, total): a page, latest first, and how many there are before paging."""
    found = notes.where(is_current()) if current_only else notes
    if kinds:
        found = found.where(F.col("kind").isin(kinds))
    if tags:
        found = found.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    unique = once_each(found, F.desc("created_at"), F.col("id"))
    total = unique.agg(F.count("*").alias("total"))
    return unique.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit).select("id", "kind", "title").crossJoin(F.broadcast(total))


def text_index(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings and statistics of title, content and tags, without field weights."""
    text = F.concat_ws(" ", "title", "content", F.array_join("tags", " "))
    fields = notes.select(F.col("id").alias("node_id"), memory_tokens(text).alias("tokens"))
    words = fields.select("node_id", F.explode("tokens").alias("term")).groupBy("term", "node_id").agg(F.count("*").alias("tf")).withColumn("weight", F.lit(1.0))
    return words, fields.select("node_id", F.size("tokens").cast("bigint").alias("doc_len"))


def nearest(notes: DataFrame, vector: list[float], k: int = 10, least: float | None = None) -> DataFrame:
    """(id, cosine): the ``k`` notes whose vectors are most similar to one, exactly: each partition keeps its best k. Notes without a vector of its length take no
    part; ties go to the smaller id."""
    fit = notes.where(F.size("embedding") == len(vector)).select(F.col("id").alias("node_id"), "embedding")
    found = cosine_to(fit, vector).select(F.col("node_id").alias("id"), "cosine")
    if least is not None:
        found = found.where(F.col("cosine") >= least)
    return found.orderBy(F.desc("cosine"), "id").limit(k)


def search(notes: DataFrame, words: str, vector: list[float] | None = None, code: list[int] | DataFrame | None = None, kinds: list[str] | None = None, tags: list[str] | None = None, limit: int = 10, current_only: bool = True, unique: bool = True) -> DataFrame:
    """(id, title, score): notes by words, vectors and links to the code at hand.

    ``code`` is node ids, or a table (node_id) of any size. Candidates are the best three times ``limit`` by words and by vector; kind and tag filters apply after, so fewer may come out. The words'
    score is taken as it is. With ``unique`` a commit and a title come once.
    """
    base = notes.where(is_current()) if current_only else notes
    many = 3 * limit
    by_words = bm25(*text_index(base), words, many, memory_tokens, 0.0).select(F.col("node_id").alias("id"), F.col("score").alias("w"))
    candidates = by_words.select("id")
    if vector is not None:
        near = nearest(base, vector, many).withColumnRenamed("cosine", "v")
        candidates = candidates.unionByName(near.select("id")).distinct()
    out = candidates.join(by_words, "id", "left")
    out = out.join(near, "id", "left") if vector is not None else out.withColumn("v", F.lit(0.0))
    out = out.join(base, "id")
    if isinstance(code, DataFrame):
        links = out.select("id", F.explode("code_links").alias("l")).select("id", "l.node_id", "l.relevance").join(code.select("node_id").distinct(), "node_id", "left_semi")
        out = out.join(links.groupBy("id").agg(F.max("relevance").alias("_g")), "id", "left")
        g = F.coalesce("_g", F.lit(0.0))
    else:
        linked = F.filter("code_links", lambda x: x["node_id"].isin(code or [])) if code else None
        g = F.coalesce(F.array_max(F.transform(linked, lambda x: x["relevance"])), F.lit(0.0)) if code else F.lit(0.0)
    out = out.withColumn("score", WORDS * F.coalesce("w", F.lit(0.0)) + VECTORS * F.coalesce("v", F.lit(0.0)) + LINKS * g)
    if kinds:
        out = out.where(F.col("kind").isin(kinds))
    if tags:
        out = out.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    top = out.orderBy(F.desc("score"), "id").limit(limit)
    if unique:
        top = once_each(top, F.desc("score"), F.col("id"))
    return top.select("id", "title", "score").orderBy(F.desc("score"), "id")


def context_of_file(notes: DataFrame, nodes: DataFrame, path: str, limit: int = 5, with_links: bool = False) -> DataFrame:
    """Notes on a file: asked by its path, or by its name and with the nodes it holds."""
    if not with_links:
        return search(notes, path, limit=limit)
    return search(notes, path.rsplit("/", 1)[-1], code=nodes.where(F.col("path") == path).select("node_id"), limit=limit)


def embedded(notes: DataFrame, embedder, size: int) -> DataFrame:
    """Notes with a vector for each: those without one of ``size`` numbers, as after an update or from another model, are embedded anew from title,
    content and tags. Rows without id, kind or content can't be read and are left out."""
    from codeloom.operators.vectors import embed

    fine = notes.where("id IS NOT NULL AND kind IS NOT NULL AND content IS NOT NULL")
    has = F.coalesce(F.size("embedding") == size, F.lit(False))
    text = F.concat_ws(" ", "title", "content", F.array_join("tags", " "))
    fresh = embed(fine.where(~has).drop("embedding").withColumn("_text_", text), "_text_", embedder).drop("_text_")
    return fine.where(has).unionByName(fresh.select(*fine.columns))


def touched_by(notes: DataFrame, removed: DataFrame) -> DataFrame:
    """(id): current notes linked to any removed node (node_id), once each."""
    links = notes.where(is_current()).select("id", F.explode("code_links").alias("l")).select("id", F.col("l.node_id").alias("node_id"))
    return links.join(removed.select("node_id").distinct(), "node_id", "left_semi").select("id").distinct()


def grouped(notes: DataFrame) -> DataFrame:
    """(position, kind, notes): current notes by kind in the order of KINDS; kinds without notes are left out."""
    order = F.create_map(*[x for k, n in enumerate(KINDS) for x in (F.lit(n), F.lit(k))])
    return notes.where(is_current()).groupBy("kind").agg(F.count("*").alias("notes")).select(F.try_element_at(order, F.col("kind")).alias("position"), "kind", "notes").where("position IS NOT NULL")


def migrate(notes: DataFrame, version: int) -> DataFrame:
    """Notes of an older store in today's form: before version 5 vectors were of other models and are cleared."""
    out = notes
    for name, kind in (("tags", "array<string>"), ("code_links", "array<struct<node_id:bigint,relevance:double>>"), ("embedding", "array<float>"), ("superseded_at", "timestamp"), ("commit_hash", "string")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out.withColumn("embedding", F.lit(None).cast("array<float>")) if version < 5 else out

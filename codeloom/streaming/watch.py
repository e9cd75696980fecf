"""Change streams: debounced file events, upserts of a graph store, and branch switches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators import notes
from codeloom.operators.vectors import hashed_embedding, replace_by_file
from codeloom.session import Scratch
from codeloom.sources.files import graph_of, parse_files, replace_files

#: How long a path, and a branch, has to be quiet.
FILE_QUIET, BRANCH_QUIET = "300 milliseconds", "2 seconds"


def debounce(events: DataFrame, quiet: str = FILE_QUIET, late: str = "10 seconds") -> DataFrame:
    """(path, kind, events, ended): one row for each run of events (path, kind, ts) on a path without a pause of ``quiet``; the last kind wins, at equal times the
    greater. For batches and streams; a stream gives a run once the watermark, ``late`` behind, has passed it."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    runs = events.groupBy(F.session_window("ts", quiet).alias("w"), "path").agg(F.max_by("kind", F.struct("ts", "kind")).alias("kind"), F.count("*").alias("events"))
    return runs.select("path", "kind", "events", F.col("w.end").alias("ended"))


def branch_switches(heads: DataFrame, quiet: str = BRANCH_QUIET) -> DataFrame:
    """(repo, commit, ended): the last commit (repo, commit, ts) of each run of HEAD events; events that end where the run before ended switch nothing."""
    runs = heads.groupBy(F.session_window("ts", quiet).alias("w"), "repo").agg(F.max_by("commit", F.struct("ts", "commit")).alias("commit")).select("repo", "commit", F.col("w.end").alias("ended"))
    before = F.lag("commit").over(Window.partitionBy("repo").orderBy("ended"))
    return runs.withColumn("_b", before).where(~F.col("_b").eqNullSafe(F.col("commit"))).drop("_b")


def split_changes(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path) to remove and (path) to index anew, of (path, status): D, and A, M, R, C."""
    return changes.where("status = 'D'").select("path"), changes.where("status IN ('A', 'M', 'R', 'C')").select("path")


def apply_events(nodes: DataFrame, edges: DataFrame, events: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after debounced events (path, kind): removed and modified files lose their nodes; ``parsed`` are the new nodes of created and modified ones that parse."""
    fresh = parsed.join(events.where("kind <> 'remove'").select("path").distinct(), "path", "left_semi")
    readable = fresh.select("path").unionByName(events.where("kind = 'remove'").select("path")).distinct()
    return replace_files(nodes, edges, fresh, readable)


@dataclass
class Indexed:
    """An indexed workspace between changes: parsed files, the graph made of them, vectors of its symbols and the log of notes; the last two may be None."""

    symbols: DataFrame
    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame | None = None
    log: DataFrame | None = None


def refresh(state: Indexed, contents: DataFrame, removed: DataFrame | None = None, embedder=hashed_embedding, embed: bool = True, moment: Column | None = None) -> Indexed:
    """The state after files were created or changed (path, code) and others removed (path).

    Files that parse replace what was there of them, others are ignored; names are resolved anew over all files, as a new symbol may be what an old file
    means. Notes linked to any node that is gone or was replaced end at ``moment`` (now). With ``embed`` symbols of the changed files get new vectors. All parts are
    written, so states don't grow with the number of changes.
    """
    spark = state.nodes.sparkSession
    scratch = Scratch(spark, "index")
    parsed = scratch.cut(parse_files(contents))
    readable = parsed.where("node_type = 'CodeFile' AND ok").select("path").distinct()
    gone = readable if removed is None else readable.unionByName(removed.select("path")).distinct()
    project = state.symbols.select("project").limit(1).first() if "project" in state.symbols.columns else None
    fresh = parsed.join(readable, "path", "left_semi")
    if "project" in state.symbols.columns:
        fresh = fresh.withColumn("project", F.lit(project[0] if project else None).cast("string"))
    symbols = scratch.cut(state.symbols.join(gone, "path", "left_anti").unionByName(fresh, allowMissingColumns=True))
    nodes, edges = (scratch.cut(df) for df in graph_of(symbols))
    log, vectors = state.log, state.vectors
    if log is not None:
        lost = state.nodes.join(gone, "path", "left_semi").select("node_id")
        version = (log.agg(F.max("version")).first()[0] or 0) + 1
        log = scratch.cut(notes.invalidate(log, notes.touched_by(notes.latest(log), lost), F.current_timestamp() if moment is None else moment, version))
    if vectors is not None:
        left = vectors.join(nodes.select("node_id"), "node_id", "left_semi")
        vectors = scratch.cut(replace_by_file(left, nodes, readable, embedder) if embed else left)
    return Indexed(symbols, nodes, edges, vectors, log)


def switch_branch(state: Indexed, changes: DataFrame, contents: DataFrame, embedder=hashed_embedding) -> Indexed:
    """The state after a switch of branches with ``changes`` (path, status): deleted files go, and of the others those with ``contents`` (path, code), which are those
    that exist, are indexed anew."""
    removed, changed = split_changes(changes)
    return refresh(state, contents.join(changed.distinct(), "path", "left_semi"), removed, embedder)


def on_open(state: Indexed, path: str, text: str, at_startup: bool = True, exclude: list[str] | None = None) -> Indexed:
    """A file was opened: it is indexed, unless it matches ``exclude`` or, without ``at_startup``, was not indexed before."""
    from codeloom.sources.files import scan_files

    spark = state.nodes.sparkSession
    one = spark.createDataFrame([(path, text)], "path string, code string")
    known = not state.symbols.where(F.col("path") == path).isEmpty()
    if not at_startup and not known or exclude and scan_files(one, exclude=exclude).isEmpty():
        return state
    return refresh(state, one, embed=False)


def on_change(state: Indexed, path: str, text: str) -> Indexed:
    """The text of an open file changed: it is parsed anew; vectors wait until it is saved."""
    return refresh(state, state.nodes.sparkSession.createDataFrame([(path, text)], "path string, code string"), embed=False)


def on_save(state: Indexed, path: str, text: str, embedder=hashed_embedding) -> Indexed:
    """A file was saved: it is parsed and embedded anew."""
    return refresh(state, state.nodes.sparkSession.createDataFrame([(path, text)], "path string, code string"), embedder=embedder)


def on_close(state: Indexed, path: str) -> Indexed:
    """A file was closed: its symbols stay, for others refer to them."""
    return state


def event_handler(holder: list[Indexed], read):
    """A function for ``upsert_stream`` that brings ``holder[0]`` up to date with each batch of debounced events (path, kind): ``read(paths)`` gives (path, code) of those
    that exist. A batch that comes again gives the same state."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        present = batch.where("kind <> 'remove'").select("path").distinct()
        holder[0] = refresh(holder[0], read(present), batch.where("kind = 'remove'").select("path").distinct())

    return handle


def branch_handler(folder: str, act):
    """A function for ``foreachBatch`` over debounced HEAD events (repo, commit, ended) that calls ``act(switches, batch_id)`` with those whose commit differs from the last one
    of the repository. The last commits are kept below ``folder`` by batch, so a batch that comes again finds what it found."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm  # noqa: SLF001
        before = jvm.org.apache.hadoop.fs.Path(f"{folder}/{batch_id - 1}")
        there = before.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(before)  # noqa: SLF001
        last = spark.read.parquet(f"{folder}/{batch_id - 1}") if there else spark.createDataFrame([], "repo string, commit string, ended timestamp")
        every = last.unionByName(batch.select(F.col("repo").cast("string").alias("repo"), "commit", "ended"))
        prior = F.lag("commit").over(Window.partitionBy("repo").orderBy("ended"))
        marked = every.withColumn("_b", prior).join(batch.select(F.col("repo").cast("string").alias("repo"), "ended"), ["repo", "ended"], "left_semi")
        act(marked.where(~F.col("_b").eqNullSafe(F.col("commit"))).drop("_b"), batch_id)
        every.groupBy("repo").agg(F.max_by("commit", "ended").alias("commit"), F.max("ended").alias("ended")).write.mode("overwrite").parquet(f"{folder}/{batch_id}")

    return handle


def branch_stream(heads: DataFrame, act, folder: str, quiet: str = BRANCH_QUIET, late: str = "10 seconds") -> StreamingQuery:
    """``branch_switches`` as a stream: starts one that gives ``act`` the switches of each micro-batch, see ``branch_handler``; state and checkpoint lie below ``folder``."""
    runs = heads.withWatermark("ts", late).groupBy(F.session_window("ts", quiet).alias("w"), "repo").agg(F.max_by("commit", F.struct("ts", "commit")).alias("commit"))
    shaped = runs.select("repo", "commit", F.col("w.end").alias("ended"))
    return shaped.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(branch_handler(f"{folder}/last", act)).start()


def upsert_stream(events: DataFrame, handle, checkpoint: str, quiet: str = FILE_QUIET) -> StreamingQuery:
    """Starts a stream that gives each micro-batch of debounced events to ``handle(batch, batch_id)``, which is called again with the same batch if it fails: it must be idempotent."""
    return debounce(events, quiet).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle).start()

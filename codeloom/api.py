"""All tools behind one object: a workspace of nodes, edges, files, commits and notes, asked by name with the usual defaults.

Every method gives a DataFrame. A symbol is named by its node_id, or by a path and a line, of which the nearest symbol is taken.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import context, graph, history, metrics, notes, search, vectors
from codeloom.operators.vectors import hashed_embedding
from codeloom.session import Scratch
from codeloom.sources import files as sources
from codeloom.streaming import watch


@dataclass
class Workspace:
    spark: SparkSession
    nodes: DataFrame
    edges: DataFrame
    project: str = "default"
    files: DataFrame | None = None  # project, path, code
    commits: DataFrame | None = None  # hash, subject, body, author_name, author_date
    commit_files: DataFrame | None = None  # hash, path
    log: DataFrame | None = None  # notes with version and deleted
    vectors: DataFrame | None = None  # node_id, embedding
    embedder: object = hashed_embedding
    symbols: DataFrame | None = None  # parsed files, which changes replace
    _index: str | None = field(default=None, repr=False)
    _opened: tuple | None = field(default=None, repr=False)

    # Building ----------------------------------------------------------------------------------------------------

    @classmethod
    def index_directory(cls, spark: SparkSession, folders: list[str], project: str = "default", exclude: list[str] | None = None, max_files: int = sources.MAX_FILES) -> Workspace:
        """Reads, parses, resolves and embeds source trees. Parsed files and the graph are written to the shared folder, so files are read and parsed once."""
        tree = None
        for folder in folders:
            part = sources.read_tree(spark, folder, exclude, max_files)
            tree = part if tree is None else tree.unionByName(part)
        scratch = Scratch(spark, "index")
        parsed = scratch.cut(sources.parse_files(tree).withColumn("project", F.lit(project)))
        nodes, edges = (scratch.cut(df) for df in sources.graph_of(parsed))
        return cls(spark, nodes, edges, project, tree.withColumn("project", F.lit(project)), vectors=scratch.cut(vectors.symbol_vectors(nodes)), symbols=parsed)

    def reindex_workspace(self, folders: list[str], **options) -> Workspace:
        return self.index_directory(self.spark, folders, self.project, **options)

    def index(self) -> tuple[DataFrame, DataFrame]:
        """The inverted index, written to the shared folder once."""
        if self._index is None:
            f = search.index_fields(self.nodes)
            self._index = Scratch(self.spark, "words").root
            search.save_index(search.postings(f), search.doc_stats(f), self._index)
        return self.spark.read.parquet(f"{self._index}/postings").select("term", "node_id", "tf", "weight"), self.spark.read.parquet(f"{self._index}/documents")

    def text_search(self, query: str, limit: int = 20) -> DataFrame:
        """BM25 alone, from the buckets of the query's words."""
        if self._opened is None:
            self.index()
            self._opened = search.open_index(self.spark, self._index)
        return search.search_index(self._opened, query, limit)

    # Changes -----------------------------------------------------------------------------------------------------

    def _state(self) -> watch.Indexed:
        return watch.Indexed(self.symbols, self.nodes, self.edges, self.vectors, self.log)

    def _with(self, state: watch.Indexed) -> Workspace:
        self.symbols, self.nodes, self.edges, self.vectors, self.log, self._index = state.symbols, state.nodes, state.edges, state.vectors, state.log, None
        self._opened = None
        return self

    def update_files(self, contents: DataFrame, removed: DataFrame | None = None) -> Workspace:
        return self._with(watch.refresh(self._state(), contents, removed, self.embedder))

    def switch_branch(self, changes: DataFrame, contents: DataFrame) -> Workspace:
        return self._with(watch.switch_branch(self._state(), changes, contents, self.embedder))

    def on_open(self, path: str, text: str, **options) -> Workspace:
        return self._with(watch.on_open(self._state(), path, text, **options))

    def on_change(self, path: str, text: str) -> Workspace:
        return self._with(watch.on_change(self._state(), path, text))

    def on_save(self, path: str, text: str) -> Workspace:
        return self._with(watch.on_save(self._state(), path, text, self.embedder))

    def on_close(self, path: str) -> Workspace:
        return self

    def at(self, node: int | None = None, path: str | None = None, line: int | None = None) -> int | None:
        """The node meant."""
        if node is not None:
            return node
        asked = self.spark.createDataFrame([(0, path, line)], "position_id int, path string, line int")
        row = graph.nearest_symbols(self.nodes, asked).first()
        return row["node_id"] if row else None

    def _one(self, node: int, name: str = "start") -> DataFrame:
        return self.spark.createDataFrame([(node,)], f"{name} bigint")

    def _code(self) -> DataFrame:
        return context.bodies(self.nodes, self.files.select("project", "path", "code"))

    def _vector(self, text: str) -> list[float]:
        import pandas as pd

        return [float(x) for x in self.embedder(pd.Series([text]))[0]]

    # Graph -----------------------------------------------------------------------------------------------------------

    def get_callers(self, node=None, path=None, line=None, depth: int = 1) -> DataFrame:
        return graph.callers(self.nodes, self.edges, self._one(self.at(node, path, line)), depth)

    def get_callees(self, node=None, path=None, line=None, depth: int = 1) -> DataFrame:
        return graph.callers(self.nodes, self.edges, self._one(self.at(node, path, line)), depth, "outgoing")

    def get_call_graph(self, node=None, path=None, line=None, depth: int = 3) -> DataFrame:
        return graph.call_graph(self.nodes, self.edges, self.at(node, path, line), depth)

    def get_dependency_graph(self, path: str, depth: int = 3, direction: str = "both") -> DataFrame:
        return graph.dependency_nodes(self.nodes, self.edges, path, depth, direction)

    def traverse_graph(self, node: int, depth: int = 3, direction: str = "outgoing", edge_types=None, node_types=None, limit: int = 100) -> DataFrame:
        return graph.traverse(self.nodes, self.edges, node, depth, direction, edge_types, node_types, limit)

    def analyze_impact(self, node=None, path=None, line=None, change: str = "modify") -> dict[str, DataFrame]:
        targets = self._one(self.at(node, path, line), "target")
        direct = graph.direct_impact(self.nodes, self.edges, targets, change)
        return {"direct": direct, "indirect": graph.indirect_impact(self.nodes, self.edges, direct), "risk": graph.impact_risk(self.edges, targets, change)}

    def get_symbol_info(self, node=None, path=None, line=None) -> DataFrame:
        return graph.symbol_info(self.nodes, self.edges).where(F.col("node_id") == self.at(node, path, line))

    def get_detailed_symbol(self, node=None, path=None, line=None) -> DataFrame:
        found = self.get_symbol_info(self.at(node, path, line)).join(graph.symbol_records(self.nodes), "node_id")
        return found.join(self._code(), "node_id", "left") if self.files is not None else found

    def get_symbol_neighbours(self, node=None, path=None, line=None) -> DataFrame:
        return graph.symbol_neighbours(self.nodes, self.edges).where(F.col("node_id") == self.at(node, path, line))

    def hover(self, node=None, path=None, line=None) -> DataFrame:
        return graph.hover(self.nodes).where(F.col("node_id") == self.at(node, path, line))

    def document_symbols(self, path: str) -> DataFrame:
        return graph.document_symbols(self.nodes, self.edges, path)

    def call_hierarchy(self, node=None, path=None, line=None, direction: str = "incoming") -> DataFrame:
        return graph.call_hierarchy(self.nodes, self.edges, self.at(node, path, line), direction)

    # Search -------------------------------------------------------------------------------------------------------------

    def symbol_search(self, query: str, limit: int = 20, types=None, include_private: bool = True) -> DataFrame:
        near = vectors.cosine_to(self.vectors, self._vector(query)) if self.vectors is not None else None
        return search.symbol_search(self.nodes, *self.index(), query, near, limit, types, include_private)

    def find_by_imports(self, libraries: list[str], mode: str = "fuzzy", limit: int = 50) -> DataFrame:
        return search.by_imports(graph.import_index(self.nodes, self.edges), libraries, mode, limit)

    def find_by_signature(self, name=None, returns=None, params=None, modifiers=None, limit=None) -> DataFrame:
        return search.by_signature(self.nodes, name, returns, params, modifiers, limit)

    def find_entry_points(self, types=("http_handler", "cli_command", "main", "event_handler"), limit: int = 50) -> DataFrame:
        return search.entry_points(self.nodes, list(types), limit)

    def find_related_tests(self, node=None, path=None, line=None, limit: int = 10) -> DataFrame:
        return search.related_tests(self.nodes, self.edges, self.at(node, path, line), limit)

    def cross_project_search(self, query: str, kind=None, limit: int = 20) -> DataFrame:
        return search.cross_project(self.nodes, query, self.project, kind, limit)

    # Metrics ------------------------------------------------------------------------------------------------------------

    def analyze_complexity(self, path: str | None = None, line: int | None = None, threshold: int = 10) -> dict[str, DataFrame]:
        each = metrics.function_complexity(self.nodes, path, line)
        return {"functions": each.orderBy(F.desc("complexity"), "node_id"), "files": metrics.file_complexity(each, threshold), "advice": metrics.complexity_advice(each, threshold)}

    def find_unused_code(self, path=None, include_tests: bool = False, confidence: float = 0.7, limit=None) -> DataFrame:
        return metrics.unused(self.nodes, self.edges, path, include_tests, confidence, limit)

    def analyze_coupling(self, path: str | None = None, depth: int = 2) -> DataFrame:
        """Of one file's dependency graph, or of every file; ``metrics.coupling_advice`` says what to do about it."""
        if path is None:
            return metrics.file_coupling(self.nodes, self.edges)
        return metrics.graph_coupling(graph.dependency_edges(self.edges, self.get_dependency_graph(path, depth)))

    def graph_stats(self) -> DataFrame:
        return graph.symbols_by(self.nodes, "node_type")

    # Vectors --------------------------------------------------------------------------------------------------------------

    def find_duplicates(self, threshold: float = 0.7, limit: int = 20, path=None, exact: bool = True) -> DataFrame:
        return vectors.duplicates(self.nodes, self.vectors, threshold, limit, path, exact)

    def find_similar(self, node: int, limit: int = 10) -> DataFrame:
        functions = self.vectors.join(self.nodes.where("node_type = 'Function'").select("node_id"), "node_id", "left_semi")
        return vectors.similar(functions, functions.where(F.col("node_id") == node), limit)

    def cluster_symbols(self, threshold: float = 0.7, least: int = 2, limit: int = 20) -> DataFrame:
        found = vectors.clusters(self.vectors, threshold, least)
        top = found.groupBy("leader").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "leader").limit(limit)
        return found.join(top, "leader").join(self.nodes.select(F.col("node_id").alias("leader"), F.col("name").alias("label")), "leader")

    def compare_symbols(self, a: int, b: int) -> DataFrame:
        return vectors.compare(self.nodes, self.edges, self.vectors, a, b)

    # Context -----------------------------------------------------------------------------------------------------------------

    def get_ai_context(self, node=None, path=None, line=None, intent: str = "explain", budget: int = 4000) -> DataFrame:
        return context.ai_context(self.nodes, self.edges, self._code(), intent, budget).where(F.col("node_id") == self.at(node, path, line))

    def get_edit_context(self, node=None, path=None, line=None, budget: int = 8000) -> DataFrame:
        return context.edit_context(self.nodes, self.edges, self._code(), budget).where(F.col("node_id") == self.at(node, path, line))

    def get_ai_context_sections(self, node=None, path=None, line=None, intent: str = "explain", budget: int = 4000) -> dict[str, DataFrame]:
        """All sections of the context of one symbol."""
        asked = self.at(node, path, line)
        own = self.nodes.where(F.col("node_id") == asked)
        place = own.select("path")
        pick = lambda df: df.where(F.col("node_id") == asked)
        return {
            "related": self.get_ai_context(asked, intent=intent, budget=budget), "dependencies": pick(context.dependencies(self.nodes, self.edges)), "imports": context.file_imports(self.nodes, self.edges).join(place, "path", "left_semi"),
            "siblings": pick(context.siblings(self.nodes)), "usages": pick(context.usages(self.nodes, self.edges, self._code())), "architecture": context.architecture(self.nodes, self.edges).join(place, "path", "left_semi"),
            "neighbours": pick(context.neighbour_modules(self.nodes, self.edges)), "debug_hints": pick(context.debug_hints(self.nodes, self.edges)),
        }

    def _note_hits(self, query: str, limit: int) -> DataFrame | None:
        if self.log is None:
            return None
        return self.memory_search(query, limit).select("id", "score").join(self._notes().select("id", "title", "content", "kind"), "id")

    def get_edit_context_sections(self, node=None, path=None, line=None, budget: int = 8000) -> dict[str, DataFrame]:
        """All sections of what to know before an edit: the source, callers and tests, notes on the file, its latest commits."""
        asked = self.at(node, path, line)
        row = self.nodes.where(F.col("node_id") == asked).select("name", "path").first()
        out = {"source": self._code().where(F.col("node_id") == asked), "callers_and_tests": self.get_edit_context(asked, budget=budget)}
        hits = self._note_hits(row["path"] or row["name"], 5)
        if hits is not None:
            out["memories"] = context.notes_within(hits, budget)
        if self.commits is not None and self.commit_files is not None and row["path"]:
            out["recent_changes"] = context.recent_changes(self.commits, self.commit_files, row["path"])
        return out

    def get_curated_memories(self, query: str, budget: int = 8000, most: int = 5) -> DataFrame | None:
        """Notes on the first three files of the best symbols, three of each."""
        if self.log is None:
            return None
        best = self.symbol_search(query, most).select("node_id", "score").join(self.nodes.select("node_id", "path"), "node_id").where("path <> ''")
        files = [r["path"] for r in best.groupBy("path").agg(F.max("score").alias("s")).orderBy(F.desc("s"), "path").limit(3).collect()]
        hits = None
        for path in files:
            part = self._note_hits(path, 3)
            hits = part if hits is None else hits.unionByName(part)
        return None if hits is None else context.notes_within(hits.groupBy("id", "title", "content", "kind").agg(F.max("score").alias("score")), budget)

    def get_curated_context(self, query: str, anchor=None, budget: int = 8000, most: int = 5, expand: str = "dependencies") -> DataFrame:
        ranked = self.symbol_search(query, 3 * most).select("node_id", "score")
        return context.curated_context(ranked, self.nodes, self.edges, self._code(), budget, most, anchor, expand)

    # Notes -----------------------------------------------------------------------------------------------------------------------

    def _notes(self) -> DataFrame:
        return notes.latest(self.log)

    def memory_store(self, note: DataFrame) -> Workspace:
        """Appends notes made by ``notes.make``."""
        version = 1 if self.log is None else (self.log.agg(F.max("version")).first()[0] or 0) + 1
        if self.log is None:
            self.log = note.withColumns({"version": F.lit(version).cast("bigint"), "deleted": F.lit(False)})
        else:
            self.log = notes.put(self.log, note, version)
        return self

    def memory_update(self, note: DataFrame) -> Workspace:
        return self.memory_store(note.withColumn("embedding", F.lit(None).cast("array<float>")))

    def memory_get(self, note: str) -> DataFrame:
        return notes.get(self.log, note)

    def memory_invalidate(self, note: str) -> Workspace:
        version = (self.log.agg(F.max("version")).first()[0] or 0) + 1
        self.log = notes.invalidate(self.log, self.spark.createDataFrame([(note,)], "id string"), F.current_timestamp(), version)
        return self

    def memory_search(self, query: str, limit: int = 10, kinds=None, tags=None, code=None, current_only: bool = True) -> DataFrame:
        return notes.search(self._notes(), query, self._vector(query), code, kinds, tags, limit, current_only)

    def memory_nearest(self, query: str, k: int = 10) -> DataFrame:
        """The notes whose vectors are most similar to a text's; notes without a vector of the embedder get one first."""
        asked = self._vector(query)
        return notes.nearest(notes.embedded(self._notes().where(notes.is_current()), self.embedder, len(asked)), asked, k)

    def memory_context(self, path: str, limit: int = 5, with_links: bool = False) -> DataFrame:
        return notes.context_of_file(self._notes(), self.nodes, path, limit, with_links)

    def memory_list(self, kinds=None, tags=None, limit: int = 50, offset: int = 0, current_only: bool = True) -> DataFrame:
        return notes.listed(self._notes(), kinds, tags, limit, offset, current_only)

    def memory_stats(self) -> dict[str, DataFrame]:
        return {"kinds": notes.by_kind(self._notes()), "tags": notes.tag_counts(self._notes())}

    # History -----------------------------------------------------------------------------------------------------------------------

    def _known(self) -> DataFrame:
        return self.spark.createDataFrame([], "hash string") if self.log is None else self.log.where("commit_hash IS NOT NULL").select(F.col("commit_hash").alias("hash"))

    def mine_git_history(self, most: int = 500, confidence: float = 0.7, enabled=None) -> DataFrame:
        return history.mine(self.commits, self.commit_files, self.nodes, self._known(), most, confidence, enabled)

    def mine_git_file(self, path: str, most: int = 100, confidence: float = 0.7) -> DataFrame:
        return history.mine(history.of_file(self.commits, self.commit_files, path), self.commit_files, self.nodes, self._known(), most, confidence)

    def search_git_history(self, query: str, since=None, limit: int = 10, least: float | None = 0.5, stages: int = 3) -> DataFrame:
        near = None
        if self.log is not None:
            near = self.memory_search(query, limit).join(self._notes().select("id", F.col("commit_hash").alias("hash")), "id").select("hash", "score")
        return history.search(self.commits, near, query, since, limit, least, stages)

    def hotspots(self, least: int = 10, limit: int = 20) -> DataFrame:
        return metrics.hotspots(self.commits, self.commit_files, least, limit)

    def cochange(self, least: float = 0.7, limit: int = 15) -> DataFrame:
        return metrics.cochange(self.commit_files, least, limit)

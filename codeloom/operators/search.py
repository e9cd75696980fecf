"""Text and attribute search: BM25 over an inverted index, hybrid ranking, imports, signatures, entry points."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import rules

# BM25 and ranking constants.
K1, B = 1.2, 0.75
NAME_WEIGHT, DOC_WEIGHT, COMMENT_WEIGHT = 3.0, 2.0, 1.0
BM25_SHARE, VECTOR_SHARE = 0.4, 0.6


def tokens(text: Column) -> Column:
    """Words of identifiers and prose: alphanumeric runs, cut before a capital behind a non-capital, in lower case, of two bytes or more."""
    cut = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<!\p{Lu})(?=\p{Lu})", "_")
    return F.filter(F.split(F.lower(cut), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: F.octet_length(w) >= 2)


def memory_tokens(text: Column) -> Column:
    """Words of notes: lower case, cut at anything not alphanumeric, of three bytes or more."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: F.octet_length(w) > 2)


def index_fields(nodes: DataFrame, comments: str | None = None) -> DataFrame:
    """(node_id, fields): tokens of name, documentation and, if ``comments`` names a string array, comments, with their weights."""
    fields = [(tokens(F.col("name")), NAME_WEIGHT), (tokens(F.col("doc")), DOC_WEIGHT)]
    if comments:
        fields.append((F.flatten(F.transform(F.coalesce(comments, F.array().cast("array<string>")), tokens)), COMMENT_WEIGHT))
    return nodes.select("node_id", F.array(*[F.struct(t.alias("tokens"), F.lit(w).alias("weight")) for t, w in fields]).alias("fields"))


def postings(fields: DataFrame) -> DataFrame:
    """(term, node_id, tf, weight): occurrences over all fields and the greatest weight of a field that has the term."""
    rows = fields.select("node_id", F.explode("fields").alias("f")).select("node_id", F.explode("f.tokens").alias("term"), F.col("f.weight").alias("weight"))
    return rows.groupBy("term", "node_id").agg(F.count("*").alias("tf"), F.max("weight").alias("weight"))


def doc_stats(fields: DataFrame) -> DataFrame:
    """(node_id, doc_len, reason): tokens of each document and where it has any."""
    sizes = [F.coalesce(F.size(F.try_element_at("fields", F.lit(k + 1))["tokens"]), F.lit(0)) for k in range(3)]
    has = [s > 0 for s in sizes]
    reason = F.when(has[0] & (has[1] | has[2]), "Multiple").when(has[1], "Docstring").when(has[2], "Comment").otherwise("SymbolName")
    return fields.select("node_id", sum(sizes[1:], sizes[0]).cast("bigint").alias("doc_len"), reason.alias("reason"))


def _idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def inverse_frequencies(posted: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf)."""
    size = stats.agg(F.count("*").alias("n"))
    return posted.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size)).select("term", "df", _idf(F.col("n"), F.col("df")).alias("idf"))


def bm25(posted: DataFrame, stats: DataFrame, query: str, limit: int | None = 20, words=tokens, empty_average: float = 1.0) -> DataFrame:
    """(node_id, score): documents by the sum over query words, repeated words counting again; ties by id. No ``limit``: all.

    The query's words, a handful, are broadcast; only their postings are shuffled.
    """
    spark = posted.sparkSession
    asked = spark.range(1).select(F.explode(words(F.lit(query))).alias("term")).groupBy("term").agg(F.count("*").alias("asked"))
    hits = posted.join(F.broadcast(asked), "term")
    corpus = stats.agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_len") / F.count("*"), F.lit(empty_average)).alias("average"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "term").join(stats.select("node_id", "doc_len"), "node_id").crossJoin(F.broadcast(corpus))
    tf = F.col("tf")
    part = _idf(F.col("n"), F.col("df")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_len") / F.col("average"))) * F.col("weight") * F.col("asked")
    found = scored.groupBy("node_id").agg(F.sum(part).alias("score"))
    return found.orderBy(F.desc("score"), "node_id").limit(limit) if limit else found


def save_index(posted: DataFrame, stats: DataFrame, folder: str, buckets: int = 64) -> None:
    """Writes an inverted index: postings by bucket of their term, with the document's length and the term's document frequency in the row, so a query reads the
    buckets of its words only and joins nothing; and the statistics of documents and corpus. A term's frequency is joined by term, of which each is one row."""
    sized = posted.join(stats.select("node_id", "doc_len"), "node_id").join(posted.groupBy("term").agg(F.count("*").alias("df")), "term")
    sized.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    stats.write.mode("overwrite").parquet(f"{folder}/documents")
    stats.agg(F.count("*").alias("n"), (F.sum("doc_len") / F.count("*")).alias("average")).withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{folder}/corpus")


def open_index(spark: SparkSession, folder: str) -> tuple[DataFrame, Row]:
    """An index that ``save_index`` wrote: its postings and the figures of its corpus, read once for many searches."""
    return spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/corpus").first()


def search_index(index: tuple[DataFrame, Row], query: str, limit: int | None = 20, words=tokens) -> DataFrame:
    """(node_id, score): ``bm25`` over an opened index. Only the buckets of the query's words are read."""
    posted, corpus = index
    term = F.explode(words(F.lit(query))).alias("term")
    found = posted.sparkSession.range(1).select(term).select("term", F.pmod(F.xxhash64("term"), F.lit(corpus["buckets"])).cast("int").alias("bucket")).collect()
    asked = Counter(r["term"] for r in found)
    if not asked or not corpus["n"]:
        return posted.limit(0).select("node_id", F.lit(0.0).alias("score"))
    hits = posted.where(F.col("bucket").isin(sorted({r["bucket"] for r in found})) & F.col("term").isin(list(asked)))
    times = F.create_map(*[x for t, k in asked.items() for x in (F.lit(t), F.lit(k))])[F.col("term")]
    tf = F.col("tf")
    part = _idf(F.lit(corpus["n"]), F.col("df")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_len") / F.lit(corpus["average"]))) * F.col("weight") * times
    found = hits.groupBy("node_id").agg(F.sum(part).alias("score"))
    return found.orderBy(F.desc("score"), "node_id").limit(limit) if limit else found


def has_term(posted: DataFrame, term: str) -> bool:
    return not posted.where(F.col("term") == term).isEmpty()


def index_stats(posted: DataFrame, stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("documents")).crossJoin(posted.agg(F.count_distinct("term").alias("terms")))


def by_name(nodes: DataFrame, part: str) -> DataFrame:
    return nodes.where(F.lower("name").contains(part.lower()))


def symbol_search(nodes: DataFrame, posted: DataFrame, stats: DataFrame, query: str, similar: DataFrame | None = None, limit: int = 20, types: list[str] | None = None, include_private: bool = True) -> DataFrame:
    """(node_id, name, score, reason, total_matches): words and vectors together; total_matches counts what there is before ``limit``.

    Candidates are the best ``limit`` times 2 (10 with a type filter) of either ranking; ``similar`` is (node_id, cosine), cosine over 0.1.
    Filters apply to candidates, so fewer than ``limit`` may come out.
    """
    many = limit * (10 if types else 2)
    words = bm25(posted, stats, query, many).withColumnRenamed("score", "bm25")
    if similar is not None:
        near = similar.where("cosine > 0.1").orderBy(F.desc("cosine"), "node_id").limit(many)
        both = words.join(near, "node_id", "full_outer")
    else:
        both = words.withColumn("cosine", F.lit(None).cast("double"))
    top = both.agg(F.max("bm25").alias("top"))
    kinds = [k for k in (rules.symbol_kind(t) for t in types or []) if k]
    kept = nodes.where("name IS NOT NULL")
    if types:
        kept = kept.where(F.col("node_type").isin(kinds))
    if not include_private:
        kept = kept.where("is_public")
    norm = F.coalesce("bm25", F.lit(0.0)) / F.greatest(F.coalesce("top", F.lit(0.0)), F.lit(0.001))
    cosine = F.coalesce("cosine", F.lit(0.0))
    score = norm * BM25_SHARE + cosine * VECTOR_SHARE if similar is not None else norm
    reason = F.when(F.col("bm25").isNull() | ((cosine > 0.3) & (norm < 0.01)), "Semantic").otherwise(F.col("reason"))
    joined = both.crossJoin(F.broadcast(top)).join(stats.select("node_id", "reason"), "node_id").join(kept.select("node_id", "name"), "node_id")
    found = joined.select("node_id", "name", score.alias("score"), reason.alias("reason"))
    # A bounded number of candidates, so one window holds them all.
    return found.withColumn("total_matches", F.count("*").over(Window.partitionBy())).orderBy(F.desc("score"), "node_id").limit(limit)


def cross_project(nodes: DataFrame, part: str, current: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    found = nodes.where((F.col("project") != current) & (F.col("node_type") != "CodeFile") & F.lower("name").contains(part.lower()))
    if kind:
        found = found.where(F.col("node_type") == rules.symbol_kind(kind))
    return found.select("project", "node_id", "name", "node_type", "path", "signature", "route", "http_method").orderBy("project", "name", "node_id").limit(limit)


def workspace_symbols(nodes: DataFrame, query: str | None) -> DataFrame:
    """None: the first 100 functions, classes and modules; empty: modules; else a part of the name."""
    if query is None:
        return nodes.where("node_type IN ('Function', 'Class', 'Module')").orderBy("node_id").limit(100)
    return nodes.where("node_type = 'Module'") if query == "" else by_name(nodes, query)


def by_imports(modules: DataFrame, libraries: list[str], mode: str = "fuzzy", limit: int | None = 50) -> DataFrame:
    """(node_id, reason): importers of modules whose name is, begins with or contains (whatever the case) a library's."""
    name = F.col("module")
    tests = {"exact": lambda lib: name == lib, "prefix": lambda lib: name.startswith(lib), "fuzzy": lambda lib: F.lower(name).contains(lib.lower())}[mode]
    hit = None
    for lib in libraries:
        hit = tests(lib) if hit is None else hit | tests(lib)
    found = modules.where(hit).groupBy("node_id").agg(F.concat(F.lit("imports "), F.min("module")).alias("reason"))
    return found.orderBy("node_id").limit(limit) if limit else found


def by_signature(nodes: DataFrame, name: str | None = None, returns: str | None = None, params: tuple[int, int] | None = None, modifiers: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Functions for which all given conditions hold, with the reasons."""
    found, reasons = nodes.where("node_type = 'Function' AND name IS NOT NULL"), []
    if name:
        found = found.where(F.col("name").rlike(rules.anchored_pattern(name)))
        reasons.append(f"name matches '{name}'")
    if returns:
        actual = F.coalesce("return_type", rules.return_type_of(F.col("signature")))
        found = found.where(rules.type_matches(actual, returns))
        reasons.append(f"returns {returns}")
    if params:
        count = F.coalesce("param_count", rules.params_of(F.col("signature")))
        found = found.where(count.between(*params))
        reasons.append(f"{params[0]}-{params[1]} params")
    if modifiers:
        found = found.where(rules.modifiers_hold(modifiers, {c: F.col(c) for c in ("visibility", "is_public", "is_async", "is_static", "is_const")}))
        reasons.append("modifiers: " + ", ".join(modifiers))
    out = found.select("node_id", "name", F.lit("; ".join(reasons)).alias("reason"))
    return out.orderBy("node_id").limit(limit) if limit else out


def entry_points(nodes: DataFrame, types: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(node_id, name, entry): functions that are entered from outside, by kind."""
    kind = rules.entry_type(*[F.col(c) for c in ("name", "path", "route", "http_method", "is_test", "is_cli", "is_public")])
    found = nodes.where("node_type = 'Function' AND name IS NOT NULL").select("node_id", "name", kind.alias("entry")).where("entry IS NOT NULL")
    if types:
        found = found.where(F.col("entry").isin(types))
    return found.orderBy("node_id").limit(limit) if limit else found


def related_tests(nodes: DataFrame, edges: DataFrame, target: int, limit: int = 10) -> DataFrame:
    """(node_id, relation): tests that call the target within three steps, then those in its file, then those in the files where its
    tests belong; each once."""
    from codeloom.operators.graph import links, reach

    spark = nodes.sparkSession
    tests = entry_points(nodes, ["test_entry"]).select("node_id")
    calling = reach(links(edges, ["Calls"], "incoming"), spark.createDataFrame([(target,)], "start bigint"), 3).select(F.col("node").alias("node_id")).join(tests, "node_id", "left_semi").orderBy("node_id").limit(2 * limit)
    home = nodes.where(F.col("node_id") == target).select("path", rules.test_paths(F.col("path")).alias("places"))
    placed = nodes.select("node_id", "path").join(tests, "node_id", "left_semi")
    same = placed.join(F.broadcast(home.select("path")), "path").select("node_id")
    beside = placed.join(F.broadcast(home.select(F.explode("places").alias("path")).distinct()), "path").select("node_id")
    ranked = calling.withColumn("k", F.lit(0)).unionByName(same.withColumn("k", F.lit(1))).unionByName(beside.withColumn("k", F.lit(2)))
    names = F.element_at(F.array(F.lit("calls_target"), F.lit("same_file"), F.lit("adjacent_file")), F.col("k") + 1)
    first = ranked.where(F.col("node_id") != target).groupBy("node_id").agg(F.min("k").alias("k"))
    return first.orderBy("k", "node_id").limit(limit).select("node_id", names.alias("relation"))


def routes(nodes: DataFrame) -> DataFrame:
    """(node_id, name, route, http_method): functions with a route decorator; the first that matches counts."""
    all_ = F.transform("attributes", rules.route_of_decorator)
    first = F.try_element_at(F.filter(all_, lambda r: r.isNotNull()), F.lit(1))
    return nodes.where("node_type = 'Function'").select("node_id", "name", first.alias("r")).where("r IS NOT NULL").select("node_id", "name", "r.route", "r.http_method")


def http_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, callee, position): what each function calls: unresolved names in their order, then the targets of its calls by edge_id."""
    functions = nodes.where("node_type = 'Function'")
    open_ = functions.select("node_id", F.posexplode("unresolved_calls").alias("position", "callee")).select("node_id", "callee", F.struct(F.lit(0).alias("late"), F.col("position").cast("bigint").alias("at")).alias("position"))
    names = nodes.select(F.col("node_id").alias("dst"), F.col("name").alias("callee")).where("callee IS NOT NULL")
    made = edges.where("edge_type = 'Calls'").join(names, "dst").select(F.col("src").alias("node_id"), "callee", F.struct(F.lit(1).alias("late"), F.col("edge_id").alias("at")).alias("position"))
    return open_.unionByName(made.join(functions.select("node_id"), "node_id", "left_semi"))


def http_clients(calls: DataFrame) -> DataFrame:
    """(node_id, method): of (node_id, callee, position) the nodes that call over HTTP: whose callee is, or ends with, a client function's name, whatever
    stands before. Of several methods that of the last ``position``; without such a column, and at equal ones, the greatest name."""
    hit = None
    for name in rules.HTTP_CLIENTS:
        one = F.col("callee").endswith(name)
        hit = one if hit is None else hit | one
    order = F.struct("position", "callee") if "position" in calls.columns else F.struct("callee")
    return calls.where(hit).groupBy("node_id").agg(F.max_by(rules.method_of_client(F.col("callee")), order).alias("method"))


def runtime_calls(clients: DataFrame, served: DataFrame) -> DataFrame:
    """(src, dst, matched_route, match_type): of (node_id, url) and routes: the same normal route, else one that matches with placeholders.

    Patterns are compared with addresses of as many segments and the same first literal segment or none, an equi-join, never all with all.
    """
    asked = clients.select(F.col("node_id").alias("src"), rules.normal_route(F.col("url")).alias("url")).distinct()
    given = served.select(F.col("node_id").alias("dst"), rules.normal_route(F.col("route")).alias("route"))
    exact = asked.join(given, asked.url == given.route).select("src", "dst", F.col("route").alias("matched_route"), F.lit("exact").alias("match_type"), "url")
    rest = asked.join(exact.select("src", "url").distinct(), ["src", "url"], "left_anti")

    def head(route: Column) -> Column:
        return F.coalesce(F.try_element_at(F.split(route, "/"), F.lit(2)), F.lit(""))

    holder = head(F.col("route")).rlike(r"^\{.*\}$|^:|^<.*>$")
    keyed = given.where(F.col("route").rlike(r"\{|/:|<")).withColumn("size", F.size(F.split("route", "/"))).withColumn("head", F.when(holder, "\0any").otherwise(head(F.col("route"))))
    probes = rest.withColumn("size", F.size(F.split("url", "/"))).withColumn("head", F.explode(F.array(head(F.col("url")), F.lit("\0any"))))
    by_pattern = probes.join(keyed, ["size", "head"]).where(rules.route_matches(F.col("route"), F.col("url")))
    return exact.drop("url").unionByName(by_pattern.select("src", "dst", F.col("route").alias("matched_route"), F.lit("pattern").alias("match_type")))


def symbol_map(nodes: DataFrame) -> DataFrame:
    """(name, target): what a bare name means: an interface over a class over a function; among functions the weightiest, then the lowest id."""
    rank = F.when(F.col("node_type") == "Interface", 3).when(F.col("node_type") == "Class", 2).otherwise(1)
    weight = F.when(F.col("node_type") == "Function", rules.symbol_weight(F.col("complexity"), F.col("line_start"), F.col("line_end"))).otherwise(0)
    w = Window.partitionBy("name").orderBy(rank.desc(), weight.desc(), F.when(F.col("node_type") == "Function", F.col("node_id")).otherwise(-F.col("node_id")))
    named = nodes.where("node_type IN ('Function', 'Class', 'Interface') AND name <> ''")
    return named.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("name", F.col("node_id").alias("target"))


def resolve(nodes: DataFrame, edges: DataFrame, wanted: DataFrame, edge_type: str | None = None) -> DataFrame:
    """(src, dst, edge_type): edges for (node_id, name, edge_type) that bare names lead to, without loops and those that exist. With ``edge_type`` all
    edges are of that type. Names are looked up together, by a join whose right side has one row for each name."""
    if edge_type is not None:
        wanted = wanted.select("node_id", "name", F.lit(edge_type).alias("edge_type"))
    found = wanted.distinct().join(symbol_map(nodes), "name").where("node_id <> target").select(F.col("node_id").alias("src"), F.col("target").alias("dst"), "edge_type").distinct()
    return found.join(edges.select("src", "dst", "edge_type"), ["src", "dst", "edge_type"], "left_anti")

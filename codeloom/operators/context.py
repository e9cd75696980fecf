"""Context for a symbol or a question, within a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.rules import call_site, layer, tokens_estimate, usage_description


def within(ranked: DataFrame, group: str, budget: int, *order: str) -> DataFrame:
    """Rows (tokens) of each group until the budget is exceeded: a row is kept if those before it leave any of it."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranked.withColumn("_before", F.coalesce(F.sum("tokens").over(w), F.lit(0))).where(F.col("_before") < budget).drop("_before")


def fitting(ranked: DataFrame, group: str, budget: int, order: list[str]) -> DataFrame:
    """Rows (tokens) of each group that fit into what those taken before left; one that doesn't is skipped, and smaller ones behind it may still fit.

    Each step depends on the one before, so a group is folded in order, inside the JVM. What is kept is bounded by the budget, but for items without tokens;
    candidates of a group are those of one symbol.
    """
    columns = [c for c in ranked.columns if c not in order]
    row = F.struct(*order, *columns)
    lists = ranked.groupBy(group).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    kind = lists.schema["_rows"].dataType.simpleString()
    start = F.struct(F.lit(budget).cast("bigint").alias("left"), F.array().cast(kind).alias("kept"))

    def take(state: Column, x: Column) -> Column:
        size = x["tokens"].cast("bigint")
        more = F.struct((state["left"] - size).alias("left"), F.concat(state["kept"], F.array(x)).alias("kept"))
        return F.when(size <= state["left"], more).otherwise(state)

    kept = F.aggregate("_rows", start, take)["kept"]
    return lists.select(F.explode(kept).alias("_r")).select(*[F.col("_r")[c].alias(c) for c in ranked.columns])


def bodies(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(node_id, code): the lines of each symbol; none if they lie outside the file or start at 0. ``files`` is (path, project, code)."""
    lines = files.select("project", "path", F.split("code", "\n").alias("lines")).where("lines IS NOT NULL")
    spans = nodes.where("line_start > 0 AND path IS NOT NULL").select("node_id", "project", "path", "line_start", "line_end")
    inside = spans.join(lines, ["project", "path"]).where("line_end <= size(lines) AND line_end >= line_start")
    return inside.select("node_id", F.array_join(F.slice("lines", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n").alias("code"))


def related(nodes: DataFrame, edges: DataFrame, code: DataFrame, intent: str = "explain", strict: bool = False) -> DataFrame:
    """(node_id, other, relation, relevance, position, code): what matters around every symbol for an intent, best first.

    explain: what it uses, its callers, subclasses; modify: tests among its first callers, then, unless ``strict``, the other callers; debug: the chain of first callers
    up to five, then what it calls; test: tests among callers, then what to replace.
    """
    calls = edges.where("edge_type = 'Calls'").select("src", "dst").distinct()
    test = nodes.where(F.col("name").startswith("test_") | F.col("name").endswith("_test") | F.col("path").contains("/test")).select(F.col("node_id").alias("other"), F.lit(True).alias("is_test"))

    def first(pairs: DataFrame, n: int | None) -> DataFrame:
        w = Window.partitionBy("node_id").orderBy("other")
        placed = pairs.withColumn("position", F.row_number().over(w))
        return placed if n is None else placed.where(F.col("position") <= n)

    out_ = calls.select(F.col("src").alias("node_id"), F.col("dst").alias("other"))
    in_ = calls.select(F.col("dst").alias("node_id"), F.col("src").alias("other"))

    def as_(pairs: DataFrame, relation: str, relevance: float) -> DataFrame:
        return pairs.select("node_id", "other", F.lit(relation).alias("relation"), F.lit(relevance).alias("relevance"), "position")

    if intent == "explain":
        extends = edges.where("edge_type = 'Extends'").select(F.col("dst").alias("node_id"), F.col("src").alias("other")).distinct()
        parts = [as_(first(out_, 5), "uses", 1.0), as_(first(in_, 3), "called_by", 0.8), as_(first(extends, None), "extended_by", 0.9)]
    elif intent == "modify":
        five = first(in_, 5).join(test, "other", "left")
        parts = [as_(five.where("is_test"), "test", 1.0)]
        if not strict:
            parts.append(as_(five.where("is_test IS NULL"), "called_by", 0.9))
    elif intent == "debug":
        one = in_.groupBy("node_id").agg(F.min("other").alias("other"))
        chain, step = None, one.select("node_id", "other", F.array("node_id", "other").alias("seen"))
        for k in range(1, 6):
            part = step.select("node_id", "other", F.lit("call_chain").alias("relation"), F.round(F.lit(1 - 0.1 * k), 6).alias("relevance"), F.lit(k).alias("position"))
            chain = part if chain is None else chain.unionByName(part)
            more = step.select("node_id", F.col("other").alias("at"), "seen").join(in_.select(F.col("node_id").alias("at"), "other"), "at").where(~F.array_contains("seen", F.col("other")))
            step = more.groupBy("node_id", "seen").agg(F.min("other").alias("other")).select("node_id", "other", F.concat("seen", F.array("other")).alias("seen"))
        parts = [chain, as_(first(out_, 3), "data_flow", 0.8)]
    else:
        three = first(in_, 3).join(test, "other")
        parts = [as_(three, "test", 0.9), as_(first(out_, 3), "dependency_to_mock", 0.7)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.join(code.select(F.col("node_id").alias("other"), "code"), "other", "left").select("node_id", "other", "relation", "relevance", "position", "code")


def ai_context(nodes: DataFrame, edges: DataFrame, code: DataFrame, intent: str = "explain", budget: int = 4000) -> DataFrame:
    """(node_id, other, relation, relevance, position, tokens): the related symbols of every function that fit the budget, best first."""
    found = related(nodes, edges, code, intent).withColumn("tokens", F.coalesce(tokens_estimate(F.col("code")), F.lit(0)).cast("bigint")).drop("code")
    found = found.withColumn("_o", -F.col("relevance"))
    return fitting(found, "node_id", budget, ["_o", "relation", "position", "other"]).drop("_o")


def edit_context(nodes: DataFrame, edges: DataFrame, code: DataFrame, budget: int = 8000) -> DataFrame:
    """(node_id, other, section, relation, position, tokens): for every function up to ten callers within a quarter of the budget, and up to five tests within a
    fifth: of the first twenty test entries those that lead to it within three calls, then tests of its file, whose code is left out. Each section stops once it is over."""
    from codeloom.functions.rules import entry_type, is_test_node
    from codeloom.operators.graph import callers, links, reach

    functions = nodes.where("node_type = 'Function' AND name IS NOT NULL")
    sizes = code.select(F.col("node_id").alias("other"), tokens_estimate(F.col("code")).cast("bigint").alias("size"))
    asked = functions.select(F.col("node_id").alias("start"))
    calling = callers(nodes, edges, asked).select(F.col("start").alias("node_id"), F.col("node").alias("other")).distinct().select("node_id", "other", F.lit("callers").alias("section"), F.lit("caller").alias("relation"))
    kind = entry_type(*[F.col(c) for c in ("name", "path", "route", "http_method", "is_test", "is_cli", "is_public")])
    entries = functions.where(kind == "test_entry").select(F.col("node_id").alias("start")).orderBy("start").limit(20)
    leading = reach(links(edges, ["Calls"]), entries, 3).select(F.col("node").alias("node_id"), F.col("start").alias("other")).where("node_id <> other").join(asked.withColumnRenamed("start", "node_id"), "node_id", "left_semi")
    leading = leading.select("node_id", "other", F.lit("tests").alias("section"), F.lit("calls_target").alias("relation"))
    # Five of them are shown at most, and five more and the function itself may be passed over: the first eleven of a file are enough.
    of_file = Window.partitionBy("path").orderBy("other")
    tests = functions.where(is_test_node(F.col("name"), F.col("path"), F.col("is_test"))).select("path", F.col("node_id").alias("other")).withColumn("_n", F.row_number().over(of_file)).where("_n <= 11").drop("_n")
    beside = functions.select("node_id", "path").join(tests, "path").where("node_id <> other").select("node_id", "other", F.lit("tests").alias("section"), F.lit("same_file").alias("relation"))
    beside = beside.join(leading, ["node_id", "other"], "left_anti")
    out = None
    for part, most, share in ((calling, 10, 0.25), (leading.unionByName(beside), 5, 0.2)):
        w = Window.partitionBy("node_id").orderBy("relation", "other")
        placed = part.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most).join(sizes, "other", "left")
        sized = placed.select("node_id", "other", "section", "relation", "position", F.when(F.col("relation") == "same_file", 0).otherwise(F.coalesce("size", F.lit(0))).cast("bigint").alias("tokens"))
        kept = within(sized, "node_id", int(budget * share), "position")
        out = kept if out is None else out.unionByName(kept)
    return out


def notes_within(hits: DataFrame, budget: int, share: float = 0.15) -> DataFrame:
    """(id, title, content, kind, score, position, tokens): of search hits (id, title, content, kind, score), a bounded number, the first of each title, until a share
    of the budget is exceeded."""
    by_title = Window.partitionBy("title").orderBy(F.desc("score"), "id")
    first = hits.withColumn("_n", F.row_number().over(by_title)).where("_n = 1 OR title IS NULL").withColumn("_g", F.lit(1))
    placed = first.withColumn("position", F.row_number().over(Window.partitionBy("_g").orderBy(F.desc("score"), "id")))
    sized = placed.withColumn("tokens", F.coalesce(tokens_estimate(F.col("content")), F.lit(0)).cast("bigint"))
    return within(sized, "_g", int(budget * share), "position").select("id", "title", "content", "kind", "score", "position", "tokens")


def recent_changes(commits: DataFrame, commit_files: DataFrame, path: str, most: int = 5) -> DataFrame:
    """(hash, subject, author_name, author_date): the latest commits of a file."""
    mine = commit_files.where(F.col("path") == path).select("hash").distinct()
    return commits.join(mine, "hash", "left_semi").orderBy(F.desc("author_date"), "hash").limit(most).select(F.substring("hash", 1, 8).alias("hash"), "subject", "author_name", "author_date")


def dependencies(nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(node_id, other, name): the first ``most`` imports of each node; of these, those with a name."""
    w = Window.partitionBy("src").orderBy("edge_id")
    some = edges.where("edge_type = 'Imports'").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return some.select(F.col("src").alias("node_id"), F.col("dst").alias("other")).join(nodes.select(F.col("node_id").alias("other"), "name"), "other").where("name <> ''").select("node_id", "other", "name")


def file_imports(nodes: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """(path, name, position): the names that any symbol of a file imports, in the order of edges, each target once."""
    at = nodes.where("path IS NOT NULL").select(F.col("node_id").alias("src"), "path")
    targets = edges.where("edge_type = 'Imports'").join(at, "src").groupBy("path", "dst").agg(F.min("edge_id").alias("edge_id"))
    named = targets.join(nodes.select(F.col("node_id").alias("dst"), "name"), "dst").where("name <> ''")
    return named.withColumn("position", F.row_number().over(Window.partitionBy("path").orderBy("edge_id", "dst"))).where(F.col("position") <= most).select("path", "name", "position")


def siblings(nodes: DataFrame, most: int = 10) -> DataFrame:
    """(node_id, other, name, signature, visibility, line_start): for each function the first others of its file, by line. The first ``most`` + 1 of a file are enough."""
    functions = nodes.where("node_type = 'Function' AND name <> '' AND path IS NOT NULL")
    first = functions.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("line_start", "node_id"))).where(F.col("_n") <= most + 1)
    shown = first.select("path", "_n", F.col("node_id").alias("other"), "name", F.coalesce("signature", "name").alias("signature"), F.coalesce("visibility", F.when(F.col("is_public"), "public").otherwise("private")).alias("visibility"), "line_start")
    pairs = functions.select("node_id", "path").join(shown, "path").where("node_id <> other")
    place = F.row_number().over(Window.partitionBy("node_id").orderBy("_n"))
    return pairs.withColumn("_k", place).where(F.col("_k") <= most).select("node_id", "other", "name", "signature", "visibility", "line_start")


#: Parts of names that speak of failure.
_FAILURES = "error|err|panic|throw|fail|exception"


def debug_hints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, complexity, branches, exception_handlers, early_returns, nesting_depth, error_paths): for each function what to look at: how tangled it is,
    and the names it calls that speak of failure."""
    from codeloom.operators.metrics import function_complexity

    failing = nodes.where(F.lower("name").rlike(_FAILURES)).select(F.col("node_id").alias("dst"), "name")
    paths = edges.where("edge_type = 'Calls'").join(failing, "dst").groupBy(F.col("src").alias("node_id")).agg(F.array_sort(F.collect_set("name")).alias("error_paths"))
    shape = function_complexity(nodes).select("node_id", "complexity", "branches", F.col("exceptions").alias("exception_handlers"), "early_returns", F.col("nesting").alias("nesting_depth"))
    return shape.join(paths, "node_id", "left").withColumn("error_paths", F.coalesce("error_paths", F.array().cast("array<string>")))


def neighbour_modules(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, module, relationship): the other modules (file stems) a symbol has edges with, and of which kinds."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    at = nodes.where("path <> ''").select("node_id", stem.alias("module"))
    kind = F.lower("edge_type")
    out_ = F.when(kind == "calls", "calls").when(kind == "imports", "imports").otherwise("depends_on")
    in_ = F.when(kind == "calls", "called_by").when(kind == "imports", "imported_by").otherwise("depended_on_by")
    both = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("other"), out_.alias("r")).unionByName(edges.select(F.col("dst").alias("node_id"), F.col("src").alias("other"), in_.alias("r"))).distinct()
    ends = both.join(at.withColumnRenamed("module", "own"), "node_id").join(at.withColumnRenamed("node_id", "other"), "other").where("module <> own")
    return ends.groupBy("node_id", "module").agg(F.array_join(F.array_sort(F.collect_set("r")), ", ").alias("relationship"))


def curated_context(ranked: DataFrame, nodes: DataFrame, edges: DataFrame, code: DataFrame, budget: int = 8000, most: int = 5, anchor: str | None = None, expand: str = "dependencies") -> DataFrame:
    """(section, node_id, of, tokens): for search results (node_id, score): symbols within 40 % of the budget, those of the anchor's file first, then at most one
    new dependency, or three callers, of each within 25 %."""
    at = nodes.select("node_id", "path")
    own = F.coalesce(F.col("path") == F.lit(anchor), F.lit(False)) if anchor else F.lit(False)
    sized = ranked.join(at, "node_id").join(code.select("node_id", tokens_estimate(F.col("code")).cast("bigint").alias("tokens")), "node_id").select("node_id", "score", own.alias("own"), "tokens", F.lit(1).alias("g"))
    top = sized.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("own"), F.desc("score"), "node_id"))).where(F.col("position") <= most)
    symbols = within(top, "g", int(budget * 0.4), "position")
    if expand == "callers":
        ends, per = edges.where("edge_type = 'Calls'").select(F.col("dst").alias("of"), F.col("src").alias("node_id"), "edge_id"), 3
    else:
        ends, per = edges.where("edge_type IN ('Imports', 'Calls')").select(F.col("src").alias("of"), F.col("dst").alias("node_id"), "edge_id"), 1
    near = ends.join(symbols.select(F.col("node_id").alias("of"), F.col("position").alias("rank")), "of").join(symbols.select("node_id"), "node_id", "left_anti")
    five = near.withColumn("_n", F.row_number().over(Window.partitionBy("of").orderBy("edge_id"))).where("_n <= 5")
    new = five.withColumn("_f", F.row_number().over(Window.partitionBy("node_id").orderBy("rank", "_n"))).where("_f = 1")
    some = new.withColumn("_k", F.row_number().over(Window.partitionBy("of").orderBy("_n"))).where(F.col("_k") <= per)
    deps = some.join(code.select("node_id", tokens_estimate(F.col("code")).cast("bigint").alias("tokens")), "node_id").where(F.col("tokens") <= budget // 3).withColumn("g", F.lit(1))
    deps = within(deps, "g", int(budget * 0.25), "rank", "_n")
    return symbols.select(F.lit("symbol").alias("section"), "node_id", F.lit(None).cast("bigint").alias("of"), "tokens").unionByName(deps.select(F.lit("caller" if expand == "callers" else "dependency").alias("section"), "node_id", "of", "tokens"))


def usages(nodes: DataFrame, edges: DataFrame, code: DataFrame, most: int = 3) -> DataFrame:
    """(node_id, caller, example, description): how callers use each function, cut to the place of the call."""
    calls = edges.where("edge_type = 'Calls'").select(F.col("dst").alias("node_id"), F.col("src").alias("caller")).distinct()
    w = Window.partitionBy("node_id").orderBy("caller")
    some = calls.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    named = some.join(nodes.select("node_id", F.col("name").alias("target")), "node_id").join(nodes.select(F.col("node_id").alias("caller"), F.col("name").alias("caller_name")), "caller")
    shown = named.join(code.select(F.col("node_id").alias("caller"), "code"), "caller")
    return shown.select("node_id", "caller", call_site(F.col("code"), F.col("target")).alias("example"), usage_description(F.col("caller_name"), F.col("target"), F.col("code")).alias("description"))


def architecture(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, layer, imports, imported_by): where each file stands."""
    files = nodes.where("node_type = 'CodeFile' AND path IS NOT NULL").select("node_id", "path")
    links = edges.where("edge_type IN ('Imports', 'ImportsFrom')").select("src", "dst").distinct()
    going = links.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("imports"))
    coming = links.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("imported_by"))
    return files.join(going, "node_id", "left").join(coming, "node_id", "left").na.fill(0, ["imports", "imported_by"]).select("path", layer(F.col("path")).alias("layer"), "imports", "imported_by")

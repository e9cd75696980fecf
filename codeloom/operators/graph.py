"""Traversal and reachability over (nodes, edges). Loops run over depth only; every hop is one join with the frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.operators.skew import KEY_ROWS, join_counted, join_spread, spread
from codeloom.session import Scratch


def links(edges: DataFrame, types: list[str] | None = None, direction: str = "outgoing") -> DataFrame:
    """(at, to): distinct steps along edges of ``types`` (all if None, whatever the case), forward, backward or both ways."""
    if types:
        edges = edges.where(F.lower("edge_type").isin([t.lower() for t in types]))
    ahead = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"))
    both = {"outgoing": ahead, "incoming": back, "both": ahead.unionByName(back)}[direction]
    return both.distinct()


def reach(steps: DataFrame, starts: DataFrame, depth: int, scratch: Scratch | None = None) -> DataFrame:
    """(start, node, depth): every node within ``depth`` steps of each start, at its least depth.

    A start appears itself only through a cycle. ``starts`` is (start). All starts advance together: a hop joins the frontier with
    the steps and drops pairs found before. Beyond two hops, or with a ``scratch``, the steps and each hop are written: lineage ends there, so the plan
    stays that of one hop whatever the depth, and the steps of hubs are cut into parts that several tasks join.
    """
    hot = None
    if depth > 2 and scratch is None:
        scratch = Scratch(steps.sparkSession, "reach")
    if scratch is not None:
        steps, seen = scratch.cut_counted(steps, F.count("*").alias("rows"))
        if seen["rows"] > KEY_ROWS:  # else no node has more steps than a task may join
            steps, hot = (scratch.cut(df) for df in spread(steps, "at"))
    frontier = starts.select("start", F.col("start").alias("at")).distinct()
    found = None
    for hop in range(1, depth + 1):
        met = join_spread(frontier, steps, hot, "at") if hot is not None else frontier.join(steps, "at")
        new = met.select("start", F.col("to").alias("node")).distinct()
        if found is not None:
            new = new.join(found.select("start", "node"), ["start", "node"], "left_anti")
        new = new.withColumn("depth", F.lit(hop))
        if scratch is not None:
            new = scratch.cut(new)
        found = new if found is None else found.unionByName(new)
        frontier = new.select("start", F.col("node").alias("at"))
    return found


def call_chain(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 3, direction: str = "outgoing") -> DataFrame:
    """(start, node, depth): what each start calls (``direction`` incoming: what calls it), directly or not. Nodes without a name are passed through but not given."""
    named = nodes.where("name IS NOT NULL").select(F.col("node_id").alias("node"))
    return reach(links(edges, ["Calls"], direction), starts, depth).join(named, "node", "left_semi").select("start", "node", "depth")


def call_adjacency(edges: DataFrame) -> DataFrame:
    """(node_id, callers, callees): how many distinct functions call each node and are called by it, for all with calls."""
    calls = edges.where("edge_type = 'Calls'").select("src", "dst").distinct()
    ends = calls.select(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(calls.select(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.groupBy("node_id").agg(F.sum("i").cast("bigint").alias("callers"), F.sum("o").cast("bigint").alias("callees"))


def import_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, node_id): the nodes that import each module name; empty names are left out."""
    targets = nodes.select(F.col("node_id").alias("dst"), F.col("name").alias("module")).where("module <> ''")
    return edges.where("edge_type = 'Imports'").select("src", "dst").join(targets, "dst").select("module", F.col("src").alias("node_id")).distinct()


def callers(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 1, direction: str = "incoming") -> DataFrame:
    """(start, node, depth, via): callers (or callees, ``direction`` outgoing) of each start.

    A start without any is answered by the other functions of the same name: ``via`` is the node actually asked. Nodes without a name
    are passed through but not given.
    """
    steps = links(edges, ["Calls"], direction)
    named = nodes.where("name IS NOT NULL").select(F.col("node_id").alias("node"))
    own = reach(steps, starts, depth).join(named, "node", "left_semi").select("start", "node", "depth", F.col("start").alias("via"))
    lone = starts.select("start").join(own.select("start").distinct(), "start", "left_anti")
    functions = nodes.where("node_type = 'Function' AND name IS NOT NULL").select("node_id", "name")
    asked = lone.join(functions, lone.start == functions.node_id).select("start", "name")
    twins = asked.join(functions, "name").where("node_id <> start").select("start", F.col("node_id").alias("via"))
    # Only twins with calls of their own can answer.
    twins = twins.join(steps.select(F.col("at").alias("via")).distinct(), "via", "left_semi")
    found = reach(steps, twins.select(F.col("via").alias("start")).distinct(), depth).join(named, "node", "left_semi").select(F.col("start").alias("via"), "node", "depth")
    return own.unionByName(twins.join(found, "via").select("start", "node", "depth", "via"))


def traverse(nodes: DataFrame, edges: DataFrame, start: int, depth: int = 3, direction: str = "outgoing", edge_types: list[str] | None = None, node_types: list[str] | None = None, limit: int = 100) -> DataFrame:
    """(node_id, name, node_type, depth, edge_type, path): nodes within ``depth`` hops, each once with the path and edge of its discovery.

    Discovery follows the order (order of the parent, edge_id). Node types filter what is given, not what is expanded. Each hop is written.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "traverse")
    if edge_types:
        edges = edges.where(F.lower("edge_type").isin([t.lower() for t in edge_types]))
    ahead = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), "edge_type", "edge_id")
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), "edge_type", "edge_id")
    steps = {"outgoing": ahead, "incoming": back, "both": ahead.unionByName(back)}[direction]
    frontier = spark.createDataFrame([(start, [start], [0])], "at bigint, path array<bigint>, rank array<bigint>")
    found = None
    seen = frontier.select(F.col("at").alias("to"))
    for hop in range(1, depth + 1):
        new = frontier.join(steps, "at").join(seen, "to", "left_anti")
        first = Window.partitionBy("to").orderBy("rank", "edge_id")
        new = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("to", "edge_type", F.concat("path", F.array("to")).alias("path"), F.concat("rank", F.array("edge_id")).alias("rank"), F.lit(hop).alias("depth"))
        new = scratch.cut(new)
        found = new if found is None else found.unionByName(new)
        seen = seen.unionByName(new.select("to"))
        frontier = new.select(F.col("to").alias("at"), "path", "rank")
    out = found.withColumnRenamed("to", "node_id").join(nodes.select("node_id", "name", "node_type"), "node_id")
    if node_types:
        out = out.where(F.lower("node_type").isin([t.lower() for t in node_types]))
    return out.orderBy("depth", "rank").limit(limit).select("node_id", "name", "node_type", "depth", "edge_type", "path")


def call_graph(nodes: DataFrame, edges: DataFrame, root: int, depth: int = 3) -> DataFrame:
    """(node_id, name, relation, depth): callers and callees of ``root``; a node that is both is a caller. Every edge of the
    drawn graph joins a node with the root: node -> root for callers, root -> node for callees."""
    start = nodes.sparkSession.createDataFrame([(root,)], "start bigint")
    sides = None
    for order, (relation, direction) in enumerate((("caller", "incoming"), ("callee", "outgoing"))):
        side = reach(links(edges, ["Calls"], direction), start, depth).where(F.col("node") != root).select("node", "depth", F.lit(relation).alias("relation"), F.lit(order).alias("_order"))
        sides = side if sides is None else sides.unionByName(side)
    best = sides.groupBy("node").agg(F.min(F.struct("_order", "relation", "depth")).alias("b"))
    return best.join(nodes.select(F.col("node_id").alias("node"), "name"), "node").where("name IS NOT NULL").select(F.col("node").alias("node_id"), "name", "b.relation", "b.depth")


def dependency_nodes(nodes: DataFrame, edges: DataFrame, path: str, depth: int = 3, direction: str = "both", external: bool = True) -> DataFrame:
    """(node_id, name, path): the file at ``path`` and everything within ``depth`` import steps of it; without ``external`` only what has a path, which modules
    outside of the indexed trees have not."""
    starts = nodes.where((F.col("node_type") == "CodeFile") & (F.col("path") == path)).select(F.col("node_id").alias("start"))
    found = None
    for way in ("outgoing", "incoming") if direction == "both" else (direction,):
        part = reach(links(edges, ["Imports"], way), starts, depth).select("node")
        found = part if found is None else found.unionByName(part)
    ids = found.unionByName(starts.select(F.col("start").alias("node"))).distinct()
    out = ids.join(nodes.select(F.col("node_id").alias("node"), "name", "path"), "node").select(F.col("node").alias("node_id"), "name", "path")
    return out if external else out.where("path <> ''")


def dependency_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst, label): import edges with both ends among ``members``."""
    ids = members.select("node_id").distinct()
    inside = edges.where("edge_type = 'Imports'").join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return inside.select("src", "dst", F.lit("import").alias("label")).distinct()


def _impact_kind(edge_type: Column) -> Column:
    return F.when(edge_type == "Calls", "caller").when(edge_type == "Extends", "subclass").when(edge_type == "Implements", "implementation").otherwise("reference")


def _severity(change: str) -> Column:
    return F.lit({"delete": "breaking", "rename": "breaking", "modify": "warning"}.get(change, "info"))


def direct_impact(nodes: DataFrame, edges: DataFrame, targets: DataFrame, change: str = "modify") -> DataFrame:
    """(target, node_id, edge_id, path, impact, severity): one row for every edge that comes into a target; ``targets`` is (target)."""
    ends = edges.select(F.col("dst").alias("target"), F.col("src").alias("node_id"), "edge_type", "edge_id").join(targets.distinct(), "target", "left_semi")
    return ends.join(nodes.select("node_id", "path"), "node_id").select("target", "node_id", "edge_id", "path", _impact_kind(F.col("edge_type")).alias("impact"), _severity(change).alias("severity"))


def indirect_impact(nodes: DataFrame, edges: DataFrame, direct: DataFrame) -> DataFrame:
    """(target, node_id, path): within two steps before the directly impacted nodes, one node (the least) for every file not impacted yet."""
    steps = links(edges, None, "incoming")
    around = reach(steps, direct.select(F.col("node_id").alias("start")).distinct(), 2).select(F.col("start").alias("via"), "node")
    reached = direct.select("target", F.col("node_id").alias("via")).distinct().join(around, "via").select("target", F.col("node").alias("node_id")).distinct()
    placed = reached.where("node_id <> target").join(nodes.select("node_id", "path"), "node_id")
    return placed.join(direct.select("target", "path").distinct(), ["target", "path"], "left_anti").groupBy("target", "path").agg(F.min("node_id").alias("node_id"))


def impact_risk(edges: DataFrame, targets: DataFrame, change: str = "modify") -> DataFrame:
    """(target, callers, risk): from the number of transitive callers within three steps."""
    found = reach(links(edges, ["Calls"], "incoming"), targets.select(F.col("target").alias("start")), 3)
    counts = found.groupBy(F.col("start").alias("target")).agg(F.count("*").alias("n"))
    n = F.col("callers")
    risk = {
        "delete": F.when(n > 10, "critical").when(n > 0, "high").otherwise("low"),
        "rename": F.when(n > 10, "high").when(n > 0, "medium").otherwise("low"),
        "modify": F.when(n > 20, "medium").otherwise("low"),
    }.get(change, F.lit("low"))
    return targets.distinct().join(counts, "target", "left").select("target", F.coalesce("n", F.lit(0)).alias("callers")).withColumn("risk", risk)


def consumers(nodes: DataFrame) -> DataFrame:
    """(project, name, consumer): nodes of other projects whose unresolved calls name a function of ``project``."""
    wanted = nodes.where("unresolved_calls IS NOT NULL").select(F.col("node_id").alias("consumer"), F.col("project").alias("_from"), F.explode(F.array_distinct("unresolved_calls")).alias("name"))
    defined = nodes.where("node_type = 'Function' AND name <> ''").groupBy("project", "name").agg(F.count("*").alias("_defs"))
    return wanted.join(defined.drop("_defs"), "name").where("project <> _from").select("project", "name", "consumer").distinct()


def symbol_info(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What is known of each function at one step: (node_id, callers, callees, referrers, imports, loc, has_tests, is_public, deprecated, complexity); callers,
    callees and imports are numbers of distinct nodes and names, see ``symbol_neighbours`` for which."""
    calls = call_adjacency(edges)
    refs = edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("referrers"))
    flag = F.col("name").startswith("test_") | F.col("name").endswith("_test") | F.col("name").contains("test ") | F.col("path").contains("/test")
    testers = nodes.where(flag).select(F.col("node_id").alias("src"))
    tested = edges.where("edge_type = 'Calls'").join(testers, "src", "left_semi").select(F.col("dst").alias("node_id"), F.lit(True).alias("_t")).distinct()
    imports = symbol_neighbours(nodes, edges).where("relation IN ('dependency', 'dependent')").groupBy("node_id").agg(F.count_distinct("name").alias("imports"))
    out = nodes.where("node_type = 'Function' AND name IS NOT NULL").select("node_id", F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(1)).alias("loc"), "is_public", F.coalesce("deprecated", F.lit(False)).alias("deprecated"), "complexity")
    for part in (calls, refs, imports, tested):
        out = out.join(part, "node_id", "left")
    zero = F.lit(0).cast("bigint")
    return out.select("node_id", *[F.coalesce(c, zero).alias(c) for c in ("callers", "callees", "referrers", "imports")], "loc", F.coalesce("_t", F.lit(False)).alias("has_tests"), "is_public", "deprecated", "complexity")


def symbol_neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, relation, other, name): the callers and callees of every node, what it imports (dependency) and what imports it (dependent); with a name, each once."""
    kind = F.when(F.col("edge_type") == "Calls", F.array(F.lit("callee"), F.lit("caller"))).when(F.col("edge_type").isin("Imports", "ImportsFrom"), F.array(F.lit("dependency"), F.lit("dependent")))
    ends = edges.select("src", "dst", kind.alias("k")).where("k IS NOT NULL")
    both = ends.select(F.col("src").alias("node_id"), F.col("k")[0].alias("relation"), F.col("dst").alias("other")).unionByName(ends.select(F.col("dst").alias("node_id"), F.col("k")[1].alias("relation"), F.col("src").alias("other")))
    return both.distinct().join(nodes.select(F.col("node_id").alias("other"), "name"), "other").where("name <> ''").select("node_id", "relation", "other", "name")


def edges_around(edges: DataFrame, node: int, direction: str = "both") -> DataFrame:
    out, into = F.col("src") == node, F.col("dst") == node
    return edges.where({"both": out | into, "outgoing": out, "incoming": into}[direction])


def definitions(edges: DataFrame) -> DataFrame:
    """(node_id, target): where each node leads: the target of its first call, reference or import by edge_id."""
    ahead = edges.where("edge_type IN ('Calls', 'References', 'Imports')")
    return ahead.groupBy(F.col("src").alias("node_id")).agg(F.min_by("dst", F.struct("edge_id", "dst")).alias("target"))


def references(edges: DataFrame) -> DataFrame:
    """(node_id, referrer): sources of all edges that come into a node."""
    return edges.select(F.col("dst").alias("node_id"), F.col("src").alias("referrer")).distinct()


def hover(nodes: DataFrame) -> DataFrame:
    """(node_id, text): what is shown of a symbol under the pointer: its kind and name, or signature, then its documentation."""
    head = F.coalesce("signature", F.concat_ws(" ", F.lower("node_type"), "name"))
    return nodes.where("name IS NOT NULL").select("node_id", F.concat_ws("\n\n", head, F.when(F.trim("doc") != "", F.col("doc"))).alias("text"))


def document_symbols(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """(node_id, parent, name, node_type, line_start, line_end): the outline of a file: each symbol below the class that contains it, null at the top."""
    own = nodes.where((F.col("path") == path) & (F.col("node_type") != "CodeFile") & F.col("name").isNotNull())
    holders = nodes.where((F.col("path") == path) & F.col("node_type").isin("Class", "Interface", "Module")).select(F.col("node_id").alias("src"))
    held = edges.where("edge_type = 'Contains'").join(holders, "src", "left_semi").groupBy(F.col("dst").alias("node_id")).agg(F.max("src").alias("parent"))
    return own.join(held, "node_id", "left").select("node_id", "parent", "name", "node_type", "line_start", "line_end").orderBy("line_start", "node_id")


def call_hierarchy(nodes: DataFrame, edges: DataFrame, node: int, direction: str = "incoming") -> DataFrame:
    """(node_id, name, path, line_start, calls): who calls a node, or whom it calls, with how many call edges."""
    mine, theirs = ("dst", "src") if direction == "incoming" else ("src", "dst")
    ends = edges.where((F.col("edge_type") == "Calls") & (F.col(mine) == node)).groupBy(F.col(theirs).alias("node_id")).agg(F.count("*").alias("calls"))
    return ends.join(nodes.where("name IS NOT NULL").select("node_id", "name", "path", "line_start"), "node_id").select("node_id", "name", "path", "line_start", "calls")


def locations(nodes: DataFrame) -> DataFrame:
    """(node_id, path, line, end_line, column, end_column), counted from 0; a missing end is the start's."""
    return nodes.where("path IS NOT NULL").select(
        "node_id", "path", F.greatest(F.col("line_start") - 1, F.lit(0)).alias("line"), F.greatest(F.when(F.col("line_end") > 0, F.col("line_end")).otherwise(F.col("line_start")) - 1, F.lit(0)).alias("end_line"),
        F.col("col_start").alias("column"), F.col("col_end").alias("end_column"),
    )


#: Levels of line buckets: a range of up to 2 ** k lines lies in two buckets of level k at most.
LEVELS = 31


def _covering(ranges: DataFrame, positions: DataFrame) -> DataFrame:
    """Positions (path, line, ...) with the ranges (path, line_start, line_end, ...) that hold their line.

    An equi-join on buckets: a range is in the one or two buckets as long as itself that it touches, a position in its bucket of every level, so only ranges near
    a position, of each length, meet it, also in files with very many symbols.
    """
    length = F.col("line_end") - F.col("line_start") + 1
    level = F.ceil(F.log2(length.cast("double"))).cast("int")
    bucket = lambda line, k: F.floor(line / F.pow(F.lit(2.0), k)).cast("int")
    touched = F.array_distinct(F.array(bucket(F.col("line_start"), F.col("level")), bucket(F.col("line_end"), F.col("level"))))
    in_buckets = ranges.where("line_end >= line_start").withColumn("level", level).withColumn("bucket", F.explode(touched))
    asked = positions.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).withColumn("bucket", bucket(F.col("line"), F.col("level")))
    # Most levels are empty: those in use, LEVELS at most, are known before positions meet ranges.
    used = F.broadcast(in_buckets.select("level").distinct())
    return asked.join(used, "level", "left_semi").join(in_buckets, ["path", "level", "bucket"]).where(F.col("line").between(F.col("line_start"), F.col("line_end"))).drop("level", "bucket")


def nearest_symbols(nodes: DataFrame, positions: DataFrame) -> DataFrame:
    """(position_id, node_id, used_fallback): for each (position_id, path, line) the tightest range of the path that holds the line, else
    the nearest symbol: its start behind the line counts its distance, one that began before counts 1000 and the lines since its end. Ties go to the smaller id; paths match
    exactly. A file's symbols and positions are sorted together, so no pair of them is looked at twice."""
    symbols = nodes.where("node_type <> 'CodeFile'").select("path", "node_id", "line_start", "line_end")
    asked = positions.select("position_id", "path", "line")
    held = _covering(symbols, asked).groupBy("position_id").agg(F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("d"), F.col("node_id"))).alias("k"))
    inside = held.select("position_id", "k.node_id", F.lit(False).alias("used_fallback"))
    lost = asked.join(inside.select("position_id"), "position_id", "left_anti").where("line IS NOT NULL")
    none = [F.lit(None).cast(k).alias(c) for c, k in (("node_id", "bigint"), ("line_end", "int"))]
    begun = symbols.join(lost.select("path").distinct(), "path", "left_semi").select("path", F.col("line_start").alias("at"), F.lit(0).alias("kind"), "node_id", "line_end", F.lit(None).cast("bigint").alias("position_id"))
    events = begun.unionByName(lost.select("path", F.col("line").alias("at"), F.lit(1).alias("kind"), *none, F.col("position_id").cast("bigint").alias("position_id")))
    order = Window.partitionBy("path").orderBy("at", "kind", "node_id")
    before = F.max(F.when(F.col("kind") == 0, F.struct("line_end", (-F.col("node_id")).alias("n")))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.when(F.col("kind") == 0, F.struct("at", "node_id")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    seen = events.select("position_id", "at", "kind", before.alias("b"), after.alias("a")).where("kind = 1 AND (a IS NOT NULL OR b IS NOT NULL)")
    # least ignores nulls, and structs are compared field by field.
    best = F.least(F.when(F.col("b").isNotNull(), F.struct((F.col("at") - F.col("b.line_end") + 1000).alias("d"), (-F.col("b.n")).alias("node_id"))), F.when(F.col("a").isNotNull(), F.struct((F.col("a.at") - F.col("at")).alias("d"), F.col("a.node_id").alias("node_id"))))
    return inside.unionByName(seen.select("position_id", best["node_id"].alias("node_id"), F.lit(True).alias("used_fallback")))


def at_position(ranges: DataFrame, positions: DataFrame) -> DataFrame:
    """(position_id, node_id): the smallest range that holds a (line, column); columns count on the first and last line only."""
    fits = ((F.col("line") > F.col("line_start")) | (F.col("column") >= F.col("col_start"))) & ((F.col("line") < F.col("line_end")) | (F.col("column") <= F.col("col_end")))
    size = (F.col("line_end") - F.col("line_start")) * 10_000 + F.col("col_end") - F.col("col_start")
    held = _covering(ranges, positions.select("position_id", "path", "line", "column")).where(fits)
    return held.groupBy("position_id").agg(F.min(F.struct(size.alias("s"), "node_id")).alias("k")).select("position_id", "k.node_id")


def expand(nodes: DataFrame, edges: DataFrame, shown: DataFrame, depth: int = 2) -> DataFrame:
    """(node_id): a drawn graph's nodes (node_id) and all within ``depth`` steps of any of them."""
    more = reach(links(edges, None, "both"), shown.select(F.col("node_id").alias("start")), depth)
    return shown.select("node_id").unionByName(more.select(F.col("node").alias("node_id"))).distinct().join(nodes.select("node_id"), "node_id", "left_semi")


def symbols_by(nodes: DataFrame, column: str) -> DataFrame:
    return nodes.groupBy(column).agg(F.count("*").alias("symbols"))


def symbol_records(nodes: DataFrame, compact: bool = False) -> DataFrame:
    """The public form of symbols: those with a name, lines from 1, texts cut to 500 characters, or left out if ``compact``."""
    from codeloom.functions.rules import truncate

    texts = [F.lit(None).cast("string").alias(c) if compact else truncate(F.col(c)).alias(c) for c in ("signature", "doc")]
    visible = F.coalesce("visibility", F.when(F.col("is_public"), "public").otherwise("private")).alias("visibility")
    start = F.greatest("line_start", F.lit(1))
    return nodes.where("name IS NOT NULL").select("node_id", "name", "node_type", "path", start.alias("line"), F.when(F.col("line_end") > 0, F.col("line_end")).otherwise(start).alias("end_line"), *texts, "is_public", visible)


def skewed_lookup(spark: SparkSession, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the names of both ends, balanced for hub nodes: the lookup of dst may meet a node that a tenth of all edges point at."""
    degree = edges.groupBy(F.col("dst").alias("dst")).agg(F.count("*").alias("degree"))
    rows = edges.count()
    heads = nodes.select(F.col("node_id").alias("dst"), F.col("name").alias("dst_name")).join(degree, "dst")
    tails = nodes.select(F.col("node_id").alias("src"), F.col("name").alias("src_name"))
    return join_counted(edges, heads, "dst", "degree", rows).join(tails, "src")

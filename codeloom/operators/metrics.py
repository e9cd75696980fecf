"""Code metrics: complexity, unused code, coupling, index statistics, and hot spots of a history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import rules


#: What makes up a complexity.
DETAILS = ["branches", "loops", "logical_ops", "nesting", "exceptions", "early_returns"]


def function_complexity(nodes: DataFrame, path: str | None = None, line: int | None = None) -> DataFrame:
    """(node_id, path, name, complexity, grade, loc, branches, loops, logical_ops, nesting, exceptions, early_returns): functions, of one file or line if
    asked; without a stored complexity 1, A and zeros."""
    f = nodes.where("node_type = 'Function'")
    if path is not None:
        f = f.where(F.col("path") == path)
    if line is not None:
        f = f.where(F.lit(line).between(F.col("line_start"), F.col("line_end")))
    grade = F.when(F.col("complexity").isNull(), "A").otherwise(rules.complexity_grade(F.col("complexity")))
    loc = F.greatest(F.col("line_end") - F.col("line_start"), F.lit(0)) + 1
    details = [F.when(F.col("complexity").isNull(), 0).otherwise(F.coalesce(f"complexity_{c}", F.lit(0))).alias(c) for c in DETAILS]
    return f.select("node_id", "path", "name", F.coalesce("complexity", F.lit(1)).alias("complexity"), grade.alias("grade"), loc.alias("loc"), *details)


def file_complexity(functions: DataFrame, threshold: int = 10) -> DataFrame:
    """(path, functions, average, greatest, above, grade): complexity by file."""
    c = F.col("complexity")
    out = functions.groupBy("path").agg(F.count("*").alias("functions"), F.avg(c).alias("average"), F.max(c).alias("greatest"), F.count_if(c > threshold).alias("above"))
    return out.withColumn("grade", rules.file_grade(F.col("average")))


def complexity_advice(functions: DataFrame, threshold: int = 10) -> DataFrame:
    """(path, advice): functions over the threshold, files whose average exceeds 15, and files with functions nested deeper than 4."""
    each = functions.where(F.col("complexity") > threshold).select("path", F.concat(F.lit("Function '"), "name", F.lit("' has complexity "), F.col("complexity").cast("string"), F.lit(", consider splitting it")).alias("advice"))
    files = file_complexity(functions, threshold).where("average > 15").select("path", F.lit("The average complexity is high, consider splitting the file").alias("advice"))
    nested = functions.where("nesting > 4").groupBy("path").agg(F.count("*").alias("n"))
    deep = nested.select("path", F.concat(F.col("n").cast("string"), F.lit(" functions are nested deeper than 4 levels, consider returning early or extracting some")).alias("advice"))
    return each.unionByName(files).unionByName(deep)


#: Edges that mean use, beside calls.
_USES = ["References", "Uses", "Invokes", "Instantiates", "Extends", "Implements", "Imports"]


def unused(nodes: DataFrame, edges: DataFrame, path: str | None = None, include_tests: bool = False, least: float = 0.7, limit: int | None = None) -> DataFrame:
    """(node_id, name, node_type, path, confidence): symbols nothing uses.

    A symbol that anything calls is used, tests included: what only tests call is exercised, and not reported either. Other uses count unless they are a test's. A class or type is used if a function it contains, or any function of its file, is called. Files,
    modules, synthetic, framework and trait names, and build outputs are never reported. All steps are semi- and anti-joins on node_id or path.
    """
    name, where = F.col("name"), F.col("path")
    test = rules.is_test_node(name, where, F.col("is_test"))
    found = nodes.where("node_type IN ('Function', 'Class', 'Variable', 'Interface', 'Type')")
    found = found.where(where == path) if path is not None else found.where(~rules.is_build_output(where))
    if not include_tests:
        found = found.where(~test)
    synthetic = F.coalesce(name, F.lit("")).isin("", "arrow_function", "anonymous") | name.startswith("<")
    found = found.where(~synthetic & ~name.isin(rules.FRAMEWORK_NAMES) & ~name.isin(rules.TRAIT_NAMES))
    tests = nodes.where(test).select(F.col("node_id").alias("src"))
    calls = edges.where("edge_type = 'Calls'").select("src", "dst").distinct()
    called = calls.select(F.col("dst").alias("node_id")).distinct()
    used = edges.where(F.col("edge_type").isin(_USES)).select("src", "dst").join(tests, "src", "left_anti").select(F.col("dst").alias("node_id")).distinct()
    # Symbols that only tests call are exercised, and not reported either.
    left = found.join(called, "node_id", "left_anti").join(used, "node_id", "left_anti")
    live = nodes.where("node_type = 'Function'").join(called, "node_id", "left_semi")
    holders = edges.where("edge_type = 'Contains'").join(live.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node_id")).distinct()
    kinds = left.where("node_type IN ('Class', 'Type')").join(holders, "node_id", "left_anti").join(live.select("path").distinct(), "path", "left_anti")
    rest = left.where("node_type NOT IN ('Class', 'Type')")
    columns = ["node_id", "name", "node_type", "path", "line_start", "line_end", "is_public"]
    out = rest.select(columns).unionByName(kinds.select(columns)).withColumn("confidence", rules.unused_confidence(name, F.col("is_public"))).where(F.col("confidence") >= least)
    return out.orderBy("node_id").limit(limit) if limit else out


def unused_summary(found: DataFrame) -> DataFrame:
    """(node_type, symbols, safe_to_remove, removable_lines): by type; safe are the private ones with more than 0.8."""
    safe = ~F.col("is_public") & (F.col("confidence") > 0.8)
    lines = F.col("line_end") - F.col("line_start") + 1
    return found.groupBy("node_type").agg(F.count("*").alias("symbols"), F.count_if(safe).alias("safe_to_remove"), F.coalesce(F.sum(F.when(F.col("confidence") > 0.8, lines)), F.lit(0)).alias("removable_lines"))


def graph_coupling(dependency_edges: DataFrame) -> DataFrame:
    """(afferent, efferent, instability): both are the number of edges of a dependency graph, so instability is one half or 0."""
    n = F.count("*")
    return dependency_edges.agg(n.alias("afferent"), n.alias("efferent"), F.when(n > 0, 0.5).otherwise(0.0).alias("instability"))


def file_coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, afferent, efferent, instability, internal_ratio, cohesion, violation): over imports and calls between files; counted are distinct
    file stems on the other side; internal_ratio is 1 for a file without outgoing edges."""
    at = nodes.where("path IS NOT NULL").select("node_id", "path")
    ends = edges.where("edge_type IN ('Imports', 'Calls')").select("src", "dst").join(at.select(F.col("node_id").alias("src"), F.col("path").alias("a")), "src").join(at.select(F.col("node_id").alias("dst"), F.col("path").alias("b")), "dst")

    def stem(c: str) -> Column:
        return F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")

    pairs = ends.withColumn("out", F.col("a") != F.col("b"))
    going = pairs.groupBy(F.col("a").alias("path")).agg(F.count_distinct(F.when(F.col("out"), stem("b"))).alias("efferent"), F.count_if(~F.col("out")).alias("inside"), F.count("*").alias("outgoing"))
    coming = pairs.where("out").groupBy(F.col("b").alias("path")).agg(F.count_distinct(stem("a")).alias("afferent"))
    both = at.select("path").distinct().join(going, "path", "left").join(coming, "path", "left").na.fill(0, ["efferent", "afferent", "inside", "outgoing"])
    ca, ce, total = F.col("afferent"), F.col("efferent"), F.col("afferent") + F.col("efferent")
    out = both.withColumn("instability", F.when(total > 0, ce / total).otherwise(0.0)).withColumn("internal_ratio", F.when(F.col("outgoing") > 0, F.col("inside") / F.col("outgoing")).otherwise(1.0))
    kind = F.when(F.col("internal_ratio") > 0.7, "functional").when(F.col("internal_ratio") > 0.4, "sequential").otherwise("coincidental")
    return out.select("path", ca, ce, "instability", "internal_ratio", kind.alias("cohesion"), ((F.col("instability") < 0.2) & (ce > 5)).alias("violation"))


def coupling_advice(coupling: DataFrame) -> DataFrame:
    """(path, advice): of ``file_coupling``: files that depend on too many, hang together too little, or that many depend on, and stable ones that depend on many."""
    afferent = F.col("afferent").cast("string")
    notes = [
        (F.col("instability") > 0.8, F.lit("It depends on many others and few on it, consider fewer dependencies")),
        (F.col("internal_ratio") < 0.3, F.lit("Its functions hardly refer to each other, consider splitting it")),
        (F.col("afferent") > 10, F.concat(afferent, F.lit(" files depend on it, changes have a wide impact"))),
        (F.col("violation"), F.lit("It is stable and yet depends on many, consider moving dependencies out")),
    ]
    listed = F.array(*[F.when(when, text) for when, text in notes])
    return coupling.select("path", F.explode(F.filter(listed, lambda x: x.isNotNull())).alias("advice"))


def success_rate(results: DataFrame) -> DataFrame:
    """(succeeded, total, rate) of (ok); 1 when there are none."""
    total = F.count("*")
    good = F.count_if("ok")
    return results.agg(good.alias("succeeded"), total.alias("total"), F.when(total == 0, 1.0).otherwise(good / total).alias("rate"))


def hotspots(commits: DataFrame, commit_files: DataFrame, least: int = 10, limit: int | None = None) -> DataFrame:
    """(path, changes, commits, subjects): files changed in ``least`` commits or more, with the subjects of the five latest."""
    rows = commit_files.join(commits.select("hash", "subject", "author_date"), "hash")
    totals = rows.groupBy("path").agg(F.count("*").alias("changes"), F.count_distinct("hash").alias("commits")).where(F.col("changes") >= least)
    w = Window.partitionBy("path").orderBy(F.desc("author_date"), "hash", "subject")
    newest = rows.join(totals.select("path"), "path", "left_semi").withColumn("_n", F.row_number().over(w)).where("_n <= 5")
    subjects = newest.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "subject"))), lambda x: x["subject"]).alias("subjects"))
    out = totals.join(subjects, "path").orderBy(F.desc("changes"), "path")
    return out.limit(limit) if limit else out


#: Files of a commit that meet those of another block in one task.
COMMIT_FILES = 1000


def cochange(commit_files: DataFrame, least: float = 0.7, limit: int | None = None) -> DataFrame:
    """(path_a, path_b, together, strength, changes): pairs of files that change together in ``least`` or more of the rarer one's commits.

    Only files of the same commit meet, those of a large commit in blocks of COMMIT_FILES, so that no task has all pairs of one. The strength lies within [0, 1], so a pair needs that many common commits.
    """
    files = commit_files.select("hash", "path").distinct()
    counts = files.groupBy("path").agg(F.count("*").alias("n"))
    sizes = files.groupBy("hash").agg(F.ceil(F.count("*") / COMMIT_FILES).cast("int").alias("blocks"))
    placed = files.join(sizes, "hash").withColumn("block", F.pmod(F.xxhash64("path"), "blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = placed.select("hash", F.col("block").alias("i"), every.alias("j"), F.col("path").alias("path_a"))
    b = placed.select("hash", every.alias("i"), F.col("block").alias("j"), F.col("path").alias("path_b"))
    pairs = a.join(b, ["hash", "i", "j"]).where("path_a < path_b").groupBy("path_a", "path_b").agg(F.count("*").alias("together"))
    for side in "ab":
        pairs = pairs.join(counts.select(F.col("path").alias(f"path_{side}"), F.col("n").alias(f"n_{side}")), f"path_{side}")
    out = pairs.withColumn("strength", F.col("together") / F.least("n_a", "n_b")).where(F.col("strength") >= least)
    out = out.select("path_a", "path_b", "together", "strength", F.greatest("n_a", "n_b").alias("changes"))
    return out.orderBy(F.desc("strength"), F.desc("together"), "path_a", "path_b").limit(limit) if limit else out


def parser_metrics(results: DataFrame) -> DataFrame:
    """(language, attempted, succeeded, failed, entities, relations, total_ms, average_ms, rate) of (language, ok, entities, relations, ms), and a row
    with a null language for all together, which is there for no results too. The rate is 0 where nothing was attempted."""
    good, total = F.count_if("ok"), F.count("*")
    figures = [
        total.alias("attempted"), good.alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum("entities"), F.lit(0)).alias("entities"), F.coalesce(F.sum("relations"), F.lit(0)).alias("relations"),
        F.coalesce(F.sum("ms"), F.lit(0.0)).alias("total_ms"), F.avg("ms").alias("average_ms"), F.coalesce(F.try_divide(good, total), F.lit(0.0)).alias("rate"),
    ]
    return results.groupBy("language").agg(*figures).unionByName(results.agg(*figures).withColumn("language", F.lit(None).cast("string")))

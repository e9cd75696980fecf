"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.tokens import VOCABULARY, count_udf
from codeloom.session import Scratch

#: Documents whose inclusion is balanced together in one task.
BLOCK_DOCS = 4096
SEED = 20_250_101
_EDGE = 1e-9


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase of the cube method for the two constraints that the documents and their sizes sum to what ``pi`` expects.

    Three undecided documents at a time, the probabilities move along the direction that keeps both sums, to one of the two
    points where one of them becomes 0 or 1, each as likely as the mean demands. At most two stay undecided.
    """
    out = pi.astype(float).copy()
    undecided = [k for k in range(len(out)) if _EDGE < out[k] < 1 - _EDGE]
    draws = iter(rng.random(len(undecided) + 3))
    active: list[int] = []
    for k in undecided:
        active.append(k)
        if len(active) < 3:
            continue
        a, b, c = active
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - out[x]) / d if d > 0 else out[x] / -d for x, d in zip(active, u) if d)
        down = min(out[x] / d if d > 0 else (1 - out[x]) / -d for x, d in zip(active, u) if d)
        step = up if next(draws) < down / (up + down) else -down
        for x, d in zip(active, u):
            out[x] += step * d
        rest = []
        for x in active:
            if out[x] <= _EDGE:
                out[x] = 0.0
            elif out[x] >= 1 - _EDGE:
                out[x] = 1.0
            else:
                rest.append(x)
        active = rest
    return out


def landing(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decides the few documents that flight left: of all ways to decide, the one nearest to the expected size, then number."""
    out = pi.copy()
    left = [k for k in range(len(out)) if 0 < out[k] < 1]
    if left:
        want, number = sum(out[k] * size[k] for k in left), sum(out[k] for k in left)
        ways = range(1 << len(left))
        best = min(ways, key=lambda w: (abs(sum(size[k] for j, k in enumerate(left) if w >> j & 1) - want), abs(bin(w).count("1") - number), w))
        for j, k in enumerate(left):
            out[k] = float(best >> j & 1)
    return out


def hash_of(text: str) -> int:
    """A number for a text that is the same in every process."""
    return xxhash.xxh32_intdigest(text)


def balance(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator, final: bool) -> np.ndarray:
    """Flight over size classes, from the longest documents to the shortest.

    A long document among short ones hardly moves, so in one flight over all the longest would stay undecided and landing them
    would cost their size. Here each class flies and lands by itself; the tokens it is off by are expected of the next, shorter
    class. What is left undecided at the end, or landed if ``final``, is of the shortest class.
    """
    out = pi.astype(float).copy()
    rank = np.frexp(size)[1]
    owed = 0.0
    classes = np.unique(rank)[::-1]
    for c in classes:
        at = np.flatnonzero(rank == c)
        before = float((out[at] * size[at]).sum())
        if owed:
            out[at] = np.clip(out[at] + owed / size[at].sum(), 0, 1)
        owed += before - float((out[at] * size[at]).sum())
        want = float((out[at] * size[at]).sum())
        flown = flight(out[at], size[at], rng)
        if final or c != classes[-1]:
            flown = landing(flown, size[at])
        out[at] = flown
        owed += want - float((flown * size[at]).sum())
    return out


def _fly(final: bool):
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["draw", "doc_id"], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([SEED, hash_of(str(key[0])), int(key[1]), int(final)])
        size = f["tokens"].to_numpy(dtype=float)
        return f.assign(pi=balance(f["pi"].to_numpy(dtype=float), size, rng, final))[["doc_id", "source", "tokens", "pi", "draw"]]

    return run


def source_name(column: str):
    """Sources that differ only in case or padding are one."""
    return F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))


def plan(available: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None) -> dict[str, float]:
    """The expected uses of each document of a source.

    Without ``total`` the mix is as large as it can be with every source that has tokens at its target share of what these
    together should have; a larger ``total`` is cut to what the repeats allow, source by source.
    """
    can = {s: available.get(s, 0) for s in targets}
    usable = {s for s, (share, repeats) in targets.items() if share > 0 and repeats > 0 and can[s] > 0}
    if not usable:
        return {s: 0.0 for s in targets}
    if total is None:
        total = min(can[s] * targets[s][1] / targets[s][0] for s in usable)
    return {s: min(float(targets[s][1]), total * targets[s][0] / can[s]) if s in usable else 0.0 for s in targets}


def mixture(spark: SparkSession, documents: DataFrame, targets: DataFrame, total: float | None = None, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """Uses and report of a mixture in which each source of ``targets`` has its share of all tokens.

    Uses: (doc_id, source, tokens, uses), one row for every document of a listed source; nobody is used more often than its source's
    max_repeats. Report: (source, target_share, max_repeats, documents, available_tokens, uses, tokens, actual_share), one row for every
    listed source, with zeros for a source without documents. Null and unlisted sources and null doc_ids stay out; documents without
    tokens are never used; of repeated doc_ids the row with most tokens counts. ``targets`` is the list of sources, a
    handful; a source listed twice has the sum of its shares and the larger max_repeats, null shares and repeats count 0.

    A document's expected uses are a whole number and a fraction; the whole is used at once, and fractions are rounded by
    balanced sampling: in blocks of BLOCK_DOCS documents the flight phase decides all but two, which meet again in the
    next round's blocks, until one block a source is left and lands. A source of any size is thus spread over many tasks.
    """
    scratch = Scratch(spark, "mixing")
    rows = targets.select(source_name("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("s"), F.coalesce("max_repeats", F.lit(0)).alias("r")).where("source IS NOT NULL")
    wanted = {r["source"]: (float(r["s"]), int(r["r"])) for r in rows.groupBy("source").agg(F.sum("s").alias("s"), F.max("r").alias("r")).collect()}
    listed = documents.where("doc_id IS NOT NULL").select("doc_id", source_name("source").alias("source"), "text").where(F.col("source").isin(list(wanted) or [""]))
    counted = listed.select("doc_id", "source", count_udf(spark, vocabulary)("text").alias("tokens"))
    sizes = scratch.cut(counted.groupBy("doc_id").agg(F.max_by("source", F.struct("tokens", "source")).alias("source"), F.max("tokens").alias("tokens")))
    have = {r["source"]: r for r in sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > 0).alias("filled")).collect()}
    expected = plan({s: int(r["tokens"]) for s, r in have.items()}, wanted, total)

    def lookup(values: dict, default):
        pairs = [x for s, v in values.items() for x in (F.lit(s), F.lit(v))]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(default)) if pairs else F.lit(default)

    whole = {s: int(math.floor(x + _EDGE)) for s, x in expected.items()}
    part = {s: max(0.0, x - whole[s]) if x - whole[s] > _EDGE else 0.0 for s, x in expected.items()}
    draw = F.xxhash64("doc_id", F.lit(SEED))
    filled = F.col("tokens") > 0
    base = sizes.select("doc_id", "source", "tokens", F.when(filled, lookup(whole, 0)).otherwise(0).alias("whole"), F.when(filled, lookup(part, 0.0)).otherwise(0.0).alias("pi"), draw.alias("draw"))
    open_ = base.where("pi > 0").drop("whole")
    count = {s: int(r["filled"]) for s, r in have.items() if part.get(s, 0.0) > 0}
    decided: list[DataFrame] = []
    schema = "doc_id bigint, source string, tokens bigint, pi double, draw bigint"
    while count:
        blocks = {s: max(1, math.ceil(n / BLOCK_DOCS)) for s, n in count.items()}
        final = all(b == 1 for b in blocks.values())
        # Also a source that needs one block only goes on until all do, so that it lands in the final round.
        block = F.pmod(F.shiftright(F.xxhash64("doc_id", F.lit(len(decided))), 7), lookup(blocks, 1)).cast("int")
        flown = scratch.cut(open_.withColumn("block", block).groupBy("source", "block").applyInPandas(_fly(final), schema))
        decided.append(flown.where("pi >= 1").select("doc_id"))
        if final:
            break
        open_ = flown.where("pi > 0 AND pi < 1")
        count = {r["source"]: int(r["n"]) for r in open_.groupBy("source").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for d in decided:
        chosen = d if chosen is None else chosen.unionByName(d)
    if chosen is None:
        chosen = spark.createDataFrame([], "doc_id bigint")
    with_more = base.join(chosen.withColumn("more", F.lit(1)), "doc_id", "left")
    uses = with_more.select("doc_id", "source", "tokens", (F.col("whole") + F.coalesce("more", F.lit(0))).cast("int").alias("uses"))
    sums = uses.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("tokens").alias("available_tokens"), F.sum("uses").cast("bigint").alias("uses"), F.sum(F.col("uses") * F.col("tokens")).cast("bigint").alias("used")
    )
    listed_rows = spark.createDataFrame([(s, share, repeats) for s, (share, repeats) in wanted.items()], "source string, target_share double, max_repeats int")
    report = sums.join(F.broadcast(listed_rows), "source", "right").na.fill(0, ["documents", "available_tokens", "uses", "used"])
    whole_mix = report.agg(F.sum("used").alias("all_used"))
    report = report.crossJoin(F.broadcast(whole_mix)).select(
        "source", "target_share", "max_repeats", "documents", "available_tokens", "uses", F.col("used").alias("tokens"), F.when(F.col("all_used") > 0, F.col("used") / F.col("all_used")).otherwise(0.0).alias("actual_share")
    )
    return uses, report


"""The pN_ queries: each applies its operator, with production parameters, to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import ship, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from codeloom.llm.components import match_groups

    return match_groups(spark, table(spark, folder, "duplicate_pairs"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_kinds(spark, folder).select("file_id")


def p2_kinds(spark: SparkSession, folder: str) -> DataFrame:
    from codeloom.llm.handwritten import not_handwritten

    ship(spark)
    return not_handwritten(spark, table(spark, folder, "source_files"), table(spark, folder, "third_party_files"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    from codeloom.llm.neighbours import nearest_pairs

    ship(spark)
    return nearest_pairs(spark, table(spark, folder, "symbol_vectors"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    from codeloom.llm.source_code import documented_functions

    ship(spark)
    return documented_functions(table(spark, folder, "source_files"), texts=False)


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    from codeloom.llm.source_code import documented_functions

    ship(spark)
    return documented_functions(table(spark, folder, "source_files"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    from codeloom.llm.source_code import broken_files

    ship(spark)
    return broken_files(table(spark, folder, "source_files"))


def p5_rates(spark: SparkSession, folder: str) -> DataFrame:
    from codeloom.llm.source_code import broken_rates

    ship(spark)
    return broken_rates(table(spark, folder, "source_files"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    from codeloom.llm.tokens import encoded

    ship(spark)
    return encoded(spark, table(spark, folder, "documents"))


def p6_round_trips(spark: SparkSession, folder: str) -> DataFrame:
    from codeloom.llm.tokens import round_trips

    ship(spark)
    return round_trips(spark, table(spark, folder, "documents"))


def p7_uses(spark: SparkSession, folder: str) -> DataFrame:
    from codeloom.llm.mixing import mixture

    ship(spark)
    return mixture(spark, table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    from codeloom.llm.mixing import mixture

    ship(spark)
    return mixture(spark, table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    from codeloom.llm.subjects import subjects_of

    ship(spark)
    return subjects_of(spark, table(spark, folder, "documents"), table(spark, folder, "subject_labels"), table(spark, folder, "subjects"))


def p8_composition(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents deal with each subject, of all with a doc_id."""
    documents = table(spark, folder, "documents")
    found = p8_found(spark, folder).groupBy("subject").agg(F.count("*").alias("documents"))
    total = documents.agg(F.count("doc_id").alias("total"))
    return found.crossJoin(F.broadcast(total)).select("subject", "documents", F.round(F.col("documents") / F.col("total"), 6).alias("share"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p2_found, p2_kinds, p3_found, p4_found, p4_pairs, p5_found, p5_rates, p6_ids, p6_round_trips, p7_uses, p7_shares, p8_found, p8_composition)}

ORACLES: dict[str, str] = {
    "p6_round_trips": "SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS chars, true AS same FROM documents",
    "p1_found": """
        WITH RECURSIVE links AS (
            SELECT node_id_a AS a, node_id_b AS b FROM duplicate_pairs
            WHERE node_id_a IS NOT NULL AND node_id_b IS NOT NULL AND similarity IS NOT NULL AND NOT isnan(similarity) AND similarity >= CAST(0.7 AS FLOAT)
        ),
        edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        ids AS (SELECT node_id_a AS id FROM duplicate_pairs WHERE node_id_a IS NOT NULL UNION SELECT node_id_b FROM duplicate_pairs WHERE node_id_b IS NOT NULL),
        reach(id, other) AS (
            SELECT id, id FROM ids
            UNION
            SELECT r.id, e.b FROM reach r JOIN edges e ON r.other = e.a
        )
        SELECT id AS node_id, min(other) AS group_id FROM reach GROUP BY id
    """,
}

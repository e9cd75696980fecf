"""Queries over vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import vectors
from codeloom.plans.registry import edges, nodes, query
from codeloom.session import table

_UNIT = "u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS len FROM embeddings WHERE embedding IS NOT NULL)"


def _embeddings(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")


@query(
    f"""WITH {_UNIT}, p AS (SELECT a.vec_id AS node_id_a, b.vec_id AS node_id_b, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / (a.len * b.len) AS s FROM u a JOIN u b ON a.vec_id < b.vec_id)
    SELECT node_id_a, node_id_b, round(s, 6) AS similarity FROM p WHERE s >= 0.4""",
    graph=False,
)
def v4_similar_pairs(spark, folder):
    return vectors.similar_pairs(_embeddings(spark, folder), 0.4).withColumn("similarity", F.round("similarity", 6))


@query(
    """WITH latest AS (SELECT node_id, embedding FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY embedded_at DESC, ingested_at DESC) AS k FROM symbol_vectors) WHERE k = 1 AND len(embedding) = 128
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    u AS (SELECT l.node_id, lower(n.name) AS name, n.path, n.line_start, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS norm FROM latest l JOIN n USING (node_id) WHERE n.node_type = 'Function'),
    p AS (SELECT a.node_id AS node_id_a, b.node_id AS node_id_b, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / (a.norm * b.norm) AS s,
        coalesce(a.path = b.path AND abs(a.line_start - b.line_start) < 5, false) AS near FROM u a JOIN u b ON a.node_id < b.node_id WHERE a.norm > 0 AND b.norm > 0)
    SELECT node_id_a, node_id_b, round(s, 6) AS similarity FROM p WHERE s >= 0.7 AND NOT near"""
)
def v4_duplicates(spark, folder):
    v = vectors.latest(table(spark, folder, "symbol_vectors"), 128)
    return vectors.duplicates(nodes(spark, folder), v, 0.7, None).withColumn("similarity", F.round("similarity", 6))


@query(
    f"""WITH {_UNIT}, p AS (SELECT a.vec_id AS query_id, b.vec_id AS node_id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / (a.len * b.len), 12) AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id) AS k FROM p WHERE s > 0.1)
    SELECT query_id, node_id, round(s, 6) AS similarity FROM r WHERE k <= 10""",
    graph=False,
)
def v5_similar(spark, folder):
    """Queries are the rows whose id is divisible by 50, against all rows."""
    v = _embeddings(spark, folder)
    return vectors.similar(v, v.where("node_id % 50 = 0")).withColumn("similarity", F.round("similarity", 6))


@query(
    f"""WITH RECURSIVE {_UNIT}, l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / (a.len * b.len) >= 0.4),
    seeds AS (SELECT a, list(b ORDER BY b) AS bs, row_number() OVER (ORDER BY a) AS k FROM l GROUP BY a),
    s(k, nodes, leaders) AS (
        SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[])
        UNION ALL
        SELECT t.k, CASE WHEN list_contains(s.nodes, t.a) THEN s.nodes ELSE list_concat(s.nodes, list_filter(t.bs, lambda x: NOT list_contains(s.nodes, x))) END,
            CASE WHEN list_contains(s.nodes, t.a) THEN s.leaders ELSE list_concat(s.leaders, list_transform(list_filter(t.bs, lambda x: NOT list_contains(s.nodes, x)), lambda x: t.a)) END
        FROM s JOIN seeds t ON t.k = s.k + 1
    ),
    last AS (SELECT nodes, leaders FROM s ORDER BY k DESC LIMIT 1),
    pairs AS (SELECT unnest(leaders) AS leader, unnest(nodes) AS node_id FROM last)
    SELECT leader, node_id FROM pairs UNION SELECT leader, leader FROM pairs""",
    graph=False,
)
def v6_clusters(spark, folder):
    return vectors.clusters(_embeddings(spark, folder), 0.4)


@query()
def v7_compare(spark, folder):
    n, e = nodes(spark, folder), edges(spark, folder)
    v = vectors.latest(table(spark, folder, "symbol_vectors"), 128)
    pair = [r[0] for r in n.where("node_type = 'Function'").join(v, "node_id", "left_semi").orderBy("node_id").limit(2).select("node_id").collect()]
    return vectors.compare(n, e, v, pair[0], pair[-1])


@query()
def v2_symbol_vectors(spark, folder):
    return vectors.symbol_vectors(nodes(spark, folder))


@query("SELECT vec_id AS node_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm FROM embeddings", graph=False)
def expr_norms(spark, folder):
    return _embeddings(spark, folder).select("node_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))

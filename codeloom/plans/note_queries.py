"""Queries over history, notes and context.

Commits are the documents of the source "commits": the first line of the text is the subject, the rest the body. Notes are the documents that have a
kind; every seventh ended thirty days after it began.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import context, history, notes
from codeloom.plans.registry import edges, nodes, query
from codeloom.plans.search_queries import _ENTRY, _TESTNODE, LAYERS
from codeloom.session import table

_COMMITS = "commits AS (SELECT CAST(doc_id AS VARCHAR) AS hash, string_split(text, chr(10))[1] AS subject, CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body, created_at AS author_date FROM documents WHERE lower(trim(source)) = 'commits' AND text IS NOT NULL)"
_PATTERN = r"""CASE WHEN regexp_matches(s, '^(fix:|fix\(|bug:|bugfix:)') THEN 'BugFix/0.9' WHEN regexp_matches(s, '^breaking:') OR regexp_matches(b, 'breaking change|^breaking:') THEN 'BreakingChange/0.95' WHEN regexp_matches(s, '^(deprecate:|deprecated:)') THEN 'Deprecation/0.9'
    WHEN starts_with(s, 'revert') THEN 'Revert/0.95' WHEN regexp_matches(s, '^(arch:|adr:|decision:)') OR regexp_matches(b, 'architectural decision|adr-') THEN 'ArchitecturalDecision/0.85' WHEN regexp_matches(s, '^(feat:|feat\(|feature:|add:)') THEN 'Feature/0.8'
    WHEN regexp_matches(s, '^(refactor:|refactor\(|cleanup:|clean:)') THEN 'Refactor/0.8' WHEN regexp_matches(s, '^(docs:|doc:|documentation:)') THEN 'Documentation/0.9' WHEN regexp_matches(s, '^(test:|tests:|testing:)') THEN 'Test/0.9'
    WHEN regexp_matches(s, 'fixed |fixes |fixing |closes #|fixes #|bug |bugfix|hotfix|patch |resolve |resolved |resolves |crash|error handling|workaround') THEN 'BugFix/0.75' WHEN regexp_matches(s, 'breaking|incompatible') THEN 'BreakingChange/0.8'
    WHEN contains(s, 'deprecat') OR contains(b, 'deprecat') THEN 'Deprecation/0.75' WHEN regexp_matches(s, 'test|spec |coverage') THEN 'Test/0.7' WHEN regexp_matches(s, 'readme|document|comment|changelog') THEN 'Documentation/0.7'
    WHEN regexp_matches(s, 'refactor|restructur|reorganiz|simplif|clean up|cleanup|move |rename |extract ') THEN 'Refactor/0.7' WHEN regexp_matches(s, 'added |adding |implement|introduce|new |support for|enable ') THEN 'Feature/0.7' ELSE 'Other/0.5' END"""
_CLASSED = f"{_COMMITS}, low AS (SELECT *, lower(subject) AS s, lower(body) AS b FROM commits), classed AS (SELECT hash, subject, body, author_date, string_split({_PATTERN}, '/') AS p FROM low)"
_NOTES = """notes AS (SELECT CAST(doc_id AS VARCHAR) AS id, kind, title, text AS content, list_filter([lang, lower(trim(source))], lambda x: x IS NOT NULL) AS tags, created_at AS valid_at, CASE WHEN doc_id % 7 = 0 THEN created_at + INTERVAL 30 DAY END AS invalid_at,
    ingested_at AS created_at FROM documents WHERE kind IS NOT NULL)"""


def commits(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where(F.lower(F.trim("source")).eqNullSafe("commits") & F.col("text").isNotNull())
    cut = F.instr("text", "\n")
    body = F.when(cut > 0, F.expr("substr(text, instr(text, '\n') + 1)")).otherwise("")
    return docs.select(F.col("doc_id").cast("string").alias("hash"), F.substring_index("text", "\n", 1).alias("subject"), body.alias("body"), F.col("project").alias("author_name"), F.col("created_at").alias("author_date"))


def all_notes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("kind IS NOT NULL")
    ended = F.when(F.col("doc_id") % 7 == 0, F.col("created_at") + F.expr("INTERVAL 30 DAYS"))
    return docs.select(
        F.col("doc_id").cast("string").alias("id"), "kind", "title", F.col("text").alias("content"), F.filter(F.array("lang", F.lower(F.trim("source"))), lambda x: x.isNotNull()).alias("tags"),
        F.array(F.struct(F.col("doc_id").alias("node_id"), F.lit(1.0).alias("relevance"))).alias("code_links"), F.col("created_at").alias("valid_at"), ended.alias("invalid_at"),
        F.col("ingested_at").alias("created_at"), F.lit(None).cast("timestamp").alias("superseded_at"), F.lit(None).cast("string").alias("commit_hash"), F.lit(None).cast("array<float>").alias("embedding"),
    )


@query(
    f"""WITH {_CLASSED} SELECT hash, p[1] AS pattern, CAST(p[2] AS DOUBLE) AS confidence, CASE WHEN regexp_matches(subject, '#\\d+') THEN '#' || regexp_extract(subject, '#(\\d+)', 1) WHEN regexp_matches(subject, '(?i)gh-\\d+') THEN '#' || regexp_extract(subject, '(?i)gh-(\\d+)', 1) END AS issue,
    CASE WHEN p[1] = 'BugFix' THEN 'debug_context' WHEN p[1] = 'ArchitecturalDecision' OR (p[1] = 'Feature' AND octet_length(encode(body)) > 50) THEN 'architectural_decision' WHEN p[1] IN ('BreakingChange', 'Deprecation', 'Revert') THEN 'known_issue' END AS kind FROM classed""",
    graph=False,
)
def expr_commit_pattern(spark, folder):
    return history.classify(commits(spark, folder)).select("hash", "pattern", "confidence", "issue", "kind")


@query(
    f"""WITH {_CLASSED}, recent AS (SELECT * FROM classed ORDER BY author_date DESC NULLS LAST, hash LIMIT 500),
    k AS (SELECT hash, subject, p[1] AS pattern, CAST(p[2] AS DOUBLE) AS confidence, CASE WHEN p[1] = 'BugFix' THEN 'debug_context' WHEN p[1] = 'ArchitecturalDecision' OR (p[1] = 'Feature' AND octet_length(encode(body)) > 50) THEN 'architectural_decision' WHEN p[1] IN ('BreakingChange', 'Deprecation', 'Revert') THEN 'known_issue' END AS kind FROM recent),
    files AS (SELECT DISTINCT CAST(file_id AS VARCHAR) AS hash, path FROM source_files), linked AS (SELECT f.hash, node_id, row_number() OVER (PARTITION BY f.hash, f.path ORDER BY node_id) AS r FROM files f JOIN n USING (path)),
    links AS (SELECT hash, list(DISTINCT node_id ORDER BY node_id) AS links FROM linked WHERE r <= 5 GROUP BY hash)
    SELECT k.hash, pattern, confidence, kind, CASE pattern WHEN 'Deprecation' THEN 'Deprecated: ' || subject WHEN 'Revert' THEN 'Reverted: ' || subject ELSE subject END AS title,
    CASE WHEN pattern = 'BreakingChange' THEN 'high' WHEN kind = 'known_issue' THEN 'medium' END AS severity, coalesce(links, []) AS links FROM k LEFT JOIN links USING (hash) WHERE kind IS NOT NULL AND confidence >= 0.7"""
)
def r1_mine_history(spark, folder):
    files = table(spark, folder, "source_files").select(F.col("file_id").cast("string").alias("hash"), "path").distinct()
    known = spark.createDataFrame([], "hash string")
    return history.mine(commits(spark, folder), files, nodes(spark, folder), known)


@query(f"WITH {_COMMITS} SELECT hash, subject FROM commits WHERE regexp_matches(subject || chr(10) || body, '(?i)ledger')", graph=False)
def s15_grep(spark, folder):
    return history.grep(commits(spark, folder), "ledger").select("hash", "subject")


@query(
    f"""WITH {_COMMITS}, two AS (SELECT hash, subject, 2 AS stage, author_date FROM commits WHERE author_date >= TIMESTAMP '2025-01-01' AND regexp_matches(subject || chr(10) || body, '(?i)bundle') ORDER BY author_date DESC, hash LIMIT 10),
    three AS (SELECT hash, subject, 3 AS stage, author_date FROM commits WHERE author_date >= TIMESTAMP '2025-01-01' ORDER BY author_date DESC, hash LIMIT 10),
    one AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY stage) AS k FROM (SELECT * FROM two UNION ALL SELECT * FROM three))
    SELECT hash, subject, stage FROM one WHERE k = 1 ORDER BY stage, author_date DESC, hash LIMIT 10""",
    graph=False,
)
def r4_search_history(spark, folder):
    return history.search(commits(spark, folder), None, "bundle", since="2025-01-01 00:00:00")


@query(f"WITH {_NOTES} SELECT kind, count(*) AS notes, count(*) FILTER (invalid_at IS NULL) AS current, count(*) FILTER (invalid_at IS NOT NULL) AS invalidated FROM notes GROUP BY kind", graph=False)
def m7_notes_by_kind(spark, folder):
    return notes.by_kind(all_notes(spark, folder))


@query(f"WITH {_NOTES} SELECT tag, count(*) AS notes FROM (SELECT unnest(tags) AS tag FROM notes WHERE invalid_at IS NULL) GROUP BY tag", graph=False)
def m7_notes_by_tag(spark, folder):
    return notes.tag_counts(all_notes(spark, folder))


@query(f"WITH {_NOTES} SELECT id, title FROM notes WHERE list_contains(tags, 'wiki')", graph=False)
def r7_by_tag(spark, folder):
    return notes.by_tag(all_notes(spark, folder), "wiki").select("id", "title")


@query(f"WITH {_NOTES} SELECT id FROM notes WHERE valid_at <= TIMESTAMP '2025-03-01' AND (invalid_at IS NULL OR TIMESTAMP '2025-03-01' < invalid_at) AND created_at <= TIMESTAMP '2025-03-01'", graph=False)
def expr_as_of(spark, folder):
    return notes.as_of(all_notes(spark, folder), F.lit("2025-03-01 00:00:00").cast("timestamp")).select("id")


@query(f"WITH {_NOTES} SELECT id, CAST(30 * 86400 AS BIGINT) AS seconds FROM notes WHERE invalid_at IS NOT NULL", graph=False)
def expr_valid_seconds(spark, folder):
    return notes.valid_seconds(all_notes(spark, folder))


@query(
    f"""WITH {_NOTES}, f AS (SELECT id, list_filter(regexp_split_to_array(lower(concat_ws(' ', title, content, array_to_string(tags, ' '))), '[^\\p{{L}}\\p{{Nl}}\\p{{N}}]+'), lambda w: octet_length(encode(w)) > 2) AS t FROM notes WHERE invalid_at IS NULL),
    w AS (SELECT id, unnest(t) AS term FROM f), posted AS (SELECT term, id, count(*) AS tf FROM w GROUP BY ALL), corpus AS (SELECT count(*) AS k, sum(len(t)) / count(*) AS average FROM f), df AS (SELECT term, count(*) AS df FROM posted WHERE term IN ('ledger', 'pinned') GROUP BY term),
    s AS (SELECT p.id, sum(ln((k - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(f.t) / average))) AS score FROM posted p JOIN df USING (term) JOIN f USING (id), corpus GROUP BY p.id),
    top AS (SELECT id, 0.3 * score AS score FROM (SELECT * FROM s ORDER BY score DESC, id LIMIT 30) ORDER BY 0.3 * score DESC, id LIMIT 10),
    one AS (SELECT top.id, n.title, top.score, row_number() OVER (PARTITION BY coalesce(n.title, top.id) ORDER BY top.score DESC, top.id) AS k FROM top JOIN notes n USING (id))
    SELECT id, title, round(score, 6) AS score FROM one WHERE k = 1""",
    graph=False,
)
def r8_search_notes(spark, folder):
    return notes.search(all_notes(spark, folder), "pinned ledger").withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_NOTES}, c AS (SELECT * FROM notes WHERE invalid_at IS NULL AND kind IN ('convention', 'known_issue')), u AS (SELECT *, row_number() OVER (PARTITION BY coalesce(title, id) ORDER BY created_at DESC NULLS LAST, id) AS k FROM c)
    SELECT id, kind, title, (SELECT count(*) FROM u WHERE k = 1) AS total FROM u WHERE k = 1 ORDER BY created_at DESC NULLS LAST, id LIMIT 50 OFFSET 10""",
    graph=False,
)
def r10_list_notes(spark, folder):
    return notes.listed(all_notes(spark, folder), kinds=["convention", "known_issue"], offset=10)


@query(f"WITH {_NOTES} SELECT id FROM notes WHERE invalid_at IS NULL AND CAST(id AS BIGINT) IN (SELECT node_id FROM nodes WHERE node_type = 'Class')", graph=False)
def r12_touched_notes(spark, folder):
    removed = nodes(spark, folder).where("node_type = 'Class'").select("node_id")
    return notes.touched_by(all_notes(spark, folder), removed)


@query(f"WITH {_NOTES}, o AS (SELECT unnest(['debug_context', 'architectural_decision', 'known_issue', 'convention', 'project_context']) AS kind, unnest([0, 1, 2, 3, 4]) AS position) SELECT position, kind, count(*) AS notes FROM notes JOIN o USING (kind) WHERE invalid_at IS NULL GROUP BY ALL", graph=False)
def r13_grouped_notes(spark, folder):
    return notes.grouped(all_notes(spark, folder))


@query(f"WITH {_NOTES} SELECT id, kind, CAST(1 AS BIGINT) AS version FROM notes WHERE kind <> 'convention' AND title IS NULL AND invalid_at IS NULL", graph=False)
def r6_note_log(spark, folder):
    """The current notes after conventions were deleted and the titled of the rest ended."""
    base = all_notes(spark, folder)
    log = base.withColumns({"version": F.lit(1).cast("bigint"), "deleted": F.lit(False)})
    log = notes.delete(log, base.where("kind = 'convention'"), 2)
    log = notes.invalidate(log, base.where("title IS NOT NULL"), F.lit("2025-06-01 00:00:00").cast("timestamp"), 3)
    return notes.latest(log).where(notes.is_current()).select("id", "kind", "version")


# Context -------------------------------------------------------------------------------------------------------------

_CODE = """src AS (SELECT project, path, string_split(code, chr(10)) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY indexed_at DESC) AS k FROM source_files) WHERE k = 1 AND code IS NOT NULL),
    code AS (SELECT node_id, array_to_string(lines[line_start:line_end], chr(10)) AS code FROM n JOIN src USING (project, path) WHERE line_start > 0 AND line_end <= len(lines) AND line_end >= line_start),
    calls AS (SELECT DISTINCT src, dst FROM e WHERE edge_type = 'Calls')"""
_ISTEST = "coalesce(starts_with(name, 'test_') OR ends_with(name, '_test') OR contains(path, '/test'), false)"


def bodies(spark, folder):
    files = table(spark, folder, "source_files")
    newest = files.groupBy("project", "path").agg(F.max_by("code", "indexed_at").alias("code"))
    return context.bodies(nodes(spark, folder), newest)


@query(f"WITH {_CODE} SELECT node_id, floor(octet_length(encode(code)) / 4) AS tokens FROM code")
def s21_source_text(spark, folder):
    from codeloom.functions.rules import tokens_estimate

    return bodies(spark, folder).select("node_id", tokens_estimate(F.col("code")).cast("double").alias("tokens"))


_SIZES = "sizes AS (SELECT node_id, CAST(floor(octet_length(encode(code)) / 4) AS BIGINT) AS size FROM code)"
_NAMED = "named AS (SELECT node_id FROM n WHERE name IS NOT NULL), fns AS (SELECT node_id, name, path FROM n WHERE node_type = 'Function' AND name IS NOT NULL)"


@query(
    f"""WITH {_CODE}, {_SIZES}, {_NAMED},
    own AS (SELECT c.dst AS node_id, c.src AS other FROM calls c JOIN fns f ON f.node_id = c.dst JOIN named m ON m.node_id = c.src),
    twins AS (SELECT a.node_id, c.src AS other FROM fns a JOIN fns b ON a.name = b.name AND a.node_id <> b.node_id JOIN calls c ON c.dst = b.node_id JOIN named m ON m.node_id = c.src WHERE a.node_id NOT IN (SELECT node_id FROM own)),
    calling AS (SELECT DISTINCT node_id, other, 'callers' AS section, 'caller' AS relation FROM (SELECT * FROM own UNION ALL SELECT * FROM twins)),
    entries AS (SELECT node_id FROM (SELECT node_id, {_ENTRY} AS entry FROM n WHERE node_type = 'Function' AND name IS NOT NULL) WHERE entry = 'test_entry' ORDER BY node_id LIMIT 20),
    walk(start, node, depth) AS (SELECT c.src, c.dst, 1 FROM calls c JOIN entries t ON t.node_id = c.src UNION SELECT w.start, c.dst, w.depth + 1 FROM walk w JOIN calls c ON c.src = w.node WHERE w.depth < 3),
    led AS (SELECT DISTINCT node AS node_id, start AS other, 'tests' AS section, 'calls_target' AS relation FROM walk WHERE node <> start AND node IN (SELECT node_id FROM fns)),
    beside AS (SELECT f.node_id, t.node_id AS other, 'tests' AS section, 'same_file' AS relation FROM fns f JOIN (SELECT * FROM n WHERE node_type = 'Function' AND name IS NOT NULL AND coalesce({_TESTNODE}, false)) t ON t.path = f.path AND t.node_id <> f.node_id),
    every AS (SELECT * FROM calling UNION ALL SELECT * FROM led UNION ALL SELECT * FROM beside WHERE (node_id, other) NOT IN (SELECT node_id, other FROM led)),
    placed AS (SELECT v.*, row_number() OVER (PARTITION BY v.node_id, section ORDER BY relation, other) AS position, CASE WHEN relation = 'same_file' THEN 0 ELSE coalesce(size, 0) END AS tokens FROM every v LEFT JOIN sizes ON sizes.node_id = other),
    shown AS (SELECT * FROM placed WHERE position <= CASE WHEN section = 'tests' THEN 5 ELSE 10 END),
    b AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY node_id, section ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM shown)
    SELECT node_id, other, section, relation, position, CAST(tokens AS BIGINT) AS tokens FROM b WHERE before < CASE WHEN section = 'tests' THEN 160 ELSE 200 END"""
)
def c2_edit_context(spark, folder):
    return context.edit_context(nodes(spark, folder), edges(spark, folder), bodies(spark, folder), 800)


@query(
    f"""WITH {_CODE}, {_SIZES}, fn AS (SELECT DISTINCT src AS node_id, dst AS other FROM calls), rn AS (SELECT DISTINCT dst AS node_id, src AS other FROM calls),
    uses AS (SELECT node_id, other, 'uses' AS relation, 1.0 AS relevance, row_number() OVER (PARTITION BY node_id ORDER BY other) AS position FROM fn), by_ AS (SELECT node_id, other, 'called_by' AS relation, 0.8 AS relevance, row_number() OVER (PARTITION BY node_id ORDER BY other) AS position FROM rn),
    every AS (SELECT * FROM uses WHERE position <= 5 UNION ALL SELECT * FROM by_ WHERE position <= 3), sized AS (SELECT v.*, coalesce(size, 0) AS tokens FROM every v LEFT JOIN sizes ON sizes.node_id = other),
    lists AS (SELECT node_id, list({{'o': other, 'r': relation, 'v': relevance, 'p': position, 't': tokens}} ORDER BY -relevance, relation, position, other) AS l FROM sized GROUP BY node_id),
    taken AS (SELECT node_id, list_reduce(l, lambda a, x: {{'left': CASE WHEN x.t <= a.left THEN a.left - x.t ELSE a.left END, 'kept': CASE WHEN x.t <= a.left THEN list_append(a.kept, x) ELSE a.kept END}}, {{'left': CAST(300 AS BIGINT), 'kept': l[1:0]}}) AS s FROM lists),
    rows_ AS (SELECT node_id, unnest(s.kept) AS x FROM taken)
    SELECT node_id, x.o AS other, x.r AS relation, CAST(x.v AS DOUBLE) AS relevance, x.p AS position, x.t AS tokens FROM rows_"""
)
def c1_ai_context(spark, folder):
    return context.ai_context(nodes(spark, folder), edges(spark, folder), bodies(spark, folder), "explain", 300)


@query()
def c1_ai_context_debug(spark, folder):
    return context.ai_context(nodes(spark, folder), edges(spark, folder), bodies(spark, folder), "debug", 300)


@query("WITH d AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY edge_id) AS k FROM e WHERE edge_type = 'Imports') SELECT d.src AS node_id, d.dst AS other, n.name FROM d JOIN n ON n.node_id = d.dst WHERE k <= 10 AND n.name <> ''")
def c1_dependencies(spark, folder):
    return context.dependencies(nodes(spark, folder), edges(spark, folder))


@query(
    """WITH t AS (SELECT n.path, e.dst, min(e.edge_id) AS edge_id FROM e JOIN n ON n.node_id = e.src WHERE e.edge_type = 'Imports' AND n.path IS NOT NULL GROUP BY n.path, e.dst),
    r AS (SELECT t.path, m.name, row_number() OVER (PARTITION BY t.path ORDER BY t.edge_id, t.dst) AS position FROM t JOIN n m ON m.node_id = t.dst WHERE m.name <> '') SELECT * FROM r WHERE position <= 20"""
)
def c1_file_imports(spark, folder):
    return context.file_imports(nodes(spark, folder), edges(spark, folder))


@query(
    """WITH f AS (SELECT * FROM n WHERE node_type = 'Function' AND name <> '' AND path IS NOT NULL),
    p AS (SELECT a.node_id, b.node_id AS other, b.name, coalesce(b.signature, b.name) AS signature, coalesce(b.visibility, CASE WHEN b.is_public THEN 'public' ELSE 'private' END) AS visibility, b.line_start,
        row_number() OVER (PARTITION BY a.node_id ORDER BY b.line_start, b.node_id) AS k FROM f a JOIN f b ON a.path = b.path AND a.node_id <> b.node_id) SELECT * EXCLUDE k FROM p WHERE k <= 10"""
)
def c1_siblings(spark, folder):
    return context.siblings(nodes(spark, folder))


@query(
    """WITH f AS (SELECT e.src, list(DISTINCT n.name ORDER BY n.name) AS paths FROM e JOIN n ON n.node_id = e.dst WHERE e.edge_type = 'Calls' AND regexp_matches(lower(n.name), 'error|err|panic|throw|fail|exception') GROUP BY e.src)
    SELECT n.node_id, 1 AS complexity, 0 AS branches, 0 AS exception_handlers, 0 AS early_returns, 0 AS nesting_depth, coalesce(f.paths, []) AS error_paths FROM n LEFT JOIN f ON f.src = n.node_id WHERE node_type = 'Function'"""
)
def c1_debug_hints(spark, folder):
    return context.debug_hints(nodes(spark, folder), edges(spark, folder))


@query(
    r"""WITH m AS (SELECT node_id, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS module FROM n WHERE path <> ''),
    b AS (SELECT src AS node_id, dst AS other, CASE lower(edge_type) WHEN 'calls' THEN 'calls' WHEN 'imports' THEN 'imports' ELSE 'depends_on' END AS r FROM e
        UNION SELECT dst, src, CASE lower(edge_type) WHEN 'calls' THEN 'called_by' WHEN 'imports' THEN 'imported_by' ELSE 'depended_on_by' END FROM e)
    SELECT b.node_id, o.module, string_agg(DISTINCT r, ', ' ORDER BY r) AS relationship FROM b JOIN m s ON s.node_id = b.node_id JOIN m o ON o.node_id = b.other WHERE o.module <> s.module GROUP BY b.node_id, o.module"""
)
def c1_neighbour_modules(spark, folder):
    return context.neighbour_modules(nodes(spark, folder), edges(spark, folder))


@query(
    """WITH u AS (SELECT CAST(vec_id AS VARCHAR) AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL), q AS (SELECT v AS w FROM u ORDER BY CAST(id AS BIGINT) LIMIT 1),
    s AS (SELECT id, list_sum(list_transform(list_zip(v, w), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(w, lambda x: x * x)))) AS c FROM u, q)
    SELECT id, round(c, 6) AS cosine FROM s ORDER BY c DESC, id LIMIT 10""",
    graph=False,
)
def v8_nearest_notes(spark, folder):
    """Embeddings as the vectors of notes, the first of them asked for."""
    v = table(spark, folder, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    asked = v.orderBy(F.col("id").cast("bigint")).select("embedding").first()
    return notes.nearest(v, [float(x) for x in asked[0]] if asked else [1.0]).withColumn("cosine", F.round("cosine", 6))


@query()
def c3_curated_context(spark, folder):
    from codeloom.operators import search
    from codeloom.plans.search_queries import _index

    n, e = nodes(spark, folder), edges(spark, folder)
    ranked = search.symbol_search(n, *_index(n), "merge bundle", None, 15).select("node_id", "score")
    return context.curated_context(ranked, n, e, bodies(spark, folder))


@query()
def c1_usages(spark, folder):
    return context.usages(nodes(spark, folder), edges(spark, folder), bodies(spark, folder))


@query(
    f"""WITH layers AS ({LAYERS}), links AS (SELECT DISTINCT src, dst FROM e WHERE edge_type IN ('Imports', 'ImportsFrom')), f AS (SELECT node_id, path FROM n WHERE node_type = 'CodeFile' AND path IS NOT NULL)
    SELECT f.path, layer, (SELECT count(*) FROM links WHERE src = f.node_id) AS imports, (SELECT count(*) FROM links WHERE dst = f.node_id) AS imported_by FROM f LEFT JOIN layers USING (path)"""
)
def c1_architecture(spark, folder):
    return context.architecture(nodes(spark, folder), edges(spark, folder))

"""Queries that search text and attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import rules
from codeloom.operators import search
from codeloom.plans.graph_queries import _CALLS, _TOP, _UNRESOLVED, most_called, with_unresolved
from codeloom.plans.registry import edges, nodes, query
from codeloom.session import table

_TOK = "list_filter(regexp_split_to_array(lower(regexp_replace(coalesce({0}, ''), '(^|[^A-ZÀ-ÖØ-Þ])([A-ZÀ-ÖØ-Þ])', '\\1_\\2', 'g')), '[^\\p{{L}}\\p{{Nl}}\\p{{N}}]+'), lambda w: octet_length(encode(w)) >= 2)"
_POSTINGS = f"""fields AS (SELECT node_id, {_TOK.format("name")} AS nt, {_TOK.format("docstring")} AS dt FROM n),
    words AS (SELECT node_id, unnest(nt) AS term, 3.0 AS w FROM fields UNION ALL SELECT node_id, unnest(dt), 2.0 FROM fields),
    posted AS (SELECT term, node_id, count(*) AS tf, max(w) AS weight FROM words GROUP BY term, node_id),
    stats AS (SELECT node_id, len(nt) + len(dt) AS doc_len, CASE WHEN len(nt) > 0 AND len(dt) > 0 THEN 'Multiple' WHEN len(dt) > 0 THEN 'Docstring' ELSE 'SymbolName' END AS reason FROM fields),
    corpus AS (SELECT count(*) AS k, sum(doc_len) / count(*) AS average FROM stats)"""


def _scores(words: str) -> str:
    listed = ", ".join(f"('{w}')" for w in words.split())
    return f"""asked AS (SELECT term, count(*) AS c FROM (VALUES {listed}) AS v(term) GROUP BY term), df AS (SELECT term, count(*) AS df FROM posted WHERE term IN (SELECT term FROM asked) GROUP BY term),
    ranked AS (SELECT p.node_id, sum(ln((k - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * s.doc_len / average)) * weight * c) AS score
        FROM posted p JOIN asked USING (term) JOIN df USING (term) JOIN stats s USING (node_id), corpus GROUP BY p.node_id)"""


def _index(n: DataFrame) -> tuple[DataFrame, DataFrame]:
    fields = search.index_fields(n)
    return search.postings(fields), search.doc_stats(fields)


@query(f"WITH {_POSTINGS} SELECT term, node_id, tf, CAST(weight AS DOUBLE) AS weight FROM posted")
def t1_postings(spark, folder):
    return _index(nodes(spark, folder))[0]


@query(f"WITH {_POSTINGS} SELECT * FROM stats")
def t2_doc_stats(spark, folder):
    return _index(nodes(spark, folder))[1]


@query(f"WITH {_POSTINGS} SELECT term, count(*) AS df, round(ln((any_value(k) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM posted, corpus GROUP BY term")
def t3_idf(spark, folder):
    return search.inverse_frequencies(*_index(nodes(spark, folder))).withColumn("idf", F.round("idf", 6))


@query(f"WITH {_POSTINGS}, {_scores('returns cached ledger')} SELECT node_id, round(score, 6) AS score FROM ranked ORDER BY ranked.score DESC, node_id LIMIT 20")
def t4_bm25(spark, folder):
    return search.bm25(*_index(nodes(spark, folder)), "returns cachedLedger").withColumn("score", F.round("score", 6))


@query(f"WITH {_POSTINGS}, {_scores('returns cached ledger')} SELECT node_id, round(score, 6) AS score FROM ranked ORDER BY ranked.score DESC, node_id LIMIT 20")
def t4_stored_index(spark, folder):
    """The same from an index that is written and read by the buckets of the query's words."""
    from codeloom.session import Scratch

    place = Scratch(spark, "words").root
    search.save_index(*_index(nodes(spark, folder)), place, 16)
    return search.search_index(search.open_index(spark, place), "returns cachedLedger").withColumn("score", F.round("score", 6))


@query(f"WITH {_POSTINGS} SELECT (SELECT count(*) FROM stats) AS documents, (SELECT count(DISTINCT term) FROM posted) AS terms")
def t5_index_stats(spark, folder):
    return search.index_stats(*_index(nodes(spark, folder)))


@query("SELECT node_id, name FROM n WHERE contains(lower(name), 'ledger')")
def t7_by_name(spark, folder):
    return search.by_name(nodes(spark, folder), "Ledger").select("node_id", "name")


_COSINES = """latest AS (SELECT node_id, embedding FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY embedded_at DESC, ingested_at DESC) AS k FROM symbol_vectors) WHERE k = 1 AND len(embedding) = 128
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    norms AS (SELECT node_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS norm FROM latest),
    asked_vector AS (SELECT embedding AS qe, norm AS qn FROM norms WHERE norm > 0 ORDER BY node_id LIMIT 1),
    cosines AS (SELECT node_id, list_sum(list_transform(list_zip(embedding, qe), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / (norm * qn) AS cosine FROM norms, asked_vector WHERE norm > 0)"""


def _similar(spark: SparkSession, folder: str) -> DataFrame:
    from codeloom.operators.vectors import cosine_to, latest

    v = latest(table(spark, folder, "symbol_vectors"), 128)
    first = v.orderBy("node_id").select("embedding").first()
    return cosine_to(v, list(first[0]) if first else [1.0] * 128)


@query(
    f"""WITH {_POSTINGS}, {_scores('merge bundle')}, {_COSINES},
    words_top AS (SELECT node_id, score FROM ranked ORDER BY score DESC, node_id LIMIT 40), near AS (SELECT node_id, cosine FROM cosines WHERE cosine > 0.1 ORDER BY cosine DESC, node_id LIMIT 40),
    both_ AS (SELECT coalesce(w.node_id, v.node_id) AS node_id, score, cosine, (SELECT max(score) FROM words_top) AS top FROM words_top w FULL JOIN near v ON w.node_id = v.node_id),
    scored AS (SELECT b.node_id, n.name, coalesce(b.score, 0) / greatest(coalesce(top, 0), 0.001) AS norm, coalesce(cosine, 0) AS c, s.reason, b.score AS raw FROM both_ b JOIN stats s USING (node_id) JOIN n USING (node_id) WHERE n.name IS NOT NULL)
    SELECT node_id, name, round(0.4 * norm + 0.6 * c, 6) AS score, CASE WHEN raw IS NULL OR (c > 0.3 AND norm < 0.01) THEN 'Semantic' ELSE reason END AS reason, count(*) OVER () AS total_matches FROM scored ORDER BY 0.4 * norm + 0.6 * c DESC, node_id LIMIT 20"""
)
def t8_symbol_search(spark, folder):
    n = nodes(spark, folder)
    return search.symbol_search(n, *_index(n), "merge bundle", _similar(spark, folder)).withColumn("score", F.round("score", 6))


@query(f"WITH {_COSINES} SELECT node_id, round(cosine, 6) AS cosine FROM cosines WHERE cosine > 0.1")
def t9_semantic_scores(spark, folder):
    return _similar(spark, folder).where("cosine > 0.1").withColumn("cosine", F.round("cosine", 6))


@query(
    """WITH cur AS (SELECT min(project) AS p FROM n) SELECT project, node_id, name, node_type, path, signature, route, http_method FROM n, cur
    WHERE project <> p AND node_type <> 'CodeFile' AND contains(lower(name), 'bundle') ORDER BY project, name, node_id LIMIT 20"""
)
def t10_cross_project(spark, folder):
    n = nodes(spark, folder)
    return search.cross_project(n, "bundle", n.agg(F.min("project")).first()[0] or "")


@query("SELECT node_id, name FROM n WHERE node_type IN ('Function', 'Class', 'Module') ORDER BY node_id LIMIT 100")
def t11_workspace_symbols(spark, folder):
    return search.workspace_symbols(nodes(spark, folder), None).select("node_id", "name")


_MODULES = "modules AS (SELECT DISTINCT n.name AS module, e.src AS node_id FROM e JOIN n ON n.node_id = e.dst WHERE e.edge_type = 'Imports' AND n.name <> ''), lib AS (SELECT min(module) AS lib FROM modules)"


def _imports(spark, folder, mode):
    from codeloom.operators.graph import import_index

    modules = import_index(nodes(spark, folder), edges(spark, folder))
    lib = modules.agg(F.min("module")).first()[0] or ""
    return search.by_imports(modules, [{"exact": lib, "prefix": lib[:4], "fuzzy": lib[1:4].upper()}[mode]], mode, None)


@query(f"WITH {_MODULES} SELECT node_id, 'imports ' || min(module) AS reason FROM modules, lib WHERE module = lib GROUP BY node_id")
def a1_imports_exact(spark, folder):
    return _imports(spark, folder, "exact")


@query(f"WITH {_MODULES} SELECT node_id, 'imports ' || min(module) AS reason FROM modules, lib WHERE starts_with(module, substr(lib, 1, 4)) GROUP BY node_id")
def a1_imports_prefix(spark, folder):
    return _imports(spark, folder, "prefix")


@query(f"WITH {_MODULES} SELECT node_id, 'imports ' || min(module) AS reason FROM modules, lib WHERE contains(lower(module), lower(substr(lib, 2, 3))) GROUP BY node_id")
def a1_imports_fuzzy(spark, folder):
    return _imports(spark, folder, "fuzzy")


def _peeled(times: int = 12) -> str:
    """Brackets taken off from the inside, which counts the same parameters as long as none is nested deeper and no arrow stands among them."""
    text = "regexp_replace(signature, '^[^(]*\\(', '(')"
    for _ in range(times):
        text = f"regexp_replace({text}, '([\\s\\S])[(\\[{{<][^()\\[\\]{{}}<>]*[)\\]}}>]', '\\1_', 'g')"
    return text


_PARAMS = f"""parts AS (SELECT node_id, CASE WHEN regexp_matches(t, '^\\([^()]*\\)') THEN list_filter(string_split(regexp_extract(t, '^\\(([^()]*)\\)', 1), ','), lambda x: trim(x, ' ') <> '') END AS p FROM (SELECT node_id, {_peeled()} AS t FROM n WHERE signature IS NOT NULL)),
    counted AS (SELECT node_id, len(p) - CASE WHEN len(p) > 0 AND regexp_full_match(trim(p[1], ' '), '(&\\s*(''\\w+\\s+)?(mut\\s+)?|mut\\s+)?self\\s*(:.*)?') THEN 1 ELSE 0 END AS k FROM parts WHERE p IS NOT NULL)"""


@query(
    f"""WITH {_PARAMS} SELECT n.node_id, name, 'name matches ''merge*''; 1-3 params; modifiers: public' AS reason FROM n LEFT JOIN counted USING (node_id) WHERE node_type = 'Function' AND name IS NOT NULL AND regexp_full_match(name, 'merge.*')
    AND coalesce(param_count, k) BETWEEN 1 AND 3 AND is_public"""
)
def a2_by_signature(spark, folder):
    return search.by_signature(nodes(spark, folder), "merge*", params=(1, 3), modifiers=["public"])


@query(f"WITH {_PARAMS} SELECT n.node_id, k AS params FROM n LEFT JOIN counted USING (node_id) WHERE node_type = 'Function' AND signature IS NOT NULL")
def a2_params_from_signature(spark, folder):
    n = nodes(spark, folder).where("node_type = 'Function' AND signature IS NOT NULL")
    return n.select("node_id", rules.params_of(F.col("signature")).cast("bigint").alias("params"))


_ENTRY = """CASE WHEN route IS NOT NULL OR http_method IS NOT NULL THEN 'http_handler' WHEN name IN ('main', '__main__') THEN 'main'
    WHEN starts_with(lower(name), 'test_') OR ends_with(lower(name), '_test') OR starts_with(name, 'Test') OR regexp_matches(path, '/test/|/tests/|/__tests__/|\\.test\\.|\\.spec\\.|_test\\.') THEN 'test_entry'
    WHEN contains(lower(name), 'command') OR contains(lower(name), 'cli') THEN 'cli_command'
    WHEN starts_with(lower(name), 'on_') OR starts_with(lower(name), 'handle_') OR ends_with(lower(name), '_handler') OR ends_with(lower(name), '_callback') THEN 'event_handler' WHEN is_public THEN 'public_api' END"""


@query(f"SELECT * FROM (SELECT node_id, name, {_ENTRY} AS entry FROM n WHERE node_type = 'Function' AND name IS NOT NULL) WHERE entry IS NOT NULL")
def a3_entry_points(spark, folder):
    return search.entry_points(nodes(spark, folder))


#: The indexed functions have no names of tests: those in files of tests get one. Asked for is the function that most tests call.
_NAMED_TESTS = "t AS (SELECT * REPLACE (CASE WHEN node_type = 'Function' AND contains(path, '/test_') THEN 'test_' || name ELSE name END AS name) FROM n)"
_TESTED = f"{_NAMED_TESTS}, tests AS (SELECT node_id, path FROM (SELECT node_id, path, {_ENTRY} AS entry FROM t WHERE node_type = 'Function' AND name IS NOT NULL) WHERE entry = 'test_entry'), top AS (SELECT e.dst AS id FROM e JOIN tests ON tests.node_id = e.src JOIN n f ON f.node_id = e.dst WHERE e.edge_type = 'Calls' AND f.node_type = 'Function' GROUP BY e.dst ORDER BY count(DISTINCT e.src) DESC, e.dst LIMIT 1)"


def named_tests(n: DataFrame) -> DataFrame:
    return n.withColumn("name", F.when((F.col("node_type") == "Function") & F.col("path").contains("/test_"), F.concat(F.lit("test_"), "name")).otherwise(F.col("name")))


def most_tested(n: DataFrame, e: DataFrame) -> int:
    tests = search.entry_points(n, ["test_entry"]).select(F.col("node_id").alias("src"))
    functions = n.where("node_type = 'Function'").select(F.col("node_id").alias("dst"))
    called = e.where("edge_type = 'Calls'").join(tests, "src", "left_semi").join(functions, "dst", "left_semi")
    first = called.groupBy("dst").agg(F.count_distinct("src").alias("k")).orderBy(F.desc("k"), "dst").first()
    return first["dst"] if first else -1


@query(
    f"""WITH {_CALLS}, {_TESTED},
    up(node, depth) AS (SELECT c.src, 1 FROM calls c JOIN top ON c.dst = top.id UNION SELECT c.src, u.depth + 1 FROM up u JOIN calls c ON c.dst = u.node WHERE u.depth < 3),
    calling AS (SELECT DISTINCT node AS node_id, 0 AS k FROM up WHERE node IN (SELECT node_id FROM tests) ORDER BY node LIMIT 20),
    same AS (SELECT node_id, 1 AS k FROM tests WHERE path = (SELECT path FROM n, top WHERE node_id = id)),
    home AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS d, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS s, regexp_extract(path, '[^/]\\.([^./]*)$', 1) AS x FROM n, top WHERE node_id = id),
    places AS (SELECT unnest([d || '/' || s || '.test.' || x, d || '/' || s || '.spec.' || x, d || '/' || s || '_test.' || x, d || '/tests/' || s || '.' || x, d || '/__tests__/' || s || '.' || x, d || '/test/' || s || '.' || x, d || '/tests/' || s || '_test.' || x]) AS path FROM home WHERE x <> ''),
    beside AS (SELECT node_id, 2 AS k FROM tests WHERE path IN (SELECT path FROM places)),
    ranked AS (SELECT node_id, min(k) AS k FROM (SELECT * FROM calling UNION ALL SELECT * FROM same UNION ALL SELECT * FROM beside) WHERE node_id <> (SELECT id FROM top) GROUP BY node_id)
    SELECT node_id, CASE k WHEN 0 THEN 'calls_target' WHEN 1 THEN 'same_file' ELSE 'adjacent_file' END AS relation FROM ranked ORDER BY k, node_id LIMIT 10"""
)
def a4_related_tests(spark, folder):
    n, e = named_tests(nodes(spark, folder)), edges(spark, folder)
    return search.related_tests(n, e, most_tested(n, e))


@query(
    r"""WITH decos AS (SELECT node_id, name, unnest(attributes) AS a, generate_subscripts(attributes, 1) AS k FROM n WHERE node_type = 'Function'),
    hits AS (SELECT node_id, name, k, regexp_replace(a, '^@+', '') AS d FROM decos),
    kinds AS (SELECT *, regexp_extract(d, '^(app\.(?:route|get|post|put|patch|delete)|router\.(?:get|post|put|patch|delete)|(?:Get|Post|Put|Patch|Delete|Request)Mapping|Get|Post|Put|Patch|Delete)', 1) AS p FROM hits),
    found AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY k) AS f FROM kinds WHERE p <> '')
    SELECT node_id, name, coalesce(nullif(regexp_extract(d, '\([^"]*"([^"]*)"', 1), ''), regexp_extract(d, '\([^'']*''([^'']*)''', 1)) AS route,
    CASE WHEN p IN ('app.route', 'RequestMapping') THEN 'ANY' ELSE upper(regexp_replace(regexp_extract(p, '([^.]*)$', 1), 'Mapping$', '')) END AS http_method FROM found WHERE f = 1"""
)
def a6_routes(spark, folder):
    return search.routes(nodes(spark, folder))


@query(
    r"""WITH raw AS (SELECT file_id AS node_id, unnest(regexp_extract_all(code, '([A-Za-z_][\w.]*)\(', 1)) AS c FROM source_files WHERE code IS NOT NULL),
    calls AS (SELECT node_id, regexp_replace(regexp_replace(c, '^app\.', 'std.http.'), '^state\.', 'my_requests.') AS callee FROM raw),
    listed AS (SELECT unnest(string_split('fetch requests.get requests.post requests.put requests.patch requests.delete httpx.get httpx.post httpx.put httpx.patch httpx.delete http.Get http.Post http.NewRequest reqwest::get axios.get axios.post axios.put axios.patch axios.delete http.get http.post http.put http.patch http.delete', ' ')) AS f)
    SELECT node_id, arg_max(CASE WHEN lower(regexp_extract(callee, '([^.:]*)$', 1)) IN ('get', 'post', 'put', 'patch', 'delete') THEN upper(regexp_extract(callee, '([^.:]*)$', 1)) ELSE 'ANY' END, callee) AS method
    FROM calls JOIN listed ON ends_with(callee, f) GROUP BY node_id""",
    graph=False,
)
def a7_http_clients(spark, folder):
    """What files call, with two receivers renamed to clients, one of them behind other letters."""
    raw = table(spark, folder, "source_files").where("code IS NOT NULL").select(F.col("file_id").alias("node_id"), F.explode(F.regexp_extract_all("code", F.lit(r"([A-Za-z_][\w.]*)\("), 1)).alias("c"))
    return search.http_clients(raw.select("node_id", F.regexp_replace(F.regexp_replace("c", r"^app\.", "std.http."), r"^state\.", "my_requests.").alias("callee")))


_SERVED = "served AS (SELECT node_id AS dst, CASE WHEN r = '' THEN '/' ELSE r END AS route FROM (SELECT node_id, regexp_replace(regexp_replace(route, '[?#].*$', ''), '/+$', '') AS r FROM n WHERE route IS NOT NULL))"


@query(
    f"""WITH {_SERVED}, asked AS (SELECT DISTINCT f.file_id AS src, CASE WHEN r = '' THEN '/' ELSE r END AS url FROM (SELECT file_id, regexp_replace(unnest(regexp_extract_all(code, '["''`](/[a-zA-Z0-9_/{{}}.-]+)', 1)), '/+$', '') AS r FROM source_files) f),
    exact AS (SELECT src, dst, route AS matched_route, 'exact' AS match_type, url FROM asked JOIN served ON url = route),
    rest AS (SELECT * FROM asked WHERE (src, url) NOT IN (SELECT src, url FROM exact)),
    split_ AS (SELECT src, url, dst, route, string_split(url, '/') AS u, string_split(route, '/') AS p FROM rest, served WHERE contains(route, '{{') AND len(string_split(url, '/')) = len(string_split(route, '/')))
    SELECT src, dst, matched_route, match_type FROM exact UNION ALL
    SELECT src, dst, route, 'pattern' FROM split_ WHERE len(list_filter(list_zip(u, p), lambda z: NOT (z[1] = z[2] OR regexp_matches(z[2], '^\\{{.*\\}}$|^:|^<.*>$')))) = 0"""
)
def a8_runtime_calls(spark, folder):
    files = table(spark, folder, "source_files").where("code IS NOT NULL")
    clients = files.select(F.col("file_id").alias("node_id"), F.explode(F.regexp_extract_all("code", F.lit(r"[\"'`](/[a-zA-Z0-9_/{}\-\.]+)"), 1)).alias("url"))
    served = nodes(spark, folder).where("route IS NOT NULL").select("node_id", "route")
    return search.runtime_calls(clients, served)


_MAP = """best AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE node_type WHEN 'Interface' THEN 3 WHEN 'Class' THEN 2 ELSE 1 END DESC,
        CASE WHEN node_type = 'Function' THEN 100 + greatest(line_end - line_start, 0) + 1 ELSE 0 END DESC, CASE WHEN node_type = 'Function' THEN node_id ELSE -node_id END) AS k FROM n WHERE node_type IN ('Function', 'Class', 'Interface') AND name <> ''),
    meant AS (SELECT name, node_id AS target FROM best WHERE k = 1)"""


@query(f"WITH {_MAP} SELECT * FROM meant")
def a9_symbol_map(spark, folder):
    return search.symbol_map(nodes(spark, folder))


@query(
    f"""WITH {_MAP}, {_UNRESOLVED}, found AS (SELECT DISTINCT u.node_id AS src, m.target AS dst FROM unresolved u JOIN meant m USING (name) WHERE u.node_id <> m.target)
    SELECT src, dst, 'Calls' AS edge_type FROM found WHERE (src, dst) NOT IN (SELECT src, dst FROM e WHERE edge_type = 'Calls')"""
)
def a9_resolution(spark, folder):
    n, e = nodes(spark, folder), edges(spark, folder)
    wanted = with_unresolved(n, e).where("unresolved_calls IS NOT NULL").select("node_id", F.explode("unresolved_calls").alias("name"))
    return search.resolve(n, e, wanted, "Calls")


_TESTNODE = "(starts_with(name, 'test_') OR ends_with(name, '_test') OR contains(name, 'test ') OR starts_with(name, 'Test') OR contains(path, '/test') OR contains(path, '.test.') OR contains(path, '.spec.') OR contains(path, '_test.'))"


@query(
    f"""SELECT node_id, coalesce({_TESTNODE}, false) AS is_test, coalesce(list_has_any(string_split(path, '/'), ['out', 'dist', 'target', 'node_modules', 'build']), false) AS is_build_output,
    CASE WHEN regexp_matches(name, '[hH]andler|[cC]allback|[lL]istener|[mM]iddleware') THEN 0.2 WHEN ends_with(name, '_tool') OR starts_with(name, 'default_') THEN 0.1 WHEN starts_with(name, 'migrate_') OR starts_with(name, 'migration_') THEN 0.2
    WHEN starts_with(name, 'on_') OR regexp_matches(name, '^on[A-Z]') OR regexp_matches(name, '^handle[A-Z]') THEN 0.2 WHEN is_public THEN 0.5 ELSE 0.9 END AS confidence FROM n"""
)
def expr_node_predicates(spark, folder):
    c = F.col
    return nodes(spark, folder).select("node_id", rules.is_test_node(c("name"), c("path"), c("is_test")).alias("is_test"), rules.is_build_output(c("path")).alias("is_build_output"), rules.unused_confidence(c("name"), c("is_public")).alias("confidence"))


LAYERS = r"""WITH p AS (SELECT DISTINCT path FROM n WHERE path IS NOT NULL), s AS (SELECT path, lower(path) AS l, regexp_replace(regexp_extract(lower(path), '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem FROM p)
    SELECT path, CASE WHEN regexp_matches(l, 'controller|routes|router|endpoints|api/') THEN 'controller' WHEN regexp_matches(l, 'view|templates|pages|components|ui/') THEN 'presentation' WHEN contains(l, 'handler') THEN 'handler'
    WHEN regexp_matches(l, 'service|usecases|use_cases|application/') THEN 'service' WHEN contains(l, 'command') THEN 'command' WHEN regexp_matches(l, 'queries|query') THEN 'query' WHEN regexp_matches(l, 'model|entities|entity|domain/') THEN 'domain'
    WHEN contains(l, 'aggregate') THEN 'aggregate' WHEN regexp_matches(l, 'value_objects|valueobjects') THEN 'value_object' WHEN regexp_matches(l, 'repositories|repository|repos') THEN 'repository' WHEN regexp_matches(l, 'database|db/|persistence') THEN 'persistence'
    WHEN regexp_matches(l, 'adapter|infrastructure/') THEN 'infrastructure' WHEN contains(l, 'client') THEN 'client' WHEN contains(l, 'provider') THEN 'provider' WHEN contains(l, 'middleware') THEN 'middleware' WHEN regexp_matches(l, 'util|helper|lib/') THEN 'utility'
    WHEN regexp_matches(l, 'config|settings') THEN 'configuration' WHEN regexp_matches(l, 'types|interfaces|contracts') THEN 'contract' WHEN regexp_matches(l, 'test|spec') THEN 'test' WHEN regexp_matches(l, 'fixtures|mocks|stubs') THEN 'test_support'
    WHEN ends_with(stem, 'repo') THEN 'repository' END AS layer FROM s"""


@query(LAYERS)
def expr_layer(spark, folder):
    return nodes(spark, folder).where("path IS NOT NULL").select("path").distinct().select("path", rules.layer(F.col("path")).alias("layer"))


@query(
    """SELECT path, CASE regexp_extract(lower(path), '\\.([^./]+)$', 1) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'rs' THEN 'rust' WHEN 'c' THEN 'c' END AS by_path,
    CASE lower(trim(language)) WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'golang' THEN 'go' WHEN 'clang' THEN 'c' ELSE lower(trim(language)) END AS by_label FROM (SELECT DISTINCT path, language FROM source_files)""",
    graph=False,
)
def s4_languages(spark, folder):
    files = table(spark, folder, "source_files").select("path", "language").distinct()
    return files.select("path", rules.language_of_path(F.col("path")).alias("by_path"), rules.canonical_language(F.col("language")).alias("by_label"))

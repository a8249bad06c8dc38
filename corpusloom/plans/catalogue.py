"""The queries of the engine by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import feedback, graph, ingest, retrieval
from corpusloom.sources.tables import newest, table

FLAGSHIP = "hybrid_retrieve"
QUESTION = "which gateway timeout delayed the shipment and the customer retry"
SERVICE, OTHER = "nm-ledger-api", "nm-audit-service"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under the function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- tables with one row for each key --------------------------------------------------------------------------
def _docs(spark, folder):
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("collection"))


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _vector(spark, folder):
    return list(table(spark, folder, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def _events(spark, folder):
    return newest(table(spark, folder, "interactions"), "id", "logged_at", ["ts", "question", "intent", "confidence", "chunk_ids", "paths", "rating", "implicit"])


def _graph(spark, folder):
    return graph.build(table(spark, folder, "repositories"), table(spark, folder, "source_files"), table(spark, folder, "incidents"))


_EVENTS = "ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(logged_at, TIMESTAMP '0001-01-01') DESC, ts DESC) AS rn FROM interactions WHERE id IS NOT NULL) WHERE rn = 1)"
_TERMS = "regexp_extract_all(lower(coalesce(text, '')), '" + T.TERM + "')"
_Q = sorted(set(retrieval._query_terms(QUESTION)))
_QLIST = "[" + ", ".join(f"'{t}'" for t in _Q) + "]"
_LEX = f"""lex AS (SELECT id, round(CASE WHEN len(t) = 0 THEN 0 ELSE len(list_intersect({_QLIST}, t)) / {len(_Q)}::DOUBLE + 0.1 * len(list_filter(t, lambda x: list_contains({_QLIST}, x))) / len(t) END, 9) AS score
 FROM (SELECT doc_id AS id, {_TERMS} AS t FROM documents))"""
_BM = f"""tok AS (SELECT doc_id AS id, {_TERMS} AS t FROM documents),
 st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM tok),
 tf AS (SELECT id, len(t) AS dl, w, len(list_filter(t, lambda x: x = w)) AS f FROM (SELECT id, t, unnest({_QLIST}) AS w FROM tok)),
 df AS (SELECT w, count(*) AS d FROM tf WHERE f > 0 GROUP BY w),
 bm AS (SELECT id, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * dl / mean))), 9) AS score FROM tf JOIN df USING (w), st WHERE f > 0 GROUP BY id)"""
_DENSE = """dn AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings)"""
_TOP = "{0}60 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT * FROM {0} {1} ORDER BY score DESC, id LIMIT 60))"
_FUSED = f"""WITH {_LEX}, {_BM}, {_DENSE}, {_TOP.format('lex', '')}, {_TOP.format('bm', '')}, {_TOP.format('dn', '')},
 fused AS (SELECT id, sum(1.0 / (60 + r)) AS s FROM (SELECT * FROM lex60 UNION ALL SELECT * FROM bm60 UNION ALL SELECT * FROM dn60) GROUP BY id)"""


# ---- retrieval ---------------------------------------------------------------------------------------------------
@query(f"WITH {_LEX} SELECT id, score FROM lex ORDER BY score DESC, id LIMIT 20")
def lexical_topk(spark, folder):
    return retrieval.lexical_rank(_docs(spark, folder), QUESTION, 20)


@query(f"WITH {_BM} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 20")
def bm25_topk(spark, folder):
    return retrieval.bm25_topk(_docs(spark, folder), QUESTION, 20)


@query(f"WITH {_DENSE} SELECT id, score FROM dn ORDER BY score DESC, id LIMIT 20")
def dense_topk(spark, folder):
    return retrieval.dense_topk(_vectors(spark, folder), _vector(spark, folder), 20)


@query(f"WITH {_DENSE} SELECT id, score FROM dn JOIN embeddings ON vec_id = id WHERE label = 2 ORDER BY score DESC, id LIMIT 10")
def dense_filtered_topk(spark, folder):
    return retrieval.dense_topk(_vectors(spark, folder), _vector(spark, folder), 10, F.col("label") == 2)


@query(_FUSED + " SELECT id, round(s, 6) AS score FROM fused")
def rrf_fusion(spark, folder):
    d = _docs(spark, folder)
    lists = [retrieval.lexical_rank(d, QUESTION, 60), retrieval.bm25_topk(d, QUESTION, 60), retrieval.dense_topk(_vectors(spark, folder), _vector(spark, folder), 60)]
    return retrieval.rrf(lists).select("id", F.round("score", 6).alias("score"))


@query(_FUSED + " SELECT id, source AS collection, round(s + CASE WHEN source = 'wiki' THEN 0.25 ELSE 0 END, 6) AS score FROM fused JOIN documents ON doc_id = id ORDER BY score DESC, id LIMIT 20")
def hybrid_retrieve(spark, folder):
    return retrieval.hybrid_retrieve(_docs(spark, folder), _vectors(spark, folder), QUESTION, _vector(spark, folder))


# ---- text functions ----------------------------------------------------------------------------------------------
@query(f"SELECT source, sum(len({_TERMS}))::BIGINT AS n_terms, sum(len(list_distinct(regexp_extract_all(coalesce(text, ''), '{T.IDENTIFIER}').list_transform(lambda x: lower(x)))))::BIGINT AS n_identifiers, sum(len(regexp_extract_all(lower(coalesce(text, '')), '{T.LEARNING}')))::BIGINT AS n_learning FROM documents GROUP BY source")
def token_counts(spark, folder):
    d = table(spark, folder, "documents")
    c = F.col("text")
    return d.groupBy("source").agg(F.sum(F.size(T.terms(c))).alias("n_terms"), F.sum(F.size(T.identifiers(c))).alias("n_identifiers"), F.sum(F.size(T.learning_terms(c))).alias("n_learning"))


@query("SELECT doc_id, greatest(1, length(coalesce(text, '')) // 4)::BIGINT AS tokens FROM documents")
def approx_tokens(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.approx_tokens(F.col("text")).alias("tokens"))


def _counts(patterns: dict[str, str]) -> str:
    return " UNION ALL ".join(f"""SELECT '{k}' AS kind, count(*) FILTER (WHERE n > 0) AS n_texts, coalesce(sum(n), 0)::BIGINT AS n_found FROM (SELECT len(regexp_extract_all(coalesce(text, ''), '{p.replace("'", "''").replace('(?im)', '(?im)')}')) AS n FROM src)""" for k, p in patterns.items())


@query(f"WITH src AS (SELECT DISTINCT id, text FROM chunks) SELECT * FROM ({_counts(T.SECRETS)}) WHERE n_texts > 0")
def secret_counts(spark, folder):
    d = table(spark, folder, "chunks").select("id", "text").distinct()
    return d.select(F.explode(T.findings(F.col("text"), T.SECRETS)).alias("f")).groupBy("f.kind").agg(F.count("*").alias("n_texts"), F.sum("f.n").cast("long").alias("n_found"))


@query(f"WITH src AS (SELECT question AS text FROM interactions) SELECT * FROM ({_counts(T.PII)}) WHERE n_texts > 0")
def pii_counts(spark, folder):
    d = table(spark, folder, "interactions")
    return d.select(F.explode(T.findings(F.col("question"), T.PII)).alias("f")).groupBy("f.kind").agg(F.count("*").alias("n_texts"), F.sum("f.n").cast("long").alias("n_found"))


@query(f"WITH src AS (SELECT text FROM documents UNION ALL SELECT question FROM interactions) SELECT * FROM ({_counts(T.INJECTIONS)}) WHERE n_texts > 0")
def injection_counts(spark, folder):
    d = table(spark, folder, "documents").select("text").unionByName(table(spark, folder, "interactions").select(F.col("question").alias("text")))
    return d.select(F.explode(T.findings(F.col("text"), T.INJECTIONS)).alias("f")).groupBy("f.kind").agg(F.count("*").alias("n_texts"), F.sum("f.n").cast("long").alias("n_found"))


def _redact_sql(c: str, patterns: dict[str, str]) -> str:
    for k, p in patterns.items():
        c = f"""regexp_replace({c}, '{p.replace("'", "''")}', '***REDACTED-{k.upper()}***', 'g')"""
    return c


@query(f"SELECT id, {_redact_sql('question', T.PII)} AS question FROM (SELECT DISTINCT id, question FROM interactions)")
def redacted_questions(spark, folder):
    return table(spark, folder, "interactions").select("id", "question").distinct().select("id", T.redact(F.col("question"), T.PII).alias("question"))


@query("""SELECT doc_id, i AS pos, array_to_string(list_slice(ws, i + 1, i + 64), ' ') AS text FROM (SELECT doc_id, ws, unnest(range(0, len(ws), 56)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '') AS ws FROM documents)) WHERE i = 0 OR i + 8 < len(ws)""")
def windowed_chunks(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.explode(T.windows(F.col("text"), 64)).alias("w")).select("doc_id", "w.pos", "w.text")


@query()
def best_sentences(spark, folder):
    """The sentence of each document with the greatest overlap with the question; the first of equals."""
    q = F.array(*[F.lit(w) for w in sorted({w.lower() for w in QUESTION.split()})])
    s = table(spark, folder, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    s = s.withColumn("overlap", F.round(T.overlap(q, T.words(F.col("sentence"))), 6))
    return s.groupBy("doc_id").agg(F.max(F.struct("overlap", (-F.col("pos")).alias("p"), "sentence")).alias("r")).select("doc_id", "r.sentence", "r.overlap")


# ---- graph -------------------------------------------------------------------------------------------------------
_EDGES = """e AS (SELECT DISTINCT * FROM (
 SELECT 'inc:' || id AS src, 'svc:' || o AS dst, 'AFFECTS' AS type FROM (SELECT id, service_name, unnest(affected_services) AS o FROM incidents) WHERE id IS NOT NULL AND service_name IS NOT NULL AND o IS NOT NULL
 UNION ALL SELECT 'svc:' || service_name, 'svc:' || o, 'CALLS' FROM (SELECT id, service_name, unnest(affected_services) AS o FROM incidents) WHERE id IS NOT NULL AND service_name <> o
 UNION ALL SELECT 'svc:' || repo, 'file:' || file_id, 'CONTAINS' FROM source_files WHERE file_id IS NOT NULL AND rel_path IS NOT NULL AND repo IS NOT NULL))"""
_NODES = """n AS (SELECT DISTINCT * FROM (SELECT 'svc:' || name AS id, 'Service' AS type, name, name AS service, NULL AS file FROM repositories WHERE name IS NOT NULL
 UNION ALL SELECT 'file:' || file_id, 'File', regexp_extract(rel_path, '([^/]*)$', 1), repo, rel_path FROM source_files WHERE file_id IS NOT NULL AND rel_path IS NOT NULL
 UNION ALL SELECT 'inc:' || id, 'Incident', id, service_name, NULL FROM incidents WHERE id IS NOT NULL))"""


@query(f"WITH {_EDGES}, {_NODES} SELECT 'node' AS what, type AS kind, count(*) AS n FROM n GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY type")
def graph_stats(spark, folder):
    return graph.stats(*_graph(spark, folder))


@query(f"WITH {_EDGES}, {_NODES}, x AS (SELECT 'out' AS direction, e.type AS edge_type, dst AS id FROM e WHERE src = 'svc:{SERVICE}' UNION ALL SELECT 'in', e.type, src FROM e WHERE dst = 'svc:{SERVICE}') SELECT x.*, n.type, n.name FROM x JOIN n USING (id)")
def neighbours(spark, folder):
    n, e = _graph(spark, folder)
    return graph.neighbours(n, e, f"svc:{SERVICE}")


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT 'svc:{SERVICE}' AS id, 0 AS level UNION SELECT e.src, r.level + 1 FROM r JOIN e ON e.dst = r.id WHERE r.level < 3) SELECT id, min(level) AS level FROM r WHERE id <> 'svc:{SERVICE}' GROUP BY id")
def impact_levels(spark, folder):
    return graph.impacted(_graph(spark, folder)[1], f"svc:{SERVICE}", 3)


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT 'svc:{SERVICE}' AS id, 0 AS level UNION SELECT e.src, r.level + 1 FROM r JOIN e ON e.dst = r.id AND e.type = 'CALLS' WHERE r.level < 2) SELECT id, min(level) AS level FROM r WHERE id <> 'svc:{SERVICE}' GROUP BY id")
def callers(spark, folder):
    return graph.impacted(_graph(spark, folder)[1], f"svc:{SERVICE}", 2, ["CALLS"])


@query(f"WITH RECURSIVE {_EDGES}, c AS (SELECT DISTINCT src, dst FROM e WHERE type = 'CALLS'), r AS (SELECT ['svc:{SERVICE}'] AS p, 'svc:{SERVICE}' AS id UNION ALL SELECT list_append(r.p, c.dst), c.dst FROM r JOIN c ON c.src = r.id WHERE r.id <> 'svc:{OTHER}' AND len(r.p) <= 3 AND NOT list_contains(r.p, c.dst)) SELECT (len(p) - 1)::INT AS hops, array_to_string(p, ' > ') AS path FROM r WHERE id = 'svc:{OTHER}' ORDER BY hops, path LIMIT 10")
def simple_paths(spark, folder):
    return graph.simple_paths(_graph(spark, folder)[1], f"svc:{SERVICE}", f"svc:{OTHER}", 3, 10, ["CALLS"])


@query(f"WITH {_EDGES}, {_NODES} SELECT DISTINCT a.service, b.service AS depends_on FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE e.type IN ('CALLS', 'DEPENDS_ON') AND a.service <> b.service")
def service_dependency_map(spark, folder):
    return graph.service_map(*_graph(spark, folder))


@query(f"WITH {_EDGES}, {_NODES} SELECT DISTINCT a.service AS dependent FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE e.type IN ('CALLS', 'DEPENDS_ON') AND a.service <> b.service AND b.service = '{SERVICE}'")
def service_dependents(spark, folder):
    return graph.service_map(*_graph(spark, folder)).where(F.col("depends_on") == SERVICE).select(F.col("service").alias("dependent"))


@query(f"WITH {_NODES} SELECT id, name, CASE WHEN lower(name) = 'ledger' THEN 100 WHEN contains(lower(name), 'ledger') THEN 60 ELSE 30 END AS score FROM n WHERE contains(lower(name), 'ledger') OR contains(lower(file), 'ledger') ORDER BY score DESC, id LIMIT 20")
def find_nodes(spark, folder):
    return graph.find_nodes(_graph(spark, folder)[0], "ledger")


@query(f"WITH {_NODES} SELECT DISTINCT service FROM n WHERE service IS NOT NULL")
def services(spark, folder):
    return _graph(spark, folder)[0].where("service IS NOT NULL").select("service").distinct()


@query("SELECT DISTINCT repo, rel_path, id FROM chunks WHERE id IS NOT NULL AND rel_path IS NOT NULL AND (start_line IS NULL OR end_line IS NULL OR NOT (end_line < 10 OR start_line > 20))")
def line_range_chunks(spark, folder):
    c = table(spark, folder, "chunks").where("id IS NOT NULL AND rel_path IS NOT NULL")
    return c.where("start_line IS NULL OR end_line IS NULL OR NOT (end_line < 10 OR start_line > 20)").select("repo", "rel_path", "id").distinct()


# ---- feedback ----------------------------------------------------------------------------------------------------
_SIG = "sg AS (SELECT id, chunk_ids, paths, CASE WHEN rating >= 4 THEN 1 WHEN rating <= 2 THEN -1 WHEN implicit = 'positive' THEN 1 WHEN implicit = 'negative' THEN -1 END AS sign, CASE WHEN rating >= 4 OR rating <= 2 THEN 1.0 ELSE 0.5 END AS w FROM ev)"
_BOOST = "SELECT key, round(greatest(-0.4, least(1.0, sum(CASE WHEN sign > 0 THEN 0.25 * w ELSE -0.175 * w END)::DOUBLE)), 4) AS boost, count(*) AS n FROM (SELECT sign, w, unnest(list_distinct({})) AS key FROM sg WHERE sign IS NOT NULL) WHERE key IS NOT NULL GROUP BY key"


@query(f"WITH {_EVENTS}, {_SIG} " + _BOOST.format("chunk_ids"))
def chunk_boosts(spark, folder):
    return feedback.boosts(_events(spark, folder), "chunk_ids")


@query(f"WITH {_EVENTS}, {_SIG} " + _BOOST.format("paths"))
def path_boosts(spark, folder):
    return feedback.boosts(_events(spark, folder), "paths")


@query(f"WITH {_EVENTS}, x AS (SELECT rating, implicit, confidence, unnest(list_distinct(chunk_ids)) AS key FROM ev), y AS (SELECT key, count(*) FILTER (WHERE rating >= 4 OR rating IS NULL AND implicit = 'positive') AS n_pos, count(*) FILTER (WHERE rating <= 2 OR rating IS NULL AND implicit = 'negative') AS n_neg, count(*) AS n_events, round(avg(confidence) + 1e-9, 6) AS avg_conf FROM x WHERE key IS NOT NULL GROUP BY key) SELECT *, (n_pos > n_neg)::INT AS label FROM y")
def feature_table(spark, folder):
    return feedback.features(_events(spark, folder))


@query()
def rephrased_questions(spark, folder):
    return feedback.rephrased(_events(spark, folder))


@query(f"WITH {_EVENTS}, x AS (SELECT id, unnest(list_distinct(paths)) AS p FROM ev WHERE len(list_distinct(paths)) BETWEEN 2 AND 20), c AS (SELECT p, count(*) AS n FROM x GROUP BY p), q AS (SELECT a.p AS path_a, b.p AS path_b, count(*) AS together FROM x a JOIN x b ON a.id = b.id AND a.p < b.p GROUP BY ALL HAVING count(*) >= 2) SELECT path_a, path_b, together, round(together / least(ca.n, cb.n), 6) AS coupling FROM q JOIN c ca ON ca.p = path_a JOIN c cb ON cb.p = path_b")
def path_coupling(spark, folder):
    return feedback.coupling(_events(spark, folder))


@query(f"WITH {_EVENTS} SELECT coalesce(intent, '') AS intent, count(*) AS n, count(rating) AS rated, round(avg(rating), 6) AS mean_rating, round(avg(confidence), 6) AS mean_confidence FROM ev GROUP BY 1")
def intent_report(spark, folder):
    e = _events(spark, folder)
    return e.groupBy(F.coalesce("intent", F.lit("")).alias("intent")).agg(F.count("*").alias("n"), F.count("rating").alias("rated"), F.round(F.avg("rating"), 6).alias("mean_rating"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


# ---- ingest ------------------------------------------------------------------------------------------------------
@query("SELECT file_id, sha256(content) = sha256 AS same FROM (SELECT DISTINCT file_id, content, sha256 FROM source_files WHERE file_id IS NOT NULL)")
def file_hashes(spark, folder):
    f = table(spark, folder, "source_files").where("file_id IS NOT NULL").select("file_id", "content", "sha256").distinct()
    return f.select("file_id", (F.sha2("content", 256) == F.col("sha256")).alias("same"))


_CLASS = "CASE WHEN regexp_matches(rel_path, '" + ingest.EXCLUDED + "') THEN 'excluded' " + " ".join(f"WHEN regexp_matches(rel_path, '{p}') THEN '{k}'" for k, p in ingest.GROUPS.items()) + " END"


@query(f"SELECT coalesce({_CLASS}, '') AS grp, count(DISTINCT file_id) AS n FROM source_files WHERE rel_path IS NOT NULL GROUP BY 1")
def file_groups(spark, folder):
    f = table(spark, folder, "source_files").where("rel_path IS NOT NULL")
    return f.groupBy(F.coalesce(ingest.classify(F.col("rel_path")), F.lit("")).alias("grp")).agg(F.countDistinct("file_id").alias("n"))


_CLEAN = "regexp_replace(regexp_replace(regexp_replace(trim(rel_path), '\\\\', '/', 'g'), '/{2,}', '/', 'g'), '^(?:\\./|/)+', '')"


@query(f"""WITH d AS (SELECT repo, {_CLEAN} AS path, max(coalesce(sha256, '')) AS sha256 FROM source_files WHERE repo IS NOT NULL AND rel_path IS NOT NULL GROUP BY 1, 2),
 r AS (SELECT name AS repo, {_CLEAN} AS path, max(coalesce(sha256, '')) AS sha256 FROM ingested_files JOIN repositories ON repositories.id = repository_id WHERE rel_path IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2)
 SELECT coalesce(d.repo, r.repo) AS repo, coalesce(d.path, r.path) AS path, CASE WHEN d.path IS NULL THEN 'deleted' WHEN r.path IS NULL THEN 'unrecorded' WHEN d.sha256 = r.sha256 THEN 'ok' ELSE 'changed' END AS status FROM d FULL JOIN r ON d.repo = r.repo AND d.path = r.path""")
def index_coverage(spark, folder):
    one = F.max(F.coalesce("sha256", F.lit(""))).alias("sha256")
    disk = table(spark, folder, "source_files").where("repo IS NOT NULL AND rel_path IS NOT NULL").groupBy("repo", ingest.clean(F.col("rel_path")).alias("path")).agg(one)
    repos = table(spark, folder, "repositories").where("name IS NOT NULL").select(F.col("id").alias("repository_id"), F.col("name").alias("repo"))
    rec = table(spark, folder, "ingested_files").where("rel_path IS NOT NULL").join(repos, "repository_id").groupBy("repo", ingest.clean(F.col("rel_path")).alias("path")).agg(one)
    return ingest.coverage(disk, rec)


@query("WITH r AS (SELECT repository_id, id, lower(trim(status)) AS status, chunks_written, lag(chunks_written) OVER (PARTITION BY repository_id ORDER BY started_at, id) AS b, row_number() OVER (PARTITION BY repository_id ORDER BY started_at DESC, id DESC) AS rn FROM ingestion_runs WHERE repository_id IS NOT NULL AND started_at IS NOT NULL) SELECT repository_id, id AS run_id, status, chunks_written, round((chunks_written - b) / nullif(b, 0), 6) AS change FROM r WHERE rn = 1")
def last_runs(spark, folder):
    return ingest.last_runs(table(spark, folder, "ingestion_runs"))


@query("WITH u AS (SELECT id, min(repo) AS repo, min(collection) AS collection, min(rel_path) AS rel_path FROM chunks WHERE id IS NOT NULL GROUP BY id) SELECT repo, rel_path, count(*) AS n_chunks FROM u WHERE repo IS NOT NULL AND rel_path IS NOT NULL GROUP BY 1, 2")
def chunks_per_file(spark, folder):
    u = table(spark, folder, "chunks").where("id IS NOT NULL").groupBy("id").agg(F.min("repo").alias("repo"), F.min("rel_path").alias("rel_path"))
    return u.where("repo IS NOT NULL AND rel_path IS NOT NULL").groupBy("repo", "rel_path").agg(F.count("*").alias("n_chunks"))


@query("SELECT name AS repo, branch, coalesce(last_indexed < TIMESTAMP '2025-10-01' - INTERVAL 30 DAY, true) AS stale, CASE WHEN last_indexed IS NULL THEN NULL ELSE greatest(0, date_diff('day', last_indexed::DATE, DATE '2025-10-01')) END::INT AS age_days FROM repositories")
def freshness(spark, folder):
    now = F.lit("2025-10-01").cast("timestamp_ntz")
    r = table(spark, folder, "repositories")
    return r.select(F.col("name").alias("repo"), "branch", F.coalesce(F.col("last_indexed") < now - F.expr("INTERVAL 30 DAYS"), F.lit(True)).alias("stale"), F.when(F.col("last_indexed").isNotNull(), F.greatest(F.lit(0), F.datediff(F.lit("2025-10-01").cast("date"), F.to_date("last_indexed")))).alias("age_days"))


# ---- incidents ---------------------------------------------------------------------------------------------------
_INC = "i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(received_at, TIMESTAMP '0001-01-01') DESC) AS rn FROM incidents WHERE id IS NOT NULL) WHERE rn = 1)"


def _incidents(spark, folder, columns):
    return newest(table(spark, folder, "incidents"), "id", "received_at", columns)


@query(f"WITH {_INC} SELECT id, len(regexp_extract_all(stack_trace, '(?m)^Caused by: ')) + 1 AS n_blocks, len(regexp_extract_all(stack_trace, '(?m)^\\s+at ')) AS n_frames, regexp_extract(stack_trace, '^([\\w.]+(?:Exception|Error))', 1) AS exception FROM i WHERE stack_trace <> ''")
def stack_blocks(spark, folder):
    i = _incidents(spark, folder, ["stack_trace"]).where("stack_trace <> ''")
    c = F.col("stack_trace")
    return i.select("id", (F.regexp_count(c, F.lit("(?m)^Caused by: ")) + 1).cast("long").alias("n_blocks"), F.regexp_count(c, F.lit(r"(?m)^\s+at ")).cast("long").alias("n_frames"), F.regexp_extract(c, r"^([\w.]+(?:Exception|Error))", 1).alias("exception"))


@query(f"WITH {_INC} SELECT id, severity, service_name, created_at FROM i WHERE service_name = '{SERVICE}' ORDER BY created_at DESC, id LIMIT 50")
def recent_incidents(spark, folder):
    return _incidents(spark, folder, ["severity", "service_name", "created_at"]).where(F.col("service_name") == SERVICE).orderBy(F.desc("created_at"), "id").limit(50)


_SIM = [t for t in retrieval._query_terms(QUESTION) if len(t) > 2]


@query(f"WITH {_INC} SELECT id, n FROM (SELECT id, " + " + ".join(f"contains(lower(concat_ws(' ', title, description)), '{t}')::INT" for t in _SIM) + " AS n FROM i) WHERE n > 0 ORDER BY n DESC, id LIMIT 20")
def similar_incidents(spark, folder):
    i = _incidents(spark, folder, ["title", "description"])
    text = F.lower(F.concat_ws(" ", "title", "description"))
    n = sum((text.contains(t).cast("int") for t in _SIM[1:]), text.contains(_SIM[0]).cast("int"))
    return i.select("id", n.alias("n")).where("n > 0").orderBy(F.desc("n"), "id").limit(20)


# ---- problem 6 ---------------------------------------------------------------------------------------------------
@query()
def p6_found(spark, folder):
    from corpusloom.operators.loglines import entries

    return entries(table(spark, folder, "incidents")).drop("message")


@query()
def p6_entries(spark, folder):
    from corpusloom.operators.loglines import entries

    return entries(table(spark, folder, "incidents"))


# ---- streams -----------------------------------------------------------------------------------------------------
@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def hourly_events(spark, folder):
    from corpusloom.streaming.windows import tumbling

    return tumbling(table(spark, folder, "events"), "1 hour").select("event_type", "start", "n", F.round("total", 4).alias("total"))

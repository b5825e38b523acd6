"""Queries of the memory store, vector points and queries, prepared requests, locked predictions and chunk records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import adapters as D
from ..operators import evaluation as E
from ..operators import memory as M
from ..operators import payloads as Y
from ..operators import policy as P
from ..sources import table
from . import dims, query
from .tables import _CONFIGURED, _STRIP, _configured

_STRINGS = "map<string,string>"

# Payload hashes and locked predictions ----------------------------------------------------------------------------

_ESCAPED = """array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN c = '"' THEN '\\"' WHEN c = '\\' THEN '\\\\' WHEN c = chr(10) THEN '\\n' WHEN c = chr(13) THEN '\\r' WHEN c = chr(9) THEN '\\t'
    WHEN c = chr(8) THEN '\\b' WHEN c = chr(12) THEN '\\f' WHEN c <> '' AND ord(c) > 65535 THEN format('\\u{{:04x}}\\u{{:04x}}', 55232 + ord(c) // 1024, 56320 + ord(c) % 1024)
    WHEN c <> '' AND (ord(c) > 127 OR ord(c) < 32) THEN format('\\u{{:04x}}', ord(c)) ELSE c END), '')"""
_CANONICAL = f"""'{{"case_id": "case-' || doc_id || '", "n": ' || doc_id || ', "parts": {{"a": [1, 2], "z": "' || {_ESCAPED.format("source")} || '"}}, "report_text": "' || {_ESCAPED.format("coalesce(text, '')")} || '"}}'"""


def _payload_json():
    """The fields are out of order on purpose."""
    parts = F.struct(F.col("source").alias("z"), F.array(F.lit(1), F.lit(2)).alias("a"))
    return F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("report_text"), parts.alias("parts"), F.col("doc_id").alias("n"), F.concat(F.lit("case-"), F.col("doc_id").cast("string")).alias("case_id")))


@query(f"SELECT doc_id, sha256({_CANONICAL}) AS payload_hash FROM documents")
def payload_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.canonical_hash(_payload_json()).alias("payload_hash"))


@query(f"""WITH h AS (SELECT doc_id, sha256({_CANONICAL}) AS payload_hash, 1700000000 + doc_id AS created_at FROM documents)
    SELECT doc_id, 'case-' || doc_id AS case_id, substr(sha256('protocol-1:case-' || doc_id || ':' || payload_hash || ':' || created_at || '.0'), 1, 24) AS prediction_id, created_at::DOUBLE AS created_at, payload_hash, true AS locked,
        'protocol-1' AS protocol_id, 'true' AS created_before_outcome FROM h""")
def prediction_locks(spark, sf_dir):
    i = F.col("doc_id")
    lock = Y.prediction_lock("protocol-1", F.concat(F.lit("case-"), i.cast("string")), F.col("payload"), (i + 1700000000).cast("double"))
    rows = table(spark, sf_dir, "documents").select("doc_id", _payload_json().alias("payload")).select("doc_id", lock.alias("l")).select("doc_id", "l.*")
    return rows.select("doc_id", "case_id", "prediction_id", "created_at", "payload_hash", "locked", *(F.col("audit")[k].alias(k) for k in ("protocol_id", "created_before_outcome")))


# Memory -----------------------------------------------------------------------------------------------------------

_LOG = """log AS (SELECT event_id, ts, CASE event_type WHEN 'purchase' THEN 'promote' ELSE 'upsert' END AS event,
        CASE WHEN event_type = 'signup' THEN substr(sha256('memory:note ' || event_id), 1, 24) ELSE 'user-' || user_id END AS record_id, 'note ' || event_id AS text, event_type,
        CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'promoted' WHEN event_type = 'error' THEN 'rejected' ELSE 'candidate' END AS status FROM events)"""
_STATE = f"""WITH {_LOG}, u AS (SELECT * FROM log WHERE event = 'upsert'), s AS (
        SELECT record_id, min(row(ts, event_id)) AS f, max(row(ts, event_id)) AS l, min(ts) AS created_at, max(ts) AS last_ts, arg_max(text, row(ts, event_id)) AS text, arg_max(event_type, row(ts, event_id)) AS kind,
            arg_max(status, row(ts, event_id)) AS status, bool_or(status = 'promoted') AS sticky FROM u GROUP BY 1
    ), p AS (SELECT record_id, max(row(ts, event_id)) AS p, max(ts) AS p_ts, arg_max(event_id, row(ts, event_id)) AS why FROM log WHERE event = 'promote' GROUP BY 1)"""


def _log(spark, sf_dir):
    e, t = table(spark, sf_dir, "events"), F.col("event_type")
    status = F.when((t == "error") & (F.col("event_id") % 5 == 0), "promoted").when(t == "error", "rejected").otherwise("candidate")
    relation = F.struct(F.lit("hasEvent").alias("predicate"), F.col("event_id").cast("string").alias("to"))
    return e.select(
        "event_id", "ts", F.when(t == "purchase", "promote").otherwise("upsert").alias("event"), F.when(t != "signup", F.concat(F.lit("user-"), F.col("user_id").cast("string"))).alias("record_id"),
        F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("text"), F.create_map(F.lit("kind"), t, F.lit("at"), F.col("event_id").cast("string")).alias("metadata"), F.lit("text").alias("modality"),
        F.lit("events").alias("source"), status.alias("status"), F.concat(F.lit("seen "), F.col("event_id").cast("string")).alias("reason"), F.array_repeat(relation, (F.col("event_id") % 3).cast("int")).alias("relations"),
    )


@query(_STATE + """ SELECT s.record_id, text, kind, CASE WHEN p.p > s.l THEN 'seen ' || why END AS promotion_reason, CASE WHEN sticky OR coalesce(p.p > s.f, false) THEN 'promoted' ELSE status END AS learning_status,
    created_at, CASE WHEN p.p > s.l THEN p_ts ELSE last_ts END AS updated_at FROM s LEFT JOIN p USING (record_id)""")
def memory_records(spark, sf_dir):
    """Whole records after a log of upserts, some without an id, and promotions."""
    r, _ = M.replay(_log(spark, sf_dir))
    return r.select("record_id", "text", F.col("metadata")["kind"].alias("kind"), F.col("metadata")["promotion_reason"].alias("promotion_reason"), "learning_status", "created_at", "updated_at")


@query(_STATE + """ SELECT log.record_id, event_id, 'unknown_record_id' AS why FROM log LEFT JOIN s USING (record_id) WHERE event = 'promote' AND (f IS NULL OR row(ts, event_id) < f)""")
def memory_rejects(spark, sf_dir):
    return M.replay(_log(spark, sf_dir))[1].select("record_id", "event_id", "why")


@query(f"""{_STATE}, t AS (SELECT record_id, text FROM s), b AS (SELECT record_id, ('0x' || x)::INT AS b, i FROM (SELECT record_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x, unnest(range(strlen(text))) AS i FROM t)),
    v AS (SELECT record_id, ((b + i) % 128)::INT AS bucket, sum(b % 31 + 1)::BIGINT AS total FROM b GROUP BY 1, 2), n AS (SELECT record_id, sqrt(sum(total * total)) AS norm FROM v GROUP BY 1)
    SELECT record_id, string_agg(bucket || ':' || format('{{:.6f}}', (total / norm)::DOUBLE), ',' ORDER BY bucket) AS vector FROM v JOIN n USING (record_id) GROUP BY 1""")
def memory_vectors(spark, sf_dir):
    """The records embedded anew by an embedding that the caller passes."""
    r = M.embedded(M.replay(_log(spark, sf_dir))[0].select("record_id", "text"), M.embed)
    some = F.filter(F.transform("vector", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e["x"] != 0)
    return r.select("record_id", F.array_join(F.transform(some, lambda e: F.concat_ws(":", e["i"].cast("string"), F.format_string("%.6f", e["x"]))), ",").alias("vector"))


@query("""SELECT event_id, CASE event_type WHEN 'purchase' THEN 'promote' ELSE 'upsert' END AS event, 'at,kind' AS metadata_keys, (event_id % 3)::INT AS relation_count, floor(epoch(ts))::BIGINT AS stamp FROM events""")
def memory_update_log(spark, sf_dir):
    g = M.update_log(_log(spark, sf_dir))
    return g.select("event_id", "event", F.array_join("metadata_keys", ",").alias("metadata_keys"), "relation_count", F.unix_timestamp("ts").alias("stamp"))


@query("""SELECT 'case:case-' || doc_id AS src, 'hasClinicalTrace' AS predicate, 'clinical_pipeline_result' AS dst FROM documents""")
def consolidation_edges(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("case-"), F.col("doc_id").cast("string")).alias("case_id"))
    return Y.edges(M.consolidation_relations(d))


_PAIRS = """q AS (SELECT vec_id AS query_id, embedding AS w FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, e.vec_id, round(list_sum(list_transform(list_zip(e.embedding, q.w), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS score FROM embeddings e, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)"""


def _asked(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return queries, M.top_hits_of(e.select("vec_id", F.col("embedding").alias("vector")), queries, "query_id")


@query(f"WITH {_PAIRS} SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5")
def vector_topk_table(spark, sf_dir):
    """A table of queries against all records."""
    return _asked(spark, sf_dir)[1].select("query_id", "vec_id", "score", "rank")


@query(f"""WITH {_PAIRS} SELECT query_id, 5 AS top_k, count(*)::INT AS hit_count, string_agg(vec_id::VARCHAR, ',' ORDER BY rank) AS hits FROM r WHERE rank <= 5 GROUP BY 1""")
def search_envelopes(spark, sf_dir):
    queries, hits = _asked(spark, sf_dir)
    e = M.search_envelope(hits, queries, "query_id", 5)
    return e.select("query_id", "top_k", "hit_count", F.array_join(F.transform("hits", lambda h: h["vec_id"].cast("string")), ",").alias("hits"))


@query(f"""WITH {_PAIRS}, o AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY abs(vec_id - query_id), vec_id)::INT AS rank FROM (SELECT query_id, vec_id FROM r WHERE rank <= 5)),
    f AS (SELECT query_id, vec_id, 1e0 / (60 + rank) AS s FROM r WHERE rank <= 5 UNION ALL SELECT query_id, vec_id, 1e0 / (60 + rank) FROM o)
    SELECT query_id || ':' || vec_id AS hit, round(sum(s), 9) AS score FROM f GROUP BY 1""")
def rank_fusion(spark, sf_dir):
    """Hits by score and by nearness of ids, fused by reciprocal ranks."""
    from pyspark.sql import Window

    hits = _asked(spark, sf_dir)[1].withColumn("hit", F.concat_ws(":", F.col("query_id").cast("string"), F.col("vec_id").cast("string")))
    near = Window.partitionBy("query_id").orderBy(F.abs(F.col("vec_id") - F.col("query_id")), "vec_id")
    other = hits.select("hit", F.row_number().over(near).alias("rank"))
    return M.fused_ranks([hits.select("hit", "rank"), other], "hit").select("hit", F.round("score", 9).alias("score"))


# Points, queries, requests ------------------------------------------------------------------------------------------

@query("SELECT * FROM (VALUES ('events_memory', 'text_dense', 'dense', 128, 'Cosine'), ('events_memory', 'image_dense', 'dense', 128, 'Cosine'), ('events_memory', 'text_sparse', 'sparse', NULL, NULL)) t(collection, vector, kind, size, distance)")
def collection_schema(spark, sf_dir):
    return Y.collection_schema(spark, "events_memory")


@query(r"""WITH d AS (SELECT item_id, coalesce(text, '') AS t FROM benchmark), b AS (SELECT item_id, ('0x' || x)::INT AS b, i FROM (SELECT item_id, unnest(regexp_extract_all(hex(encode(t)), '..')) AS x, unnest(range(strlen(t))) AS i FROM d)),
    s AS (SELECT item_id, ((b + i) % 128)::INT AS bucket, sum(b % 31 + 1)::BIGINT AS total FROM b GROUP BY 1, 2), n AS (SELECT item_id, sqrt(sum(total * total)) AS norm FROM s GROUP BY 1),
    v AS (SELECT d.item_id, string_agg(format('{:.6f}', coalesce(total / norm, 0)::DOUBLE), ',' ORDER BY k) AS dense
        FROM d CROSS JOIN (SELECT unnest(range(128)) AS k) LEFT JOIN s ON s.item_id = d.item_id AND bucket = k LEFT JOIN n ON n.item_id = d.item_id GROUP BY 1),
    w AS (SELECT item_id, (list_sum(list_transform(string_split(x, ''), lambda c: ord(c))) % 100000)::INT AS idx, count(*) AS n
        FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(t), '\s+'), lambda x: x <> '')) AS x FROM d) GROUP BY 1, 2),
    p AS (SELECT item_id, string_agg(idx || ':' || n, ',' ORDER BY idx) AS sparse FROM w GROUP BY 1)
    SELECT v.item_id, dense, coalesce(sparse, '') AS sparse, 'reciprocal_rank_fusion_candidate' AS fusion, 5 AS top_k, 'lang=en' AS filters, 'not_sent_offline_contract' AS execution FROM v LEFT JOIN p USING (item_id)""")
def hybrid_queries(spark, sf_dir):
    q = Y.hybrid_query(F.col("text"), 5, F.create_map(F.lit("lang"), F.lit("en")))
    rows = table(spark, sf_dir, "benchmark").select("item_id", q.alias("q")).select("item_id", "q.*")
    sparse = F.array_join(F.transform(F.arrays_zip("query.sparse.indexes", "query.sparse.values"), lambda x: F.concat_ws(":", x["indexes"].cast("string"), x["values"].cast("long").cast("string"))), ",")
    return rows.select(
        "item_id", F.array_join(F.transform("query.dense.vector", lambda x: F.format_string("%.6f", x)), ",").alias("dense"), sparse.alias("sparse"), F.col("query.fusion").alias("fusion"), F.col("limit").alias("top_k"),
        F.array_join(F.transform(F.map_entries("filters"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("filters"), "execution",
    )


@query(f"""WITH c AS ({_CONFIGURED}), r AS (SELECT c.*, event_id % 4 <> 0 AS known, e AND NOT d AND coalesce(p, '') <> '' AND c AS ready FROM c)
    SELECT event_id, CASE WHEN NOT known THEN 'rejected' WHEN ready THEN 'requires_infrastructure_subclass' ELSE 'not_executed' END AS status,
        CASE WHEN NOT known THEN 'unknown_schema_class' WHEN ready THEN 'live_upsert_deliberately_not_hardcoded_in_core' ELSE
            concat_ws(';', CASE WHEN NOT e THEN 'adapter_disabled' END, CASE WHEN d THEN 'dry_run_enabled' END, CASE WHEN coalesce(p, '') = '' THEN 'endpoint_missing' END, CASE WHEN NOT c THEN 'weaviate_client_unavailable' END) END AS reason,
        CASE WHEN known THEN 'upsert_object' END AS operation, CASE WHEN known THEN 'o' || event_id END AS object_id, CASE WHEN known THEN CASE WHEN event_id % 3 = 0 THEN 'promoted' ELSE 'candidate' END END AS learning_status,
        CASE WHEN known THEN 'belongsToCase' END AS reference FROM r""")
def store_upserts(spark, sf_dir):
    i = F.col("event_id")
    c = _configured(spark, sf_dir).withColumn("class", F.when(i % 4 != 0, "ClinicalCase").otherwise("NoSuchClass"))
    c = c.join(F.broadcast(dims.classes(spark).withColumn("known", F.lit(True))), "class", "left").withColumn("known", F.coalesce("known", F.lit(False)))  # a constant table of seven rows
    properties = F.when(i % 3 == 0, F.create_map(F.lit("learning_status"), F.lit("promoted"))).otherwise(F.create_map().cast(_STRINGS))
    ready = D.live_readiness(F.col("e"), F.col("d"), F.col("p"), F.col("c"))
    r = Y.prepared_upsert(F.col("known"), F.col("class"), F.concat(F.lit("o"), i.cast("string")), properties, F.array(F.lit("belongsToCase")), ready)
    rows = c.select("event_id", r.alias("r")).select("event_id", "r.*")
    return rows.select("event_id", "status", F.array_join("reason", ";").alias("reason"), "operation", "object_id", "learning_status", F.element_at("references", 1).alias("reference"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'rejected' ELSE 'prepared' END AS status, CASE WHEN page_id % 3 = 0 THEN 'unknown_schema_class' END AS reason, CASE WHEN page_id % 3 <> 0 THEN 'semantic_search' END AS operation,
    CASE WHEN page_id % 3 <> 0 THEN url END AS query, CASE WHEN page_id % 3 <> 0 THEN 5 END AS top_k FROM pages""")
def store_searches(spark, sf_dir):
    kind = F.when(F.col("page_id") % 3 == 0, "NoSuchClass").otherwise("Symptom")
    r = Y.prepared_search(kind.isin(dims.CLASSES), kind, F.col("url"), F.lit("symptom_text_vector"))
    return table(spark, sf_dir, "pages").select("page_id", r.alias("r")).select("page_id", "r.status", "r.reason", "r.operation", "r.query", F.col("r.limit").alias("top_k"))


# Runtime ------------------------------------------------------------------------------------------------------------

@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'remote_research' ELSE 'local_research' END AS profile, event_id % 5 = 0 AS allow, CASE event_id % 4 WHEN 0 THEN 'local_metadata' WHEN 1 THEN 'local_pixels' END AS strategy,
        event_type, user_id % 2 = 0 AS even FROM events)
    SELECT event_id, profile AS runtime_profile, allow OR profile = 'remote_research' AS allow_remote_models,
        CASE WHEN profile = 'remote_research' AND coalesce(strategy, 'local_metadata') = 'local_metadata' THEN 'hybrid_multimodal' ELSE coalesce(strategy, 'local_metadata') END AS imaging_provider_strategy,
        array_to_string(list_sort(list_filter([CASE WHEN even THEN event_type END, CASE WHEN profile = 'remote_research' THEN 'theoretical_quantum' END], lambda x: x IS NOT NULL)), ',') AS enabled_services, 2 AS service_count, 15 AS calibration_bin_count FROM e""")
def runtime_profiles(spark, sf_dir):
    i = F.col("event_id")
    services = F.array(F.struct(F.col("event_type").alias("name"), (F.col("user_id") % 2 == 0).alias("enabled")), F.struct(F.lit("theoretical_quantum").alias("name"), F.lit(False).alias("enabled")))
    r = dims.runtime(F.when(i % 3 == 0, "remote_research").otherwise("local_research"), i % 5 == 0, F.when(i % 4 == 0, "local_metadata").when(i % 4 == 1, "local_pixels"), services)
    rows = table(spark, sf_dir, "events").select("event_id", r.alias("r")).select("event_id", "r.*")
    return rows.select("event_id", "runtime_profile", "allow_remote_models", "imaging_provider_strategy", F.array_join("enabled_services", ",").alias("enabled_services"), "service_count", "calibration_bin_count")


@query("SELECT doc_id, u >= t AS abstain FROM (SELECT doc_id, (doc_id % 17) * 0.06 AS u, CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 0.65 END AS t FROM documents)")
def metacognition(spark, sf_dir):
    i = F.col("doc_id")
    threshold = F.when(i % 2 == 0, F.lit(0.5)).otherwise(F.lit(None))
    return table(spark, sf_dir, "documents").select("doc_id", P.should_abstain((i % 17) * 0.06, threshold).alias("abstain"))


# Evaluation ---------------------------------------------------------------------------------------------------------

_SCORED = "records AS (SELECT least(1.0, greatest(0.0, CASE WHEN d.doc_id % 4 = 0 THEN (d.n_chars % 1000) / 1000.0 WHEN d.doc_id % 4 = 1 THEN 0.0 ELSE (d.n_chars % 500) / 500.0 END)) AS c, l.quality AS y FROM labels l JOIN documents d USING (doc_id))"


@query(f"""WITH {_SCORED}, b AS (SELECT least(floor(c * 10), 9)::INT AS bin, count(*) AS n, sum(c::DECIMAL(20,12))::DOUBLE AS sc, sum(y) AS sy FROM records GROUP BY 1)
    SELECT k::INT AS bin, coalesce(n, 0) AS n, round(k / 10, 4) AS lower, round((k + 1) / 10, 4) AS upper, round(coalesce(sc / n, 0.0), 4) AS confidence, round(coalesce(sy / n, 0.0), 4) AS accuracy,
        round(abs(coalesce(sc / n, 0.0) - coalesce(sy / n, 0.0)), 4) AS gap FROM (SELECT unnest(range(10)) AS k) r LEFT JOIN b ON b.bin = r.k""")
def calibration_report(spark, sf_dir):
    """Confidence where it is given, else the score; what is no number counts as 0; every measure to four digits."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    i, n = F.col("doc_id"), F.col("n_chars")
    given = F.when(i % 4 == 0, ((n % 1000) / 1000.0).cast("string")).when(i % 4 == 1, "high")
    records = E.scored_records(rows.select(given.alias("confidence"), ((n % 500) / 500.0).cast("string").alias("score"), (F.col("quality") == 1).alias("correct")))
    return E.rounded_bins(E.calibration_bins(records))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'none' ELSE source END AS predicted, doc_id % 5 = 0 AS abstained, doc_id % 5 <> 0 AND (doc_id % 2 = 0 OR source = 'src1') AS correct,
    CASE WHEN doc_id % 3 = 0 THEN least(1.0, (doc_id % 10) * 0.125) ELSE 0.25 END AS confidence FROM documents WHERE source IS NOT NULL""")
def benchmark_confidence(spark, sf_dir):
    """The rows of a benchmark run with a prediction function: label, abstention, and confidence by score or else by pi."""

    def predict(rows):
        i = F.col("doc_id")
        return rows.withColumns({
            "result_label": F.when(i % 5 == 0, "abstain_or_escalate").otherwise(F.upper("source")), "top_label": F.lit(None).cast("string"),
            "top_score": F.when(i % 3 == 0, ((i % 10) * 0.125).cast("string")).when(i % 3 == 1, "n/a"), "pi_score": F.lit("0.25"),
        })

    gold = F.when(F.col("doc_id") % 2 == 0, F.array(F.col("source"))).otherwise(F.array(F.lit("src1 ")))
    records = table(spark, sf_dir, "documents").where("source is not null").select("doc_id", "source", gold.alias("gold_labels"))
    return E.benchmark_run(records, predict).select("doc_id", "predicted", "abstained", "correct", "confidence")


# Chunks -------------------------------------------------------------------------------------------------------------

_PATH = "'/data/in.box/doc.' || doc_id || '.txt'"


def _path():
    return F.concat(F.lit("/data/in.box/doc."), F.col("doc_id").cast("string"), F.lit(".txt"))


@query(f"""SELECT doc_id, 'doc.' || doc_id || '-chunk-' || (k + 1) AS record_id, k::INT AS chunk_index, (k * 1080)::INT AS chunk_start, least(k * 1080 + 1200, n)::INT AS chunk_end, sha256(chunk) AS sha, {_PATH} AS source_path,
        'structured_document_contract' AS converter, 'document_ingestion_contract' AS source
    FROM (SELECT doc_id, k, length(t) AS n, {_STRIP.format("substr(t, k * 1080 + 1, 1200)")} AS chunk FROM (SELECT doc_id, t, unnest(range(0, greatest(ceil((length(t) - 1200) / 1080), 0)::INT + 1)) AS k
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WHERE {_STRIP.format("t")} <> '')) WHERE chunk <> ''""")
def chunk_records(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", _path().alias("path"), F.explode(S.chunks_bounded(F.coalesce("text", F.lit("")))).alias("c"))
    more = F.create_map(F.lit("chunk_index"), F.col("c.idx").cast("string"), F.lit("converter"), F.lit("structured_document_contract"), F.lit("chunk_start"), F.col("c.start").cast("string"), F.lit("chunk_end"), F.col("c.end").cast("string"))
    r = Y.chunk_record(S.chunk_id("bounded", F.col("path"), F.col("c.idx")), F.col("c.chunk"), F.col("path"), more, "document_ingestion_contract")
    whole = lambda k: F.col("r.metadata")[k].cast("int").alias(k)
    return c.select("doc_id", r.alias("r")).select("doc_id", "r.record_id", whole("chunk_index"), whole("chunk_start"), whole("chunk_end"), F.sha2("r.text", 256).alias("sha"), F.col("r.metadata")["source_path"].alias("source_path"), F.col("r.metadata")["converter"].alias("converter"), "r.source")


@query(f"""SELECT doc_id, 'doc:doc.' || doc_id || '.txt:' || idx AS record_id, sha256(chunk) AS sha FROM (
    SELECT doc_id, idx, {_STRIP.format("substr(t, idx * 1040 + 1, 1200)")} AS chunk FROM (SELECT doc_id, coalesce(text, '') AS t, unnest(range(0, ((length(coalesce(text, '')) + 1039) // 1040)::INT)) AS idx FROM documents)) WHERE chunk <> ''""")
def chunk_names(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", _path().alias("path"), F.explode(S.chunks_sliding(F.coalesce("text", F.lit("")))).alias("c"))
    return c.select("doc_id", S.chunk_id("sliding", F.col("path"), F.col("c.idx")).alias("record_id"), F.sha2("c.chunk", 256).alias("sha"))

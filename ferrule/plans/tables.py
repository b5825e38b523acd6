"""Queries over the driver tables: evaluation, text, vectors, memory, imaging, payloads, registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import adapters as D
from ..operators import evaluation as E
from ..operators import imaging as I
from ..operators import intake as N
from ..operators import memory as M
from ..operators import payloads as Y
from ..operators import placeholders as H
from ..sources import batch_summary as summed
from ..sources import cxr_cases, known_modalities, nested_payloads, openi_cases, parse_benchmark, table, validated
from . import dims, query

# Evaluation ----------------------------------------------------------------------------------------------------

_RECORDS = "records AS (SELECT least(1.0, greatest(0.0, (d.n_chars % 1000) / 1000.0)) AS c, l.quality AS y FROM labels l JOIN documents d USING (doc_id))"
_BINS = f"""WITH {_RECORDS}, b AS (
    SELECT least(floor(c * 10), 9)::INT AS bin, count(*) AS n, sum(c::DECIMAL(20,12))::DOUBLE AS sc, sum(y) AS sy, sum(((c - y) * (c - y))::DECIMAL(20,12))::DOUBLE AS sq FROM records GROUP BY 1
), bins AS (
    SELECT k::INT AS bin, k / 10 AS lower, (k + 1) / 10 AS upper, coalesce(n, 0) AS n, coalesce(sc / n, 0.0) AS confidence, coalesce(sy / n, 0.0) AS accuracy,
        abs(coalesce(sc / n, 0.0) - coalesce(sy / n, 0.0)) AS gap, coalesce(sq, 0.0) AS square_sum
    FROM (SELECT unnest(range(10)) AS k) r LEFT JOIN b ON b.bin = r.k
)"""


def _records(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select(((F.col("n_chars") % 1000) / 1000.0).alias("confidence"), F.col("quality").alias("correct"))


@query(_BINS + " SELECT bin, lower, upper, n, round(confidence, 9) AS confidence, round(accuracy, 9) AS accuracy, round(gap, 9) AS gap FROM bins")
def calibration_bins(spark, sf_dir):
    b = E.calibration_bins(_records(spark, sf_dir))
    return b.select("bin", "lower", "upper", "n", *(F.round(c, 9).alias(c) for c in ("confidence", "accuracy", "gap")))


@query(_BINS + " SELECT sum(n)::BIGINT AS n, round(sum((n * gap)::DECIMAL(28,12))::DOUBLE / sum(n), 6) AS ece, round(max(CASE WHEN n > 0 THEN gap ELSE 0 END), 6) AS mce, round(sum(square_sum::DECIMAL(28,12))::DOUBLE / sum(n), 6) AS brier FROM bins")
def calibration_summary(spark, sf_dir):
    return E.calibration_summary(E.calibration_bins(_records(spark, sf_dir)))


@query(_BINS + " SELECT min(lower) FILTER (n > 0 AND accuracy >= 0.85) AS threshold, CASE WHEN min(lower) FILTER (n > 0 AND accuracy >= 0.85) IS NULL THEN 'no_threshold_suggested' ELSE 'threshold_suggested' END AS status FROM bins")
def calibration_threshold(spark, sf_dir):
    return E.suggested_threshold(E.calibration_bins(_records(spark, sf_dir)), 0.85)


@query(_BINS + """, t AS (SELECT bin, lower, n, sum(n) OVER (ORDER BY bin DESC) AS answered, sum(round(accuracy * n)) OVER (ORDER BY bin DESC) AS correct, sum(n) OVER () AS total FROM bins)
    SELECT bin, round(lower, 4) AS threshold, round(answered / total, 6) AS coverage, round(correct / answered, 6) AS retained_accuracy, round(1 - correct / answered, 6) AS risk FROM t WHERE n > 0""")
def risk_coverage(spark, sf_dir):
    return E.risk_coverage(E.calibration_bins(_records(spark, sf_dir)))


_ROWS = """WITH r AS (
    SELECT l.doc_id, d.lang, d.source, l.doc_id % 5 = 0 AS abstained, CASE WHEN l.doc_id % 3 = 0 THEN 'alpha' ELSE 'beta' END AS predicted, CASE WHEN l.quality = 1 THEN ['alpha'] ELSE ['beta', 'gamma'] END AS gold
    FROM labels l JOIN documents d USING (doc_id)
), rows AS (SELECT *, list_contains(gold, predicted) AND NOT abstained AS correct FROM r)"""
_REPORT = """count(*) AS n, count(*) FILTER (NOT abstained) AS answered, count(*) FILTER (abstained) AS abstained, count(*) FILTER (correct) AS correct, round(count(*) FILTER (correct) / greatest(count(*), 1), 6) AS top1_accuracy,
    round(count(*) FILTER (NOT abstained) / greatest(count(*), 1), 6) AS coverage, round(count(*) FILTER (correct) / greatest(count(*) FILTER (NOT abstained), 1), 6) AS selective_accuracy"""


def _benchmark(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    i = F.col("doc_id")
    gold = F.when(F.col("quality") == 1, F.array(F.lit("Alpha "))).otherwise(F.array(F.lit("BETA"), F.lit("gamma")))
    rows = rows.select(
        "doc_id", F.when(i % 5 == 0, "abstain_or_escalate").when(i % 2 == 0, F.when(i % 3 == 0, " ALPHA").otherwise("beta")).alias("result_label"), F.when(i % 3 == 0, "alpha").otherwise("Beta").alias("top_label"),
        F.concat(F.lit("0."), (i % 10).cast("string")).alias("top_score"), F.lit("0.5").alias("pi_score"), gold.alias("gold_labels"), F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("slices"),
    )
    return E.benchmark_rows(rows)


@query(_ROWS + f" SELECT {_REPORT} FROM rows")
def benchmark_report(spark, sf_dir):
    return E.benchmark_report(_benchmark(spark, sf_dir))


@query(_ROWS + f", s AS (SELECT 'lang:' || lang AS slice, abstained, correct FROM rows UNION ALL SELECT 'source:' || source, abstained, correct FROM rows) SELECT slice, {_REPORT} FROM s GROUP BY slice")
def benchmark_slices(spark, sf_dir):
    return E.benchmark_slices(_benchmark(spark, sf_dir))


@query("""SELECT unnest(list_transform(list_filter([' One', 'TWO ', '', 'doc' || doc_id], lambda x: x <> ''), lambda x: lower(trim(x)))) AS label, doc_id, 'case-' || doc_id AS case_id FROM labels""")
def benchmark_jsonl(spark, sf_dir):
    """Lines of both spellings of gold labels, made from the labels table and parsed again."""
    rows = table(spark, sf_dir, "labels").select("doc_id")
    every = F.array(F.lit(" One"), F.lit("TWO "), F.lit(""), F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    line = F.to_json(F.struct(F.concat(F.lit("case-"), F.col("doc_id").cast("string")).alias("case_id"), F.when(F.col("doc_id") % 2 == 0, every).alias("gold_labels"), F.when(F.col("doc_id") % 2 == 1, every).alias("gold_label")))
    parsed = parse_benchmark(rows.select(line.alias("value")))
    return parsed.select(F.explode("gold_labels").alias("label"), F.expr("cast(substring(case_id, 6) as bigint)").alias("doc_id"), "case_id")


_PRED = "p AS (SELECT DISTINCT user_id, substr(sha256('protocol-1:case-' || user_id || ':h:0'), 1, 24) AS prediction_id, CASE WHEN user_id % 2 = 0 THEN 'click' ELSE 'view' END AS label FROM events)"
_OUT = """o AS (SELECT event_id, ts, event_type, substr(sha256((CASE WHEN event_type = 'error' THEN 'protocol-2' ELSE 'protocol-1' END) || ':case-' || user_id || ':h:0'), 1, 24) AS prediction_id
    FROM events WHERE event_type IN ('click', 'view', 'purchase', 'error'))"""
_ATT = f"""WITH {_PRED}, {_OUT}, a AS (
    SELECT o.*, p.user_id, CASE WHEN p.prediction_id IS NULL THEN 'unknown_prediction_id' WHEN row_number() OVER (PARTITION BY o.prediction_id ORDER BY ts, event_id) = 1 THEN 'attached' ELSE 'outcome_already_attached' END AS status
    FROM o LEFT JOIN p ON o.prediction_id = p.prediction_id
)"""


def _prospective(spark, sf_dir):
    """A prediction for every user; outcomes by their events, of which errors belong to a protocol that registered nothing."""
    events = table(spark, sf_dir, "events")

    def named(protocol):
        return F.substring(F.sha2(F.concat_ws(":", protocol, F.concat(F.lit("case-"), F.col("user_id").cast("string")), F.lit("h"), F.lit("0")), 256), 1, 24)

    predictions = events.select("user_id").distinct().select("user_id", named(F.lit("protocol-1")).alias("prediction_id"), F.when(F.col("user_id") % 2 == 0, "click").otherwise("view").alias("label"))
    outcomes = events.where("event_type in ('click', 'view', 'purchase', 'error')")
    protocol = F.when(F.col("event_type") == "error", "protocol-2").otherwise("protocol-1")
    outcomes = outcomes.select("event_id", "ts", named(protocol).alias("prediction_id"), F.array("event_type").alias("accepted_labels"))
    return predictions, E.attach_outcomes(predictions, outcomes, ["ts", "event_id"])


@query(f"WITH {_PRED} SELECT user_id, prediction_id, label FROM p")
def prospective_register(spark, sf_dir):
    return _prospective(spark, sf_dir)[0]


@query(_ATT + " SELECT event_id, prediction_id FROM a WHERE status = 'attached'")
def prospective_first_outcome(spark, sf_dir):
    return _prospective(spark, sf_dir)[1].where("status = 'attached'").select("event_id", "prediction_id")


@query(_ATT + " SELECT status, count(*) AS n FROM a WHERE status <> 'attached' GROUP BY status")
def prospective_rejects(spark, sf_dir):
    return _prospective(spark, sf_dir)[1].where("status <> 'attached'").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(_ATT + """ SELECT count(*) AS registered, count(a.event_id) AS completed, count(*) FILTER (a.event_type = p.label) AS correct, round(count(*) FILTER (a.event_type = p.label) / greatest(count(a.event_id), 1), 6) AS accuracy
    FROM p LEFT JOIN (SELECT * FROM a WHERE status = 'attached') a ON a.prediction_id = p.prediction_id""")
def prospective_accuracy(spark, sf_dir):
    return E.prospective_accuracy(*_prospective(spark, sf_dir))


# Text ----------------------------------------------------------------------------------------------------------

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _chunks(spark, sf_dir, cut):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(cut(F.coalesce("text", F.lit("")))).alias("c"))
    return rows.select("doc_id", F.col("c.idx").cast("int").alias("idx"), F.col("c.start").cast("int").alias("start"), F.char_length("c.chunk").alias("n"), F.sha2(F.col("c.chunk"), 256).alias("sha"))


def _bounded_sql(text: str, size: int, step: int, blank: str, strip: bool = False) -> str:
    return f"""SELECT doc_id, k::INT AS idx, (k * {step})::INT AS start, length(chunk)::INT AS n, sha256(chunk) AS sha FROM (
        SELECT doc_id, k, {_STRIP.format(f"substr(t, k * {step} + 1, {size})") if strip else f"substr(t, k * {step} + 1, {size})"} AS chunk FROM (SELECT doc_id, t, unnest(range(0, greatest(ceil((length(t) - {size}) / {step}), 0)::INT + 1)) AS k FROM (SELECT doc_id, {text} AS t FROM documents) {blank})){" WHERE chunk <> ''" if strip else ""}"""


@query(f"""SELECT doc_id, idx::INT AS idx, (idx * 1040)::INT AS start, length(chunk)::INT AS n, sha256(chunk) AS sha FROM (
    SELECT doc_id, idx, {_STRIP.format("substr(t, idx * 1040 + 1, 1200)")} AS chunk FROM (SELECT doc_id, coalesce(text, '') AS t, unnest(range(0, ((length(coalesce(text, '')) + 1039) // 1040)::INT)) AS idx FROM documents)) WHERE chunk <> ''""")
def chunk_sliding(spark, sf_dir):
    return _chunks(spark, sf_dir, S.chunks_sliding)


@query(_bounded_sql("coalesce(text, '')", 1200, 1080, f"WHERE {_STRIP.format('t')} <> ''", strip=True))
def chunk_bounded(spark, sf_dir):
    return _chunks(spark, sf_dir, S.chunks_bounded)


@query(_bounded_sql(r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))", 900, 780, ""))
def chunk_collapsed(spark, sf_dir):
    return _chunks(spark, sf_dir, S.chunks_collapsed)


@query("SELECT doc_id, substr(sha256('documents:' || coalesce(text, '')), 1, 24) AS record_id, substr(sha256('p:case-' || doc_id || ':' || sha256(coalesce(text, '')) || ':0'), 1, 24) AS prediction_id FROM documents")
def stable_ids(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    case = F.concat(F.lit("case-"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", S.stable_id(F.lit("documents"), text).alias("record_id"), S.stable_id(F.lit("p"), F.concat_ws(":", case, F.sha2(text, 256), F.lit("0"))).alias("prediction_id"))


@query(r"""SELECT page_id, regexp_extract(p, '([^/]*)$', 1) AS name, CASE WHEN regexp_extract(p, '([^/]*)$', 1) LIKE '_%.%' THEN regexp_replace(regexp_extract(p, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') ELSE regexp_extract(p, '([^/]*)$', 1) END AS stem,
    lower(regexp_extract(regexp_extract(p, '([^/]*)$', 1), '.(\.[^./]+)$', 1)) AS suffix FROM (SELECT page_id, regexp_extract(url, '^[^?#]*') AS p FROM pages)""")
def path_features(spark, sf_dir):
    p = F.regexp_extract("url", r"^[^?#]*", 0)
    return table(spark, sf_dir, "pages").select("page_id", S.file_name(p).alias("name"), S.file_stem(p).alias("stem"), S.file_suffix(p).alias("suffix"))


@query("""SELECT doc_id, 'doc' AS kind, source AS origin, lang, CASE WHEN doc_id % 3 = 0 THEN 'override' ELSE 'base' END AS focus, length(coalesce(text, ''))::INT AS n, sha256(coalesce(text, '')) AS sha FROM documents""")
def memory_documents(spark, sf_dir):
    """The memory document of every whole text; its text by length and hash."""
    more = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("focus"), F.lit("override"))).otherwise(F.create_map().cast("map<string,string>"))
    doc = Y.memory_document(F.coalesce("text", F.lit("")), {"kind": F.lit("doc"), "origin": F.col("source"), "lang": F.col("lang"), "focus": F.lit("base")}, more)
    rows = table(spark, sf_dir, "documents").select("doc_id", doc.alias("d"))
    return rows.select("doc_id", *(F.col("d.metadata")[k].alias(k) for k in ("kind", "origin", "lang", "focus")), F.char_length("d.text").alias("n"), F.sha2("d.text", 256).alias("sha"))


# Vectors -------------------------------------------------------------------------------------------------------

_BYTES = """SELECT item_id, ((b + i) % 128)::INT AS bucket, sum(b % 31 + 1)::BIGINT AS total FROM (
    SELECT item_id, i, ('0x' || substr(h, 2 * i + 1, 2))::INT AS b FROM (SELECT item_id, hex(encode(coalesce(text, ''))) AS h, unnest(range(strlen(coalesce(text, '')))) AS i FROM benchmark)) GROUP BY 1, 2"""


@query(_BYTES)
def hash_embedding(spark, sf_dir):
    return M.embedding_sums(table(spark, sf_dir, "benchmark"), ["item_id"]).select("item_id", F.col("bucket").cast("int").alias("bucket"), "total")


@query(f"""WITH s AS ({_BYTES}), n AS (SELECT item_id, sqrt(sum(total * total)) AS norm FROM s GROUP BY 1)
    SELECT item_id, bucket, round(total / norm, 6) AS value FROM s JOIN n USING (item_id)""")
def hash_vectors(spark, sf_dir):
    v = M.embedded(table(spark, sf_dir, "benchmark"), M.embed)
    return v.select("item_id", F.posexplode("vector").alias("bucket", "value")).where("value <> 0")


@query("""SELECT doc_id, (list_sum(list_transform(string_split(t, ''), lambda c: ord(c))) % 100000)::INT AS idx, count(*) AS n
    FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')) AS t FROM documents) GROUP BY 1, 2""")
def sparse_hash(spark, sf_dir):
    return Y.sparse(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]).select("doc_id", F.col("idx").cast("int").alias("idx"), "n")


_SCORE = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


def _query_vector(spark, sf_dir):
    """The vector of the smallest id: a table of one row."""
    return table(spark, sf_dir, "embeddings").agg(F.min_by("embedding", "vec_id").alias("query"))


def _vectors(spark, sf_dir):
    status = F.when(F.col("label") < 4, "promoted").otherwise("candidate")
    meta = F.when(F.col("label").isin(1, 2, 7), F.create_map(F.lit("modality"), F.lit("ct"))).otherwise(F.create_map().cast("map<string,string>"))
    return table(spark, sf_dir, "embeddings").withColumns({"vector": F.col("embedding"), "learning_status": status, "metadata": meta})


def _topk_sql(where: str, part: str = "") -> str:
    return f"""WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT e.vec_id, e.label, round({_SCORE}, 6) AS score FROM embeddings e, q WHERE {where}),
        r AS (SELECT *, row_number() OVER ({part} ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT vec_id, {"label, " if part else ""}score, rank FROM r WHERE rank <= 5"""


@query(_topk_sql("true"))
def vector_topk(spark, sf_dir):
    asked = _vectors(spark, sf_dir).join(F.broadcast(_query_vector(spark, sf_dir)))
    return M.top_hits(asked, F.col("query")).select("vec_id", "score", "rank")


@query(_topk_sql("e.label < 4 AND e.label IN (1, 2, 7)"))
def vector_topk_filtered(spark, sf_dir):
    rows = _vectors(spark, sf_dir).where(M.search_filter(["promoted"], {"modality": "ct"}))
    return M.top_hits(rows.join(F.broadcast(_query_vector(spark, sf_dir))), F.col("query")).select("vec_id", "score", "rank")


@query(_topk_sql("true", "PARTITION BY label"))
def vector_topk_grouped(spark, sf_dir):
    asked = _vectors(spark, sf_dir).join(F.broadcast(_query_vector(spark, sf_dir)))
    return M.top_hits_by_group(asked, F.col("query"), "label").select("vec_id", "label", "score", "rank")


@query(f"""WITH s AS ({_BYTES}), q AS (SELECT bucket, total FROM s WHERE item_id = (SELECT min(item_id) FROM benchmark))
    SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id)::INT AS rank FROM (SELECT s.item_id, sum(s.total * q.total)::BIGINT AS score FROM s JOIN q USING (bucket) GROUP BY 1) ORDER BY score DESC, item_id LIMIT 5""")
def text_memory_search(spark, sf_dir):
    """Benchmark passages nearest to the first one, by whole-number inner products of their sums."""
    from pyspark.sql import Window

    bench = table(spark, sf_dir, "benchmark")
    sums = M.embedding_sums(bench, ["item_id"])
    least = bench.agg(F.min("item_id").alias("item_id"))
    own = sums.join(F.broadcast(least), "item_id").select("bucket", F.col("total").alias("w"))  # one id, 128 buckets at most
    scored = sums.join(F.broadcast(own), "bucket").groupBy("item_id").agg(F.sum(F.col("total") * F.col("w")).alias("score"))
    best = scored.orderBy(F.col("score").desc(), "item_id").limit(5)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "item_id")))


@query(r"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    b AS (SELECT doc_id, ('0x' || x)::INT AS b, i FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(t)), '..')) AS x, unnest(range(strlen(t))) AS i FROM d)),
    s AS (SELECT doc_id, ((b + i) % 128)::INT AS bucket, sum(b % 31 + 1)::BIGINT AS total FROM b GROUP BY 1, 2),
    n AS (SELECT doc_id, sqrt(sum(total * total)) AS norm FROM s GROUP BY 1),
    v AS (SELECT d.doc_id, string_agg(format('{:.6f}', coalesce(total / norm, 0)::DOUBLE), ',' ORDER BY k) AS dense
        FROM d CROSS JOIN (SELECT unnest(range(128)) AS k) LEFT JOIN s ON s.doc_id = d.doc_id AND bucket = k LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1),
    w AS (SELECT doc_id, (list_sum(list_transform(string_split(x, ''), lambda c: ord(c))) % 100000)::INT AS idx, count(*) AS n
        FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(t), '\s+'), lambda x: x <> '')) AS x FROM d) GROUP BY 1, 2),
    p AS (SELECT doc_id, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS sparse_indexes, string_agg(n::VARCHAR, ',' ORDER BY idx) AS sparse_values FROM w GROUP BY 1)
    SELECT d.doc_id, 'documents:' || d.doc_id AS point_id, dense, coalesce(sparse_indexes, '') AS sparse_indexes, coalesce(sparse_values, '') AS sparse_values, length(t)::INT AS n, sha256(t) AS sha,
        lang, source, 'clinical_semantic_memory' AS memory_type FROM d JOIN v USING (doc_id) LEFT JOIN p USING (doc_id)""")
def vector_points(spark, sf_dir):
    """The point of every document from its whole text; the payload's text by length and hash."""
    docs = table(spark, sf_dir, "documents")
    own = Y.point(F.concat(F.lit("documents:"), F.col("doc_id").cast("string")), F.col("text"), F.create_map(F.lit("lang"), F.col("lang")), F.col("source"))
    p = docs.select("doc_id", own.alias("p")).select("doc_id", "p.id", "p.vector.*", "p.payload.*")
    listed = lambda x, f: F.array_join(F.transform(x, f), ",")
    whole = lambda v: v.cast("long").cast("string")
    return p.select(
        "doc_id", F.col("id").alias("point_id"), listed("text_dense", lambda v: F.format_string("%.6f", v)).alias("dense"), listed("text_sparse.indexes", whole).alias("sparse_indexes"),
        listed("text_sparse.values", whole).alias("sparse_values"), F.char_length("text").alias("n"), F.sha2("text", 256).alias("sha"), F.col("metadata")["lang"].alias("lang"), "source", "memory_type",
    )


# Placeholders ----------------------------------------------------------------------------------------------------

@query("""SELECT doc_id, 'api_for_service_pathology_encoder' AS pathology, 's' || doc_id AS slide_id, '/img/' || doc_id || '.dcm' AS series_path, 'api_for_service_dicom_reader' AS reader, 'placeholder' AS status,
    'api_for_service_knowledge_graph' AS graph, 'api_for_service_document_rag' AS rag, lang AS asked, (2 + (doc_id % 2 = 0)::INT)::INT AS feature_count, CASE WHEN doc_id % 2 = 0 THEN 'a,lang,source' ELSE 'lang,source' END AS context_keys,
    (doc_id % 7) * 0.125 AS calibrated, 'research_only' AS clinical, CASE WHEN doc_id % 3 = 0 THEN 'enabled_research' ELSE 'disabled_local_research' END AS theoretical_quantum FROM documents""")
def placeholders(spark, sf_dir):
    """What the parts answer that only name their service."""
    i = F.col("doc_id")
    two = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    context = F.when(i % 2 == 0, F.map_concat(F.create_map(F.lit("a"), F.lit("1")), two)).otherwise(two)
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", H.pathology(F.concat(F.lit("s"), i.cast("string"))).alias("p"), H.dicom_series(F.concat(F.lit("/img/"), i.cast("string"), F.lit(".dcm"))).alias("d"), H.asked("knowledge_graph", F.col("lang")).alias("g"),
        H.asked("retrieval", F.col("lang")).alias("r"), H.decision(context).alias("h"), H.dreamt(context).alias("m"), H.calibrated((i % 7) * 0.125).alias("c"), H.validation_matrix(i % 3 == 0, F.lit("local_research")).alias("v"),
    )
    return rows.select(
        "doc_id", F.col("p.provider").alias("pathology"), "p.slide_id", "d.series_path", "d.reader", "d.status", F.col("g.provider").alias("graph"), F.col("r.provider").alias("rag"), F.col("r.query").alias("asked"),
        "h.feature_count", F.array_join("m.context_keys", ",").alias("context_keys"), "c.calibrated", "v.clinical", "v.theoretical_quantum",
    )


# Memory --------------------------------------------------------------------------------------------------------

_LOG = """log AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS record_id, ts, event_id, value, CASE event_type WHEN 'purchase' THEN 'promoted' WHEN 'error' THEN 'rejected' ELSE 'candidate' END AS status FROM events)"""
_FOLD = f"""WITH {_LOG}, f AS (
    SELECT record_id, min(ts) AS created_at, max(ts) AS updated_at, CASE WHEN bool_or(status = 'promoted') THEN 'promoted' ELSE arg_max(status, row(ts, event_id)) END AS learning_status,
        arg_max(value, row(ts, event_id)) AS value, count(*) AS events FROM log GROUP BY record_id)"""


def _log(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", "promoted").when(F.col("event_type") == "error", "rejected").otherwise("candidate")
    key = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, sf_dir, "events").select(key.alias("record_id"), "ts", "event_id", "value", status.alias("status"))


@query(_FOLD + " SELECT record_id, created_at, updated_at, learning_status, value, events FROM f")
def memory_fold(spark, sf_dir):
    return M.fold(_log(spark, sf_dir))


@query(_FOLD + " SELECT learning_status, count(*) AS n FROM f GROUP BY 1")
def memory_status_counts(spark, sf_dir):
    return M.status_counts(M.fold(_log(spark, sf_dir)))


@query(f"WITH {_LOG} SELECT record_id, event_id, CASE WHEN status = 'promoted' THEN 'promote' ELSE 'upsert' END AS event FROM log")
def memory_log(spark, sf_dir):
    return _log(spark, sf_dir).select("record_id", "event_id", F.when(F.col("status") == "promoted", "promote").otherwise("upsert").alias("event"))


@query("""SELECT 'case:case-' || doc_id AS record_id, sha256(concat_ws(chr(10), 'case-' || doc_id, nullif(coalesce(text, ''), ''), CASE WHEN doc_id % 3 = 0 THEN 'complaint' END, 'top_hypothesis=candidate_1', 'policy=clear')) AS sha, 'candidate' AS learning_status FROM documents""")
def memory_consolidation(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("case-"), F.col("doc_id").cast("string")).alias("case_id"), F.coalesce("text", F.lit("")).alias("report_text"), F.lit("").alias("ehr_text"),
        F.when(F.col("doc_id") % 3 == 0, "complaint").alias("patient_complaints"), F.lit("candidate_1").alias("top_label"), F.lit("clear").alias("policy_band"),
    )
    return M.consolidated(d).select("record_id", F.sha2("text", 256).alias("sha"), "learning_status")


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, count(*)::INT AS pushed FROM conversations GROUP BY 1")
def workspace_snapshots(spark, sf_dir):
    """A conversation as a workspace that its turns are pushed to."""
    w = M.snapshot(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")
    return w.select("conv_id", F.array_join("items", ",").alias("roles"), F.size("items").alias("pushed"))


@query("SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT 5")
def episodic_first(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy("ts", "event_id").limit(5).select("event_id", "user_id")


@query("SELECT page_id, coalesce(nullif(url, ''), '') AS text, CASE WHEN page_id % 2 = 0 THEN 'p' || page_id ELSE 'doc-' || page_id END AS record_id FROM pages")
def semantic_coalesce(spark, sf_dir):
    i = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("").alias("text"), F.col("url").alias("content"), F.when(i % 2 == 0, F.concat(F.lit("p"), i.cast("string"))).alias("record_id"))
    text, own = Y.semantic_document(pages.columns, ["text", "report_text", "content"], ["id", "record_id"], F.concat(F.lit("doc-"), i.cast("string")))
    return pages.select("page_id", text.alias("text"), own.alias("record_id"))


@query("SELECT event_id, (props->>'k')::INT AS k, event_type || ':' || (props->>'k') AS trace FROM events")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.concat_ws(":", "event_type", k.cast("string")).alias("trace"))


# Imaging -------------------------------------------------------------------------------------------------------

_STUDIES = """st AS (SELECT p_partkey AS study_id, CASE p_partkey % 5 WHEN 0 THEN 'ct' WHEN 1 THEN 'CR' WHEN 2 THEN 'MR' ELSE 'unknown' END AS modality,
    CASE p_partkey % 6 WHEN 0 THEN '.dcm' WHEN 1 THEN '.PNG' WHEN 2 THEN '' WHEN 3 THEN '.jpeg' WHEN 4 THEN '.txt' ELSE '.tif' END AS sx, p_partkey % 4 > 0 AS has, p_size,
    CASE p_partkey % 6 WHEN 0 THEN 'local_metadata' WHEN 1 THEN 'local_pixels' WHEN 2 THEN 'remote_radiology_vlm' WHEN 3 THEN 'remote_dicom_3d' WHEN 4 THEN 'hybrid_multimodal' ELSE 'other' END AS strategy FROM part),
kd AS (SELECT *, CASE WHEN upper(modality) IN ('CT', 'MR', 'PT') THEN 'volumetric_dicom_or_series' WHEN has AND sx = '.dcm' THEN 'dicom_like_series' WHEN has AND lower(sx) IN ('.png', '.jpeg', '.tif') THEN 'projection_or_image_file' ELSE 'metadata_only' END AS kind FROM st)"""


def _studies(spark, sf_dir):
    i = F.col("p_partkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (i % n + 1).cast("int"))
    path = F.concat(F.lit("/img/"), i.cast("string"), pick([".dcm", ".PNG", "", ".jpeg", ".txt", ".tif"], 6))
    strategies = ["local_metadata", "local_pixels", "remote_radiology_vlm", "remote_dicom_3d", "hybrid_multimodal", "other"]
    return table(spark, sf_dir, "part").select(
        i.alias("study_id"), pick(["ct", "CR", "MR", "unknown", "unknown"], 5).alias("modality"), F.when(i % 4 > 0, F.array(path)).otherwise(F.array().cast("array<string>")).alias("paths"), pick(strategies, 6).alias("strategy"), "p_size",
    )


@query(f"""WITH {_STUDIES} SELECT study_id, kind AS input_kind, CASE WHEN has THEN coalesce(nullif(lower(sx), ''), '<no_suffix>') ELSE '' END AS suffixes, has::INT AS image_count,
    CASE strategy WHEN 'local_metadata' THEN CASE WHEN has THEN 'metadata_ready' ELSE 'metadata_only' END WHEN 'local_pixels' THEN CASE WHEN has THEN 'local_pixel_provider_ready' ELSE 'waiting_for_images' END
        WHEN 'other' THEN 'unknown_strategy' ELSE CASE WHEN has THEN 'remote_provider_configured' ELSE 'remote_provider_waiting_for_images' END END AS readiness,
    CASE strategy WHEN 'local_pixels' THEN 'local_pixel_feature_provider' WHEN 'remote_radiology_vlm' THEN 'remote_radiology_vlm_provider' WHEN 'remote_dicom_3d' THEN 'remote_dicom_3d_provider'
        WHEN 'hybrid_multimodal' THEN CASE WHEN kind = 'volumetric_dicom_or_series' THEN 'remote_dicom_3d_provider' ELSE 'remote_radiology_vlm_provider' END ELSE 'local_imaging_feature_provider' END AS provider,
    CASE WHEN kind = 'volumetric_dicom_or_series' THEN 'route_to_3d_dicom_provider' WHEN kind IN ('projection_or_image_file', 'dicom_like_series') THEN 'route_to_projection_radiology_provider' ELSE 'metadata_only_review' END AS route,
    (has AND p_size <= 25)::BIGINT AS existing_count, CASE WHEN has AND p_size <= 25 THEN 'ready' ELSE 'metadata_only' END AS local_readiness FROM kd""")
def imaging_routing(spark, sf_dir):
    studies = _studies(spark, sf_dir)
    there = studies.where("p_size <= 25").select(F.explode("paths").alias("path"))
    out = I.encode_studies(studies, there)
    return out.select("study_id", "input_kind", F.array_join("suffixes", ",").alias("suffixes"), "image_count", "readiness", F.col("provider.name").alias("provider"), "route", "existing_count", "local_readiness")


@query(f"""WITH {_STUDIES}, r AS (SELECT *, strategy IN ('remote_radiology_vlm', 'remote_dicom_3d', 'hybrid_multimodal') AS remote, study_id % 2 = 0 AS enabled, CASE WHEN study_id % 3 = 0 THEN 'https://host' END AS endpoint FROM kd)
    SELECT study_id, has AS encoder_ready, (has::INT - (has AND p_size <= 25)::INT)::BIGINT AS missing_count, CASE WHEN remote THEN 'remote_stub_to_local_features' ELSE 'local_features_only' END AS fallback_mode,
        CASE WHEN remote THEN CASE WHEN enabled AND endpoint IS NOT NULL THEN 'request_prepared' ELSE 'not_called' END END AS status,
        CASE WHEN remote THEN CASE WHEN enabled AND endpoint IS NOT NULL THEN 'network_call_not_implemented_in_research_stub' ELSE 'remote_provider_not_configured' END END AS reason,
        CASE WHEN remote THEN endpoint END AS endpoint, CASE WHEN remote THEN study_id::VARCHAR END AS requested_study, CASE WHEN remote THEN has::INT END AS requested_paths, CASE WHEN remote THEN 30 END AS timeout_seconds FROM r""")
def imaging_requests(spark, sf_dir):
    """Encoded studies with the request that a remote provider would get."""
    studies = _studies(spark, sf_dir)
    out = I.encode_studies(studies, studies.where("p_size <= 25").select(F.explode("paths").alias("path")))
    i = F.col("study_id")
    out = I.with_remote(out, F.lit("volume_encoder"), F.when(i % 3 == 0, "https://host"), i % 2 == 0)
    r = "remote_result"
    return out.select(
        "study_id", "encoder_ready", "missing_count", "fallback_mode", f"{r}.status", f"{r}.reason", f"{r}.request.endpoint", F.col(f"{r}.request.study_id").alias("requested_study"),
        F.when(F.col(r).isNotNull(), F.size(f"{r}.request.series_paths")).alias("requested_paths"), f"{r}.request.timeout_seconds",
    )


@query("""SELECT p_partkey AS study_id, CASE WHEN p_partkey % 3 = 0 THEN p_partkey || '-local-imaging' ELSE 's' || p_partkey END AS first_study, CASE WHEN p_partkey % 3 = 0 THEN 'new.png' WHEN p_partkey % 3 = 1 THEN 'old.png,new.png' ELSE 'old.png' END AS paths FROM part""")
def attach_images(spark, sf_dir):
    i = F.col("p_partkey")
    kind = "array<struct<study_id:string,modality:string,series_paths:array<string>>>"
    study = F.array(F.struct(F.concat(F.lit("s"), i.cast("string")).alias("study_id"), F.lit("CT").alias("modality"), F.array(F.lit("old.png")).alias("series_paths")))
    imaging = F.when(i % 3 == 0, F.array().cast(kind)).otherwise(study)
    new = F.when(i % 3 == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("new.png")))
    rows = table(spark, sf_dir, "part").select(i.alias("study_id"), I.attach_paths(imaging, new, i.cast("string")).alias("im"))
    first = F.element_at("im", 1)
    return rows.select("study_id", first["study_id"].alias("first_study"), F.array_join(first["series_paths"], ",").alias("paths"))


# Payloads ------------------------------------------------------------------------------------------------------

def _fhir_cases(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.struct(F.col("l_returnflag").alias("code"), F.col("l_linenumber").cast("string").alias("value"), F.col("l_linestatus").alias("unit")).alias("o")).alias("x"))
    seen = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["o"]).alias("observations"))
    orders = table(spark, sf_dir, "orders")
    joined = orders.join(seen, orders["o_orderkey"] == seen["l_orderkey"], "left")
    return joined.select(
        F.concat(F.lit("case-"), F.col("o_orderkey").cast("string")).alias("case_id"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("patient-"), F.col("o_custkey").cast("string"))).alias("patient_id"),
        F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority")).alias("report_text"), "observations",
    )


@query("""WITH c AS (SELECT o_orderkey, 'case-' || o_orderkey AS case_id, CASE WHEN o_orderkey % 2 = 0 THEN 'patient-' || o_custkey END AS pid, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS report FROM orders)
    SELECT case_id, 'Patient' AS resource_type, coalesce(pid, case_id) AS id, CAST(NULL AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS unit FROM c
    UNION ALL SELECT case_id, 'DiagnosticReport', 'dr-' || case_id, NULL, report, NULL FROM c WHERE report <> ''
    UNION ALL SELECT case_id, 'Observation', 'obs-' || case_id || '-' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus) - 1), l_returnflag, l_linenumber::VARCHAR, l_linestatus FROM c JOIN lineitem ON l_orderkey = o_orderkey""")
def fhir_resources(spark, sf_dir):
    return Y.resources(_fhir_cases(spark, sf_dir))


@query("""SELECT 'case-' || o_orderkey AS case_id, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'patient-' || o_custkey END, 'case-' || o_orderkey) AS patient_ref, 'report-case-' || o_orderkey AS report_id, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS conclusion FROM orders""")
def fhir_bundle(spark, sf_dir):
    return Y.bundle(_fhir_cases(spark, sf_dir))


@query("""SELECT 'cxr14-' || CASE WHEN p_partkey % 4 = 0 THEN 'cxr-row-' || p_partkey ELSE 'img_' || p_partkey END AS case_id, CASE WHEN p_partkey % 3 = 0 THEN 'synthetic-cxr-patient-' || p_partkey ELSE 'P' || p_partkey END AS patient_id, p_size::VARCHAR AS age, '' AS sex,
    'ChestX-ray14-style weak-label case. Finding labels: ' || CASE WHEN p_partkey % 5 = 0 THEN 'No Finding' ELSE p_type END || '. Labels are metadata-derived and should be treated as weak supervision only.' AS report_text,
    CASE WHEN p_partkey % 4 = 0 THEN 'cxr-row-' || p_partkey ELSE 'img_' || p_partkey || '.png' END AS study_id, '/root/' || CASE WHEN p_partkey % 4 = 0 THEN 'cxr-row-' || p_partkey ELSE 'img_' || p_partkey || '.png' END AS series_path FROM part""")
def csv_payload_cxr(spark, sf_dir):
    i = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        i.alias("row_index"), F.when(i % 4 == 0, "  ").otherwise(F.concat(F.lit(" img_"), i.cast("string"), F.lit(".png "))).alias("Image Index"), F.when(i % 5 != 0, F.col("p_type")).alias("Finding Labels"),
        F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("P"), i.cast("string"))).alias("patient_id"), F.col("p_size").alias("Patient Age"),
    )
    return cxr_cases(rows, image_root="/root/").select("case_id", "patient_id", "age", "sex", "report_text", "study_id", "series_path")


@query("""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'cxr-row-' || p_partkey ELSE 'img_' || p_partkey || '.png' END AS image, CASE WHEN p_partkey % 5 = 0 THEN 'No Finding' ELSE p_type END AS findings, p_size FROM part)
    SELECT p_partkey, 'cxr14-' || regexp_replace(image, '\\.png$', '') AS case_id, p_size::VARCHAR AS age, image AS study_id, 'CR' AS modality, '/root/' || image AS series_path, findings AS finding_labels, 'PA' AS view_position, 'NIH ChestX-ray14-style metadata' AS source,
        'false' AS contains_real_patient_data, '' AS errors FROM r""")
def csv_payloads_nested(spark, sf_dir):
    """CSV rows as whole payloads, with nested imaging, demographics and provenance, which the intake takes."""
    i = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        i.alias("row_index"), F.when(i % 4 == 0, "  ").otherwise(F.concat(F.lit(" img_"), i.cast("string"), F.lit(".png "))).alias("Image Index"), F.when(i % 5 != 0, F.col("p_type")).alias("Finding Labels"),
        F.col("p_size").alias("Patient Age"), F.lit("PA").alias("View Position"),
    )
    good, _ = N.from_payload(nested_payloads(cxr_cases(rows, image_root="/root/"), "row_index"))
    study = F.element_at("imaging", 1)
    v = validated(good)
    return v.select(
        F.col("row_index").alias("p_partkey"), "case_id", F.col("demographics")["age"].alias("age"), study["study_id"].alias("study_id"), study["modality"].alias("modality"), F.element_at(study["series_paths"], 1).alias("series_path"),
        study["metadata"]["finding_labels"].alias("finding_labels"), study["metadata"]["view_position"].alias("view_position"), F.col("provenance")["source"].alias("source"),
        F.col("provenance")["contains_real_patient_data"].alias("contains_real_patient_data"), F.array_join("errors", ";").alias("errors"),
    )


@query("""SELECT 'openi-u' || p_partkey AS case_id, 'openi-synthetic-patient-' || p_partkey AS patient_id, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS patient_complaints, 'openi-image-' || p_partkey || '.png' AS study_id,
    coalesce(nullif(concat_ws(' ', CASE WHEN p_partkey % 2 = 0 THEN 'Indication: ' || p_brand END, CASE WHEN p_partkey % 3 = 0 THEN 'Findings: ' || p_type END, CASE WHEN p_partkey % 5 = 0 THEN 'Impression: ' || p_name END), ''), 'Open-i-style report metadata without narrative text.') AS report_text FROM part""")
def csv_payload_openi(spark, sf_dir):
    i = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        i.alias("row_index"), F.concat(F.lit("u"), i.cast("string"), F.lit(".xml")).alias("uid"), F.when(i % 2 == 0, F.col("p_brand")).alias("indication"), F.when(i % 3 == 0, F.col("p_type")).alias("report_findings"), F.when(i % 5 == 0, F.col("p_name")).otherwise(" ").alias("impression"),
    )
    return openi_cases(rows).select("case_id", "patient_id", "patient_complaints", "study_id", "report_text")


def _payloads(spark, sf_dir):
    i = F.col("doc_id")
    study = F.array(F.struct(F.lit("s").alias("study_id"), F.when(i % 4 == 0, "CR").when(i % 4 == 1, "ct_3d").otherwise("XX").alias("modality")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.when(i % 9 == 0, "").otherwise(F.concat(F.lit("case-"), i.cast("string"))).alias("case_id"), F.when(i % 2 == 0, F.col("text")).otherwise("").alias("report_text"), F.lit("").alias("ehr_text"), F.lit(None).cast("string").alias("patient_complaints"),
        F.when(i % 3 == 0, study).otherwise(F.array().cast("array<struct<study_id:string,modality:string>>")).alias("imaging"),
    )


@query("""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'missing_required_field:case_id' ELSE '' END AS errors, CASE WHEN (doc_id % 2 = 1 OR coalesce(text, '') = '') AND doc_id % 3 <> 0 THEN 'minimal_payload_without_narrative_or_imaging' ELSE '' END AS warnings, doc_id % 9 <> 0 AS valid,
    doc_id % 3 <> 0 OR doc_id % 4 IN (0, 1) AS modality_ok FROM documents""")
def validate_payloads(spark, sf_dir):
    v = known_modalities(validated(_payloads(spark, sf_dir)))
    return v.select("doc_id", F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"), "valid", "modality_ok")


@query("SELECT count(*) AS cases, count(*) FILTER (doc_id % 9 = 0) AS failed, CASE WHEN count(*) FILTER (doc_id % 9 = 0) > 0 THEN 2 ELSE 0 END AS exit_code, CASE WHEN count(*) FILTER (doc_id % 9 = 0) > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM documents")
def batch_summary(spark, sf_dir):
    v = validated(_payloads(spark, sf_dir))
    return summed(v.withColumn("status", F.when(F.col("valid"), "completed").otherwise("invalid_payload")))


# Registries ----------------------------------------------------------------------------------------------------

@query(f"SELECT * FROM (VALUES {', '.join(str(tuple(r)) for r in dims.CATALOG if r[1] == 'deidentified_ehr_icu_hospital')}) t(name, modality, access_policy, license_or_terms, recommended_use, caution, url)")
def dataset_catalog(spark, sf_dir):
    return dims.catalog(spark).where(F.col("modality") == "deidentified_ehr_icu_hospital")


def _capabilities(spark, sf_dir):
    """Parts as capabilities: the type is the role, brand and type are modalities, the words of the name areas."""
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_type").alias("role"), F.array("p_brand", "p_type").alias("modalities"),
        F.split("p_name", " ").alias("areas"), F.col("p_size").cast("int").alias("priority"),
    )


_CAPABLE = "c AS (SELECT p_partkey, p_name || '-' || p_partkey AS name, p_type AS role, p_brand, string_split(p_name, ' ') AS areas, p_size::INT AS priority FROM part)"
_ASKED = """q AS (SELECT list_extract(string_split(min(p_name), ' '), 1) AS area, min(p_brand) AS modality, max(p_type) AS role FROM part)"""


@query(f"""WITH {_CAPABLE}, {_ASKED}, f AS (
        SELECT 'area' AS asked, name, priority, p_partkey FROM c, q WHERE list_contains(areas, area) UNION ALL SELECT 'modality', name, priority, p_partkey FROM c, q WHERE p_brand = modality OR c.role = modality
        UNION ALL SELECT 'role', name, priority, p_partkey FROM c, q WHERE c.role = q.role UNION ALL SELECT 'both', name, priority, p_partkey FROM c, q WHERE list_contains(areas, area) AND c.role = q.role)
    SELECT asked, name, priority, row_number() OVER (PARTITION BY asked ORDER BY priority, p_partkey)::INT AS place FROM f""")
def registry_select(spark, sf_dir):
    """Capabilities that fit what is asked for, by priority: an area, a modality, a role, or two of them."""
    from pyspark.sql import Window

    parts, own = table(spark, sf_dir, "part"), _capabilities(spark, sf_dir)
    asked = parts.agg(F.element_at(F.split(F.min("p_name"), " "), 1).alias("area"), F.min("p_brand").alias("modality"), F.max("p_type").alias("asked_role"))
    rows = own.join(F.broadcast(asked))  # one row
    area, modality, role = F.col("area"), F.col("modality"), F.col("asked_role")
    ways = {"area": dims.supports(area=area), "modality": dims.supports(modality=modality), "role": dims.supports(role=role), "both": dims.supports(area=area, role=role)}
    fits = rows.select("name", "priority", "p_partkey", F.explode(F.array_compact(F.array(*(F.when(w, F.lit(n)) for n, w in ways.items())))).alias("asked"))
    return fits.select("asked", "name", "priority", F.row_number().over(Window.partitionBy("asked").orderBy("priority", "p_partkey")).alias("place"))


@query(f"""WITH {_CAPABLE} SELECT 'multimodal_multimodel_signal_orchestration' AS strategy, 'orchestrator' AS final_authority, count(*) AS capabilities, sha256(string_agg(name, '|' ORDER BY priority, p_partkey)) AS ordered_sha FROM c""")
def registry_record(spark, sf_dir):
    """The record of a registry: who decides, and all capabilities by priority."""
    r = dims.decision_record(_capabilities(spark, sf_dir), "p_partkey")
    return r.select("strategy", "final_authority", F.size("capabilities").cast("long").alias("capabilities"), F.sha2(F.array_join("capabilities", "|"), 256).alias("ordered_sha"))


@query("""WITH s(task, provider, enabled) AS (VALUES ('volume_encoder', 'local_imaging_feature_provider', true), ('report_encoder', 'local_text_encoder', true), ('critique', 'external_critic', false)),
    t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'volume_encoder' WHEN 1 THEN 'critique' WHEN 2 THEN 'model_router' ELSE 'mcp_tool' END AS task FROM events)
    SELECT event_id, t.task, coalesce(provider, 'router_only') AS provider, coalesce(enabled, false) AS available, CASE WHEN t.task LIKE '%router%' THEN 'a2a' WHEN t.task LIKE '%mcp%' THEN 'mcp' ELSE 'service' END AS protocol FROM t LEFT JOIN s ON s.task = t.task""")
def service_lookup(spark, sf_dir):
    i = F.col("event_id")
    tasks = table(spark, sf_dir, "events").select("event_id", F.when(i % 4 == 0, "volume_encoder").when(i % 4 == 1, "critique").when(i % 4 == 2, "model_router").otherwise("mcp_tool").alias("task"))
    joined = tasks.join(F.broadcast(dims.services(spark)), "task", "left")  # a constant table of three rows
    return joined.select("event_id", "task", F.coalesce("provider", F.lit("router_only")).alias("provider"), F.coalesce("enabled", F.lit(False)).alias("available"), dims.protocol(F.col("task")).alias("protocol"))


@query("SELECT event_type AS task, arg_max(event_id, row(ts, event_id)) AS event_id, count(*) > 0 AS known FROM events GROUP BY 1")
def latest_registration(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("task"), "event_id", F.struct("ts", "event_id").alias("at"))
    return dims.latest(e, "task", "at").select("task", "event_id", F.lit(True).alias("known"))


@query("""WITH s AS (SELECT event_type || '-' || user_id % 7 AS task, arg_max(value, row(ts, event_id)) > 50 AS enabled FROM events GROUP BY 1)
    SELECT enabled, count(*) AS n, string_agg(task, ',' ORDER BY task) AS tasks FROM s GROUP BY enabled""")
def service_partition(spark, sf_dir):
    """Services that events register again and again: enabled and disabled ones by their last registration."""
    e = table(spark, sf_dir, "events").select(F.concat_ws("-", "event_type", (F.col("user_id") % 7).cast("string")).alias("task"), (F.col("value") > 50).alias("enabled"), F.struct("ts", "event_id").alias("at"))
    return dims.partitioned(dims.latest(e, "task", "at")).select("enabled", "n", F.array_join("tasks", ",").alias("tasks"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'rejected' ELSE 'prepared' END AS status FROM pages""")
def object_upsert_check(spark, sf_dir):
    objects = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, "NoSuchClass").when(F.col("page_id") % 3 == 1, "Symptom").otherwise("ClinicalCase").alias("class"))
    good, bad = Y.checked(objects, F.broadcast(dims.classes(spark)))  # a constant table of seven rows
    return good.select("page_id", F.lit("prepared").alias("status")).unionByName(bad.select("page_id", F.lit("rejected").alias("status")))


@query("""SELECT 'case:' || conv_id AS src, 'hasTurn' AS predicate, 'turn:' || conv_id || ':' || turn AS dst FROM conversations""")
def memory_edges(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    own = F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    return Y.edges(c.select(F.concat(F.lit("case:"), F.col("conv_id").cast("string")).alias("id"), F.array(F.struct(F.lit("hasTurn").alias("predicate"), own.alias("to"))).alias("relations")))


# Adapters ------------------------------------------------------------------------------------------------------

_CONFIGURED = "SELECT event_id, event_id % 2 = 0 AS e, CASE event_id % 3 WHEN 0 THEN 'https://host' WHEN 1 THEN '' END AS p, event_id % 5 = 0 AS d, event_id % 7 <> 0 AS c FROM events"


def _configured(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", (i % 2 == 0).alias("e"), F.when(i % 3 == 0, "https://host").when(i % 3 == 1, "").alias("p"), (i % 5 == 0).alias("d"), (i % 7 != 0).alias("c"))


@query(f"""SELECT event_id, CASE WHEN ok THEN 'request_prepared' ELSE 'not_called' END AS status, CASE WHEN ok THEN 'network_call_stub' ELSE 'contract_only' END AS mode, 0.0 AS confidence, 1.0 AS uncertainty,
        CASE WHEN ok THEN 'actual_inference_adapter_required;research_use_only' ELSE 'network_call_not_implemented;research_use_only' END AS limitations,
        CASE WHEN ok THEN 'network_call_not_implemented_in_research_stub' ELSE 'remote_provider_not_configured' END AS imaging_reason, true AS fallback_required
    FROM (SELECT event_id, e AND coalesce(p, '') <> '' AS ok FROM ({_CONFIGURED}))""")
def adapter_requests(spark, sf_dir):
    a = _configured(spark, sf_dir).select("event_id", D.specialist_response(F.col("e"), F.col("p")).alias("s"), D.imaging_response(F.col("e"), F.col("p")).alias("r"))
    own = [F.col(f"s.{c}").alias(c) for c in ("status", "mode", "confidence", "uncertainty")]
    return a.select("event_id", *own, F.array_join("s.limitations", ";").alias("limitations"), F.col("r.reason").alias("imaging_reason"), F.col("r.fallback_required").alias("fallback_required"))


@query(f"""SELECT event_id, e AND NOT d AND coalesce(p, '') <> '' AND c AS ready,
        concat_ws(';', CASE WHEN NOT e THEN 'adapter_disabled' END, CASE WHEN d THEN 'dry_run_enabled' END, CASE WHEN coalesce(p, '') = '' THEN 'endpoint_missing' END, CASE WHEN NOT c THEN 'weaviate_client_unavailable' END) AS reasons
    FROM ({_CONFIGURED})""")
def store_readiness(spark, sf_dir):
    a = _configured(spark, sf_dir).select("event_id", D.live_readiness(F.col("e"), F.col("d"), F.col("p"), F.col("c")).alias("r"))
    return a.select("event_id", F.col("r.ready").alias("ready"), F.array_join("r.reasons", ";").alias("reasons"))


@query(f"""WITH d AS (
        SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'docling' ELSE 'plain_text_fallback' END AS parser, CASE WHEN doc_id % 4 = 0 THEN '# ' || coalesce(text, '') WHEN doc_id % 5 <> 0 THEN text END AS t FROM documents
    ), n AS (
        SELECT doc_id, count(*) AS n FROM (SELECT doc_id, {_STRIP.format("substr(t, idx * 1040 + 1, 1200)")} AS chunk FROM (SELECT doc_id, t, unnest(range(0, ((length(t) + 1039) // 1040)::INT)) AS idx FROM d WHERE t IS NOT NULL)) WHERE chunk <> '' GROUP BY 1
    ) SELECT d.doc_id, CASE WHEN t IS NULL THEN 'failed' ELSE 'completed' END AS status, parser, CASE WHEN t IS NOT NULL THEN coalesce(n, 0)::INT END AS chunk_count,
        CASE doc_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'not_executed' ELSE 'not_requested' END AS converter_status FROM d LEFT JOIN n USING (doc_id)""")
def parsed_documents(spark, sf_dir):
    i = F.col("doc_id")
    plain, status = F.when(i % 5 != 0, F.col("text")), F.when(i % 4 == 0, "completed").when(i % 4 == 1, "failed").when(i % 4 == 2, "not_executed")
    d = table(spark, sf_dir, "documents").select("doc_id", D.parsed_document(plain, status, F.concat(F.lit("# "), F.coalesce("text", F.lit("")))).alias("o"))
    return d.select("doc_id", "o.*")

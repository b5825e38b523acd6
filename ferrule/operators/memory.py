"""The semantic memory as a fold over its event log, and vector search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bucket_sums, dot, present, stable_id
from .payloads import point_vectors


def fold(log: DataFrame, key: str = "record_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The state of every record after a log of events (status, value and the order of arrival).

    The last event gives the record, the first its creation, and a status of
    promoted stays once reached. One aggregation with map-side combining.
    """
    at = F.struct(*order)
    last = F.max(F.struct(*order, "status", "value"))
    promoted = F.max(F.col("status") == "promoted")
    rows = log.groupBy(key).agg(F.min(at).alias("first"), last.alias("last"), promoted.alias("_p"), F.count(F.lit(1)).alias("events"))
    return rows.select(
        key, F.col(f"first.{order[0]}").alias("created_at"), F.col(f"last.{order[0]}").alias("updated_at"), F.when(F.col("_p"), "promoted").otherwise(F.col("last.status")).alias("learning_status"),
        F.col("last.value").alias("value"), "events",
    )


#: Rows that are numbered in one task.
RUN_ROWS = 100_000


def numbered(rows: DataFrame, by: str, name: str = "place") -> DataFrame:
    """(by, place): every row's place from 1 in ascending order of a whole number, without one task that sees all rows.

    Rows are counted in ranges of the number, the counts are summed up, and only
    the rows of one range are sorted together. Equal numbers get places in any order.
    """
    ends = rows.agg(F.min(by).alias("low"), F.max(by).alias("high"), F.count(F.lit(1)).alias("n")).first()
    if not ends.n:
        return rows.select(by, F.lit(None).cast("long").alias(name))
    width = max((ends.high - ends.low + 1) * RUN_ROWS // ends.n, 1)
    own = rows.select(by, F.floor((F.col(by) - ends.low) / width).alias("_r"))
    counts = own.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = own.join(counts.select(F.col("_r").alias("_q"), before.alias("_b")), F.col("_r") == F.col("_q"))
    return placed.select(by, (F.col("_b") + F.row_number().over(Window.partitionBy("_r").orderBy(by))).alias(name))


def snapshot(pushed: DataFrame, key: str, order: str, item: str) -> DataFrame:
    """(key, items): what was pushed to each workspace, in the order of arrival. A workspace is small: one per case."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, item))), lambda x: x[item])
    return pushed.groupBy(key).agg(listed.alias("items"))


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("learning_status").agg(F.count(F.lit(1)).alias("n"))


UPSERT = ("text", "metadata", "modality", "source", "status")


def replay(log: DataFrame, order: tuple[str, ...] = ("ts", "event_id"), collection: str = "memory") -> tuple[DataFrame, DataFrame]:
    """The records after a log of upserts and promotions, and the rejected promotions.

    ``log`` has event (upsert or promote), record_id (null: named by the text),
    text, metadata, modality, source, status, reason and the order of arrival. The
    last upsert gives the whole record, the first its creation; once promoted, by a
    status or by a promotion, a record stays so; a promotion's reason is lost
    with the metadata that the next upsert replaces. A promotion of a record that
    no earlier upsert made is rejected. One aggregation with map-side combining.
    """
    key = F.coalesce(F.nullif("record_id", F.lit("")), stable_id(F.lit(collection), F.coalesce("text", F.lit(""))))
    rows = log.withColumn("record_id", key)
    at = F.struct(*order)
    upsert, promote = F.col("event") == "upsert", F.col("event") == "promote"
    state = rows.groupBy("record_id").agg(
        F.min(F.when(upsert, at)).alias("_first"), F.max(F.when(upsert, at)).alias("_last"), F.max_by(F.struct(*UPSERT), F.when(upsert, at)).alias("_r"), F.max(F.when(promote, at)).alias("_p"),
        F.max_by("reason", F.when(promote, at)).alias("_why"), F.coalesce(F.max(F.when(upsert, F.col("status") == "promoted")), F.lit(False)).alias("_sticky"),
    ).where("_first is not null")
    promoted = F.coalesce(F.col("_p") > F.col("_first"), F.lit(False))
    fresh = F.coalesce(F.col("_p") > F.col("_last"), F.lit(False))
    plain = F.coalesce("_r.metadata", F.create_map().cast("map<string,string>"))
    known = F.map_filter(plain, lambda k, _: k != "promotion_reason")
    records = state.select(
        "record_id", "_r.text", F.when(fresh, F.map_concat(known, F.create_map(F.lit("promotion_reason"), F.col("_why")))).otherwise(plain).alias("metadata"), "_r.modality", "_r.source",
        F.when(F.col("_sticky") | promoted, "promoted").otherwise(F.col("_r.status")).alias("learning_status"), F.col(f"_first.{order[0]}").alias("created_at"),
        F.greatest(F.col("_last"), F.when(promoted, F.col("_p")))[order[0]].alias("updated_at"),
    )
    made = state.select(F.col("record_id").alias("_id"), "_first")
    rejected = rows.where(promote).join(made, F.col("record_id") == F.col("_id"), "left").where(F.col("_first").isNull() | (at < F.col("_first")))
    return records, rejected.select("record_id", *order, F.lit("unknown_record_id").alias("why"))


def embedded(records: DataFrame, embed: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """``records`` with ``vector`` by an embedding function of the text, which callers may replace."""
    return records.withColumn("vector", embed(F.col(text)))


def update_log(log: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """What each event of a log leaves in the update log: metadata keys in order and the number of relations too."""
    keys = F.array_sort(F.map_keys(F.coalesce("metadata", F.create_map().cast("map<string,string>"))))
    return log.select("event", "record_id", *order, "modality", "source", keys.alias("metadata_keys"), F.coalesce(F.size("relations"), F.lit(0)).alias("relation_count"), "reason")


def search_envelope(hits: DataFrame, queries: DataFrame, query_id: str, k: int, filters: dict[str, str] | None = None) -> DataFrame:
    """One row a query: what was asked and the ranked ids that were found; queries without a hit too."""
    found = hits.groupBy(query_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))), lambda h: h).alias("hits"))
    none = F.array().cast("array<struct<rank:int,vec_id:bigint,score:double>>")
    out = queries.select(query_id).join(found, query_id, "left").withColumn("hits", F.coalesce("hits", none))
    pairs = F.array(*(F.lit(x) for kv in sorted((filters or {}).items()) for x in ("=".join(kv),))) if filters else F.array().cast("array<string>")
    return out.withColumns({"top_k": F.lit(k), "filters": pairs, "hit_count": F.size("hits")})


#: Query vectors that are searched together; the caller's queries go through in so many rounds.
QUERIES = 512


def top_hits_of(records: DataFrame, queries: DataFrame, query_id: str, vector: str = "vector", limit: int = 5, ties: str = "vec_id") -> DataFrame:
    """(query_id, vec_id, score, rank) for a table of query vectors (query_id, query) against all records.

    Queries are packed into blocks of ``QUERIES``, so a record meets blocks, and
    each task keeps the best of a query before anything is shuffled.
    """
    blocks = queries.groupBy(F.pmod(F.xxhash64(query_id), F.lit(max(1, -(-queries.count() // QUERIES)))).alias("_b")).agg(F.collect_list(F.struct(query_id, "query")).alias("_qs"))
    numbers = blocks.select(F.collect_list("_b").alias("_bs"))  # one number a block
    met = records.join(F.broadcast(numbers)).withColumn("_b", F.explode("_bs")).join(blocks, "_b").withColumn("_q", F.explode("_qs"))
    scored = met.select(F.col(f"_q.{query_id}").alias(query_id), F.col(ties).alias("vec_id"), F.round(dot(F.col(vector), F.col("_q.query")), 6).alias("score"))
    place = Window.partitionBy(query_id).orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= limit)


def embedding_sums(docs: DataFrame, ids: list[str], text: str = "text", dimensions: int = 128) -> DataFrame:
    """Whole-number bucket sums of the byte hash: (ids, bucket, total), buckets that are not empty.

    Every row is summed up on its own, without a shuffle; an empty text has no bucket.
    """
    return docs.select(*ids, F.posexplode(bucket_sums(F.col(text), dimensions)).alias("bucket", "total")).where("total > 0")


def embed(text: Column) -> Column:
    """The built-in embedding: bucket sums of a text divided by their length, to six digits; zeros for an empty text."""
    return point_vectors(text)["dense"]


def search_filter(status: list[str] | None, wanted: dict[str, str], metadata: str = "metadata") -> Column:
    """Status within the list (none: any) and every metadata key equal to the wanted value; a missing key equals null."""
    out = F.col("learning_status").isin(status) if status else F.lit(True)
    for k, v in wanted.items():
        out = out & F.try_element_at(metadata, F.lit(k)).eqNullSafe(F.lit(v))
    return out


def top_hits(records: DataFrame, query: Column, vector: str = "vector", limit: int = 5, ties: str = "vec_id") -> DataFrame:
    """The most similar records to one query vector, ranked from 1."""
    scored = records.withColumn("score", F.round(dot(F.col(vector), query), 6))
    best = scored.orderBy(F.col("score").desc(), ties).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), ties)))


def top_hits_by_group(records: DataFrame, query: Column, group: str, vector: str = "vector", limit: int = 5, ties: str = "vec_id") -> DataFrame:
    scored = records.withColumn("score", F.round(dot(F.col(vector), query), 6))
    place = Window.partitionBy(group).orderBy(F.col("score").desc(), ties)
    return scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= limit)


def consolidated(cases: DataFrame) -> DataFrame:
    """The memory record of a case: its texts line by line, with its top hypothesis and policy where known."""
    texts = [F.when(present(F.col(c)), F.col(c)) for c in ("report_text", "ehr_text", "patient_complaints")]
    top = [F.concat(F.lit("top_hypothesis="), F.col("top_label")), F.concat(F.lit("policy="), F.col("policy_band"))]
    return cases.select(F.concat(F.lit("case:"), F.col("case_id")).alias("record_id"), F.concat_ws("\n", F.col("case_id"), *texts, *top).alias("text"), F.lit("candidate").alias("learning_status"))


def consolidation_relations(cases: DataFrame) -> DataFrame:
    """(id, relations): what consolidation says about the record of a case."""
    trace = F.struct(F.lit("hasClinicalTrace").alias("predicate"), F.lit("clinical_pipeline_result").alias("to"))
    return cases.select(F.concat(F.lit("case:"), F.col("case_id")).alias("id"), F.array(trace).alias("relations"))


def fused_ranks(hits: list[DataFrame], key: str, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of several hit lists (key, rank). An extension."""
    rows = [h.select(key, (1.0 / (constant + F.col("rank"))).alias("s")) for h in hits]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.groupBy(key).agg(F.sum("s").alias("score"))

"""Cases as resources, memory documents, points and graph edges."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import canonical_hash, chunk_id, chunks_collapsed, first_present, present


def resources(cases: DataFrame) -> DataFrame:
    """One row a resource: the patient, the report if any, and each observation with its index."""
    rid = first_present(F.col("patient_id"), F.col("case_id"))
    none = F.lit(None).cast("string")

    def row(kind: str, own: Column, value: Column, unit: Column = none, code: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("resource_type"), own.alias("id"), code.alias("code"), value.alias("value"), unit.alias("unit"))

    report = F.when(present(F.col("report_text")), row("DiagnosticReport", F.concat(F.lit("dr-"), F.col("case_id")), F.col("report_text")))
    seen = F.transform("observations", lambda o, i: row("Observation", F.concat(F.lit("obs-"), F.col("case_id"), F.lit("-"), i.cast("string")), o["value"], o["unit"], o["code"]))
    every = F.concat(F.array_compact(F.array(row("Patient", rid, none), report)), F.coalesce(seen, F.array().cast("array<struct<resource_type:string,id:string,code:string,value:string,unit:string>>")))
    return cases.select("case_id", F.explode(every).alias("r")).select("case_id", "r.*")


def bundle(cases: DataFrame) -> DataFrame:
    """The two-entry bundle of a case."""
    rid = first_present(F.col("patient_id"), F.col("case_id"))
    return cases.select("case_id", rid.alias("patient_ref"), F.concat(F.lit("report-"), F.col("case_id")).alias("report_id"), F.coalesce("report_text", F.lit("")).alias("conclusion"))


def memory_document(chunk: Column, base: dict[str, Column], more: Column) -> Column:
    """A chunk with metadata: the base entries, overridden by ``more`` (a map)."""
    own = F.create_map(*(x for k, v in base.items() for x in (F.lit(k), v)))
    kept = F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys(more), k))
    return F.struct(chunk.alias("text"), F.map_concat(kept, more).alias("metadata"))


def sparse(docs: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """(ids, idx, n): tokens of the lower-cased text by the sum of their code points, counted within the row."""
    own = point_vectors(F.col(text), 0)
    rows = docs.select(*ids, own.alias("_v")).select(*ids, F.explode(F.arrays_zip("_v.indexes", "_v.counts")).alias("_x"))
    return rows.select(*ids, F.col("_x.indexes").alias("idx"), F.col("_x.counts").cast("long").alias("n"))


def _dense(text: str, dimensions: int) -> list[float]:
    """Bucket sums of the positional byte hash (as bucket_sums), divided by their length, to six digits; zeros for an empty text."""
    data = np.frombuffer(text.encode(), dtype=np.uint8).astype(np.int64)
    sums = np.bincount((data + np.arange(len(data))) % dimensions, weights=data % 31 + 1, minlength=dimensions)
    norm = math.sqrt(float((sums * sums).sum())) or 1.0
    return [round(x / norm, 6) for x in sums.tolist()]


def point_vectors(text: Column, dimensions: int = 128) -> Column:
    """The dense vector of a whole text (empty for no dimensions), and the indexes (ascending) and counts of its sparse one; null is an empty text.

    Each row is a point of its own, also where ids repeat, and an empty text has one
    too, so this does not group exploded bytes and tokens by id.
    """

    @F.arrow_udf("dense array<double>, indexes array<int>, counts array<double>")
    def built(texts: pa.Array) -> pa.Array:
        places: dict[str, int] = {}
        dense, indexes, counts = [], [], []
        for value in texts:
            own = value.as_py() or ""
            dense.append(_dense(own, dimensions) if dimensions else [])
            sums: dict[int, float] = {}
            for token, n in Counter(own.lower().split()).items():
                if (at := places.get(token)) is None:
                    at = places[token] = sum(map(ord, token)) % 100_000
                sums[at] = sums.get(at, 0.0) + n
            indexes.append(sorted(sums))
            counts.append([sums[i] for i in indexes[-1]])
        parts = [pa.array(dense, pa.list_(pa.float64())), pa.array(indexes, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float64()))]
        return pa.StructArray.from_arrays(parts, names=["dense", "indexes", "counts"])

    return built(text)


def point(own_id: Column, text: Column, metadata: Column, source: Column) -> Column:
    """The point of a record: its id, the dense and the sparse vector of its whole text, and the payload."""
    text = F.coalesce(text, F.lit(""))
    found = point_vectors(text)
    vector = F.struct(found["dense"].alias("text_dense"), F.struct(found["indexes"].alias("indexes"), found["counts"].alias("values")).alias("text_sparse"))
    payload = F.struct(text.alias("text"), metadata.alias("metadata"), source.alias("source"), F.lit("clinical_semantic_memory").alias("memory_type"))
    return F.struct(own_id.alias("id"), vector.alias("vector"), payload.alias("payload"))


#: The vectors of a point with their sizes, the distance, and what stands for a call that is not made.
VECTORS = {"text_dense": 128, "image_dense": 128}
SPARSE, DISTANCE, FUSION, NOT_SENT = "text_sparse", "Cosine", "reciprocal_rank_fusion_candidate", "not_sent_offline_contract"


def collection_schema(spark: SparkSession, collection: str) -> DataFrame:
    """A row for every vector of the collection: name, kind, size and distance."""
    rows = [(collection, name, "dense", size, DISTANCE) for name, size in VECTORS.items()] + [(collection, SPARSE, "sparse", None, None)]
    return spark.createDataFrame(rows, "collection string, vector string, kind string, size int, distance string")


def hybrid_query(text: Column, limit: int = 5, filters: Column | None = None) -> Column:
    """The prepared query of a text: its dense and its sparse vector, how both are fused, limit and filters."""
    found = point_vectors(F.coalesce(text, F.lit("")))
    dense = F.struct(F.lit("text_dense").alias("name"), found["dense"].alias("vector"))
    own = F.struct(F.lit(SPARSE).alias("name"), found["indexes"].alias("indexes"), found["counts"].alias("values"))
    none = F.create_map().cast("map<string,string>")
    return F.struct(
        F.struct(dense.alias("dense"), own.alias("sparse"), F.lit(FUSION).alias("fusion")).alias("query"), F.lit(limit).alias("limit"), (none if filters is None else filters).alias("filters"), F.lit(NOT_SENT).alias("execution"),
    )


def prepared_upsert(known: Column, kind: Column, own_id: Column, properties: Column, references: Column, ready: Column | None = None) -> Column:
    """The request that would store an object: rejected for an unknown class, otherwise prepared, or not executed where the store is not ready.

    ``ready`` is a struct of ``adapters.live_readiness``; without it the request is only prepared.
    """
    status = F.when(~known, "rejected")
    reason = F.when(~known, F.array(F.lit("unknown_schema_class")))
    if ready is not None:
        status = status.when(~ready["ready"], "not_executed").otherwise("requires_infrastructure_subclass")
        reason = reason.when(~ready["ready"], ready["reasons"]).otherwise(F.array(F.lit("live_upsert_deliberately_not_hardcoded_in_core")))
    else:
        status, reason = status.otherwise("prepared"), reason.otherwise(F.array().cast("array<string>"))
    return F.struct(
        status.alias("status"), reason.alias("reason"), F.when(known, "upsert_object").alias("operation"), kind.alias("class_name"), F.when(known, own_id).alias("object_id"), F.when(known, properties).alias("properties"),
        F.when(known, references).alias("references"), F.when(known, F.coalesce(properties["learning_status"], F.lit("candidate"))).alias("learning_status"), F.when(known, F.lit(True)).alias("requires_provenance"),
    )


def prepared_search(known: Column, kind: Column, query: Column, target: Column, limit: int = 5) -> Column:
    """The request that would search a class, rejected for an unknown one."""
    return F.struct(
        F.when(known, "prepared").otherwise("rejected").alias("status"), F.when(~known, "unknown_schema_class").alias("reason"), F.when(known, "semantic_search").alias("operation"), kind.alias("class_name"),
        F.when(known, query).alias("query"), F.when(known, target).alias("target_vector"), F.when(known, F.lit(limit)).alias("limit"),
    )


def chunk_record(own_id: Column, chunk: Column, path: Column, more: Column, source: str) -> Column:
    """A chunk as a record: text, metadata (of the path, overridden by ``more``) and where it comes from."""
    base = memory_document(chunk, {"source_path": path}, more)
    return F.struct(own_id.alias("record_id"), base["text"].alias("text"), base["metadata"].alias("metadata"), F.lit(source).alias("source"))


def ingested(files: DataFrame, source: str, document_type: str) -> DataFrame:
    """The log of upserts that texts (path, text) make: a record for every collapsed chunk, named by the file's stem."""
    rows = files.select("path", F.explode(chunks_collapsed(F.col("text"))).alias("c"))
    fixed = {"source": F.lit(source), "path": F.col("path"), "document_type": F.lit(document_type), "parser_mode": F.lit("local_text_ingestion_contract"), "chunk_index": F.col("c.idx").cast("string")}
    own = chunk_id("collapsed", F.col("path"), F.col("c.idx"))
    return rows.select(
        F.lit("upsert").alias("event"), own.alias("record_id"), F.col("c.chunk").alias("text"), F.create_map(*(x for k, v in fixed.items() for x in (F.lit(k), v))).alias("metadata"), F.lit("text").alias("modality"),
        F.lit(source).alias("source"), F.lit("candidate").alias("status"), F.lit(None).cast("string").alias("reason"), F.lit(0).alias("ts"), F.col("c.idx").alias("event_id"),
    )


def prediction_lock(protocol: str, case_id: Column, payload: Column, created_at: Column) -> Column:
    """A locked prediction: its id from protocol, case, payload hash and time of creation (whole epoch seconds)."""
    own = canonical_hash(payload)
    stamp = F.concat(created_at.cast("long").cast("string"), F.lit(".0"))
    audit = F.create_map(F.lit("protocol_id"), F.lit(protocol), F.lit("created_before_outcome"), F.lit("true"))
    return F.struct(
        case_id.alias("case_id"), F.substring(F.sha2(F.concat_ws(":", F.lit(protocol), case_id, own, stamp), 256), 1, 24).alias("prediction_id"), created_at.alias("created_at"), own.alias("payload_hash"),
        F.lit(True).alias("locked"), audit.alias("audit"),
    )


def semantic_document(columns: list[str], text: list[str], ids: list[str], fallback: Column) -> tuple[Column, Column]:
    """The first text and the first id that are not empty, among the columns at hand."""
    texts = [F.col(c).cast("string") for c in text if c in columns]
    names = [F.col(c).cast("string") for c in ids if c in columns]
    return F.coalesce(first_present(*texts), F.lit("")), F.coalesce(first_present(*names), fallback)


def checked(objects: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects of a declared class, and the rejected others."""
    return objects.join(classes, "class", "left_semi"), objects.join(classes, "class", "left_anti")


def edges(objects: DataFrame) -> DataFrame:
    """(src, predicate, dst) from the relations of objects (id, relations array<struct<predicate,to>>)."""
    return objects.select(F.col("id").alias("src"), F.explode("relations").alias("r")).select("src", F.col("r.predicate").alias("predicate"), F.col("r.to").alias("dst"))

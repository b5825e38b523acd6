"""Queries that write files of every kind the sources read, and read them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import intake as N
from ..operators import memory as M
from ..operators import payloads as Y
from ..sources import batch_summary, canonical_lines, cxr_cases, openi_cases, read_benchmark, read_cases, read_csv, read_registry, read_texts, table, write_json
from ..sources.workdir import work_path
from . import query
from .intake import payload_lines

#: Rows a file holds at most, so that a table becomes several files.
FILE_ROWS = 5_000


@query("SELECT count(*) AS cases, count(*) FILTER (doc_id % 9 = 0) AS failed, count(DISTINCT doc_id) FILTER (doc_id % 9 <> 0) AS ids, sum(length(coalesce(text, ''))) FILTER (doc_id % 9 <> 0)::BIGINT AS characters FROM documents")
def case_files(spark, sf_dir):
    """Cases written as lines of JSON and read by their schema."""
    path = work_path(spark, "cases")
    payload_lines(spark, sf_dir).select("value").write.option("maxRecordsPerFile", FILE_ROWS).text(path)
    read = read_cases(spark, path, lines=True)
    good, bad = N.from_payload(read.withColumn("imaging", F.lit(None).cast(read.schema["imaging"].dataType)))
    own = good.agg(F.count_distinct("case_id").alias("ids"), F.sum(F.char_length("report_text")).alias("characters"), F.count(F.lit(1)).alias("n"))
    return own.join(F.broadcast(bad.agg(F.count(F.lit(1)).alias("failed")))).select((F.col("n") + F.col("failed")).alias("cases"), "failed", "ids", "characters")  # two rows


@query("""SELECT 'cxr14-img_' || p_partkey AS case_id, p_type AS finding_labels, p_size::VARCHAR AS age FROM part ORDER BY p_partkey LIMIT 50""")
def cxr_file(spark, sf_dir):
    """The first rows of a CSV file with a header."""
    path = work_path(spark, "cxr")
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey"), F.concat(F.lit("img_"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("Image Index"), F.col("p_type").alias("Finding Labels"), F.col("p_size").alias("Patient Age"))
    rows.orderBy("p_partkey").limit(200).coalesce(1).write.option("header", True).csv(path)
    read = read_csv(spark, path, limit=50).withColumnRenamed("p_partkey", "row_index")
    return cxr_cases(read).select("case_id", "finding_labels", "age")


@query("""SELECT 'openi-u' || p_partkey AS case_id, 'Indication: ' || p_brand || ', "quoted" Findings: ' || p_type AS report_text FROM part""")
def openi_file(spark, sf_dir):
    path = work_path(spark, "openi")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_index"), F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("uid"), F.concat("p_brand", F.lit(', "quoted"')).alias("indication"), F.col("p_type").alias("findings"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return openi_cases(read_csv(spark, path)).select("case_id", "report_text")


@query("""SELECT 'case-' || doc_id AS case_id, doc_id % 7 = 0 AS rejected, CASE WHEN doc_id % 7 <> 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'a,b' ELSE 'one' END END AS labels FROM labels""")
def benchmark_file(spark, sf_dir):
    """A file of JSON lines, blank and broken ones among them: records, and rejected lines with their numbers."""
    path = work_path(spark, "benchmark")
    rows = table(spark, sf_dir, "labels").select("doc_id")
    case = F.concat(F.lit("case-"), F.col("doc_id").cast("string"))
    line = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("["), case, F.lit("]"))).when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(case.alias("case_id"), F.array(F.lit("A "), F.lit(""), F.lit("b")).alias("gold_labels")))).otherwise(F.to_json(F.struct(case.alias("case_id"), F.lit(" ONE").alias("gold_label"))))
    rows.select(F.concat(line, F.lit("\n")).alias("value")).write.option("maxRecordsPerFile", FILE_ROWS).text(path)
    good, bad = read_benchmark(spark, path)
    kept = good.select("case_id", F.lit(False).alias("rejected"), F.array_join("gold_labels", ",").alias("labels"))
    # Every second line is blank, so rejected lines have odd numbers.
    return kept.unionByName(bad.where("line % 2 = 1").select(F.regexp_extract("value", r"(case-\d+)", 1).alias("case_id"), F.lit(True).alias("rejected"), F.lit(None).cast("string").alias("labels")))


@query("SELECT doc_id, 'case-' || doc_id AS case_id, substr(sha256('p:' || doc_id), 1, 24) AS prediction_id, true AS locked, 0 AS missing FROM labels")
def registry_file(spark, sf_dir):
    """A registry saved twice, the second time over the first, and read again; one that was never saved is empty."""
    path = work_path(spark, "registry")
    i = F.col("doc_id").cast("string")
    rows = table(spark, sf_dir, "labels").select(F.concat(F.lit("case-"), i).alias("case_id"), F.substring(F.sha2(F.concat(F.lit("p:"), i), 256), 1, 24).alias("prediction_id"), F.lit(1.5).alias("created_at"), F.lit(True).alias("locked"))
    write_json(rows.limit(3), path)
    write_json(rows, path)
    missing = read_registry(spark, work_path(spark, "none")).agg(F.count(F.lit(1)).cast("int").alias("missing"))
    read = read_registry(spark, path).join(F.broadcast(missing))  # one row
    return read.select(F.expr("cast(substring(case_id, 6) as bigint)").alias("doc_id"), "case_id", "prediction_id", "locked", "missing")


@query("""SELECT doc_id, '{"a":' || doc_id || ',"m":{"k":"' || source || '","z":null},"t":"2020-01-01","z":' || CASE WHEN doc_id % 2 = 0 THEN 'null' ELSE '"x"' END || '}' AS line FROM documents""")
def json_lines(spark, sf_dir):
    """Rows as lines of JSON with sorted names, without the raw branch; a date is a string."""
    d = table(spark, sf_dir, "documents")
    out = d.select(
        F.when(F.col("doc_id") % 2 == 1, "x").alias("z"), F.col("doc_id").alias("a"), F.struct(F.lit(None).cast("string").alias("z"), F.col("source").alias("k")).alias("m"), F.col("text").alias("raw_result"), F.lit("2020-01-01").cast("date").alias("t"),
    )
    return canonical_lines(out).select(F.get_json_object("value", "$.a").cast("long").alias("doc_id"), F.col("value").alias("line"))


@query("SELECT count(*) AS cases, count(*) FILTER (doc_id % 9 = 0) AS failed, CASE WHEN count(*) FILTER (doc_id % 9 = 0) > 0 THEN 2 ELSE 0 END AS exit_code, CASE WHEN count(*) FILTER (doc_id % 9 = 0) > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM documents")
def batch_file(spark, sf_dir):
    """A batch from file to exit code."""
    path = work_path(spark, "batch")
    payload_lines(spark, sf_dir).select("value").write.text(path)
    v = N.validation(read_cases(spark, path, lines=True), ["case_id"])
    return batch_summary(v)


_COLLAPSED = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


@query(f"""WITH d AS (SELECT 'p' || item_id AS stem, {_COLLAPSED} AS t FROM benchmark)
    SELECT stem || '-chunk-' || k AS record_id, sha256(chunk) AS sha, 'candidate' AS learning_status, stem || '.txt' AS name, 'text_document' AS document_type
    FROM (SELECT stem, k, substr(t, k * 780 + 1, 900) AS chunk FROM (SELECT stem, t, unnest(range(0, greatest(ceil((length(t) - 900) / 780), 0)::INT + 1)) AS k FROM d))""")
def text_files_to_memory(spark, sf_dir):
    """Text files, one for every passage, chunked and put into the memory store."""
    path = work_path(spark, "texts")
    rows = table(spark, sf_dir, "benchmark").select(F.coalesce("text", F.lit("")).alias("value"), F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("stem"))
    rows.write.partitionBy("stem").text(path)
    files = read_texts(spark, path + "/*/*").withColumn("path", F.concat(F.regexp_extract("path", r"^(.*/)stem=", 1), F.regexp_extract("path", r"stem=([^/]*)/", 1), F.lit(".txt")))
    whole = files.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("text")), "").alias("text"))  # a file has one part
    records, _ = M.replay(Y.ingested(whole, "clinical_document", "text_document"))
    return records.select("record_id", F.sha2("text", 256).alias("sha"), "learning_status", S.file_name(F.col("metadata")["path"]).alias("name"), F.col("metadata")["document_type"].alias("document_type"))

"""Readers and writers: Parquet tables, cases as JSON, metadata as CSV, benchmarks and registries as JSON lines, texts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType, StringType, StructType,
)

from ..functions.scalars import as_list, file_stem, first_named, normal_label, present

CASE_SCHEMA = """case_id STRING, patient_id STRING, demographics MAP<STRING,STRING>, report_text STRING, ehr_text STRING, patient_complaints STRING,
 observations ARRAY<STRUCT<code:STRING,value:STRING,unit:STRING,source:STRING>>,
 imaging ARRAY<STRUCT<study_id:STRING,modality:STRING,series_paths:ARRAY<STRING>,metadata:MAP<STRING,STRING>>>,
 provenance MAP<STRING,STRING>, exposures MAP<STRING,STRING>, voice_features MAP<STRING,STRING>, patient_visual MAP<STRING,STRING>, labs_snapshot MAP<STRING,STRING>"""
BENCHMARK_SCHEMA = "case_id STRING, payload STRING, gold_labels STRING, gold_label STRING, slices MAP<STRING,STRING>, provenance MAP<STRING,STRING>"
REGISTRY_SCHEMA = "case_id STRING, prediction_id STRING, created_at DOUBLE, payload_hash STRING, label STRING, locked BOOLEAN, accepted_labels ARRAY<STRING>, attached_at DOUBLE"
#: Modalities that a study may have, names of the sources, the fallback sentences of the loaders, and the
#: spellings of their columns in order of precedence.
MODALITIES = ["ct_3d", "mri_3d", "wsi", "ehr_text", "report_text", "labs", "demographics", "CR", "DX", "CT", "MR", "US", "PT", "DICOM"]
CXR_SOURCE, OPENI_SOURCE = "NIH ChestX-ray14-style metadata", "Open-i / Indiana-style chest X-ray metadata"
CXR_REPORT = ("ChestX-ray14-style weak-label case. Finding labels: ", ". Labels are metadata-derived and should be treated as weak supervision only.")
OPENI_EMPTY = "Open-i-style report metadata without narrative text."
CXR_COLUMNS = {
    "image": ["Image Index", "image_id", "image", "filename"], "findings": ["Finding Labels", "findings", "labels"], "age": ["Patient Age", "age"], "sex": ["Patient Gender", "Patient Sex", "sex", "gender"],
    "view_position": ["View Position", "view_position"], "follow_up": ["Follow-up #", "follow_up"], "patient_id": ["Patient ID", "patient_id"],
}
OPENI_COLUMNS = {
    "uid": ["uid", "report_id", "id", "case_id"], "image": ["image", "image_id", "filename", "image_filename"], "indication": ["indication", "clinical_indication"], "findings": ["findings", "report_findings"],
    "impression": ["impression", "report_impression"], "problems": ["problems", "labels", "mesh_terms"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_cases(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One JSON object a file, or a line; what is no object has a null case_id."""
    return spark.read.schema(CASE_SCHEMA).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)


def read_csv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows if limit is None else rows.limit(limit)


def read_benchmark(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records of JSON lines, and the rejected lines (path, line from 1, value) that are no object; blank lines are skipped.

    gold_labels or gold_label, a scalar or a list. A file is read as one row, so that its lines have numbers.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("_at", "value"))
    lines = files.where(F.trim("value") != "").withColumn("line", F.col("_at") + 1).drop("_at")
    whole = F.coalesce(F.trim("value").startswith("{") & F.expr("try_parse_json(value)").isNotNull(), F.lit(False))
    return parse_benchmark(lines.where(whole)), lines.where(~whole)


def parse_benchmark(lines: DataFrame, value: str = "value") -> DataFrame:
    item = F.from_json(F.col(value), BENCHMARK_SCHEMA)
    rows = lines.withColumn("_i", item)
    raw = F.coalesce(F.col("_i.gold_labels"), F.col("_i.gold_label"))
    listed = F.coalesce(F.from_json(raw, "array<string>"), as_list(raw, False))
    labels = F.filter(F.transform(F.when(raw.isNull(), as_list(raw, False)).otherwise(listed), normal_label), lambda x: present(x))
    return rows.select(F.col("_i.case_id").alias("case_id"), F.col("_i.payload").alias("payload"), labels.alias("gold_labels"), F.col("_i.slices").alias("slices"), F.col("_i.provenance").alias("provenance"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The saved registry, or an empty one where there is none."""
    try:
        return spark.read.schema(REGISTRY_SCHEMA).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], REGISTRY_SCHEMA)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files; bytes that are no UTF-8 are dropped."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit("")).alias("text"))


def canonical_lines(df: DataFrame, raw: bool = False) -> DataFrame:
    """(value): a line of JSON for every row, columns and fields of structs in order of their names; the bulky raw branch is dropped unless asked for.

    Nulls are written; what JSON has no type for (times, binaries, decimals) is a string.
    """
    df = df if raw else df.drop("raw_result")

    def plain(x: Column, kind: DataType) -> Column:
        if isinstance(kind, StructType):
            return F.struct(*(plain(x[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)))
        if isinstance(kind, ArrayType):
            return F.transform(x, lambda e: plain(e, kind.elementType))
        if isinstance(kind, MapType):
            ordered = F.array_sort(F.map_entries(x))
            return F.map_from_entries(F.transform(ordered, lambda e: F.struct(e["key"].cast("string"), plain(e["value"], kind.valueType))))
        return x if isinstance(kind, (BooleanType, ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType, StringType)) else x.cast("string")

    fields = [plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str, raw: bool = False) -> None:
    """Lines of ``canonical_lines``, replacing what is there."""
    canonical_lines(df, raw).write.mode("overwrite").text(path)


def batch_summary(results: DataFrame) -> DataFrame:
    """Counts of a batch with its exit code: 2 if any case did not complete."""
    bad = F.count_if(F.coalesce(F.col("status") != "completed", F.lit(True)))
    return results.agg(F.count(F.lit(1)).alias("cases"), bad.alias("failed"), F.when(bad > 0, 2).otherwise(0).alias("exit_code"), F.when(bad > 0, "completed_with_errors").otherwise("completed").alias("status"))


def cxr_cases(rows: DataFrame, index: str = "row_index", image_root: str | None = None) -> DataFrame:
    """Cases from chest x-ray metadata; column names have several spellings."""
    names, n = rows.columns, F.col(index).cast("string")
    text = lambda key, default="": first_named(names, CXR_COLUMNS[key], F.lit(default))
    image = first_named(names, CXR_COLUMNS["image"], F.concat(F.lit("cxr-row-"), n))
    findings = text("findings", "No Finding")
    return rows.select(
        F.col(index), F.concat(F.lit("cxr14-"), file_stem(image)).alias("case_id"), first_named(names, CXR_COLUMNS["patient_id"], F.concat(F.lit("synthetic-cxr-patient-"), n)).alias("patient_id"),
        text("age").alias("age"), text("sex").alias("sex"), F.concat(F.lit(CXR_REPORT[0]), findings, F.lit(CXR_REPORT[1])).alias("report_text"), image.alias("study_id"), F.lit("CR").alias("modality"),
        _root(image, image_root).alias("series_path"), text("view_position").alias("view_position"), text("follow_up").alias("follow_up"), findings.alias("finding_labels"), F.lit(CXR_SOURCE).alias("source"),
    )


def openi_cases(rows: DataFrame, index: str = "row_index", image_root: str | None = None) -> DataFrame:
    """Cases from report metadata: the report joins its labelled parts that are not empty."""
    names, n = rows.columns, F.col(index).cast("string")
    empty = F.lit(None).cast("string")
    part = lambda key: first_named(names, OPENI_COLUMNS[key], empty)
    uid = first_named(names, OPENI_COLUMNS["uid"], F.concat(F.lit("openi-row-"), n))
    image = first_named(names, OPENI_COLUMNS["image"], F.concat(F.lit("openi-image-"), n, F.lit(".png")))
    parts = {"Indication": part("indication"), "Findings": part("findings"), "Impression": part("impression"), "Problem terms": part("problems")}
    report = F.concat_ws(" ", *(F.concat(F.lit(f"{k}: "), v) for k, v in parts.items()))
    return rows.select(
        F.col(index), F.concat(F.lit("openi-"), file_stem(uid)).alias("case_id"), F.concat(F.lit("openi-synthetic-patient-"), n).alias("patient_id"),
        F.coalesce(F.nullif(report, F.lit("")), F.lit(OPENI_EMPTY)).alias("report_text"), F.coalesce(part("indication"), F.lit("")).alias("patient_complaints"),
        image.alias("study_id"), F.lit("CR").alias("modality"), _root(image, image_root).alias("series_path"), uid.alias("uid"), F.coalesce(part("problems"), F.lit("")).alias("problem_terms"), F.lit(OPENI_SOURCE).alias("source"),
    )


#: What the provenance of loaded cases says of them.
NOTES = {CXR_SOURCE: "Generated from metadata. Verify source terms and de-identification status before use.", OPENI_SOURCE: "Generated from local metadata. Verify Open-i/Indiana license terms before use or redistribution."}


def nested_payloads(cases: DataFrame, *more: str) -> DataFrame:
    """Flat cases of a loader as payloads of ``CASE_SCHEMA``: nested imaging with its metadata, demographics and provenance; ``more`` columns are kept."""
    names = cases.columns

    def packed(wanted: list[str]) -> Column:
        return F.create_map(*(x for k in wanted if k in names for x in (F.lit(k), F.col(k)))) if any(k in names for k in wanted) else F.create_map().cast("map<string,string>")

    details = F.map_concat(F.create_map(F.lit("source_dataset_style"), F.col("source"), F.lit("image_id"), F.col("study_id")), packed(["finding_labels", "view_position", "follow_up", "uid", "problem_terms"]))
    study = F.struct(F.col("study_id"), F.col("modality"), F.array_compact(F.array("series_path")).alias("series_paths"), details.alias("metadata"))
    note = F.create_map(*(F.lit(x) for kv in NOTES.items() for x in kv))
    provenance = F.create_map(F.lit("source"), F.col("source"), F.lit("contains_real_patient_data"), F.lit("false"), F.lit("note"), F.try_element_at(note, F.col("source")))
    none = {f.name: F.lit(None).cast(f.dataType) for f in StructType.fromDDL(CASE_SCHEMA).fields}
    own = none | {"case_id": F.col("case_id"), "patient_id": F.col("patient_id"), "demographics": packed(["age", "sex"]), "report_text": F.col("report_text"), "ehr_text": F.lit(""), "imaging": F.array(study), "provenance": provenance}
    own["patient_complaints"] = F.col("patient_complaints") if "patient_complaints" in names else F.lit("")
    return cases.select(*more, *(v.alias(k) for k, v in own.items()))


def _root(image: Column, root: str | None) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), image) if root else F.lit(None).cast("string")


def validated(cases: DataFrame) -> DataFrame:
    """Add errors and warnings; cases with errors go to the reject branch."""
    narrative = present(F.col("report_text")) | present(F.col("ehr_text")) | present(F.col("patient_complaints"))
    errors = F.array_compact(F.array(F.when(~present(F.col("case_id")), F.lit("missing_required_field:case_id"))))
    warnings = F.array_compact(F.array(F.when(~narrative & (F.coalesce(F.size("imaging"), F.lit(0)) <= 0), F.lit("minimal_payload_without_narrative_or_imaging"))))
    return cases.withColumns({"errors": errors, "warnings": warnings, "valid": F.size(errors) == 0})


def known_modalities(cases: DataFrame, strict: list[str] | None = None) -> DataFrame:
    """Add whether all studies are of a known modality; a strict list narrows it."""
    allowed = strict or MODALITIES
    return cases.withColumn("modality_ok", F.forall(F.coalesce("imaging", F.array()), lambda s: s["modality"].isin(allowed)))

"""Parts that only name the service that would answer, as columns; and the validation matrix of a configuration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The service that stands behind each part.
SERVICES = {
    "pathology": "api_for_service_pathology_encoder", "dicom": "api_for_service_dicom_reader", "knowledge_graph": "api_for_service_knowledge_graph", "retrieval": "api_for_service_document_rag",
    "decision": "api_for_service_multimodal_reasoner", "dreamer": "api_for_service_synthetic_case_generator",
}


def pathology(slide_id: Column) -> Column:
    return F.struct(F.lit(SERVICES["pathology"]).alias("provider"), slide_id.alias("slide_id"))


def dicom_series(path: Column) -> Column:
    return F.struct(path.alias("series_path"), F.lit(SERVICES["dicom"]).alias("reader"), F.lit("placeholder").alias("status"))


def asked(part: str, query: Column) -> Column:
    """What the knowledge graph or the retrieval would be asked."""
    return F.struct(F.lit(SERVICES[part]).alias("provider"), query.alias("query"))


def decision(features: Column) -> Column:
    return F.struct(F.lit(SERVICES["decision"]).alias("provider"), F.size(features).alias("feature_count"))


def dreamt(context: Column) -> Column:
    return F.struct(F.lit(SERVICES["dreamer"]).alias("provider"), F.array_sort(F.map_keys(context)).alias("context_keys"))


def calibrated(score: Column) -> Column:
    """The identity, until a calibration is learned."""
    return F.struct(score.alias("raw"), score.alias("calibrated"))


def validation_matrix(allow_remote: Column, profile: Column) -> Column:
    """How far each side of a configuration is validated."""
    fixed = {"technical": "scaffold_ready", "clinical": "research_only", "metacognitive": "traceable_scaffold"}
    quantum = F.when(allow_remote, "enabled_research").otherwise("disabled_local_research")
    return F.struct(*(F.lit(v).alias(k) for k, v in fixed.items()), quantum.alias("theoretical_quantum"), profile.alias("runtime_profile"))

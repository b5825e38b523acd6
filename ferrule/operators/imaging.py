"""Imaging inputs: kind, readiness, provider and route, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import file_suffix
from .adapters import imaging_response

#: Provider (kind, name, needs pixels, remote, requirement) by strategy.
PROVIDERS = {
    "local_pixels": ("local_pixel_adapter", "local_pixel_feature_provider", True, False, "local_images_required"),
    "remote_radiology_vlm": ("remote_projection_radiology_vlm", "remote_radiology_vlm_provider", True, True, "local_or_remote_projection_images_required"),
    "remote_dicom_3d": ("remote_3d_dicom_foundation_model", "remote_dicom_3d_provider", True, True, "dicom_or_volumetric_series_required"),
    "local_metadata": ("local_metadata_adapter", "local_imaging_feature_provider", False, False, "metadata_or_paths_optional"),
}
_HYBRID = "image_or_dicom_series_required"
#: Suffixes of projection images, and modalities of volumes.
IMAGES = [".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff"]
VOLUMES = ["CT", "MR", "PT"]


def suffixes(paths: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(paths, lambda p: F.coalesce(F.nullif(file_suffix(p), F.lit("")), F.lit("<no_suffix>")))))


def input_kind(paths: Column, modality: Column) -> Column:
    found = suffixes(paths)
    return (
        F.when(F.upper(modality).isin(VOLUMES), "volumetric_dicom_or_series").when(F.array_contains(found, ".dcm"), "dicom_like_series")
        .when(F.arrays_overlap(found, F.array(*map(F.lit, IMAGES))), "projection_or_image_file").otherwise("metadata_only")
    )


def readiness(strategy: Column, has_images: Column) -> Column:
    return (
        F.when(strategy == "local_metadata", F.when(has_images, "metadata_ready").otherwise("metadata_only"))
        .when(strategy == "local_pixels", F.when(has_images, "local_pixel_provider_ready").otherwise("waiting_for_images"))
        .when(strategy.isin("remote_radiology_vlm", "remote_dicom_3d", "hybrid_multimodal"), F.when(has_images, "remote_provider_configured").otherwise("remote_provider_waiting_for_images"))
        .otherwise("unknown_strategy")
    )


def provider(strategy: Column, kind: Column) -> Column:
    def pack(row: tuple) -> Column:
        return F.struct(*(F.lit(x).alias(n) for x, n in zip(row, ("kind", "name", "pixels", "remote", "requirement"))))

    volume, flat = (pack((*PROVIDERS[n][:4], _HYBRID)) for n in ("remote_dicom_3d", "remote_radiology_vlm"))
    out = F.when(strategy == "hybrid_multimodal", F.when(kind == "volumetric_dicom_or_series", volume).otherwise(flat))
    for name, row in PROVIDERS.items():
        out = out.when(strategy == name, pack(row))
    return out.otherwise(pack(PROVIDERS["local_metadata"]))


def route(kind: Column, modality: Column) -> Column:
    return (
        F.when((kind == "volumetric_dicom_or_series") | F.upper(modality).isin(VOLUMES), "route_to_3d_dicom_provider")
        .when(kind.isin("projection_or_image_file", "dicom_like_series"), "route_to_projection_radiology_provider").otherwise("metadata_only_review")
    )


def encode_studies(studies: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Describe studies of study_id, paths, modality and strategy; ``existing`` lists the paths that are there."""
    kind = input_kind(F.col("paths"), F.col("modality"))
    out = studies.withColumns({"input_kind": kind, "suffixes": suffixes(F.col("paths")), "image_count": F.size("paths")})
    out = out.withColumns({
        "readiness": readiness(F.col("strategy"), F.col("image_count") > 0), "provider": provider(F.col("strategy"), F.col("input_kind")),
        "route": route(F.col("input_kind"), F.coalesce("modality", F.lit("unknown"))),
    })
    if existing is None:
        return out
    rows = studies.select("study_id", F.explode("paths").alias("path")).join(existing.select("path").distinct().withColumn("there", F.lit(1)), "path", "left")
    counts = rows.groupBy("study_id").agg(F.count("there").alias("existing_count"))
    there = F.coalesce("existing_count", F.lit(0))
    ready = F.when((F.col("image_count") > 0) & (there == F.col("image_count")), "ready").when(there > 0, "partial").otherwise("metadata_only")
    return out.join(counts, "study_id", "left").withColumns({"existing_count": there, "missing_count": F.col("image_count") - there, "local_readiness": ready})


def remote_request(provider_name: Column, endpoint: Column, enabled: Column, timeout_seconds: int = 30) -> Column:
    """The request to a remote provider over rows of ``encode_studies``: what it would be sent, and why it is not."""
    request = F.struct(
        provider_name.alias("provider_name"), endpoint.alias("endpoint"), F.col("study_id").cast("string").alias("study_id"), F.col("paths").alias("series_paths"), F.col("provider.name").alias("selected"), F.lit(timeout_seconds).alias("timeout_seconds"),
    )
    answer = imaging_response(enabled, endpoint)
    return F.when(F.col("provider.remote"), F.struct(provider_name.alias("provider"), answer["status"].alias("status"), answer["reason"].alias("reason"), request.alias("request"), answer["fallback_required"].alias("fallback_required")))


def with_remote(studies: DataFrame, provider_name: Column, endpoint: Column, enabled: Column) -> DataFrame:
    """Add remote_result (null where the strategy needs no remote provider), encoder_ready and fallback_mode to ``encode_studies``."""
    out = studies.withColumn("remote_result", remote_request(provider_name, endpoint, enabled))
    fallback = F.coalesce(F.col("remote_result.fallback_required"), F.lit(False))
    return out.withColumns({
        "encoder_ready": (F.col("image_count") > 0) & (F.col("strategy") != "metadata_only"), "fallback_mode": F.when(fallback, "remote_stub_to_local_features").otherwise("local_features_only"),
    })


def attach_paths(imaging: Column, paths: Column, case_id: Column) -> Column:
    """Append paths to the first study, or make a study of them."""
    first = lambda s, i: F.when(i == 0, s.withField("series_paths", F.concat(s["series_paths"], paths))).otherwise(s)
    new = F.array(F.struct(F.concat(case_id, F.lit("-local-imaging")).alias("study_id"), F.lit("CR").alias("modality"), paths.alias("series_paths")))
    return F.when(F.size(paths) == 0, imaging).when(F.size(imaging) > 0, F.transform(imaging, first)).otherwise(new)

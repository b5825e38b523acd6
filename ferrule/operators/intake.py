"""From payloads to decisions: typed cases with a reject branch, areas from the cases' own parts, and all stages over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import first_present, present, reasons
from ..sources import CASE_SCHEMA, MODALITIES
from . import areas as A
from .reasoning import run_cases

_MAPS = ("demographics", "provenance", "exposures", "voice_features", "patient_visual", "labs_snapshot")
_TEXTS = ("report_text", "ehr_text", "patient_complaints")
#: What the text, the volume and the pathology encoder and the fusion call themselves.
ENGINES = {"text": "clinical_text_encoder", "fusion": "multimodal_fusion_engine"}
FUSION_PROVIDER = "api_for_service_multimodal_reasoner"
SERVICE_PROVIDER = "api_for_service_volume_encoder"
BELIEF_MODE = "quantum_like_belief_update"
#: The measures of a case that brings none of its own.
MEASURES = {"replay_coherence": 0.9, "replay_risk": 0.1, "risk": 0.2, "uncertainty": 0.1}


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """Typed payloads from lines of JSON; a line that is no object has null fields."""
    return lines.withColumn("_p", F.from_json(F.col(value), CASE_SCHEMA)).select(*(c for c in lines.columns if c != value), "_p.*")


def from_payload(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed cases, and the rejected payloads with a reason: no case id, or an unknown modality.

    Missing texts are empty, missing maps and arrays too.
    """
    strange = F.filter(F.coalesce(F.transform("imaging", lambda s: s["modality"]), F.array().cast("array<string>")), lambda m: ~F.coalesce(m.isin(MODALITIES), F.lit(False)))
    rows = payloads.withColumn("reason", F.when(~present(F.col("case_id")), "missing_required_field:case_id").when(F.size(strange) > 0, F.concat(F.lit("unknown_modality:"), F.coalesce(F.element_at(strange, 1), F.lit("none")))))
    fixed = {t: F.coalesce(t, F.lit("")) for t in _TEXTS}
    fixed |= {m: F.coalesce(m, F.create_map().cast("map<string,string>")) for m in _MAPS}
    empty = {c: payloads.schema[c].dataType.simpleString() for c in ("observations", "imaging")}
    fixed |= {c: F.coalesce(c, F.array().cast(kind)) for c, kind in empty.items()}
    return rows.where("reason is null").withColumns(fixed).drop("reason"), rows.where("reason is not null")


def first_study(imaging: Column) -> Column:
    """The first study as the volume encoder sees it; without imaging a study called none."""
    study = F.try_element_at(imaging, F.lit(1))
    paths = F.coalesce(study["series_paths"], F.array().cast("array<string>"))
    return F.struct(
        F.coalesce(study["study_id"], F.lit("none")).alias("study_id"), paths.alias("series_paths"), F.size(paths).alias("image_count"), (F.size(paths) > 0).alias("has_local_images"), study["modality"].alias("modality"),
    )


def fused(**inputs: Column) -> Column:
    """The fusion of named inputs: their sorted names, provider and engine."""
    names = F.array_sort(F.map_keys(F.create_map(*(x for k, v in inputs.items() for x in (F.lit(k), F.to_json(v))))))
    return F.struct(F.lit(FUSION_PROVIDER).alias("provider"), names.alias("input_keys"), F.lit(ENGINES["fusion"]).alias("engine"))


def merged_text(*texts: Column) -> Column:
    """The texts that are not empty, joined in order."""
    return F.concat_ws(" | ", *(F.when(present(t), t) for t in texts))


def with_areas(cases: DataFrame) -> DataFrame:
    """Add study, fusion, the parts of the four areas (visual, heard, context_keys, epi, merged_text) and ``areas``."""
    c = F.col
    filled = lambda m: F.size(m) > 0
    text = first_present(c("report_text"), c("ehr_text"), c("case_id"))
    rows = cases.withColumns({
        "study": first_study(c("imaging")), "text_length": F.char_length(text), "merged_text": merged_text(c("patient_complaints"), c("report_text"), c("ehr_text")),
        "visual": A.streams(volume=F.lit(True), pathology=F.lit(True), patient_visual=filled("patient_visual"), labs_snapshot=filled("labs_snapshot")),
        "heard": A.streams(patient_complaints=present(c("patient_complaints")), report_text=present(c("report_text")), ehr_text=present(c("ehr_text")), voice_features=filled("voice_features")),
        "epi": A.streams(demographics=filled("demographics"), provenance=filled("provenance"), exposures=filled("exposures")),
        "context_keys": F.array_sort(F.map_keys(F.create_map(*(F.lit(x) for k in ("demographics", "provenance", "bundle_keys") for x in (k, True))))),
    })
    rows = rows.withColumn("fusion", fused(text=F.struct("text_length"), volume=c("study"), pathology=F.struct(c("study.study_id").alias("slide_id"))))
    four = [("visual_diagnostic", "visual"), ("language_listening", "heard"), ("case_context", "context_keys"), ("epidemiology", "epi")]
    return rows.withColumn("areas", F.array(*(A.area(name, F.size(parts)) for name, parts in four)))


def settled(rows: DataFrame) -> DataFrame:
    """The same rows, whose columns later stages read as they are: the optimizer neither repeats nor merges what made them.

    A row passes through a generator of one row, which costs no shuffle.
    """
    return rows.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in rows.columns)))))


def run_payloads(payloads: DataFrame, stages: Callable[[DataFrame], DataFrame] = run_cases, **measures: Column) -> tuple[DataFrame, DataFrame]:
    """Decided cases and rejected payloads; ``measures`` replace those of ``MEASURES``, ``stages`` all that follows the areas."""
    good, bad = from_payload(payloads)
    rows = settled(with_areas(settled(good)).withColumn("exposures", F.size("exposures") > 0))
    return stages(rows.withColumns({k: measures.get(k, F.lit(v)) for k, v in MEASURES.items()})), bad


def state_summary(df: DataFrame) -> Column:
    """The coordinator's state over rows of ``run_cases``."""
    c = F.col
    return F.struct(
        c("case_id").alias("case_id"), F.size("signals").alias("evidence_count"), F.size("hypotheses").alias("hypothesis_count"), c("risk").alias("risk"), c("uncertainty").alias("uncertainty"),
        c("policy.abstain").alias("abstain"), c("policy.escalate").alias("escalate"),
    )


def decision_trace(df: DataFrame) -> Column:
    """The eight entries key:value of a decision."""
    c, top = F.col, F.element_at("hypotheses", 1)
    entries = {
        "case": c("case_id"), "evidence_count": F.size("signals"), "policy_band": c("policy.band"), "reasoning_mode": c("intuition.mode"), "differential_top": top["label"], "top_domain": top["domain"],
        "recommended_actions": F.size("actions"), "mismatch_score": c("mismatch_score"),
    }
    return F.array(*(F.concat(F.lit(f"{k}:"), v.cast("string")) for k, v in entries.items()))


def support_summary(df: DataFrame) -> Column:
    """The salience of every area, and the evidence that retrieval brought."""
    return F.struct(F.map_from_entries(F.transform("areas", lambda a: F.struct(a["area"], a["salience"]))).alias("salience"), F.size("evidence").alias("semantic_memory"))


def audit(df: DataFrame, authority: str = "orchestrator") -> Column:
    """What a decision was held against, what was seen, and who decided."""
    c = F.col
    limits = F.struct(F.lit(0.35).alias("min_pi_score"), F.lit(0.7).alias("max_mismatch_index"), F.lit(0.75).alias("max_uncertainty"))
    seen = F.struct(c("metrics.pi_score"), c("metrics.mismatch_index"), c("uncertainty"), c("policy.abstain").alias("policy_abstain"), c("policy.escalate").alias("policy_escalate"))
    return F.struct(limits.alias("thresholds"), seen.alias("observed"), F.lit(authority).alias("final_authority"), F.lit(True).alias("external_models_are_not_final_arbiters"), decision_trace(df).alias("pipeline_trace"))


def area_trace(df: DataFrame) -> Column:
    """What the intuition stage leaves for the record, with defaults where a part is missing."""
    c, zero = F.col, F.lit(0.0)
    i = lambda n, d: F.coalesce(c(f"intuition.{n}"), d)
    metrics = ("pi_score", "prediction_error", "precision_weighted_coherence", "convergence_index", "mismatch_index", "inhibitory_control", "deductive_gate", "dream_plasticity", "belief_update_rate")
    return F.struct(
        i("label", F.lit("none")).alias("intuition"), F.size("evidence").alias("candidate_count"), F.when(c("intuition.belief").isNull(), "none").otherwise(BELIEF_MODE).alias("belief_mode"),
        F.array_sort(F.transform("areas", lambda a: a["area"])).alias("active_areas"), i("top_areas", F.array().cast("array<string>")).alias("top_areas"),
        i("convergence", zero).alias("convergence_score"), i("conflict", zero).alias("conflict_score"), F.coalesce("coherence_score", zero).alias("coherence_score"), F.coalesce("mismatch_score", zero).alias("mismatch_score"),
        *(F.coalesce(c(f"metrics.{m}"), zero).alias(m) for m in metrics), F.coalesce("metrics.candidate_temperature", F.lit(1.0)).alias("candidate_temperature"),
        i("bonus", zero).alias("area_pair_bonus"), i("penalty", zero).alias("disagreement_penalty"), F.coalesce("dream.rehearsal", F.lit(False)).alias("contradiction_rehearsal"),
        F.coalesce("dream.revision_bias", F.lit("exploratory")).alias("revision_bias"), F.coalesce("dream.adjustment", F.lit("stabilize_primary")).alias("post_error_adjustment"),
        i("mode", F.lit("rapid_intuition")).alias("reasoning_mode"),
    )


def evidence_union(df: DataFrame) -> Column:
    """The five rows (source, kind, value) that every case has, then its ranked evidence, in order."""
    c = F.col
    own = [
        ("bundle", "bundle_keys", F.lit("patient,diagnostic_report")), ("retrieval", "grounded_retrieval_ready", F.size("evidence").cast("string")), ("fusion", "engine", c("fusion.engine")),
        ("service", "provider", F.lit(SERVICE_PROVIDER)), ("intuition", "candidate", c("intuition.label")),
    ]
    five = F.array(*(F.struct(F.lit(s).alias("source"), F.lit(k).alias("kind"), v.alias("value")) for s, k, v in own))
    return F.concat(five, F.transform("evidence", lambda e: F.struct(e["item"]["source"].alias("source"), e["item"]["kind"].alias("kind"), e["item"]["value"].alias("value"))))


def validation(payloads: DataFrame, fields: list[str]) -> DataFrame:
    """Add errors, warnings, field_count (of ``fields`` that are given) and the status of a payload before any stage runs."""
    narrative = present(F.col("report_text")) | present(F.col("ehr_text")) | present(F.col("patient_complaints"))
    seen = F.coalesce(F.size("imaging"), F.lit(0)) > 0
    errors = reasons((~present(F.col("case_id")), "missing_required_field:case_id"))
    given = sum((F.col(f"`{f}`").isNotNull().cast("int") for f in fields), F.lit(0))
    rows = payloads.withColumns({"errors": errors, "warnings": reasons((~narrative & ~seen, "minimal_payload_without_narrative_or_imaging")), "field_count": given})
    return rows.withColumn("status", F.when(F.size("errors") > 0, "invalid_payload").otherwise("completed"))

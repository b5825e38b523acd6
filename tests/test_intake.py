"""From payloads to decisions."""

import json

import pytest
from pyspark.sql import functions as F

from ferrule.operators import intake as N
from ferrule.operators import reasoning as R

FULL = {"case_id": "c1", "report_text": "possible pulmonary lesion", "patient_complaints": "cough", "demographics": {"age": "58"}, "provenance": {"source": "s"}, "exposures": {"travel": "x"},
        "imaging": [{"study_id": "s1", "modality": "CR", "series_paths": ["/a.png"]}], "labs_snapshot": {"wbc": "1"}}


def payloads(spark, *rows):
    return N.parsed(spark.createDataFrame([(json.dumps(r) if not isinstance(r, str) else r,) for r in rows], "value string"))


def test_payload_to_decision(spark):
    good, bad = N.run_payloads(payloads(spark, FULL, {"case_id": "c2"}, {"case_id": ""}, {"case_id": "c4", "imaging": [{"study_id": "s", "modality": "nope"}]}, "no json"))
    got = {r.case_id: r for r in good.select("*", N.state_summary(good).alias("state"), N.decision_trace(good).alias("trace"), N.audit(good).alias("audit"), N.area_trace(good).alias("areas_seen")).collect()}
    assert set(got) == {"c1", "c2"}
    assert sorted(r.reason for r in bad.collect()) == ["missing_required_field:case_id", "missing_required_field:case_id", "unknown_modality:nope"]
    one, two = got["c1"], got["c2"]
    assert (one.merged_text, one.study.study_id, one.study.image_count, one.text_length) == ("cough | possible pulmonary lesion", "s1", 1, 25)
    assert (two.merged_text, two.study.study_id, two.text_length) == ("", "none", 2)
    assert [(a.area, a.n) for a in one.areas] == [("visual_diagnostic", 3), ("language_listening", 2), ("case_context", 3), ("epidemiology", 3)]
    assert one.fusion.input_keys == ["pathology", "text", "volume"]
    assert one.trace[:3] == ["case:c1", "evidence_count:8", "policy_band:clear"] and len(one.trace) == 8
    assert one.audit.final_authority == "orchestrator" and one.audit.observed.pi_score == one.metrics.pi_score and one.audit.pipeline_trace == one.trace
    assert one.areas_seen.reasoning_mode == one.intuition.mode and one.areas_seen.active_areas == sorted(a.area for a in one.areas)
    assert (one.state.evidence_count, one.state.abstain) == (8, False)


def test_measures_and_stages_can_be_replaced(spark):
    good, _ = N.run_payloads(payloads(spark, FULL), risk=F.lit(0.8), uncertainty=F.lit(0.9))
    assert good.first().result_label == "abstain_or_escalate"
    plain, _ = N.run_payloads(payloads(spark, FULL), stages=lambda d: d.select("case_id", F.size("areas").alias("n")))
    assert tuple(plain.first()) == ("c1", 4)


@pytest.mark.parametrize("spoken,source,kind,domain", [
    ("fusion:x", "a", "b", "imaging_led"), ("z", "contradiction_revision", "b", "imaging_led"), ("dream:language_listening", "a", "b", "language_led"), ("dream:epidemiology", "a", "b", "epidemiology_led"),
    ("z", "a", "mismatch_resolution", "mismatch_resolution_led"), ("z", "a", "b", "multimodal_led"),
])
def test_domains(spark, spoken, source, kind, domain):
    r = spark.range(1).select(R.domain(F.array(F.lit(spoken)), F.lit(source), F.lit(kind)).alias("d"))
    r = r.select("d", R.domain_actions(F.col("d")).alias("a")).first()
    assert r.d == domain and len(r.a) == (1 if domain == "multimodal_led" else 2)


def test_fallback_alternative(spark):
    case, _ = N.run_payloads(payloads(spark, FULL), stages=lambda d: d)
    from ferrule.operators.areas import with_metrics, with_pairs

    d = R.with_support(R.with_intuition(R.with_replay(R.case_evidence(with_metrics(with_pairs(case))))))
    none = d.withColumn("dream", F.col("dream").withField("alternatives", F.slice("dream.alternatives", 1, 0)))
    h = R.with_differential(none).first().hypotheses
    assert [x.kind for x in h[1:]] == ["fallback_alternative"] and h[1].label == "alternative_hypothesis"

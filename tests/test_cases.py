"""Golden values and branches of the case stages."""

import pytest
from pyspark.sql import functions as F

from ferrule.functions.scalars import r3
from ferrule.operators import adapters as D
from ferrule.operators import areas as A
from ferrule.operators import policy as P
from ferrule.operators import reasoning as R


def case(spark, v=2, l=1, e=0, **more):
    row = {"case_id": "case-001", "report_text": "possible pulmonary lesion", "ehr_text": "", "patient_complaints": "", "exposures": False, "replay_coherence": 0.9, "replay_risk": 0.1, "risk": 0.2, "uncertainty": 0.1} | more
    df = spark.createDataFrame([tuple(row.values())], list(row))
    return df.withColumn("areas", F.array(*(A.area(n, F.lit(k)) for n, k in (("visual_diagnostic", v), ("language_listening", l), ("case_context", 3), ("epidemiology", e)))))


def test_golden_trace(spark):
    r = R.run_cases(case(spark)).first()
    assert (r.coherence_score, r.mismatch_score) == (1.292, 0.25)
    m = r.metrics
    assert (m.pi_score, m.precision_weighted_coherence, m.prediction_error, m.conflict_load) == (0.826, 1.0, 0.15, 0.169)
    assert (m.convergence_index, m.mismatch_index, m.inhibitory_control, m.deductive_gate) == (0.872, 0.121, 1.0, 1.0)
    assert (m.revision_pressure, m.dream_plasticity, m.intuition_gain, m.bias_suppression_score, m.candidate_temperature, m.belief_update_rate) == (0.151, 0.41, 1.315, 0.774, 0.803, 0.615)
    i = r.intuition
    assert sorted(i.top_areas) == ["case_context", "visual_diagnostic"]
    assert (i.bonus, i.penalty, i.rapid, i.rational, i.contradiction) == (0.359, -0.026, 8.132, 2.782, 0.402)
    assert (i.belief.contextuality_score, i.belief.interference_score) == (0.46, 0.457)
    assert (r.dream.belief.contextuality_score, r.dream.belief.interference_score, r.dream.evolution_score, r.dream.acceptance_score) == (0.429, 0.417, 0.618, 0.4)
    assert [(h.label, h.score, h.domain) for h in r.hypotheses][0] == ("candidate_1", 8.294, "imaging_led")
    assert [(h.label, h.score) for h in r.hypotheses][1:] == [("case-001_alt_1", 0.428), ("case-001_alt_2", 0.378)]
    assert [a.label for a in r.actions] == ["repeat targeted imaging review", "correlate imaging with structured report findings", "monitor boundary conditions"]
    assert r.critique.warnings == ["boundary_case_review", "possible_spurious_conflict"]
    assert (r.result_label, r.decision.allow, r.decision.abstain) == ("candidate_1", True, False)
    assert [(round(e.weight, 3), e["item"].source) for e in r.evidence] == [(2.48, "semantic_memory"), (2.25, "knowledge_graph"), (1.99, "episodic_memory")]


@pytest.mark.parametrize("state,pi,convergence,rapid", [((2, 2, 0), 0.789, 0.855, 8.448), ((2, 0, 0), 0.904, 0.907, 8.388), ((2, 3, 3), 0.759, 0.834, 7.855), ((4, 4, 3), 0.812, 0.865, 8.247)])
def test_other_states(spark, state, pi, convergence, rapid):
    r = R.run_cases(case(spark, *state)).first()
    assert (r.metrics.pi_score, r.metrics.convergence_index, r.intuition.rapid) == (pi, convergence, rapid)


def test_repaired_pair_is_coherent(spark):
    assert A.with_pairs(case(spark), strict=False).first().mismatch_score == 0.0


def test_rounding_goes_by_the_binary_value(spark):
    values = [2.675, 0.4275, 1.2925, 0.0005, 0.0015, 1.0005, -0.0005, -1.2345, 0.1235, 123456.7895, 0.0, 1.25 + 0.05 * 0.85]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(r3(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == [round(v, 3) for v in values]


@pytest.mark.parametrize("risk,uncertainty,band,level", [(0.8, 0.2, "blocked", "high"), (0.4, 0.7, "blocked", "moderate"), (0.1, 0.1, "clear", "low"), (0.2, 0.9, "blocked", "high")])
def test_policy_bands(spark, risk, uncertainty, band, level):
    r = P.policy_stack(spark.createDataFrame([(risk, uncertainty)], "risk double, uncertainty double")).first()
    assert (r.policy.band, r.policy.level) == (band, level)


def test_abstention_and_revision_branches(spark):
    r = R.run_cases(case(spark, risk=0.8, uncertainty=0.9, replay_risk=0.5)).first()
    assert r.result_label == "abstain_or_escalate" and r.decision.escalate and r.dream.rehearsal
    assert len(r.hypotheses) == 4 and {a.priority for a in r.critique.actions} == {"high"}


def test_null_texts(spark):
    r = R.run_cases(case(spark).withColumn("report_text", F.lit(None).cast("string"))).first()
    assert r.evidence[0]["item"].value == "case-001"


def test_adapters_without_configuration(spark):
    rows = spark.createDataFrame([(True, False, "x", True, "ab", "completed"), (None, None, None, None, None, None), (True, True, "", False, None, "failed")], "e boolean, d boolean, p string, c boolean, text string, outcome string")
    e, d, p, c = (F.col(x) for x in "edpc")
    got = rows.select(D.specialist_response(e, p).alias("s"), D.imaging_response(e, p).alias("i"), D.live_readiness(e, d, p, c).alias("l"), D.parsed_document(F.col("text"), F.col("outcome"), F.lit(None).cast("string")).alias("o")).collect()
    assert [r.s.status for r in got] == ["request_prepared", "not_called", "not_called"] == [r.i.status for r in got]
    assert [r.l.ready for r in got] == [True, False, False] and got[1].l.reasons == ["adapter_disabled", "endpoint_missing", "weaviate_client_unavailable"]
    assert got[2].l.reasons == ["dry_run_enabled", "endpoint_missing", "weaviate_client_unavailable"]
    assert [(r.o.status, r.o.parser, r.o.chunk_count) for r in got] == [("completed", "docling", 0), ("failed", "plain_text_fallback", None), ("failed", "plain_text_fallback", None)]


def test_refined_pipeline_by_default(spark):
    r = R.run_refined(spark.createDataFrame([("c",)], "case_id string"), F.lit(None).cast("string")).first()
    assert r.evidence[2] == "service:none" and r.policy.band == "clear" and r.context.allow and r.replay.replay_mode == "stabilizing_replay"

"""Queries from payloads: parsing, rejects, areas, decisions with trace and audit, and the stages' inner tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import areas as A
from ..operators import intake as N
from ..operators import reasoning as R
from ..sources import table
from . import query
from . import r3 as rs
from .cases import BASE, INTUITION, POLICY, REPLAY, SUPPORT, base_sql, cases

_VALID = "d.doc_id % 9 <> 0 AND (d.doc_id % 3 <> 0 OR d.doc_id % 4 IN (0, 1))"
_OWN = "0.9 AS replay_coherence, 0.1 AS replay_risk, 0.2 AS risk, 0.1 AS uncertainty"
PAYLOAD = base_sql(_OWN, _VALID, "false")


def payload_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of JSON for every document; parts are given or missing by the id."""
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("labs", F.lit(True))
    one = lambda k, v: F.create_map(F.lit(k), v.cast("string"))
    study = F.struct(
        F.concat(F.lit("study-"), i.cast("string")).alias("study_id"), F.when(i % 4 == 0, "CR").when(i % 4 == 1, "ct_3d").otherwise("XX").alias("modality"),
        F.when(i % 2 == 0, F.array(F.concat(F.lit("/img/"), i.cast("string"), F.lit(".png")))).alias("series_paths"),
    )
    payload = F.struct(
        F.when(i % 9 == 0, "").otherwise(F.concat(F.lit("case-"), i.cast("string"))).alias("case_id"), F.concat(F.lit("p"), i.cast("string")).alias("patient_id"),
        F.when(i % 2 == 0, one("age", i % 90)).alias("demographics"), F.col("text").alias("report_text"), F.when(i % 6 == 0, F.concat(F.lit("ehr note "), F.col("source"))).alias("ehr_text"),
        F.when(i % 3 == 0, "complaint of cough").alias("patient_complaints"), F.when(i % 3 == 0, F.array(study)).alias("imaging"), F.when(F.col("source").isNotNull(), one("source", F.col("source"))).alias("provenance"),
        F.when(i % 4 == 1, one("travel", i)).alias("exposures"), F.when(i % 5 == 0, one("pitch", i)).alias("voice_features"), F.when(i % 7 == 0, one("rash", i)).alias("patient_visual"),
        F.when(F.col("labs"), one("wbc", i)).alias("labs_snapshot"),
    )
    return docs.join(labelled, "doc_id", "left").select("doc_id", F.to_json(payload).alias("value"))


def _payloads(spark, sf_dir) -> DataFrame:
    return N.parsed(payload_lines(spark, sf_dir))


def _each(d: DataFrame, column: str, *fields: str) -> DataFrame:
    """(doc_id, place from 1, fields) of the structs in an array column.

    Only places are exploded: an explode of the structs is rewritten field by field, which repeats the whole plan below.
    """
    d = N.settled(d.select("doc_id", column))
    places = d.select("doc_id", column, F.explode(F.sequence(F.lit(1), F.size(column))).alias("place"))
    return places.select("doc_id", "place", *(F.element_at(column, F.col("place"))[f].alias(f) for f in fields))


def _decided(spark, sf_dir) -> DataFrame:
    return N.run_payloads(_payloads(spark, sf_dir))[0]


@query("""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'missing_required_field:case_id' ELSE 'unknown_modality:XX' END AS reason FROM documents d WHERE NOT (""" + _VALID + ")")
def payload_rejects(spark, sf_dir):
    return N.from_payload(_payloads(spark, sf_dir))[1].select("doc_id", "reason")


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'study-' || doc_id ELSE 'none' END AS study_id, (doc_id % 3 = 0 AND doc_id % 2 = 0)::INT AS image_count, doc_id % 3 = 0 AND doc_id % 2 = 0 AS has_local_images,
    length(coalesce(nullif(t, ''), nullif(e, ''), 'case-' || doc_id))::INT AS text_length, sha256(concat_ws(' | ', nullif(p, ''), nullif(t, ''), nullif(e, ''))) AS merged_sha,
    concat_ws(',', 'volume', 'pathology', CASE WHEN doc_id % 7 = 0 THEN 'patient_visual' END, CASE WHEN labs THEN 'labs_snapshot' END) AS visual,
    concat_ws(',', CASE WHEN p <> '' THEN 'patient_complaints' END, CASE WHEN t <> '' THEN 'report_text' END, CASE WHEN e <> '' THEN 'ehr_text' END, CASE WHEN doc_id % 5 = 0 THEN 'voice_features' END) AS heard,
    concat_ws(',', CASE WHEN doc_id % 2 = 0 THEN 'demographics' END, CASE WHEN source IS NOT NULL THEN 'provenance' END, CASE WHEN doc_id % 4 = 1 THEN 'exposures' END) AS epi,
    'bundle_keys,demographics,provenance' AS context_keys, 'pathology,text,volume' AS fused_keys, 'multimodal_fusion_engine' AS engine
    FROM (SELECT d.doc_id, source, coalesce(text, '') AS t, CASE WHEN d.doc_id % 6 = 0 THEN 'ehr note ' || source ELSE '' END AS e, CASE WHEN d.doc_id % 3 = 0 THEN 'complaint of cough' ELSE '' END AS p, l.doc_id IS NOT NULL AS labs
        FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE {_VALID})""")
def payload_areas(spark, sf_dir):
    c = N.with_areas(N.from_payload(_payloads(spark, sf_dir))[0])
    joined = lambda n: F.array_join(n, ",")
    return c.select(
        "doc_id", "study.study_id", "study.image_count", "study.has_local_images", "text_length", F.sha2("merged_text", 256).alias("merged_sha"), *(joined(n).alias(n) for n in ("visual", "heard", "epi", "context_keys")),
        joined("fusion.input_keys").alias("fused_keys"), "fusion.engine",
    )


_STAGES = REPLAY + INTUITION + SUPPORT + POLICY


@query(PAYLOAD + _STAGES + """ SELECT doc_id, CASE WHEN final_reasons = '' THEN top_label ELSE 'abstain_or_escalate' END AS result_label, final_reasons AS reasons, top_label, top_score, pi_score, mis AS mismatch_index,
    mode AS reasoning_mode, rapid, rational, contradiction, accepted, actions FROM fin""")
def payload_decision(spark, sf_dir):
    """From a line of JSON to the decision, through every stage."""
    d = _decided(spark, sf_dir)
    top = F.element_at("hypotheses", 1)
    return d.select(
        "doc_id", "result_label", F.array_join("decision.reasons", "; ").alias("reasons"), top["label"].alias("top_label"), top["score"].alias("top_score"), "metrics.pi_score", "metrics.mismatch_index",
        F.col("intuition.mode").alias("reasoning_mode"), "intuition.rapid", "intuition.rational", "intuition.contradiction", "dream.accepted", F.array_join(F.transform("actions", lambda a: a["label"]), "; ").alias("actions"),
    )


_N_ACTIONS = "length(actions) - length(replace(actions, ';', '')) + 1"
_BAND = "CASE WHEN abstain OR NOT allow THEN 'blocked' WHEN escalate THEN 'guarded' ELSE 'clear' END"
_TRACE = f"""concat_ws('|', 'case:' || case_id, 'evidence_count:8', 'policy_band:' || {_BAND}, 'reasoning_mode:' || mode, 'differential_top:' || top_label, 'top_domain:imaging_led',
    'recommended_actions:' || ({_N_ACTIONS}), 'mismatch_score:' || mismatch_score::VARCHAR)"""


@query(BASE + _STAGES + f" SELECT doc_id, {_TRACE} AS trace FROM fin")
def case_trace(spark, sf_dir):
    d = R.run_cases(cases(spark, sf_dir))
    return d.select("doc_id", F.array_join(N.decision_trace(d), "|").alias("trace"))


@query(BASE + _STAGES + " SELECT case_id, 8 AS evidence_count, CAST(1 + least(n_alt, 3) AS INT) AS hypothesis_count, risk, uncertainty, abstain OR NOT allow AS blocked, abstain, escalate FROM fin")
def case_state(spark, sf_dir):
    d = R.run_cases(cases(spark, sf_dir))
    s = d.select(N.state_summary(d).alias("s"), "policy.allow").select("s.*", "allow")
    return s.select("case_id", "evidence_count", "hypothesis_count", "risk", "uncertainty", (F.col("abstain") | ~F.col("allow")).alias("blocked"), "abstain", "escalate")


@query(PAYLOAD + _STAGES + f""", s AS (SELECT doc_id, string_agg(area || '=' || sal::VARCHAR, ',' ORDER BY area) AS salience FROM areas GROUP BY doc_id)
    SELECT f.doc_id, 0.35 AS min_pi_score, 0.7 AS max_mismatch_index, 0.75 AS max_uncertainty, pi_score, mis AS mismatch_index, uncertainty, abstain AS policy_abstain, escalate AS policy_escalate, 'orchestrator' AS final_authority,
        sha256({_TRACE}) AS trace_sha, salience, 3 AS semantic_memory FROM fin f JOIN s USING (doc_id)""")
def case_audit(spark, sf_dir):
    d = _decided(spark, sf_dir)
    a = d.select("doc_id", N.audit(d).alias("a"), N.support_summary(d).alias("s"))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("s.salience")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return a.select("doc_id", "a.thresholds.*", "a.observed.*", "a.final_authority", F.sha2(F.array_join("a.pipeline_trace", "|"), 256).alias("trace_sha"), listed.alias("salience"), "s.semantic_memory")


@query(BASE + REPLAY + INTUITION + """, act AS (SELECT doc_id, string_agg(area, ',' ORDER BY area) AS active_areas FROM areas GROUP BY doc_id)
    SELECT i.doc_id, CASE mode WHEN 'rapid_intuition' THEN 'candidate_1' WHEN 'rational_revision' THEN 'candidate_2' ELSE case_id || '_alt_1' END AS intuition, 3 AS candidate_count, 'quantum_like_belief_update' AS belief_mode,
        active_areas, replace(top_areas, '|', ',') AS top_areas, ic AS convergence_score, cf AS conflict_score, coherence_score, mismatch_score, pi_score, err AS prediction_error, pwc AS precision_weighted_coherence, conv AS convergence_index,
        mis AS mismatch_index, ctl AS inhibitory_control, gate AS deductive_gate, plas AS dream_plasticity, rate AS belief_update_rate, temp AS candidate_temperature, bonus AS area_pair_bonus, penalty AS disagreement_penalty,
        rehearsal AS contradiction_rehearsal, revision_bias, CASE WHEN rehearsal THEN 're-rank_alternatives' ELSE 'stabilize_primary' END AS post_error_adjustment, mode AS reasoning_mode FROM intuition i JOIN act USING (doc_id)""")
def area_trace(spark, sf_dir):
    d = R.with_intuition(R.with_replay(R.case_evidence(A.with_metrics(A.with_pairs(cases(spark, sf_dir))))))
    rows = d.select("doc_id", N.area_trace(d).alias("t")).select("doc_id", "t.*")
    return rows.withColumns({c: F.array_join(c, ",") for c in ("active_areas", "top_areas")})


@query(BASE + f""" SELECT doc_id, a, b, CASE WHEN coh THEN 'coherent' ELSE 'mismatch' END AS status,
    {rs("least(1.0, greatest(0.0, CASE WHEN coh THEN ns + exc + prec * 0.1 ELSE ns - sens * 0.2 END))")} AS coupling_score FROM shared""")
def pair_couplings(spark, sf_dir):
    d = A.with_pairs(cases(spark, sf_dir))
    return d.select("doc_id", F.explode(A.couplings(F.col("pairs"), F.col("total_salience"))).alias("p")).select("doc_id", "p.*")


@query(BASE + REPLAY + INTUITION + SUPPORT + """ SELECT doc_id, concat_ws(',', CASE WHEN spurious THEN 'spurious_conflict' END, CASE WHEN useful THEN 'useful_contradiction' END, CASE WHEN weak THEN 'weak_contradiction' END) AS classes FROM sup""")
def contradiction_classes(spark, sf_dir):
    d = R.with_support(R.with_intuition(R.with_replay(R.case_evidence(A.with_metrics(A.with_pairs(cases(spark, sf_dir)))))))
    return d.select("doc_id", F.array_join(R.distinct_classes("contradiction"), ",").alias("classes"))


@query(BASE + REPLAY + INTUITION + SUPPORT + f""", alts AS (SELECT doc_id, n_alt, accepted, boundary, exposures, txt, variant_focus, mismatch_score, contradiction_strength, case_id, rehearsal, rev, unnest([0, 1, 2]) AS i FROM hyp),
    named AS (SELECT *, CASE i WHEN 0 THEN CASE WHEN accepted THEN 'rare_case' ELSE 'adjacent_case' END WHEN 1 THEN CASE WHEN boundary THEN 'boundary_case' ELSE 'counterfactual_case' END
        ELSE CASE WHEN rehearsal THEN 'contradiction_revision' ELSE 'mismatch_resolution' END END AS own FROM alts WHERE i < least(n_alt, 3))
    SELECT doc_id, CAST(i + 2 AS INT) AS place, case_id || '_alt_' || (CASE WHEN i < 2 OR rehearsal THEN i + 1 ELSE 4 END) AS label,
        CASE own WHEN 'contradiction_revision' THEN 'contradiction_revision_alternative' WHEN 'mismatch_resolution' THEN 'mismatch_resolution' ELSE 'revision_alternative' END AS kind,
        {rs("0.4 + mismatch_score * 0.1 - i * 0.05 + contradiction_strength * 0.01")} AS score, greatest(8 - i - 1, 0)::INT AS support FROM named""")
def alternative_hypotheses(spark, sf_dir):
    d = R.with_differential(R.with_support(R.with_intuition(R.with_replay(R.case_evidence(A.with_metrics(A.with_pairs(cases(spark, sf_dir))))))))
    return _each(d, "hypotheses", "label", "kind", "score", "support").where("place > 1")


_SPOKEN = "CASE doc_id % 7 WHEN 0 THEN 'fusion:engine' WHEN 1 THEN 'dream:language_listening x' WHEN 2 THEN 'y dream:epidemiology' WHEN 3 THEN 'pair:a-visual_diagnostic' ELSE 'bundle:bundle_keys' END"


@query(f"""WITH d AS (SELECT doc_id, {_SPOKEN} AS s, CASE WHEN doc_id % 11 = 0 THEN 'contradiction_revision' ELSE 'intuition_engine' END AS source, CASE WHEN doc_id % 2 = 0 THEN 'mismatch_resolution' ELSE 'primary_hypothesis' END AS kind FROM documents),
    e AS (SELECT doc_id, CASE WHEN s LIKE '%fusion:%' OR s LIKE '%visual_diagnostic%' OR source = 'contradiction_revision' THEN 'imaging_led' WHEN s LIKE '%dream:language_listening%' THEN 'language_led'
        WHEN s LIKE '%dream:epidemiology%' THEN 'epidemiology_led' WHEN kind = 'mismatch_resolution' THEN 'mismatch_resolution_led' ELSE 'multimodal_led' END AS domain FROM d)
    SELECT doc_id, domain, CASE domain WHEN 'imaging_led' THEN 'repeat targeted imaging review;correlate imaging with structured report findings' WHEN 'language_led' THEN 'reassess symptom chronology;clarify narrative inconsistencies'
        WHEN 'epidemiology_led' THEN 'review exposure history;check prevalence-guided differential filters' WHEN 'mismatch_resolution_led' THEN 'cross-check modality agreement;request multimodal reconciliation review'
        ELSE 'expand corroborating evidence' END AS actions FROM e""")
def domain_actions(spark, sf_dir):
    """Every domain that signals can lead to, with its actions."""
    i = F.col("doc_id")
    spoken = F.when(i % 7 == 0, "fusion:engine").when(i % 7 == 1, "dream:language_listening x").when(i % 7 == 2, "y dream:epidemiology").when(i % 7 == 3, "pair:a-visual_diagnostic").otherwise("bundle:bundle_keys")
    source, kind = F.when(i % 11 == 0, "contradiction_revision").otherwise("intuition_engine"), F.when(i % 2 == 0, "mismatch_resolution").otherwise("primary_hypothesis")
    d = table(spark, sf_dir, "documents").select("doc_id", R.domain(F.array(spoken), source, kind).alias("domain"))
    return d.select("doc_id", "domain", F.array_join(F.transform(R.domain_actions(F.col("domain")), lambda a: a["label"]), ";").alias("actions"))


@query(f"""WITH q AS (SELECT doc_id, coalesce(nullif(text, ''), nullif(CASE WHEN doc_id % 6 = 0 THEN 'ehr note ' || source ELSE '' END, ''), 'case-' || doc_id) AS t FROM documents d WHERE {_VALID})
    SELECT doc_id, k::INT AS place, source, kind, CASE k WHEN 6 THEN substr(t, 1, 120) WHEN 7 THEN 'kg_link_for:' || substr(t, 1, 40) WHEN 8 THEN 'analogy_for:' || substr(t, 1, 40) ELSE value END AS value
    FROM q, (VALUES (1, 'bundle', 'bundle_keys', 'patient,diagnostic_report'), (2, 'retrieval', 'grounded_retrieval_ready', '3'), (3, 'fusion', 'engine', 'multimodal_fusion_engine'), (4, 'service', 'provider', 'api_for_service_volume_encoder'),
        (6, 'semantic_memory', 'summary', ''), (7, 'knowledge_graph', 'relation', ''), (8, 'episodic_memory', 'analogy', '')) v(k, source, kind, value)""")
def evidence_union(spark, sf_dir):
    d = _decided(spark, sf_dir)
    rows = _each(d.select("doc_id", N.evidence_union(d).alias("e")), "e", "source", "kind", "value")
    return rows.where("source <> 'intuition'")  # whose value payload_decision has


@query(f"""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'invalid_payload' ELSE 'completed' END AS status, CASE WHEN doc_id % 9 = 0 THEN 'missing_required_field:case_id' ELSE '' END AS errors,
    CASE WHEN coalesce(text, '') = '' AND doc_id % 3 <> 0 THEN 'minimal_payload_without_narrative_or_imaging' ELSE '' END AS warnings,
    2 + (doc_id % 2 = 0)::INT + (text IS NOT NULL)::INT + (doc_id % 6 = 0)::INT + 2 * (doc_id % 3 = 0)::INT + (source IS NOT NULL)::INT AS field_count FROM documents""")
def payload_validation(spark, sf_dir):
    fields = ["case_id", "patient_id", "demographics", "report_text", "ehr_text", "patient_complaints", "imaging", "provenance"]
    v = N.validation(_payloads(spark, sf_dir), fields)
    return v.select("doc_id", "status", F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"), "field_count")

"""Case queries: areas, pairs, metrics, replay, intuition, support, differential, policy, decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import first_present, focus, present
from ..operators import areas as A
from ..operators import memory as M
from ..operators import policy as P
from ..operators import reasoning as R
from ..operators.intake import settled
from ..sources import table
from . import query
from . import r3 as rs


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for every document: the text is its report; other streams depend on the id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("labs", F.lit(True))
    d = docs.join(labelled, "doc_id", "left")
    i, none = F.col("doc_id"), F.lit("")
    d = d.select(
        "doc_id", F.concat(F.lit("case-"), i.cast("string")).alias("case_id"), F.coalesce("text", none).alias("report_text"),
        F.when(i % 6 == 0, F.concat(F.lit("ehr note "), F.col("source"))).otherwise(none).alias("ehr_text"), F.when(i % 3 == 0, "complaint of cough").otherwise(none).alias("patient_complaints"),
        (i % 4 == 1).alias("exposures"), (0.5 + (i % 11) * 0.05).alias("replay_coherence"), ((i % 9) * 0.05).alias("replay_risk"), ((i % 13) * 0.05).alias("risk"), ((i % 17) * 0.06).alias("uncertainty"),
        A.streams(volume=F.lit(True), pathology=F.lit(True), patient_visual=i % 7 == 0, labs_snapshot=F.coalesce("labs", F.lit(False))).alias("visual"),
        A.streams(demographics=i % 2 == 0, provenance=F.col("source").isNotNull(), exposures=i % 4 == 1).alias("epi"),
        (i % 5 == 0).alias("voice"), (i % 10 == 3).alias("extra"),
    )
    heard = A.streams(patient_complaints=present(F.col("patient_complaints")), report_text=present(F.col("report_text")), ehr_text=present(F.col("ehr_text")), voice_features=F.col("voice"))
    d = d.withColumn("heard", heard)
    four = F.array(A.area("visual_diagnostic", F.size("visual")), A.area("language_listening", F.size("heard")), A.area("case_context", F.lit(3)), A.area("epidemiology", F.size("epi")))
    return settled(d.withColumn("areas", F.when(F.col("extra"), F.concat(four, F.array(A.area("genomics", F.lit(2))))).otherwise(four)))


_PRIORS = ", ".join(f"('{a}', '{b}', {w[0]}, {w[1]}, {w[2]}, {w[3]})" for (a, b), w in A.PAIRS.items())
_MEASURES = "0.5 + (d.doc_id % 11) * 0.05 AS replay_coherence, (d.doc_id % 9) * 0.05 AS replay_risk, (d.doc_id % 13) * 0.05 AS risk, (d.doc_id % 17) * 0.06 AS uncertainty"


def base_sql(measures: str = _MEASURES, wanted: str = "true", fifth: str = "doc_id % 10 = 3") -> str:
    """The stages up to the metrics over the documents that are ``wanted``; a ``fifth`` area where that holds."""
    return f"""
WITH base AS (
    SELECT d.doc_id, 'case-' || d.doc_id AS case_id, coalesce(d.text, '') AS report_text,
        CASE WHEN d.doc_id % 6 = 0 THEN 'ehr note ' || d.source ELSE '' END AS ehr_text, CASE WHEN d.doc_id % 3 = 0 THEN 'complaint of cough' ELSE '' END AS complaints,
        d.doc_id % 4 = 1 AS exposures, {measures},
        2 + (d.doc_id % 7 = 0)::INT + (l.doc_id IS NOT NULL)::INT AS nv,
        (coalesce(d.text, '') <> '')::INT + (d.doc_id % 6 = 0)::INT + (d.doc_id % 3 = 0)::INT + (d.doc_id % 5 = 0)::INT AS nl,
        (d.doc_id % 2 = 0)::INT + (d.source IS NOT NULL)::INT + (d.doc_id % 4 = 1)::INT AS ne
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE {wanted}
), areas AS (
    SELECT doc_id, area, ord, fields, n, sal, 1 - least(sal, 1.0) AS unc FROM (
        SELECT doc_id, 'visual_diagnostic' AS area, 0 AS ord, 9 AS fields, nv AS n, {rs("0.2 * nv")} AS sal FROM base
        UNION ALL SELECT doc_id, 'language_listening', 1, 8, nl, {rs("0.15 * nl")} FROM base
        UNION ALL SELECT doc_id, 'case_context', 2, 6, 3, {rs("0.1 * 3")} FROM base
        UNION ALL SELECT doc_id, 'epidemiology', 3, 8, ne, {rs("0.18 * ne")} FROM base
        UNION ALL SELECT doc_id, 'genomics', 4, 4, 2, {rs("0.25 * 2")} FROM base WHERE {fifth})
), priors(a, b, exc, inh, prec, sens) AS (VALUES {_PRIORS}),
pairs AS (
    SELECT x.doc_id, x.area AS a, y.area AS b, {rs("x.sal + y.sal")} AS psal, x.n + y.n AS pn, p.exc IS NOT NULL AS coh,
        coalesce(p.exc, 0.05) AS exc, coalesce(p.inh, 0.05) AS inh, coalesce(p.prec, 0.5) AS prec, coalesce(p.sens, 0.5) AS sens
    FROM areas x JOIN areas y ON x.doc_id = y.doc_id AND x.area < y.area LEFT JOIN priors p ON p.a = x.area AND p.b = y.area
), tot AS (
    SELECT doc_id, count(*) AS k, list_reduce(list(sal ORDER BY ord), lambda s, v: s + v) AS ts,
        list_reduce(list(least(1.0, greatest(0.0, sal / greatest(sal + unc + 0.001, 0.001))) ORDER BY ord), lambda s, v: s + v) / count(*) AS mean_prec
    FROM areas GROUP BY doc_id
), shared AS (SELECT p.*, least(1.0, greatest(0.0, psal / greatest(ts + 1.0, 1.0))) AS ns, ts FROM pairs p JOIN tot USING (doc_id)),
agg AS (
    SELECT doc_id, sum(coh::INT) AS good, sum((NOT coh)::INT) AS bad,
        list_reduce(list(CASE WHEN coh THEN psal * (1.0 + exc) ELSE 0.0 END ORDER BY a, b), lambda s, v: s + v) AS good_s,
        list_reduce(list(CASE WHEN coh THEN 0.0 ELSE psal * (1.0 + sens) END ORDER BY a, b), lambda s, v: s + v) AS bad_s,
        sum(CASE WHEN coh THEN pn ELSE 0 END) AS good_n, sum(CASE WHEN coh THEN 0 ELSE pn END) AS bad_n,
        list_reduce(list(CASE WHEN coh THEN exc * ns ELSE 0.0 END ORDER BY a, b), lambda s, v: s + v) AS exc_m,
        list_reduce(list(CASE WHEN coh THEN 0.0 ELSE inh * ns END ORDER BY a, b), lambda s, v: s + v) AS inh_m,
        list_reduce(list(prec * ns ORDER BY a, b), lambda s, v: s + v) AS prec_m, list_reduce(list(sens * ns ORDER BY a, b), lambda s, v: s + v) AS sens_m
    FROM shared GROUP BY doc_id
), coh AS (
    SELECT t.doc_id, k, ts, mean_prec, good, bad, good_s, bad_s, good_n, bad_n, exc_m, inh_m, prec_m, sens_m,
        {rs("good / k + ts * 0.05")} AS coherence_score, {rs("bad / k")} AS mismatch_score, greatest(good_s + bad_s, 1e-6) AS all_s
    FROM tot t JOIN agg USING (doc_id)
), m1 AS (
    SELECT *, good_s / all_s AS sync, bad_s / all_s AS ratio, ts / greatest(ts + bad_n + 1.0, 1.0) AS signal, prec_m / greatest(prec_m + sens_m + 1e-6, 1e-6) AS prior FROM coh
), m2 AS (SELECT *, coherence_score * (0.6 + signal + mean_prec * 0.25) AS pwc, mismatch_score * (0.4 + ratio + sens_m * 0.15) AS err FROM m1),
m3 AS (SELECT *, err + bad_n / greatest(good_n + bad_n, 1) * 0.35 AS load FROM m2),
m4 AS (
    SELECT *, least(1.0, greatest(0.0, coherence_score * 0.35 + sync * 0.25 + signal * 0.2 + prior * 0.15 + exc_m * 0.25)) AS conv,
        least(1.0, greatest(0.0, err * 0.45 + ratio * 0.25 + load * 0.2 + inh_m * 0.2)) AS mis, least(1.0, greatest(0.0, 1.0 - load * 0.55 + signal * 0.25 + mean_prec * 0.1)) AS ctl FROM m3
), m5 AS (
    SELECT *, least(1.0, greatest(0.0, pwc * 0.35 + conv * 0.3 + ctl * 0.2 + sync * 0.25 - err * 0.35)) AS gate, least(1.0, greatest(0.0, err * 0.45 + load * 0.35 + 0.0 * 0.2 + mis * 0.2)) AS rev FROM m4
), m6 AS (SELECT *, least(1.0, greatest(0.0, 0.35 + rev * 0.4 + (1.0 - ctl) * 0.15)) AS plas FROM m5),
m7 AS (SELECT *, least(1.0, greatest(0.0, pwc * 0.35 + conv * 0.25 + ctl * 0.18 + signal * 0.12 - err * 0.22 - mis * 0.18 + plas * 0.04)) AS pi FROM m6),
metrics AS (
    SELECT doc_id, coherence_score, mismatch_score, good, bad, {rs("pi")} AS pi_score, {rs("least(1.0, greatest(0.0, pwc))")} AS pwc, {rs("least(1.0, greatest(0.0, err))")} AS err,
        {rs("least(1.0, greatest(0.0, load))")} AS load, {rs("conv")} AS conv, {rs("mis")} AS mis, {rs("ctl")} AS ctl, {rs("gate")} AS gate, {rs("rev")} AS rev, {rs("plas")} AS plas,
        {rs("least(1.35, greatest(0.5, 1.0 + gate * 0.25 - rev * 0.15 + conv * 0.1))")} AS gain, {rs("least(1.0, greatest(0.0, ctl * 0.65 + signal * 0.2 + prior * 0.15 - mis * 0.15))")} AS bias,
        {rs("least(1.5, greatest(0.35, 1.0 - gate * 0.25 + rev * 0.35))")} AS temp, {rs("least(1.0, greatest(0.0, pi * 0.45 + plas * 0.25 + conv * 0.2 - load * 0.2))")} AS rate,
        {rs("sync")} AS sync, {rs("ratio")} AS ratio, {rs("signal")} AS signal, {rs("prior")} AS prior
    FROM m7
)"""


BASE = base_sql()

REPLAY = f""", dream AS (
    SELECT b.*, m.* EXCLUDE (doc_id), replay_coherence >= 0.7 AND replay_risk <= 0.3 AS accepted, report_text <> '' OR complaints <> '' AS txt,
        CASE WHEN mismatch_score > 0.6 THEN 'cross_area_alignment' WHEN exposures THEN 'epidemiology' WHEN report_text <> '' OR complaints <> '' THEN 'language_listening' ELSE 'context' END AS variant_focus,
        replay_coherence < 0.95 AND replay_risk <= 0.15 AS boundary
    FROM base b JOIN metrics m USING (doc_id)
), dream2 AS (
    SELECT *, NOT accepted OR replay_risk > 0.2 OR mismatch_score > 0.6 OR rev > 0.55 AS rehearsal,
        CASE WHEN replay_risk > 0.15 OR mismatch_score > 0.4 OR rev > 0.5 THEN 'conservative' ELSE 'exploratory' END AS revision_bias,
        2 + (NOT accepted OR replay_risk > 0.2 OR mismatch_score > 0.6 OR rev > 0.55)::INT + (mismatch_score > 0.6 OR rev > 0.6)::INT AS n_alt FROM dream
)"""

INTUITION = f""", weights AS (SELECT doc_id, area, row_number() OVER (PARTITION BY doc_id ORDER BY fields + n + sal - unc DESC, ord) AS r, fields + n + sal - unc AS w FROM areas),
top AS (
    SELECT doc_id, max(w) FILTER (r = 1) AS w1, max(w) FILTER (r = 2) AS w2, array_to_string(list(area ORDER BY r) FILTER (r <= 2), '|') AS top_areas, array_to_string(list(area ORDER BY area) FILTER (r <= 2), '|') AS top_pair
    FROM weights GROUP BY doc_id
), int1 AS (
    SELECT d.*, top_areas, top_pair, {rs("w2 / greatest(w1, 1.0)")} AS ic, {rs("(w1 - w2) / greatest(w1, 1.0)")} AS cf FROM dream2 d JOIN top USING (doc_id)
), int2 AS (
    SELECT *, {rs('''(CASE top_pair WHEN 'language_listening|visual_diagnostic' THEN 0.2 WHEN 'epidemiology|visual_diagnostic' THEN 0.15 WHEN 'case_context|language_listening' THEN 0.1 ELSE 0.0 END)
            + 0.08 * coherence_score + 0.12 * pi_score + conv * 0.18''')} AS bonus,
        {rs("greatest(cf - 0.4, 0.0) + mismatch_score * 0.08 + err * 0.18 + mis * 0.22 - ctl * 0.1")} AS penalty FROM int1
), int3 AS (
    SELECT *, {rs("(2.48 + bonus + ic + gate + bias * 0.18 + pi_score * 0.2 - penalty) * gain / greatest(temp, 0.35)")} AS rapid,
        {rs("2.25 + cf + (CASE WHEN revision_bias = 'conservative' THEN 0.2 ELSE 0.0 END) + mismatch_score * 0.08 + rev * 0.25 + pwc * 0.12 + gate * 0.15")} AS rational,
        {rs("(CASE WHEN rehearsal THEN 1.0 ELSE 0.0 END) + (CASE WHEN rehearsal THEN 0.3 ELSE 0.0 END) + 0.1 * n_alt + mismatch_score * 0.18 + err * 0.3 + mis * 0.25 + plas * 0.2")} AS contradiction FROM int2
), intuition AS (
    SELECT *, CASE WHEN rapid >= rational AND rapid >= contradiction THEN 'rapid_intuition' WHEN rational >= contradiction THEN 'rational_revision' ELSE 'contradiction_revision' END AS mode, greatest(rapid, rational, contradiction) AS best FROM int3
)"""

SUPPORT = f""", bads AS (SELECT doc_id, list('pair:' || a || '-' || b ORDER BY a, b) FILTER (NOT coh) AS bad_pairs, list('pair:' || a || '-' || b ORDER BY a, b) FILTER (coh) AS good_pairs FROM pairs GROUP BY doc_id),
sup AS (
    SELECT i.*, list_concat(['bundle:bundle_keys', 'retrieval:grounded_retrieval_ready', 'fusion:engine', 'service:provider'],
            list_concat(CASE WHEN coherence_score > 0.4 THEN good_pairs[1:2] ELSE [] END, CASE WHEN good > 0 THEN ['dream:multimodal_support'] ELSE [] END)) AS support_labels,
        list_concat(CASE WHEN mode = 'contradiction_revision' THEN ['intuition:contradiction_revision'] ELSE [] END, list_concat(
            CASE WHEN mismatch_score > 0.6 THEN list_concat(['areas:high_mismatch'], bad_pairs[1:2]) WHEN mismatch_score > 0.3 THEN ['areas:moderate_mismatch'] WHEN bad > 0 THEN ['areas:low_conflict'] ELSE [] END,
            CASE WHEN boundary THEN ['dream:boundary_case'] ELSE [] END)) AS contradiction_labels,
        {rs("0.2 + 0.2 + 0.2 + 0.2 + (CASE WHEN coherence_score > 0.4 THEN 0.3 * least(good, 2) ELSE 0.0 END) + (CASE WHEN good > 0 THEN 0.25 ELSE 0.0 END)")} AS support_strength,
        {rs('''(CASE WHEN mode = 'contradiction_revision' THEN 0.4 ELSE 0.0 END) + (CASE WHEN mismatch_score > 0.6 THEN 0.5 + 0.35 * least(bad, 2) WHEN mismatch_score > 0.3 THEN 0.2 WHEN bad > 0 THEN 0.1 ELSE 0.0 END)
            + (CASE WHEN boundary THEN 0.15 ELSE 0.0 END)''')} AS contradiction_strength,
        mode = 'contradiction_revision' OR mismatch_score > 0.6 AS useful, boundary OR (mismatch_score > 0.3 AND mismatch_score <= 0.6) AS weak, mismatch_score <= 0.3 AND bad > 0 AS spurious
    FROM intuition i JOIN bads USING (doc_id)
), hyp AS (
    SELECT *, CASE mode WHEN 'rapid_intuition' THEN 'candidate_1' WHEN 'rational_revision' THEN 'candidate_2' ELSE case_id || '_alt_1' END AS top_label,
        {rs("best + coherence_score * 0.1 + support_strength * 0.02")} AS top_score, {rs("0.4 + mismatch_score * 0.1 - 0 * 0.05 + contradiction_strength * 0.01")} AS alt1_score,
        {rs("0.4 + mismatch_score * 0.1 - 1 * 0.05 + contradiction_strength * 0.01")} AS alt2_score,
        array_to_string(list_concat(['repeat targeted imaging review', 'correlate imaging with structured report findings'], list_concat(list_concat(
            CASE WHEN useful THEN ['recheck multimodal alignment'] ELSE [] END, CASE WHEN coherence_score < 0.5 THEN ['expand corroborating evidence'] ELSE [] END), list_concat(
            CASE WHEN mode = 'contradiction_revision' THEN ['review alternative hypotheses'] ELSE [] END, CASE WHEN weak THEN ['monitor boundary conditions'] ELSE [] END))), '; ') AS actions
    FROM sup
)"""

POLICY = """, pol AS (
    SELECT *, uncertainty >= 0.65 AS abstain, risk <= 0.35 AS allow, risk > 0.35 OR uncertainty > 0.65 AS escalate FROM hyp
), fin AS (
    SELECT *, concat_ws('; ', CASE WHEN pi_score < 0.35 THEN 'pi_score_below_threshold' END, CASE WHEN mis > 0.7 THEN 'mismatch_index_above_threshold' END, CASE WHEN uncertainty > 0.75 THEN 'uncertainty_above_threshold' END,
        CASE WHEN abstain THEN 'policy_abstention_requested' END, CASE WHEN escalate THEN 'policy_escalation_requested' END) AS final_reasons FROM pol
)"""


@query(BASE + " SELECT doc_id, area, CAST(n AS INT) AS n, sal AS salience, unc AS uncertainty FROM areas")
def area_signals(spark, sf_dir):
    return cases(spark, sf_dir).select("doc_id", F.explode("areas").alias("a")).select("doc_id", "a.area", "a.n", "a.salience", "a.uncertainty")


@query(BASE + " SELECT doc_id, a, b, coh AS coherent, psal AS salience, CAST(pn AS INT) AS n, exc, prec FROM pairs")
def area_pairs(spark, sf_dir):
    rows = A.with_pairs(cases(spark, sf_dir)).select("doc_id", F.explode("pairs").alias("p"))
    return rows.select("doc_id", "p.a", "p.b", "p.coherent", "p.salience", "p.n", F.col("p.w.exc").alias("exc"), F.col("p.w.prec").alias("prec"))


@query(BASE + f" SELECT doc_id, coherence_score, mismatch_score, {rs('ts')} AS total_salience FROM coh")
def area_coherence(spark, sf_dir):
    from ..functions.scalars import r3

    return A.with_pairs(cases(spark, sf_dir)).select("doc_id", "coherence_score", "mismatch_score", r3(F.col("total_salience")).alias("total_salience"))


_METRICS = {
    "pi_score": "pi_score", "precision_weighted_coherence": "pwc", "prediction_error": "err", "cross_area_synchrony": "sync", "mismatch_ratio": "ratio", "signal_precision": "signal", "prior_precision": "prior",
    "conflict_load": "load", "convergence_index": "conv", "mismatch_index": "mis", "inhibitory_control": "ctl", "deductive_gate": "gate", "revision_pressure": "rev", "dream_plasticity": "plas",
    "intuition_gain": "gain", "bias_suppression_score": "bias", "candidate_temperature": "temp", "belief_update_rate": "rate",
}


@query(BASE + " SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in _METRICS.items()) + " FROM metrics")
def neuro_metrics(spark, sf_dir):
    return A.with_metrics(A.with_pairs(cases(spark, sf_dir))).select("doc_id", "metrics.*")


def _belief_sql(prior: int, context: int) -> str:
    c, i = rs(f"0.5 * {context} / {prior + context}"), rs(f"0.5 * {context - prior} / {context}")
    return f""", bl AS (SELECT doc_id, {c} AS contextuality_score, {i} AS interference_score, {rs("least(1.0, greatest(0.0, pi_score * 0.35 + pwc * 0.15))")} AS precision_modulation,
        {rs("least(1.0, greatest(0.0, err * 0.25 + load * 0.15))")} AS conflict_modulation FROM metrics)
    SELECT *, {rs("least(1.0, greatest(0.0, contextuality_score + interference_score + precision_modulation - conflict_modulation))")} AS belief_shift,
        {rs("least(1.0, greatest(0.0, 1.0 - conflict_modulation + precision_modulation * 0.5))")} AS belief_stability FROM bl"""


@query(BASE + _belief_sql(2, 23))
def belief_update(spark, sf_dir):
    m = A.with_metrics(A.with_pairs(cases(spark, sf_dir)))
    b = A.belief(F.lit(2), F.lit(23), F.col("metrics.pi_score"), F.col("metrics.precision_weighted_coherence"), F.col("metrics.prediction_error"), F.col("metrics.conflict_load"))
    return m.select("doc_id", b.alias("b")).select("doc_id", "b.*")


@query(BASE + f""" SELECT doc_id, replay_coherence >= 0.7 AND replay_risk <= 0.3 AS accepted, {rs("replay_coherence - 0.7")} AS coherence_margin, {rs("0.3 - replay_risk")} AS risk_margin,
    {rs(rs("replay_coherence - 0.7") + " + " + rs("0.3 - replay_risk"))} AS acceptance_score,
    CASE WHEN NOT (replay_coherence >= 0.7 AND replay_risk <= 0.3) THEN 'corrective_replay' WHEN replay_coherence < 0.7 + 0.1 OR replay_risk > 0.3 - 0.1 THEN 'boundary_replay' ELSE 'stabilizing_replay' END AS replay_mode FROM base""")
def replay_filter(spark, sf_dir):
    c = cases(spark, sf_dir)
    return c.select("doc_id", P.replay_filter(F.col("replay_coherence"), F.col("replay_risk")).alias("f")).select("doc_id", "f.*")


@query(BASE + REPLAY + f""" SELECT doc_id, variant_focus, CASE variant_focus WHEN 'epidemiology' THEN 'context_recombination; exposure_shift' WHEN 'language_listening' THEN 'context_recombination; narrative_reframing'
    WHEN 'cross_area_alignment' THEN 'context_recombination; multimodal_reconciliation' ELSE 'context_recombination' END AS plan, CASE WHEN variant_focus = 'context' THEN 0.2 ELSE 0.4 END AS novelty_score FROM dream2""")
def counterfactual(spark, sf_dir):
    c = A.with_pairs(cases(spark, sf_dir))
    s = R.counterfactual(F.col("mismatch_score"), F.col("exposures"), present(F.col("report_text")) | present(F.col("patient_complaints")))
    return c.select("doc_id", s.alias("s")).select("doc_id", "s.variant_focus", F.array_join("s.plan", "; ").alias("plan"), "s.novelty_score")


def _replayed(spark, sf_dir):
    return R.with_replay(R.case_evidence(A.with_metrics(A.with_pairs(cases(spark, sf_dir)))))


@query(BASE + REPLAY + f""" SELECT doc_id, accepted, boundary, rehearsal, revision_bias, CASE WHEN rehearsal THEN 're-rank_alternatives' ELSE 'stabilize_primary' END AS adjustment,
    concat_ws('; ', case_id || '_alt_1 ' || (CASE WHEN accepted THEN 'rare_case' ELSE 'adjacent_case' END) || ' ' || (CASE WHEN exposures THEN 'epidemiology' ELSE variant_focus END),
        case_id || '_alt_2 ' || (CASE WHEN boundary THEN 'boundary_case' ELSE 'counterfactual_case' END) || ' ' || (CASE WHEN txt THEN 'language_listening' ELSE variant_focus END),
        CASE WHEN rehearsal THEN case_id || '_alt_3 contradiction_revision multi_area_recheck' END, CASE WHEN mismatch_score > 0.6 OR rev > 0.6 THEN case_id || '_alt_4 mismatch_resolution cross_area_alignment' END) AS alternatives,
    CASE WHEN accepted AND pi_score >= 0.55 AND conv >= 0.45 AND replay_risk <= 0.25 AND plas >= 0.35 THEN 'candidate' ELSE 'hold_for_more_evidence' END AS evolution,
    {rs("pi_score * 0.35 + conv * 0.3 + plas * 0.2 - replay_risk * 0.15")} AS evolution_score, {rs("0.5 * 6 / 7")} AS contextuality_score FROM dream2""")
def dream_alternatives(spark, sf_dir):
    d = _replayed(spark, sf_dir)
    listed = F.array_join(F.transform("dream.alternatives", lambda a: F.concat_ws(" ", a["label"], a["kind"], a["focus"])), "; ")
    return d.select(
        "doc_id", "dream.accepted", "dream.boundary", "dream.rehearsal", "dream.revision_bias", "dream.adjustment", listed.alias("alternatives"), "dream.evolution", "dream.evolution_score",
        F.col("dream.belief.contextuality_score").alias("contextuality_score"),
    )


@query(BASE + REPLAY + INTUITION + " SELECT doc_id, mode, best AS score, rapid, rational, contradiction, top_areas, ic AS convergence, cf AS conflict, bonus, penalty FROM intuition")
def intuition_scores(spark, sf_dir):
    d = R.with_intuition(_replayed(spark, sf_dir))
    i = "intuition"
    return d.select("doc_id", *(f"{i}.{x}" for x in ("mode", "score", "rapid", "rational", "contradiction")), F.array_join(f"{i}.top_areas", "|").alias("top_areas"), *(f"{i}.{x}" for x in ("convergence", "conflict", "bonus", "penalty")))


@query(BASE + REPLAY + INTUITION + SUPPORT + " SELECT doc_id, array_to_string(support_labels, '; ') AS support, array_to_string(contradiction_labels, '; ') AS contradiction, support_strength, contradiction_strength FROM sup")
def support_profiles(spark, sf_dir):
    d = R.with_support(R.with_intuition(_replayed(spark, sf_dir)))
    names = lambda n: F.array_join(F.transform(n, lambda p: p["label"]), "; ").alias(n)
    return d.select("doc_id", names("support"), names("contradiction"), "support_strength", "contradiction_strength")


@query(BASE + REPLAY + INTUITION + SUPPORT + """ SELECT doc_id, top_label, CASE mode WHEN 'rational_revision' THEN 'revision_hypothesis' WHEN 'contradiction_revision' THEN 'contradiction_revision_hypothesis' ELSE 'primary_hypothesis' END AS kind,
    'imaging_led' AS domain, top_score, alt1_score, alt2_score, CAST(1 + least(n_alt, 3) AS INT) AS n_hypotheses, actions FROM hyp""")
def differential(spark, sf_dir):
    d = R.with_differential(R.with_support(R.with_intuition(_replayed(spark, sf_dir))))
    h = lambda k, n: F.element_at("hypotheses", k)[n]
    return d.select(
        "doc_id", h(1, "label").alias("top_label"), h(1, "kind").alias("kind"), h(1, "domain").alias("domain"), h(1, "score").alias("top_score"), h(2, "score").alias("alt1_score"), h(3, "score").alias("alt2_score"),
        F.size("hypotheses").alias("n_hypotheses"), F.array_join(F.transform("actions", lambda a: a["label"]), "; ").alias("actions"),
    )


@query(BASE + f""" SELECT doc_id, uncertainty >= 0.65 AS abstain, risk <= 0.35 AS allow, risk > 0.35 OR uncertainty > 0.65 AS escalate,
    concat_ws('; ', CASE WHEN uncertainty >= 0.65 THEN 'uncertainty_above_abstention_threshold' END, CASE WHEN risk > 0.35 THEN 'risk_above_gate_threshold' END, CASE WHEN risk > 0.35 THEN 'risk_above_threshold' END,
        CASE WHEN uncertainty > 0.65 THEN 'uncertainty_above_threshold' END) AS reasons,
    CASE WHEN uncertainty >= 0.65 OR risk > 0.35 THEN 'blocked' WHEN uncertainty > 0.65 THEN 'guarded' ELSE 'clear' END AS band,
    CASE WHEN risk > 0.5 OR uncertainty > 0.8 THEN 'high' WHEN risk > 0.35 OR uncertainty > 0.65 THEN 'moderate' ELSE 'low' END AS level,
    {rs("uncertainty - 0.65")} AS abstention_margin, CASE WHEN uncertainty >= 0.65 + 0.15 THEN 'high' WHEN uncertainty >= 0.65 THEN 'guarded' ELSE 'low' END AS abstention_level,
    {rs("0.35 - risk")} AS risk_margin, CASE WHEN risk > 0.35 + 0.15 THEN 'high' WHEN risk > 0.35 THEN 'guarded' ELSE 'low' END AS risk_band FROM base""")
def policy_stack(spark, sf_dir):
    d = P.policy_stack(cases(spark, sf_dir))
    return d.select(
        "doc_id", "policy.abstain", "policy.allow", "policy.escalate", F.array_join("policy.reasons", "; ").alias("reasons"), "policy.band", "policy.level",
        F.col("abstention.margin").alias("abstention_margin"), F.col("abstention.level").alias("abstention_level"), F.col("gate.margin").alias("risk_margin"), F.col("gate.band").alias("risk_band"),
    )


@query(f"""SELECT doc_id, s >= 0.6 AS allow, {rs("s - 0.6")} AS margin, CASE WHEN s >= 0.6 + 0.2 THEN 'high' WHEN s >= 0.6 THEN 'guarded' ELSE 'low' END AS level,
    CASE WHEN s >= 0.6 THEN 'contextuality_above_quantum_gate_threshold' ELSE 'contextuality_below_quantum_gate_threshold' END AS reason FROM (SELECT doc_id, (doc_id % 21) * 0.05 AS s FROM documents)""")
def context_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", P.context_gate((F.col("doc_id") % 21) * 0.05).alias("g"))
    return d.select("doc_id", "g.*")


@query(BASE + REPLAY + INTUITION + SUPPORT + POLICY + """ SELECT doc_id, concat_ws('; ', CASE WHEN mismatch_score > 0.5 THEN 'high_cross_area_mismatch' END, CASE WHEN mode = 'contradiction_revision' THEN 'contradiction_revision_active' END,
        CASE WHEN boundary THEN 'boundary_case_review' END, CASE WHEN useful THEN 'useful_contradiction_detected' END, CASE WHEN spurious THEN 'possible_spurious_conflict' END) AS warnings,
    coalesce(nullif(concat_ws('; ', CASE WHEN mismatch_score > 0.5 OR useful THEN 'recheck multimodal consistency' END, CASE WHEN escalate THEN 'escalate to expert review' END,
        CASE WHEN spurious THEN 'down-weight low-value conflicts' END), ''), 'proceed with monitored interpretation') AS suggestions,
    CAST(CASE WHEN escalate THEN 2 + useful::INT + (coherence_score < 0.5)::INT + (mode = 'contradiction_revision')::INT + weak::INT
        WHEN mismatch_score > 0.5 THEN 1 + useful::INT + (CASE WHEN mode = 'contradiction_revision' THEN 1 + weak::INT ELSE 0 END)
        WHEN mode = 'contradiction_revision' THEN 1 + weak::INT ELSE 0 END AS INT) AS high_actions FROM pol""")
def critique_actions(spark, sf_dir):
    d = R.run_cases(cases(spark, sf_dir))
    high = F.size(F.filter("critique.actions", lambda a: a["priority"] == "high"))
    return d.select("doc_id", F.array_join("critique.warnings", "; ").alias("warnings"), F.array_join("critique.suggestions", "; ").alias("suggestions"), high.alias("high_actions"))


_DECISION = """ SELECT doc_id, CASE WHEN final_reasons = '' THEN top_label ELSE 'abstain_or_escalate' END AS result_label, final_reasons = '' AS allow, final_reasons <> '' OR abstain AS abstain,
    escalate OR mis > 0.7 OR uncertainty > 0.75 AS escalate, final_reasons AS reasons, pi_score, mis AS mismatch_index FROM fin"""


@query(BASE + REPLAY + INTUITION + SUPPORT + POLICY + _DECISION)
def orchestrator_decision(spark, sf_dir):
    d = R.run_cases(cases(spark, sf_dir))
    return d.select("doc_id", "result_label", "decision.allow", "decision.abstain", "decision.escalate", F.array_join("decision.reasons", "; ").alias("reasons"), "metrics.pi_score", "metrics.mismatch_index")


@query(BASE + REPLAY + INTUITION + SUPPORT + POLICY + """ SELECT case_id, top_label AS top_hypothesis, top_score, actions, CASE WHEN abstain OR NOT allow THEN 'blocked' WHEN escalate THEN 'guarded' ELSE 'clear' END AS band,
    'selected ' || top_label || ' by ' || mode AS trace FROM fin""")
def case_summary(spark, sf_dir):
    d = R.run_cases(cases(spark, sf_dir))
    top = F.element_at("hypotheses", 1)
    return d.select("case_id", top["label"].alias("top_hypothesis"), top["score"].alias("top_score"), F.array_join(F.transform("actions", lambda a: a["label"]), "; ").alias("actions"), F.col("policy.band").alias("band"),
                    F.concat(F.lit("selected "), top["label"], F.lit(" by "), F.col("intuition.mode")).alias("trace"))


@query(BASE + REPLAY + """ SELECT case_id, pi_score >= 0.55 AND err <= 0.45 AND bias >= 0.45 AS accepted, CASE WHEN pi_score >= 0.55 AND err <= 0.45 AND bias >= 0.45 THEN 'promoted' ELSE 'candidate' END AS learning_status,
    'dream-' || case_id || '-' || row_number() OVER (ORDER BY doc_id) AS record_id FROM dream2""")
def rehearsal(spark, sf_dir):
    """Cases are rehearsed in the order of their ids; each adds a record, so its own carries the size of the store after it."""
    d = A.with_metrics(A.with_pairs(cases(spark, sf_dir)))
    ok = P.promotion(F.col("metrics.pi_score"), F.col("metrics.prediction_error"), F.col("metrics.bias_suppression_score"))
    n = M.numbered(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    d = d.join(n, "doc_id")
    return d.select("case_id", ok.alias("accepted"), F.when(ok, "promoted").otherwise("candidate").alias("learning_status"), F.concat(F.lit("dream-"), "case_id", F.lit("-"), F.col("place").cast("string")).alias("record_id"))


_FOCUS_TEXT = "coalesce(text, '') || ' ' || CASE doc_id % 4 WHEN 0 THEN 'ct scan' WHEN 1 THEN 'dry cough' WHEN 2 THEN 'travel abroad' ELSE 'zz' END"
_FOCUS_CASE = "CASE WHEN regexp_matches(q, 'ct|mri|rmn|tac|lesion|nodule|imaging') THEN 'visual_diagnostic' WHEN regexp_matches(q, 'cough|pain|fatigue|history|symptom|complaint') THEN 'language_listening' WHEN regexp_matches(q, 'travel|smoking|exposure|occupation|prevalence') THEN 'epidemiology' ELSE 'multimodal_context' END"


@query(f"SELECT doc_id, {_FOCUS_CASE} AS focus FROM (SELECT doc_id, lower({_FOCUS_TEXT}) AS q FROM documents)")
def focus_routing(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    phrase = F.when(F.col("doc_id") % 4 == 0, "ct scan").when(F.col("doc_id") % 4 == 1, "dry cough").when(F.col("doc_id") % 4 == 2, "travel abroad").otherwise("zz")
    return d.select("doc_id", focus(F.concat_ws(" ", F.coalesce("text", F.lit("")), phrase)).alias("focus"))


@query(f"""WITH q AS (SELECT doc_id, t, {_FOCUS_CASE} AS focus FROM (SELECT doc_id, coalesce(nullif(text, ''), 'case-' || doc_id) AS t, lower(coalesce(nullif(text, ''), 'case-' || doc_id)) AS q FROM documents))
    SELECT doc_id, rank, source, substr(CASE WHEN rank = 1 THEN substr(t, 1, 120) ELSE pre || substr(t, 1, 40) END, 1, 200) AS value, focus, weight
    FROM q, (VALUES (1, 'semantic_memory', '', 2.48), (2, 'knowledge_graph', 'kg_link_for:', 2.25), (3, 'episodic_memory', 'analogy_for:', 1.99)) v(rank, source, pre, weight)""")
def evidence_rank(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", first_present(F.col("text"), F.concat(F.lit("case-"), F.col("doc_id").cast("string"))).alias("q"))
    rows = d.select("doc_id", F.explode(R.ranked(R.retrieved(F.col("q")))).alias("e"))
    return rows.select("doc_id", "e.rank", "e.item.source", "e.item.value", "e.item.focus", "e.weight")


@query("""SELECT doc_id, CAST(length(coalesce(nullif(text, ''), 'case-' || doc_id)) AS INT) AS text_length, CAST(length(coalesce(text, '')) AS INT) AS heard_length, a + b + c + d AS uncertainty_total
    FROM (SELECT *, (doc_id % 3) * 0.1 AS a, (doc_id % 5) * 0.1 AS b, (doc_id % 7) * 0.1 AS c, 0.25 AS d FROM documents)""")
def text_features(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    total = (i % 3) * 0.1 + (i % 5) * 0.1 + (i % 7) * 0.1 + F.lit(0.25)
    return d.select("doc_id", F.char_length(first_present(F.col("text"), F.concat(F.lit("case-"), i.cast("string")))).alias("text_length"), F.char_length(F.coalesce("text", F.lit(""))).alias("heard_length"), total.alias("uncertainty_total"))


@query("""SELECT doc_id, least(1.0, greatest(0.0, c)) AS salience_score, least(1.0, greatest(0.0, u)) AS uncertainty_score, CAST(doc_id % 4 AS INT) AS signal_count
    FROM (SELECT doc_id, (doc_id % 16) * 0.125 - 0.25 AS c, (doc_id % 8) * 0.25 - 0.25 AS u FROM documents)""")
def specialist_signals(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    s = A.specialist_signal((i % 16) * 0.125 - 0.25, (i % 8) * 0.25 - 0.25, F.array_repeat(F.lit("s"), (i % 4).cast("int")))
    return d.select("doc_id", s.alias("s")).select("doc_id", "s.*")


@query("""SELECT doc_id, 'bundle:patient,diagnostic_report;retrieval:grounded_retrieval_ready;service:' || CASE WHEN doc_id % 2 = 0 THEN 'local_imaging_feature_provider' ELSE 'none' END AS evidence,
        CASE WHEN u >= 0.65 OR r > 0.35 THEN 'blocked' WHEN r > 0.35 OR u > 0.65 THEN 'guarded' ELSE 'clear' END AS band, s >= 0.6 AS context_allowed,
        CASE WHEN NOT (c >= 0.7 AND q <= 0.3) THEN 'corrective_replay' WHEN c < (0.7 + 0.1) OR q > (0.3 - 0.1) THEN 'boundary_replay' ELSE 'stabilizing_replay' END AS replay_mode
    FROM (SELECT doc_id, (doc_id % 13) * 0.05 AS r, (doc_id % 17) * 0.06 AS u, (doc_id % 8) * 0.125 AS s, 0.5 + (doc_id % 11) * 0.05 AS c, (doc_id % 9) * 0.05 AS q FROM documents)""")
def refined_cases(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id")
    done = R.run_refined(d, F.when(i % 2 == 0, "local_imaging_feature_provider"), (i % 13) * 0.05, (i % 17) * 0.06, (i % 8) * 0.125, 0.5 + (i % 11) * 0.05, (i % 9) * 0.05)
    return done.select("doc_id", F.array_join("evidence", ";").alias("evidence"), F.col("policy.band").alias("band"), F.col("context.allow").alias("context_allowed"), F.col("replay.replay_mode").alias("replay_mode"))

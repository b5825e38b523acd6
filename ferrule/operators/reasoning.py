"""From metrics to decisions: replay, intuition, support, differential, critique, decision.

Every stage adds a struct column to a row per case and shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import first_present, focus, present, r3, reasons
from .areas import belief
from .policy import context_gate, decide, policy_stack, replay_filter

#: Priorities of evidence by source and by kind; others have DEFAULT_PRIORITY.
SOURCE_PRIORITY = {"semantic_memory": 0.9, "knowledge_graph": 0.8, "episodic_memory": 0.7, "retrieval": 0.75, "bundle": 0.72, "fusion": 0.68, "service": 0.6}
KIND_PRIORITY = {"summary": 0.8, "relation": 0.75, "analogy": 0.65, "grounded": 0.78, "bundle_keys": 0.55, "engine": 0.5, "provider": 0.45, "candidate": 0.7}
DEFAULT_PRIORITY = 0.4
#: Bonus of the two strongest areas, in sorted order.
PAIR_BONUS = {("language_listening", "visual_diagnostic"): 0.2, ("epidemiology", "visual_diagnostic"): 0.15, ("case_context", "language_listening"): 0.1}
#: Actions (category, label) by domain.
ACTIONS = {
    "imaging_led": [("confirmation_test", "repeat targeted imaging review"), ("multimodal_reconciliation", "correlate imaging with structured report findings")],
    "language_led": [("disambiguation_test", "reassess symptom chronology"), ("disambiguation_test", "clarify narrative inconsistencies")],
    "epidemiology_led": [("confirmation_test", "review exposure history"), ("disambiguation_test", "check prevalence-guided differential filters")],
    "mismatch_resolution_led": [("multimodal_reconciliation", "cross-check modality agreement"), ("multimodal_reconciliation", "request multimodal reconciliation review")],
}
MORE_EVIDENCE = ("confirmation_test", "expand corroborating evidence")


def _lookup(table: dict[str, float], key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(DEFAULT_PRIORITY))


def evidence_weight(source: Column, kind: Column, grounding: Column) -> Column:
    return r3(F.coalesce(grounding, F.lit(0.5)) + _lookup(SOURCE_PRIORITY, F.coalesce(source, F.lit("unknown"))) + _lookup(KIND_PRIORITY, F.coalesce(kind, F.lit("signal"))))


def retrieved(query: Column) -> Column:
    """The three evidence rows of a query."""

    head = F.substring(query, 1, 40)
    items = [
        ("semantic_memory", "summary", F.substring(query, 1, 120), 0.78), ("episodic_memory", "analogy", F.concat(F.lit("analogy_for:"), head), 0.64),
        ("knowledge_graph", "relation", F.concat(F.lit("kg_link_for:"), head), 0.7),
    ]
    fixed = F.array(*(F.struct(F.lit(s).alias("source"), F.lit(k).alias("kind"), v.alias("value"), F.lit(g).alias("grounding_score")) for s, k, v, g in items))
    # The focus reads the whole text, so it is found once and shared by the rows.
    shared = F.transform(F.array(focus(query)), lambda at: F.transform(fixed, lambda x: x.withField("focus", at)))
    return F.element_at(shared, 1)


def ranked(evidence: Column) -> Column:
    """Evidence by falling weight, ties in the given order: array of (weight, pos, item)."""
    weighed = F.transform(evidence, lambda e, i: F.struct((-evidence_weight(e["source"], e["kind"], e["grounding_score"])).alias("neg"), i.alias("pos"), e.alias("item")))
    return F.transform(F.array_sort(weighed), lambda x, i: F.struct((i + 1).alias("rank"), (-x["neg"]).alias("weight"), x["item"].alias("item")))


def counterfactual(mismatch: Column, exposed: Column, text: Column) -> Column:
    at = F.when(mismatch > 0.6, "cross_area_alignment").when(exposed, "epidemiology").when(text, "language_listening").otherwise("context")
    more = F.when(at == "epidemiology", "exposure_shift").when(at == "language_listening", "narrative_reframing").when(at == "cross_area_alignment", "multimodal_reconciliation")
    plan = F.array_compact(F.array(F.lit("context_recombination"), more))
    return F.struct(at.alias("variant_focus"), plan.alias("plan"), r3(F.lit(0.2) * F.size(plan)).alias("novelty_score"))


def with_replay(df: DataFrame) -> DataFrame:
    """Add ``dream`` to rows of case_id, exposures, report_text, patient_complaints, replay_coherence, replay_risk, pairs and metrics."""
    c = F.col
    text = present(c("report_text")) | present(c("patient_complaints"))
    df = df.withColumns({"_f": replay_filter(c("replay_coherence"), c("replay_risk")), "_s": counterfactual(c("mismatch_score"), c("exposures"), text)})
    risk, mismatch, revision = c("replay_risk"), c("mismatch_score"), c("metrics.revision_pressure")
    accepted = c("_f.accepted")
    rehearse = ~accepted | (risk > 0.2) | (mismatch > 0.6) | (revision > 0.55)
    boundary = (c("replay_coherence") < 0.95) & (risk <= 0.15)

    def alternative(k: int, kind: Column, at: Column) -> Column:
        return F.struct(F.concat(c("case_id"), F.lit(f"_alt_{k}")).alias("label"), kind.alias("kind"), at.alias("focus"))

    alternatives = F.array_compact(F.array(
        alternative(1, F.when(accepted, "rare_case").otherwise("adjacent_case"), F.when(c("exposures"), F.lit("epidemiology")).otherwise(c("_s.variant_focus"))),
        alternative(2, F.when(boundary, "boundary_case").otherwise("counterfactual_case"), F.when(text, F.lit("language_listening")).otherwise(c("_s.variant_focus"))),
        F.when(rehearse, alternative(3, F.lit("contradiction_revision"), F.lit("multi_area_recheck"))),
        F.when((mismatch > 0.6) | (revision > 0.6), alternative(4, F.lit("mismatch_resolution"), F.lit("cross_area_alignment"))),
    ))
    m = lambda n: c(f"metrics.{n}")
    evolve = accepted & (m("pi_score") >= 0.55) & (m("convergence_index") >= 0.45) & (risk <= 0.25) & (m("dream_plasticity") >= 0.35)
    zero = F.lit(0.0)  # the metrics lie one level deeper than the belief update looks
    return df.withColumn("dream", F.struct(
        accepted.alias("accepted"), c("_f.replay_mode").alias("replay_mode"), c("_f.acceptance_score").alias("acceptance_score"), c("_s.variant_focus").alias("variant_focus"),
        boundary.alias("boundary"), rehearse.alias("rehearsal"), F.when((risk > 0.15) | (mismatch > 0.4) | (revision > 0.5), "conservative").otherwise("exploratory").alias("revision_bias"),
        F.when(rehearse, "re-rank_alternatives").otherwise("stabilize_primary").alias("adjustment"),
        F.exists("pairs", lambda p: p["coherent"]).alias("multimodal"), alternatives.alias("alternatives"),
        F.when(evolve, "candidate").otherwise("hold_for_more_evidence").alias("evolution"),
        r3(m("pi_score") * 0.35 + m("convergence_index") * 0.3 + m("dream_plasticity") * 0.2 - risk * 0.15).alias("evolution_score"),
        belief(F.lit(1), F.lit(6), zero, zero, zero, zero).alias("belief"),
    )).drop("_f", "_s")


def with_intuition(df: DataFrame) -> DataFrame:
    """Add ``intuition`` to rows of ``with_replay`` with ``evidence`` (ranked)."""
    c = F.col
    m = lambda n: c(f"metrics.{n}")
    weighed = F.array_sort(F.transform("areas", lambda x, i: F.struct((-(x["fields"] + x["n"] + x["salience"] - x["uncertainty"])).alias("neg"), i.alias("pos"), x["area"].alias("area"))))
    df = df.withColumn("_top", F.slice(weighed, 1, 2))
    one, two = -F.element_at("_top", 1)["neg"], F.coalesce(-F.try_element_at("_top", F.lit(2))["neg"], F.lit(0.0))
    df = df.withColumns({"_conv": r3(two / F.greatest(one, F.lit(1.0))), "_conf": r3((one - two) / F.greatest(one, F.lit(1.0))), "_names": F.transform("_top", lambda x: x["area"])})
    pair = F.concat_ws("|", F.array_sort("_names"))
    bonus = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, v in PAIR_BONUS.items() for x in ("|".join(k), v))), pair), F.lit(0.0))
    df = df.withColumns({
        "_bonus": r3(bonus + 0.08 * c("coherence_score") + 0.12 * m("pi_score") + m("convergence_index") * 0.18),
        "_penalty": r3(F.greatest(c("_conf") - 0.4, F.lit(0.0)) + c("mismatch_score") * 0.08 + m("prediction_error") * 0.18 + m("mismatch_index") * 0.22 - m("inhibitory_control") * 0.1),
    })
    weight = lambda k: F.coalesce(F.try_element_at("evidence", F.lit(k))["weight"], F.lit(0.0))
    rapid = r3((weight(1) + c("_bonus") + c("_conv") + m("deductive_gate") + m("bias_suppression_score") * 0.18 + m("pi_score") * 0.2 - c("_penalty")) * m("intuition_gain") / F.greatest(m("candidate_temperature"), F.lit(0.35)))
    rational = r3(
        weight(2) + c("_conf") + F.when(c("dream.revision_bias") == "conservative", 0.2).otherwise(0.0) + c("mismatch_score") * 0.08
        + m("revision_pressure") * 0.25 + m("precision_weighted_coherence") * 0.12 + m("deductive_gate") * 0.15
    )
    contradiction = r3(
        F.when(c("dream.rehearsal"), 1.0).otherwise(0.0) + F.when(c("dream.adjustment") == "re-rank_alternatives", 0.3).otherwise(0.0) + 0.1 * F.size("dream.alternatives")
        + c("mismatch_score") * 0.18 + m("prediction_error") * 0.3 + m("mismatch_index") * 0.25 + m("dream_plasticity") * 0.2
    )
    label = lambda k: F.lit(f"candidate_{k}")
    none = F.size("evidence") == 0
    first = F.when(none, "no_candidate").otherwise(label(1))
    second = F.when(F.size("evidence") > 1, label(2)).otherwise(first)
    third = F.coalesce(F.try_element_at("dream.alternatives", F.lit(1))["label"], second)
    scores = F.array(*(F.struct((-s).alias("neg"), F.lit(i).alias("pos"), F.lit(n).alias("mode"), l.alias("label")) for i, (n, l, s) in enumerate(
        [("rapid_intuition", first, rapid), ("rational_revision", second, rational), ("contradiction_revision", third, contradiction)])))
    df = df.withColumn("_best", F.element_at(F.array_sort(scores), 1))
    update = belief(F.lit(2), F.lit(23), m("pi_score"), m("precision_weighted_coherence"), m("prediction_error"), m("conflict_load"))
    return df.withColumn("intuition", F.struct(
        c("_best.mode").alias("mode"), c("_best.label").alias("label"), (-c("_best.neg")).alias("score"), rapid.alias("rapid"), rational.alias("rational"), contradiction.alias("contradiction"),
        c("_names").alias("top_areas"), c("_conv").alias("convergence"), c("_conf").alias("conflict"), c("_bonus").alias("bonus"), c("_penalty").alias("penalty"), update.alias("belief"),
    )).drop("_top", "_conv", "_conf", "_names", "_bonus", "_penalty", "_best")


def with_support(df: DataFrame) -> DataFrame:
    """Add ``support`` and ``contradiction``: arrays of (label, class, strength), with their sums.

    ``signals`` is the array of (source, kind) that speaks for the case.
    """

    def profile(label: Column, kind: str, strength: float) -> Column:
        return F.struct(label.alias("label"), F.lit(kind).alias("class"), F.lit(strength).alias("strength"))

    name = lambda p: F.concat(F.lit("pair:"), p["a"], F.lit("-"), p["b"])
    none = F.array().cast("array<struct<label:string,class:string,strength:double>>")
    c = F.col
    grounded = F.transform(F.filter("signals", lambda e: e["source"].isin("bundle", "retrieval", "fusion", "service")), lambda e: profile(F.concat_ws(":", e["source"], e["kind"]), "grounded_support", 0.2))
    good, bad = F.filter("pairs", lambda p: p["coherent"]), F.filter("pairs", lambda p: ~p["coherent"])
    support = F.concat(
        grounded, F.when(c("coherence_score") > 0.4, F.transform(F.slice(good, 1, 2), lambda p: profile(name(p), "multimodal_support", 0.3))).otherwise(none),
        F.when(c("dream.multimodal"), F.array(profile(F.lit("dream:multimodal_support"), "replay_supported_alignment", 0.25))).otherwise(none),
    )
    mismatch = c("mismatch_score")
    torn = F.exists("signals", lambda e: e["source"] == "intuition") & (c("intuition.mode") == "contradiction_revision")
    contradiction = F.concat(
        F.when(torn, F.array(profile(F.lit("intuition:contradiction_revision"), "useful_contradiction", 0.4))).otherwise(none),
        F.when(mismatch > 0.6, F.concat(F.array(profile(F.lit("areas:high_mismatch"), "useful_contradiction", 0.5)), F.transform(F.slice(bad, 1, 2), lambda p: profile(name(p), "useful_contradiction", 0.35))))
        .when(mismatch > 0.3, F.array(profile(F.lit("areas:moderate_mismatch"), "weak_contradiction", 0.2)))
        .when(F.size(bad) > 0, F.array(profile(F.lit("areas:low_conflict"), "spurious_conflict", 0.1))).otherwise(none),
        F.when(c("dream.boundary"), F.array(profile(F.lit("dream:boundary_case"), "weak_contradiction", 0.15))).otherwise(none),
    )
    total = lambda n: r3(F.aggregate(n, F.lit(0.0), lambda s, p: s + p["strength"]))
    df = df.withColumns({"support": support, "contradiction": contradiction})
    return df.withColumns({"support_strength": total("support"), "contradiction_strength": total("contradiction")})


def distinct_classes(profiles: str) -> Column:
    """The classes that occur among profiles, sorted."""
    return F.array_sort(F.array_distinct(F.transform(profiles, lambda p: p["class"])))


def domain(signals: Column, source: Column, kind: Column) -> Column:
    joined = F.array_join(signals, " ")
    led = joined.contains("fusion:") | joined.contains("visual_diagnostic") | source.isin("mismatch_resolution", "contradiction_revision")
    return (
        F.when(led, "imaging_led").when(joined.contains("dream:language_listening"), "language_led").when(joined.contains("dream:epidemiology"), "epidemiology_led")
        .when(kind == "mismatch_resolution", "mismatch_resolution_led").otherwise("multimodal_led")
    )


def _action(pair: tuple[str, str]) -> Column:
    return F.struct(F.lit(pair[0]).alias("category"), F.lit(pair[1]).alias("label"))


def domain_actions(of: Column) -> Column:
    """The actions (category, label) that a domain calls for."""
    found = F
    for name, actions in ACTIONS.items():
        found = found.when(of == name, F.array(*map(_action, actions)))
    return found.otherwise(F.array(_action(MORE_EVIDENCE)))


def with_differential(df: DataFrame) -> DataFrame:
    """Add ``hypotheses`` (first the primary one) and ``actions`` to rows of ``with_support``."""
    c = F.col
    labels = F.transform("support", lambda p: p["label"])
    mode = c("intuition.mode")
    kind = F.when(mode == "rational_revision", "revision_hypothesis").when(mode == "contradiction_revision", "contradiction_revision_hypothesis").otherwise("primary_hypothesis")
    df = df.withColumn("_domain", domain(F.slice(labels, 1, 4), F.lit("intuition_engine"), kind))
    n = F.size("signals")
    primary = F.struct(
        c("intuition.label").alias("label"), kind.alias("kind"), c("_domain").alias("domain"),
        r3(c("intuition.score") + c("coherence_score") * 0.1 + c("support_strength") * 0.02).alias("score"), n.alias("support"),
    )

    def alternative(x: Column, i: Column) -> Column:
        own = F.when(x["kind"] == "mismatch_resolution", "mismatch_resolution").when(x["kind"] == "contradiction_revision", "contradiction_revision_alternative").otherwise("revision_alternative")
        spoken = F.concat(F.array(F.concat(F.lit("dream:"), x["focus"])), F.slice(labels, 1, 1))
        return F.struct(
            x["label"].alias("label"), own.alias("kind"), domain(spoken, x["kind"], own).alias("domain"),
            r3(0.4 + c("mismatch_score") * 0.1 - i * 0.05 + c("contradiction_strength") * 0.01).alias("score"), F.greatest(n - i - 1, F.lit(0)).alias("support"),
        )

    fallback = F.array(F.struct(
        F.lit("alternative_hypothesis").alias("label"), F.lit("fallback_alternative").alias("kind"), F.lit("multimodal_led").alias("domain"),
        r3(0.3 + c("mismatch_score") * 0.05).alias("score"), F.greatest(n - 1, F.lit(0)).alias("support"),
    ))
    others = F.when(F.size("dream.alternatives") > 0, F.transform(F.slice("dream.alternatives", 1, 3), alternative)).otherwise(fallback)
    none = F.array().cast("array<struct<category:string,label:string>>")
    has = lambda k: F.exists("contradiction", lambda p: p["class"] == k)
    more = [
        (has("useful_contradiction"), ("multimodal_reconciliation", "recheck multimodal alignment")), (c("coherence_score") < 0.5, MORE_EVIDENCE),
        (mode == "contradiction_revision", ("disambiguation_test", "review alternative hypotheses")), (has("weak_contradiction"), ("disambiguation_test", "monitor boundary conditions")),
    ]
    actions = F.array_distinct(F.concat(domain_actions(c("_domain")), *(F.when(w, F.array(_action(a))).otherwise(none) for w, a in more)))
    return df.withColumns({"hypotheses": F.concat(F.array(primary), others), "actions": actions}).drop("_domain")


def with_critique(df: DataFrame) -> DataFrame:
    """Add ``critique``: warnings, suggestions and actions with priorities."""
    c = F.col
    has = lambda k: F.exists("contradiction", lambda p: p["class"] == k)
    mismatch, mode, escalate = c("mismatch_score") > 0.5, c("intuition.mode") == "contradiction_revision", c("policy.escalate")
    warnings = reasons(
        (mismatch, "high_cross_area_mismatch"), (mode, "contradiction_revision_active"), (c("dream.boundary"), "boundary_case_review"),
        (has("useful_contradiction"), "useful_contradiction_detected"), (has("spurious_conflict"), "possible_spurious_conflict"),
    )
    suggestions = reasons((mismatch | has("useful_contradiction"), "recheck multimodal consistency"), (escalate, "escalate to expert review"), (has("spurious_conflict"), "down-weight low-value conflicts"))
    suggestions = F.when(F.size(suggestions) > 0, suggestions).otherwise(F.array(F.lit("proceed with monitored interpretation")))

    def prioritised(a: Column) -> Column:
        high = escalate | ((a["category"] == "multimodal_reconciliation") & mismatch) | ((a["category"] == "disambiguation_test") & mode)
        return F.struct(a["category"].alias("category"), a["label"].alias("label"), F.when(high, "high").otherwise("medium").alias("priority"))

    return df.withColumn("critique", F.struct(warnings.alias("warnings"), suggestions.alias("suggestions"), F.transform("actions", prioritised).alias("actions")))


def with_decision(df: DataFrame) -> DataFrame:
    """Add ``decision`` and ``result_label``."""
    c = F.col
    df = df.withColumn("decision", decide(c("metrics.pi_score"), c("metrics.mismatch_index"), c("uncertainty"), c("policy.abstain"), c("policy.escalate")))
    return df.withColumn("result_label", F.when(c("decision.allow"), F.element_at("hypotheses", 1)["label"]).otherwise("abstain_or_escalate"))


def case_evidence(df: DataFrame) -> DataFrame:
    """Add ``evidence`` (ranked retrieval) and ``signals`` (all that speaks for a case)."""
    query = first_present(F.col("report_text"), F.col("ehr_text"), F.col("case_id"))
    fixed = [("bundle", "bundle_keys"), ("retrieval", "grounded_retrieval_ready"), ("fusion", "engine"), ("service", "provider"), ("intuition", "candidate")]
    own = F.array(*(F.struct(F.lit(s).alias("source"), F.lit(k).alias("kind")) for s, k in fixed))
    df = df.withColumn("evidence", ranked(retrieved(query)))
    # A ranked row wraps its item, so its own source and kind are unknown.
    wrapped = F.transform("evidence", lambda e: F.struct(F.lit("unknown").alias("source"), F.lit("signal").alias("kind")))
    return df.withColumn("signals", F.concat(own, wrapped))


def run_cases(cases: DataFrame) -> DataFrame:
    """All stages over cases with ``areas``; see ``plans.cases``."""
    from .areas import with_metrics, with_pairs

    out = case_evidence(with_metrics(with_pairs(cases)))
    out = with_differential(with_support(with_intuition(with_replay(out))))
    return with_decision(with_critique(policy_stack(out)))


def run_refined(cases: DataFrame, provider: Column, risk: Column | None = None, uncertainty: Column | None = None, score: Column | None = None, coherence: Column | None = None, replay_risk: Column | None = None) -> DataFrame:
    """The smaller pipeline: evidence as texts, no areas; policy, context gate and replay of ``cases``.

    The measures are columns, so every branch can be reached; their defaults are those of the fixed pipeline.
    """

    def known(x: Column | None, default: float) -> Column:
        return F.lit(default) if x is None else x

    evidence = F.array(F.lit("bundle:patient,diagnostic_report"), F.lit("retrieval:grounded_retrieval_ready"), F.concat(F.lit("service:"), F.coalesce(provider, F.lit("none"))))
    out = policy_stack(cases.withColumns({"evidence": evidence, "risk": known(risk, 0.2), "uncertainty": known(uncertainty, 0.1)}))
    return out.withColumns({"context": context_gate(known(score, 0.7)), "replay": replay_filter(known(coherence, 0.9), known(replay_risk, 0.1))})

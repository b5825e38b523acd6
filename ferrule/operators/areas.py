"""Area signals, pairs of areas, and the metrics derived from them.

A case carries an array of areas; pairs are enumerated inside the row by
higher-order functions, so no stage of a case shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp, r3

#: Pairs of areas (in sorted order) that cohere, with their weights: excitatory, inhibitory,
#: expected precision, mismatch sensitivity. All other pairs are mismatches with the generic weights.
PAIRS = {
    ("language_listening", "visual_diagnostic"): (0.22, 0.08, 0.85, 0.75),
    ("epidemiology", "visual_diagnostic"): (0.16, 0.06, 0.72, 0.65),
    ("case_context", "language_listening"): (0.14, 0.05, 0.78, 0.55),
    ("case_context", "epidemiology"): (0.12, 0.05, 0.7, 0.5),
    ("case_context", "visual_diagnostic"): (0.09, 0.04, 0.62, 0.52),
}
GENERIC = (0.05, 0.05, 0.5, 0.5)
#: With the repair flag, the pair whose stored order otherwise hides it.
REPAIRED = {("epidemiology", "language_listening"): (0.1, 0.04, 0.64, 0.48)}
#: Fixed values: (focus, salience of one stream, fields of the area's record) by area.
AREAS = {
    "visual_diagnostic": ("imaging_led", 0.2, 9),
    "language_listening": ("language_led", 0.15, 8),
    "case_context": ("multimodal_context", 0.1, 6),
    "epidemiology": ("epidemiology_led", 0.18, 8),
}
_WEIGHTS = ("exc", "inh", "prec", "sens")


def streams(**flags: Column) -> Column:
    """Names of the streams that are present, in order."""
    return F.array_compact(F.array(*(F.when(flag, F.lit(name)) for name, flag in flags.items())))


def area(name: str, count: Column, uncertainty: Column | None = None) -> Column:
    focus, weight, fields = AREAS.get(name, (name, 0.25, 4))
    salience = r3(F.lit(weight) * count)
    return F.struct(
        F.lit(name).alias("area"), F.lit(focus).alias("focus"), F.lit(fields).alias("fields"), count.cast("int").alias("n"), salience.alias("salience"),
        F.coalesce(uncertainty if uncertainty is not None else F.lit(None).cast("double"), 1.0 - F.least(salience, F.lit(1.0))).alias("uncertainty"),
    )


def specialist_signal(confidence: Column, uncertainty: Column, signals: Column) -> Column:
    """A specialist's response as an area signal."""
    return F.struct(r3(clamp(confidence)).alias("salience_score"), r3(clamp(uncertainty)).alias("uncertainty_score"), F.size(signals).alias("signal_count"))


def _weights(a: Column, b: Column, strict: bool) -> Column:
    known = PAIRS if strict else PAIRS | REPAIRED

    def pack(w: tuple) -> Column:
        return F.struct(*(F.lit(x).alias(n) for x, n in zip(w, _WEIGHTS)))

    table = F.create_map(*(x for pair, w in known.items() for x in (F.lit("|".join(pair)), pack(w))))
    return F.try_element_at(table, F.concat_ws("|", a, b))


def with_pairs(df: DataFrame, strict: bool = True) -> DataFrame:
    """Add pairs (a < b, each once) of ``areas``, with coherence_score, mismatch_score and total_salience."""
    ordered = F.array_sort("areas")

    def pair(x: Column, y: Column) -> Column:
        w = _weights(x["area"], y["area"], strict)
        generic = F.struct(*(F.lit(v).alias(n) for v, n in zip(GENERIC, _WEIGHTS)))
        return F.struct(
            x["area"].alias("a"), y["area"].alias("b"), w.isNotNull().alias("coherent"), r3(x["salience"] + y["salience"]).alias("salience"),
            (x["n"] + y["n"]).alias("n"), (x["focus"] == y["focus"]).alias("aligned"), F.coalesce(w, generic).alias("w"),
        )

    df = df.withColumn("_areas", ordered)
    pairs = F.flatten(F.transform("_areas", lambda x, i: F.transform(F.filter("_areas", lambda y, j: j > i), lambda y: pair(x, y))))
    df = df.withColumn("pairs", pairs)
    total = F.aggregate("areas", F.lit(0.0), lambda s, x: s + x["salience"])
    n = F.greatest(F.size("areas"), F.lit(1))
    good = F.size(F.filter("pairs", lambda p: p["coherent"]))
    return df.withColumns({
        "total_salience": total, "coherence_score": r3(good / n + total * 0.05), "mismatch_score": r3((F.size("pairs") - good) / n),
    }).drop("_areas")


def couplings(pairs: Column, total_salience: Column) -> Column:
    """For every pair its coupling score: how strongly two areas that cohere drive each other, or how weakly others do."""

    def score(p: Column) -> Column:
        share = clamp(p["salience"] / F.greatest(total_salience + 1.0, F.lit(1.0)))
        return clamp(F.when(p["coherent"], share + p["w"]["exc"] + p["w"]["prec"] * 0.1).otherwise(share - p["w"]["sens"] * 0.2))

    return F.transform(pairs, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.when(p["coherent"], "coherent").otherwise("mismatch").alias("status"), r3(score(p)).alias("coupling_score")))


def with_metrics(df: DataFrame, dream_pressure: float = 0.0) -> DataFrame:
    """Add the struct ``metrics`` to rows of ``with_pairs``."""

    def total(value, start: float | int = 0.0) -> Column:
        return F.aggregate("pairs", F.lit(start), lambda s, p: s + value(p))

    share = lambda p: clamp(p["salience"] / F.greatest(F.col("total_salience") + 1.0, F.lit(1.0)))
    when = lambda p, x, y: F.when(p["coherent"], x).otherwise(y)
    zero = F.lit(0.0)
    precision = lambda x: clamp(x["salience"] / F.greatest(x["salience"] + x["uncertainty"] + 0.001, F.lit(0.001)))
    s = df.withColumns({
        "_good": total(lambda p: when(p, p["salience"] * (1.0 + p["w"]["exc"]), zero)),
        "_bad": total(lambda p: when(p, zero, p["salience"] * (1.0 + p["w"]["sens"]))),
        "_good_n": total(lambda p: when(p, p["n"], F.lit(0)), 0),
        "_bad_n": total(lambda p: when(p, F.lit(0), p["n"]), 0),
        "_exc": total(lambda p: when(p, p["w"]["exc"] * share(p), zero)),
        "_inh": total(lambda p: when(p, zero, p["w"]["inh"] * share(p))),
        "_prec": total(lambda p: p["w"]["prec"] * share(p)),
        "_sens": total(lambda p: p["w"]["sens"] * share(p)),
        "_mean": F.aggregate("areas", zero, lambda a, x: a + precision(x)) / F.greatest(F.size("areas"), F.lit(1)),
    })
    c = F.col
    s = s.withColumn("_all", F.greatest(c("_good") + c("_bad"), F.lit(1e-6)))
    s = s.withColumns({
        "_sync": c("_good") / c("_all"), "_ratio": c("_bad") / c("_all"),
        "_signal": c("total_salience") / F.greatest(c("total_salience") + c("_bad_n") + 1.0, F.lit(1.0)),
        "_prior": c("_prec") / F.greatest(c("_prec") + c("_sens") + 1e-6, F.lit(1e-6)),
    })
    s = s.withColumns({
        "_pwc": c("coherence_score") * (0.6 + c("_signal") + c("_mean") * 0.25),
        "_error": c("mismatch_score") * (0.4 + c("_ratio") + c("_sens") * 0.15),
    })
    s = s.withColumn("_load", c("_error") + c("_bad_n") / F.greatest(c("_good_n") + c("_bad_n"), F.lit(1)) * 0.35)
    s = s.withColumns({
        "_conv": clamp(c("coherence_score") * 0.35 + c("_sync") * 0.25 + c("_signal") * 0.2 + c("_prior") * 0.15 + c("_exc") * 0.25),
        "_mis": clamp(c("_error") * 0.45 + c("_ratio") * 0.25 + c("_load") * 0.2 + c("_inh") * 0.2),
        "_ctl": clamp(1.0 - c("_load") * 0.55 + c("_signal") * 0.25 + c("_mean") * 0.1),
    })
    s = s.withColumns({
        "_gate": clamp(c("_pwc") * 0.35 + c("_conv") * 0.3 + c("_ctl") * 0.2 + c("_sync") * 0.25 - c("_error") * 0.35),
        "_rev": clamp(c("_error") * 0.45 + c("_load") * 0.35 + F.lit(dream_pressure) * 0.2 + c("_mis") * 0.2),
    })
    s = s.withColumn("_plas", clamp(0.35 + c("_rev") * 0.4 + (1.0 - c("_ctl")) * 0.15))
    s = s.withColumn("_pi", clamp(c("_pwc") * 0.35 + c("_conv") * 0.25 + c("_ctl") * 0.18 + c("_signal") * 0.12 - c("_error") * 0.22 - c("_mis") * 0.18 + c("_plas") * 0.04))
    out = {
        "pi_score": c("_pi"), "precision_weighted_coherence": clamp(c("_pwc")), "prediction_error": clamp(c("_error")), "cross_area_synchrony": clamp(c("_sync")),
        "mismatch_ratio": clamp(c("_ratio")), "signal_precision": clamp(c("_signal")), "prior_precision": clamp(c("_prior")), "conflict_load": clamp(c("_load")),
        "convergence_index": c("_conv"), "mismatch_index": c("_mis"), "inhibitory_control": c("_ctl"), "deductive_gate": c("_gate"), "revision_pressure": c("_rev"),
        "dream_plasticity": c("_plas"), "intuition_gain": clamp(1.0 + c("_gate") * 0.25 - c("_rev") * 0.15 + c("_conv") * 0.1, 0.5, 1.35),
        "bias_suppression_score": clamp(c("_ctl") * 0.65 + c("_signal") * 0.2 + c("_prior") * 0.15 - c("_mis") * 0.15),
        "candidate_temperature": clamp(1.0 - c("_gate") * 0.25 + c("_rev") * 0.35, 0.35, 1.5),
        "belief_update_rate": clamp(c("_pi") * 0.45 + c("_plas") * 0.25 + c("_conv") * 0.2 - c("_load") * 0.2),
    }
    s = s.withColumn("metrics", F.struct(*(r3(x).alias(n) for n, x in out.items())))
    return s.drop(*(n for n in s.columns if n.startswith("_")))


def belief(prior_size: Column, context_size: Column, pi: Column, pwc: Column, error: Column, load: Column) -> Column:
    """A belief update from the sizes of prior and context and four metrics."""
    context = r3(0.5 * F.greatest(context_size, F.lit(1)) / F.greatest(prior_size + context_size, F.lit(1)))
    interference = r3(0.5 * F.greatest(context_size - prior_size, F.lit(0)) / F.greatest(context_size, F.lit(1)))
    precision = r3(clamp(pi * 0.35 + pwc * 0.15))
    conflict = r3(clamp(error * 0.25 + load * 0.15))
    return F.struct(
        context.alias("contextuality_score"), interference.alias("interference_score"), precision.alias("precision_modulation"), conflict.alias("conflict_modulation"),
        r3(clamp(context + interference + precision - conflict)).alias("belief_shift"), r3(clamp(1.0 - conflict + precision * 0.5)).alias("belief_stability"),
    )

"""Calibration, benchmark and prospective reducers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, normal_label


def calibration_bins(records: DataFrame, bins: int = 10) -> DataFrame:
    """One row a bin, empty ones too, for records of confidence and correct (0 or 1).

    Sums are kept in exact decimals, so results do not hang on the order of rows.
    """
    c = clamp(F.col("confidence"))
    rows = records.select(c.alias("c"), F.col("correct").cast("int").alias("y"), F.least(F.floor(c * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    exact = F.col("c").cast("decimal(20,12)")
    found = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum(exact).cast("double").alias("sc"), F.sum("y").alias("sy"), F.sum(((F.col("c") - F.col("y")) * (F.col("c") - F.col("y"))).cast("decimal(20,12)")).cast("double").alias("sq"))
    every = records.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    joined = every.join(F.broadcast(found), "bin", "left")  # one row a bin at most
    n = F.coalesce("n", F.lit(0))
    confidence, accuracy = F.coalesce(F.col("sc") / F.col("n"), F.lit(0.0)), F.coalesce(F.col("sy") / F.col("n"), F.lit(0.0))
    return joined.select(
        "bin", (F.col("bin") / bins).alias("lower"), ((F.col("bin") + 1) / bins).alias("upper"), n.alias("n"), confidence.alias("confidence"),
        accuracy.alias("accuracy"), F.abs(confidence - accuracy).alias("gap"), F.coalesce("sq", F.lit(0.0)).alias("square_sum"),
    )


def scored_records(rows: DataFrame, confidence: str = "confidence", score: str = "score") -> DataFrame:
    """Records of confidence (else score; what is no number counts as 0) and correct."""
    value = lambda c: F.expr(f"try_cast(`{c}` as double)")
    given = F.when(F.col(confidence).isNotNull(), value(confidence)).otherwise(value(score))
    return rows.select(F.coalesce(given, F.lit(0.0)).alias("confidence"), F.coalesce("correct", F.lit(False)).cast("int").alias("correct"))


def rounded_bins(bins: DataFrame) -> DataFrame:
    """Bins as they are reported: every measure to four digits."""
    return bins.select("bin", "n", *(F.round(c, 4).alias(c) for c in ("lower", "upper", "confidence", "accuracy", "gap")))


def benchmark_run(records: DataFrame, predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of a benchmark whose results come from ``predict``, which adds result_label, top_label, top_score and pi_score."""
    return benchmark_rows(predict(records))


def calibration_summary(bins: DataFrame) -> DataFrame:
    n = F.sum("n")
    safe = F.greatest(n, F.lit(1))
    return bins.agg(
        n.alias("n"), F.round(F.sum((F.col("n") * F.col("gap")).cast("decimal(28,12)")).cast("double") / safe, 6).alias("ece"),
        F.round(F.max(F.when(F.col("n") > 0, F.col("gap")).otherwise(0.0)), 6).alias("mce"), F.round(F.sum(F.col("square_sum").cast("decimal(28,12)")).cast("double") / safe, 6).alias("brier"),
    )


def risk_coverage(bins: DataFrame) -> DataFrame:
    """For every bin that holds records: what answering from its lower bound on would cover, and the accuracy and risk of it.

    The bins' few rows are summed up from the most confident one on, so records are never sorted.
    """
    down = Window.orderBy(F.col("bin").desc())
    n, right = F.sum("n").over(down), F.sum(F.round(F.col("accuracy") * F.col("n")).cast("long")).over(down)
    total = F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = bins.select("bin", "lower", "n", n.alias("answered"), right.alias("right"), total.alias("total")).where("n > 0")
    share = F.col("right") / F.col("answered")
    return rows.select("bin", F.round("lower", 4).alias("threshold"), F.round(F.col("answered") / F.col("total"), 6).alias("coverage"), F.round(share, 6).alias("retained_accuracy"), F.round(1 - share, 6).alias("risk"))


def suggested_threshold(bins: DataFrame, target: float = 0.8) -> DataFrame:
    least = F.min(F.when((F.col("n") > 0) & (F.col("accuracy") >= target), F.col("lower")))
    return bins.agg(least.alias("threshold")).withColumn("status", F.when(F.col("threshold").isNull(), "no_threshold_suggested").otherwise("threshold_suggested"))


def benchmark_rows(results: DataFrame) -> DataFrame:
    """Add predicted, abstained and correct to rows of result_label, top_label, top_score, pi_score and gold_labels."""
    abstained = F.col("result_label") == "abstain_or_escalate"
    predicted = normal_label(F.when(F.col("result_label").isNotNull() & ~abstained, F.col("result_label")).otherwise(F.coalesce("top_label", F.lit("none"))))
    gold = F.transform("gold_labels", normal_label)
    return results.withColumns({
        "abstained": F.coalesce(abstained, F.lit(False)), "predicted": predicted, "correct": F.array_contains(gold, predicted) & ~F.coalesce(abstained, F.lit(False)),
        "confidence": clamp(F.coalesce(F.expr("try_cast(top_score as double)"), F.expr("try_cast(pi_score as double)"))),
    })


def _report(n: Column) -> list[Column]:
    answered, right = F.count_if(~F.col("abstained")), F.count_if("correct")
    return [
        n.alias("n"), answered.alias("answered"), F.count_if("abstained").alias("abstained"), right.alias("correct"), F.round(right / F.greatest(n, F.lit(1)), 6).alias("top1_accuracy"),
        F.round(answered / F.greatest(n, F.lit(1)), 6).alias("coverage"), F.round(right / F.greatest(answered, F.lit(1)), 6).alias("selective_accuracy"),
    ]


def benchmark_report(rows: DataFrame) -> DataFrame:
    return rows.agg(*_report(F.count(F.lit(1))))


def benchmark_slices(rows: DataFrame, slices: str = "slices") -> DataFrame:
    """The report of every key:value of the slice map; a row counts in each of its slices."""
    own = rows.select(F.explode(slices).alias("k", "v"), "abstained", "correct")
    return own.groupBy(F.concat_ws(":", "k", "v").alias("slice")).agg(*_report(F.count(F.lit(1))))


def attach_outcomes(predictions: DataFrame, outcomes: DataFrame, order: list[str]) -> DataFrame:
    """Every outcome with its status: the first of a known prediction is accepted.

    ``outcomes`` has prediction_id (null ids are dropped); ``order`` gives a total order of arrival.
    """
    # One row an id, by partial aggregation; an id with very many outcomes is never sorted in one task.
    first = outcomes.groupBy("prediction_id").agg(F.min(F.struct(*order)).alias("_first"))
    known = predictions.select("prediction_id").distinct().withColumn("_known", F.lit(True))
    joined = outcomes.join(first.join(known, "prediction_id", "left"), "prediction_id")
    status = F.when(F.col("_known").isNull(), "unknown_prediction_id").when(F.struct(*order) == F.col("_first"), "attached").otherwise("outcome_already_attached")
    return joined.withColumn("status", status).drop("_known", "_first")


def prospective_accuracy(predictions: DataFrame, attached: DataFrame) -> DataFrame:
    """Accuracy over predictions with an outcome; predictions have label, outcomes accepted_labels."""
    own = attached.where("status = 'attached'").select("prediction_id", "accepted_labels")
    joined = predictions.join(own, "prediction_id", "left")
    done = F.col("accepted_labels").isNotNull()
    right = F.count_if(done & F.array_contains(F.transform("accepted_labels", normal_label), normal_label(F.col("label"))))
    return joined.agg(F.count(F.lit(1)).alias("registered"), F.count_if(done).alias("completed"), right.alias("correct"), F.round(right / F.greatest(F.count_if(done), F.lit(1)), 6).alias("accuracy"))

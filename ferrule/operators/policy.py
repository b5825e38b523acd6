"""Threshold policies as columns; thresholds are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import r3, reasons


def abstention(uncertainty: Column, threshold: float = 0.65) -> Column:
    abstain = uncertainty >= threshold
    return F.struct(
        abstain.alias("abstain"), r3(uncertainty - threshold).alias("margin"),
        F.when(uncertainty >= threshold + 0.15, "high").when(abstain, "guarded").otherwise("low").alias("level"),
        reasons((abstain, "uncertainty_above_abstention_threshold")).alias("reasons"),
    )


def should_abstain(uncertainty: Column, threshold: Column | None = None) -> Column:
    """Abstention by a configured threshold (a column; where it is null, the default)."""
    return uncertainty >= F.coalesce(F.lit(None).cast("double") if threshold is None else threshold, F.lit(0.65))


def risk_gate(risk: Column, threshold: float = 0.35) -> Column:
    allow = risk <= threshold
    return F.struct(
        allow.alias("allow"), r3(threshold - risk).alias("margin"),
        F.when(risk > threshold + 0.15, "high").when(~allow, "guarded").otherwise("low").alias("band"),
        reasons((~allow, "risk_above_gate_threshold")).alias("reasons"),
    )


def escalation(risk: Column, uncertainty: Column, max_risk: float = 0.35, max_uncertainty: float = 0.65) -> Column:
    escalate = (risk > max_risk) | (uncertainty > max_uncertainty)
    return F.struct(
        escalate.alias("escalate"),
        F.when((risk > 0.5) | (uncertainty > 0.8), "high").when(escalate, "moderate").otherwise("low").alias("level"),
        reasons((risk > max_risk, "risk_above_threshold"), (uncertainty > max_uncertainty, "uncertainty_above_threshold")).alias("reasons"),
    )


def policy_stack(df: DataFrame, risk: str = "risk", uncertainty: str = "uncertainty") -> DataFrame:
    """Add struct columns abstention, gate, escalation and policy."""
    df = df.withColumns({"abstention": abstention(F.col(uncertainty)), "gate": risk_gate(F.col(risk)), "escalation": escalation(F.col(risk), F.col(uncertainty))})
    blocked = F.col("abstention.abstain") | ~F.col("gate.allow")
    return df.withColumn("policy", F.struct(
        F.col("abstention.abstain").alias("abstain"), F.col("gate.allow").alias("allow"), F.col("escalation.escalate").alias("escalate"),
        F.concat("abstention.reasons", "gate.reasons", "escalation.reasons").alias("reasons"),
        F.when(blocked, "blocked").when(F.col("escalation.escalate"), "guarded").otherwise("clear").alias("band"),
        F.col("escalation.level").alias("level"),
    ))


def context_gate(score: Column, least: float = 0.6) -> Column:
    allow = score >= least
    return F.struct(
        allow.alias("allow"), r3(score - least).alias("margin"),
        F.when(score >= least + 0.2, "high").when(allow, "guarded").otherwise("low").alias("level"),
        F.when(allow, "contextuality_above_quantum_gate_threshold").otherwise("contextuality_below_quantum_gate_threshold").alias("reason"),
    )


def replay_filter(coherence: Column, risk: Column, min_coherence: float = 0.7, max_risk: float = 0.3) -> Column:
    accepted = (coherence >= min_coherence) & (risk <= max_risk)
    near = (coherence < min_coherence + 0.1) | (risk > max_risk - 0.1)
    a, b = r3(coherence - min_coherence), r3(max_risk - risk)
    return F.struct(
        accepted.alias("accepted"), a.alias("coherence_margin"), b.alias("risk_margin"), r3(a + b).alias("acceptance_score"),
        F.when(~accepted, "corrective_replay").when(near, "boundary_replay").otherwise("stabilizing_replay").alias("replay_mode"),
    )


def promotion(pi: Column, error: Column, bias: Column, min_pi: float = 0.55, max_error: float = 0.45, min_bias: float = 0.45) -> Column:
    """Whether a rehearsed candidate is promoted; a missing error counts as 1."""
    pi, error, bias = F.coalesce(pi, F.lit(0.0)), F.coalesce(error, F.lit(1.0)), F.coalesce(bias, F.lit(0.0))
    return (pi >= min_pi) & (error <= max_error) & (bias >= min_bias)


def decide(pi: Column, mismatch: Column, uncertainty: Column, abstain: Column, escalate: Column, min_pi: float = 0.35, max_mismatch: float = 0.7, max_uncertainty: float = 0.75) -> Column:
    """The final decision: allow, abstain, escalate and the reasons."""
    found = reasons(
        (pi < min_pi, "pi_score_below_threshold"), (mismatch > max_mismatch, "mismatch_index_above_threshold"), (uncertainty > max_uncertainty, "uncertainty_above_threshold"),
        (abstain, "policy_abstention_requested"), (escalate, "policy_escalation_requested"),
    )
    return F.struct(
        (F.size(found) == 0).alias("allow"), ((F.size(found) > 0) | abstain).alias("abstain"),
        (escalate | (mismatch > max_mismatch) | (uncertainty > max_uncertainty)).alias("escalate"), found.alias("reasons"),
    )

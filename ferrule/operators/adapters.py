"""Answers that stand for services which are never called, and what became of parsed documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import chunks_sliding, reasons


def _set(x: Column) -> Column:
    """Whether a text is given at all; blanks count as given."""
    return F.coalesce(F.char_length(x) > 0, F.lit(False))


def _on(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def specialist_response(enabled: Column, endpoint: Column) -> Column:
    """A specialist model's answer: a prepared request where one is configured; it never carries confidence."""
    ready = _on(enabled) & _set(endpoint)
    return F.struct(
        F.when(ready, "request_prepared").otherwise("not_called").alias("status"), F.when(ready, "network_call_stub").otherwise("contract_only").alias("mode"),
        F.lit(0.0).alias("confidence"), F.lit(1.0).alias("uncertainty"),
        reasons((~ready, "network_call_not_implemented"), (ready, "actual_inference_adapter_required"), (F.lit(True), "research_use_only")).alias("limitations"),
    )


def imaging_response(enabled: Column, endpoint: Column) -> Column:
    """A remote imaging provider's answer; local features are always needed instead."""
    ready = _on(enabled) & _set(endpoint)
    return F.struct(
        F.when(ready, "request_prepared").otherwise("not_called").alias("status"),
        F.when(ready, "network_call_not_implemented_in_research_stub").otherwise("remote_provider_not_configured").alias("reason"), F.lit(True).alias("fallback_required"),
    )


def live_readiness(enabled: Column, dry_run: Column, endpoint: Column, client: Column, name: str = "weaviate") -> Column:
    """Whether an object store may be written to, and every reason why not."""
    blocked = reasons((~_on(enabled), "adapter_disabled"), (_on(dry_run), "dry_run_enabled"), (~_set(endpoint), "endpoint_missing"), (~_on(client), f"{name}_client_unavailable"))
    return F.struct((F.size(blocked) == 0).alias("ready"), blocked.alias("reasons"))


def parsed_document(text: Column, converted: Column, converted_text: Column, converter: str = "docling") -> Column:
    """A document by the converter where its status is completed, else by its plain text; without one it failed.

    Chunks are the sliding ones of the text that was taken.
    """
    rich = F.coalesce(converted == "completed", F.lit(False))
    taken = F.when(rich, F.coalesce(converted_text, F.lit(""))).otherwise(text)
    return F.struct(
        F.when(taken.isNotNull(), "completed").otherwise("failed").alias("status"), F.when(rich, converter).otherwise("plain_text_fallback").alias("parser"),
        F.when(taken.isNotNull(), F.size(chunks_sliding(taken))).alias("chunk_count"), F.coalesce(converted, F.lit("not_requested")).alias("converter_status"),
    )

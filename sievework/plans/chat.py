"""Everything a chat request needs besides the model: checks, classes, context, and the audit of given answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, masking, rx, text
from ..operators import context, documents
from ..session import cut_lineage
from .retrieve import retrieve_requests


def triage(messages: DataFrame, identity_answer: str = "Evidence assistant.") -> DataFrame:
    """Status, sanitized message, fixed answer, intent and retrieval priority per (message, private_context, namespace)."""
    rows = messages.withColumn("_scan", masking.leak_scan(rx.text_or_empty("message")))
    status = classify.request_status(F.col("message"))
    rows = rows.withColumn(
        "status", F.when(status != "ok", status).when(F.col("_scan.block"), "Sensitive data blocked").otherwise("ok")
    )
    rows = rows.withColumn("message", F.col("_scan.sanitized")).drop("_scan")
    has_private = rx.trim(rx.text_or_empty("private_context")) != ""
    return (
        rows.withColumn("fixed_answer", classify.simple_case(F.col("message"), identity_answer))
        .withColumn("_intent", classify.decode_intent(F.col("message")))
        .withColumn("intent", F.col("_intent.type"))
        .withColumn("maturity", F.col("_intent.maturity"))
        .withColumn("tone", text.tone_for_namespace(F.col("namespace")))
        .withColumn("priority", classify.retrieval_priority(F.col("message"), F.col("intent"), has_private))
        .drop("_intent")
    )


def finish(answers: DataFrame) -> DataFrame:
    """Format answers, strip sensitive fields, add the audit columns. answers: message, context, answer, ..."""
    formatted = text.format_output(answers, "answer", "message")
    cleaned = formatted.withColumn("answer", masking.strip_sensitive(F.col("formatted"))).drop("formatted")
    return documents.audit_row(cleaned)


def answer_contexts(
    messages: DataFrame,
    corpus: DataFrame,
    embed: Callable[[Column], Column],
    *,
    key: str,
    identity_answer: str = "Evidence assistant.",
) -> DataFrame:
    """One row per message with everything a model would be given, or the fixed answer that makes it unnecessary.

    messages: query_id, message, private_context, private_mode, role, namespace. Private mode and private context that
    suffices use no retrieval.
    """
    rows = cut_lineage(triage(messages, identity_answer))
    open_rows = rows.where((F.col("status") == "ok") & F.col("fixed_answer").isNull())
    searching = open_rows.where(~F.coalesce("private_mode", F.lit(False)) & (F.col("priority") != "NONE"))
    requests = searching.select(
        "query_id", F.col("message").alias("query"), "role", "namespace", F.col("namespace").alias("own_namespace")
    )
    _, found = retrieve_requests(requests, corpus, embed, key=key)
    results = found.withColumn("pos", F.col("pack_pos"))
    contexts = context.concat_context(results, open_rows.select("query_id", "message", "private_context"))
    joined = rows.join(contexts, "query_id", "left")
    gate = classify.synthesis_gate(F.col("message"), F.col("context"))
    answer = F.coalesce(F.col("fixed_answer"), F.when(F.col("status") == "ok", gate))
    return joined.withColumn("fixed_answer", answer)

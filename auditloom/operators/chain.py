"""The audit of passages as one chain: sanitise, retrieve, prompt, generate, parse, gate, judge, reconcile, report.

Models are functions made once a worker. Every step is a table; a passage that fails is a row with its error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import query_text, sanitised
from auditloom.operators import findings as A
from auditloom.operators import prompts as P

Provider = Callable[[], Callable[[str], str]]


def prepared(passages: DataFrame, use_title: bool = False) -> DataFrame:
    """Passages (passage_id, title, text) with the clean text, the number of removed instructions and the retrieval query."""
    clean, removed = sanitised(F.col("text"))
    rows = passages.withColumn("n_removed", F.size(removed)).withColumn("text", clean)
    return rows.withColumn("query", query_text(F.col("text"), F.col("title"), use_title))


def audited(
    passages: DataFrame,
    retrieve: Callable[[DataFrame], DataFrame],
    provider: Provider,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
    judge: Provider | None = None,
    reconciler: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None,
    use_title: bool = False,
    min_confidence: float = 0.35,
    min_grounding: float = 0.82,
) -> tuple[DataFrame, DataFrame]:
    """(findings, passages): every finding of the model with its reason for rejection or none, and each passage with its counts and error.

    retrieve: from (query_id, text) to (query_id, rk, clause_id, path, text). keep: writes a table that is read again, so that
    a model is asked and a quote searched for once; the findings do not repeat their passage's text. judge answers {"supported": ...}; a missing or broken verdict keeps a finding and counts as an
    error. reconciler: from open absence claims to verdicts and shown excerpts, see findings.reconciled().
    """
    ready = keep(prepared(passages, use_title))
    shown = keep(retrieve(ready.select(F.col("passage_id").alias("query_id"), F.col("query").alias("text"))))
    context = P.clause_context(shown).withColumnRenamed("query_id", "passage_id")
    asked = ready.join(context, "passage_id", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))
    prompt = P.audit_prompt(F.col("text"), F.coalesce("context", F.lit("")))
    replies = A.generated(asked.select("passage_id", prompt.alias("prompt")), provider, "passage_id")
    parsed = keep(A.parsed(replies.withColumnRenamed("error", "call_error")).drop("raw"))
    items = A.items_of(parsed.select("passage_id", "payload")).where("NOT skipped")
    rows = items.join(asked.select("passage_id", "text", "allowed"), "passage_id").withColumn("finding_id", F.concat_ws("#", "passage_id", "item_no"))
    rows = keep(A.cascade(A.quote_places(rows, least=min_grounding), min_confidence, min_grounding).drop("text"))
    if judge is not None:
        requirement = shown.select(F.col("query_id").alias("passage_id"), F.col("clause_id").alias("_cited"), F.col("text").alias("_clause"))
        open_ = rows.where("reason IS NULL").withColumn("_cited", A.bare_id(F.col("clause_id"))).join(requirement, ["passage_id", "_cited"], "left")
        ask = open_.select("finding_id", P.judge_prompt(F.col("violating_statement"), F.col("source_quote"), F.coalesce("_clause", F.lit(""))).alias("prompt"))
        verdicts = keep(A.parsed(A.generated(ask, judge, "finding_id").withColumnRenamed("error", "call_error")).drop("raw"))
        verdicts = verdicts.select("finding_id", F.get_json_object("payload", "$.supported").cast("boolean").alias("supported"), (F.col("call_error").isNotNull() | F.col("error").isNotNull()).alias("judge_failed"))
        rows = A.judged(rows, verdicts, "finding_id").join(verdicts.select("finding_id", "judge_failed"), "finding_id", "left").withColumn("judge_failed", F.coalesce("judge_failed", F.lit(False)))
    if reconciler is not None:
        claims = rows.where(F.col("reason").isNull() & A.absence_claim(F.col("violating_statement"), F.col("explanation")))
        rows = A.reconciled(rows, *reconciler(claims), "finding_id", min_grounding)
    rows = rows if judge is None and reconciler is None else keep(rows)
    counts = rows.groupBy("passage_id").agg(F.sum(F.col("reason").isNull().cast("long")).alias("kept"), F.sum(F.col("reason").isNotNull().cast("long")).alias("dropped"))
    notice = F.when(F.col("n_removed") > 0, F.format_string("neutralised %d instruction-like span(s)", "n_removed"))
    failed = parsed.select("passage_id", F.coalesce("call_error", "error").alias("_error"))
    report = ready.join(failed, "passage_id", "left").join(counts, "passage_id", "left").na.fill(0, ["kept", "dropped"])
    return rows, report.select("passage_id", "kept", "dropped", F.coalesce("_error", notice).alias("error"))


def document_report(findings: DataFrame, passages: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each document: readiness score, findings, rejected findings, and passages with a real error.

    Both tables have the key; findings also category, severity and reason.
    """
    score = A.readiness(passages, findings.where("reason IS NULL"), key)
    real = F.col("error").isNotNull() & ~F.contains(F.coalesce("error", F.lit("")), F.lit("neutralised"))
    own = passages.groupBy(key).agg(F.count("*").alias("passages"), F.sum("kept").alias("findings"), F.sum("dropped").alias("rejected"), F.sum(real.cast("long")).alias("errors"))
    return own.join(score, key)


def replay(findings: DataFrame, rule: Callable[[DataFrame], DataFrame], key: str = "config") -> DataFrame:
    """(config, before, after): stored findings with reasons, counted before and after a further rule is put to them."""
    before = findings.where("reason IS NULL").groupBy(key).agg(F.count("*").alias("before"))
    after = rule(findings).where("reason IS NULL").groupBy(key).agg(F.count("*").alias("after"))
    return before.join(after, key, "left").na.fill(0, ["after"])


def correction_checked(findings: DataFrame, provider: Provider, key: str = "finding_id") -> DataFrame:
    """(key, compliant, explanation): whether a correction settles its finding, by a model; a failed call counts as compliant and says so."""
    prompt = F.concat(F.lit("Finding:\n"), "violating_statement", F.lit("\n\nQuote:\n"), "source_quote", F.lit("\n\nCorrection:\n"), "suggested_correction", F.lit('\n\nAnswer {"compliant": ..., "explanation": ...}.'))
    replies = A.parsed(A.generated(findings.select(key, prompt.alias("prompt")), provider, key).withColumnRenamed("error", "call_error"))
    said = F.get_json_object("payload", "$.compliant").cast("boolean")
    return replies.select(key, F.coalesce(said, F.lit(True)).alias("compliant"), F.coalesce(F.get_json_object("payload", "$.explanation"), "call_error", "error", F.lit("")).alias("explanation"))

"""Prompts as column expressions, and the presets of an audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import clip_chars, clip_words

#: The rules of each preset: what is retrieved, whether titles join the query, and which guards run.
PRESETS = {
    "v1_retrieval": {"retriever": "v1", "use_title": False, "guards": True, "judge": True, "reconcile": False},
    "v2_no_guards": {"retriever": "v2", "use_title": False, "guards": False, "judge": False, "reconcile": False},
    "v2_full": {"retriever": "v2", "use_title": False, "guards": True, "judge": True, "reconcile": False},
    "v2_title": {"retriever": "v2", "use_title": True, "guards": True, "judge": True, "reconcile": False},
    "v2_reconcile": {"retriever": "v2", "use_title": False, "guards": True, "judge": True, "reconcile": True},
    "v2_context": {"retriever": "v2", "use_title": False, "guards": True, "judge": True, "reconcile": True},
}


def clause_context(ranked: DataFrame, most_words: int = 250) -> DataFrame:
    """(query_id, context, allowed): the clauses (query_id, rk, clause_id, path, text) of each query in rank order, each "[id] path" and its clipped text."""
    shown = F.concat(F.lit("["), "clause_id", F.lit("] "), "path", F.lit("\n"), clip_words(F.col("text"), most_words))
    rows = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rk", "clause_id", shown.alias("shown")))).alias("_c"))
    return rows.select("query_id", F.array_join(F.transform("_c", lambda c: c["shown"]), "\n\n").alias("context"), F.transform("_c", lambda c: c["clause_id"]).alias("allowed"))


def audit_prompt(text: Column, context: Column) -> Column:
    return F.concat(F.lit("Requirements:\n"), context, F.lit("\n\nPassage under audit:\n"), text, F.lit('\n\nAnswer with one JSON object {"findings": [...]}. Quote the passage word for word and cite only ids given above.'))


def judge_prompt(statement: Column, quote: Column, requirement: Column) -> Column:
    return F.concat(F.lit("Requirement:\n"), clip_words(requirement, 150), F.lit("\n\nQuote:\n"), quote, F.lit("\n\nFinding:\n"), statement, F.lit('\n\nAnswer {"supported": true} or {"supported": false}.'))


def reconcile_prompt(statement: Column, excerpts: Column) -> Column:
    return F.concat(F.lit("Finding:\n"), statement, F.lit("\n\nOther sections:\n"), clip_chars(excerpts, 4000), F.lit('\n\nAnswer {"addressed": ..., "passage_id": ..., "quote": ...}.'))

"""Gold labels: the expert map joined to passages, integrity problems as rows, and proposals merged in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: roman numerals of the annexes in order.
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI", "XVII")


def gold_records(passages: DataFrame, section_map: DataFrame) -> DataFrame:
    """(passage_id, section, clause_id, grade, provenance) of passages (passage_id, section) by a map (section, primary, secondary): primary wins."""
    pair = F.concat(F.transform("primary", lambda c: F.struct(c.alias("clause_id"), F.lit(2).alias("grade"))), F.transform("secondary", lambda c: F.struct(c.alias("clause_id"), F.lit(1).alias("grade"))))
    rows = passages.join(section_map, "section").select("passage_id", "section", F.explode(pair).alias("p"))
    return rows.groupBy("passage_id", "section", F.col("p.clause_id").alias("clause_id")).agg(F.max("p.grade").alias("grade")).withColumn("provenance", F.array(F.lit("expert_map")))


def problems(passages: DataFrame, section_map: DataFrame, corpus: DataFrame) -> DataFrame:
    """(problem, key): sections without an entry, entries without a section, and clause ids that the corpus lacks."""
    unmapped = passages.select("section").distinct().join(section_map.select("section"), "section", "left_anti").select(F.lit("unmapped section").alias("problem"), F.col("section").alias("key"))
    unused = section_map.select("section").join(passages.select("section"), "section", "left_anti").select(F.lit("unused entry"), "section")
    named = referenced(section_map).join(corpus.select("clause_id"), "clause_id", "left_anti").select(F.lit("unknown clause"), "clause_id")
    return unmapped.union(unused).union(named)


def referenced(section_map: DataFrame) -> DataFrame:
    """Distinct clause ids of either grade."""
    return section_map.select(F.explode(F.array_union("primary", "secondary")).alias("clause_id")).distinct()


def merged(gold: DataFrame, proposals: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gold with proposals (passage_id, clause_id) merged, and notes on those that name what isn't there.

    A proposal that agrees adds `llm` to the provenance, a new one becomes secondary; none raises a grade.
    """
    known = gold.select("passage_id").distinct()
    valid = proposals.distinct().join(known, "passage_id", "left_semi").join(corpus.select("clause_id").distinct(), "clause_id", "left_semi")
    p = valid.select("passage_id", "clause_id", F.lit(True).alias("proposed"))
    rows = gold.join(p, ["passage_id", "clause_id"], "full_outer")
    own = F.coalesce("provenance", F.array().cast("array<string>"))
    rows = rows.select("passage_id", "clause_id", F.coalesce("grade", F.lit(1)).alias("grade"), F.when(F.coalesce("proposed", F.lit(False)), F.array_union(own, F.array(F.lit("llm")))).otherwise(own).alias("provenance"))
    notes = proposals.distinct().join(valid, ["passage_id", "clause_id"], "left_anti").select("passage_id", "clause_id")
    return rows, notes


def label_counts(gold: DataFrame) -> DataFrame:
    """One row: primary, total, llm only, agreed, passages."""
    both, llm = F.array_contains("provenance", "expert_map") & F.array_contains("provenance", "llm"), F.array_contains("provenance", "llm")
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    return gold.agg(one(F.col("grade") == 2)("n_primary"), F.count("*").alias("n_total"), one(llm & ~F.array_contains("provenance", "expert_map"))("llm_only"), one(both)("agreed"), F.countDistinct("passage_id").alias("passages"))


def catalogue(clauses: DataFrame) -> DataFrame:
    """(instrument, title, n, place) of clauses (ord, instrument, title): first-seen title; articles by number, then annexes in roman order."""
    rows = clauses.groupBy("instrument").agg(F.min_by("title", "ord").alias("title"), F.count("*").alias("n"))
    number = F.try_to_number(F.regexp_extract("instrument", r"(\d+)$", 1), F.lit("999999")).cast("int")
    roman = F.array_position(F.array(*map(F.lit, ROMAN)), F.regexp_extract("instrument", r"([IVX]+)$", 1)).cast("int")
    return rows.withColumn("place", F.when(F.rlike("instrument", F.lit(r"\d$")), number).otherwise(F.lit(1_000_000) + roman))


def sorted_map(m: str):
    """A map column's entries by key."""
    return F.map_from_entries(F.array_sort(F.map_entries(m)))

"""Registered audit queries. Findings come from documents by fixed expressions, said once in SQL that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import findings as A
from auditloom.operators import gold as G

CATS = "'" + "', '".join(A.CATEGORIES) + "'"
#: A finding for each document: some break the schema, some have no explanation, low confidence, a strange clause or a quote that isn't there.
MADE = """SELECT doc_id, source AS passage_id, text,
  CASE WHEN doc_id % 13 = 0 THEN 'Cosmology' ELSE {pick} END AS category,
  CASE doc_id % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Critical' END AS severity,
  CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE 'The report does not say why' END AS explanation, 'Say why' AS suggested_correction,
  'A statement' AS violating_statement, '[Art.' || CAST(doc_id % 7 AS {str}) || '.1]' AS clause_id,
  CAST(doc_id * 37 % 100 AS DOUBLE) / 100 AS confidence,
  CASE WHEN doc_id % 5 = 0 THEN '@@ not in the text @@' ELSE substr(text, CAST(doc_id % 10 AS INT) + 1, 30) END AS source_quote
FROM documents"""
DUCK = "f AS (" + MADE.format(pick=f"([{CATS}])[doc_id % 9 + 1]", str="VARCHAR") + ")"
INVALID = f"(category NOT IN ({CATS}) OR trim(source_quote) = '' OR trim(explanation) = '')"
REASON = f"""r AS (SELECT *, CASE WHEN {INVALID} THEN 'SCHEMA_INVALID' WHEN trim(explanation) = '' THEN 'EMPTY_EXPLANATION' WHEN confidence < 0.35 THEN 'LOW_CONFIDENCE'
  WHEN doc_id % 7 > 4 THEN 'UNKNOWN_CLAUSE' WHEN NOT contains(text, source_quote) THEN 'UNGROUNDED_QUOTE' END AS reason FROM f)"""
BASE = f"WITH {DUCK}, {REASON}"


def made(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet")
    sql = MADE.format(pick=f"element_at(array({CATS}), CAST(doc_id % 9 AS INT) + 1)", str="STRING").replace("FROM documents", "FROM {docs}")
    return spark.sql(sql, docs=rows).withColumn("allowed", F.array(*(F.lit(f"Art.{k}.1") for k in range(5))))


def gated(spark: SparkSession, d: str) -> DataFrame:
    rows = made(spark, d)
    at = F.call_function("instr", F.col("text"), F.col("source_quote"))
    return A.cascade(rows.withColumn("grounding", F.when(at > 0, 1.0).otherwise(0.0)))


def guardrail_cascade(spark: SparkSession, d: str) -> DataFrame:
    return gated(spark, d).select("doc_id", "reason")


def drop_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.reason_counts(gated(spark, d))


def kept(spark: SparkSession, d: str) -> DataFrame:
    return gated(spark, d).where("reason IS NULL")


def readiness_score(spark: SparkSession, d: str) -> DataFrame:
    return A.readiness(made(spark, d), kept(spark, d), "passage_id")


def severity_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.severity_summary(kept(spark, d), "passage_id")


def category_bars(spark: SparkSession, d: str) -> DataFrame:
    return A.category_bars(kept(spark, d))


def quote_locate(spark: SparkSession, d: str) -> DataFrame:
    """All three strategies: exact, squeezed and fuzzy quotes of benchmark items."""
    rows = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text")
    quote = F.when(F.col("item_id") % 3 == 0, F.substring("text", 5, 60)).when(F.col("item_id") % 3 == 1, F.upper(F.regexp_replace(F.substring("text", 5, 60), " ", "  "))).otherwise(F.regexp_replace(F.substring("text", 5, 60), "a", "e"))
    return A.quote_places(rows.withColumn("source_quote", quote)).select("item_id", "at_start", "at_end", F.round("grounding", 6).alias("grounding"))


def reply_parsing(spark: SparkSession, d: str) -> DataFrame:
    """Replies in every form that a model gives them, one for each document, with its whole text as the quote."""
    item = F.to_json(F.struct(F.concat(F.lit("Art."), F.col("doc_id") % 7, F.lit(".1")).alias("clause_id"), F.col("text").alias("source_quote")))
    whole = F.concat(F.lit('{"findings": ['), item, F.lit("]}"))
    raw = (
        F.when(F.col("doc_id") % 6 == 0, whole).when(F.col("doc_id") % 6 == 1, F.concat(F.lit("<think>hm</think>```json\n"), whole, F.lit("\n```")))
        .when(F.col("doc_id") % 6 == 2, F.concat(F.lit("Here it is: "), whole, F.lit(" as asked"))).when(F.col("doc_id") % 6 == 3, F.lit(""))
        .when(F.col("doc_id") % 6 == 4, F.concat(F.lit('{"findings": ['), item, F.lit(', {"clause_id": "Art'))).otherwise(F.lit("[1, 2]"))
    )
    rows = A.parsed(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", raw.alias("raw")))
    field = lambda name: F.get_json_object("payload", f"$.findings[0].{name}")
    return rows.select("doc_id", "salvaged", field("clause_id").alias("clause_id"), F.md5(field("source_quote")).alias("quote"), F.col("error").isNotNull().alias("failed"))


def expected(spark: SparkSession, d: str) -> DataFrame:
    """Two expectations for each passage, the second within the first's scope."""
    rows = made(spark, d).select("passage_id").distinct()
    pair = F.explode(F.array(F.struct(F.lit(1).cast("long").alias("expect_no"), F.lit("Art.1").alias("clause_scope")), F.struct(F.lit(2).cast("long").alias("expect_no"), F.lit("Art.1.1").alias("clause_scope")), F.struct(F.lit(3).cast("long").alias("expect_no"), F.lit("Art.9").alias("clause_scope")))).alias("p")
    return rows.select("passage_id", pair).select("passage_id", "p.expect_no", "p.clause_scope")


def predicted(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d).select("passage_id", F.col("doc_id").alias("predict_no"), A.bare_id(F.col("clause_id")).alias("clause_id"), (F.col("doc_id") % 10 > 0).alias("grounded"), F.lit(True).alias("retrieved"))


def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    return A.greedy_matches(predicted(spark, d), expected(spark, d))


def audit_scores(spark: SparkSession, d: str) -> DataFrame:
    clean = made(spark, d).where(F.endswith("passage_id", F.lit("5")) | F.endswith("passage_id", F.lit("7"))).select("passage_id")
    return A.audit_scores(predicted(spark, d), expected(spark, d), clean)


def reconcile(spark: SparkSession, d: str) -> DataFrame:
    """A scripted judge says that every third finding is answered in its own passage, sometimes with too short a quote."""
    rows = gated(spark, d)
    verdicts = rows.select("doc_id", (F.col("doc_id") % 3 == 0).alias("addressed"), F.col("doc_id").alias("passage_id"), F.when(F.col("doc_id") % 2 == 0, F.regexp_extract("text", r"^(\S+ \S+ \S+ \S+)", 1)).otherwise(F.regexp_extract("text", r"^(\S+)", 1)).alias("quote"))
    shown = rows.select("doc_id", F.col("doc_id").alias("passage_id"), "text")
    judged = A.judged(rows, rows.select("doc_id", (F.col("doc_id") % 17 != 0).alias("supported")), "doc_id")
    return A.reason_counts(A.reconciled(judged, verdicts, shown, "doc_id"))


def passages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("passage_id"), F.concat(F.lit("S"), F.col("c_custkey") % 30).alias("section"))


def section_map(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("S"), k + 1).alias("section"), F.array(F.concat(F.lit("C"), k)).alias("primary"), F.array(F.concat(F.lit("C"), k), F.concat(F.lit("C"), k + 1)).alias("secondary"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("C"), "n_nationkey").alias("clause_id"))


GOLD = """p AS (SELECT c_custkey AS passage_id, 'S' || c_custkey % 30 AS section FROM customer), m AS (SELECT 'S' || (n_nationkey + 1) AS section, n_nationkey AS k FROM nation),
  g AS (SELECT passage_id, section, 'C' || k AS clause_id, 2 AS grade FROM p JOIN m USING (section) UNION ALL SELECT passage_id, section, 'C' || (k + 1), 1 FROM p JOIN m USING (section)),
  pr AS (SELECT DISTINCT c_custkey AS passage_id, 'C' || c_custkey % 30 AS clause_id FROM customer)"""


def gold_records(spark: SparkSession, d: str) -> DataFrame:
    return G.gold_records(passages(spark, d), section_map(spark, d)).select("passage_id", "section", "clause_id", "grade", F.array_join("provenance", ",").alias("provenance"))


def gold_problems(spark: SparkSession, d: str) -> DataFrame:
    return G.problems(passages(spark, d), section_map(spark, d), corpus(spark, d))


def merged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    proposals = passages(spark, d).select("passage_id", F.concat(F.lit("C"), F.col("passage_id") % 30).alias("clause_id"))
    return G.merged(G.gold_records(passages(spark, d), section_map(spark, d)).drop("section"), proposals, corpus(spark, d))


def gold_merge(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d)[0].withColumn("provenance", F.array_join("provenance", ","))


def gold_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.label_counts(merged(spark, d)[0])


def instrument_catalogue(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey")
    name = F.when(o % 3 == 0, F.concat(F.lit("Annex."), F.element_at(F.array(*map(F.lit, G.ROMAN)), (o % 17 + 1).cast("int")))).otherwise(F.concat(F.lit("Art."), o % 123 + 1))
    return G.catalogue(spark.read.parquet(f"{d}/orders.parquet").select(o.alias("ord"), name.alias("instrument"), F.col("o_orderpriority").alias("title")))


MERGED = f"""WITH {GOLD}, gg AS (SELECT passage_id, clause_id, max(grade) AS grade FROM g GROUP BY ALL),
  v AS (SELECT * FROM pr WHERE passage_id IN (SELECT passage_id FROM g) AND clause_id IN (SELECT 'C' || n_nationkey FROM nation)),
  x AS (SELECT passage_id, clause_id, coalesce(gg.grade, 1) AS grade, CASE WHEN gg.grade IS NULL THEN 'llm' WHEN v.passage_id IS NULL THEN 'expert_map' ELSE 'expert_map,llm' END AS provenance
        FROM gg FULL JOIN v USING (passage_id, clause_id))"""
WEIGHT = "CASE severity WHEN 'Low' THEN 5 WHEN 'Medium' THEN 10 WHEN 'High' THEN 15 WHEN 'Critical' THEN 20 END"
ROMANS = "['" + "', '".join(G.ROMAN) + "']"
MATCHED = """k AS (SELECT passage_id, doc_id AS predict_no, doc_id % 7 AS a FROM r WHERE reason IS NULL AND doc_id % 7 = 1),
  n AS (SELECT *, row_number() OVER (PARTITION BY passage_id ORDER BY predict_no) AS expect_no FROM k)"""

TABLE = {
    "guardrail_cascade": (guardrail_cascade, f"{BASE} SELECT doc_id, reason FROM r"),
    "drop_reason_counts": (drop_reason_counts, f"{BASE} SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason"),
    "readiness_score": (
        readiness_score,
        f"{BASE}, w AS (SELECT passage_id, category, max({WEIGHT}) AS w FROM r WHERE reason IS NULL GROUP BY ALL) SELECT passage_id, greatest(0, 100 - coalesce(sum(w), 0))::BIGINT AS score FROM (SELECT DISTINCT passage_id FROM f) LEFT JOIN w USING (passage_id) GROUP BY passage_id",
    ),
    "severity_summary": (
        severity_summary,
        f"{BASE} SELECT passage_id, " + ", ".join(f"sum((severity = '{s}')::INT)::BIGINT AS {s.lower()}" for s in A.SEVERITIES) + ", sum((severity IN ('Critical', 'High'))::INT)::BIGINT AS grave, floor(avg(confidence) * 100 + 1e-9)::BIGINT AS confidence_percent FROM r WHERE reason IS NULL GROUP BY passage_id",
    ),
    "category_bars": (category_bars, f"{BASE}, c AS (SELECT category, count(*) AS n FROM r WHERE reason IS NULL GROUP BY category) SELECT category, n, round(n / (SELECT max(n) FROM c), 6) AS bar FROM c"),
    "quote_locate": (quote_locate, None),
    "reply_parsing": (
        reply_parsing,
        "SELECT doc_id, doc_id % 6 = 4 AS salvaged, CASE WHEN doc_id % 6 IN (3, 5) THEN NULL ELSE 'Art.' || doc_id % 7 || '.1' END AS clause_id, CASE WHEN doc_id % 6 NOT IN (3, 5) THEN md5(text) END AS quote, doc_id % 6 IN (3, 5) AS failed FROM documents",
    ),
    "greedy_match": (greedy_match, f"{BASE}, {MATCHED} SELECT passage_id, expect_no, predict_no FROM n WHERE expect_no <= 2"),
    "audit_scores": (
        audit_scores,
        f"""{BASE}, {MATCHED}, t AS (SELECT (SELECT count(*) FROM n WHERE expect_no <= 2) AS matched, (SELECT 3 * count(DISTINCT passage_id) FROM f) AS e, (SELECT count(*) FROM r WHERE reason IS NULL) AS p,
        (SELECT count(*) FROM r WHERE reason IS NULL AND doc_id % 10 = 0) AS bad, (SELECT count(DISTINCT passage_id) FROM f WHERE right(passage_id, 1) IN ('5', '7')) AS cl,
        (SELECT count(*) FROM r WHERE reason IS NULL AND right(passage_id, 1) IN ('5', '7')) AS oc, (SELECT count(DISTINCT passage_id) FROM r WHERE reason IS NULL AND right(passage_id, 1) IN ('5', '7')) AS ch)
        SELECT matched, round_even(matched / e, 4) AS recall, round_even(matched / p, 4) AS precision, round_even(2 * (matched / e) * (matched / p) / (matched / e + matched / p), 4) AS f1, round_even(ch / cl, 4) AS fp_rate, oc AS findings_on_clean, round_even(bad / p, 4) AS hallucination_rate FROM t""",
    ),
    "reconcile": (
        reconcile,
        f"""{BASE}, j AS (SELECT *, CASE WHEN reason IS NULL AND doc_id % 17 = 0 THEN 'JUDGE_REJECTED' ELSE reason END AS r1 FROM r),
        k AS (SELECT CASE WHEN r1 IS NULL AND doc_id % 6 = 0 AND regexp_matches(text, '^\\S+ \\S+ \\S+ \\S+') THEN 'ADDRESSED_ELSEWHERE' ELSE r1 END AS reason FROM j) SELECT reason, count(*) AS n FROM k WHERE reason IS NOT NULL GROUP BY reason""",
    ),
    "gold_records": (gold_records, f"WITH {GOLD} SELECT passage_id, section, clause_id, max(grade) AS grade, 'expert_map' AS provenance FROM g GROUP BY ALL"),
    "gold_problems": (
        gold_problems,
        f"WITH {GOLD} SELECT 'unmapped section' AS problem, section AS key FROM (SELECT DISTINCT section FROM p) WHERE section NOT IN (SELECT section FROM m) UNION ALL SELECT 'unused entry', section FROM m WHERE section NOT IN (SELECT section FROM p) UNION ALL SELECT DISTINCT 'unknown clause', clause_id FROM (SELECT 'C' || k AS clause_id FROM m UNION SELECT 'C' || (k + 1) FROM m) WHERE clause_id NOT IN (SELECT 'C' || n_nationkey FROM nation)",
    ),
    "gold_merge": (gold_merge, f"{MERGED} SELECT * FROM x"),
    "gold_label_counts": (
        gold_label_counts,
        f"{MERGED} SELECT sum((grade = 2)::INT)::BIGINT AS n_primary, count(*) AS n_total, sum((provenance = 'llm')::INT)::BIGINT AS llm_only, sum((provenance = 'expert_map,llm')::INT)::BIGINT AS agreed, count(DISTINCT passage_id) AS passages FROM x",
    ),
    "instrument_catalogue": (
        instrument_catalogue,
        f"WITH c AS (SELECT o_orderkey AS o, o_orderpriority AS t, CASE WHEN o_orderkey % 3 = 0 THEN 'Annex.' || ({ROMANS})[o_orderkey % 17 + 1] ELSE 'Art.' || (o_orderkey % 123 + 1) END AS instrument, CASE WHEN o_orderkey % 3 = 0 THEN 1000000 + o_orderkey % 17 + 1 ELSE o_orderkey % 123 + 1 END AS place FROM orders)"
        " SELECT instrument, arg_min(t, o) AS title, count(*) AS n, min(place)::INT AS place FROM c GROUP BY instrument",
    ),
}

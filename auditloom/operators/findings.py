"""Findings: replies parsed, validated, put through an ordered cascade of rules, reconciled, and scored. Rejects are rows with a reason."""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories, severities with their weights, and reasons for a rejection.
CATEGORIES = (
    "Clinical Evaluation", "Risk Management", "Post Market Surveillance", "Verification & Validation", "Equivalence",
    "Safety", "Regulatory Documentation", "Clinical Investigation", "Other",
)
SEVERITIES = {"Low": 5, "Medium": 10, "High": 15, "Critical": 20}
REASONS = ("UNGROUNDED_QUOTE", "UNKNOWN_CLAUSE", "LOW_CONFIDENCE", "SCHEMA_INVALID", "EMPTY_EXPLANATION", "JUDGE_REJECTED", "ADDRESSED_ELSEWHERE")
# How a reader says that something is missing.
ABSENCE = (
    r"(?i)\b((?:does|do|did|is|are|has|have)\s+not|not\s+(?:been\s+)?\w*"
    r"(?:specif|includ|provid|describ|identif|present|demonstrat|defin|address|mention|document|state|contain|detail|discuss|justif|report|reference)\w*|"
    r"lacks?|lacking|missing|absent|absence|omit\w*|fails?\s+to|"
    r"no\s+(?:evidence|mention|description|reference|information|data|details?|discussion|justification|indication|explicit)|"
    r"without\s+(?:any\s+)?(?:evidence|description|reference|justification)|insufficient|incomplete)\b"
)

ITEM = "violating_statement string, source_quote string, clause_id string, category string, severity string, explanation string, suggested_correction string, confidence double"
LOCATED = "at_start int, at_end int, grounding double"


def weight(severity: Column) -> Column:
    out = F.lit(0)
    for name, value in SEVERITIES.items():
        out = F.when(severity == name, value).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    """Critical first; unknown ones last."""
    out = F.lit(len(SEVERITIES))
    for k, name in enumerate(reversed(SEVERITIES)):
        out = F.when(severity == name, k).otherwise(out)
    return out


def parse_reply(raw: str | None) -> tuple[str | None, bool, str | None]:
    """JSON text of a reply's object, whether it was salvaged, and the error if there is none.

    Thinking blocks and code fences go; then the whole is parsed, then what lies between the outermost braces, then the
    complete leading items of a truncated findings array.
    """
    if not (raw or "").strip():
        return None, False, "empty reply"
    text = re.sub(r"(?s)<think>.*?</think>", "", raw)
    text = re.sub(r"(?m)^\s*```\w*\s*$|```(?:json)?", "", text).strip()
    begin, end = text.find("{"), text.rfind("}")
    for part in (text, text[begin : end + 1] if 0 <= begin < end else ""):
        try:
            value = json.loads(part)
        except ValueError:
            continue
        return (json.dumps(value), False, None) if isinstance(value, dict) else (None, False, "reply is not an object")
    if begin < 0 or end < begin:
        return None, False, "no object in the reply"
    array = re.search(r'"findings"\s*:\s*\[', text)
    items, decoder, at = [], json.JSONDecoder(), array.end() if array else len(text)
    while array:
        at += len(re.match(r"[\s,]*", text[at:])[0])
        try:
            item, at = decoder.raw_decode(text, at)
        except ValueError:
            break
        items.append(item)
    return (json.dumps({"findings": items, "_salvaged": True}), True, None) if items else (None, False, "nothing complete in the reply")


def parsed(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """The rows with payload (JSON text), salvaged and error."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in replies.schema)
    at, names = replies.columns.index(raw), [*replies.columns, "payload", "salvaged", "error"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Replies are long: some at a time become Python objects.
        for batch in batches:
            for part in (batch.slice(n, 200) for n in range(0, batch.num_rows, 200)):
                rows = [parse_reply(x.as_py()) for x in part.column(at)]
                own = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.bool_(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *own], names=names)

    return replies.mapInArrow(parse, f"{kinds}, payload string, salvaged boolean, error string")


def items_of(replies: DataFrame, payload: str = "payload") -> DataFrame:
    """One row for each finding of a JSON payload, with item_no, the item's fields, the item's own text (raw_item) and skipped (not an object)."""
    items = F.from_json(F.get_json_object(payload, "$.findings"), "array<string>")
    rows = replies.select(*replies.columns, F.posexplode(items).alias("item_no", "raw_item"))
    return rows.withColumn("skipped", ~F.startswith(F.ltrim("raw_item"), F.lit("{"))).withColumn("f", F.from_json("raw_item", ITEM)).select(*replies.columns, "item_no", "raw_item", "skipped", "f.*")


def stripped(text: Column) -> Column:
    """Without white space, line ends included, at either end; a null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def bare_id(clause_id: Column) -> Column:
    """An id without the brackets that models echo."""
    return stripped(F.btrim(stripped(clause_id), F.lit("[]")))


def schema_invalid() -> Column:
    """Whether a finding breaks the schema: an unknown category or severity, a required text that is blank, or a confidence outside 0..1."""
    blank = bare_id(F.col("clause_id")) == ""
    for name in ("source_quote", "violating_statement", "explanation", "suggested_correction"):
        blank |= stripped(F.col(name)) == ""
    within = lambda c, known: F.coalesce(F.col(c).isin(*known), F.lit(False))
    return ~within("category", CATEGORIES) | ~within("severity", SEVERITIES) | blank | ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))


def cascade(rows: DataFrame, min_confidence: float = 0.35, min_grounding: float = 0.82, rules: tuple[str, ...] = REASONS) -> DataFrame:
    """The rows with `reason`, the first rule that rejects one, or null. Rows need the finding's fields, allowed (array of ids) and grounding."""
    empty = (stripped(F.col("explanation")) == "") | (stripped(F.col("suggested_correction")) == "")
    tests = (
        ("SCHEMA_INVALID", schema_invalid()),
        ("EMPTY_EXPLANATION", empty),
        ("LOW_CONFIDENCE", F.coalesce(F.col("confidence"), F.lit(0.0)) < min_confidence),
        ("UNKNOWN_CLAUSE", ~F.coalesce(F.array_contains("allowed", bare_id(F.col("clause_id"))), F.lit(False))),
        ("UNGROUNDED_QUOTE", F.coalesce(F.col("grounding"), F.lit(0.0)) < min_grounding),
    )
    reason = F.lit(None).cast("string")
    for name, test in reversed(tests):
        if name in rules:
            reason = F.when(test, F.lit(name)).otherwise(reason)
    return rows.withColumn("reason", reason)


def locate_quote(quote: str | None, passage: str | None, least: float = 0.82) -> tuple[int, int, float]:
    """Start, end and score of a quote: as it stands (1.0), then without regard to case and white space (0.98), then the nearest window (its ratio).

    A quote of white space alone stands for the whole passage. The nearest window is looked for only with 12 characters or more. (-1, -1, 0.0) if there is none.
    """
    quote, passage = quote or "", passage or ""
    if not quote or not passage:
        return -1, -1, 0.0
    at = passage.find(quote)
    if at >= 0:
        return at, at + len(quote), 1.0
    hay, needle = re.sub(r"\s+", " ", lowered(passage)), " ".join(quote.lower().split())
    at = hay.find(needle)
    if at >= 0:
        places = flat_places(passage)
        return places[at], places[at + len(needle) - 1] + 1 if needle else places[-1] + 1, 0.98
    if len(needle) < 12:
        return -1, -1, 0.0
    in_hay, in_needle, size = longest_match(hay, needle)
    if not size:
        return -1, -1, 0.0
    begin = max(0, in_hay - in_needle)
    end = min(len(hay), begin + len(needle))
    alike = difflib.SequenceMatcher(None, hay[begin:end], needle)
    if alike.quick_ratio() < least or (ratio := alike.ratio()) < least:
        return -1, -1, 0.0
    places = flat_places(passage)
    return places[begin], places[end - 1] + 1, ratio


def lowered(text: str) -> str:
    """Lower case character by character, whatever stands around one."""
    return "".join(map(str.lower, text)) if "\u03a3" in text else text.lower()


def flat_places(passage: str) -> list[int]:
    """Where each character of the lower-case text with single spaces stands in the passage."""
    places, gap = [], False
    for i, char in enumerate(passage):
        if not char.isspace():
            places += [i] * len(char.lower())
        elif not gap:
            places.append(i)
        gap = char.isspace()
    return places


def longest_match(hay: str, needle: str) -> tuple[int, int, int]:
    """Start in hay, start in needle and size of the longest string of both; of several the first in hay, then in needle.

    The same as difflib's find_longest_match, by at most three searches for each character of the needle.
    """
    size = 0
    for j in range(len(needle)):
        while j + size < len(needle) and needle[j : j + size + 1] in hay:
            size += 1
        if j + size >= len(needle):
            break
    found = ((hay.find(needle[j : j + size]), j) for j in range(len(needle) - size + 1)) if size else ()
    return (*min((x for x in found if x[0] >= 0), default=(0, 0)), size)


def quote_places(rows: DataFrame, quote: str = "source_quote", passage: str = "text", least: float = 0.82) -> DataFrame:
    """The rows with at_start, at_end and grounding. Exact quotes are found by an expression; of the others alone quote and passage go to Python."""
    at = F.call_function("instr", F.col(passage), F.col(quote)).cast("int")
    exact = F.coalesce((at > 0) & (F.length(quote) > 0), F.lit(False))

    @F.pandas_udf(LOCATED)
    def search(quotes: pd.Series, passages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([locate_quote(q, p, least) for q, p in zip(quotes, passages, strict=True)], columns=["at_start", "at_end", "grounding"])

    rows = rows.withColumn("_exact", F.when(exact, at)).withColumn("_found", search(F.when(~exact, F.col(quote)), F.when(~exact, F.col(passage))))
    place = lambda name, here: F.when(F.col("_exact").isNotNull(), here).otherwise(F.col(f"_found.{name}")).alias(name)
    end = F.col("_exact") - 1 + F.length(quote)
    return rows.withColumns({"at_start": place("at_start", F.col("_exact") - 1), "at_end": place("at_end", end.cast("int")), "grounding": place("grounding", F.lit(1.0))}).drop("_exact", "_found")


def absence_claim(*texts: Column) -> Column:
    return F.rlike(F.concat_ws(" ", *texts), F.lit(ABSENCE))


def judged(rows: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Rows with reason JUDGE_REJECTED where the second model said (key, supported = false); a missing or failed verdict keeps a finding."""
    v = verdicts.select(F.col(key).alias("_k"), "supported")
    rows = rows.join(v, F.col(key) == F.col("_k"), "left")
    return rows.withColumn("reason", F.when(F.col("reason").isNull() & ~F.coalesce("supported", F.lit(True)), F.lit("JUDGE_REJECTED")).otherwise(F.col("reason"))).drop("_k", "supported")


def reconciled(rows: DataFrame, verdicts: DataFrame, shown: DataFrame, key: str, least: float = 0.82, min_words: int = 4) -> DataFrame:
    """Absence claims that another shown passage answers get reason ADDRESSED_ELSEWHERE.

    verdicts: (key, addressed, passage_id, quote); shown: (key, passage_id, text). The quote must have min_words words and
    stand in the passage it names, which must have been shown; anything else keeps the finding.
    """
    proof = verdicts.where("addressed").join(shown, [key, "passage_id"]).where(F.size(F.split(F.trim("quote"), r"\s+")) >= min_words)
    proof = quote_places(proof, "quote", "text", least).where(F.col("grounding") >= least).select(F.col(key).alias("_k")).distinct()
    rows = rows.join(proof.withColumn("_answered", F.lit(True)), F.col(key) == F.col("_k"), "left")
    hit = F.col("reason").isNull() & F.coalesce("_answered", F.lit(False)) & absence_claim(F.col("violating_statement"), F.col("explanation"))
    return rows.withColumn("reason", F.when(hit, F.lit("ADDRESSED_ELSEWHERE")).otherwise(F.col("reason"))).drop("_k", "_answered")


def reason_counts(rows: DataFrame) -> DataFrame:
    return rows.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def readiness(docs: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """100 less, for each category, the weight of its gravest finding; at least 0; 100 without findings."""
    worst = findings.groupBy(key, "category").agg(F.max(weight(F.col("severity"))).alias("w")).groupBy(key).agg(F.sum("w").alias("w"))
    return docs.select(key).distinct().join(worst, key, "left").select(key, F.greatest(F.lit(0), 100 - F.coalesce("w", F.lit(0))).cast("long").alias("score"))


def severity_summary(findings: DataFrame, key: str) -> DataFrame:
    """Counts of each severity (0 where none), grave ones, and the mean confidence in whole percent."""
    counts = [F.sum((F.col("severity") == s).cast("int")).alias(s.lower()) for s in SEVERITIES]
    return findings.groupBy(key).agg(*counts, F.sum(F.col("severity").isin("Critical", "High").cast("int")).alias("grave"), F.floor(F.avg("confidence") * 100 + 1e-9).cast("long").alias("confidence_percent"))


def category_bars(findings: DataFrame) -> DataFrame:
    """Category counts and their share of the largest."""
    counts = findings.groupBy("category").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    return counts.crossJoin(F.broadcast(most)).select("category", "n", F.round(F.col("n") / F.col("most"), 6).alias("bar"))


def greedy_matches(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """(passage_id, expect_no, predict_no): expectations in order take their first unmatched prediction within their scope.

    predicted: passage_id, predict_no, clause_id; expected: passage_id, expect_no, clause_scope. One passage at a time, as
    only there do expectations compete.
    """
    kind = predicted.schema["passage_id"].dataType.simpleString()
    p = predicted.groupBy("passage_id").agg(F.array_sort(F.collect_list(F.struct("predict_no", "clause_id"))).alias("p"))
    e = expected.groupBy("passage_id").agg(F.array_sort(F.collect_list(F.struct("expect_no", "clause_scope"))).alias("e"))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for passage, preds, exps in zip(batch["passage_id"], batch["p"], batch["e"], strict=True):
                free = list(preds)
                for x in exps:
                    hit = next((y for y in free if y["clause_id"] == x["clause_scope"] or y["clause_id"].startswith(x["clause_scope"] + ".")), None)
                    if hit is not None:
                        free.remove(hit)
                        out.append((passage, x["expect_no"], hit["predict_no"]))
            yield pd.DataFrame(out, columns=["passage_id", "expect_no", "predict_no"])

    return p.join(e, "passage_id").mapInPandas(match, f"passage_id {kind}, expect_no long, predict_no long")


def audit_scores(predicted: DataFrame, expected: DataFrame, clean: DataFrame) -> DataFrame:
    """One row: matched, recall, precision, f1, fp_rate, findings_on_clean, hallucination_rate. predicted also has grounded and retrieved."""
    matched = greedy_matches(predicted, expected).agg(F.count("*").alias("matched"))
    clean = clean.select("passage_id").distinct()
    on_clean = predicted.join(clean, "passage_id", "left_semi").agg(F.count("*").alias("findings_on_clean"), F.countDistinct("passage_id").alias("clean_hit"))
    whole = predicted.agg(F.count("*").alias("n"), F.sum((~F.col("grounded") | ~F.col("retrieved")).cast("int")).alias("bad"))
    one = matched.crossJoin(on_clean).crossJoin(whole).crossJoin(expected.agg(F.count("*").alias("expected"))).crossJoin(clean.agg(F.count("*").alias("clean")))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    one = one.withColumn("recall", ratio("matched", "expected")).withColumn("precision", ratio("matched", "n"))
    return one.select("matched", F.bround("recall", 4).alias("recall"), F.bround("precision", 4).alias("precision"), F.bround(ratio(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")), 4).alias("f1"),
                      F.bround(ratio("clean_hit", "clean"), 4).alias("fp_rate"), "findings_on_clean", F.bround(ratio("bad", "n"), 4).alias("hallucination_rate"))


def generated(prompts: DataFrame, provider: Callable[[], Callable[[str], str]], key: str) -> DataFrame:
    """(key, raw, error): one call of a model for each prompt row; a failure is a row with its error and stops nothing.

    provider is called once in each Python worker's partition and returns the function that answers a prompt. Write the
    result before using it twice, so that a retry does not ask again.
    """
    kind = prompts.schema[key].dataType.simpleString()

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = provider()
        for batch in batches:
            rows = []
            for k, prompt in zip(batch[key], batch["prompt"], strict=True):
                try:
                    rows.append((k, answer(prompt), None))
                except Exception as e:  # noqa: BLE001  any failure of a model is data here
                    rows.append((k, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=[key, "raw", "error"])

    return prompts.select(key, "prompt").mapInPandas(ask, f"{key} {kind}, raw string, error string")

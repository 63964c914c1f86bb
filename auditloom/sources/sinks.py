"""Writers: JSON lines in order, results by configuration, and keyed upserts."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.text import point_id
from auditloom.operators import findings as A


def write_jsonl(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines in one order over all part files: the files' names follow it, and so do the lines within each."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def write_results(df: DataFrame, path: str, config: str = "config") -> None:
    """Rows by configuration; only the partitions present are replaced, so that a later failure keeps earlier ones."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(config).parquet(path)


def upserted(old: DataFrame | None, new: DataFrame, key: str, seq: str) -> DataFrame:
    """One row for each key, that of the largest seq: loading the same rows again changes nothing. Rows get a 63-bit point_id."""
    rows = new if old is None else old.drop("point_id").unionByName(new)
    last = Window.partitionBy(key).orderBy(F.desc(seq))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n").withColumn("point_id", point_id(F.col(key)))


def html_report(doc: str, findings: DataFrame) -> str:
    """A page with the score, severity counts, category bars and all findings of one document, gravest first; ties go by clause and text.

    A driver holds the page, so it is meant for one document's findings, which are read a partition at a time.
    """
    own = findings.where(F.col("passage_id") == doc)
    score = A.readiness(findings.sparkSession.createDataFrame([(doc,)], "passage_id string"), own, "passage_id").first()["score"]
    bars = A.category_bars(own).orderBy(F.desc("n"), "category").collect()
    shown = own.orderBy(A.severity_rank(F.col("severity")), F.desc("confidence"), "clause_id", "source_quote", "explanation")
    e = lambda value: html.escape(value or "")
    body = "".join(f"<li>{e(b.category)}: {b.n}<meter value='{b.bar}'></meter></li>" for b in bars)
    cards = (f"<article><h3>{e(c.severity)} {e(c.clause_id)}</h3><q>{e(c.source_quote)}</q><p>{e(c.explanation)}</p></article>" for c in shown.toLocalIterator())
    return f"<!DOCTYPE html><html><body><h1>{e(doc)}</h1><p>Readiness {score}</p><ul>{body}</ul>{''.join(cards)}</body></html>"


def markdown_table(df: DataFrame, *order: str) -> str:
    """A small result as a Markdown table."""
    rows = df.orderBy(*order).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *map(line, rows)])

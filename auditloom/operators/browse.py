"""Everyday access: projections, lookups, filters, page tables, and findings beside the pages they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.text import html_escaped, replace_first


def without_heavy(rows: DataFrame, *heavy: str) -> DataFrame:
    """All columns but the heavy ones, which a scan then never reads."""
    return rows.drop(*heavy)


def looked_up(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Each wanted key with its row, and whether there is one."""
    return keys.select(key).distinct().join(rows.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def matching(title: Column, section: Column, needle: str) -> Column:
    """Whether a title contains the needle in any case, or a section number contains it; all do where it is blank."""
    n = needle.strip().lower()
    return F.lit(True) if not n else F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(n)) | F.contains(F.coalesce(section, F.lit("")), F.lit(n))


def key_union(*keys: DataFrame) -> DataFrame:
    """The distinct keys of several one-column tables."""
    out = keys[0]
    for k in keys[1:]:
        out = out.union(k)
    return out.distinct()


def first_of_each(rows: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    """The first n rows of each key, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)


def quote_there(page: Column, quote: Column) -> Column:
    """Whether a page has a quote, or at least its first 40 characters; a blank quote is nowhere."""
    q = F.trim(F.coalesce(quote, F.lit("")))
    p = F.coalesce(page, F.lit(""))
    return (q != "") & (F.contains(p, q) | F.contains(p, F.substring(q, 1, 40)))


def real_errors(rows: DataFrame, error: str = "error") -> DataFrame:
    """Rows whose error is one, and no notice of removed instructions."""
    return rows.where(F.col(error).isNotNull() & (F.col(error) != "") & ~F.contains(F.col(error), F.lit("neutralised")))


def from_page(pages: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """Pages (page, ...) from the first body page on."""
    rows = pages.where(F.col("page") >= first)
    return rows if last is None else rows.where(F.col("page") <= last)


def page_items(lines: DataFrame, tables: DataFrame, flat: DataFrame | None = None) -> DataFrame:
    """(page, y, ord, kind, text): lines and tables of each page in reading order; the plain text of pages that have neither.

    lines (page, y, ord, text) that lie within a table are left out beforehand, see segment.outside_boxes().
    """
    own = lines.select("page", "y", "ord", F.lit("line").alias("kind"), "text").unionByName(tables.select("page", "y", "ord", F.lit("table").alias("kind"), "text"))
    if flat is not None:
        rest = flat.join(own.select("page").distinct(), "page", "left_anti")
        own = own.unionByName(rest.select("page", F.lit(0).cast(own.schema["y"].dataType).alias("y"), F.lit(0).cast(own.schema["ord"].dataType).alias("ord"), F.lit("text").alias("kind"), "text"))
    return own.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("y", "ord")))


def is_template_table(rows: Column, markers: tuple[str, ...]) -> Column:
    """Whether a grid is a form's own: a marker stands in its first three rows, or no row has two cells."""
    cells = lambda r: F.lower(F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " "))
    marked = F.exists(F.slice(rows, 1, 3), lambda r: F.rlike(cells(r), F.lit("|".join(m.lower() for m in markers))))
    return marked | ~F.exists(rows, lambda r: F.size(r) >= 2)


def section_pages(lines: DataFrame, key: str) -> DataFrame:
    """(key, section, heading, number, title, page_start, page_end, n_lines) of sessionised lines that have a page."""
    out = lines.groupBy(key, "section").agg(F.max("heading").alias("heading"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.count("*").alias("n_lines"))
    return out.withColumns({"number": F.regexp_extract("heading", r"^(\d+(?:\.\d+)*)", 1), "title": F.trim(F.regexp_replace("heading", r"^\d+(?:\.\d+)*\.?\s*", ""))})


def findings_on_pages(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings with the text of their page; without a page number they are on the first."""
    rows = findings.withColumn("page", F.coalesce("page", F.lit(1)))
    return rows.join(pages.select("doc_id", "page", F.col("text").alias("page_text")), ["doc_id", "page"], "left")


def corrected_pages(pages: DataFrame, fixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages with one accepted fix each applied, and the resolution of every fix.

    fixes: (doc_id, page, quote, correction, verified, forced), at most one a page; more are applied in rounds. A fix is
    accepted if it is verified or forced, and replaces the first occurrence of its trimmed quote; others wait for a review.
    """
    f = fixes.withColumns({"page": F.coalesce("page", F.lit(1)), "accepted": F.coalesce("verified", F.lit(True)) | F.coalesce("forced", F.lit(False)), "_q": F.trim(F.coalesce("quote", F.lit("")))})
    rows = pages.join(f.where("accepted").select("doc_id", "page", "_q", "correction"), ["doc_id", "page"], "left")
    text = F.when(F.col("_q").isNotNull(), replace_first(F.col("text"), F.col("_q"), F.col("correction"))).otherwise(F.col("text"))
    return rows.withColumn("text", text).drop("_q", "correction"), f.select("doc_id", "page", "accepted", F.coalesce("verified", F.lit(True)).alias("verified"))


def page_cards(pages: DataFrame, findings: DataFrame, resolved: DataFrame) -> DataFrame:
    """(doc_id, page, issues, resolved_n, status) of each page: open pages have unresolved issues."""
    f = findings.withColumn("page", F.coalesce("page", F.lit(1))).groupBy("doc_id", "page").agg(F.count("*").alias("issues"))
    r = resolved.where("accepted").groupBy("doc_id", "page").agg(F.count("*").alias("resolved_n"))
    rows = pages.select("doc_id", "page").join(f, ["doc_id", "page"], "left").join(r, ["doc_id", "page"], "left").na.fill(0, ["issues", "resolved_n"])
    return rows.withColumn("status", F.when(F.col("issues") == 0, "clear").when(F.col("resolved_n") >= F.col("issues"), "resolved").otherwise("open"))


def score_band(score: Column) -> Column:
    """Colour band of a readiness score."""
    return F.when(score < 50, "red").when(score < 75, "amber").otherwise("green")


def highlight_order(findings: DataFrame, key: str, quote: str = "source_quote") -> DataFrame:
    """Findings of each key in the order in which their quotes are marked: longest first, then as they came (ord)."""
    return findings.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.length(quote)), "ord")))


def highlighted(text: Column, quotes: Column) -> Column:
    """Escaped text with the first occurrence of each quote marked, in the order of the array; quotes that are not there change nothing."""
    mark = lambda acc, q: replace_first(acc, html_escaped(q), F.concat(F.lit("<mark>"), html_escaped(q), F.lit("</mark>")))
    return F.aggregate(quotes, html_escaped(text), mark)

"""Documents to rows: lines, sections, paragraphs, passages, windows, tables and clause hierarchies. Order is always a column."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.text import LINE_CLASSES, PARAGRAPH_START, n_words, normalised, words


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ord from 0, line) of each line."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("ord", "line"))


def without_running_head(lines: DataFrame, phrase: str) -> DataFrame:
    return lines.where(~F.contains(F.lower("line"), F.lit(phrase.lower())))


def without_boilerplate(lines: DataFrame, boilerplate: DataFrame, page_mark: str) -> DataFrame:
    """Lines that are not in a table of exact lines (column line) and do not match a page mark."""
    return lines.join(boilerplate.select("line").distinct(), "line", "left_anti").where(~F.rlike("line", F.lit(page_mark)))


def sessionised(lines: DataFrame, key: str, is_heading: Column) -> DataFrame:
    """Lines with the number of their section (from 1) and its heading; lines before the first heading are dropped."""
    upto = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_h", is_heading)
    rows = rows.withColumn("section", F.sum(F.col("_h").cast("int")).over(upto)).withColumn("heading", F.last(F.when(F.col("_h"), F.col("line")), ignorenulls=True).over(upto))
    return rows.where("section > 0").drop("_h")


def suffixed(rows: DataFrame, key: str, order: str, first: int = 1, mark: str = "#") -> DataFrame:
    """Repeated keys get a mark and a number from the second on, in order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_n", n).withColumn("unique_key", F.when(F.col("_n") == 1, F.col(key)).otherwise(F.concat(key, F.lit(mark), (F.col("_n") - 2 + first).cast("string")))).drop("_n")


def paragraphs(lines: DataFrame, key: str) -> DataFrame:
    """(key, para, text): lines joined and normalised; a bullet or enumerator begins a paragraph, and so does the line after one that ends in . : or ; Blank ones go."""
    order = Window.partitionBy(key).orderBy("ord")
    new = F.rlike("line", F.lit(PARAGRAPH_START)) | F.coalesce(F.rlike(F.lag("line").over(order), F.lit(r"[.:;]\s*$")), F.lit(False))
    rows = lines.withColumn("_new", new.cast("int")).withColumn("para", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy(key, "para").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("_l"))
    return parts.select(key, "para", normalised(F.array_join(F.transform("_l", lambda x: x["line"]), " ")).alias("text")).where("text <> ''")


def packed_sizes(sizes: Column, target: int = 320, most: int = 520, tail: int = 40) -> Column:
    """Chunk number of each paragraph, from its words: a chunk ends before it would exceed `most` and after it reaches `target`; a last chunk under `tail` joins the one before."""
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("chunk"), F.lit(0).alias("n"))

    def step(acc: Column, size: Column) -> Column:
        early = (acc["n"] > 0) & (acc["n"] + size > most)
        chunk, n = acc["chunk"] + early.cast("int"), F.when(early, size).otherwise(acc["n"] + size)
        done = n >= target
        return F.struct(F.concat(acc["at"], F.array(chunk)).alias("at"), (chunk + done.cast("int")).alias("chunk"), F.when(done, 0).otherwise(n).alias("n"))

    def finish(acc: Column) -> Column:
        last = F.element_at(acc["at"], -1)
        small = (acc["n"] > 0) & (acc["n"] < tail) & (last > 0)
        return F.when(small, F.transform(acc["at"], lambda c: F.when(c == last, last - 1).otherwise(c))).otherwise(acc["at"])

    return F.when(F.size(sizes) == 0, F.array().cast("array<int>")).otherwise(F.aggregate(sizes, start, step, finish))


def passages(paras: DataFrame, key: str, floor: int = 8, **limits: int) -> DataFrame:
    """(key, part, n_parts, text, n_words) of paragraphs (key, para, text), packed in order; chunks under `floor` words go."""
    own = paras.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("para", "text", n_words(F.col("text")).alias("n")))).alias("_p"))
    rows = own.withColumn("_at", packed_sizes(F.transform("_p", lambda p: p["n"]), **limits)).select(key, F.explode(F.arrays_zip("_p", "_at")).alias("z"))
    parts = rows.groupBy(key, F.col("z._at").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(F.col("z._p.para").alias("para"), F.col("z._p.text").alias("text")))).alias("_t"), F.sum("z._p.n").alias("n_words"))
    parts = parts.where(F.col("n_words") >= floor)
    part = F.row_number().over(Window.partitionBy(key).orderBy("chunk"))
    return parts.select(key, part.alias("part"), F.count("*").over(Window.partitionBy(key)).alias("n_parts"), F.array_join(F.transform("_t", lambda x: x["text"]), " ").alias("text"), "n_words")


def fixed_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 800, overlap: int = 100) -> DataFrame:
    """(key, chunk from 0, text, n_words) of sliding windows of words; one begins at every stride within the text."""
    stride = size - overlap
    own = docs.select(key, words(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.size("_w") - 1, F.lit(stride))
    rows = own.select(key, "_w", F.posexplode(starts).alias("chunk", "_s")).withColumn("_part", F.slice("_w", F.col("_s") + 1, F.lit(size)))
    return rows.select(key, "chunk", F.array_join("_part", " ").alias("text"), F.size("_part").alias("n_words"))


def rendered_table(rows: Column, caption: Column | None = None) -> Column:
    """A grid as sentences "header: value; ... ."; empty cells and rows go, values without a header stand alone, and a grid of one row is joined plainly."""
    kept = F.filter(rows, lambda r: F.exists(r, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    clean = lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit(""))))
    head = clean(F.element_at(kept, 1))
    pair = lambda h, c: F.when(F.coalesce(c, F.lit("")) == "", F.lit(None)).when(F.coalesce(h, F.lit("")) == "", c).otherwise(F.concat(h, F.lit(": "), c))
    one = lambda r: F.concat(F.array_join(F.array_compact(F.zip_with(head, clean(r), pair)), "; "), F.lit("."))
    body = F.array_join(F.transform(F.slice(kept, F.lit(2), F.size(kept)), one), " ")
    plain = F.when(F.size(kept) == 0, F.lit("")).when(F.size(kept) == 1, F.array_join(F.array_remove(head, ""), " ")).otherwise(body)
    return plain if caption is None else F.when(F.coalesce(caption, F.lit("")) != "", F.concat(caption, F.lit(". "), plain)).otherwise(plain)


def outside_boxes(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines (page, x, y) whose point lies in none of the page's closed boxes (page, x0, y0, x1, y1)."""
    # Boxes lie in the cells of a grid as wide as they are, to a power of two, so that a box has few cells and a place few boxes.
    level = F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).cast("double")))
    b = boxes.select(F.col("page").alias("_page"), "x0", "y0", "x1", "y1").where("x0 <= x1 AND y0 <= y1").distinct().withColumn("_level", F.coalesce(level, F.lit(0)).cast("int"))
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level")))
    b = b.withColumn("_cx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("_cy", F.explode(F.sequence(cell("y0"), cell("y1"))))
    places = lines.select("page", "x", "y").distinct().join(b.select(F.col("_page").alias("page"), "_level").distinct(), "page").withColumns({"_cx": cell("x"), "_cy": cell("y")})
    held = (places["page"] == b["_page"]) & (places["_level"] == b["_level"]) & (places["_cx"] == b["_cx"]) & (places["_cy"] == b["_cy"])
    inside = places.join(b, held & F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")), "left_semi").select("page", "x", "y").distinct()
    return lines.join(inside, ["page", "x", "y"], "left_anti").select(*lines.columns)


_MARKS = tuple((name, re.compile(pattern)) for name, pattern in LINE_CLASSES)
# What each heading clears besides the enumerators, as said in the survey of the format.
_CLEARS = {"chapter": (), "article": ("annex", "annex_title", "part", "section", "article_title"), "annex": ("chapter", "article", "article_title", "part", "section", "annex_title"), "part": ("section",), "section": ()}
CLAUSE_SCHEMA = "doc_id {kind}, ord int, clause_id string, kind string, path string, text string, page_start int, page_end int, n_words int"


def _title_like(line: str) -> bool:
    enumerator = any(pattern.match(line) for name, pattern in _MARKS if name in ("number", "alpha", "roman"))
    return len(line.split()) <= 18 and not line.endswith((".", ";", ":", ",")) and not enumerator


def clause_rows(pages: pd.DataFrame, min_words: int = 8) -> list[tuple]:
    """Clauses of one document's lines (page, ord, line), in order: (ord, clause_id, kind, path, text, page_start, page_end, n_words).

    The line after a chapter, article or annex is its title if it looks like one, whatever else it is. Text before the
    first article or annex is dropped. Repeated ids get #1, #2, ... before short clauses are filtered.
    """
    at: dict[str, str] = {}
    levels: dict[str, str] = {}
    labels: list[str] = []
    text: list[str] = []
    found: list[list] = []
    titled, begun = "", 0

    def flush(page: int) -> None:
        body, own = " ".join(" ".join(text).split()), list(labels)
        text.clear()
        labels.clear()
        if not body or not (at.get("annex") or at.get("article")):
            return
        marks = [f"({x})" for x in own]
        if at.get("annex"):
            kind, parts, path = "annex_section", ["Annex", at["annex"]], [f"Annex {at['annex']}"]
            if at.get("part"):
                parts.append(at["part"])
                path.append(f"Part {at['part']}")
            if at.get("section"):
                parts.append(f"S{at['section']}")
                path.append(f"Section {at['section']}")
        else:
            kind, parts, path = "article_paragraph", ["Art", at["article"]], [f"Article {at['article']}"]
            if at.get("chapter"):
                path.insert(0, f"Chapter {at['chapter']}")
        found.append([".".join([*parts, *own]), kind, " > ".join([*path, *marks]), body, begun, page])

    last = 0
    for page, line in zip(pages["page"], pages["line"], strict=True):
        line, last = line.strip(), page
        if not line:
            continue
        if titled:
            name, titled = titled, ""
            if _title_like(line):
                at[f"{name}_title"] = line
                continue
        mark, m = next(((name, m) for name, pattern in _MARKS if (m := pattern.match(line))), ("", None))
        if mark in _CLEARS:
            flush(page)
            levels.clear()
            for name in _CLEARS[mark]:
                at.pop(name, None)
            if mark == "chapter" and at.get("annex"):
                at.pop("section", None)
            at.pop(f"{mark}_title", None)
            at[mark] = m[1]
            titled = mark if mark in ("chapter", "article", "annex") else ""
        elif mark:
            flush(page)
            if mark == "number":
                levels.clear()
            if mark != "roman":
                levels[mark] = m[1]
            labels[:] = [levels[x] for x in ("number", "alpha") if x in levels] + [m[1]] * (mark == "roman")
            begun = page
            if m[2]:
                text.append(m[2])
        else:
            if not text:
                begun = page
            text.append(line)
    flush(last)
    seen: dict[str, int] = {}
    for row in found:
        seen[row[0]] = n = seen.get(row[0], -1) + 1
        row[0] += f"#{n}" if n else ""
    return [(i, *row, len(row[3].split())) for i, row in enumerate(found) if len(row[3].split()) >= min_words]


def clauses(lines: DataFrame, min_words: int = 8) -> DataFrame:
    """The clause hierarchy of lines (doc_id, page, ord, line): a state machine over one document's lines at a time."""
    kind = lines.schema["doc_id"].dataType.simpleString()

    def build(batch: pd.DataFrame) -> pd.DataFrame:
        rows = clause_rows(batch.sort_values(["page", "ord"]), min_words)
        out = pd.DataFrame(rows, columns=["ord", "clause_id", "kind", "path", "text", "page_start", "page_end", "n_words"])
        out.insert(0, "doc_id", batch["doc_id"].iloc[0])
        return out

    return lines.select("doc_id", "page", "ord", "line").groupBy("doc_id").applyInPandas(build, CLAUSE_SCHEMA.format(kind=kind))


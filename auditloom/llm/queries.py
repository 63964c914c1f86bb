"""The registered queries of the training-data operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_UPPER, table
from .exact_dedup import exact_groups
from .fingerprint import edited_fingerprints
from .html_extract import main_texts
from .jaccard_join import jaccard_classes
from .license_scan import PHRASES, TEMPLATES, license_scan, spans_of, template_tokens
from .ngram_lm import backoff_scores
from .packing import pack_documents
from .quality import fit, quality_scores
from .repeats import repeat_report
from .sampled_pieces import sampled_segmentations


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), words=4, ratio=(85, 100))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = sampled_segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "rank", "n_pieces", F.crc32("ids").alias("ids_crc32"), "log_prob", "perturbed", "log_inclusion")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_scores(documents, fit(documents, table(spark, sf_dir, "labels")))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_imatch": op4_imatch,
        "op5_sampled_pieces": op5_sampled_pieces,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_stupid_backoff": op7_stupid_backoff,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_html_extraction": op9_html_extraction,
        "op10_license_scan": op10_license_scan,
    }


#: Columns of SQL texts: A-Z lower-cased, and the words that ASCII white space parts.
_LOWER = f"translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_UPPER.lower()}')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"


def _license_sql() -> str:
    """The license scan: phrases at their places, and for each template the most of its words within a run of its span."""
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in PHRASES.items())
    tokens = template_tokens(TEMPLATES)
    need = {label: math.ceil(0.9 * len(t) - 1e-9) for label, t in tokens.items()}
    words = ", ".join(f"('{label}', '{w}')" for label, t in tokens.items() for w in t)
    sizes = ", ".join(f"('{label}', {len(t)}, {need[label]}, {spans_of(TEMPLATES)[label]})" for label, t in tokens.items())
    return rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        phrases(p, label) AS (VALUES {phrases}), words(label, word) AS (VALUES {words}), sizes(label, n, need, span) AS (VALUES {sizes}),
        places AS (
            SELECT doc_id, label, k FROM (SELECT doc_id, w, unnest(range(len(w))) AS k FROM d), phrases
            WHERE w[k + 1 : k + len(p)] = p
        ),
        base AS (
            SELECT doc_id, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY doc_id
        ),
        marks AS (
            SELECT doc_id, label, word, k FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS k FROM d) JOIN words USING (word)
        ),
        likely AS (SELECT doc_id, label FROM marks JOIN sizes USING (label) GROUP BY doc_id, label HAVING count(DISTINCT word) >= any_value(need)),
        runs AS (
            SELECT a.doc_id, a.label, a.k, count(DISTINCT b.word) AS held FROM marks a JOIN likely USING (doc_id, label) JOIN sizes USING (label)
            JOIN marks b ON b.doc_id = a.doc_id AND b.label = a.label AND b.k >= a.k AND b.k < a.k + span GROUP BY a.doc_id, a.label, a.k
        ),
        found AS (SELECT doc_id, label, max(held) / any_value(n) AS c FROM runs JOIN sizes USING (label) GROUP BY doc_id, label HAVING max(held) >= any_value(need)),
        more AS (SELECT doc_id, list(label) AS labels, max(c) AS c FROM found GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
               coalesce(array_to_string(base.labels, ','), '') AS base_labels,
               array_to_string(list_sort(list_distinct(coalesce(base.labels, []) || coalesce(more.labels, []))), ',') AS labels,
               CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
        FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard_join": rf"""
            WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
            s AS (
                SELECT DISTINCT doc_id, array_to_string(w[k : k + 3], ' ') AS s
                FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS k FROM d)
            ),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
            links AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * both_ >= 85 * (p.n + q.n - both_)),
            reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
            SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(y) AS component_id
            FROM documents JOIN reach ON x = doc_id LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
        "op3_suffix_dedup": r"""
            WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
            w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS k FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 99)) AS s FROM d)),
            again AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
            cut AS (SELECT doc_id, s, s > coalesce(max(s + 100) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS opens FROM again),
            run AS (SELECT doc_id, s, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM cut),
            spans AS (SELECT doc_id, r, min(s) AS a, max(s) + 100 AS b FROM run GROUP BY doc_id, r),
            kept AS (
                SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before_ FROM (
                    SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, len(h) // 2, len(h) // 2 + 1 FROM d)
            )
            SELECT d.doc_id, (any_value(len(h)) // 2)::BIGINT AS n_bytes, sum(least(b, len(h) // 2) - a)::BIGINT AS n_removed, (count(*) - 1)::BIGINT AS n_spans,
                   sha256(unhex(string_agg(substr(h, 2 * before_ + 1, 2 * (a - before_)), '' ORDER BY a))) AS kept_sha256
            FROM d JOIN kept USING (doc_id) GROUP BY d.doc_id""",
        "op6_exact_dedup": r"""
            WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
            FROM n WINDOW w AS (PARTITION BY t)""",
        "op7_stupid_backoff": rf"""
            WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
            e AS (SELECT doc_id, k, w[k] AS x, CASE WHEN k > 1 THEN w[k - 1] END AS b FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
            one AS (SELECT x, count(*) AS c FROM e GROUP BY x), two AS (SELECT b, x, count(*) AS c FROM e WHERE b IS NOT NULL GROUP BY b, x),
            mine AS (SELECT doc_id, x, count(*) AS m FROM e GROUP BY doc_id, x), pair AS (SELECT doc_id, b, x, count(*) AS m FROM e WHERE b IS NOT NULL GROUP BY doc_id, b, x),
            total AS (SELECT count(*) AS n FROM e),
            c AS (
                SELECT e.doc_id, one.c - mine.m AS cx, before_.c - own.m AS cb, two.c - pair.m AS c2, greatest(1, (SELECT n FROM total) - len(d.w)) AS size
                FROM e JOIN d USING (doc_id) JOIN one USING (x) JOIN mine ON mine.doc_id = e.doc_id AND mine.x = e.x
                LEFT JOIN two ON two.b = e.b AND two.x = e.x LEFT JOIN pair ON pair.doc_id = e.doc_id AND pair.b = e.b AND pair.x = e.x
                LEFT JOIN one before_ ON before_.x = e.b LEFT JOIN mine own ON own.doc_id = e.doc_id AND own.x = e.b
            ),
            s AS (
                SELECT doc_id, CASE WHEN cx > 0 THEN cx ELSE 0.4 END / size AS p, c2, cb FROM c
            ),
            t AS (SELECT doc_id, sum(ln(CASE WHEN c2 IS NULL THEN p WHEN c2 > 0 AND cb > 0 THEN least(1.0::DOUBLE, c2::DOUBLE / cb) ELSE 0.4 * p END)) AS score FROM s GROUP BY doc_id)
            SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(score, 0)::DOUBLE AS score, score / nullif(len(w), 0) AS mean_score FROM d LEFT JOIN t USING (doc_id)""",
        "op10_license_scan": _license_sql(),
    }

"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that documents use for bullets, and the one they become.
BAD_BULLETS, BULLET = "\ufffd\uf0a7\uf0b7", "\u2022"
# Instructions smuggled into a document, by the phrase that gives each away, and what replaces them.
INJECTIONS = (
    r"ignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions?",
    r"disregard\s+(?:all\s+)?(?:previous|prior|above)",
    r"you\s+are\s+now\s+(?:a|an)\s+",
    r"new\s+(?:system\s+)?(?:instructions?|prompt)\s*:",
    r"</?(?:system|assistant|user)>",
    r"\[\s*(?:system|INST)\s*\]",
    r"forget\s+(?:everything|all)\s+(?:you|above)",
    r"do\s+not\s+report\s+(?:any\s+)?(?:violations?|findings?|issues?)",
    r"return\s+(?:an\s+)?empty\s+(?:list|array|findings)",
)
MARKER = "[redacted: instruction-like text in source document]"
_SPACE = r"(?U)\s+"


def words(text: Column) -> Column:
    """Words between Unicode white space; none in an empty or null text."""
    return F.array_remove(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, " "), " "), "")


def n_words(text: Column) -> Column:
    return F.size(words(text))


def tokens(text: Column) -> Column:
    """Lower-case ASCII alphanumerics."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def normalised(text: Column) -> Column:
    """No soft hyphens, plain spaces, words parted at a line's hyphen joined again, single spaces, trimmed."""
    plain = F.translate(F.regexp_replace(text, "\u00ad", ""), "\u00a0", " ")
    return squeezed(F.regexp_replace(plain, r"(?U)(\w)-\s+(\w)", "$1-$2"))


def repaired_bullets(text: Column) -> Column:
    return F.translate(text, BAD_BULLETS, BULLET * len(BAD_BULLETS))


def clip_words(text: Column, most: int) -> Column:
    """The first `most` words and how many were left out, or the text itself."""
    own = words(text)
    return F.when(F.size(own) > most, F.concat(F.array_join(F.slice(own, 1, most), " "), F.lit(" [... "), (F.size(own) - most).cast("string"), F.lit(" words omitted]"))).otherwise(text)


def clip_chars(text: Column, most: int) -> Column:
    """At most `most` characters, with an ellipsis where some were left out."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("\u2026"))).otherwise(text)


def query_text(text: Column, title: Column, use_title: bool = True) -> Column:
    """The query of a passage: its text, after its title if there is one."""
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit(". "), text)).otherwise(text) if use_title else text


def first_words(text: Column, most: int = 100) -> Column:
    return F.array_join(F.slice(words(text), 1, most), " ")


def sanitised(text: Column) -> tuple[Column, Column]:
    """The text with smuggled instructions replaced by a marker, and those removed, in order."""
    pattern = "(?i)(" + "|".join(INJECTIONS) + ")"
    return F.regexp_replace(text, pattern, F.lit(MARKER)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def sha_key(text: Column) -> Column:
    """The first 12 hexadecimal digits of the SHA-1."""
    return F.substring(F.sha1(text), 1, 12)


def point_id(key: Column) -> Column:
    """A 63-bit integer from the first 8 bytes of the SHA-1."""
    return F.shiftrightunsigned(F.conv(F.substring(F.sha1(key), 1, 16), 16, -10).cast("long"), 1)


def html_escaped(text: Column) -> Column:
    # HTML's five special characters and their references.
    for char, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(reference))
    return text


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """The literal first occurrence of `old` replaced; the text itself where there is none or `old` is empty."""
    at = F.call_function("instr", text, old)
    return F.when((at > 0) & (F.length(old) > 0), F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))).otherwise(text)


def estimated_tokens(text: Column) -> Column:
    """A third of the characters, rounded down, and 128."""
    return F.floor(F.length(text) / 3) + 128


# Line classes, in the order in which they are tried.
LINE_CLASSES = (
    ("chapter", r"^CHAPTER\s+([IVXL]+)$"),
    ("article", r"^Article\s+(\d+)$"),
    ("annex", r"^ANNEX\s+([IVXL]+)$"),
    ("part", r"^PART\s+([A-Z])$"),
    ("section", r"^SECTION\s+(\d+)$"),
    ("number", r"^(\d+)\.\s+(.*)$"),
    ("alpha", r"^\(([a-z])\)\s+(.*)$"),
    ("roman", r"^\(([ivx]+)\)\s+(.*)$"),
)
ENUMERATORS = "|".join(pattern for name, pattern in LINE_CLASSES if name in ("number", "alpha", "roman"))
# Phrases, lines and shares by which a page is front matter.
FRONT_MATTER = (
    "table of contents", "list of tables", "list of figures", "list of abbreviation", "abbreviations and definitions", "revision history", "document history", "glossary of terms", "list of acronym",
)
LEADER_LINE = r"(?:\.{4,}\s*\d{1,4}\s*$|\s{3,}\d{1,4}\s*$)"
ACRONYM_LINE = r"^[A-Za-z][A-Za-z0-9&/]{1,9}\s{1,4}[A-Z(]"
# What begins a paragraph within a section.
PARAGRAPH_START = r"^([•\-\*]|\(?[a-z0-9]{1,3}[.)])\s+"


def line_class(line: Column) -> tuple[Column, Column]:
    """Class of a trimmed line and what its pattern captures first; body and empty where none fits."""
    kind, captured = F.lit("body"), F.lit("")
    for name, pattern in reversed(LINE_CLASSES):
        kind = F.when(F.rlike(line, F.lit(pattern)), F.lit(name)).otherwise(kind)
        captured = F.when(F.rlike(line, F.lit(pattern)), F.regexp_extract(line, pattern, 1)).otherwise(captured)
    return kind, captured


def looks_like_title(line: Column) -> Column:
    """Not empty, at most 18 words, no closing punctuation, no enumerator; of a trimmed line."""
    return (line != "") & (n_words(line) <= 18) & ~F.rlike(line, F.lit(r"[.;:,]$")) & ~F.rlike(line, F.lit(ENUMERATORS))


def looks_like_front_matter(text: Column) -> Column:
    """Blank, under 40 words, a marker phrase, or mostly contents or acronym lines."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    share = lambda pattern: F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(pattern))))
    marker = F.rlike(F.lower(F.coalesce(text, F.lit(""))), F.lit("|".join(FRONT_MATTER)))
    return (n_words(text) < 40) | marker | (share(LEADER_LINE) > 0.35 * F.size(lines)) | (share(ACRONYM_LINE) > 0.5 * F.size(lines))

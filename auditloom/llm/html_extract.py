"""Main text of web pages by equivalence-class template deduction.

Tokens are tags with the path that leads to them, and strings of text with theirs. Across the different pages of one
host, tokens with one occurrence vector (how often on which page) are an equivalence class. A class of several tokens that
stand on enough of the host's pages is valid; the tags of valid classes nest by their paths into the host's template, and
their strings are its boilerplate. What the template leaves open are slots, each under the deepest template tag around it.

The slots' text, over all pages of the host, decides: the deepest template tag that holds most of it is the article, under
whatever name; slots elsewhere that are mostly links are menus. The names of tags and classes decide what this leaves
undecided: asides within the article, small slots beside it, and hosts of too few pages for a template.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, frugal, small_batches, written

# HTML elements by their part in a page.
RAW = "script|style|textarea|iframe"
HIDDEN = set("noscript template svg select object".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main"
    " menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
ASIDE_TAGS = set("nav footer aside form head button dialog menu title".split())
# Words of class, id and role attributes that mark what is not the article.
ASIDE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget footer header"
    " masthead cookie cookies consent gdpr notice notices alert comment comments commentlist reply replies disqus discussion respond related recommended share sharing social subscribe"
    " newsletter signup popup modal overlay pagination pager skip hidden login search toolbar copyright complementary contentinfo".split()
)

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S | re.I)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Block(NamedTuple):
    """Path, depth of the outermost element that is aside by its name (0: none), and text; how many of its characters are links."""

    path: str
    aside: int
    text: str
    linked: int


class Open(NamedTuple):
    """An open element: its path (None: hidden) and depth, the depth of an aside, whether it is in an article and in a link."""

    name: str
    path: str | None
    depth: int
    aside: int
    article: bool
    link: bool


_ROOT = Open("", "", 0, 0, False, False)


def blocks_of(page: str) -> Iterator[Block]:
    """The blocks of text in page order.

    Entities are decoded and white space is one space; blocks without text are left out. A new block ends an open
    paragraph; an end tag closes what was left open within its element; line breaks are white space. Raw elements are
    skipped up to their end tag; hidden ones by nesting, and they end with the element around them at the latest.
    """
    stack: list[Open] = []
    text: list[str] = []
    linked = 0

    def ended() -> Iterator[Block]:
        nonlocal linked
        if text:
            plain = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if plain:
                at = next((x for x in reversed(stack) if x.name in BLOCK and x.path is not None), _ROOT)
                yield Block(at.path or "", stack[-1].aside if stack else 0, plain, min(linked, len(plain)))
            linked = 0

    for m in _TOKEN.finditer(page):
        name, above = m[3], stack[-1] if stack else _ROOT
        if name is None:
            if m[0][0] != "<" or m[0] == "<":
                if above.path is not None:
                    text.append(m[0])
                    linked += len(m[0]) * above.link
            elif m[1]:
                text.append(" ")
            continue
        name = name.lower()
        if above.path is None or not m[2] and name in HIDDEN:
            # A hidden element has the path None, and so has what is in it.
            if not m[2]:
                if name not in VOID and not (m[4] or "").rstrip().endswith("/"):
                    stack.append(above._replace(name=name, path=None))
                text.append(" ")
                continue
            inner = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name), None)
            if inner is None or stack[inner].path is None:
                if inner is not None:
                    del stack[inner:]
                continue
        if m[2]:
            if any(x.name == name for x in stack):
                if name in BLOCK or any(x.name in BLOCK for x in stack[max(k for k, x in enumerate(stack) if x.name == name) :]):
                    yield from ended()
                while stack.pop().name != name:
                    pass
            elif name in ("p", "br"):
                yield from ended()
            continue
        if name in VOID:
            if name == "hr":
                yield from ended()
            elif name == "br":
                text.append(" ")
            continue
        if name in BLOCK:
            yield from ended()
            last = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].name == "p" or name in ("li", "dt", "dd", "tr", "td", "th") and stack[k].name == name), None)
            if last is not None and (stack[last].name == "p" or not any(x.name in ("ul", "ol", "dl", "table") for x in stack[last:])):
                del stack[last:]
        above = stack[-1] if stack else _ROOT
        names = {w for x in _NAMES.finditer(m[4] or "") for w in re.split(r"[^a-z0-9]+", (x[2] or x[3] or x[4] or "").lower())} - {""}
        if m[4] and m[4].rstrip().endswith("/") and name not in BLOCK:
            continue
        named = name in ASIDE_TAGS or name == "header" and not above.article or bool(names & ASIDE_NAMES)
        aside = above.aside or (above.depth + 1) * named
        label = name + "".join(f".{x}" for x in sorted(names))
        stack.append(Open(name, f"{above.path}/{label}", above.depth + 1, aside, above.article or (name == "article" or "article" in names) and not aside, above.link or name == "a"))
    yield from ended()


def string_key(path: str, text: str) -> int:
    """A string of text and where it stands, as a signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest(f"{path} {text}") - (1 << 63)


def page_tokens(page: str) -> dict[tuple[str, int], list[int]]:
    """Count, and characters of text, of text not aside and of links, of each token: (path, 0) for a tag on the way to a block, ("", key) for a string."""
    found: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    for path, aside, text, linked in blocks_of(page):
        parts = path.split("/")
        for k in range(2, len(parts) + 1):
            tag = found["/".join(parts[:k]), 0]
            tag[0] += k == len(parts)
            tag[1] += len(text)
            tag[2] += len(text) * (not aside)
            tag[3] += linked
        found["", string_key(path, text)][0] += 1
    return found


class Template(NamedTuple):
    """A host's own strings, the path of its article, and the paths of its menus."""

    constant: frozenset[int] = frozenset()
    article: str = ""
    menus: frozenset[str] = frozenset()


def within(path: str, paths: frozenset[str]) -> bool:
    """Whether one of the paths leads to this one."""
    return bool(paths) and any(path[: k] in paths for k in (*(i for i, c in enumerate(path) if c == "/" and i), len(path)))


def extract(page: str | None, template: Template) -> str:
    """The text that the template leaves open, two line ends between any two blocks.

    In the article all is taken but what is aside below it, elsewhere all but menus and what is aside; a slot is what the
    template leaves open, and a page may fill several. Strings of the template itself go, unless nothing else is left.
    """
    own, rest, article = [], [], template.article
    depth = article.count("/")
    for path, aside, text, _ in blocks_of(page or ""):
        if article and (path == article or path.startswith(article + "/")):
            taken = aside <= depth
        else:
            taken = not aside and not within(path, template.menus)
        if taken:
            (rest if template.constant and string_key(path, text) in template.constant else own).append(text)
    return "\n\n".join(own or rest)


def templates(rows: DataFrame, share: float = 0.5, constant_share: float = 0.9, support: int = 3, most: float = 0.5, links: float = 0.6, named: float = 0.2) -> DataFrame:
    """host, constant, article and menus, of rows (_host, _html): what Template has. Written.

    A token's occurrence vector is kept as a combined hash of page and count, which tasks combine, so that a hot host
    costs each task one row a token; equal pages count once. A class is valid if it has several tokens and stands on
    `support` pages and on `share` of the host's. Its strings are boilerplate on `constant_share` of the pages. The article
    is the deepest tag of a valid class with more than the share `most` of the text that is neither link nor aside by name,
    or, where that is less than the share `named` of all text, of all text but links. Menus are tags of valid classes neither
    around nor in the article of whose text more than the share `links` is links. A host's template has at most (mean
    tokens a page) / share tokens.
    """

    @frugal
    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for host, page in zip(batch["_host"], batch["_html"], strict=True):
                key = xxhash.xxh3_64_intdigest(page) - (1 << 63)
                out.append((host, key, "", 0, 1, 0, 0, 0))
                out += [(host, key, path, text, *n) for (path, text), n in page_tokens(page).items()]
            yield pd.DataFrame(out, columns=["_host", "_page", "path", "text", "n", "chars", "plain", "linked"])

    found = rows.mapInPandas(tokens, "_host string, _page long, path string, text long, n long, chars long, plain long, linked long").distinct()
    vector = found.groupBy("_host", "path", "text").agg(
        F.bit_xor(F.xxhash64("_page", "n")).alias("vector"), F.count("*").alias("pages"), *(F.sum(c).alias(c) for c in ("chars", "plain", "linked"))
    )
    # Strings of fewer pages are no template; what is left is written, so that the pages are read once.
    vector = written(vector.where((F.col("pages") >= support) | (F.col("path") == "") & (F.col("text") == 0)))
    hosts = vector.where("path = '' AND text = 0").select(F.col("_host").alias("_h"), F.col("pages").alias("of"))
    large = vector.where("path <> '' OR text <> 0").join(hosts, F.col("_host") == F.col("_h")).where((F.col("pages") >= share * F.col("of")) & (F.col("pages") >= support))
    classes = large.groupBy(F.col("_host").alias("_h"), F.col("vector").alias("_v"), F.col("pages").alias("_p")).agg(F.count("*").alias("_size")).where("_size > 1")
    same = (large["_host"] == classes["_h"]) & (large["vector"] == classes["_v"]) & (large["pages"] == classes["_p"])
    valid = large.join(classes, same, "left_semi")
    # The whole text of a host is that of its outermost tags, whether valid or not.
    outer = vector.where((F.col("text") == 0) & (F.col("path") != "") & (F.instr(F.substring("path", 2, 1 << 20), "/") == 0))
    sums = outer.groupBy(F.col("_host").alias("_h")).agg(F.sum("chars").alias("_chars"), F.sum("plain").alias("_plain"), F.sum("linked").alias("_linked"))
    tag, is_tag = F.struct("path", "chars", "plain", "linked"), F.col("text") == 0
    deduced = valid.groupBy("_host").agg(
        F.sort_array(F.collect_set(F.when(~is_tag & (F.col("pages") >= constant_share * F.col("of")), F.col("text")))).alias("constant"),
        F.collect_list(F.when(is_tag, tag)).alias("_tags"),
    ).join(sums, F.col("_host") == F.col("_h"), "left")
    by_name = F.col("_plain") >= named * F.col("_chars")
    own = lambda t: F.when(by_name, t["plain"]).otherwise(t["chars"] - t["linked"])
    whole = F.when(by_name, F.col("_plain")).otherwise(F.col("_chars") - F.col("_linked"))
    held = F.filter("_tags", lambda t: own(t) > most * whole)
    # Of nested tags the deepest has the longest path.
    longest = F.array_max(F.transform(held, lambda t: F.struct(F.length(t["path"]).alias("n"), t["path"].alias("path"))))["path"]
    deduced = deduced.withColumn("article", F.coalesce(longest, F.lit("")))
    apart = lambda t: ~F.startswith(F.concat("article", F.lit("/")), F.concat(t["path"], F.lit("/"))) & ~F.startswith(F.concat(t["path"], F.lit("/")), F.concat("article", F.lit("/")))
    menus = F.transform(F.filter("_tags", lambda t: apart(t) & (F.col("article") != "") & (t["linked"] > links * t["chars"])), lambda t: t["path"])
    out = written(deduced.select("_host", "constant", "article", menus.alias("menus")))
    drop_written(vector)
    return out


def main_texts(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text of the article and n_chars (code points).

    Null or empty html, and html without text, give the empty text. Pages whose address has no host are one host of
    their own. Repeated rows give equal results and count once for the template. Hosts of too few different pages have no
    template; of their pages all that is not aside is kept. Other columns are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    small_batches(df)
    # The id goes as text, as pandas would round integers beside a null.
    rows = df.select(F.col(id_col).cast("string").alias("_id"), F.col(url_col).alias("url"), F.col(html_col).alias("_html"), host.alias("_host"))
    deduced = templates(rows.where(F.col("_html").isNotNull()).select("_host", "_html"))
    deduced = deduced.select(F.col("_host").alias("_of"), "constant", "article", "menus")

    @frugal
    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, known = [], {}
            for of, page, constant, article, menus in zip(batch["_of"], batch["_html"], batch["constant"], batch["article"], batch["menus"], strict=True):
                if of not in known:
                    known[of] = Template() if of is None else Template(frozenset(constant), article, frozenset(menus))
                own.append(extract(page, known[of]))
            yield pd.DataFrame({"_id": batch["_id"], "url": batch["url"], "text": own, "n_chars": [len(x) for x in own]})

    # Templates are a table of known size: small ones are broadcast, others joined, and a hot host's pages may be split.
    joined = rows.join(deduced, F.col("_host") == F.col("_of"), "left").select("_id", "url", "_html", "_of", "constant", "article", "menus")
    out = joined.mapInPandas(texts, "_id string, url string, text string, n_chars long")
    return out.select(F.col("_id").cast(df.schema[id_col].dataType).alias(id_col), "url", "text", "n_chars")

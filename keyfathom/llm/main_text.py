"""Main text of web pages by template deduction over the pages of a host.

Tokens of a page are its tags, told apart by their place in the tree, and its text blocks.  Tokens
with the same occurrence vector over a host's pages form an equivalence class; the classes that are
large and on nearly every page are the template.  Copies of a page are one page there: what only they
share is their article.  Its tokens have one order; text of the template
that stands in its place on a page is dropped, and what the remaining slots of the article hold is
the main text.  Vectors are compared by their support and a commutative hash, so a class needs
no list of pages and a host with a third of all pages is counted like any other.
"""

from __future__ import annotations

import html as entities
import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyfathom.llm.common import stage

#: A template token is on this share of a host's pages; a class has so many tokens; a host so many distinct pages.
SUPPORT, LEAST_TOKENS, LEAST_PAGES = 0.9, 3, 5
#: Counted tokens a task holds before it passes them on.
HELD_TOKENS = 100_000

# Fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section
summary table tbody td tfoot th thead tr ul""".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}, "body": {"head"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
             "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = set("table td th ul ol dl menu html body".split())
# Elements and names that are no part of an article.
NOISE_TAGS = set("nav footer aside form menu dialog head button select svg canvas object audio video map search".split())
NOISE_NAMES = set("""ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments
commentlist consent cookie cookies copyright disqus footer gdpr header login masthead menu modal nav navbar navigation
newsletter notice notices notification overlay paywall pagination popup promo promoted promotion related respond search share
sharing sidebar signup social sponsor sponsored subscribe subscription toolbar toc widget widgets""".split())
# The names that name no part of an article, where they stand in a class inside one.
ARTICLE_NOISE = set("""ad ads advert adverts advertisement advertising adsense commentlist comments disqus navbar newsletter
pagination promo promoted sidebar sponsored""".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup header".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|--!>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<[!?/][^>]*(?:>|\Z)"
                    r"|<[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


class Block(NamedTuple):
    """A run of text without a block border: its token, its place in the page, whether it is noise."""
    text: str
    token: int
    noise: bool
    article: bool


class Page(NamedTuple):
    blocks: list[Block]
    tokens: list[int]  # of tags and text blocks in page order


def _noise(tag: str, raw: str, in_article: bool) -> bool:
    if tag in NOISE_TAGS or (tag == "header" and not in_article):
        return True
    if not raw or raw.isspace():
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in NOISE_ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    if in_article:
        # Ids are anchors of sections there, and other names belong to its parts; the template's classes decide.
        return tag not in HEADINGS and not ARTICLE_NOISE.isdisjoint(
            n.lower() for n in _NAME.findall(found.get("class", "")))
    names = f"{found.get('class', '')} {found.get('id', '')}"
    return not NOISE_NAMES.isdisjoint(n.lower() for n in _NAME.findall(names))


def read_page(html: str) -> Page:
    """Blocks and tokens of a page, read tolerantly: what is left open ends with the page."""
    blocks: list[Block] = []
    tokens: list[int] = []
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]  # tag, noise, in article, hash of the path
    parts: list[str] = []
    at = 0

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                _, noise, article, path = stack[-1]
                token = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), path) >> 1
                tokens.append(token)
                blocks.append(Block(text, token, noise, article))

    def close(k: int) -> None:
        if any(entry[0] in BLOCKS for entry in stack[k:]):
            flush()
        del stack[k:]

    size = len(html)
    while at < size:
        found = _TOKEN.search(html, at)
        if not found:
            parts.append(html[at:])
            break
        if found.start() > at:
            parts.append(html[at:found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if tag == "p" and all(entry[0] != "p" for entry in stack):
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in ("td", "th", "table") and tag not in BLOCKS:
                    break
            continue
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
            continue
        if tag in BLOCKS:
            flush()
            closed = CLOSED_BY.get(tag, ())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in closed or (stack[k][0] == "p" and tag not in ("body", "html")):
                    close(k)
                elif stack[k][0] in SCOPE:
                    break
        _, noise, article, path = stack[-1]
        path = xxhash.xxh3_64_intdigest(f"{tag}{found[3].strip()}" if tag in ("div", "section", "span") else tag, path) >> 1
        if tag in BLOCKS:
            tokens.append(path)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else size
            continue
        noise = noise or _noise(tag, found[3], article)
        stack.append((tag, noise, article or tag in ("article", "main"), path))
    flush()
    return Page(blocks, tokens)


STATS = "host string, token long, pages long, total long, vector long, places double"


def token_stats(pages: DataFrame) -> DataFrame:
    """(host, token) with support, occurrences, hash of the occurrence vector and mean place, summed in each task first.

    Token 0 stands for the page itself.  Pages of a host with the same tokens count once.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [struct.pack(f"<{len(t)}q", *t) for t in (read_page(html.as_py() or "").tokens for html in batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([xxhash.xxh3_128_digest(b) for b in bodies], pa.binary()),
                 pa.array(bodies, pa.binary())], names=["host", "page", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def rows() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            columns = list(zip(*((*k, *v) for k, v in held.items()), strict=True)) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                              names=STATS.replace(",", "").split()[::2])

        for batch in batches:
            for host, name, body in zip(*batch.columns, strict=True):
                host, name = host.as_py(), name.as_py()
                tokens = struct.unpack(f"<{len(body.as_py()) // 8}q", body.as_py())
                counts: dict[int, list] = {0: [1, 0.0]}
                for k, token in enumerate(tokens):
                    if token in counts:
                        counts[token][0] += 1
                    else:
                        counts[token] = [1, k / len(tokens)]
                for token, (n, place) in counts.items():
                    mark = xxhash.xxh3_64_intdigest(name + n.to_bytes(8, "little")) >> 1
                    if (entry := held.get((host, token))) is None:
                        held[host, token] = [1, n, mark, place]
                    else:
                        entry[0] += 1
                        entry[1] += n
                        entry[2] ^= mark
                        entry[3] += place
                if len(held) > HELD_TOKENS:
                    yield rows()
                    held.clear()
        yield rows()

    # Copies go within each task first, so that many of them do not meet in one.
    distinct = pages.select("host", "html").mapInArrow(read, "host string, page binary, tokens binary").groupBy(
        "host", "page").agg(F.first("tokens").alias("tokens"))
    parts = distinct.mapInArrow(run, STATS)
    return parts.groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.bit_xor("vector").alias("vector"),
        F.sum("places").alias("places"))


def templates(stats: DataFrame) -> DataFrame:
    """(host, template): the tokens of the large and frequent classes in their mean order.

    As each is on nearly every page of the host, a template is no longer than a page.
    """
    hosts = stats.where("token = 0").select("host", F.col("pages").alias("host_pages"))
    frequent = stats.where("token <> 0").join(hosts, "host").where(
        (F.col("host_pages") >= LEAST_PAGES) & (F.col("pages") >= SUPPORT * F.col("host_pages")))
    alike = Window.partitionBy("host", "pages", "total", "vector")
    large = frequent.withColumn("size", F.count(F.lit(1)).over(alike)).where(F.col("size") >= LEAST_TOKENS)
    order = F.sort_array(F.collect_list(F.struct((F.col("places") / F.col("pages")).alias("place"), "token")))
    return large.groupBy("host").agg(F.transform(order, lambda x: x["token"]).alias("template"))


def slot_text(page: Page, template: dict[int, int]) -> str:
    """Text of the slots: no noise, no text of the template where the template has it.

    A template token is in its place if those before and after it on the page come in the
    template's order too.  With an article or main element on the page, only its blocks count.
    """
    places = [template.get(t, -1) for t in page.tokens]
    met = [(k, p) for k, p in enumerate(places) if p >= 0]
    in_place = {page.tokens[k] for i, (k, p) in enumerate(met)
                if (i == 0 or met[i - 1][1] <= p) and (i + 1 == len(met) or p <= met[i + 1][1])}
    article = any(b.article for b in page.blocks)
    return "\n".join(b.text for b in page.blocks
                     if not b.noise and (b.article or not article) and b.token not in in_place)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    A null or empty page has an empty text; a null url belongs to no host and has no template, nor have
    hosts with few distinct pages; there the tree alone decides.  Copies all get their text, but count once
    for the template; null ids are carried along.  Nothing is capped; an empty table gives no rows.
    """
    host = F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"), F.coalesce(host, F.lit("")).alias("host"))
    made = stage(templates(stage(token_stats(rows.where("host <> ''")), "page-tokens")), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[int, int]] = {}
        for batch in batches:
            texts = []
            for host, html, template in zip(*batch.columns[2:], strict=True):
                host = host.as_py()
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = {t: k for k, t in enumerate(template.as_py() or ())}
                texts.append(slot_text(read_page(html.as_py() or ""), known[host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.join(made, "host", "left").select("page_id", "url", "host", "html", "template").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long")

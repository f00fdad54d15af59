"""Main text of web pages: a host-wide suffix array over the page token streams, then the page's own structure.

A page is cut into blocks of text; the tokens of all its blocks, articles included, form the page's stream. The streams are concatenated and their
suffixes sorted host by host (prefix doubling, to a depth of RUN tokens); neighbours that share RUN tokens and lie on distinct pages show a substring
that the host repeats. Windows of RUN tokens overlap, so longer repeats are covered whole. What enough pages of the host repeat, LEAST_PAGES of them and LEAST_SHARE of all, is boilerplate: blocks
that it covers whole go. Unique runs stay, and so does a block that only quotes: nothing is cut out of a sentence.

What the page's structure says follows as a check. Blocks of menus, headers, footers, sidebars, notices, adverts, forms and reader comments go whole, unique or
not. Plain blocks of an article stay whole, for articles may quote each other; inside an article the repeats decide about blocks whose own element bears a class or an
id. Outside of both they decide alone. Pages of one host with equal text are mirrors of one page and
count once, and a page with next to nothing of its own is a near copy and keeps its text.

The suffix array of a host is held in parts: each task sorts the suffixes of its own pages and hands on each one's RUN-token prefix as a 128-bit digest that the host is
part of; the parts are merged by digest, each with the number of distinct pages that have it. Pairs of digest and page are made distinct in each task before anything moves, so a host with a third of
all pages is never one group. Digests that no token to be decided has are held back by a bitmap of fixed size.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.tables import bitmap_filter, by_slices
from codequarry.storage import discard, keep

#: tokens that a repeated substring has at least
RUN = 8
#: distinct pages of a host, and the share of its pages, that repeat a substring of boilerplate at least
LEAST_PAGES = 3
LEAST_SHARE = 0.1
#: kinds of blocks: plain ones of an article; of an article, with a class or an id of their own; of neither; of what is not the article
CONTENT, MARKED, OPEN, BOILER = "c", "m", "o", "b"
#: the share of its tokens that a page has for itself, unless it is a near copy
LEAST_OWN = 0.2
#: covered tokens are broadcast up to this size, else joined
MOST_BROADCAST = 16 << 20
#: an open element that rules out what it holds, articles included: comments, sidebars, footers, forms
_FIRM = "x"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|object|canvas|audio|video|select|textarea|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-z][^\s/>]*+)(?P<attrs2>[^>]*+)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
# fixed values: HTML elements by their part in a page
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SCOPES = frozenset("article main nav header footer aside form".split())
_CONTAINERS = _SCOPES | frozenset("body div section ul ol dl table figure fieldset dialog menu details blockquote button head".split())
_DROPPED = frozenset("nav header footer aside form menu dialog button head".split())
# fixed values: words in class, id or role that mark what is not the article
_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog discussion disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion related respond search share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
_WRAPPERS = frozenset("article body container content entry has layout main no page post row site with without wrap wrapper".split())
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _hinted(attrs: str, in_article: bool) -> bool:
    """Whether an element's attributes mark it as something other than article text."""
    if _HIDDEN.search(attrs):
        return True
    words = {w.lower() for value in _NAMED.findall(attrs) for w in _WORD.findall(value)}
    if in_article:
        words -= {"header", "banner"}
    return bool(words & _HINTS) and not words & _WRAPPERS


def _own_mark(attrs: str) -> bool:
    """Whether attributes name an element by class or id, other than as a wrapper."""
    words = {w.lower() for value in _NAMED.findall(attrs) for w in _WORD.findall(value)}
    return bool(words) and not words & _WRAPPERS


def blocks(html: str | None) -> list[tuple[str, str]]:
    """(kind, text) of the page's blocks in order: character references decoded, white space runs as one space; empty blocks left out."""
    out: list[tuple[str, str]] = []
    held: list[str] = []
    stack: list[tuple[str, str]] = []  # open elements that say something about what they hold
    kind, at, marked = OPEN, 0, False

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append((MARKED if marked and kind == CONTENT else kind, text))

    def settle() -> str:
        marks = [k for _, k in stack]
        return BOILER if BOILER in marks or _FIRM in marks else CONTENT if CONTENT in marks else OPEN

    given = html or ""
    for m in _TOKEN.finditer(given):
        if m.start() > at:
            piece = given[at : m.start()]
            held.append(unescape(piece) if "&" in piece else piece)
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            if m["raw"] and m["raw"].lower() in ("iframe", "object", "canvas", "audio", "video", "select", "textarea"):
                held.append(" ")
            continue
        name, ends, attrs = name.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if name in _INLINE:
            if name in _VOID:
                continue
            if ends:
                if stack and stack[-1][0] == name:
                    flush()
                    stack.pop()
                    kind = settle()
            elif attrs and _hinted(attrs, kind == CONTENT):
                flush()
                stack.append((name, BOILER))
                kind = BOILER
            continue
        if name == "br":
            held.append(" ")
            continue
        flush()
        marked = not ends and name not in ("article", "main") and bool(attrs) and _own_mark(attrs)
        if ends:
            own = [n for n, _ in stack]
            if name in own:
                last = len(own) - 1 - own[::-1].index(name)
                # a stray end tag of a plain container closes nothing beyond the scope it stands in
                if name in _SCOPES or name == "body" or not any(n in _SCOPES for n in own[last + 1 :]):
                    del stack[last:]
                    kind = settle()
            continue
        if name in _VOID or attrs.endswith("/") and name not in _CONTAINERS:
            continue
        while stack and stack[-1][0] not in _CONTAINERS:  # a paragraph or an inline element that is still open ends here
            stack.pop()
        kind = settle()
        if name in ("article", "main"):
            if kind == BOILER and not any(k in (CONTENT, _FIRM) for _, k in stack):
                stack = [(n, OPEN) for n, _ in stack]  # an unclosed menu, header or advert does not swallow the article
            stack.append((name, BOILER if attrs and _hinted(attrs, True) else CONTENT))
        elif name in _DROPPED and not (name == "header" and kind == CONTENT) or attrs and _hinted(attrs, kind == CONTENT):
            firm = name in ("aside", "footer", "form") or re.search("comment|discussion|disqus|respond", attrs, re.I)
            stack.append((name, _FIRM if firm else BOILER))
        elif name in _CONTAINERS:
            if name == "body":
                stack = []
            stack.append((name, OPEN))
        kind = settle()
    if at < len(given):
        held.append(unescape(given[at:]))
    flush()
    return out


def stream(page: list[tuple[str, str]]) -> list[str]:
    """The tokens of a page's blocks."""
    return [w for _, text in page for w in text.split(" ")]


def undecided(page: list[tuple[str, str]], run: int = RUN) -> np.ndarray:
    """For each token of the stream, whether one of the run tokens from there is in a block that repeats decide about."""
    sizes = [text.count(" ") + 1 for _, text in page]
    asked = np.repeat([kind in (OPEN, MARKED) for kind, _ in page], sizes).astype(np.int64)
    past = np.append(0, np.cumsum(asked))
    at = np.arange(len(asked))
    return past[np.minimum(at + run, len(asked))] > past[at]


def mirror(page: list[tuple[str, str]]) -> int:
    """A number that pages share whose text, but for what structure rules out, is the same."""
    own = [text for kind, text in page if kind != BOILER] or ["", *(text for _, text in page)]
    return xxhash.xxh64_intdigest("\n".join(own)) - (1 << 63)


def suffix_array(tokens: np.ndarray, depth: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Positions in suffix order to the given depth, by prefix doubling, and the rank of each position; equal ranks share depth tokens."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    n, width = len(tokens), 1
    while width < depth:
        step = min(width, depth - width)
        later = np.full(n, -1, np.int64)
        later[: max(0, n - step)] = rank[step:]
        rank = np.unique(rank * (n + 2) + later + 1, return_inverse=True)[1].astype(np.int64)
        width += step
    return np.argsort(rank, kind="stable"), rank


def run_digests(streams: list[list[str]], hosts: list[str], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stream number, position, two 64-bit digests of the host and the run tokens from there) for the suffixes of at least run tokens.

    Suffixes are sorted within each host. The digests are computed once for each group of neighbours that share their first run tokens.
    """
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    coded = pa.array([w for s in streams for w in s], pa.string()).dictionary_encode()
    words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    none = (np.empty(0, np.int64),) * 4
    if not len(words):
        return none
    names = {h: n for n, h in enumerate(dict.fromkeys(hosts))}
    page = np.repeat(np.arange(len(streams)), sizes)
    of_host = np.fromiter((names[h] for h in hosts), np.int64, len(hosts))[page]
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))
    order, rank = suffix_array(of_host * len(coded.dictionary) + words, run)
    order = order[left[order] >= run]
    if not len(order):
        return none
    heads = np.append(True, rank[order[1:]] != rank[order[:-1]])
    first, group = order[heads], np.cumsum(heads) - 1
    wide = [xxhash.xxh128_intdigest(w) for w in (*names, *coded.dictionary.to_pylist())]
    digests = []
    for lane in (0, 64):
        hashes = np.array([w >> lane & (1 << 64) - 1 for w in wide], np.uint64)
        digest = hashes[of_host[first]]
        for i in range(run):
            digest = (digest ^ hashes[len(names) + words[first + i]]) * np.uint64(0x9E3779B97F4A7C15)
            digest ^= digest >> np.uint64(29)
        digests.append(digest[group].view(np.int64))
    starts = np.cumsum(sizes) - sizes
    return page[order], order - starts[page[order]], *digests


def unique_text(page: list[tuple[str, str]], covered: set[int]) -> str:
    """Plain blocks of the article, and those blocks that structure neither keeps nor rules out and that are not covered whole.

    A page of which less than LEAST_OWN would be left is a near copy of another one and keeps its text.
    """
    out, at, tokens, left = [], 0, 0, 0
    for kind, text in page:
        words = text.split(" ")
        if kind != BOILER:
            stays = kind == CONTENT or not covered or any(n not in covered for n in range(at, at + len(words)))
            tokens, left = tokens + len(words), left + stays * len(words)
            out += [text] if stays else []
        at += len(words)
    return " ".join(out) if left >= LEAST_OWN * tokens else " ".join(text for kind, text in page if kind != BOILER)


def _suffixes(keyed: DataFrame, run: int) -> DataFrame:
    """(digest, other, mirror, page, place, position, asked) of the suffixes of the streams of keyed(page, host, place, html); place is a number for the host; asked: one of its tokens is to be decided."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, keys, places = batch.column(1).to_pylist(), batch.column(0).to_numpy(), batch.column(3).to_numpy()
        pages = [blocks(h) for h in batch.column(2).to_pylist()]
        of, position, digest, other = run_digests([stream(p) for p in pages], hosts, run)
        asked = [undecided(p, run) for p in pages]
        starts = np.cumsum([0, *map(len, asked)])[:-1]
        flags = np.concatenate([*asked, np.empty(0, bool)])[starts[of] + position] if len(of) else np.empty(0, bool)
        mirrors = np.array([mirror(p) for p in pages], np.int64)
        return pa.record_batch([pa.array(digest), pa.array(other), pa.array(mirrors[of]), pa.array(keys[of]), pa.array(places[of]), pa.array(position.astype(np.int32)), pa.array(flags)], names=["digest", "other", "mirror", "page", "place", "position", "asked"])

    return keyed.select("page", "host", "html", "place").mapInArrow(by_slices(work, "html"), "digest bigint, other bigint, mirror bigint, page bigint, place bigint, position int, asked boolean")


def covered_tokens(keyed: DataFrame, run: int = RUN) -> DataFrame:
    """(page, starts array<int>): where runs of run tokens begin that enough distinct pages of the host share and that hold a token to be decided; a table in the shared folder."""
    keyed = keyed.withColumn("place", F.xxhash64("host"))
    suffixes = _suffixes(keyed, run)
    asked = keep(suffixes.where("asked").select("digest", "other", "page", "place", "position"), "suffixes")
    wanted = bitmap_filter(suffixes.select("digest", "other", "mirror"), "digest", asked.select("digest"))
    repeated = keep(wanted.distinct().groupBy("digest", "other").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= LEAST_PAGES), "repeated")
    hosts = keyed.select("place", F.xxhash64("html").alias("html")).distinct().groupBy("place").agg(F.count(F.lit(1)).alias("of_host"))
    often = asked.join(repeated, ["digest", "other"]).join(hosts, "place").where(F.col("n_pages") >= LEAST_SHARE * F.col("of_host"))
    # repeated rows give equal positions twice; a set holds them once
    covered = keep(often.groupBy("page").agg(F.collect_set("position").alias("starts")), "covered")
    discard(asked)
    discard(repeated)
    return covered


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN) -> DataFrame:
    """(id_col, url_col, text string, n_chars bigint) for every row of pages.

    Null and empty html have the text "". A null url, or one without a host, belongs to the host "". Equal rows are one page; repeated rows stay repeated. A page is
    never split, whatever its length. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    given = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    keyed = given.withColumn("page", F.xxhash64("id", "url", "html")).withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)))
    covered = covered_tokens(keyed, run)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [unique_text(blocks(h), {s + i for s in starts or () for i in range(run)}) for h, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        return pa.record_batch([*batch.columns[:2], pa.array(texts, pa.string())], names=["id", "url", "text"])

    size = covered.agg(F.coalesce(F.sum(F.size("starts") * 4 + 16), F.lit(0)).alias("n")).first()["n"]
    joined = keyed.join(F.broadcast(covered) if size <= MOST_BROADCAST else covered, "page", "left").select("id", "url", "html", "starts")
    kind = given.schema["id"].dataType.simpleString()
    text = joined.mapInArrow(by_slices(work, "html"), f"id {kind}, url string, text string")
    return text.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("bigint").alias("n_chars"))

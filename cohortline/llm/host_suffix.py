"""Main text of web pages: markup first, then a suffix array over each host's pages.

A page is cut into blocks. Blocks in menus, headers, footers, sidebars, adverts, notices, forms and comments are chrome. On pages with an article (or a main
element) its blocks are the text, on pages without such markup all blocks that are no chrome, called open. Both are then judged by the token streams of the host's pages put
together: suffixes, cut after RUN tokens, are sorted in buckets by host and first token, and neighbours that agree in RUN tokens (or to the end of a shorter
block) lie on a substring that is repeated. Pages with different text that hold such a run are counted (copies of a page are one).

Open blocks: every suffix is in the array, also those of chrome. A run's tokens are taken out
of an open block if `needed` pages of the host have it and such runs cover at least COVER of the block, so inner phrases and quotations stay. What fewer than STRONG
pages share may also be near copies of an article: a page that would lose more than MOST of its open tokens to such runs keeps them.

Article blocks: markup says they are text, so only a notice of the host takes one out, which is a block all of whose tokens lie in runs that `needed_in_articles` articles of the
host have. The first token lies in no other run than the block's first, so the array holds that suffix of each block; all suffixes are looked at in blocks whose first one is on so many
articles. Articles that have the same first or the same longest block beside it count as one, as copies of an article, also changed ones, are still articles;
a page that would lose more than MOST of its article keeps it.

Suffixes are reduced to one for each task and string before the shuffle, with the least and greatest page text they stand on, so a line
that every page of a large host has costs a row for each task.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.durable import durable
from .blobs import SCHEMA, bucket_count, bucket_of, scatter, unpack_all
from .url_filter import host_of
from .words import mix, slices, span_hashes

#: Tokens that a repeated run has at least; a whole block that is shorter counts as one.
RUN = 10
#: Share of a block's tokens that repeated runs must cover.
COVER = 0.8
#: Pages from which on a tenth of the host's pages is enough, and copying no longer the likelier reason.
STRONG = 10
#: Share of the open tokens that runs on fewer pages may take out of a page, and of an article's that any runs may.
MOST = 0.8
MAIN, CHROME, OPEN = 0, 1, 2
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*)>?",
    re.S,
)
# What HTML defines, as fixed values.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "canvas", "audio", "video", "select", "head"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "td", "th", "time", "tt", "u", "var", "wbr",
}
_CHROME_TAGS = {"nav", "aside", "footer", "form", "button", "dialog", "menu"}
_CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
_CHROME_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "newsletter", "subscribe", "subscription", "signup", "sidebar", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "comment", "comments", "disqus",
    "replies", "social", "share", "sharing", "related", "recommended", "popup", "modal", "overlay", "toolbar", "pagination", "pager", "widget", "copyright", "login", "search", "skip",
}
#: Whole class names and ids that mark chrome inside an article. A part of a name says nothing there: an entry-header holds the title, a share-price is news.
_CHROME_IN_MAIN = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "sponsored", "promo", "banner", "cookie", "cookies", "cookie-banner", "cookie-notice", "consent", "gdpr", "notice", "notices", "newsletter",
    "newsletter-signup", "subscribe", "signup", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "comment", "comments", "comment-list", "comments-section", "comment-section",
    "disqus", "disqus_thread", "replies", "social", "social-links", "share", "sharing", "share-buttons", "share-links", "related", "related-posts", "related-articles", "recommended", "popup", "modal", "overlay",
    "toolbar", "pagination", "pager", "widget", "login", "search",
}
#: Elements that no class name turns into chrome: headings and paragraphs are text.
_TEXT = {"h1", "h2", "h3", "h4", "h5", "h6", "p"}
_MAIN_ROLES = {"main", "article"}
_ATTRIBUTE = re.compile(r"([a-zA-Z:_-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_NOTES = {"footer", "aside", "nav", "form", "button", "dialog", "menu"}


def _in_main_chrome(token: str) -> bool:
    """Whether a whole class name or id marks chrome inside an article: a listed one, or comments of any sort, such as user-comments."""
    return token in _CHROME_IN_MAIN or re.split("[-_]", token)[-1] == "comments"


def _kind(name: str, rest: str, in_main: bool) -> int | None:
    """What an element makes of its content: MAIN, CHROME, or None for no change."""
    if name in _CHROME_TAGS or (name == "header" and not in_main):
        return CHROME
    if rest and not rest.isspace():
        given = {k.lower(): (a or b or c or "").lower() for k, a, b, c in _ATTRIBUTE.findall(rest)}
        if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", ""):
            return CHROME
        role = set(given.get("role", "").split())
        if role & _CHROME_ROLES:
            return CHROME
        if name not in ("html", "body", "article", "main") and name not in _TEXT:
            names = given.get("class", "") + " " + given.get("id", "")
            # Outside articles words of class names and ids count: sidebar-left has sidebar.
            if any(_in_main_chrome(x) for x in names.split()) if in_main else not _CHROME_NAMES.isdisjoint(_NAME.findall(names)):
                return CHROME
        if role & _MAIN_ROLES:
            return MAIN
    return MAIN if name in ("article", "main") else None


def blocks(page: str | None) -> list[tuple[int, str]]:
    """The page's text blocks in order, each MAIN, CHROME or OPEN. Unclosed and stray tags are taken as browsers would, roughly."""
    page = page or ""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    kind, at, end = OPEN, 0, len(page)

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((kind, text))

    depth: list[list] = []  # [name, kind before, nested elements of the same name]
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        parts.append(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            if name not in _INLINE:
                flush()
            elif name in ("td", "th"):
                parts.append(" ")
            for i in range(len(depth) - 1, -1, -1):
                if depth[i][0] == name:
                    if depth[i][2]:
                        depth[i][2] -= 1
                    else:
                        flush()
                        kind = depth[i][1]
                        del depth[i:]
                    break
            continue
        rest = m["rest"] or ""
        if name in _RAW and not (name == "head" or rest.rstrip().endswith("/")):
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            if name not in ("svg", "math"):
                flush()
            continue
        if name in ("br", "td", "th"):
            parts.append(" ")
        elif name not in _INLINE:
            flush()
        if name in _VOID or rest.rstrip().endswith("/"):
            continue
        if name in ("article", "main") and kind == CHROME and not any(d[0] in _NOTES for d in depth):
            depth.clear()  # an unclosed advert or the like ends where the article begins
            kind = OPEN
        new = _kind(name, rest, kind == MAIN)
        if new is not None and kind != CHROME and new != kind:
            flush()
            depth.append([name, kind, 0])
            kind = new
        else:
            for d in reversed(depth):
                if d[0] == name:
                    d[2] += 1
                    break
    flush()
    return out


def _streams(page: str | None) -> tuple[list[tuple[int, str]], bool]:
    """The blocks, and whether the page marks its main text."""
    found = blocks(page)
    return found, any(k == MAIN for k, _ in found)


def _tokens(found: list[tuple[int, str]], kinds: set[int]) -> tuple[list[bytes], np.ndarray]:
    """Tokens of the blocks of these kinds in page order, and the block of each."""
    tokens, owner = [], []
    for i, (kind, text) in enumerate(found):
        if kind in kinds:
            own = text.encode("utf-8", "surrogatepass").split(b" ")
            tokens.extend(own)
            owner.extend([i] * len(own))
    return tokens, np.array(owner, dtype=np.int64)


def _suffixes(tokens: list[bytes], owner: np.ndarray) -> np.ndarray:
    """For each token the hashes of the RUN tokens from it on, 0 behind the end of its block."""
    n = len(tokens)
    size = np.fromiter(map(len, tokens), np.int64, n)
    ends = np.cumsum(size)
    data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
    hashes = span_hashes(data, ends - size, ends) | np.uint64(1)
    out = np.zeros((n, RUN), dtype=np.uint64)
    for j in range(min(RUN, n)):
        same = owner[j:] == owner[: n - j] if j else np.ones(n, bool)
        out[: n - j, j][same] = hashes[j:][same]
    return out


def _whole(suffixes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Suffixes of RUN tokens, and those that are a whole shorter block."""
    first = np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.empty(0, bool)
    return (suffixes[:, -1] != 0) | first


def _run_keys(hosts: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """64 bits for each run of each host."""
    out = np.zeros(len(suffixes), dtype=np.uint64)
    for j in range(RUN):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + suffixes[:, j])
    return out ^ mix(hosts)


def _hash_of(text: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Suffixes(NamedTuple):
    """The suffixes of some pages, in page order, and what is known of each page with text."""

    page: np.ndarray
    kind: np.ndarray
    block: np.ndarray
    #: Position among the page's open tokens.
    place: np.ndarray
    runs: np.ndarray
    #: Hashes of the first and the longest block in the rest of the article.
    first: np.ndarray
    longest: np.ndarray
    #: For each page: its place in the batch, whether its main text is marked, and hashes of its host and text.
    at: np.ndarray
    marked: np.ndarray
    host: np.ndarray
    text: np.ndarray


def _read(batch: pa.RecordBatch) -> Suffixes:
    """Every suffix outside articles that has RUN tokens or is a whole shorter block, and the first suffix of each article block."""
    tokens: list[bytes] = []
    stream, pages, names, firsts, lengths = [], [], [], [], []
    for i, (host, page) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist())):
        found, marked = _streams(page)
        if not found:
            continue
        article = [b for b, (kind, _) in enumerate(found) if kind == MAIN]
        # What is left of an article without one of its blocks begins with its first or second block, and its longest is the article's or the next.
        for ranks, order in ((firsts, article[:2]), (lengths, sorted(article, key=lambda b: -len(found[b][1]))[:2])):
            ranks.append([order[0] if order else -1, *[_hash_of(found[b][1]) for b in order], 0, 0][:3])
        for b, (kind, text) in enumerate(found):
            raw = text.encode("utf-8", "surrogatepass")
            own = raw.split(b" ", RUN)[:RUN] if kind == MAIN else raw.split(b" ")
            tokens.extend(own)
            stream.append((len(pages), kind, b, len(own)))
        pages.append((i, marked))
        names.append((_hash_of(host), _hash_of(_own(found, marked))))
    page, kind, block, n = np.array(stream, dtype=np.int64).reshape(-1, 4).T
    owner = np.repeat(np.arange(len(n)), n)
    suffixes = _suffixes(tokens, owner) if tokens else np.zeros((0, RUN), np.uint64)
    begins = np.flatnonzero(_whole(suffixes, owner))
    owner_of = owner[begins]
    is_open = np.concatenate(([0], np.cumsum((kind == OPEN)[owner])))
    block_start = np.cumsum(n) - n
    page_start = block_start[np.searchsorted(page, np.arange(len(pages)))] if len(pages) else block_start
    place = is_open[begins] - is_open[page_start[page[owner_of]]]
    at, marked = np.array(pages, dtype=np.int64).reshape(-1, 2).T
    host, text = np.array(names, dtype=np.uint64).reshape(-1, 2).T
    of, number = page[owner_of], block[owner_of]

    def rest(ranks: list[list[int]]) -> np.ndarray:
        best = np.array([x[0] for x in ranks], dtype=np.int64)[of]
        hashes = np.array([x[1:] for x in ranks], dtype=np.uint64).reshape(-1, 2)[of]
        return np.where(number == best, hashes[:, 1], hashes[:, 0])

    return Suffixes(of, kind[owner_of], number, place, suffixes[begins], rest(firsts), rest(lengths), at, marked.astype(bool), host, text)


_KINDS = ("u8", "u8", "u8", *["u8"] * RUN)


def _dealt(n_buckets: int):
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            read = _read(batch)
            if not len(read.page):
                continue
            # Copies of a page are one page: what tells pages apart is their text beside the chrome.
            suffixes, host, text = read.runs, read.host[read.page], read.text[read.page]
            key = _run_keys(host, suffixes)
            order = np.lexsort((text, key))
            suffixes, host, text, key = suffixes[order], host[order], text[order], key[order]
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            least, most = text[start], text[np.concatenate((start[1:], [len(key)])) - 1]
            suffixes, host = suffixes[start], host[start]
            bucket = bucket_of(mix(host ^ mix(suffixes[:, 0])), n_buckets)
            yield from scatter(bucket, [host, least, most, *np.ascontiguousarray(suffixes.T)])

    return dealt


def _repeated(table: pa.Table) -> pa.Table:
    """A bucket's suffix array: sorted suffixes, and of each class of equal runs whether it stands on different pages."""
    host, least, most, *tokens = unpack_all(table.column("data").to_pylist(), _KINDS)
    order = np.lexsort((*reversed(tokens), host))
    host, least, most, tokens = host[order], least[order], most[order], [t[order] for t in tokens]
    agree = host[1:] == host[:-1]
    for t in tokens:  # neighbours whose common prefix is the whole run
        agree &= t[1:] == t[:-1]
    start = np.flatnonzero(np.concatenate(([True], ~agree)))
    low, high = np.minimum.reduceat(least, start), np.maximum.reduceat(most, start)
    hit = start[low != high]
    suffixes = np.stack([t[hit] for t in tokens], axis=1)
    keys = _run_keys(host[hit], suffixes)
    return pa.table({"run": pa.array(keys.view(np.int64))})


_RUNS = "key long, host long, text long, marked boolean, runs array<long>, places array<long>, firsts array<long>, lengths array<long>, beside array<long>"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page with text: its runs that may go, by block of an article (with the first and longest of the rest) or by place among the open tokens, and its other runs beside articles."""
    for batch in slices(batches, "html"):
        read = _read(batch)
        if not len(read.at):
            continue
        keys = _run_keys(read.host[read.page], read.runs).view(np.int64)
        marked = read.marked[read.page]

        def lists(chosen: np.ndarray, values: np.ndarray) -> pa.Array:
            ends = np.cumsum(np.bincount(read.page[chosen], minlength=len(read.at)))
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values[chosen], pa.int64()))

        judged = np.flatnonzero(read.kind == np.where(marked, MAIN, OPEN))
        beside = np.flatnonzero((read.kind == CHROME) | (marked & (read.kind == OPEN)))
        yield pa.record_batch(
            [
                batch.column("key").take(pa.array(read.at)),
                *[pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (read.host, read.text)],
                pa.array(read.marked),
                lists(judged, keys),
                lists(judged, np.where(marked, read.block, read.place)),
                lists(judged, read.first.view(np.int64)),
                lists(judged, read.longest.view(np.int64)),
                lists(beside, keys),
            ],
            names=["key", "host", "text", "marked", "runs", "places", "firsts", "lengths", "beside"],
        )


_INSIDE = "key long, host long, text long, first long, longest long, run long, place long"


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All runs of the given article blocks, by place among the article's tokens."""
    for batch in slices(batches, "html"):
        rows, runs, places, rests = [], [], [], []
        for i, (host, page, given) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("given").to_pylist())):
            rest = {g["place"]: (g["first"], g["longest"]) for g in given}
            tokens, owner = _tokens(blocks(page), {MAIN})
            suffixes = _suffixes(tokens, owner)
            at = np.flatnonzero(_whole(suffixes, owner) & np.isin(owner, list(rest)))
            rows.extend([i] * len(at))
            runs.append(_run_keys(np.full(len(at), host, dtype=np.int64).view(np.uint64), suffixes[at]).view(np.int64))
            places.append(at)
            rests.extend(rest[b] for b in owner[at].tolist())
        if rows:
            own = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("key", "host", "text")]
            others = [pa.array([x[k] for x in rests], pa.int64()) for k in (0, 1)]
            yield pa.record_batch(
                [*own, *others, pa.array(np.concatenate(runs)), pa.array(np.concatenate(places), pa.int64())], names=["key", "host", "text", "first", "longest", "run", "place"]
            )


def _own(found: list[tuple[int, str]], marked: bool) -> str:
    """What tells pages apart: their text beside the chrome."""
    return "\n".join(t for k, t in found if k == (MAIN if marked else OPEN))


def needed(pages):
    """Pages with different text that must have a run, of so many of the host: more than half of few, STRONG, a tenth of many."""
    return F.greatest(F.least(F.floor(pages / 2) + 1, F.lit(STRONG)), F.ceil(pages / 10), F.lit(2))


def needed_in_articles(pages):
    """Articles that must have a run of an article block: more than half of the host's pages, and STRONG. What fewer share, such as quotations, is text."""
    return F.greatest(F.floor(pages / 2) + 1, F.lit(STRONG))


def _articles() -> Column:
    """How many different articles the rows are of. Those whose rest has the same first or the same longest block may be changed copies."""
    return F.least(*[F.countDistinct(c) for c in ("text", "first", "longest")])


def _gone(owner: np.ndarray, places: list[int], cover: float = COVER) -> np.ndarray:
    """Tokens in the runs from these places on, in blocks that the runs cover."""
    gone = np.zeros(len(owner), dtype=bool)
    for p in places:
        stop = min(p + RUN, len(owner))
        gone[p:stop] |= owner[p:stop] == owner[p]
    blocks, block = np.unique(owner, return_inverse=True)
    covered = np.bincount(block, gone, len(blocks)) >= cover * np.bincount(block, minlength=len(blocks))
    return gone & covered[block]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        out = []
        for page, places in zip(batch.column("html").to_pylist(), batch.column("places").to_pylist()):
            found, marked = _streams(page)
            if not places:
                out.append("\n\n".join(t for k, t in found if k == (MAIN if marked else OPEN)))
                continue
            tokens, owner = _tokens(found, {MAIN if marked else OPEN})
            every = _gone(owner, [p["place"] for p in places], 1.0 if marked else COVER)
            if marked:
                gone = every if every.sum() <= MOST * len(every) else np.zeros_like(every)
            else:
                gone = _gone(owner, [p["place"] for p in places if p["strong"]])
                if (every & ~gone).sum() <= MOST * (~gone).sum():
                    gone = every
            kept: dict[int, list[bytes]] = {}
            for i in np.flatnonzero(~gone):
                kept.setdefault(int(owner[i]), []).append(tokens[i])
            out.append("\n\n".join(b" ".join(x).decode("utf-8", "surrogatepass") for x in kept.values()))
        rest = [c for c in batch.schema.names if c not in ("html", "places", "key", "host")]
        columns = [*[batch.column(c) for c in rest], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*rest, "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of `pages`: page_id, url, text (blocks joined by two line feeds, empty if none), n_chars.

    Character references are decoded, white space within a block becomes one space. A missing page is empty. Pages without a url or with one
    without :// share a nameless host. Repeated rows are returned as often as they occur, and count as one page of their host; rows that share an id and differ
    are kept apart by their content.
    """
    spark = pages.sparkSession

    named = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.xxhash64(F.col(id_col), F.col(url_col), F.col(html_col)).alias("key"),
        host_of(F.col(url_col)).alias("host"),
        F.col(html_col).alias("html"),
    )
    total = int(named.agg(F.sum(F.octet_length("html"))).first()[0] or 0)
    n_buckets = bucket_count(spark, total // 20, 300_000)
    dealt = named.select("host", "html").mapInArrow(_dealt(n_buckets), SCHEMA)
    repeated = dealt.groupBy("bucket").applyInArrow(_repeated, "run long")
    runs = durable(named.select("key", "host", "html").mapInArrow(_runs, _RUNS))
    each = runs.select("key", "host", "text", "marked", F.explode(F.arrays_zip("runs", "places", "firsts", "lengths")).alias("e"))
    of_run = [F.col(f"e.{a}").alias(b) for a, b in (("runs", "run"), ("places", "place"), ("firsts", "first"), ("lengths", "longest"))]
    each = each.select("key", "host", "text", "marked", *of_run)
    hits = durable(each.join(repeated.distinct(), "run"))
    of_host = runs.select("host", "text").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    places = durable(_in_open_blocks(hits.where(~F.col("marked")), runs, of_host).unionByName(_in_articles(hits.where("marked"), named, of_host)))
    kinds = {f.name: f.dataType.simpleString() for f in named.schema.fields}
    result = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    if not places.take(1):  # nothing to take out of any block
        return named.withColumn("places", F.lit(None).cast("array<struct<place:long,strong:boolean>>")).mapInArrow(_texts, result)
    places = places.groupBy(F.col("key").alias("places_key")).agg(F.collect_set(F.struct("place", "strong")).alias("places"))
    joined = named.join(places, F.col("key") == F.col("places_key"), "left").drop("places_key")
    return joined.mapInArrow(_texts, result)


def _in_open_blocks(hits: DataFrame, runs: DataFrame, of_host: DataFrame) -> DataFrame:
    """(key, place, strong) of the runs in open blocks that enough pages have."""
    # Each (text, run) is one row before the count, so a run of every page of a host is added up in all tasks.
    wanted = hits.select(F.col("run").alias("w")).distinct()
    standing = runs.select("host", "text", F.explode(F.when(F.col("marked"), F.col("beside")).otherwise(F.concat("beside", "runs"))).alias("run"))
    on_pages = standing.join(wanted, F.col("run") == F.col("w"), "left_semi").distinct().groupBy("host", "run").agg(F.count(F.lit(1)).alias("n"))
    enough = on_pages.join(of_host, "host").where(F.col("n") >= needed(F.col("pages"))).select("run", (F.col("n") >= STRONG).alias("strong"))
    return hits.join(enough, "run").select("key", "place", "strong")


def _in_articles(hits: DataFrame, named: DataFrame, of_host: DataFrame) -> DataFrame:
    """(key, place, strong) of the runs in article blocks that enough articles have, in blocks that begin with such a run."""

    def enough(rows: DataFrame) -> DataFrame:
        counted = rows.groupBy("host", "run").agg(_articles().alias("n")).join(of_host, "host")
        return counted.where(F.col("n") >= needed_in_articles(F.col("pages"))).select("run")

    begun = durable(hits.join(enough(hits), "run"))
    if not begun.take(1):
        return begun.select("key", "place", F.lit(True).alias("strong"))
    wanted = begun.groupBy("key", "host", "text").agg(F.collect_set(F.struct("place", "first", "longest")).alias("given"))
    found = named.select(F.col("key").alias("page_key"), "html").join(wanted, F.col("page_key") == F.col("key")).drop("page_key")
    inside = durable(found.mapInArrow(_inside, _INSIDE))
    return inside.join(enough(inside), "run").select("key", "place", F.lit(True).alias("strong"))

"""Main text of web pages with host suffix arrays (operator 9).

A page is cut into blocks of text by its markup.  Menus, headers, footers, sidebars, notices,
adverts, forms, scripts and reader comments go by their tags, roles and class names.  The token
streams of the pages of one host make one sequence, and its suffix array gives the long substrings
that repeat across distinct pages.  The markup is a prior for what they mean: outside an article a
run on two pages is boilerplate, in an article one that a large share of the host's pages show.
Covered runs go and unique runs stay.

Suffixes with a common prefix of RUN words or more are an interval of the suffix array, and the
words of all substrings that repeat are those of such prefixes.  So the array is kept in buckets, a
bucket an interval, named by the hash of its prefix: a host's pages are compared as a whole, in
many tasks, whatever the size of the host.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import words as W
from engram.llm.common import discard, key_filter, map_arrow, materialise, passes, pieces, table
from engram.llm.decontamination import suffix_array

#: Words of a run that counts as long.
RUN = 8
BATCH_BYTES = 1 << 21
#: A table of at most this many bytes is broadcast.
BROADCAST_BYTES = 8 << 20
#: A run in an article is boilerplate if it is on this share of the host's pages, and on so many.
SHARE, PAGES = 0.25, 4
#: An article with more than this share of such words is a copy with changes, and stays whole.
COPIED = 0.5

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_TO_END = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")

#: HTML elements by what they mean for the main text.
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("script style noscript template title textarea nav footer aside form button select option svg iframe object canvas audio video map dialog menu head".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split())
_CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_MAIN_ROLES = frozenset("main article".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class names and ids that mark boilerplate.
_DROPPED_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner banners nav navbar
    navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead topbar toolbar pagination pager
    cookie cookies consent gdpr notice notices
    newsletter subscribe subscription signup login popup modal overlay share sharing social related recommended
    recommendations widget widgets copyright disclaimer skip hidden""".split()
)
_COMMENT_NAMES = frozenset("comment comments commentlist disqus discussion replies reply respond".split())


@dataclass
class Block:
    words: list[str]
    kept: bool  # the markup names it as part of the article

    @property
    def text(self) -> str:
        return " ".join(self.words)


@lru_cache(4096)
def _traits(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is an article, firmly dropped, or dropped, as far as it says so itself."""
    names = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
    role = names.get("role", "").lower()
    marked = {w for key in ("class", "id") for w in re.split(r"[^a-z0-9]+", names.get(key, "").lower())}
    if tag in ("body", "html"):  # their classes speak of the whole page
        return role in _MAIN_ROLES, False, False
    firm = tag in _DROPPED or role in _DROPPED_ROLES or "hidden" in names or not marked.isdisjoint(_COMMENT_NAMES)
    return tag in ("article", "main") or role in _MAIN_ROLES, firm, firm or not marked.isdisjoint(_DROPPED_NAMES)


@dataclass
class _Open:
    tag: str
    dropped: bool
    firm: bool  # dropped by its tag, its role or as comments; an article in it is dropped, too
    article: bool


@dataclass
class _Builder:
    """The blocks so far and the open elements; every step takes constant time on average."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=lambda: [_Open("", False, False, False)])
    places: dict[str, list[int]] = field(default_factory=dict)  # of open elements in the stack
    containers: list[int] = field(default_factory=lambda: [0])  # places of those that aren't inline
    text: list[str] = field(default_factory=list)

    def end_block(self) -> None:
        words = "".join(self.text).split()
        if words:
            self.blocks.append(Block(words, self.stack[-1].article))
        self.text = []

    def add(self, raw: str) -> None:
        if not self.stack[-1].dropped:
            self.text.append(entities.unescape(raw))

    def open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag not in _INLINE:
            self.end_block()
        if tag in _VOID:
            return
        if tag in _CLOSES_P:
            self.close_implied("p")
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self.close_implied(tag)
        above = self.stack[-1]
        article, firm, dropped = _traits(tag, attributes)
        if tag == "header" and not above.article:
            firm = dropped = True
        # an article may stand in a badly named or unclosed wrapper
        inherited = above.firm if article else above.dropped
        dropped, firm = inherited or dropped, above.firm or firm
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag not in _INLINE:
            self.containers.append(len(self.stack))
        self.stack.append(_Open(tag, dropped, firm, (above.article or article) and not dropped))

    def end(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()
        while self.containers[-1] >= place:
            self.containers.pop()

    def close_implied(self, tag: str) -> None:
        """Ends an open element of this name, unless a container that may hold another stands between."""
        own = self.places.get(tag)
        if own and own[-1] >= self.containers[-1]:
            self.end(own[-1])

    def close(self, tag: str) -> None:
        if tag not in _INLINE:
            self.end_block()
        own = self.places.get(tag)
        # a stray end tag doesn't reach over a block
        if own and (tag not in _INLINE or own[-1] > self.containers[-1]):
            self.end(own[-1])


def tags(source: str, at: int = 0) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of all tags; comments and declarations have no name.

    Every character is looked at a bounded number of times: a tag whose quotes are not closed, and
    every tag after it, ends at the next ``>``, and one without it is text.  ``send`` a place to go
    on from there.
    """
    quotes = True
    while (at := source.find("<", at)) >= 0:
        closing, name, attributes = False, "", ""
        if m := _NAME.match(source, at):
            rest = _TO_END.match(source, m.end()) if quotes else None
            quotes = bool(rest)
            end = rest.end() if rest else source.find(">", m.end()) + 1
            if not end:
                return
            closing, name, attributes = bool(m[1]), m[2].lower(), source[m.end() : end - 1]
        elif source.startswith("<!--", at):
            end = source.find("-->", at + 4) + 3
            end = end if end > 2 else len(source)
        elif source[at + 1 : at + 2] in ("!", "?"):
            end = source.find(">", at) + 1 or len(source)
        else:
            at += 1
            continue
        to = yield at, end, closing, name, attributes
        at = end if to is None else to


def page_blocks(source: str) -> list[Block]:
    """The blocks of text of a page that the markup doesn't rule out."""
    b, at, found = _Builder(), 0, tags(source)
    tag = next(found, None)
    while tag:
        start, end, closing, name, attributes = tag
        if start > at:
            b.add(source[at:start])
        at, to = end, None
        if closing:
            b.close(name)
        elif name and (name in _VOID or not attributes.endswith("/")):
            b.open(name, attributes)
            if name in _RAW:
                raw = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                at = to = raw.start() if raw else len(source)
        try:
            tag = found.send(to)
        except StopIteration:
            break
    b.add(source[at:])
    b.end_block()
    return b.blocks


def common_prefixes(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place in a suffix array the length of the prefix that its suffix shares with the one before."""
    rank = np.empty(len(s), np.int64)
    rank[order] = np.arange(len(s))
    values, before = s.tolist(), [int(order[r - 1]) if r else -1 for r in rank.tolist()]
    out, h = np.zeros(len(s), np.int64), 0
    for i, j in enumerate(before):  # a suffix shares at most one word less than the one that starts a word earlier
        if j < 0:
            h = 0
            continue
        while i + h < len(values) and j + h < len(values) and values[i + h] == values[j + h]:
            h += 1
        out[rank[i]] = h
        h = max(0, h - 1)
    return out


def repeated_words(pages: list[list[list[str]]]) -> list[list[np.ndarray]]:
    """For each page's blocks' words, whether a run that repeats across distinct pages covers them.

    A run has RUN words at least; a whole shorter block counts as a run between its ends.  This is
    the suffix array of all pages' tokens with its common prefixes, for pages that one task holds;
    extract_pages finds the same words of any number of pages by the hashes of runs.
    """
    flat = [(k, b, w) for k, page in enumerate(pages) for b, w in enumerate(page)]
    if not flat:
        return [[] for _ in pages]
    number: dict[str, int] = {}
    symbols, owner, end = [], [], -1
    for k, _, words in flat:  # after each block an end of its own, which no run can pass
        symbols += [number.setdefault(w, len(number) + 1) for w in words] + [end]
        owner += [k] * (len(words) + 1)
        end -= 1
    s, own = np.array(symbols), np.array(owner)
    order = suffix_array(s)
    # suffixes with RUN words or more in common are neighbours: an interval of the array
    interval = np.cumsum(common_prefixes(s, order) < RUN)
    several = np.zeros(interval[-1] + 1, bool)
    several[interval[1:][(interval[1:] == interval[:-1]) & (own[order[1:]] != own[order[:-1]])]] = True
    cover = np.zeros(len(s) + RUN + 1, np.int64)
    at = order[several[interval]]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + RUN, -1)
    covered = np.cumsum(cover)[: len(s)] > 0
    short: dict[tuple[str, ...], set[int]] = {}
    for k, _, words in flat:
        if len(words) < RUN:
            short.setdefault(tuple(words), set()).add(k)
    out: list[list[np.ndarray]] = [[] for _ in pages]
    begin = 0
    for k, _, words in flat:
        whole = len(words) < RUN and len(short[tuple(words)]) > 1
        out[k].append(np.full(len(words), True) if whole else covered[begin : begin + len(words)])
        begin += len(words) + 1
    return out


def main_text(blocks: list[Block], covered: list[np.ndarray]) -> str:
    """The words of the blocks that are not covered, joined in page order.

    An article that is mostly covered stays whole, as a copy that the host shows elsewhere with
    changes, unless the blocks outside have more unique words: then it is but a teaser.
    """
    inside = [(len(f), int(f.sum())) for b, f in zip(blocks, covered, strict=True) if b.kept]
    size, gone = sum(n for n, _ in inside), sum(n for _, n in inside)
    outside = sum(int((~f).sum()) for b, f in zip(blocks, covered, strict=True) if not b.kept)
    copied = gone > COPIED * size and outside <= size
    out = []
    for block, flags in zip(blocks, covered, strict=True):
        if not flags.any() or (block.kept and copied):
            out.append(block.text)
        elif not flags.all():
            out.append(" ".join(w for w, gone in zip(block.words, flags, strict=True) if not gone))
    return "\n\n".join(out)


@dataclass
class Runs:
    """The runs of n words of some pages' blocks; a block of fewer words is one run."""

    keys: np.ndarray  # of each page: equal for pages of a host with the same blocks
    sizes: np.ndarray  # words of each block
    at: np.ndarray  # the runs' places among all words
    lengths: np.ndarray
    owners: np.ndarray  # the runs' pages
    kept: np.ndarray  # whether the runs stand in articles
    hashes: np.ndarray
    least: np.ndarray  # the runs' minimizers

    @classmethod
    def of(cls, pages: list[list[Block]], hosts: np.ndarray, n: int = RUN) -> Runs:
        """A run's minimizer is the least hash of the shorter runs in it: equal runs have equal ones."""
        blocks = [b for page in pages for b in page]
        sizes = np.array([len(b.words) for b in blocks], np.int64)
        page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
        own = W.mix(hosts.astype(np.int64).view(np.uint64))
        if not blocks:
            none = np.empty(0, np.int64)
            return cls(own.view(np.int64), sizes, none, none, none, none.astype(bool), none, none)
        h = W.words("\n".join(b.text for b in blocks).encode(), W.NON_SPACE, lower=False)[0]
        begin = np.cumsum(sizes) - sizes
        block, word_page = np.repeat(np.arange(len(sizes)), sizes), np.repeat(page, sizes)
        words = np.bincount(word_page, minlength=len(pages))
        starts = np.zeros(len(h), np.uint64)
        starts[begin] = 1
        keys = own.copy()
        with np.errstate(over="ignore"):
            place = np.arange(len(h)) - np.repeat(np.cumsum(words) - words, words)
            np.add.at(keys, word_page, W.mix(h + W.mix(np.uint64(2) * place.astype(np.uint64) + starts)))
            inner = (np.arange(len(h)) - begin[block]).astype(np.uint64)
            whole = W.mix(np.add.reduceat(W.mix(h + W.mix(inner)), begin) + sizes.astype(np.uint64))
        short = np.flatnonzero(sizes < n)
        at, hashes, least = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
        if len(h) >= n:
            m = (n + 1) // 2
            at = np.flatnonzero(block[: len(h) - n + 1] == block[n - 1 :])
            hashes = W.mix(W.grams(h, n)[at] ^ own[word_page[at]])
            shorter = W.mix(W.grams(h, m) ^ own[word_page[: len(h) - m + 1]])
            least = sliding_window_view(shorter, n - m + 1).min(axis=1)[at]
        ends = W.mix(whole[short] ^ own[page[short]])
        lengths = np.concatenate([np.full(len(at), n), sizes[short]])
        at = np.concatenate([at, begin[short]])
        hashes, least = np.concatenate([hashes, ends]).view(np.int64), np.concatenate([least, ends]).view(np.int64)
        return cls(keys.view(np.int64), sizes, at, lengths, word_page[at], np.array([b.kept for b in blocks])[block[at]], hashes, least)

    def covered(self, repeated: np.ndarray) -> list[np.ndarray]:
        """For each block's words, whether one of the repeated runs covers them."""
        total = int(self.sizes.sum())
        here = np.isin(self.hashes, repeated)
        cover = np.zeros(total + 1, np.int64)
        np.add.at(cover, self.at[here], 1)
        np.add.at(cover, self.at[here] + self.lengths[here], -1)
        return np.split(np.cumsum(cover)[:total] > 0, np.cumsum(self.sizes)[:-1]) if total else []


def _if_small(df: DataFrame, bytes_: int) -> DataFrame:
    """df, to be broadcast only if its size, which has been counted, is small."""
    return F.broadcast(df) if bytes_ <= BROADCAST_BYTES else df


def extract_pages(pages: DataFrame, run_words: int = RUN) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages.

    A null or empty html has an empty text.  Pages without a url, or with one that isn't absolute,
    are one host.  Blocks are joined by two line feeds; white space within a block becomes one
    space.  Repeated rows keep their own rows, and pages of a host with the same blocks count as
    one page; an empty table gives an empty table; other columns are ignored.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit(""))
    source = pages.select("page_id", "url", "html", F.xxhash64(host).alias("host"))
    # equal rows have one name; the text itself is cut in Python alone
    source = source.withColumn("name", F.xxhash64("host", "html"))
    hashed = source.select("host", "name", "html")

    def found(batch: pa.RecordBatch) -> tuple[list[list[Block]], Runs]:
        cut = [page_blocks(x or "") for x in batch.column("html").to_pylist()]
        return cut, Runs.of(cut, batch.column("host").to_numpy(), run_words)

    def minimizers_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html", BATCH_BYTES):
            _, r = found(batch)
            first = np.ones(len(r.least), bool)  # neighbouring runs mostly share one
            first[1:] = (r.least[1:] != r.least[:-1]) | (r.owners[1:] != r.owners[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(r.least[first]), pa.array(r.keys[r.owners[first]])], names=["least", "key"])

    # 1. a run on two pages has its minimizer on both: only such runs are dealt out whole
    ends = map_arrow(hashed.select("host", "html"), minimizers_of, "least long, key long").groupBy("least").agg(F.min("key").alias("a"), F.max("key").alias("b"))
    likely = materialise(ends.where("a <> b").select("least"), "likely")
    n_likely, bits = key_filter(likely, "least")
    passing = pages.sparkSession.sparkContext.broadcast(bits)

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html", BATCH_BYTES):
            _, r = found(batch)
            here = np.flatnonzero(passes(r.least, passing.value))
            page, hosts, names = r.owners[here], batch.column("host").to_numpy(), batch.column("name").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (r.least[here], r.hashes[here], r.kept[here], r.keys[page], hosts[page], names[page])], names=["least", "run", "kept", "key", "host", "name"])

    # 2. the suffix array's intervals of RUN words, and on how many of the host's pages they lie
    runs = map_arrow(hashed, runs_of, "least long, run long, kept boolean, key long, host long, name long")
    runs = materialise(runs.join(_if_small(likely, 16 * n_likely), "least", "left_semi").drop("least").distinct(), "runs")
    on = runs.select("host", "run", "key").distinct().groupBy("host", "run").agg(F.count(F.lit(1)).alias("on")).where("on > 1")
    sizes = source.select("host", "name").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    on = on.join(sizes, "host").select("run", F.lit(False).alias("kept")).unionByName(on.join(sizes, "host").where((F.col("on") >= PAGES) & (F.col("on") >= SHARE * F.col("size"))).select("run", F.lit(True).alias("kept")))
    repeated = materialise(on, "repeated")
    runs = runs.join(_if_small(repeated, 16 * repeated.count()), ["run", "kept"], "left_semi")
    covers = materialise(runs.groupBy("name").agg(F.collect_set(F.when(F.col("kept"), F.col("run"))).alias("inside"), F.collect_set(F.when(~F.col("kept"), F.col("run"))).alias("outside")), "covers")
    size = covers.agg(F.sum(F.size("inside") * 8 + F.size("outside") * 8 + 64)).first()[0] or 0
    discard(likely, repeated)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html", BATCH_BYTES):
            cut = [page_blocks(x or "") for x in batch.column("html").to_pylist()]
            covered = [[np.zeros(len(b.words), bool) for b in page] for page in cut]
            for kept, name in ((True, "inside"), (False, "outside")):
                own = [x or () for x in batch.column(name).to_pylist()]
                some = [i for i, x in enumerate(own) if len(x)]
                if some:
                    r = Runs.of([cut[i] for i in some], batch.column("host").to_numpy()[some], run_words)
                    flags = iter(r.covered(np.array([x for i in some for x in own[i]], np.int64)))
                    for i in some:
                        covered[i] = [f if b.kept == kept else old for b, f, old in zip(cut[i], flags, covered[i], strict=False)]
            texts = [main_text(page, flags) for page, flags in zip(cut, covered, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    # 3. the covered words go
    joined = source.join(_if_small(covers, size), "name", "left").select("page_id", "url", "host", "html", "inside", "outside")
    return map_arrow(joined, extract, f"page_id {kinds['page_id']}, url string, text string, n_chars long")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))

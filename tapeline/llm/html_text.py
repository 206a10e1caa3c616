"""Main text of web pages: page marks and host suffix arrays.

A page is read into blocks of three kinds: the marked article, furniture (menus, footers, adverts, forms, comments and the like, by element, role or
class name) and open blocks. The token streams of a host's pages form suffixes; suffixes that share their first ``depth`` tokens on enough pages are
boilerplate, the tokens they cover go, and the unique runs stay. Only the groups of the suffix order down to ``depth`` matter for that.

* Pages that mark an article: the article's blocks, without the long runs that at least ``ARTICLE_SHARE`` of the host's articles hold. Near copies are one
  article here. A marked article of which such runs would take more than half is itself what recurs, and stays.
* Pages without marks: the open blocks, without what stands outside marked articles on enough distinct pages (whole shorter blocks count as well).
  These few suffixes are grouped by (host, prefix digest) with partial aggregates, so a hot host is spread over tasks.

Articles are the bulk of the text, and a row for each of their suffixes would be larger than the pages. They are sorted by host and cut into chunks; a run that
a share of all articles holds is held by that share in one chunk at least, so the chunks' own suffix orders name all candidates, and only these are counted.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from tapeline.functions.lineage import parts_for, store
from tapeline.llm.common import join_same, pieces

DEPTH = 6  # tokens of a long substring
LEAST_PAGES, LEAST_SHARE = 2, 0.1  # of the host's distinct pages, for a repeat to be boilerplate
LEAST_ARTICLES, ARTICLE_SHARE = 3, 0.5  # of the host's articles, near copies counted once, for a repeat inside marked articles to be boilerplate
SHINGLE = 3  # tokens of the shingles whose smallest digest names an article and most of its near copies
CHUNK, PAGES_EACH = 500_000, 4096  # suffixes sorted at once (up to twice as many), pages of a task

#: Element, role and class names.
_SILENT = frozenset("script style noscript template iframe object svg math canvas audio video head title textarea select option datalist".split())
_FURNITURE = frozenset("nav footer aside form button menu dialog".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_NAMES = frozenset("ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice notices sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus share sharing social related recommended newsletter subscribe subscription popup popups modal widget login signin signup advertising adsbygoogle commentlist respond replies pagination pager toolbar".split())
_CONTENT_NAMES = frozenset("main content article post entry story body".split())
#: element -> elements that its start tag closes, and those beyond which it does not look
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
_HARD = frozenset("article aside body div footer form header main nav section table td th blockquote".split())
#: elements that stand in a head; any other closes it
_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
#: names of what belongs to other pages or readers: an article inside stays outside
_OTHERS = frozenset("ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo comment comments commentlist disqus respond replies related recommended share sharing social".split())
_SPLIT_NAME = re.compile(r"[\s_-]+")

#: WRAPPED and WRAPPED_MAIN are outside by class name only, in open or main content; REOPENED is an article in a WRAPPED element.
ARTICLE, MAIN, OPEN, OUTSIDE, WRAPPED, WRAPPED_MAIN, REOPENED = range(7)


class _Blocks(HTMLParser):
    """Collects (kind, text) blocks in page order; kinds are the constants above."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[int, str]] = []
        self.stack: list[tuple[str, int, bool]] = []  # element, kind inside it, silent
        self.text: dict[int, list[str]] = {}

    def flush(self):
        for kind, parts in self.text.items():
            if words := "".join(parts).split():
                self.blocks.append((kind, " ".join(words)))
        self.text = {}

    def close_to(self, at: int):
        del self.stack[at:]

    def find(self, names, stop) -> int:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in names:
                return i
            if self.stack[i][0] in stop:
                return -1
        return -1

    def close_head(self, anywhere: bool = False):
        if (i := self.find({"head"}, ())) >= 0 and (anywhere or i == len(self.stack) - 1):
            self.close_to(i)

    def handle_starttag(self, tag, attrs):
        if tag not in _HEAD:
            self.close_head(tag == "body")
        if tag in _BLOCK:
            self.flush()
            if (i := self.find({"p"}, _HARD)) >= 0:
                self.close_to(i)
        if tag in _CLOSES and (i := self.find(*_CLOSES[tag])) >= 0:
            self.close_to(i)
        if tag in _VOID:
            if tag == "br" and self.text:
                for parts in self.text.values():
                    parts.append(" ")
            return
        kind, silent = self.stack[-1][1:] if self.stack else (OPEN, False)
        self.stack.append((tag, self.kind(tag, dict(attrs), kind), silent or tag in _SILENT))

    def kind(self, tag, attrs, kind):
        names = {n for key in ("class", "id") for n in _SPLIT_NAME.split((attrs.get(key) or "").lower())}
        role = (attrs.get("role") or "").lower()
        inside = kind in (ARTICLE, MAIN, REOPENED)
        marked = names & _NAMES - ({"header"} if inside else set())
        if kind == OUTSIDE or tag in _FURNITURE or role in _ROLES or (tag == "header" and not inside) or "hidden" in attrs or "display:none" in (attrs.get("style") or "").replace(" ", ""):
            return OUTSIDE
        if marked and tag not in ("html", "body", "main") and not (names & _CONTENT_NAMES) and not (tag == "article" and "comment" not in marked and "comments" not in marked):
            return OUTSIDE if marked & _OTHERS else {OPEN: WRAPPED, MAIN: WRAPPED_MAIN}.get(kind, kind if kind in (WRAPPED, WRAPPED_MAIN) else OUTSIDE)
        if tag == "article" or attrs.get("itemprop") == "articleBody":
            return {WRAPPED: REOPENED, REOPENED: REOPENED, WRAPPED_MAIN: MAIN}.get(kind, ARTICLE)
        return MAIN if kind in (OPEN, WRAPPED) and (tag == "main" or role == "main") else kind

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self.flush()
        stop = _HARD if tag not in _HARD else ()
        if (i := self.find({tag}, stop)) >= 0:
            self.close_to(i)

    def handle_data(self, data):
        if data.strip():
            self.close_head()
        kind, silent = self.stack[-1][1:] if self.stack else (OPEN, False)
        if not silent:
            self.text.setdefault(kind, []).append(data)


def blocks(html: str | None) -> tuple[bool, list[str], list[str]]:
    """(marked, own blocks, blocks outside): own blocks are the marked article's, or the open ones if nothing is marked.

    An article in a wrapper with a class name of furniture counts as main content inside <main>, and as open blocks on a page without marks.
    """
    if not html:
        return False, [], []
    for source in (html, html.replace("<!", "&lt;!")):  # a broken declaration is text
        parser = _Blocks()
        try:
            parser.feed(source)
            parser.close()
            break
        except AssertionError:
            continue
    parser.flush()
    kinds = {k for k, _ in parser.blocks}
    own = {ARTICLE} if ARTICLE in kinds else {MAIN} if MAIN in kinds else {OPEN, REOPENED}
    return OPEN not in own, [t for k, t in parser.blocks if k in own], [t for k, t in parser.blocks if k not in own]


def _tokens(own: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Tokens of the blocks, their digests, and the block of each."""
    tokens = " ".join(own).encode().split(b" ")
    return tokens, np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens)), np.repeat(np.arange(len(own)), [b.count(" ") + 1 for b in own])


def _runs(token: np.ndarray, depth: int) -> np.ndarray:
    """Digests of all runs of ``depth`` tokens."""
    n = max(0, len(token) - depth + 1)
    digest = token[:n].astype(np.uint64)
    for i in range(1, depth):
        digest = digest * np.uint64(0x9E3779B97F4A7C15) + token[i : i + n].astype(np.uint64)
    return digest.view(np.int64)


def _starts(block: np.ndarray, depth: int) -> np.ndarray:
    """First tokens of the runs that stay inside a block."""
    n = max(0, len(block) - depth + 1)
    return np.flatnonzero(block[:n] == block[len(block) - n :])


def _short(token: np.ndarray) -> np.ndarray:
    """16 bits of each token digest, never 0: a run of them is enough to name candidates."""
    return np.maximum(token >> np.uint64(48), 1).astype(np.uint16)


def _sketch(own: list[str]) -> int:
    found = _runs(_tokens(own)[1], SHINGLE)
    return int(found.min()) if len(found) else xxhash.xxh3_64_intdigest(" ".join(own)) >> 1


@arrow_udf(StructType([StructField("marked", BooleanType()), StructField("own", ArrayType(StringType())), StructField("outside", ArrayType(StringType())), StructField("sketch", LongType())]))
def _blocks(html: pa.Array) -> pa.Array:
    rows = [blocks(h) for h in html.to_pylist()]
    strings = pa.list_(pa.string())
    sketches = [_sketch(r[1]) if r[0] else None for r in rows]
    return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], strings), pa.array([r[2] for r in rows], strings), pa.array(sketches, pa.int64())], ["marked", "own", "outside", "sketch"])


def _suffixes(block: str, depth: int) -> list[bytes]:
    tokens = block.encode().split(b" ")
    if len(tokens) <= depth:
        return [xxhash.xxh3_128_digest(b"\x00" + b" ".join(tokens))]
    return [xxhash.xxh3_128_digest(b" ".join(tokens[i : i + depth])) for i in range(len(tokens) - depth + 1)]


def _suffix_rows(batches, depth):
    for batch in batches:
        digests, owner, place, at = [], [], [], []
        for i, found in enumerate(batch.column("blocks").to_pylist()):
            for b, block in enumerate(found):
                own = _suffixes(block, depth)
                digests += own
                owner.append(np.full(len(own), i))
                place.append(np.full(len(own), b, np.int32))
                at.append(np.arange(len(own), dtype=np.int32))
        if digests:
            take = pa.array(np.concatenate(owner))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column("host").take(take), pa.array(digests, pa.binary()), pa.array(np.concatenate(place)), pa.array(np.concatenate(at))], [batch.schema.names[0], "host", "prefix", "block", "at"])


def boilerplate(streams: DataFrame, depth: int = DEPTH, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, prefix): groups of the suffix order that enough distinct pages of a host share; ``streams`` holds (content, host, blocks).

    ``content`` is a digest of the page, so exact copies of a page count once.
    """
    host = next(f for f in streams.schema if f.name == "host").dataType.simpleString()
    rows = streams.mapInArrow(lambda b: _suffix_rows(b, depth), f"content long, host {host}, prefix binary, block int, at int")
    pages = streams.groupBy("host", "content").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("pages"))
    shared = rows.groupBy("host", "prefix", "content").agg(F.lit(1).alias("one")).groupBy("host", "prefix").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages)
    return join_same(shared, pages, ["host"]).filter(F.col("n") >= F.lit(least_share) * F.col("pages")).select("host", "prefix")


@arrow_udf(StringType())
def _unique_runs(found: pa.Array, covered: pa.Array, depth: pa.Array) -> pa.Array:
    """Text of the blocks without the tokens that covered prefixes span."""
    out = []
    for own, hits, d in zip(found.to_pylist(), covered.to_pylist(), depth.to_pylist(), strict=True):
        gone: dict[int, set[int]] = {}
        for h in hits or []:
            gone.setdefault(h["block"], set()).update(range(h["at"], h["at"] + d))
        kept = [" ".join(t for i, t in enumerate(block.split(" ")) if i not in gone.get(b, ())) for b, block in enumerate(own)]
        out.append("\n".join(k for k in kept if k))
    return pa.array(out, pa.string())


def _short_rows(batches):
    """(host, sketch, content, codes): 16 bits a token, 0 between blocks; of the pages of one sketch only those below the ones seen before in this task."""
    seen: dict[tuple[str, int], int] = {}
    for batch in pieces(batches):
        out = []
        for h, s, c, own in zip(*(batch.column(n).to_pylist() for n in ("host", "sketch", "content", "own")), strict=True):
            if seen.get((h, s), c + 1) > c:
                seen[h, s] = c
                _, token, block = _tokens(own)
                out.append((h, s, c, np.insert(_short(token), np.flatnonzero(np.diff(block)) + 1, 0).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["host", "sketch", "content", "codes"])


def _chunk_repeats(batches, depth, least, share):
    """(host, short): runs that the share of some chunk's articles hold; rows come sorted by (host, sketch, content), the first of a sketch counts."""
    host, sketch, held, size, first = None, None, [], 0, True

    def close(part, whole):
        found, n = np.unique(np.concatenate(part), return_counts=True)
        found = found[n >= max(least if whole else 1, share * len(part))]
        return pa.RecordBatch.from_arrays([pa.array([host] * len(found), pa.string()), pa.array(found, pa.int64())], ["host", "short"])

    for batch in pieces(batches):
        for h, s, codes in zip(*(batch.column(c).to_pylist() for c in ("host", "sketch", "codes")), strict=True):
            if h != host:
                if held:
                    yield close(held, not first)  # the first and the last host of a task may go on in another one
                    first = False
                host, sketch, held, size = h, None, [], 0
            if s == sketch:
                continue
            if size >= 2 * CHUNK and len(held) >= 32:  # the second half waits, so that no chunk of a few articles is left over
                yield close(held[: len(held) // 2], False)
                held, first = held[len(held) // 2 :], True
                size = sum(map(len, held))
            sketch, code = s, np.frombuffer(codes, np.uint16)
            gap = code == 0
            at = _starts(np.cumsum(gap) + gap * -0.5, depth)  # a gap belongs to neither block
            held.append(np.unique(_runs(code, depth)[at]))
            size += len(held[-1])
    if held:
        yield close(held, False)


def _hits(batches, depth):
    """(host, sketch, content, prefix) of the runs of candidates."""
    for batch in pieces(batches):
        out, found = [], []
        for h, s, c, own, shorts in zip(*(batch.column(n).to_pylist() for n in ("host", "sketch", "content", "own", "shorts")), strict=True):
            _, token, block = _tokens(own)
            at = _starts(block, depth)
            at = at[np.isin(_runs(_short(token), depth)[at], np.array(shorts, np.int64))]
            found.append(np.unique(_runs(token, depth)[at]))
            out += [(h, s, c)] * len(found[-1])
        if out:
            yield pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64()), strict=True)), pa.array(np.concatenate(found), pa.int64())], ["host", "sketch", "content", "prefix"])


def article_boilerplate(articles: DataFrame, depth: int = DEPTH, least: int = LEAST_ARTICLES, share: float = ARTICLE_SHARE) -> DataFrame:
    """(host, prefixes): digests of the runs that enough of a host's articles hold; ``articles`` holds (host, sketch, content, own).

    Pages of one sketch are one article, for which the page of the smallest ``content`` stands. Hosts without such runs have no row.
    """
    host = "host string, sketch long, content long"
    ordered = articles.mapInArrow(_short_rows, f"{host}, codes binary").repartitionByRange(parts_for(articles.count(), PAGES_EACH), "host", "sketch").sortWithinPartitions("host", "sketch", "content")
    candidates = ordered.mapInArrow(lambda b: _chunk_repeats(b, depth, least, share), "host string, short long")
    listed = store(candidates.groupBy("host").agg(F.collect_set("short").alias("shorts")))
    one = articles.groupBy("host", "sketch").agg(F.min("content").alias("content"))
    counts = one.groupBy("host").agg(F.count("*").alias("articles"))
    hits = articles.join(listed, "host").select("host", "sketch", "content", "own", "shorts").mapInArrow(lambda b: _hits(b, depth), f"{host}, prefix long")
    held = hits.distinct().join(one, ["host", "sketch", "content"]).groupBy("host", "prefix").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return held.join(counts, "host").filter(F.col("n") >= F.lit(share) * F.col("articles")).groupBy("host").agg(F.collect_list("prefix").alias("prefixes"))


@arrow_udf(StringType())
def _article_runs(own: pa.Array, prefixes: pa.Array, depth: pa.Array) -> pa.Array:
    """Text of marked blocks without the runs of their host; if these are more than half, they are the article."""
    text = pc.binary_join(own, "\n").to_pylist()
    for i in np.flatnonzero(prefixes.is_valid().to_numpy(zero_copy_only=False)):
        d = depth[int(i)].as_py()
        tokens, token, block = _tokens(own[int(i)].as_py())
        at = _starts(block, d)
        hit = at[np.isin(_runs(token, d)[at], prefixes[int(i)].values.to_numpy(zero_copy_only=False))]
        keep = np.ones(len(tokens), bool)
        for k in range(d):
            keep[hit + k] = False
        if len(hit) and 2 * keep.sum() >= len(tokens):
            kept = np.flatnonzero(keep)
            cut = np.flatnonzero(np.diff(block[kept])) + 1
            text[i] = b"\n".join(b" ".join(tokens[j] for j in run) for run in np.split(kept, cut)).decode()
    return pa.array(text, pa.string())


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", depth: int = DEPTH) -> DataFrame:
    """(page_id, url, text), one row for each input row.

    White space inside a block is one space, blocks are joined by one line feed, character references are decoded. Null and empty pages have the empty
    text; a null or odd url is a host of its own kind; exact copies of a page are one page for the repeats of its host.
    """
    page = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    parsed = page.select(F.monotonically_increasing_id().alias("row_no"), "page_id", "url", host.alias("host"), _blocks("html").alias("b"))
    rows = store(parsed.select("row_no", "page_id", "url", "host", "b.*"))  # each page is parsed once
    none = F.array().cast("array<string>")
    streams = rows.select(F.xxhash64("own", "outside").alias("content"), "host", F.concat(F.when(F.col("marked"), none).otherwise(F.col("own")), "outside").alias("blocks"))
    repeats = store(boilerplate(streams, depth))
    bare = rows.filter(~F.col("marked"))
    suffixes = bare.select("row_no", "host", F.col("own").alias("blocks")).mapInArrow(lambda b: _suffix_rows(b, depth), "row_no long, host string, prefix binary, block int, at int")
    covered = suffixes.join(repeats, ["host", "prefix"]).groupBy("row_no").agg(F.collect_list(F.struct("block", "at")).alias("covered"))
    cleaned = bare.join(covered, "row_no", "left").select("page_id", "url", _unique_runs("own", "covered", F.lit(depth)).alias("text"))
    articles = rows.filter("marked")
    runs = store(article_boilerplate(articles.select("host", "sketch", F.xxhash64("own").alias("content"), "own"), depth))
    return articles.join(runs, "host", "left").select("page_id", "url", _article_runs("own", "prefixes", F.lit(depth)).alias("text")).unionByName(cleaned)

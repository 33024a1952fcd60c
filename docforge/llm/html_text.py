"""Main text of web pages by a suffix array of each host's token streams, with markup as a vote.

Markup cuts a page into blocks and tells where each stands: in an article, on the open page,
under a class name that hints at boilerplate, or in an element that never is main text. All of its text is
its token stream on its host. The suffixes of streams, cut off at
the end of a block, are sorted across all tasks; suffixes that share their first words with one of another page
are repeats. The places where a repeat stands in a main text speak for it, the others on pages with a text of their own against it. Every
block of every page is then decided by what markup and the array say together, see VOTES.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEAST_BITS, MOST_BITS, bit_filter, join_spread, materialise, small_batches, split_by, without
from .words import mixed, pieces

#: Elements whose content is never text; elements that never hold main text; elements that end a block; elements without content; elements whose content isn't markup.
DROPPED = frozenset("script style noscript template head title iframe object svg canvas audio video map".split())
CHROME_ELEMENTS = frozenset("nav header footer aside form button select option textarea input dialog menu".split())
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
SPACED = frozenset("br td th".split())
#: Words of class and id, and roles, that mark boilerplate; and words that only say what kind of box it is.
NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
BOXES = frozenset("area bar block body box btn button buttons container content form group inner item items left link links list main outer panel right row section site slot top unit wrap wrapper".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())

#: A quote opens only after an equals sign; elsewhere it is a character like any other.
_INSIDE = r"(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+"
TAG = re.compile(rf"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)({_INSIDE})(?:>|\Z)|</[^A-Za-z>][^>]*>|</>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WORD = re.compile(r"[A-Za-z]+")

#: Where a block stands: in an article or main element; on a page without one; under a name that hints at boilerplate; in what markup rules out.
MAIN, OPEN, HINTED, CHROME = range(4)
OUTSIDE = 4

#: What markup says for each standing. The array adds 1 for words that aren't boilerplate of the host and takes 1 for those that are; words with a sum above 0 stay. So an article, also a copied one, and what never is main text are certain, and the array decides the rest.
VOTES = {MAIN: 2, OPEN: 0, HINTED: 0, CHROME: -2}
UNSURE = tuple(s for s, v in VOTES.items() if abs(v) <= 1)

#: Words of a run that is looked for on other pages of a host: the depth to which suffixes are compared.
LEAST_REPEAT = 8
#: The share of its words that a page has alone on its host, if it is to count; pages and share of the host's that runs and short blocks are on.
OWN, LEAST_PAGES, LEAST_SHARE = 0.2, 3, 0.1
#: Streams whose suffixes are listed at a time, at most so many and with about so many characters.
STREAMS, STREAM_CHARACTERS = 200, 1 << 20
#: Bytes of a word that is hashed together with others.
LONG_WORD = 64


def _standing(name: str, attributes: str) -> int:
    """CHROME, HINTED or OPEN, by an element's name, class, id and role. A class of which each word is a boilerplate word or a box is certain; one with other words too is a hint."""
    if name in CHROME_ELEMENTS:
        return CHROME
    if not attributes:
        return OPEN
    found = OPEN
    for key, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        match key.lower():
            case "class" | "id" if name not in ("html", "body"):
                for token in value.split():
                    words = WORD.findall(token)
                    if any(w in NAMES for w in words) and (name not in ("article", "main") or "comment" in token):
                        found = max(found, CHROME if all(w in NAMES or w in BOXES for w in words) else HINTED)
            case "role" if value.strip() in ROLES:
                found = CHROME
            case "hidden":
                found = CHROME
            case "aria-hidden" if value.strip() == "true":
                found = CHROME
    return found


def blocks(page: str) -> tuple[list[tuple[str, int]], bool]:
    """The blocks of a page, white space folded, with where they stand; and whether it has a marked article or main part.

    On a page that has one, what lies outside it is CHROME.
    """
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    inside: list[tuple[str, int]] = []
    #: Open regions: name, elements of that name in it, standing.
    regions: list[list] = []
    at, marked = 0, False

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            # A hint around an article says nothing about it.
            standing = max((r[2] for k, r in enumerate(regions) if r[2] == CHROME or k >= (inside[-1][1] if inside else 0)), default=OPEN)
            out.append((text, (MAIN if standing == OPEN else standing) if inside else standing | OUTSIDE))

    while at < len(page):
        m = TAG.search(page, at)
        parts.append(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        ends, attributes = bool(m[1]), m[3] or ""
        alone = name in VOID or attributes.rstrip().endswith("/")
        if name in DROPPED:
            if name in ("head", "title", "iframe", "object"):
                close()
            if not ends and not alone:
                at = _element_end(page, name, at)
            continue
        while regions and regions[-1][0] in ("p", "li") and name in BLOCKS and (name == regions[-1][0] and not ends or name != regions[-1][0] and (not ends or name in ("ul", "ol", "div", "article", "section", "body"))):
            close()  # its end tag was left out
            regions.pop()
        if regions and name == regions[-1][0]:
            if name in BLOCKS or name in CHROME_ELEMENTS:
                close()
            regions[-1][1] += -1 if ends else 0 if alone else 1
            if not regions[-1][1]:
                regions.pop()
            continue
        if not ends and (standing := _standing(name, attributes)) != OPEN:
            if name in BLOCKS or name in CHROME_ELEMENTS and name != "input":
                close()
            if name in RAW:
                at = _element_end(page, name, at)
            elif not alone:
                regions.append([name, 1, standing])
            continue
        if name in BLOCKS:
            close()
            if name in ("article", "main") and not (regions and regions[-1][2] == CHROME):
                if not ends:
                    inside.append((name, len(regions)))
                    marked = True
                elif any(name == x for x, _ in inside):
                    while inside.pop()[0] != name:
                        pass
        elif name in SPACED:
            parts.append(" ")
    close()
    return [(t, CHROME if s & OUTSIDE and marked else s & ~OUTSIDE) for t, s in out], marked


def _element_end(page: str, name: str, at: int) -> int:
    """Where an element's content ends; a head ends at the body at the latest."""
    if name == "head":
        found = re.compile(r"</head(?=[\s/>])[^>]*>?|(?=<body[\s/>])", re.I).search(page, at)
    elif name in RAW:
        found = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
    else:
        depth = 1
        for found in re.compile(rf"<(/?){name}(?=[\s/>])[^>]*?(/?)>", re.I).finditer(page, at):
            depth += -1 if found[1] else 0 if found[2] else 1
            if not depth:
                return found.end()
        found = None
    return found.end() if found else len(page)


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words: eight bytes at a time of all words that are as long, and one by one of those above LONG_WORD bytes."""
    size = np.asarray(pc.binary_length(words)).astype(np.int64)
    starts = np.cumsum(size) - size
    data = np.zeros(size.sum() + 8, np.uint8)
    if size.any():
        _, offsets, held = words.buffers()
        data[:-8] = np.frombuffer(held, np.uint8, len(data) - 8, np.frombuffer(offsets, np.int32)[words.offset])
    # The eight bytes from each byte on.
    lanes = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    h = mixed(size.astype(np.uint64))
    for k in np.flatnonzero(size > LONG_WORD):
        h[k] = xxhash.xxh64_intdigest(data[starts[k] : starts[k] + size[k]])
    rows = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at = 0
    while len(rows):
        lane = lanes[starts[rows] + at].astype(np.uint64)
        there = np.minimum(size[rows] - at, 8).astype(np.uint64)
        h[rows] = mixed(h[rows] ^ (lane & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * there)))) + np.uint64(1)
        at += 8
        rows = rows[size[rows] > at]
    return h


def suffixes(streams: pa.Array, sites: np.ndarray | None = None, known: np.ndarray | None = None, keyed: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """The suffixes of token streams, each a list of blocks: stream, block, first word, the words that count, whether it is a whole block of LEAST_REPEAT words or more, the unit, and if asked the key by which they sort; with a bitmap() only those whose unit may be in it.

    A key holds the hashes of LEAST_REPEAT words, zeros beyond the end of the block, and the whole block's
    hash where a suffix starts a block and counts as a whole: a block as such, and in a longer one each suffix that has LEAST_REPEAT words.
    A unit is the number of the interval that a suffix lies in: a hash of its key. Keys are made only for the suffixes that are returned.
    """
    flat = streams.flatten().cast(pa.string())
    of = np.repeat(np.arange(len(streams)), np.asarray(pc.list_value_length(streams)))
    lists = pc.split_pattern(flat, " ")
    tokens = word_hashes(lists.flatten())
    begins = np.asarray(lists.offsets).astype(np.int64)
    size = np.diff(begins)
    block = np.repeat(np.arange(len(flat)), size)
    padded = np.append(tokens, np.zeros(LEAST_REPEAT, np.uint64))
    digests = np.fromiter((xxhash.xxh64_intdigest(x, 1) | 1 for x in flat.cast(pa.binary()).to_pylist()), np.uint64, len(flat))
    full = np.flatnonzero(np.arange(len(tokens)) + LEAST_REPEAT <= begins[1:][block])

    def columns(starts: np.ndarray, whole: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(LEAST_REPEAT):
            yield np.where(starts + k < begins[1:][block[starts]], padded[starts + k], np.uint64(0))
        yield whole

    # Every word starts a window; the windows that leave their block are then left out.
    windows = _hashed([*(padded[k : k + len(tokens)] for k in range(LEAST_REPEAT)), np.uint64(0)], len(tokens))
    units = np.concatenate([_hashed(columns(begins[:-1], digests), len(flat)), windows[full]]).view(np.int64)
    at = np.concatenate([begins[:-1], full])
    picked = np.arange(len(at))
    if known is not None:
        spot = (units ^ sites[of[block[at]]]) & (8 * len(known) - 1)
        picked = np.flatnonzero(known[spot >> 3] >> (spot & 7) & 1)
    at, units, heads = at[picked], units[picked], picked < len(flat)
    owner = block[at]
    keys = np.column_stack(list(columns(at, np.where(heads, digests[owner], np.uint64(0))))).astype(">u8") if keyed else None
    return of[owner], owner, at - begins[owner], np.where(heads, size[owner], LEAST_REPEAT), heads & (size[owner] >= LEAST_REPEAT), units, keys


def _hashed(columns: Iterable[np.ndarray], n: int) -> np.ndarray:
    """A hash of each of n rows of columns."""
    h = np.zeros(n, np.uint64)
    for column in columns:
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += column
        h += np.uint64(1)
        h = mixed(h)
    return h


def without_repeats(page: list[str], repeated: np.ndarray) -> list[str]:
    """The blocks of a page without the words that lie in a repeated unit; blocks with nothing left are empty."""
    words = [b.split(" ") for b in page]
    gone = [bytearray(len(w)) for w in words]
    _, owner, first, n, _, units, _ = suffixes(pa.array([page], pa.list_(pa.string())))
    for k in np.flatnonzero(np.isin(units, repeated)):
        gone[owner[k]][first[k] : first[k] + n[k]] = b"\1" * int(n[k])
    return [" ".join(x for x, g in zip(w, gs, strict=True) if not g) for w, gs in zip(words, gone, strict=True)]


def _distinct(streams: pa.Array, sites: np.ndarray | None = None, known: np.ndarray | None = None, keyed: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """The distinct units of each stream: stream, unit, whether it is a whole block of LEAST_REPEAT words or more, weight, and if asked the key; with a bitmap() only those that may be in it."""
    of, _, _, words, long, units, keys = suffixes(streams, sites, known, keyed)
    order = np.lexsort((units, of))
    new = (np.diff(of[order], prepend=-1) != 0) | np.append(True, units[order][1:] != units[order][:-1])[: len(of)]
    first = np.sort(order[new])
    of, units, words, long = of[first], units[first], words[first], long[first]
    weight = np.where(long, 0, np.where(words >= LEAST_REPEAT, 1, words)).astype(np.int32)
    return of, units, long, weight, keys[first] if keyed else None


def words_apart(streams: pa.Array) -> np.ndarray:
    """The weight of all distinct units of each stream."""
    out = np.zeros(len(streams), np.int64)
    for start, part in _slices([streams]):
        of, _, _, weight, _ = _distinct(part[0])
        out[start : start + len(part[0])] = np.bincount(of, weight, len(part[0]))
    return out


def bitmap(streams: DataFrame, n: int) -> np.ndarray:
    """A filter over the units of streams(site, stream), about n of them: 32 to 64 bits for each, and at most 2**MOST_BITS (32 MB); when it fills up it lets more through and never loses one."""
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, (part,) in _slices([b.column("stream")]):
                of, units, *_ = _distinct(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique((units ^ b.column("site").to_numpy()[start + of]) & ((1 << bits) - 1)))], ["bit"])

    bit = F.col("bit") + 1  # the bitmap functions count from 1
    slabs = streams.select("site", "stream").mapInArrow(run, "bit long").groupBy(F.bitmap_bucket_number(bit).alias("slab")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bitmap"))
    out = np.zeros(1 << bits - 3, np.uint8)
    for r in slabs.toLocalIterator():
        out[(r["slab"] - 1) * 4096 : r["slab"] * 4096] = np.frombuffer(r["bitmap"], np.uint8)
    return out


def _slices(columns: list[pa.Array]) -> Iterator[tuple[int, list[pa.Array]]]:
    """Slices of columns of streams with their first row, of at most STREAMS rows and about STREAM_CHARACTERS."""
    size = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        done = np.append(0, np.cumsum(np.asarray(pc.utf8_length(column.flatten()))))
        size += np.diff(done[np.append(0, np.cumsum(np.asarray(pc.list_value_length(column))))])
    ends = np.cumsum(size)
    start = 0
    while start < len(size):
        stop = min(start + STREAMS, max(start + 1, int(np.searchsorted(ends, ends[start] - size[start] + STREAM_CHARACTERS, "right"))))
        yield start, [c.slice(start, stop - start) for c in columns]
        start = stop


def _listed(streams: DataFrame, columns: list[str], extra: list[str], known: np.ndarray | None = None) -> DataFrame:
    """A row for each distinct unit of a stream: the stream's columns, unit, and of key, long, weight and main those asked for; with a bitmap() also, with main set, for those of the column main that may be in it."""
    kinds = {"key": "binary", "long": "boolean", "weight": "int", "main": "boolean"}
    texts = ["stream"] if known is None else ["stream", "main"]
    sent = None if known is None else streams.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, parts in _slices([b.column(t) for t in texts]):
                told = [b.column(c).slice(start, len(parts[0])) for c in columns]
                for main, part in enumerate(parts):
                    of, units, long, weight, keys = _distinct(part, *((b.column("site").to_numpy()[start:], sent.value) if main else (None, None)), "key" in extra)
                    made = {"key": lambda: _binary(keys), "long": lambda: pa.array(long), "weight": lambda: pa.array(weight), "main": lambda: pa.array(np.full(len(of), bool(main)))}  # noqa: B023
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(of)) for c in told), pa.array(units), *(made[c]() for c in extra)], [*columns, "unit", *extra])

    schema = ", ".join([*(f"{c} long" for c in columns), "unit long", *(f"{c} {kinds[c]}" for c in extra)])
    return streams.select(*columns, *texts).mapInArrow(run, schema)


def _binary(keys: np.ndarray) -> pa.Array:
    """Rows of an array as bytes."""
    keys = np.ascontiguousarray(keys)
    ends = np.arange(len(keys) + 1, dtype=np.int32) * (keys.shape[1] * keys.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends), pa.py_buffer(keys)])


def suffix_array(streams: DataFrame) -> DataFrame:
    """Rows (site, unit, mark, shared, long, weight, main): the suffixes of streams(site, mark, stream) that may occur in another stream of the site, in the order of each site's suffix array.

    A further column main(array) holds the blocks of a stream that are main text; their suffixes have main set. One whose unit
    occurs in main texts only has no bearing on any block, as all its places are vouched for; such suffixes are left out, by a
    filter over the units of the other blocks, and column n_rest says about how many of those there are.

    A first pass over hashes tells which suffixes occur once and needn't be sorted. The array is sorted across tasks
    by site and key, then by stream, so that a passage that very many pages have is spread too; a unit is an
    interval of suffixes with the same key, and shared how many words a suffix has in common with the one before it.
    """
    small_batches(streams.sparkSession)
    known = bitmap(streams, streams.agg(F.coalesce(F.sum("n_rest"), F.lit(0))).first()[0]) if "main" in streams.columns else None
    rest = _listed(streams, ["site"], [], known)
    listed = _listed(streams, ["site", "mark"], ["key", "long", "weight", "main"], known)
    again = rest.groupBy("site", "unit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = materialise(again.select(F.xxhash64("site", "unit").alias("spot")), "host-again")
    found, _ = split_by(listed.withColumn("spot", F.xxhash64("site", "unit")), "spot", bit_filter(again, "spot"))
    ordered = found.drop("spot").repartitionByRange("site", "key", "mark").sortWithinPartitions("site", "key", "mark")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        site, last = None, np.zeros(LEAST_REPEAT + 1, np.uint64)
        for b in batches:
            if not len(b):
                continue
            keys = np.frombuffer(b"".join(b.column("key").to_pylist()), ">u8").reshape(len(b), -1)
            sites = b.column("site").to_numpy()
            same = np.concatenate([[sites[0] == site], sites[1:] == sites[:-1]])[:, None] & (keys == np.concatenate([last[None], keys[:-1]]))
            shared = np.where(same[:, :LEAST_REPEAT].all(1), LEAST_REPEAT, same[:, :LEAST_REPEAT].argmin(1)).astype(np.int32)
            site, last = sites[-1], keys[-1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("site", "unit", "mark")), pa.array(shared), b.column("long"), b.column("weight"), b.column("main")], ["site", "unit", "mark", "shared", "long", "weight", "main"])

    return ordered.mapInArrow(numbered, "site long, unit long, mark long, shared int, long boolean, weight int, main boolean")


def boilerplate(streams: DataFrame) -> DataFrame:
    """site, unit, n: the units of streams(row, site, mark, every, n_rest, main, stream) that are boilerplate of their site, and in how many streams they are outside main text.

    Column every is the weight of all words of the page. Streams of a mark count once (the first row's, and row tells rows apart; streams is a written table), and only if OWN of the page's words, main text included, are in no other stream of the site, so that
    copies don't tell against each other. Whole blocks of LEAST_REPEAT words are boilerplate in two such streams;
    shorter blocks, and runs inside blocks, in at least LEAST_PAGES and LEAST_SHARE of the site's. What as many streams or more have in their main text isn't.
    """
    firsts = materialise(streams.groupBy("site", "mark").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "host-marks")
    extra = join_spread(streams.select("site", "mark", "row"), firsts, ["site", "mark"], "n", "row").filter("row <> first")
    once = without(streams, extra.select("row"), "row")
    array = materialise(suffix_array(once), "host-suffixes")
    units = materialise(array.groupBy("site", "unit").agg(F.count(F.lit(1)).alias("n"), F.min("mark").alias("low"), F.max("mark").alias("high")).filter("low <> high").select("site", "unit", "n"), "host-units")
    repeated = join_spread(array, units, ["site", "unit"], "n", "mark").groupBy("site", "mark").agg(F.sum("weight").alias("repeated"))

    counted = once.select("site", "mark", "every").join(repeated, ["site", "mark"], "left").filter(F.col("every") - F.coalesce("repeated", F.lit(0)) >= OWN * F.col("every"))
    counted = materialise(counted.select("site", "mark"), "host-counted")
    of_site = materialise(counted.groupBy("site").agg(F.count(F.lit(1)).alias("of")), "host-pages")
    times = array.join(counted, ["site", "mark"]).groupBy("site", "unit").agg(F.count_if(~F.col("main")).alias("n"), F.count_if("main").alias("vouched"), F.bool_or("long").alias("long"))
    times = materialise(times.filter("n > 1 AND n > vouched"), "host-times")
    told = join_spread(times, of_site, ["site"], "of", "unit")
    enough = F.when(F.col("long"), 2).otherwise(F.greatest(F.lit(LEAST_PAGES), F.ceil(LEAST_SHARE * F.col("of"))))
    return told.filter(F.col("n") >= enough).select("site", "unit", "n")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages(page_id, url, html, ...).

    Each block stays or goes by VOTES and the host's suffix array, which holds the whole text of every page. What stands in menus,
    headers, footers, sidebars, notices, adverts, forms and reader comments, by element, class, id or role, goes, and on a page with an article or main element what
    is outside those. A block whose class only hints at that, like "share-prices", goes if the array shows it to be boilerplate(); on pages without an
    article go all runs of words that are. Null and empty html give an empty text; a url without a host has no other pages.
    A page is parsed in one piece, however long. Repeated rows repeat (equal pages count as one), an
    empty table stays empty, and other columns don't matter.
    """
    kinds = dict(pages.dtypes)
    schema = f"page_id {kinds['page_id']}, url string, text string, n_chars long"
    pages = pages.select("page_id", "url", "html")
    small_batches(pages.sparkSession)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in pieces(b.column("html")):
                found = [blocks(h or "")[0] for h in part.to_pylist()]
                cut = b.slice(start, len(part))
                main, unsure, chrome, rest = ([[t for t, s in x if s in which] for x in found] for which in ((MAIN,), UNSURE, (CHROME,), (*UNSURE, CHROME)))
                n_main, n_rest = (np.array([sum(t.count(" ") + 1 for t in x) for x in y], np.int64) for y in (main, rest))
                lists = [pa.array(x, pa.list_(pa.string())) for x in (main, unsure, chrome)]
                yield pa.RecordBatch.from_arrays(
                    [cut.column("page_id"), cut.column("url"), cut.column("host"), *lists, pa.array([[s for _, s in x] for x in found], pa.list_(pa.int8())),
                     pa.array(n_main + words_apart(pa.array(rest, pa.list_(pa.string())))), pa.array(n_rest), pa.array([xxhash.xxh3_64_intdigest("\n".join(m or s).encode(errors="replace")) - 2**63 for m, s in zip(main, rest, strict=True)], pa.int64())],
                    ["page_id", "url", "host", "main", "unsure", "chrome", "standing", "every", "n_rest", "mark"],
                )

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decided(*x) for x in zip(*(b.column(c).to_pylist() for c in ("main", "unsure", "standing", "repeated")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    # The host by the same rule as for every other use of a url.
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))
    # Blocks of each kind in a column, so that a pass reads only those that it needs.
    kept = pages.withColumn("host", host).mapInArrow(parsed, f"page_id {kinds['page_id']}, url string, host string, main array<string>, unsure array<string>, chrome array<string>, standing array<tinyint>, every long, n_rest long, mark long")
    kept = kept.withColumn("site", F.xxhash64("host")).withColumn("content", F.xxhash64("unsure")).withColumn("row", F.monotonically_increasing_id())
    kept = materialise(kept, "page-blocks")

    streams = kept.filter("host <> '' AND size(standing) > 0").select("row", "site", "mark", "every", "n_rest", "main", F.concat("unsure", "chrome").alias("stream"))
    bad = materialise(boilerplate(streams), "host-boilerplate")
    # Where markup is certain, the array's vote can't turn the sum: of other blocks the units are looked up.
    asked = kept.filter("host <> '' AND size(unsure) > 0").select("site", F.col("unsure").alias("stream"), "content").dropDuplicates(["site", "content"])
    units = _listed(asked, ["site", "content"], []).withColumn("spot", F.xxhash64("site", "unit"))
    units, _ = split_by(units, "spot", bit_filter(bad.select(F.xxhash64("site", "unit").alias("spot")), "spot"))
    lists = join_spread(units.drop("spot"), bad, ["site", "unit"], "n", "content").groupBy("site", "content").agg(F.collect_set("unit").alias("repeated"))
    lists = materialise(lists, "page-repeats")
    columns = ["page_id", "url", "main", "unsure", "standing", "repeated"]
    may, clear = split_by(kept, "content", bit_filter(lists, "content"))
    return may.join(lists, ["site", "content"], "left").select(columns).unionByName(clear.withColumn("repeated", F.lit(None).cast("array<bigint>")).select(columns)).mapInArrow(finished, schema)


def decided(main: list[str], unsure: list[str], standing: list[int], repeated: list[int] | None) -> str:
    """A page's main text by VOTES, given its blocks by what markup says, where each stands, and the units of its unsure blocks that are boilerplate of its host."""
    if unsure and repeated:
        rest = without_repeats(unsure, np.array(repeated, np.int64))
        # In an article a hinted block goes as a whole or not at all.
        unsure = [t if main and r else r for t, r in zip(unsure, rest, strict=True)]
    sure, open_ = iter(main), iter(unsure)
    kept = main if not unsure else [next(sure if s == MAIN else open_) for s in standing if s == MAIN or s in UNSURE]
    return "\n\n".join(t for t in kept if t)

"""Arrays of words and characters of whole texts, a few megabytes at a time."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 3 << 18
#: Texts of more characters are cut, at white space or else at what isn't a letter.
LONG = 1 << 20
SPACE = re.compile(r"[\x20\x09-\x0D]")
NO_LETTER = re.compile(r"[\W\d_]")
RELEASE_BYTES = 4 << 20


def release() -> None:
    """Gives freed memory back to the system. Workers live on into later stages, whose memory is the executor's too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def pieces(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about `limit` bytes with their first row; a longer text is a slice of its own. Freed memory goes back after every 8 MB and at the end."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    ends = np.cumsum(size)
    start = 0
    while start < len(texts):
        done = ends[start] - size[start]
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield start, texts.slice(start, stop - start)
        if stop == len(texts) or ends[stop - 1] // RELEASE_BYTES > done // RELEASE_BYTES:
            release()
        start = stop


def parts_of(text: str, at: re.Pattern[str], size: int = LONG) -> Iterator[str]:
    """A text in parts of about `size` characters, each from the second on beginning with a character that fits `at`; one part if none does."""
    start = 0
    while len(text) - start > size and (found := at.search(text, start + size)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def is_long(texts: pa.Array) -> bool:
    """Whether a slice that pieces() gives is a single long text."""
    return len(texts) == 1 and (pc.binary_length(texts)[0].as_py() or 0) > 2 * CHUNK_BYTES


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Successive batches as one, up to about `limit` bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if held and sum(h.nbytes for h in held) + b.nbytes > limit:
            yield pa.concat_batches(held)
            held = []
        held.append(b)
    if held:
        yield pa.concat_batches(held)


def split(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Runs of bytes other than space and \\t to \\r: distinct words, the code of each word in turn, and where each text's words begin (one more at the end)."""
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten().dictionary_encode()
    codes = np.asarray(flat.indices).astype(np.int64)
    begins = np.asarray(lists.offsets).astype(np.int64)
    begins = begins - begins[0]
    empty = np.flatnonzero(np.asarray(pc.equal(pc.binary_length(flat.dictionary), 0)))
    if len(empty):
        there = codes != empty[0]
        begins = np.concatenate([[0], np.cumsum(there)])[begins]
        codes = codes[there]
    return flat.dictionary, codes, begins


def hash64(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_letters: np.ndarray | None = None


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, other characters than letters as 0; each text has a 0 before it, and its place is returned."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    low = [("" if t is None else t).lower() for t in texts.to_pylist()]
    points = np.frombuffer(("\0" + "\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, low), np.int64, len(low))
    begins = np.cumsum(size + 1) - size - 1
    return np.where(_letters[points], points, 0).astype(np.uint32), begins


def sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of the stretches of values (rows) between successive begins."""
    total = np.zeros((len(begins) - 1, *values.shape[1:]), np.float64)
    there = np.flatnonzero(np.diff(begins) > 0)
    if len(there):
        total[there] = np.add.reduceat(values, begins[there], axis=0, dtype=np.float64)[: len(there)]
    return total

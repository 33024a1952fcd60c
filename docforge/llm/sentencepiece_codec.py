"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

Distinct marked words are sorted, which lays them out as a trie in depth-first order; the
forward state of each prefix is computed once and reused by all words that continue it. A state is a best score
and the last piece of the path that has it. A unigram model's paths score the sum of their pieces. A byte-pair
model's scores are merge ranks, whose sum says nothing; there a path scores 0 if merging leaves each of its neighbouring
pieces as they are, else minus infinity, and exactly one path to each prefix has 0, so only its last
piece is kept. Both give the ids that the public library gives, but that paths of a unigram model with equal scores, like those through
a run of spaces in pieces of one and of two, are decided there by the rounding of the whole text's score.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import small_batches, tokenizer_path
from .words import gathered, pieces

#: Bytes of words, with their ids, and pairs of pieces that a worker keeps from one batch to the next.
CACHE_BYTES = 20 << 20
CACHE_PAIRS = 250_000
#: What a kept word takes besides its bytes and ids.
ENTRY_BYTES = 200
#: Bytes of text whose words are sorted together: the more, the more prefixes are shared. Longer texts are cut before a space.
SORTED_BYTES = 2 << 20
#: What the score of a character without a piece lies below the least score, as the public library has it.
UNKNOWN_PENALTY = 10.0
#: Bits of a piece's code: pieces, then characters without one.
CODE_BITS = 21
UNIGRAM, BPE = 1, 2


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a serialised protocol buffer message."""

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            out |= (message[at] & 127) << shift
            shift += 7
            at += 1
            if message[at - 1] < 128:
                return out

    at = 0
    while at < len(message):
        tag = varint()
        match tag & 7:
            case 0:
                yield tag >> 3, varint()
            case 2:
                size = varint()
                yield tag >> 3, message[at : at + size]
                at += size
            case wire:
                size = {1: 8, 5: 4}[wire]
                yield tag >> 3, message[at : at + size]
                at += size


def model_type(model: bytes) -> int:
    """UNIGRAM or BPE, from the model's trainer specification (field 2, model_type 3); unigram is the default."""
    for number, value in _fields(model):
        if number == 2 and isinstance(value, bytes):
            return next((v for n, v in _fields(value) if n == 3 and isinstance(v, int)), UNIGRAM)
    return UNIGRAM


def marked_words(texts: pa.Array, split: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and how many each text has. A word takes the spaces before it; the first is the marker that every text gets.

    The words are offsets into one buffer, so no object is made for each of them. Without `split` each text is one word.
    """
    there = np.asarray(pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0))
    marked = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts.filter(pa.array(there)).cast(pa.large_string()), pa.scalar(" ", pa.large_string()))
    count = np.zeros(len(texts), np.int64)
    if not len(marked):
        return pa.array([], pa.large_binary()), count
    if not split:
        count[there] = 1
        return marked.cast(pa.large_binary()), count
    _, offsets, data = marked.buffers()
    begins = np.frombuffer(offsets, np.int64)[marked.offset : marked.offset + len(marked) + 1]
    space = np.frombuffer(data, np.uint8)[: begins[-1]] == 32
    opens = space.copy()
    opens[1:] &= ~space[:-1]
    opens[: begins[0]] = False
    opens[begins[:-1]] = True
    starts = np.flatnonzero(opens)
    count[there] = np.diff(np.append(np.searchsorted(starts, begins[:-1]), len(starts)))
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, begins[-1])), data]), count


def cuts(text: str, size: int) -> Iterator[str]:
    """A text in parts of about `size` characters, each of which but the first has lost a space that it began with: the marker that it gets instead."""
    at = 0
    while len(text) - at > size:
        space = text.find(" ", at + size)
        while space > 0 and text[space - 1] == " ":  # the spaces before a word are its own
            space = text.find(" ", space + 1)
        if space < 0 or space + 1 == len(text):
            break
        yield text[at:space]
        at = space + 1
    yield text[at:]


class Codec:
    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        #: The text of each code: of pieces, and from n on of characters without a piece.
        self.names: list[str] = [""] * n
        for i in plain:
            self.names[i] = sp.id_to_piece(i).replace("▁", " ")
        self.ids = {self.names[i]: i for i in reversed(plain)}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.byte = {int(sp.id_to_piece(i)[3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown, self.n = sp.unk_id(), n
        self.unigram = model_type(model) == UNIGRAM
        self.longest = max(map(len, self.ids), default=1)
        #: Whether texts fall into words that no piece crosses: a space is only at the beginning of a piece.
        self.split = not any(" " in p.lstrip(" ") for p in self.ids)
        self.least = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.bytes: list[bytes] = [x.encode() for x in self.names]
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        self.chars: dict[str, int] = {}
        self.pairs: dict[int, bool] = {}  # whether two pieces, their codes side by side, may follow each other
        self.held = 0
        #: Pieces that merging their own characters gives, and the length of the longest one by its last three characters.
        self.whole = {p: i for p, i in self.ids.items() if self.unigram or self.merged(p) == [p]}
        self.reach: dict[str, int] = {}
        for p in self.whole:
            if len(p) > 2:
                self.reach[p[-3:]] = max(len(p), self.reach.get(p[-3:], 0))

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging as it is defined: again and again the adjacent pair of best score, the leftmost of equals. Only for short texts."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, pair: int) -> bool:
        """Whether two neighbouring pieces stay as they are."""
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        left, right = self.names[pair >> CODE_BITS], self.names[pair & (1 << CODE_BITS) - 1]
        known = self.pairs[pair] = self.merged(left + right) == [left, right]
        return known

    def char(self, c: str) -> int:
        """The code of a character, whether it has a piece or not."""
        if (code := self.ids.get(c)) is None and (code := self.chars.get(c)) is None:
            code = self.chars[c] = len(self.names)
            self.names.append(c)
        return code

    def by_score(self, word: str, end: int, best: array) -> tuple[int, float]:
        """The last piece and score, in single precision as the library has it, of the best path to the word's first `end` characters; of equals the piece that starts first."""
        code, most, total = -1, -np.inf, array("f", [0.0])
        for start in range(max(0, end - self.longest), end):
            piece = word[start:end]
            if (s := self.score.get(piece)) is None:
                if end - start > 1:
                    continue
                s = self.least
            total[0] = best[start] + s
            if total[0] > most:
                code, most = self.whole.get(piece, -1), total[0]
        return (self.char(word[end - 1 : end]) if code < 0 else code), most

    def by_pairs(self, word: str, end: int, last: list[int] | array) -> int:
        """The last piece of the only path to the word's first `end` characters on which merging leaves all neighbours as they are."""
        whole, pairs = self.whole, self.pairs
        start = max(0, end - self.reach.get(word[end - 3 : end], 2)) if end > 2 else 0
        while True:
            code = whole.get(word[start:end])
            if code is None and end - start == 1:
                code = self.char(word[start:end])
            if code is not None:
                if not start:
                    return code
                pair = last[start] << CODE_BITS | code
                known = pairs.get(pair)
                if self.follows(pair) if known is None else known:
                    return code
            start += 1

    def words(self, distinct: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """The ids, as 32-bit numbers, of each word, in sorted order. last[i] and best[i], the forward state of the word's first i characters, outlive the word as far as the next one shares them."""
        last: list[int] | array = [0]
        best, before, names, n = array("f", [0.0]), "", self.names, self.n
        for raw in sorted(distinct):
            word = raw.decode()
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            before = word
            if len(word) > 100_000 and isinstance(last, list):  # four bytes a character for a word without end
                last = array("i", last)
            del last[shared + 1 :], best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                if self.unigram:
                    code, score = self.by_score(word, end, best)
                    best.append(score)
                else:
                    code = self.by_pairs(word, end, last)
                last.append(code)
            out = array("i")
            end = len(word)
            while end:
                code = last[end]
                end -= len(names[code])
                if code < n:
                    out.append(code)
                else:
                    out.extend(self.spell(names[code])[::-1])
            out.reverse()
            yield raw, out.tobytes()

    def spell(self, c: str) -> list[int]:
        """The ids of the bytes of a character without a piece; the unknown id in a model without bytes."""
        return [self.byte[b] for b in c.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def encode(self, texts: pa.Array | list[str | None], cache: dict[bytes, bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin (one more at the end)."""
        cache = {} if cache is None else cache
        found, count = marked_words(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts, self.split)
        coded = found.dictionary_encode()
        codes = np.asarray(coded.indices)
        distinct = coded.dictionary.to_pylist()
        del found, coded
        if self.held > CACHE_BYTES:
            cache.clear()
            self.held = 0
        for w, ids in self.words([w for w in distinct if w not in cache]):
            cache[w] = ids
            self.held += len(w) + len(ids) + ENTRY_BYTES
        tables = [cache[w] for w in distinct]
        size = np.fromiter(map(len, tables), np.int64, len(tables)) >> 2
        flat = np.frombuffer(b"".join(tables), np.int32)
        del tables, distinct
        each = size[codes]
        ends = np.append(0, np.cumsum(each))
        # An Arrow list has fewer than 2**31 elements, so places fit 32 bits.
        at = np.repeat(((np.cumsum(size) - size)[codes] - ends[:-1]).astype(np.int32), each)
        at += np.arange(len(at), dtype=np.int32)
        return flat[at], ends[np.append(0, np.cumsum(count))]

    def decode(self, ids: Iterable[int]) -> str:
        """The text: pieces joined, bytes joined to characters, and the first marker taken away."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:].decode("utf-8", "replace")


_open: dict[bytes, tuple[Codec, dict[bytes, bytes]]] = {}


def _codec(model: bytes) -> tuple[Codec, dict[bytes, bytes]]:
    """One codec for each worker: another model's goes."""
    key = hashlib.sha256(model).digest()
    if key not in _open:
        _open.clear()
        _open[key] = (Codec(model), {})
    return _open[key]


def tokenise(docs: DataFrame, model: str | bytes | None = None) -> DataFrame:
    """doc_id, n_tokens, token_ids and round_trip for every row of docs(doc_id, text, ...).

    The model is a file on the driver or its bytes, which go to the executors. round_trip tells whether decoding
    gives the text again, which holds for every valid text, those with control characters, runs of spaces or the
    marker character itself included, if the model has bytes. Null and empty texts have no tokens. A text of more than
    SORTED_BYTES is encoded in parts that begin with a space, with the same ids. Rows are encoded alone: repeated
    rows repeat, also with a null doc_id, an empty table stays empty, other columns don't matter.
    """
    if not isinstance(model, bytes):
        with open(model or tokenizer_path("piece_bpe_32k.model"), "rb") as f:
            model = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, cache = _codec(shared.value)
        for b in gathered(batches, SORTED_BYTES):
            for start, part in pieces(b.column("text"), SORTED_BYTES):
                texts = list(cuts(part[0].as_py(), SORTED_BYTES)) if codec.split and len(part) == 1 and part[0].is_valid else [t or "" for t in part.to_pylist()]
                ids, same = [], []
                for group in [[t] for t in texts] if len(part) == 1 else [texts]:
                    found, begins = codec.encode(group, cache)
                    same += [codec.decode(found[begins[k] : begins[k + 1]].tolist()) == t for k, t in enumerate(group)]
                    ids.append(found)
                if len(part) == 1:
                    begins, same = np.array([0, sum(map(len, ids))]), [all(same)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(start, len(part)), pa.array(np.diff(begins)), pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(np.concatenate(ids))), pa.array(same)],
                    ["doc_id", "n_tokens", "token_ids", "round_trip"],
                )

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, token_ids array<int>, round_trip boolean")

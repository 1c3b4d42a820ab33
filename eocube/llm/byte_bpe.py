"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A word's merges never depend on another word, so any slice of the corpus can be replayed by itself and slices agree.
Each task takes its documents in slices of bounded bytes. The slice's distinct new words are laid out as one symbol
sequence; an inverted index maps each mergeable pair (named by the rank of its merge) to the positions where it
stands; merges are replayed over the whole slice in rank order, and a merge touches only its two neighbours. What a
word became is kept for later slices of the worker (bounded number of words). Nothing is shuffled.

Edge cases: a null text counts as empty (no ids); an empty table gives an empty result; repeated rows are encoded
one by one; other columns of the input are ignored, whatever their names; texts of any length are taken whole.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

# Unicode's White_Space, which is what \s means to the pattern's own library (Python's re counts four controls more).
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """The merge table: rank of every pair of ids that merges, as sorted arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.spell = [b""] * self.size
        for piece, r in ranks.items():
            self.spell[r] = piece
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        made = [(a * self.size + b, r) for piece, r in ranks.items() for i in range(1, len(piece)) if (a := ranks.get(piece[:i])) is not None and (b := ranks.get(piece[i:])) is not None]
        made.sort()
        self.keys = np.array([k for k, _ in made] or [-1], np.int64)
        self.ranks = np.array([r for _, r in made] or [0], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``size`` where the pair doesn't merge."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.size)


def replay(words: list[bytes], merges: Merges) -> list[bytes]:
    """Ids of each word as packed little-endian uint32.

    The words stand in one symbol sequence. ``index`` maps a mergeable pair, named by its rank, to the places where it
    stands. Pairs are taken in rank order for all words at once; each merge renews only the pairs that it touches.
    """
    none = merges.size
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    sym = merges.byte.astype(np.int32)[np.frombuffer(b"".join(words), np.uint8)]
    n, ends = len(sym), np.cumsum(lengths)
    if not n:
        return [b""] * len(words)
    word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    nxt, prev = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    nxt[ends[lengths > 0] - 1] = -1
    prev[(ends - lengths)[lengths > 0]] = -1
    alive = np.ones(n, bool)
    pair = np.full(n, none, np.int32)
    at = np.flatnonzero(nxt >= 0)
    pair[at] = merges.rank(sym[at], sym[at + 1])

    index: dict[int, list] = {}  # rank -> arrays of places, of which some may be out of date
    order = at[np.argsort(pair[at], kind="stable")]
    cut = np.flatnonzero(np.diff(pair[order])) + 1
    for part in np.split(order, cut):
        if len(part) and (r := int(pair[part[0]])) < none:
            index[r] = [part]
    heap = list(index)
    heapify(heap)

    def apply(k: np.ndarray, r: int) -> np.ndarray:
        j = nxt[k]
        after = nxt[j]
        sym[k], alive[j], pair[j], nxt[k] = r, False, none, after
        prev[after[after >= 0]] = k[after >= 0]
        left = prev[k]
        t = np.concatenate([left[left >= 0], k])
        t = t[alive[t]]
        right = nxt[t]
        pair[t] = np.where(right >= 0, merges.rank(sym[t], sym[right]), none)
        return t

    while heap:
        r = heappop(heap)
        k = np.concatenate([np.array(x, np.int64) for x in index.pop(r)])
        k = np.sort(k[pair[k] == r])
        k = k[np.concatenate([[True], k[1:] != k[:-1]])] if len(k) else k
        if not len(k):
            continue
        every = k
        if len(k) > 1 and (meets := nxt[k[:-1]] == k[1:]).any():  # overlapping places: every second one of a run
            start = np.concatenate([[True], ~meets])
            first = np.maximum.accumulate(np.where(start, np.arange(len(k)), 0))
            k = k[(np.arange(len(k)) - first) % 2 == 0]
        again = len(k) > 1 and (word[k[1:]] == word[k[:-1]]).any()  # a word that has the pair twice
        if again:
            j = nxt[k]
            saved = sym[k], nxt[k], nxt[j], pair[j], prev[k]
            side = np.flatnonzero(nxt[j[:-1]] == k[1:])  # places side by side: between their merges there is another pair
            between = merges.rank(np.full(len(side), r), sym[k[1:][side]])
        t = apply(k, r)
        if again and min(pair[t].min(), between.min(initial=none)) <= r:  # a merge made an earlier pair: undo, and let each word's first place go alone
            sym[k], nxt[k], alive[j], pair[j], prev[k] = saved[0], saved[1], True, saved[3], saved[4]
            prev[saved[2][saved[2] >= 0]] = j[saved[2] >= 0]
            right = nxt[t]
            pair[t] = np.where(right >= 0, merges.rank(sym[t], sym[right]), none)
            one = np.concatenate([[True], word[k[1:]] != word[k[:-1]]])
            index[r] = [np.setdiff1d(every, k[one], assume_unique=True)]
            heappush(heap, r)
            t = apply(k[one], r)
        found = pair[t]
        t, found = t[found < none], found[found < none]
        order = np.argsort(found, kind="stable")
        t, found = t[order], found[order]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(found)) + 1]) if len(found) else found
        cuts = [*starts.tolist(), len(found)]
        for new, i, j in zip(found[starts].tolist(), cuts, cuts[1:]):
            if new in index:
                index[new].append(t[i:j])
            else:
                index[new] = [t[i:j]]
                heappush(heap, new)
    left = np.bincount(word[alive], minlength=len(words))
    packed, ends = sym[alive].astype("<u4").tobytes(), np.cumsum(left) * 4
    return [packed[i:j] for i, j in zip((ends - left * 4).tolist(), ends.tolist())]


BLOCK = 100_000  # words that are replayed together


class Encoder:
    """Encodes slices of texts; lives once per Python worker. ``keep`` bounds the words that it remembers."""

    def __init__(self, ranks_path: str, pattern: str, keep: int = 200_000):
        self.merges = merges_of(ranks_path)
        self.find, self.find_any = (re.compile(unfold(pattern, top)).findall for top in (0xFFFF, 0x10FFFF))
        self.keep = keep
        self.words: dict[str, bytes] = {}  # match of the pattern -> its ids, packed

    def split(self, text: str | None) -> list[str]:
        return (self.find_any if _ASTRAL(text) else self.find)(text) if text else []

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, packed as little-endian uint32."""
        gc.disable()  # millions of strings, no cycles
        try:
            # Texts are split twice, as the matches of a whole slice take many times its memory.
            new: set[str] = set()
            for t in texts:
                new.update(self.split(t))
            unknown = new.difference(self.words)
            if len(self.words) + len(unknown) > self.keep:
                self.words, unknown = {}, new
            del new
            unknown = list(unknown)
            for i in range(0, len(unknown), BLOCK):
                some = unknown[i : i + BLOCK]
                self.words.update(zip(some, replay([w.encode() for w in some], self.merges)))
            get = self.words.__getitem__
            out = [b"".join(map(get, self.split(t))) for t in texts]
            if len(self.words) > self.keep:  # an idle worker holds little
                self.words = {}
            return out
        finally:
            gc.enable()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.merges.spell.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ASTRAL = re.compile("[\U00010000-\U0010ffff]").search


def unfold(pattern: str, top: int) -> str:
    """``pattern`` for Python's ``re``: ``\\s`` and ``\\p{..}`` become ranges of code points up to ``top``."""
    import regex

    every = "".join(map(chr, (c for c in range(top + 1) if not 0xD800 <= c <= 0xDFFF)))

    def ranges(name: str) -> str:
        if name not in known:
            known[name] = "".join(f"\\U{ord(x[0]):08x}-\\U{ord(x[-1]):08x}" for m in regex.finditer(f"[{name}]+", every) for x in _runs(m[0]))
        return known[name]

    known = {"\\s": _WS}
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            m = re.compile(r"\\[pP]\{\w+\}|\\.").match(pattern, i)
            got = m[0]
            if got == "\\S":
                got = f"[^{_WS}]"
            elif got == "\\s" or got.startswith("\\p"):
                got = ranges(got) if in_class else f"[{ranges(got)}]"
            out.append(got)
            i = m.end()
            continue
        in_class = True if c == "[" else False if c == "]" else in_class
        out.append(c)
        i += 1
    return "".join(out)


def _runs(chars: str) -> list[str]:
    """Consecutive code points; the surrogates, which ``every`` leaves out, end a run."""
    return [chars] if not (chars[0] < "\ud800" <= chars[-1]) else [x for x in ("".join(c for c in chars if c < "\ud800"), "".join(c for c in chars if c > "\udfff")) if x]


_MERGES: dict[str, Merges] = {}


def merges_of(path: str) -> Merges:
    if path not in _MERGES:
        _MERGES[path] = Merges(load_ranks(path))
    return _MERGES[path]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(ranks_path: str, pattern: str) -> Encoder:
    if (key := (ranks_path, pattern)) not in _ENCODERS:
        _ENCODERS[key] = Encoder(ranks_path, pattern)
    return _ENCODERS[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 16 << 20) -> DataFrame:
    """``(id_col, n_tokens long, ids binary)``: ids as little-endian uint32. One row for each input row."""

    def run(rows):
        enc = encoder(ranks_path, pattern)
        for b in batches(rows, slice_bytes):
            ids = enc.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, bytes binary)`` from packed ids; null ids give empty bytes."""

    def run(rows):
        spell = None
        for b in batches(rows):
            spell = spell or merges_of(ranks_path).spell
            got = [b"".join(map(spell.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], ["id", "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 16 << 20) -> DataFrame:
    """Encode and decode in one pass: ``(id_col, n_tokens, ids_sha256, decoded_sha256)``, hashes as lowercase hex."""

    def run(rows):
        enc = encoder(ranks_path, pattern)
        for b in batches(rows, slice_bytes):
            ids = enc.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import read

    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)

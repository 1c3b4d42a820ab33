"""Token ids as canonical, length-limited Huffman code in independent blocks with bit-offset checkpoints.

File format (version 1), a folder with two Parquet tables, so that Spark commits, splits and retries them:

``code``    one row for each id that occurs: ``id``, ``length`` (bits). Codes are canonical: ids in the order of
            (length, id) get consecutive code words, so lengths alone restore the code.
``blocks``  one row for each block: ``part`` (range partition), ``block`` (number in it), ``n_tokens``, ``payload``
            (code words, most significant bit first), ``checkpoints`` (bit offset of each 256th token), and by document
            ``doc_ids``, ``doc_tokens``. Parts, blocks and documents ascend by doc_id.

A block is decoded without any other. Decoding is driven by a table indexed by the next ``max_bits`` bits, and all
checkpoints of a block advance together.

Edge cases: a null text counts as empty; an empty table gives empty files; repeated or null doc_ids stay separate rows
(nulls first, ties in the order of their ids' hash); one id that fills the corpus gets a code of one bit; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
from heapq import merge

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_path, stage
from .common import batches, bounded, read

STRIDE = 256  # tokens between checkpoints


# --- ids ------------------------------------------------------------------------------------------------------------


class LibraryIds:
    """Ids of texts by a file of the tokenizers library, remembered by blank-free piece (bounded number).

    A piece between ASCII blanks is encoded by the library itself. That equals encoding the whole text where the file's
    normalizer and splitter treat blanks as borders (NFC, blank runs to one blank, lower case; a splitter that drops
    blanks and takes runs of letters); A-Z are lower-cased before, as the normalizer does. Texts with a special token's
    string, and all texts under another kind of file, are given to the library whole.

    Most pieces are a word of letters, perhaps with punctuation behind it, and both parts are tokens by themselves for
    the splitter. New words go to the library many at a time, with blanks between them: the last token of a word bears
    the suffix of word ends and no other does, so the ids fall apart into words by themselves (checked by number). All
    other pieces are encoded alone. Pieces are kept in two generations: what the older one has and is met again moves to
    the younger, so that frequent pieces stay when the older is dropped.
    """

    def __init__(self, path: str, width: int = 4, keep: int = 1_200_000):
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.lib, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.width, self.keep = width, keep
        self.pieces: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        if width == 2 and self.lib.get_vocab_size() > 1 << 16:
            raise ValueError("ids need 4 bytes")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        norm = spec["normalizer"] or {"type": ""}
        split, *rest = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        pattern = (split.get("pattern") or {}).get("Regex", "")
        suffix = spec["model"].get("end_of_word_suffix")
        self.by_piece = (
            {n["type"] for n in norm.get("normalizers", [norm])} == {"NFC", "Replace", "Lowercase"}
            and (split.get("type"), split.get("behavior"), split.get("invert")) == ("Split", "Removed", True)
            and {"[\\p{L}]+", "[^\\s\\p{L}\\p{N}]+"} <= set(pattern.split("|")) and [r["type"] for r in rest] == ["ByteLevel"] and bool(suffix)
        )
        if self.by_piece:
            # For words that the normalizer would leave as they are and the splitter whole.
            self.plain.normalizer = None
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def _alone(self, pieces: list[bytes]) -> None:
        for k in range(0, len(pieces), 10_000):
            some = pieces[k : k + 10_000]
            got = self.lib.encode_batch_fast([x.decode() for x in some], add_special_tokens=False)
            self.pieces.update((x, self._pack(e.ids)) for x, e in zip(some, got))

    def _words(self, words: list[bytes]) -> None:
        """Words of letters, 200 at a time."""
        w, odd = self.width, []
        for k in range(0, len(words), 200):
            some = words[k : k + 200]
            ids = np.array(self.plain.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, f"<u{w}")
            stop = (w * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            packed = ids.tobytes()
            if len(stop) == len(some) and stop[-1] == len(packed):
                self.pieces.update(zip(some, [packed[i:j] for i, j in zip([0, *stop], stop)]))
            else:
                odd += some
        self._alone(odd)

    def _known(self, new: set[bytes]) -> set[bytes]:
        """Those of ``new`` that the older generation has; they move to the younger one."""
        known = self.older.keys() & new if self.older else set()
        self.pieces.update(zip(known, map(self.older.__getitem__, known)))
        return known

    def _learn(self, new: set[bytes]) -> None:
        """Ids of pieces that the younger generation hasn't."""
        pieces = list(new - self._known(new))
        stems = [x.rstrip(_MARKS) for x in pieces]  # a word has only punctuation behind it
        words = {w for w in stems if w.isalpha()}
        words.update(_WORD.findall(b"\n".join([w for w in stems if not w.isascii()])))
        alone = {x for x, w in zip(pieces, stems) if w not in words}
        alone.update({x[len(w) :] for x, w in zip(pieces, stems) if w in words and len(w) < len(x)})
        fresh = words.difference(self.pieces)
        self._words(list(fresh - self._known(fresh)))
        self._alone(list(alone.difference(self.pieces)))
        get = self.pieces.__getitem__
        self.pieces.update((x, get(w) + get(x[len(w) :])) for x, w in zip(pieces, stems) if w in words and len(w) < len(x))

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text, packed. Texts are held together: a caller bounds their size.

        Arrow splits the texts and numbers their distinct pieces; only these meet the pieces that are remembered, and
        Arrow puts their ids in the places of the pieces.
        """
        col = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        whole = np.full(len(col), not self.by_piece)
        for s in self.special:
            whole |= pc.match_substring(col, s).to_numpy(zero_copy_only=False)
        alone = {i: self._pack(self.lib.encode(col[i].as_py(), add_special_tokens=False).ids) for i in np.flatnonzero(whole).tolist()}
        if len(alone) == len(col):
            return list(alone.values())
        cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(whole, "", col) if alone else col))
        pieces = cut.values.dictionary_encode()
        seen = pieces.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(self._ids(seen), pa.binary()).take(pieces.indices)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(ids))])[cut.offsets].tolist()
        packed = memoryview(ids.buffers()[2] or b"")
        return [alone[i] if i in alone else bytes(packed[j:k]) for i, (j, k) in enumerate(zip(ends, ends[1:]))]

    def _ids(self, seen: list[bytes]) -> list[bytes]:
        new = {x for x in seen if x not in self.pieces}
        if len(self.pieces) + len(new) > self.keep // 2:
            self.older, self.pieces, new = self.pieces, {}, set(seen)
        self._learn(new)
        return list(map(self.pieces.__getitem__, seen))


#: Punctuation of ASCII.
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: A word in lower-case letters of ASCII, Latin-1 or Cyrillic (composed, and letters in every version of Unicode).
_WORD = re.compile(rb"^(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf]|\xd0[\xb0-\xbf]|\xd1[\x80-\x9f])+$", re.M)

_LIBS: dict[tuple[str, int], LibraryIds] = {}


def library_ids(docs: DataFrame, path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``(doc_id, ids binary, counts binary)``: little-endian ids of ``width`` bytes of each text, then ``end_id`` if given.

    ``counts`` stands in the first row of each Arrow batch (null in the others): the batch's ids and how often each
    occurs, as pairs of uint32. ``width`` 2 halves what is moved, for vocabularies of up to 65,536 ids.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(rows):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if (path, width) not in _LIBS:
            _LIBS[path, width] = LibraryIds(path, width)
        end = np.array([] if end_id is None else [end_id], f"<u{width}").tobytes()
        for b in batches(rows):
            ids = [x + end for x in _LIBS[path, width].encode(b.column(1))]
            total = np.bincount(np.frombuffer(b"".join(ids), f"<u{width}"))
            used = np.flatnonzero(total)
            counts = [np.stack([used, total[used]], axis=1).astype("<u4").tobytes(), *[None] * (len(ids) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "ids", "counts"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, ids binary, counts binary")


# --- code -----------------------------------------------------------------------------------------------------------


def code_lengths(counts: dict[int, int], max_bits: int) -> dict[int, int]:
    """Optimal lengths of at most ``max_bits`` bits (package-merge). At most as many ids as the vocabulary has."""
    if not counts:
        return {}
    if len(counts) == 1:
        return {next(iter(counts)): 1}
    if len(counts) > 1 << max_bits:
        raise ValueError(f"{len(counts)} ids need codes of over {max_bits} bits")
    ids = sorted(counts, key=lambda i: (counts[i], i))
    leaves = [(counts[i], k, None) for k, i in enumerate(ids)]
    row = leaves
    for _ in range(max_bits - 1):
        packages = [(a[0] + b[0], len(ids), (a, b)) for a, b in zip(row[::2], row[1::2])]
        row = list(merge(leaves, packages, key=lambda x: x[0]))
    length = [0] * len(ids)
    stack = row[: 2 * len(ids) - 2]
    while stack:
        _, k, pair = stack.pop()
        if pair is None:
            length[k] += 1
        else:
            stack += pair
    return dict(zip(ids, length))


class Code:
    """Canonical code from lengths: encoder arrays and the decoding table."""

    def __init__(self, lengths: dict[int, int]):
        self.max_bits = max(lengths.values(), default=1)
        size = max(lengths, default=0) + 1
        self.bits = np.zeros(size, np.int64)
        self.word = np.zeros(size, np.int64)
        ids = np.array(sorted(lengths, key=lambda i: (lengths[i], i)), np.int64)
        lens = np.array([lengths[i] for i in ids.tolist()], np.int64)
        width = 1 << (self.max_bits - lens)
        at = np.cumsum(width) - width  # canonical words, left-aligned
        self.bits[ids], self.word[ids] = lens, at >> (self.max_bits - lens)
        self.table = np.zeros(1 << self.max_bits, np.int32 if size < 1 << 25 else np.int64)  # id << 6 | bits
        used = int(width.sum())
        self.table[:used] = np.repeat(ids << 6 | lens, width)

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Code words and checkpoints (bit offsets) of documents with ``sizes`` ids each; every document starts at a byte."""
        n = self.bits[ids]
        after = np.concatenate([[0], np.cumsum(n)])
        first = np.concatenate([[0], np.cumsum(sizes)])
        bits = after[first[1:]] - after[first[:-1]]
        size = (bits + 7) // 8
        byte = np.cumsum(size) - size
        start = after[:-1] + np.repeat(byte * 8 - after[first[:-1]], sizes)
        slot, shift = start >> 5, 64 - (start & 31) - n  # a word lies in two neighbouring 32-bit slots
        both = self.word[ids].astype(np.uint64) << shift.astype(np.uint64)
        total = int(size.sum())
        slots = total // 4 + 3
        hi = np.bincount(slot, (both >> np.uint64(32)).astype(np.float64), slots)
        lo = np.bincount(slot + 1, (both & np.uint64(0xFFFFFFFF)).astype(np.float64), slots)
        payload = (hi + lo).astype(np.uint64).astype(">u4").tobytes()[:total]
        nth = np.arange(len(ids)) - np.repeat(first[:-1], sizes)
        return payload, start[nth % STRIDE == 0]

    def decode(self, payload: bytes, checkpoints: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """All ids of a block. Each checkpoint is followed by ``counts`` ids; all advance together, the longest first."""
        out = np.zeros(int(counts.sum()), np.int64)
        base = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        at, base, counts = checkpoints[order].astype(np.int64), base[order], counts[order]
        raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        peek = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        down, mask = 32 - self.max_bits, (1 << self.max_bits) - 1
        live = np.searchsorted(-counts, -np.arange(STRIDE), "left")  # how many have more than k ids
        for k, m in enumerate(live.tolist()):
            if not m:
                break
            at = at[:m]
            got = self.table[(peek[at >> 3] >> (down - (at & 7))) & mask]
            out[base[:m] + k] = got >> 6
            at = at + (got & 63)
        return out


def count_ids(encoded: DataFrame) -> DataFrame:
    """Global counts ``(id, n)`` from the batches' counts; a task sends one row for each id that it has."""

    def run(rows):
        total = np.zeros(0, np.int64)
        for b in rows:
            for x in b.column(0):
                got = np.frombuffer(x.as_py(), "<u4").reshape(-1, 2).astype(np.int64)
                if len(got) and got[-1, 0] >= len(total):
                    total = np.concatenate([total, np.zeros(got[-1, 0] + 1 - len(total), np.int64)])
                total[got[:, 0]] += got[:, 1]
        ids = np.flatnonzero(total)
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    return encoded.select("counts").filter("counts is not null").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


# --- files ----------------------------------------------------------------------------------------------------------


def write(encoded: DataFrame, path: str, width: int = 4, max_bits: int = 16, block_tokens: int = 1 << 18, max_ids: int = 1 << 20) -> None:
    """Write ``(doc_id, ids, counts)`` in the file format, in ascending doc_id order. ``encoded`` should be stored: ids are read twice.

    The counts that the driver gets have a row for each id of the vocabulary at most (checked against ``max_ids``).
    Documents are dealt by ranges of the stored ids and packed in order, so that packing runs once.
    """
    spark = encoded.sparkSession
    counts = {r["id"]: r["n"] for r in count_ids(encoded).limit(max_ids + 1).collect()}
    bounded(len(counts), max_ids, "ids in use")
    lengths = code_lengths(counts, min(24, max(max_bits, (max(1, len(counts)) - 1).bit_length())))
    spark.createDataFrame(sorted(lengths.items()), "id bigint, length int").coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast(lengths)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def pack(rows):
        """Documents in order -> blocks. A document over the size of a block ends its block."""
        code, part, number, first = Code(shared.value), TaskContext.get().partitionId(), 0, 0
        ids, texts, held = [], [], 0

        def block():
            sizes = np.array([len(x) // width for x in texts], np.int64)
            payload, marks = code.encode(np.frombuffer(b"".join(texts), f"<u{width}").astype(np.int64), sizes)
            cols = [part], [number], [first], [held], [payload], [marks], [ids], [sizes]
            kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(kind_of), pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["part", "block", "first", "n_tokens", "payload", "checkpoints", "doc_ids", "doc_tokens"])

        for b in rows:
            kind_of = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(doc)
                texts.append(text.as_py() or b"")
                held += len(texts[-1]) // width
                if held >= block_tokens or len(ids) >= block_tokens:
                    yield block()
                    number, first, ids, texts, held = number + 1, first + held, [], [], 0
        if ids:
            yield block()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded.select("doc_id", "ids", F.xxhash64("ids").alias("_h")).repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")
    blocks = ordered.mapInArrow(pack, f"part int, block int, first bigint, n_tokens bigint, payload binary, checkpoints array<bigint>, doc_ids array<{kind}>, doc_tokens array<bigint>")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def read_files(spark, path: str, max_ids: int = 1 << 20) -> DataFrame:
    """Documents back from the files: ``(doc_id, start, n_tokens, ids binary)``; ``start`` counts the ids of all before."""
    stored = {r["id"]: r["length"] for r in spark.read.parquet(f"{path}/code").limit(max_ids + 1).collect()}
    bounded(len(stored), max_ids, "ids in use")
    shared = spark.sparkContext.broadcast(stored)
    blocks = spark.read.parquet(f"{path}/blocks")
    # A row for each part; parts are as many as shuffle partitions.
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(rows):
        code = Code(shared.value)
        for b in rows:
            for payload, marks, ids, sizes, first in zip(*(c.to_pylist() for c in b.columns)):
                sizes = np.array(sizes, np.int64)
                lanes = (sizes + STRIDE - 1) // STRIDE
                counts = np.full(int(lanes.sum()), STRIDE, np.int64)
                ends = np.cumsum(lanes)[lanes > 0] - 1
                counts[ends] = (sizes - (lanes - 1) * STRIDE)[lanes > 0]
                flat = code.decode(payload, np.array(marks, np.int64), counts).astype("<u4")
                last = np.cumsum(sizes)
                got = [flat[i:j].tobytes() for i, j in zip((last - sizes).tolist(), last.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(2).type.value_type), pa.array(first + last - sizes), pa.array(sizes), pa.array(got, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    placed = blocks.join(F.broadcast(parts), "part").select("payload", "checkpoints", "doc_ids", "doc_tokens", (F.col("first") + F.col("base")).alias("first"))
    return placed.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")


def with_crc(read_back: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)``."""
    return read_back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_huffman(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ids = stage(library_ids(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, width=2), "ids")
    path = new_path(spark, "huffman")
    write(ids, path, width=2)
    return with_crc(read_files(spark, path))

"""Cross-tokenizer alignment, with corpus counts of id pairs by external spill counting.

Two tokenizers cut the same bytes (a blank and the text). Where both end a token the bytes fall into groups, and tokens
whose byte ranges overlap are linked. What a document's links are worth needs the counts of all id pairs of the corpus:

1. Tasks align documents and hold their (pair, document) records. So many links at a time make a run: its records are
   sorted with the B id as the major side, merged, cut by radix (low bits of the B id) and written as one zstd blob for
   each radix, in a table of the shared folder.
2. Runs are dealt to groups of about ``WAYS``. For each radix and group, a heap merges the runs' pairs and counts them.
   Counts of groups are summed by Spark, and the largest count of each B id comes from its section in side-major order.
3. The counts go back to the radix and group as one more run; the records of each run pass along them and give each
   document's contribution. Contributions are added up by run, where they meet the documents' rows.

A run, a group and a radix of a group are bounded at any size of the corpus: a pair that stands in every document adds
one entry to each run's pairs, and its records are spread over all groups.

Texts are aligned by unit: what lies between single blanks that have no white space beside them. Both tokenizers always
end a token before such a blank (checked for the vocabulary of B), so units are independent, and frequent ones are kept.

Edge cases: null and empty texts, and texts whose joined token bytes differ from blank + text under one tokenizer, have
no tokens: zeros and an empty group column. Repeated rows count as often as they occur, null doc_ids stay rows; an empty
table gives an empty result; columns other than id and text are ignored, whatever their names; texts are taken whole.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import join_counted
from ..session import stage
from .common import batches, read

RADIX = 16  # parts of the B ids, by their low bits
RUN_LINKS, RUN_DOCS = 2_000_000, 4096  # a run ends when it has so many links or documents
WAYS = 64  # runs that are merged together, about
KEEP = 150_000  # units that a worker remembers, in each of two generations


# --- tokens -----------------------------------------------------------------------------------------------------------


def byte_level() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies are written in: printable ones stand for themselves, the
    others are numbered from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


_BYTE = re.compile("<0x([0-9A-Fa-f]{2})>")


class Pair:
    """Both tokenizers, with the bytes of their ids, and the remembered units. Lives once per Python worker."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = byte_level()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.a_bytes[i] = bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        if len(self.a_bytes) > 1 << 16 or len(self.b_bytes) > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.by_unit = not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_size, self.b_size = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        self.spell = [f"{i}{end}" for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for end in ends for i in range(n)]
        self.spell_size = np.array(list(map(len, self.spell)))
        self.units: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def align(self, texts: list[str]) -> list[tuple | None]:
        """``(groups, pairs, n_a)`` of each text: the groups as text with an end mark each, linked ids as uint32
        ``b << 16 | a``, and the number of A tokens. None where the bytes differ."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        want = [(" " + t).encode() for t in texts]
        out: list[tuple | None] = [None] * len(texts)
        ok = [i for i, w in enumerate(want) if a[i] and b[i]]
        if len(ok) < len(want) or not all(self._spells(size, of, ids, want) for size, of, ids in ((self.a_size, self.a_bytes, a), (self.b_size, self.b_bytes, b))):
            ok = [i for i in ok if b"".join(map(self.a_bytes.__getitem__, a[i])) == want[i] and b"".join(map(self.b_bytes.__getitem__, b[i])) == want[i]]
        if not ok:
            return out
        na, nb = (np.cumsum([len(side[i]) for i in ok]) for side in (a, b))
        ida, idb = (np.fromiter(chain.from_iterable([side[i] for i in ok]), np.int64, n[-1]) for side, n in ((a, na), (b, nb)))
        ea, eb = np.cumsum(self.a_size[ida]), np.cumsum(self.b_size[idb])
        both = np.intersect1d(ea, eb, assume_unique=True)
        # Links: the B tokens from the one that ends after an A token's start to the one that covers its end.
        low, high = np.searchsorted(eb, ea - self.a_size[ida], "right"), np.searchsorted(eb, ea, "left")
        n = high - low + 1
        link = np.cumsum(n)
        at = np.repeat(low - (link - n), n) + np.arange(link[-1])
        pairs = (idb[at] << 16 | np.repeat(ida, n)).astype("<u4").tobytes()
        # Groups: tokens in the order of (group, side), each spelled with the mark behind it.
        ga, gb = np.searchsorted(both, ea), np.searchsorted(both, eb)
        upto_a, upto_b = np.searchsorted(ea, both, "right"), np.searchsorted(eb, both, "right")
        spelled = np.empty(len(ida) + len(idb), np.int64)
        spelled[np.arange(len(ida)) + np.where(ga > 0, upto_b[ga - 1], 0)] = ida + len(self.a_bytes) * (both[ga] == ea)
        spelled[np.arange(len(idb)) + upto_a[gb]] = 2 * len(self.a_bytes) + idb + len(self.b_bytes) * (both[gb] == eb)
        groups = "".join(map(self.spell.__getitem__, spelled.tolist()))
        ends = np.cumsum(self.spell_size[spelled])[na + nb - 1].tolist()
        cuts = (4 * link[na - 1]).tolist()
        for i, g0, g1, p0, p1, k in zip(ok, [0, *ends], ends, [0, *cuts], cuts, np.diff(na, prepend=0).tolist()):
            out[i] = groups[g0:g1], pairs[p0:p1], k
        return out

    @staticmethod
    def _spells(size: np.ndarray, of: list[bytes], ids: list[list[int]], want: list[bytes]) -> bool:
        """Whether the ids of each text spell it; all texts are compared at once."""
        n = [len(x) for x in ids]
        flat = np.fromiter(chain.from_iterable(ids), np.int64, sum(n))
        ends = np.cumsum(size[flat])[np.cumsum(n) - 1]
        return bool((np.diff(ends, prepend=0) == [len(w) for w in want]).all()) and b"".join(map(of.__getitem__, flat.tolist())) == b"".join(want)

    def documents(self, texts: list[str | None]) -> list[tuple]:
        """``(groups, pairs, n_a)`` of each text; empty where there are no tokens."""
        cut = [(t.split(" ") if self.by_unit else [t]) if t else [] for t in texts]
        seen = set().union(*cut)
        if len(self.units) + len(seen) > KEEP:
            self.older, self.units = self.units, {}
        new = seen.difference(self.units)
        known = new.intersection(self.older)
        self.units.update((u, self.older[u]) for u in known)
        new -= known
        beside = [u for u in new if not u or u[0].isspace() or u[-1].isspace()] if self.by_unit else []
        self.units.update(dict.fromkeys(beside))
        new = list(new.difference(beside))
        for i in range(0, len(new), 5000):
            self.units.update(zip(new[i : i + 5000], self.align(new[i : i + 5000])))
        out = []
        get = self.units.__getitem__
        for t, units in zip(texts, cut):
            got = list(map(get, units))
            if None in got:  # white space beside a blank; or the bytes may still be equal as a whole
                got = self.align(_APART.split(t)) if self.by_unit else got
                got = self.align([t]) if None in got else got
            if got and got[0]:
                groups, pairs, n_a = zip(*got)
                out.append(("".join(groups)[:-1], b"".join(pairs), sum(n_a)))
            else:
                out.append(_NOTHING)
        if len(seen) > KEEP:
            self.units = {}
        return out


_NOTHING = ("", b"", 0)
_APART = re.compile(r"(?<=\S) (?=\S)")
_PAIRS: dict[tuple[str, str], Pair] = {}


def tokenizers(a_path: str, b_path: str) -> Pair:
    if (key := (a_path, b_path)) not in _PAIRS:
        _PAIRS[key] = Pair(a_path, b_path)
    return _PAIRS[key]


# --- runs -------------------------------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(b"".join([np.array([len(a) for a in arrays], "<u4").tobytes(), *[a.tobytes() for a in arrays]]), 3)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(blob)
    sizes, at, out = np.frombuffer(raw, "<u4", len(kinds)).tolist(), 4 * len(kinds), []
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def sorted_run(pairs: list[bytes]) -> list[tuple[int, int, bytes]]:
    """``(radix, records, blob)`` of a run: distinct pairs in side-major order with their number of documents, and for
    each (pair, document) the document's place in the run (as differences) and the links."""
    place = np.repeat(np.arange(len(pairs), dtype=np.uint64), [len(p) // 4 for p in pairs])
    key, n = np.unique(np.frombuffer(b"".join(pairs), "<u4").astype(np.uint64) << np.uint64(16) | place, return_counts=True)
    pair, place = (key >> np.uint64(16)).astype("<u4"), (key & np.uint64(0xFFFF)).astype("<u2")
    radix = (pair >> 16) % RADIX
    out = []
    for r in np.unique(radix).tolist():
        at = np.flatnonzero(radix == r)
        own, first, docs = np.unique(pair[at], return_index=True, return_counts=True)
        links = np.add.reduceat(n[at], first).astype("<u4")
        out.append((r, len(at), pack(np.diff(own, prepend=np.uint32(0)), docs.astype("<u4"), links, np.diff(place[at], prepend=np.uint16(0)), n[at].astype("<u4"))))
    return out


def read_run(blob: bytes) -> tuple[np.ndarray, ...]:
    """``(pair, docs, links, place, n)`` of a run's blob."""
    pair, docs, links, place, n = unpack(blob, "<u4", "<u4", "<u4", "<u2", "<u4")
    return np.cumsum(pair, dtype=np.uint32), docs, links, np.cumsum(place, dtype=np.uint16), n


_STORED = "run bigint, place int, id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, radix int, blob binary"


def _aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """A row for each document, and for each run and radix its blob."""
    kind = docs.schema[id_col].dataType
    stored = _STORED.format(kind=kind.simpleString())

    def run(rows):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pair, number = tokenizers(a_path, b_path), TaskContext.get().partitionId() << 32
        held: list[bytes] = []
        links = 0

        def table(n, **columns):
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

        def blobs():
            got = sorted_run(held)
            if got:
                yield table(len(got), run=pa.array([number] * len(got), pa.int64()), radix=pa.array([g[0] for g in got], pa.int32()), blob=pa.array([g[2] for g in got], pa.binary()))

        schema = None
        for b in batches(rows, 4 << 20):
            if schema is None:
                types = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
                schema = pa.schema([(c.split()[0], types.get(c.split()[1]) if c.split()[0] != "id" else b.schema.field(0).type) for c in stored.split(", ")])
            gc.disable()
            got = pair.documents(b.column(1).to_pylist())
            gc.enable()
            start = 0
            while start < len(got):  # as many as the run still takes
                stop = start
                while stop < len(got) and len(held) < RUN_DOCS and links < RUN_LINKS:
                    held.append(got[stop][1])
                    links += len(got[stop][1]) // 4
                    stop += 1
                part, first = got[start:stop], len(held) - (stop - start)
                n_a = [g[2] for g in part]
                tokens, groups = [1 + sum(map(g[0].count, ",|;")) if g[0] else 0 for g in part], [g[0].count("|") for g in part]
                yield table(
                    len(part), run=pa.array([number] * len(part), pa.int64()), place=pa.array(range(first, len(held)), pa.int32()), id=b.column(0)[start:stop],
                    n_a=pa.array(n_a, pa.int64()), n_b=pa.array([t - a for t, a in zip(tokens, n_a)], pa.int64()), n_groups=pa.array(groups, pa.int64()),
                    n_links=pa.array([len(g[1]) // 4 for g in part], pa.int64()), groups_sha256=pa.array([hashlib.sha256(g[0].encode()).hexdigest() if g[0] else "" for g in part], pa.string()),
                )
                start = stop
                if len(held) >= RUN_DOCS or links >= RUN_LINKS:
                    yield from blobs()
                    held, links, number = [], 0, number + 1
        if held:
            yield from blobs()

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, stored)


# --- counts -----------------------------------------------------------------------------------------------------------


def _sections(rows, keys: int):
    """Rows of consecutive batches that share their first ``keys`` columns, as (key, list of row lists)."""
    at, held = None, []
    for b in rows:
        for row in zip(*[c.to_pylist() for c in b.columns]):
            if row[:keys] != at:
                if held:
                    yield at, held
                at, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield at, held


def _merged(rows):
    """Counts of the pairs of each radix and group: the runs' pairs come from a heap, in side-major order."""
    for (radix, group), runs in _sections(rows, 2):
        ways = []
        for (blob,) in runs:
            pair, _, links, _, _ = read_run(blob)
            ways.append(zip(pair.tolist(), links.tolist()))
        pairs, counts, last = [], [], -1
        for pair, links in heapq.merge(*ways):
            if pair == last:
                counts[-1] += links
            else:
                pairs.append(last := pair)
                counts.append(links)
        for i in range(0, len(pairs), 100_000):
            p, c = pairs[i : i + 100_000], counts[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([radix] * len(p), pa.int32()), pa.array([group] * len(p), pa.int64()), pa.array(p, pa.int64()), pa.array(c, pa.int64())], ["radix", "group", "pair", "links"])


def _contributed(rows):
    """Contributions of a radix and group by run: the counts come first, then the runs' blobs."""

    def give(run, blob, counts):
        pair, docs, _, place, n = read_run(blob)
        known, count, best = counts
        at = np.repeat(np.searchsorted(known, pair), docs)
        n = n.astype(np.int64)
        total, most = np.zeros(int(place.max()) + 1, np.int64), np.zeros(int(place.max()) + 1, np.int64)
        np.add.at(total, place, n * count[at])
        np.add.at(most, place, n * best[at])
        return run, pack(total, most)

    key, parts, counts = None, [], None
    for b in rows:
        radix, group = b.column(0).to_numpy(), b.column(1).to_numpy()
        cut = [0, *(np.flatnonzero((radix[1:] != radix[:-1]) | (group[1:] != group[:-1])) + 1).tolist(), b.num_rows]
        out = []
        for i, j in zip(cut, cut[1:]):
            if j == i:
                continue
            if (radix[i], group[i]) != key:
                key, parts, counts = (radix[i], group[i]), [], None
            part = b.slice(i, j - i)
            is_run = np.asarray(part.column(2).is_valid())
            k = int(np.argmax(is_run)) if is_run.any() else len(is_run)
            if k:
                parts.append([part.column(c).slice(0, k).to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 4, 5)])
            if k < len(is_run):
                if counts is None:
                    counts = [np.concatenate([p[c] for p in parts]) for c in range(3)]
                out += [give(r, x, counts) for r, x in zip(part.column(2).to_pylist()[k:], part.column(6).to_pylist()[k:])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["run", "blob"])


def _added(rows):
    """Documents with the sum of their run's contributions, which come before them."""
    run, total, most = None, None, None
    for b in rows:
        runs = b.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), b.num_rows]
        for i, j in zip(cut, cut[1:]):
            if j == i:
                continue
            if runs[i] != run:
                run, total, most = runs[i], np.zeros(RUN_DOCS, np.int64), np.zeros(RUN_DOCS, np.int64)
            part = b.slice(i, j - i)
            place = part.column(1)
            k = part.num_rows - len(place.drop_null())
            for blob in part.column(7).to_pylist()[:k]:
                t, m = unpack(blob, "<i8", "<i8")
                total[: len(t)] += t
                most[: len(m)] += m
            if k < part.num_rows:
                docs = part.slice(k)
                at = docs.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([*docs.columns[2:7], pa.array(most[at]), pa.array(total[at]), docs.column(8)], ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, a row for each row of ``docs``."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = stage(_aligned(docs, a_path, b_path, id_col, text_col), "aligned")
    blobs = stored.filter("blob is not null")
    groups = 1 + blobs.select("run").distinct().count() // WAYS
    blobs = blobs.select("radix", F.pmod(F.xxhash64("run"), F.lit(groups)).alias("group"), "run", "blob")
    merged = blobs.select("radix", "group", "blob").repartition(max(parts, RADIX), "radix", "group").sortWithinPartitions("radix", "group")
    counts = stage(merged.mapInArrow(_merged, "radix int, group bigint, pair bigint, links bigint"), "pair-counts")
    totals = counts.groupBy("pair").agg(F.sum("links").alias("count"), F.count(F.lit(1)).alias("d"))
    section = Window.partitionBy(F.shiftright("pair", 16))  # of a B id: at most as many pairs as A has ids
    totals = totals.withColumn("best", (F.col("count") == F.max("count").over(section)).cast("int"))
    known = join_counted(counts.select("radix", "group", "pair"), totals, "pair", counts.count())
    back = known.select("radix", "group", F.lit(None).cast("bigint").alias("run"), "pair", "count", "best").unionByName(blobs, allowMissingColumns=True)
    back = back.repartition(max(parts, RADIX), "radix", "group").sortWithinPartitions("radix", "group", F.col("run").asc_nulls_first(), "pair")
    given = back.mapInArrow(_contributed, "run bigint, blob binary")
    rows = stored.filter("blob is null").drop("radix", "blob").unionByName(given, allowMissingColumns=True)
    rows = rows.select("run", "place", "id", "n_a", "n_b", "n_groups", "n_links", "blob", "groups_sha256")
    rows = rows.repartition(parts, "run").sortWithinPartitions("run", F.col("place").asc_nulls_first())
    out = rows.mapInArrow(_added, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op13_cross_tokenizer(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))

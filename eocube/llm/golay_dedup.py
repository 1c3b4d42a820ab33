"""Near-duplicate detection: SimHash fingerprints and Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into A (23 bits), B (23) and C (18, in halves C1 and C2). The perfect Golay code (23,12)
gives a segment the index of the nearest codeword; the indices of the segment itself and of all its one-bit neighbours
are one or six in number, and segments that differ in one bit at most share an index. Of three errors, segments get
shares as below, and each case is caught by a key of 30 to 35 bits:

    A <= 1, B <= 1, a half of C free   (index A, index B, C1), (index A, index B, C2)
    A  = 0, B <= 1 | A <= 1, B = 0     (A, index B), (index A, B)
    A >= 2: B = 0 and C <= 1           (B, C1), (B, C2)     | B = 1 and C = 0   (index B, C)
    B >= 2: A = 0 and C <= 1           (A, C1), (A, C2)     | A = 1 and C = 0   (index A, C)

Equal fingerprints are one node, so exact copies never meet in a bucket. A bucket is verified in its task and gives a
spanning star of each connected group in it, not its pairs: small buckets by comparing, large ones by looking up all
one- and two-bit neighbours, whose number grows with the bucket and not with its square.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.skew import join_counted
from ..session import stage
from .common import as_bytes, batches, read, row_key, whole_row

# --- fingerprints ---------------------------------------------------------------------------------------------------


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle, repeats included; a shorter text is one shingle, one without words has none."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[:n].tolist()
    stops = (ends - 1)[min(size, len(words)) - 1 :].tolist()
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), [joined[i:j] for i, j in zip(starts, stops)]), np.uint64, n)


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """SimHash over word shingles, repeats included: bit set if set in over half of their hashes."""
    return simhash(shingles(text, size))


def simhash(h: np.ndarray) -> int:
    n = len(h)
    if not n:
        return 0
    ones = sum(np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, n, 65536))
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``(doc_id, fp long, _k1, _k2)``, a row for each input row; ``fp`` holds the 64 bits as a signed number."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(rows):
        for b in batches(rows):
            fp = np.array([fingerprint(t, size) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(2), b.column(3)], ["doc_id", "fp", "_k1", "_k2"])

    return docs.select(F.col(id_col), as_bytes(text_col), *row_key(id_col, text_col)).mapInArrow(run, f"doc_id {kind}, fp bigint, _k1 string, _k2 bigint")


# --- Golay code -----------------------------------------------------------------------------------------------------

_G = 0b110001110101  # generator polynomial of the binary Golay code (23,12)


def _remainder(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for i in range(22, 10, -1):
        v ^= np.where(v >> i & 1, _G << (i - 11), 0)
    return v


class Golay:
    """Index of the nearest codeword of 23-bit numbers. The code is perfect: each syndrome has one error of weight <= 3."""

    def __init__(self):
        bits = 1 << np.arange(23)
        one, two = bits, (bits[:, None] | bits)[np.triu_indices(23, 1)]
        three = np.unique(two[:, None] | bits)
        three = three[np.bitwise_count(three) == 3]
        errors = np.concatenate([[0], one, two, three])
        self.error = np.zeros(1 << 11, np.int64)
        self.error[_remainder(errors)] = errors
        self.high, self.low = _remainder(np.arange(1 << 12) << 11), _remainder(np.arange(1 << 11))

    def index(self, v: np.ndarray) -> np.ndarray:
        return (v ^ self.error[self.high[v >> 11] ^ self.low[v & 2047]]) >> 11

    def keys(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, index) pairs: the distinct indices of each segment and its one-bit neighbours."""
        got = self.index(v[:, None] ^ np.concatenate([[0], 1 << np.arange(23)]))
        got.sort(axis=1)
        keep = np.concatenate([np.ones((len(v), 1), bool), got[:, 1:] != got[:, :-1]], axis=1)
        return np.nonzero(keep)[0], got[keep]


_GOLAY: list[Golay] = []


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) pairs of signed 64-bit fingerprints, as in the table above."""
    if not _GOLAY:
        _GOLAY.append(Golay())
    g, u = _GOLAY[0], fp.view(np.uint64)
    a, b, c = (u >> np.uint64(41)).astype(np.int64), (u >> np.uint64(18)).astype(np.int64) & (1 << 23) - 1, u.astype(np.int64) & (1 << 18) - 1
    halves = c >> 9, c & 511
    (ra, ka), (rb, kb) = g.keys(a), g.keys(b)
    # All pairs of an index of A and one of B of the same row.
    na, nb = np.bincount(ra, minlength=len(fp)), np.bincount(rb, minlength=len(fp))
    first_b = np.cumsum(nb) - nb
    left = np.repeat(np.arange(len(ra)), nb[ra])
    inner = np.arange(len(left)) - np.repeat(np.cumsum(nb[ra]) - nb[ra], nb[ra])
    pair_row, pair = ra[left], ka[left] << 12 | kb[first_b[ra[left]] + inner]
    all_rows = np.arange(len(fp))
    families = [
        (pair_row, pair << 9 | halves[0][pair_row]), (pair_row, pair << 9 | halves[1][pair_row]),
        (rb, a[rb] << 12 | kb), (ra, b[ra] << 12 | ka),
        (all_rows, b << 9 | halves[0]), (all_rows, b << 9 | halves[1]), (rb, c[rb] << 12 | kb),
        (all_rows, a << 9 | halves[0]), (all_rows, a << 9 | halves[1]), (ra, c[ra] << 12 | ka),
    ]
    return np.concatenate([k | i << 36 for i, (_, k) in enumerate(families)]), np.concatenate([r for r, _ in families])


# --- links ----------------------------------------------------------------------------------------------------------

COMPARE = 1024  # a bucket of up to so many fingerprints is compared pair by pair inside its task


def bucket_stars(f: np.ndarray, within: int = 3) -> np.ndarray:
    """Edges (member, root) that connect what is connected by links of up to ``within`` (3) bits among distinct ``f``."""
    m = len(f)
    if m == 2:
        return f[None, ::-1] if np.bitwise_count(f[0] ^ f[1]) <= within else np.empty((0, 2), f.dtype)
    if m <= COMPARE:
        near = np.bitwise_count(f[:, None] ^ f) <= within
        i, j = np.nonzero(near)
    else:
        i, j = _neighbours(f)
    root = np.arange(m)
    while True:  # smallest label spreads; jumping halves the way
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            break
        root = new
    far = np.flatnonzero(root != np.arange(m))
    return np.stack([f[far], f[root[far]]], axis=1)


PLACES = 1 << 23  # places that are held at once


def _neighbours(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a graph with the same components: x and y at up to 3 bits meet as x^(<=1 bit) = y^(<=2 bits).

    Fingerprints that share a one-bit neighbour are at 2 bits at most, so one of them stands for all at that place.
    Places are taken by their remainder, so many at a time.
    """
    bit = np.concatenate([[0], 1 << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    turns = np.uint64(1 + 65 * len(f) // PLACES)
    left, right = [], []
    for turn in range(int(turns)):
        mine = lambda x: np.flatnonzero(x % turns == turn) if turns > 1 else np.arange(len(x))  # noqa: E731, B023
        place, owner = [], []
        for x in bit:
            at = mine(f ^ x)
            place.append((f ^ x)[at])
            owner.append(at)
        place, owner = np.concatenate(place), np.concatenate(owner)
        order = np.argsort(place, kind="stable")
        place, owner = place[order], owner[order]
        if not len(place):
            continue
        same = np.flatnonzero(place[1:] == place[:-1])
        left.append(owner[same])
        right.append(owner[same + 1])
        for k, x in enumerate(bit[1:]):
            for y in bit[k + 2 :]:
                want = f ^ (x | y)
                ask = mine(want)
                at = np.minimum(np.searchsorted(place, want[ask]), len(place) - 1)
                hit = place[at] == want[ask]
                left.append(ask[hit])
                right.append(owner[at[hit]])
    return np.concatenate(left), np.concatenate(right)


def links(nodes: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` that connect the distinct fingerprints ``fp`` linked at up to 3 bits."""

    def emit(rows):
        for b in rows:
            fp = b.column(0).to_numpy()
            for i in range(0, len(fp), 10_000):
                part = fp[i : i + 10_000]
                key, row = bucket_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], ["key", "fp"])

    def verify(rows):
        """Rows come sorted by key: buckets are runs. A run may go over batches."""
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the last bucket so far

        def stars(key, fp):
            cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            size = np.diff(cut)
            two = cut[:-1][size == 2]
            ok = np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= 3
            found = [np.stack([fp[two[ok]], fp[two[ok] + 1]], axis=1)]
            found += [bucket_stars(fp[i : i + n].view(np.uint64)).view(np.int64).reshape(-1, 2) for i, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist())]
            got = np.unique(np.concatenate(found), axis=0)
            if len(got):
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["u", "v"])

        def joined():
            return (np.concatenate([h[k] for h in held]) for k in (0, 1))

        for b in rows:
            key, fp = (c.to_numpy() for c in b.columns)
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))  # where the batch's last bucket begins
            if held and (last or key[0] != held[-1][0][-1]):
                held.append((key[:last], fp[:last]))
                yield from stars(*joined())
                held = []
            elif last:
                yield from stars(key[:last], fp[:last])
            held.append((key[last:], fp[last:]))
        if held:
            yield from stars(*joined())

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = nodes.select("fp").mapInArrow(emit, "key bigint, fp bigint").repartition(n, "key").sortWithinPartitions("key", "fp")
    return buckets.mapInArrow(verify, "u bigint, v bigint")


def classes(fps: DataFrame) -> DataFrame:
    """``(fp, root, component_id, d)`` for every distinct fingerprint of a stored table ``(doc_id, fp)``; ``d`` rows have it."""
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("d")), "fingerprints")
    return classes_of(nodes, links(nodes))


def classes_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    roots = connected_components(edges)
    named = stage(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "d", F.coalesce("component", "fp").alias("root")), "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    return stage(join_counted(named, least, "root", named.count(), "n").select("fp", "root", "component_id", "d"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, a row for each input row.

    Texts without words (null, empty, blank) have fingerprint zero and are linked like any other. Null doc_ids take
    part, but are never a component_id unless nothing else is in the class. Repeated rows stay.
    """
    fps = stage(fingerprints(docs, id_col, text_col), "document-fingerprints")
    return join_counted(fps, classes(fps), "fp", fps.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_sets(nodes: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` to confirm among stored shingle sets ``(fp, simhash)``: sets of one fingerprint with the first of
    them, and firsts along the links of their fingerprints at up to 3 bits."""
    prints = stage(nodes.groupBy("simhash").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("d")), "fingerprints")
    same = join_counted(nodes.select("simhash", "fp"), prints, "simhash", nodes.count()).filter("fp <> u").select("u", F.col("fp").alias("v"))
    near = stage(links(prints.select(F.col("simhash").alias("fp"))).distinct(), "fingerprint-links").withColumnsRenamed({"u": "member", "v": "simhash"})
    roots = prints.select("simhash", "u").join(near.groupBy("simhash").agg(F.count(F.lit(1)).alias("d")), "simhash")
    members = prints.select(F.col("simhash").alias("member"), F.col("u").alias("v"))
    return same.unionByName(join_counted(near, roots, "simhash", near.count()).join(members, "member").select("u", "v"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, similarity: float | None = None) -> DataFrame:
    """``docs`` with one row of each class: the one of the smallest doc_id (ties by content); all columns are kept.

    Classes are those of ``near_duplicates``; with a ``similarity``, of texts linked by that Jaccard of ``size``-word
    shingles (texts without words are then one class): SimHash and Golay keys link the near ones, ``minhash_join`` finds
    those farther than 3 bits, and every link is confirmed on full sets.
    """
    if similarity is None:
        fps = stage(fingerprints(docs, id_col, text_col, size), "document-fingerprints")
        of = classes(fps)
    else:
        from . import minhash_join

        fps = stage(minhash_join.described(docs, id_col, text_col, size, with_simhash=True), "document-sets")
        nodes = stage(minhash_join.node_table(fps), "shingle-sets")
        none = fps.filter("n_shingles = 0").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("d"))
        of = classes_of(stage(nodes.select("fp", "least", "d").unionByName(none), "all-sets"), minhash_join.links(nodes, docs, id_col, text_col, size, similarity, near_sets(nodes)))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "_k1", "_k2"))
    kept = join_counted(fps, of, "fp", fps.count()).groupBy("root").agg(best.alias("s")).select("s._k1", "s._k2").distinct()
    keyed = docs.select(whole_row(docs), *row_key(id_col, text_col))
    return keyed.join(kept, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select("_row.*")


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))

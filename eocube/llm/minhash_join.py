"""Near-duplicates by MinHash: a multi-index Hamming join of b-bit signatures, confirmed on the full shingle sets.

A signature has ``CHUNKS`` x ``WIDTH`` symbols of 8 bits, each of one MinHash value; its distance to another is the
number of symbols that differ. One error is allowed in a chunk, and it is enumerated: a chunk gives a key for each of
its symbols, made of all others. By pigeonhole, two signatures at up to ``2 * CHUNKS - 1`` (23 of 84) differing symbols
have a chunk with at most one error and so a common key: all pairs under that distance meet. Pairs at a larger distance
mostly meet as well: at Jaccard 0.8 a pair misses all keys with probability 3e-5, at 0.85 with 3e-7. Pairs that meet at
more than ``LIMIT`` symbols (probability 4e-7 at 0.8) are left out; all others are confirmed on full sets.

Texts with equal sets are one node, so exact copies never meet. Nodes of a bucket (one key):

* up to ``SMALL``: every pair is a candidate.
* more: each node is paired with the bucket's hub (the member with the most such buckets: of edited copies of a text,
  the one nearest to it). Then only buckets whose members are still of several components are left. These are split
  into blocks of bounded rows and bytes, each pair of blocks a cell, and searched in cells: first by signature for
  members that have a near one of another component, then those by full sets. Nothing is capped; a cell's memory is
  bounded; what a cell gives is a link between components, not its pairs.

Keys that many nodes have are found on a sample of nodes and never sorted into one task; whether a key is found there
changes the plan, not the result.

Edge cases: a text without words (null, empty, blank) has an empty set and is linked with nothing; null doc_ids take
part, but are a component_id only where a class has no other; repeated rows and repeated doc_ids stay; an empty table
gives an empty result; other columns are ignored, whatever their names; texts are taken whole.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.skew import join_counted
from ..session import stage
from .common import as_bytes, batches, read, row_key
from .golay_dedup import classes_of, shingles, simhash

CHUNKS, WIDTH = 12, 7
SYMBOLS = CHUNKS * WIDTH
LIMIT = 36  # differing symbols beyond which a pair isn't confirmed
SMALL = 8  # members of a bucket that are all paired
CELL_ROWS, CELL_BYTES = 4096, 32 << 20  # of a block of a large bucket
_RANDOM = np.random.default_rng(7).integers(0, 1 << 64, (3, SYMBOLS), np.uint64)
_XOR, _ODD, _SALT = _RANDOM[0], _RANDOM[1] | np.uint64(1), _RANDOM[2]
_MIX = np.random.default_rng(8).integers(0, 1 << 64, (SYMBOLS, 256), np.uint64)


# --- signatures -------------------------------------------------------------------------------------------------------


def signature(h: np.ndarray) -> bytes:
    """The symbols of a shingle set, a byte each."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1024):
        low = np.minimum(low, ((h[i : i + 1024, None] ^ _XOR) * _ODD).min(axis=0))
    return ((low ^ low >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8).tobytes()


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each symbol: of its chunk without that symbol. ``sig`` has a row for each node."""
    mixed = _MIX[np.arange(SYMBOLS), sig]
    whole = np.repeat(mixed.reshape(len(sig), CHUNKS, WIDTH).sum(axis=2, dtype=np.uint64), WIDTH, axis=1)
    return (whole - mixed + _SALT).view(np.int64)


def described(docs: DataFrame, id_col: str, text_col: str, size: int, with_simhash: bool = False) -> DataFrame:
    """``(doc_id, fp, n_shingles, sig, _k1, _k2)``: ``fp`` names the shingle set, 0 if it is empty; on demand its ``simhash``."""
    import xxhash

    kind = docs.schema[id_col].dataType.simpleString()

    def run(rows):
        for b in batches(rows):
            sets = [np.unique(shingles(t, size)) for t in b.column(1).to_pylist()]
            fp = np.array([xxhash.xxh64_intdigest(h.tobytes()) or 1 if len(h) else 0 for h in sets], np.uint64).view(np.int64)
            sig = pa.array([signature(h) if len(h) else b"" for h in sets], pa.binary())
            columns = {"doc_id": b.column(0), "fp": pa.array(fp), "n_shingles": pa.array(list(map(len, sets)), pa.int64()), "sig": sig, "_k1": b.column(2), "_k2": b.column(3)}
            if with_simhash:
                columns["simhash"] = pa.array(np.array(list(map(simhash, sets)), np.uint64).view(np.int64))
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col(f"`{id_col}`"), as_bytes(text_col), *row_key(id_col, text_col)).mapInArrow(run, f"doc_id {kind}, fp bigint, n_shingles bigint, sig binary, _k1 string, _k2 bigint" + ", simhash bigint" * with_simhash)


# --- candidates -------------------------------------------------------------------------------------------------------


def _keys(nodes: DataFrame) -> DataFrame:
    def run(rows):
        for b in rows:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, SYMBOLS)
                key = chunk_keys(sig)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), SYMBOLS))], ["key", "fp"])

    return nodes.select("fp", "sig").mapInArrow(run, "key bigint, fp bigint")


def _frequent(nodes: DataFrame, n: int) -> DataFrame:
    """Keys that are surely frequent, at most 5,000, as a sample of about 100,000 nodes shows."""
    part = max(1, n // 100_000)
    some = nodes.filter(F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(part)) == 0)
    most = max(50, 2 * SYMBOLS * (n // part) // 10_000)
    return _keys(some).groupBy("key").count().filter(F.col("count") >= most).select("key")


def _bucketed(rows):
    """Rows come sorted by (key, fp). Pairs ``(u, v)`` of small buckets; ``(u, null, key)`` for each member of a large one."""

    def batch(u, v, key):
        return pa.RecordBatch.from_arrays([pa.array(u), v, key], ["u", "v", "key"])

    def small(key, fp, cut):
        size, found = np.diff(cut), []
        for s in range(2, SMALL + 1):
            at = cut[:-1][size == s]
            found += [np.stack([fp[at + i], fp[at + j]], axis=1) for i in range(s) for j in range(i + 1, s)] if len(at) else []
        if found:
            got = np.unique(np.concatenate(found), axis=0)
            yield batch(got[:, 0], pa.array(got[:, 1]), pa.nulls(len(got), pa.int64()))
        big = np.repeat(size > SMALL, size)
        if big.any():
            yield large(key[big], fp[big])

    def large(key, fp):
        return batch(fp, pa.nulls(len(fp), pa.int64()), pa.array(key))

    open_key, open_fp, is_large = None, np.empty(0, np.int64), False
    for b in rows:
        key, fp = (c.to_numpy() for c in b.columns)
        if not len(key):
            continue
        if open_key is not None:
            more = int(np.searchsorted(key, open_key, "right"))
            if is_large:
                if more:
                    yield large(key[:more], fp[:more])
                key, fp = key[more:], fp[more:]
            else:
                key, fp = np.concatenate([np.full(len(open_fp), open_key), key]), np.concatenate([open_fp, fp])
            if not len(key):
                continue
        cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        last = int(cut[-2])
        yield from small(key[:last], fp[:last], cut[:-1])
        open_key, open_fp, is_large = key[-1], fp[last:], len(key) - last > SMALL
        if is_large:
            yield large(key[last:], open_fp)
            open_fp = open_fp[:0]
    if len(open_fp) > 1:
        yield from small(np.full(len(open_fp), open_key), open_fp, np.array([0, len(open_fp)]))


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(u, v)`` of small buckets and with hubs, and the members ``(key, fp)`` of large buckets, of stored ``nodes``."""
    spark = nodes.sparkSession
    n = nodes.count()
    frequent = F.broadcast(stage(_frequent(nodes, n), "frequent-keys"))
    keys = _keys(nodes)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rare = keys.join(frequent, "key", "left_anti").repartition(parts, "key").sortWithinPartitions("key", "fp").mapInArrow(_bucketed, "u bigint, v bigint, key bigint")
    often = keys.join(frequent, "key", "left_semi").select(F.col("fp").alias("u"), F.lit(None).cast("bigint").alias("v"), "key")
    buckets = stage(rare.unionByName(often), "buckets")
    members = buckets.filter("v is null").select("key", F.col("u").alias("fp"))
    pairs = buckets.filter("v is not null").select("u", "v")
    if not members.isEmpty():
        many = members.groupBy("fp").agg(F.count(F.lit(1)).alias("k"))
        hub = members.join(many, "fp").groupBy("key").agg(F.max(F.struct("k", "fp"))["fp"].alias("hub"), F.count(F.lit(1)).alias("d"))
        near = join_counted(members, hub, "key", SYMBOLS * n).filter("fp <> hub").select(F.col("hub").alias("u"), F.col("fp").alias("v"))
        pairs = pairs.unionByName(near)
    return pairs.distinct(), members


# --- links ------------------------------------------------------------------------------------------------------------


def similar(a: np.ndarray, b: np.ndarray, least: Fraction) -> bool:
    """Whether the Jaccard of two sorted sets is at least ``least``, in whole numbers."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both * least.denominator >= least.numerator * (len(a) + len(b) - both)


def _signed(pairs: DataFrame, nodes: DataFrame, least: Fraction) -> DataFrame:
    """The pairs that signatures and set sizes allow."""
    side = lambda c: nodes.select(F.col("fp").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n_shingles").alias(f"n_{c}"))

    def run(rows):
        for b in rows:
            if b.num_rows:
                a, c = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, SYMBOLS) for k in (2, 3))
                keep = (a != c).sum(axis=1) <= LIMIT
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], ["u", "v"])

    both = join_counted(pairs, side("u").join(pairs.groupBy("u").agg(F.count(F.lit(1)).alias("d")), "u"), "u", SYMBOLS * nodes.count()).join(side("v"), "v")
    fits = F.least("n_u", "n_v") * least.denominator >= F.greatest("n_u", "n_v") * least.numerator
    return both.filter(fits).select("u", "v", "sig_u", "sig_v").mapInArrow(run, "u bigint, v bigint")


def sets_of(chosen: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(fp, shingles)``: the sorted sets of the nodes ``chosen`` (``fp``), made again from a text of each."""

    def run(rows):
        for b in batches(rows):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(shingles(t, size)).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["fp", "shingles"])

    rows = nodes.join(chosen, "fp", "left_semi").select("fp", "rep._k1", "rep._k2")
    texts = docs.select(*row_key(id_col, text_col), as_bytes(text_col).alias("_text")).join(rows, ["_k1", "_k2"]).dropDuplicates(["fp"])
    return texts.select("fp", "_text").mapInArrow(run, "fp bigint, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """The stored ``pairs`` whose sets reach ``least``. The pairs of one ``u`` are dealt to parts of about 1,024."""

    def run(rows):
        own = None
        for b in rows:
            hit = []
            for i, (v, x) in enumerate(zip(b.column(2).to_pylist(), b.column(3))):
                x = np.frombuffer(x.as_py(), np.uint64)
                if v is None:
                    own = x
                elif similar(own, x, least):
                    hit.append(i)
            got = b.take(pa.array(hit, pa.int64()))
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(2)], ["u", "v"])

    of = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / 1024).cast("int").alias("_k"))
    firsts = of.join(sets.withColumnRenamed("fp", "u"), "u").select("u", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("part"), F.lit(None).cast("bigint").alias("v"), "shingles")
    dealt = join_counted(pairs.withColumn("_h", F.xxhash64("v")), of.withColumn("d", F.col("_k") * 1024), "u", pairs.count()).select("u", F.pmod("_h", F.col("_k")).cast("int").alias("part"), "v")
    rest = dealt.join(sets.withColumnRenamed("fp", "v"), "v").select("u", "part", "v", "shingles")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = firsts.unionByName(rest).repartition(parts, "u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())
    return rows.mapInArrow(run, "u bigint, v bigint")


# --- large buckets ----------------------------------------------------------------------------------------------------


def cell_links(fp: np.ndarray, component: np.ndarray, n: np.ndarray, sig: np.ndarray, least: Fraction, sets: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Links between components in a cell: ``(u, v)`` that connect what links of full sets connect, each link of two parts
    that weren't connected. Without ``sets``: a near node for each node that has one of another component."""
    root = np.unique(component, return_inverse=True)[1]
    u, v = [], []
    for i in range(len(fp) - 1):
        rest = slice(i + 1, None)
        far = root[rest] != root[i]
        if not far.any():
            continue
        lo, hi = np.minimum(n[rest], n[i]), np.maximum(n[rest], n[i])
        at = np.flatnonzero(far & (lo * least.denominator >= hi * least.numerator)) + i + 1
        at = at[(sig[at] != sig[i]).sum(axis=1) <= LIMIT]
        if sets is None:
            u.append(np.full(len(at), i))
            v.append(at)
            continue
        for j in at.tolist():
            if root[j] != root[i] and similar(sets[i], sets[j], least):
                root[root == root[j]] = root[i]
                u.append([i])
                v.append([j])
    if not u:
        return fp[:0], fp[:0]
    u, v = np.concatenate(u).astype(np.int64), np.concatenate(v).astype(np.int64)
    if sets is None:
        met = np.unique(np.concatenate([u, v]))
        return fp[met], fp[met]
    return fp[u], fp[v]


def _cells(rows, least: Fraction, with_sets: bool):
    """Rows ``(cell, fp, component, n, sig[, shingles])`` come sorted by cell. Without sets: ``(cell, fp)`` of near nodes;
    with them: links ``(u, v)``."""
    at, held = None, []

    def done():
        c = [np.array([h[k] for h in held], np.int64) for k in (0, 1, 2)]
        sig = np.frombuffer(b"".join(h[3] for h in held), np.uint8).reshape(-1, SYMBOLS)
        u, v = cell_links(*c, sig, least, [np.frombuffer(h[4], np.uint64) for h in held] if with_sets else None)
        if len(u):
            first = pa.array(u) if with_sets else pa.array([at] * len(u), pa.string())
            yield pa.RecordBatch.from_arrays([first, pa.array(v)], ["u" if with_sets else "cell", "v" if with_sets else "fp"])

    for b in rows:
        for row in zip(*[c.to_pylist() for c in b.columns]):
            if row[0] != at:
                if held:
                    yield from done()
                at, held = row[0], []
            held.append(row[1:])
    if held:
        yield from done()


def rest_of_large(members: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, least: Fraction) -> DataFrame | None:
    """Links between components that large buckets still hold; None if each is of one component."""
    spark, n = nodes.sparkSession, nodes.count()
    named = members.join(roots, F.col("fp") == F.col("node"), "left").select("key", "fp", F.coalesce("component", "fp").alias("component"))
    named = named.join(nodes.select("fp", F.col("n_shingles").alias("n")), "fp")
    several = named.groupBy("key").agg(
        F.count(F.lit(1)).alias("d"), F.sum("n").alias("_n"), F.min("component").alias("_a"), F.max("component").alias("_b"), F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("_who")
    ).filter("_a <> _b")
    # Buckets of the same members are one.
    several = several.groupBy("d", "_who", "_n").agg(F.min("key").alias("key"))
    blocks = F.greatest(F.ceil(F.col("d") / CELL_ROWS), F.ceil(F.col("_n") * 8 / CELL_BYTES)).cast("int").alias("_g")
    left = stage(join_counted(named, several.select("key", "d", blocks), "key", SYMBOLS * n), "large-buckets")
    if left.isEmpty():
        return None
    block = F.pmod(F.xxhash64("fp"), F.col("_g")).cast("int")
    pair = F.concat_ws(".", F.col("key").cast("string"), F.least("_i", "_j").cast("string"), F.greatest("_i", "_j").cast("string"))
    cells = left.withColumn("_i", block).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_g") - 1))).select(pair.alias("cell"), "fp", "component", "n")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def by_cell(df):
        return df.repartition(parts, "cell").sortWithinPartitions("cell", "fp")

    signed = by_cell(cells.join(nodes.select("fp", "sig"), "fp").select("cell", "fp", "component", "n", "sig"))
    near = stage(signed.mapInArrow(lambda rows: _cells(rows, least, False), "cell string, fp bigint"), "near-members")
    sets = stage(sets_of(near.select("fp").distinct(), nodes, docs, id_col, text_col, size), "shingles")
    full = cells.join(near, ["cell", "fp"]).join(nodes.select("fp", "sig"), "fp").join(sets, "fp").select("cell", "fp", "component", "n", "sig", "shingles")
    return stage(by_cell(full).mapInArrow(lambda rows: _cells(rows, least, True), "u bigint, v bigint"), "large-links")


def links(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, similarity: float, near: DataFrame | None = None) -> DataFrame:
    """Edges ``(u, v)`` that connect what is linked by ``similarity`` among stored ``nodes`` ``(fp, sig, n_shingles, rep)``.

    ``rep`` is the ``row_key`` of a row of the node in ``docs``. Pairs ``near`` (u, v) that were found in another way are
    confirmed with those of the signatures.
    """
    least = Fraction(str(similarity))
    pairs, members = candidates(nodes)
    pairs = _signed(stage(pairs, "pairs"), nodes, least)
    pairs = stage(pairs if near is None else pairs.unionByName(near).distinct(), "near-pairs")
    chosen = pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).distinct()
    sets = stage(sets_of(chosen, nodes, docs, id_col, text_col, size), "shingles")
    found = stage(confirmed(pairs, sets, least), "links")
    if members.isEmpty():
        return found
    roots = stage(connected_components(found), "roots")
    more = rest_of_large(members, roots, nodes, docs, id_col, text_col, size, least)
    return found if more is None else roots.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)


def node_table(described_docs: DataFrame) -> DataFrame:
    """``(fp, least, d, n_shingles, sig, rep)``, a row for each set that isn't empty, of a stored table of ``described``."""
    some = described_docs.filter("n_shingles > 0")
    more = [F.first(c).alias(c) for c in ("simhash",) if c in described_docs.columns]
    return some.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("d"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.min(F.struct("_k1", "_k2")).alias("rep"), *more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row for each input row."""
    rows = stage(described(docs, id_col, text_col, size), "document-sets")
    nodes = stage(node_table(rows), "shingle-sets")
    of = classes_of(nodes.select("fp", "least", "d"), links(nodes, docs, id_col, text_col, size, similarity))
    linked = join_counted(rows.filter("n_shingles > 0").select("doc_id", "n_shingles", "fp"), of.select("fp", "component_id", "d"), "fp", rows.count())
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n_shingles", "component_id").unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_minhash_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))

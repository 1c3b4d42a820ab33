"""Benchmark decontamination with a distributed positional inverted index.

The documents are cut into segments of bounded size. A row of the index is a segment: all its terms, and for each term
the list of its word positions (documents of a segment follow each other with a gap, so a position names document and
word, and no phrase runs over a border), with the table of its documents. The index is a stored table of all terms: any
test set is looked up in it, and nothing is shuffled, as a segment is searched where it is read.

A test phrase (10 consecutive item words) is looked up by its terms from the rarest on (by counts over all segments;
of equals the first by bytes): the rarest term's list, moved back by its offset, is intersected with the next term's
moved list, and so on; what is left are exact occurrences. A proximity match is a place of the rarest term that has all
other terms of the phrase at most ``near`` words away, in one document. Lists of a frequent term are spread over
segments, so no task holds a whole list.

The test set is taken in blocks of bounded size (``block_words``): a block is what is sent to all tasks. A full block
takes some 80 MB on the driver and 100 MB more for its plan there and in each task (measured at 145,500 windows). Items longer
than a part of a block are cut into pieces that overlap by a phrase less a word.

Edge cases: null and empty texts have no words (n_words 0, not hit); items without words have no windows; a null
item_id counts as the empty string; repeated item_ids count once; a null doc_id is carried through; every input row
gives one result row; other columns are ignored, whatever their names; empty tables give no hits or no rows.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import as_bytes, batches, read, row_key, whole_row

#: Word bytes: digits, letters (A-Z become a-z) and all bytes of non-ASCII characters; the rest are blanks.
_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text, A-Z lower-cased."""
    return text.translate(_TABLE).split() if text else []


class TestSet:
    """A block of the test set: distinct windows as term numbers, and the items that have each."""

    def __init__(self, items: list[tuple[str, bytes | None]], n: int):
        windows: dict[tuple[int, ...], set[str]] = {}
        self.terms: dict[bytes, int] = {}
        for item, text in items:
            w = [self.terms.setdefault(x, len(self.terms)) for x in words(text)]
            for i in range(max(1, len(w) - n + 1)) if w else ():
                windows.setdefault(tuple(w[i : i + n]), set()).add(item)
        self.windows, self.items = list(windows), [sorted(x) for x in windows.values()]

    def plan(self, counts: dict[int, int]) -> dict[int, list[tuple[int, list[tuple[int, int]]]]]:
        """Rarest term -> windows that it opens: (number of the window, [(term, offset)] from the rarest on).

        Windows with a term that the documents don't have can't occur and are left out.
        """
        out: dict[int, list] = {}
        text = list(self.terms)
        for k, w in enumerate(self.windows):
            if all(t in counts for t in w):
                order = sorted(((t, i) for i, t in enumerate(w)), key=lambda x: (counts[x[0]], text[x[0]], x[1]))
                out.setdefault(order[0][0], []).append((k, order))
        return out


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 8 << 20) -> DataFrame:
    """The positional index, a row for each segment: ``(segment, doc_ids, k1, k2, n_words, terms, sizes, positions)``.

    ``terms`` are joined by blanks, ``sizes`` are the lengths of their lists, and ``positions`` the lists one after
    another, each as its first position and the steps to the next ones (all int32).
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(rows):
        seg = TaskContext.get().partitionId() << 32
        for b in batches(rows, segment_bytes):
            number: dict[bytes, int] = defaultdict(count().__next__)
            n, codes, gap = [], [], np.array([-1], np.int32)
            for t in b.column(1).to_pylist():
                w = words(t)
                n.append(len(w))
                codes += [np.fromiter(map(number.__getitem__, w), np.int32, len(w)), gap]
            flat = np.concatenate(codes)
            at = np.argsort(flat, kind="stable")[len(n) :].astype(np.int32)  # the gaps come first
            sizes = np.bincount(flat[at], minlength=len(number)).astype(np.int32)
            steps = np.diff(at, prepend=np.int32(0))
            first = (np.cumsum(sizes) - sizes)[sizes > 0]
            steps[first] = at[first]
            blobs = [pa.array([x], pa.binary()) for x in (b" ".join(number), sizes.tobytes(), steps.astype(np.int32).tobytes())]
            lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), c) for c in (b.column(0), b.column(2).cast(pa.string()), b.column(3), pa.array(n, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([seg]), *lists, *blobs], ["segment", "doc_ids", "k1", "k2", "n_words", "terms", "sizes", "positions"])
            seg += 1

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), as_bytes(text_col).alias("t"), *row_key(id_col, text_col))
    return source.mapInArrow(run, f"segment bigint, doc_ids array<{kind}>, k1 array<string>, k2 array<bigint>, n_words array<bigint>, terms binary, sizes binary, positions binary")


def _numbers(terms: bytes, known: dict[bytes, int]) -> np.ndarray:
    """Number of each term of a segment in the test set; -1 for others."""
    w = terms.split()
    return np.fromiter(map(known.get, w, repeat(-1)), np.int64, len(w))


def _chain(start: np.ndarray, order: list[tuple[int, int]], lists: dict[int, np.ndarray]) -> np.ndarray:
    """Starts of a window: the rarest list, intersected with the other lists moved by their offsets."""
    for term, offset in order[1:]:
        p = lists.get(term)
        if p is None or not len(start):
            return start[:0]
        want = start + offset
        at = np.minimum(np.searchsorted(p, want), len(p) - 1)
        start = start[p[at] == want]
    return start


def _near(at: np.ndarray, order: list[tuple[int, int]], lists: dict[int, np.ndarray], starts: np.ndarray, within: int) -> np.ndarray:
    """Places of the rarest term that have every other term of the window at most ``within`` words away, in one document."""
    for term in dict.fromkeys(t for t, _ in order if t != order[0][0]):
        p = lists.get(term)
        if p is None or not len(at):
            return at[:0]
        hit = np.zeros(len(at), bool)
        j = np.searchsorted(p, at)
        for k in (np.maximum(j - 1, 0), np.minimum(j, len(p) - 1)):
            hit |= (np.abs(p[k] - at) <= within) & (np.searchsorted(starts, p[k], "right") == np.searchsorted(starts, at, "right"))
        at = at[hit]
    return at


def search(index: DataFrame, test: TestSet, n: int, near: int) -> DataFrame:
    """Exact and proximity matches: ``(doc_id, _k1, _k2, n_words, hits array<int>, items array<string>, near_items array<string>)``.

    One row for each document; hits are the word positions inside occurrences. ``near`` 0 looks for no proximity matches.
    """
    known = index.sparkSession.sparkContext.broadcast(test.terms)

    def count_terms(rows):
        for b in rows:
            for terms, sizes in zip(*(c.to_pylist() for c in b.columns)):
                number = _numbers(terms, known.value)
                ours = np.flatnonzero(number >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(number[ours]), pa.array(np.frombuffer(sizes, np.int32)[ours].astype(np.int64))], ["term", "n"])

    # A row for each term of the block at most.
    counts = index.select("terms", "sizes").mapInArrow(count_terms, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    shared = index.sparkSession.sparkContext.broadcast((test.plan({r["term"]: r["n"] for r in counts}), test.items))
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        """The documents of a segment."""
        plan, names = shared.value
        number = _numbers(b.column("terms")[0].as_py(), known.value)
        sizes = np.frombuffer(b.column("sizes")[0].as_py(), np.int32).astype(np.int64)
        steps = np.frombuffer(b.column("positions")[0].as_py(), np.int32)
        stop = np.cumsum(sizes)
        ours = np.flatnonzero(number >= 0)
        lists = {k: np.cumsum(steps[i:j], dtype=np.int64) for k, i, j in zip(number[ours].tolist(), (stop - sizes)[ours].tolist(), stop[ours].tolist())}
        n_words = b.column("n_words").flatten().to_numpy()
        first = np.cumsum(n_words + 1) - (n_words + 1)
        cover = np.zeros(int((n_words + 1).sum()) + n + 1, np.int32)
        exact: dict[int, set[int]] = {}
        loose: dict[int, set[int]] = {}
        for rarest in lists.keys() & plan.keys():
            p = lists[rarest]
            for k, order in plan[rarest]:
                start = _chain(p - order[0][1], order, lists)
                if len(start):
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + len(order), -1)
                    for d in np.unique(np.searchsorted(first, start, "right") - 1).tolist():
                        exact.setdefault(d, set()).add(k)
                if near and len(at := _near(p, order, lists, first, near)):
                    for d in np.unique(np.searchsorted(first, at, "right") - 1).tolist():
                        loose.setdefault(d, set()).add(k)
        hit = np.flatnonzero(np.cumsum(cover) > 0)
        which = np.searchsorted(first, hit, "right") - 1
        ends = np.searchsorted(which, np.arange(len(first) + 1))
        inside = (hit - first[which]).astype(np.int32) if len(hit) else hit.astype(np.int32)
        listed = lambda found: pa.array([sorted({x for k in found.get(d, ()) for x in names[k]}) for d in range(len(first))], pa.list_(pa.string()))
        cols = [*(b.column(c).flatten() for c in ("doc_ids", "k1", "k2", "n_words")), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(inside)), listed(exact), listed(loose)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "_k1", "_k2", "n_words", "hits", "items", "near_items"])

    def run(rows):
        for b in rows:
            for i in range(b.num_rows):
                yield one(b.slice(i, 1))

    return index.mapInArrow(run, f"doc_id {kind}, _k1 string, _k2 bigint, n_words bigint, hits array<int>, items array<string>, near_items array<string>")


def _pieces(items: DataFrame, n: int, most: int) -> DataFrame:
    """Items ``(item, t)`` as pieces of at most ``most`` words (and n - 1 more), which have the same windows."""

    def run(rows):
        for b in rows:
            out = []
            for item, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(t)
                out += [(item, b" ".join(w[i : i + most + n - 1])) for i in range(0, max(1, len(w) - n + 1), most)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.binary())], ["item", "t"])

    return items.mapInArrow(run, "item string, t binary")


def match(docs: DataFrame, benchmark: DataFrame, n: int = 10, near: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = 150_000) -> DataFrame:
    """Matches of every document row against the whole test set, in blocks of at most about ``block_words`` words.

    The index is built once. With one block (the usual case) it is searched once; more blocks are merged by row.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), as_bytes(item_text_col).alias("t"))
    pieces = stage(_pieces(items, n, max(1, block_words // 8)), "test-set")
    total = pieces.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_blocks = 1 + total // (4 * block_words)
    index = stage(build_index(docs, id_col, text_col), "postings")
    parts = []
    for k in range(n_blocks):
        mine = pieces if n_blocks == 1 else pieces.filter(F.pmod(F.xxhash64("t", "item"), F.lit(n_blocks)) == k)
        test = TestSet([(r[0], bytes(r[1])) for r in mine.collect()], n)  # bounded by block_words
        parts.append(search(index, test, n, near))
    if n_blocks == 1:
        return parts[0]
    # Equal rows (same id and text) have equal matches; their number is restored after the blocks are merged.
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    merged = both.groupBy("_k1", "_k2").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), (F.count(F.lit(1)) / n_blocks).cast("int").alias("_n"),
        *[F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in ("hits", "items", "near_items")],
    )
    return merged.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_i", "_n")


def report(matches: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items)``."""
    return matches.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that have an exact occurrence of a test window; all columns are kept."""
    hit = match(docs, benchmark, n, 0, id_col, text_col).filter(F.size("hits") > 0).select("_k1", "_k2").distinct()
    keyed = docs.select(whole_row(docs), *row_key(id_col, text_col))
    return keyed.join(hit, ["_k1", "_k2"], "left_anti").select("_row.*")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return report(match(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


ORACLE_OP2 = r"""
WITH up AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all(translate(text, a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents, up),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, up),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dg AS (SELECT rid, p, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns WHERE len(w) >= n)),
h AS (SELECT rid, p, dg.n, item FROM dg JOIN iw USING (n, g)),
hits AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM h) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid),
dw AS (SELECT rid, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d), tc AS (SELECT t, count(*) AS c FROM dw GROUP BY t),
wt AS (SELECT DISTINCT g, unnest(string_split(g, ' ')) AS t FROM iw), wc AS (SELECT g, t, c FROM wt LEFT JOIN tc USING (t)),
ra AS (SELECT g, first(t ORDER BY c, encode(t)) AS t, count(*) AS m FROM wc GROUP BY g HAVING count(c) = count(*)),
ca AS (SELECT ra.g, ra.m, dw.rid, dw.p FROM ra JOIN dw ON ra.t = dw.t),
ne AS (SELECT ca.g, ca.rid, ca.p FROM ca JOIN wt ON ca.g = wt.g JOIN dw ON dw.rid = ca.rid AND dw.t = wt.t AND abs(dw.p - ca.p) <= 20 GROUP BY ca.g, ca.rid, ca.p, ca.m HAVING count(DISTINCT wt.t) = ca.m),
ni AS (SELECT rid, count(DISTINCT item) AS n_near FROM ne JOIN iw USING (g) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN hits USING (rid) LEFT JOIN its USING (rid) LEFT JOIN ni USING (rid)
"""

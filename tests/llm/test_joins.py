"""Operators 11 to 13 against brute force: MinHash join, Merkle manifest, cross-tokenizer alignment."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from eocube.llm import alignment, golay_dedup, merkle, minhash_join
from eocube.session import stage

from .test_operators import DOCS, corpus

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- 11 -------------------------------------------------------------------------------------------------------------


def set_of(text, size):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else [])


def linked(rows, size):
    """(set size, smallest reachable id) by row place, over all pairs."""
    sets = [set_of(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return Counter((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


def edited(rnd, words, k, vocabulary):
    words = list(words)
    for _ in range(k):
        words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
    return " ".join(words)


def families(seed=5):
    """A text with edited copies of several strengths, a template family without links, a chain, and odd texts."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    base = [rnd.choice(vocabulary) for _ in range(200)]
    frame = base[:100]
    texts = [" ".join(base)] + [edited(rnd, base, rnd.randrange(18), vocabulary) for _ in range(60)] + [" ".join(frame + [rnd.choice(vocabulary) for _ in range(45)]) for _ in range(40)]
    at = [rnd.choice(vocabulary) for _ in range(200)]
    for _ in range(25):
        at = edited(rnd, at, 8, vocabulary).split()
        texts.append(" ".join(at))
    return texts + ["", None, " \n", "one", "ONE", "one two", "One  two", "one two three", "a b", "\x1c b"]


@pytest.mark.parametrize("size", [2, 5])
def test_minhash_join(spark, size):
    rows = list(enumerate(families())) + [(3, "one"), (None, "one two"), (None, "null id")]
    got = minhash_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=size).collect()
    want = linked(rows, size)
    assert Counter(tuple(r) for r in got) == want
    assert 1 < max(Counter(k[2] for k in want.elements()).values())


def test_minhash_join_in_small_cells(spark, monkeypatch):
    """Large buckets in many cells give the same classes; equal hot keys by either way as well."""
    monkeypatch.setattr(minhash_join, "CELL_ROWS", 7)
    rows = list(enumerate(families(7)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in minhash_join.near_duplicates(frame).collect()) == linked(rows, 2)
    monkeypatch.setattr(minhash_join, "_frequent", lambda nodes, n: minhash_join._keys(nodes).groupBy("key").count().filter("count > 9").select("key"))
    assert Counter(tuple(r) for r in minhash_join.near_duplicates(frame).collect()) == linked(rows, 2)


def test_signatures_follow_jaccard_and_share_keys():
    rnd = np.random.default_rng(1)
    near = total = 0
    for _ in range(60):
        both = rnd.integers(0, 1 << 64, 800, np.uint64)
        a, b = (np.unique(np.concatenate([both, rnd.integers(0, 1 << 64, 100, np.uint64)])) for _ in range(2))  # Jaccard 0.8
        s = np.frombuffer(minhash_join.signature(a) + minhash_join.signature(b), np.uint8).reshape(2, -1)
        near += int((s[0] != s[1]).sum())
        total += s.shape[1]
        ka, kb = minhash_join.chunk_keys(s)
        assert set(ka.tolist()) & set(kb.tolist())
    assert abs(near / total - 0.2) < 0.03
    # Under the threshold there is always a common key.
    s = rnd.integers(0, 256, (300, minhash_join.SYMBOLS)).astype(np.uint8)
    other = s.copy()
    for row in other:
        at = rnd.choice(minhash_join.SYMBOLS, 2 * minhash_join.CHUNKS - 1, replace=False)
        row[at] ^= rnd.integers(1, 256, len(at)).astype(np.uint8)
    assert all(set(x) & set(y) for x, y in zip(minhash_join.chunk_keys(s).tolist(), minhash_join.chunk_keys(other).tolist()))


def test_unlinked_members_of_one_bucket_are_bounded():
    """20,000 sets that share half of their shingles: cells see no near pair and hold a bounded number of rows."""
    rnd = np.random.default_rng(2)
    shared = rnd.integers(0, 1 << 64, 60, np.uint64)
    n = 2 * minhash_join.CELL_ROWS
    sig = np.stack([np.frombuffer(minhash_join.signature(np.concatenate([shared, rnd.integers(0, 1 << 64, 60, np.uint64)])), np.uint8) for _ in range(n)])
    fp = np.arange(n)
    u, v = minhash_join.cell_links(fp, fp, np.full(n, 120), sig, Fraction("0.8"), None)
    assert len(u) < 0.2 * n and (u == v).all()


def test_confirmation_is_exact():
    a = np.arange(1, 11, dtype=np.uint64)
    assert minhash_join.similar(a, np.arange(1, 9, dtype=np.uint64), Fraction("0.8")) and not minhash_join.similar(a, np.arange(1, 8, dtype=np.uint64), Fraction("0.8"))


def test_keep_one_by_similarity(spark):
    rows = list(enumerate(families(9)))
    kept = sorted(r.doc_id for r in golay_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), size=5, similarity=0.8).collect())
    want = {}
    for d, n, least, _ in linked(rows, 5).elements():
        want.setdefault(least if n else "empty", d)
        want[least if n else "empty"] = min(want[least if n else "empty"], d)
    assert kept == sorted(want.values())


def test_keep_one_links_by_simhash(spark, monkeypatch):
    """The stage is that of SimHash and Golay keys: copies at up to 3 bits go without any MinHash candidate."""
    rnd = np.random.default_rng(3)
    words = [f"w{k}" for k in range(5000)]
    base = [rnd.choice(words, 900).tolist() for _ in range(12)]
    rows = [(k, " ".join(b)) for k, b in enumerate(base)] + [(100 + k, " ".join([*b[:450], "other", *b[451:]])) for k, b in enumerate(base)]
    near = {k for k, b in rows[12:] if bin(golay_dedup.fingerprint(b.encode(), 5) ^ golay_dedup.fingerprint(rows[k - 100][1].encode(), 5)).count("1") <= 3}
    assert len(near) > 8
    none = spark.createDataFrame([], "u bigint, v bigint"), spark.createDataFrame([], "key bigint, fp bigint")
    monkeypatch.setattr(minhash_join, "candidates", lambda nodes: none)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in golay_dedup.keep_one(docs, size=5, similarity=0.8).collect()}
    assert kept == {k for k, _ in rows} - near
    # Near fingerprints alone don't do: links are confirmed on full sets.
    assert {r.doc_id for r in golay_dedup.keep_one(docs, size=5, similarity=0.999).collect()} == {k for k, _ in rows}


# --- 12 -------------------------------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lower(t):
    return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def leaf_of(row, text):
    return sha(part(row[0]), part(row[1]), part(row[2]), part(row[3]), part(text))


def climb(nodes, i):
    """Root of a list of nodes and the siblings of one, level by level."""
    sides = []
    while len(nodes) > 1:
        runs = [nodes[k : k + 16] for k in range(0, len(nodes), 16)]
        run = runs[i // 16]
        sides.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        nodes, i = [sha(*r) for r in runs], i // 16
    return nodes[0], sides


def manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    leaves = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[4]))) for g in order}
    subroots = [climb([leaf_of(r, r[4]) for r in leaves[g]], 0)[0] for g in order]
    out = []
    for s, g in enumerate(order):
        nodes = [leaf_of(r, r[4]) for r in leaves[g]]
        root, top = climb(subroots, s)
        for i, r in enumerate(leaves[g]):
            sides = climb(nodes, i)[1] + top
            folded = leaf_of(r, lower(r[4])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else nodes[i]
            for a, b in sides:
                folded = sha(a, folded, b)
            out.append((r[0], nodes[i], subroots[s], root, sha(*[a + b for a, b in sides]), folded, folded == root))
    return Counter(out)


def merkle_rows(n, groups, seed=0):
    rnd = random.Random(seed)
    pool = [None, "", *[f"s{i}é" for i in range(groups)]]
    rows = [(i, "hot" if rnd.random() < 0.4 else rnd.choice(pool), rnd.choice(["en", None]), rnd.choice([None, i % 7]), rnd.choice(["Text ÄB %d" % i, "plain text", "LOUD", "", None])) for i in range(n)]
    return rows + [rows[0], rows[0], (None, "hot", None, None, None), (None, None, "en", 1, "x")]


MERKLE = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize(("n", "groups", "depth"), [(400, 3, 1), (400, 40, 1), (700, 2, 3), (1, 1, 3)])
def test_merkle_manifest(spark, tmp_path, monkeypatch, n, groups, depth):
    """One level a block makes several rounds for documents and for sources."""
    monkeypatch.setattr(merkle, "DEPTH", depth)
    rows = merkle_rows(n, groups) if n > 1 else [(7, "s", None, 3, "One")]
    spark.createDataFrame(rows, MERKLE).withColumn("node", F.lit(1)).withColumn("g", F.lit("clash")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in merkle.op12_merkle_manifest(spark, str(tmp_path)).collect())
    assert got == manifest(rows)
    assert n == 1 or 0 < sum(k for r, k in got.items() if not r[-1]) < sum(got.values())


def test_merkle_of_nothing(spark, tmp_path):
    spark.createDataFrame([], MERKLE).write.parquet(f"{tmp_path}/documents.parquet")
    assert merkle.op12_merkle_manifest(spark, str(tmp_path)).collect() == []


def test_numbers_by_ranges(spark):
    """A hot group over many ranges is numbered without gaps."""
    rows = [("hot" if i % 3 else f"g{i % 5}", i * 7 % 1000, str(i % 4)) for i in range(1000)]
    got = merkle.numbered(stage(spark.createDataFrame(rows, "g string, item long, node string"), "t")).collect()
    for g in {r[0] for r in rows}:
        own = sorted((r.r, r.item) for r in got if r.g == g)
        assert [k for k, _ in own] == list(range(len(own))) and [i for _, i in own] == sorted(i for h, i, _ in rows if h == g)
        assert {r.n for r in got if r.g == g} == {len(own)}


# --- 13 -------------------------------------------------------------------------------------------------------------

ODD = ["a", " a", "  a  b", "a  ", "\n", "a \n b", "foo.\nBar  baz\n\n x", "▁x y", "x ▁", "naïve café 日本語 text", "<0x41> <s> </s> <|endoftext|> x", "\x00 a\x00b", "a b 　c", "é ﬁ", "🙂🙂 ok 🙂", "don't it' s 'll we'll"]
ODD += ["x" * 300, "é" * 200 + " " + "  " * 40 + "z", "\t\tfoo\tbar ", "1234 567,89 %$#", "a\x1c b", "a \x85 b", "foo\r\nbar", "same same same", "same same same", "  a  "]


def aligned(texts):
    """Rows by the two libraries on whole texts, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(x): x for x in shown} | {chr(0x100 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    pieces, counts, docs = {i: p for p, i in a.get_vocab().items()}, Counter(), []
    for t in texts:
        want = (" " + (t or "")).encode()
        ia, ib = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        sa = [bytes(letters[c] for c in pieces[i]) for i in ia]
        sb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not t or b"".join(sa) != want or b"".join(sb) != want:
            docs.append(None)
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in (sa, sb)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = ";".join("|".join(",".join(str(i) for i, e in zip(ids, es) if low < e <= high) for ids, es in ((ia, ends[0]), (ib, ends[1]))) for low, high in zip([0, *cuts], cuts))
        links = [(x, y) for x, e, s in zip(ia, ends[0], sa) for y, f, u in zip(ib, ends[1], sb) if e - len(s) < f and f - len(u) < e]
        counts.update(links)
        docs.append((len(ia), len(ib), len(cuts), links, hashlib.sha256(groups.encode()).hexdigest()))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (*d[:3], len(d[3]), sum(counts[p] == best[p[1]] for p in d[3]), sum(counts[p] for p in d[3]), d[4]) for d in docs]


@pytest.mark.parametrize(("links", "docs", "ways"), [(2_000_000, 4096, 64), (700, 9, 2)])
def test_cross_tokenizer(spark, monkeypatch, links, docs, ways):
    """One run, or many short ones in several groups."""
    monkeypatch.setattr(alignment, "RUN_LINKS", links)
    monkeypatch.setattr(alignment, "RUN_DOCS", docs)
    monkeypatch.setattr(alignment, "WAYS", ways)
    texts = ["", None, *ODD, *[r[1] for r in corpus(40)]]
    frame = spark.createDataFrame([(i, t, "run", 1) for i, t in enumerate(texts)], "doc_id long, text string, run string, place int").repartition(3)
    got = sorted(tuple(r) for r in alignment.align(frame, A, B).collect())
    want = [(i, *w) for i, w in enumerate(aligned(texts))]
    assert got == want
    assert sum(w[1] == 0 for w in want) > 2


def test_cross_tokenizer_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none, A, B).collect() == []
    rows = spark.createDataFrame([(None, "one two"), (None, "one two"), (1, None), (1, "")], "doc_id long, text string")
    got = Counter(tuple(r) for r in alignment.align(rows, A, B).collect())
    want = aligned(["one two", "one two"])[0]
    assert got == Counter({(None, *want): 2, (1, 0, 0, 0, 0, 0, 0, ""): 2})


def test_runs_go_round():
    rnd = np.random.default_rng(3)
    pairs = [rnd.integers(0, 1 << 20, rnd.integers(0, 50)).astype("<u4").tobytes() for _ in range(300)]
    want = Counter((p, i) for i, x in enumerate(pairs) for p in np.frombuffer(x, "<u4").tolist())
    got = Counter()
    for radix, n, blob in alignment.sorted_run(pairs):
        pair, docs, links, place, k = alignment.read_run(blob)
        assert ((pair >> 16) % alignment.RADIX == radix).all() and n == docs.sum() == len(place) and (np.diff(pair.astype(np.int64)) > 0).all()
        each = np.repeat(pair, docs)
        assert links.tolist() == [int(k[each == p].sum()) for p in pair]
        got.update({(int(p), int(i)): int(c) for p, i, c in zip(each, place, k)})
    assert got == want


def test_empty_tables_with_clashing_names(spark):
    frame = spark.createDataFrame([], DOCS)
    assert minhash_join.near_duplicates(frame).count() == alignment.align(frame, A, B).count() == 0

"""The quality classifier from texts to scores against a plain version: counts in Python, dense algebra, max-min isotonic fit."""

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from eocube.llm import quality_classifier as qc
from eocube.llm.common import read

SF = "/root/testdata/sf0.001"


def statistics(text):
    b = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", b)
    if not words:
        return [0.0] * 23
    of = Counter(b)
    share = lambda chars: math.sqrt(sum(of[c] for c in chars) / len(b))
    classes = [range(65, 91), range(97, 123), range(48, 58), range(128, 256), b"#*$%&<>@\\^_~=+", b"|", b"!", b".,;:?", b"\"'()[]{}", b" \t", b"\n\r"]
    n, times = len(words), Counter(words)
    lines = [x for x in b.split(b"\n") if x.strip()]
    return [
        math.log(1 + len(b)), *map(share, classes), math.log(1 + n), math.log(sum(map(len, words)) / n), len(times) / n, max(times.values()) / n,
        sum(x == y for x, y in zip(words, words[1:])) / (n - 1) if n > 1 else 0.0, sum(len(w) > 25 for w in words) / n, math.log(1 + len(lines)), math.log(n / len(lines)),
        1 - len(set(lines)) / len(lines), sum(w[-1:] in [bytes([c]) for c in b"#*$%&!|"] for w in words) / n, sum(w.isupper() and len(w) > 1 for w in words) / n,
    ]


def scores(docs, labels):
    """Score by document: every step over all rows at once."""
    part = {d: zlib.crc32(str(d).encode()) % 5 for d in docs}
    stats = {d: np.array(statistics(t)) for d, t in docs.items()}
    train = [(stats[d], y) for d, y in labels if d in docs and part[d] in (1, 2, 3)]
    x, y = np.array([s for s, _ in train]), np.array([v for _, v in train], float)
    mean, std = x.mean(axis=0), x.std(axis=0)
    rng = np.random.default_rng(7)
    w, phase = rng.normal(size=(23, 256)) / 5.0, rng.uniform(0, 2 * np.pi, 256)

    def lifted(s):
        z = np.clip((np.atleast_2d(s) - mean) / np.where(std > 1e-9, std, 1.0), -6, 6)
        return np.hstack([math.sqrt(2 / 256) * np.cos(z @ w + phase), np.ones((len(z), 1))])

    z = lifted(x)
    penalty = np.diag([1e-3 * len(y) / 256 + 1e-9] * 256 + [1e-9])
    weights = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    place = lambda raw: int(np.clip((raw + 0.5) / 2 * 4096, 0, 4095))
    held = Counter(), Counter()
    for d, v in labels:
        if d in docs and part[d] == 4:
            k = place(float(lifted(stats[d])[0] @ weights))
            held[0][k] += v
            held[1][k] += 1
    bins = sorted(held[1])
    mean_of = lambda i, j: sum(held[0][b] for b in bins[i : j + 1]) / sum(held[1][b] for b in bins[i : j + 1])
    level = [max(min(mean_of(a, e) for e in range(i, len(bins))) for a in range(i + 1)) for i in range(len(bins))]
    knots = [(-0.5 - 1e-6, 0.0)]
    for v in sorted(set(level)):
        own = [b for b, u in zip(bins, level) if u == v]
        knots.append((((own[0] + own[-1]) / 2 + 0.5) / 4096 * 2 - 0.5, v))
    knots.append((1.5 + 1e-6, 1.0))
    raw = {d: float(lifted(s)[0] @ weights) for d, s in stats.items()}
    return {d: float(np.interp(r, *zip(*knots))) for d, r in raw.items()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_scores_by_hand(spark):
    docs = {r.doc_id: r.text for r in read(spark, SF, "documents").select("doc_id", "text").collect()}
    labels = [(r.doc_id, r.quality) for r in read(spark, SF, "labels").collect() if r.quality is not None]
    want = scores(docs, labels)
    got = qc.op8_quality_classifier(spark, SF).collect()
    assert len(got) == len(want) == len(docs)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-6), r.doc_id
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3)
    assert 0 < sum(r.predicted for r in got) < len(got)


@pytest.mark.parametrize("text", ["", None, " \n", "one", "A B!! cc\n\ncc cc", "é" * 40 + " |x|\r\nx", "SHOUT shout# " * 30, "a\x1cb \x85"])
def test_statistics_by_hand(text):
    assert np.allclose(qc.describe(None if text is None else text.encode()), statistics(text))

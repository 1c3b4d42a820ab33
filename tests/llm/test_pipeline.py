"""The pipeline, stage by stage, against brute-force versions on the smallest tables."""

import os
import re

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from eocube.llm import byte_bpe, pii
from eocube.llm.common import read

from .test_operators import brute_hits

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage as Python rows, stored and read again in between."""
    docs, out = read(spark, SF, "documents"), {}
    for name, f in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp(name)}/out"
        f(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = docs.columns, docs.collect(), after.columns, after.collect()
        docs = after
    return out


def test_columns_stay(stages):
    for name, (before, _, after, _) in list(stages.items())[:-1]:
        assert before == after, name


def test_quality_stage(spark, stages):
    from eocube.llm import quality_classifier

    _, before, _, after = stages["quality_classifier"]
    good = {r["doc_id"] for r in quality_classifier.op8_quality_classifier(spark, SF).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} & good
    labels = {r["doc_id"]: r["quality"] for r in read(spark, SF, "labels").collect()}
    lost = [d for d, q in labels.items() if q == 1 and d not in good]
    assert len(lost) <= 0.1 * sum(labels.values())


def test_dedup_stage(stages):
    """One document of each class stays, classes by all pairs of five-word shingle sets with a Jaccard of 0.8 or more."""
    _, before, _, after = stages["simhash_dedup"]
    sets = {}
    for r in before:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    root = {d: d for d in ids}
    linked = [(a, b) for a in ids for b in ids if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    assert sorted(r["doc_id"] for r in after) == sorted(set(root.values()))


def test_decontamination_stage(spark, stages):
    _, before, _, after = stages["decontamination"]
    items = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()]
    windows = {w[i : i + 10] for _, t in items for w in [tuple(re.findall(r"[0-9a-z\x80-￿]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))] for i in range(max(1, len(w) - 9))}
    assert all(len(w) == 10 for w in windows)

    def hit(t):
        v = tuple(re.findall(r"[0-9a-z\x80-￿]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
        return any(v[i : i + 10] in windows for i in range(len(v) - 9))

    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if not hit(r["text"]))
    assert brute_hits(before[0]["text"], items)[1] == 0 or before[0]["doc_id"] not in {r["doc_id"] for r in after}


def test_pii_stage(stages):
    _, before, _, after = stages["pii"]
    found = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]*\w|\+\d \(\d{3}\) \d{3}-\d{4}|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.]\d)|(?<!\w)[0-9a-f]{40}(?!\w)|(?<=password=)\w+")
    new = {r["doc_id"]: r for r in after}
    assert set(new) == {r["doc_id"] for r in before}
    for r in before:
        n = new[r["doc_id"]]
        assert n["n_chars"] == len(n["text"])
        if not re.search("[0-9@]", r["text"]):
            assert n["text"] == r["text"]
        for m in set(found.findall(r["text"])):
            assert m not in n["text"], m
        assert len(n["text"].split("\n")) == len(r["text"].split("\n"))
    assert pii.PATTERN


def test_bpe_stage(spark, stages):
    import tiktoken

    _, before, _, after = stages["byte_bpe"]
    ref = tiktoken.Encoding("ref", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in after}
    assert got == {r["doc_id"]: ref.encode_ordinary(r["text"]) for r in before}
    whole = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in whole} == {d: len(x) for d, x in got.items()}

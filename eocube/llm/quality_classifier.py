"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

Statistics of the whole text (shares of byte classes, word and line shapes, repetition) are standardised and mapped by
random Fourier features, cos(Wz + b), which approximate a Gaussian kernel. Each task adds up its share of the normal
equations; the sums are of fixed size (features x features), whatever the number of labelled rows. Ridge scores of the
calibration rows are counted by bins of fixed number, and pooling adjacent violators over the bins gives the monotone
map to probabilities (interpolated between pools, so that the order of scores is kept).

Rows are dealt by crc32 of the doc_id as text (null: empty text) mod 5: 0 held out, 1 to 3 for the fit, 4 for calibration.

Edge cases: null and empty texts have all statistics 0 and get the score of that point; null labels are left out;
repeated labels count each; without labels of both kinds the score is 1 everywhere (nothing is rejected); statistics
that don't vary are not divided; every input row gives a row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import as_bytes, batches, read

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "wide": range(128, 256),
    "symbol": b"#*$%&<>@\\^_~=+", "bar": b"|", "bang": b"!", "stop": b".,;:?", "quote": b"\"'()[]{}", "blank": b" \t", "line": b"\n\r",
}
_MASK = np.array([[b in set(c) for b in range(256)] for c in _CLASSES.values()], float)
NAMES = ["chars", *_CLASSES, "words", "word_length", "distinct", "top", "same_next", "long_words", "lines", "line_words", "dup_lines", "marked_words", "shouted_words"]
FEATURES = 256
LENGTH = 5.0  # of the kernel, in standard deviations
RIDGE = 1e-3
BINS = 4096
FAN_IN = 1024  # sums that are added up in one group


def describe(text: bytes | None) -> np.ndarray:
    """The statistics of one text."""
    out = np.zeros(len(NAMES))
    words = text.split() if text else []
    if not words:
        return out
    n, k = len(text), len(words)
    shares = _MASK @ np.bincount(np.frombuffer(text, np.uint8), minlength=256) / n
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, k)
    times = np.bincount(ids)
    kinds = list(number)
    length = np.fromiter(map(len, kinds), np.int64, len(kinds))
    marked = np.fromiter((w[-1] in b"#*$%&!|" for w in kinds), bool, len(kinds))
    shouted = np.fromiter((w.isupper() and len(w) > 1 for w in kinds), bool, len(kinds))
    lines = [x for x in text.split(b"\n") if x.strip()]
    out[:] = [
        np.log1p(n), *np.sqrt(shares), np.log1p(k), np.log((length * times).sum() / k), len(kinds) / k, times.max() / k, (ids[1:] == ids[:-1]).mean() if k > 1 else 0.0,
        (times * (length > 25)).sum() / k, np.log1p(len(lines)), np.log(k / len(lines)), 1 - len(set(lines)) / len(lines), (times * marked).sum() / k, (times * shouted).sum() / k,
    ]
    return out


def describe_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``(doc_id, stats array<double>)``, a row for each input row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(rows):
        for b in batches(rows):
            got = np.array([describe(t) for t in b.column(1).to_pylist()])
            offsets = np.arange(len(got) + 1, dtype=np.int32) * len(NAMES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(got.reshape(-1)))], ["doc_id", "stats"])

    return docs.select(F.col(id_col), as_bytes(text_col)).mapInArrow(run, f"doc_id {kind}, stats array<double>")


def fold(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


class Model:
    """A fitted model; small (features x statistics) and of fixed size."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(size=(len(mean), FEATURES)) / LENGTH
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.knots = np.array([0.0, 1.0]), np.array([1.0, 1.0])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.std, -6, 6)
        return np.concatenate([np.cos(z @ self.w + self.b) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), *self.knots)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(NAMES)) if len(column) else np.empty((0, len(NAMES)))


def _normal_equations(rows: DataFrame, model: Model) -> np.ndarray:
    """[Z'Z | Z'y] summed over all rows: each task sends its own sum once, by matrix row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def part(it):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for b in it:
            z = shared.value.features(_matrix(b.column(0)))
            y = b.column(1).to_numpy().astype(float)
            total += z.T @ np.concatenate([z, y[:, None]], axis=1)
        if total[-1, -2]:  # the number of rows
            g = pa.array(np.full(FEATURES + 1, TaskContext.get().partitionId() // FAN_IN), pa.int32())
            yield pa.RecordBatch.from_arrays([g, pa.array(range(FEATURES + 1), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["g", "i", "sum"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(FEATURES + 2)
        for x in t.column("sum"):
            total += np.frombuffer(x.as_buffer())
        return pa.table({"g": pa.array([t.column("g")[0].as_py() // FAN_IN], pa.int32()), "i": t.column("i").slice(0, 1), "sum": pa.array([total.tobytes()], pa.binary())})

    kind = "g int, i int, sum binary"
    sums = rows.select("stats", "y").mapInArrow(part, kind)
    for _ in range(2):  # FAN_IN squared tasks
        sums = sums.groupBy("g", "i").applyInArrow(add, kind)
    out = np.zeros((FEATURES + 1, FEATURES + 2))
    for r in sums.collect():  # FEATURES + 1 rows
        out[r["i"]] += np.frombuffer(bytes(r["sum"]))
    return out


def pool(good: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pooling adjacent violators: the non-decreasing fit of good/n with weights n."""
    pools: list[list[float]] = []
    for g, m in zip(good.tolist(), n.tolist()):
        pools.append([g, m, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([k for _, _, k in pools]), np.array([g / m for g, m, _ in pools])


def fit(described: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """A model from the labelled rows that are not held out. ``described`` should be stored."""
    spark = described.sparkSession
    y = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("y"))
    known = stage(described.join(y, F.col("doc_id") == F.col("_id")).select("stats", "y", fold().alias("fold")).filter("fold <> 0"), "labelled-statistics")
    train = known.filter("fold <> 4")
    at = [F.get("stats", F.lit(i)) for i in range(len(NAMES))]
    r = train.agg(F.min("y"), F.max("y"), *[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at]).first()
    if r[0] is None or r[0] == r[1]:
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)))
    model = Model(np.array(r[2 : 2 + len(NAMES)]), np.array(r[2 + len(NAMES) :]))
    sums = _normal_equations(train, model)
    n = sums[-1, -2]
    ridge = np.eye(FEATURES + 1) * RIDGE * n / FEATURES
    ridge[-1, -1] = 0
    model.weights = np.linalg.solve(sums[:, :-1] + ridge + 1e-9 * np.eye(FEATURES + 1), sums[:, -1])
    shared = spark.sparkContext.broadcast(model)

    def binned(it):
        for b in it:
            raw = shared.value.raw(_matrix(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)), b.column(1)], ["bin", "y"])

    rows = known.filter("fold = 4").select("stats", "y").mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.sum("y"), F.count("y")).orderBy("bin").collect()  # BINS rows at most
    if not rows:
        rows = [(0, 0.0, 1), (BINS - 1, 1.0, 1)]
    bins, good, count = (np.array(x, float) for x in zip(*rows))
    size, level = pool(good, count)
    ends = np.cumsum(size) - 1
    centre = (bins[ends - size.astype(int) + 1] + bins[ends]) / 2
    # Beyond the outer pools scores go on to 0 and 1, so that their order is kept.
    model.knots = np.concatenate([[-0.5 - 1e-6], (centre + 0.5) / BINS * 2 - 0.5, [1.5 + 1e-6]]), np.concatenate([[0.0], level, [1.0]])
    return model


def score(described: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``."""
    shared = described.sparkSession.sparkContext.broadcast(model)
    kind = described.schema["doc_id"].dataType.simpleString()

    def run(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(_matrix(b.column(1))))], ["doc_id", "score"])

    out = described.select("doc_id", "stats").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    described = stage(describe_documents(docs, id_col, text_col), "statistics")
    return score(described, fit(described, labels, id_col), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, most_labels: int = 50_000) -> DataFrame:
    """``docs`` without the rows that score under the threshold; rows are scored where they stand, without a join.

    The model is fitted on at most about ``most_labels`` labelled rows (by a hash of their ids), so that only these are
    described beforehand, and found by sending their ids to all tasks.
    """
    ids = labels.select(F.col(id_col).alias("_label"))
    total = ids.count()
    if total > most_labels:
        ids = ids.filter(F.pmod(F.xxhash64("_label"), F.lit(1_000_000)) < 1_000_000 * most_labels // total)
    labelled = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(ids.distinct()), F.col("doc_id") == F.col("_label"), "left_semi")
    described = stage(describe_documents(labelled), "statistics")
    shared = docs.sparkSession.sparkContext.broadcast(fit(described, labels, id_col))
    at = docs.columns.index(text_col)

    def run(it):
        for b in batches(it, text=at):
            stats = np.array([describe(t.encode() if isinstance(t, str) else t) for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(shared.value.score(stats) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))

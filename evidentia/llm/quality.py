"""Quality classifier: a factorisation machine over hashed words and structure.

A text becomes a sparse vector of hashed words (damped counts, unit length) and
one-hot bins of structure and size statistics. The model adds a weight for each
feature and an interaction for each pair of features, of rank ``RANK``. The
pair sum is taken in linear time: half of the square of the sum less the sum of
the squares, for each factor.

Learning sees a bounded sample of labelled rows and runs on the driver;
scoring sees whole texts and runs on the executors with the model, whose size
is fixed, as a broadcast.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from evidentia.scratch import written

from .common import documents, texts_of, utf8

WORDS, RANK = 1 << 15, 8
BINS = 12
#: Statistics of :func:`structure`, each cut into ``BINS`` bins.
STATISTICS = 16
FEATURES = WORDS + STATISTICS * BINS
#: Rows of label that learning reads at most, one an id, and features of all of them together: 12 bytes each on the driver.
MOST_ROWS, MOST_FEATURES = 6000, 8_000_000
HELD_OUT = 5
THRESHOLD = 0.3
CACHE = 200_000
SENTENCE = re.compile(rb"[.!?]+")

_CLASSES = np.zeros((256, 8), np.float64)
for _c in range(256):
    _ch = chr(_c)
    _CLASSES[_c] = [
        65 <= _c <= 90, 97 <= _c <= 122, 48 <= _c <= 57, _ch in " \t\r\n", _c == 10,
        _ch in ".,;:'\"()-", _ch in "!?", _c < 128 and not _ch.isalnum() and _ch not in " \t\r\n.,;:'\"()-!?",
    ]


class _Words(dict):
    """Word -> hashed feature, kept for the most recent words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = at = zlib.crc32(word) % WORDS
        return at


_words = _Words()


def structure(data: bytes, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Structure and size statistics of a text, each scaled to 0..1."""
    n, size = len(ids), len(data)
    if not n:
        return np.zeros(STATISTICS)
    upper, lower, digits, space, lines, points, marks, signs = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASSES
    rows = data.split(b"\n")
    sentences = len(SENTENCE.findall(data)) + 1
    p = counts / n
    return np.array([
        min(1, np.log1p(n) / 12), min(1, np.log1p(size) / 16), min(1, (size - space) / n / 20),
        upper / (upper + lower + 1), digits / size, space / size, min(1, 20 * lines / n), min(1, points / n),
        min(1, marks / n), min(1, signs / n), len(counts) / n, counts.max() / n,
        (ids[1:] == ids[:-1]).sum() / n, 1 - len(set(rows)) / len(rows), min(1, n / sentences / 60),
        min(1, -(p * np.log(p)).sum() / (np.log(n) + 1e-9)) if n > 1 else 0,
    ])


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, values) of a text; null is an empty text."""
    data = utf8(text)
    words = data.split()
    ids = np.fromiter(map(_words.__getitem__, words), np.int32, len(words))
    known, counts = np.unique(ids, return_counts=True)
    bins = np.minimum((structure(data, ids, counts) * BINS).astype(np.int32), BINS - 1)
    told = WORDS + np.arange(STATISTICS, dtype=np.int32) * BINS + bins
    damped = np.sqrt(counts)
    damped /= np.sqrt((damped * damped).sum()) or 1
    return np.concatenate([known, told]).astype(np.int32), np.concatenate([damped, np.full(STATISTICS, 0.5)])


class Machine:
    """The factorisation machine: bias, weights and factors."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray) -> None:
        self.bias, self.weights, self.factors = bias, weights, factors

    def logit(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at] * x[:, None]
        total = v.sum(axis=0)
        return float(self.bias + self.weights[at] @ x + 0.5 * (total @ total - (v * v).sum()))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(*features(text)), -30, 30))))


def learn(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.1,
          decay: float = 1e-4, seed: int = 7) -> Machine:
    """Fit by AdaGrad on the logistic loss; without rows of both labels the score is their share."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    r = np.random.default_rng(seed)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(FEATURES), r.normal(0, 0.05, (FEATURES, RANK)))
    if len(set(labels.tolist())) < 2:
        m.factors[:] = 0
        return m
    g_b, g_w, g_v = 1e-6, np.full(FEATURES, 1e-6), np.full((FEATURES, RANK), 1e-6)
    for _ in range(epochs):
        order = r.permutation(len(rows))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            at = np.concatenate([rows[k][0] for k in some])
            x = np.concatenate([rows[k][1] for k in some])[:, None]
            begins = np.cumsum([0, *(len(rows[k][0]) for k in some)])
            v = m.factors[at] * x
            total = np.add.reduceat(v, begins[:-1])
            z = m.bias + np.add.reduceat(m.weights[at] * x[:, 0], begins[:-1])
            z += 0.5 * ((total**2).sum(1) - np.add.reduceat((v * v).sum(1), begins[:-1]))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) / len(some)
            e = np.repeat(err, np.diff(begins))[:, None]
            d_v = e * x * (np.repeat(total, np.diff(begins), axis=0) - v)
            used, where = np.unique(at, return_inverse=True)
            s_w = np.bincount(where, (e * x)[:, 0]) + decay * m.weights[used]
            s_v = np.stack([np.bincount(where, d_v[:, f]) for f in range(RANK)], 1) + decay * m.factors[used]
            g_w[used] += s_w**2
            g_v[used] += s_v**2
            g_b += err.sum() ** 2
            m.weights[used] -= rate * s_w / np.sqrt(g_w[used])
            m.factors[used] -= rate / 2 * s_v / np.sqrt(g_v[used])
            m.bias -= rate * err.sum() / np.sqrt(g_b)
    return m


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_features: int = MOST_FEATURES) -> Machine:
    """Learn from labelled rows that are not held out.

    At most ``most_rows`` labelled ids, those of the smallest hash, are read, a row
    each: of rows that repeat an id the one whose text has the smallest hash, a
    null text after all others. Of these as many count, in the same order, as
    have ``most_features`` features together. Labels of null or of a null id are left
    out, and of labels that contradict each other the larger one counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)

    @arrow_udf("struct<at:array<int>,x:array<double>>")
    def vector(column: pa.Array) -> pa.Array:
        rows = [features(t) for some in texts_of(column) for t in some]
        return pa.StructArray.from_arrays(
            [pa.array([a for a, _ in rows], pa.list_(pa.int32())), pa.array([x for _, x in rows], pa.list_(pa.float64()))], names=["at", "x"]
        )

    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # most_rows ids at most
    one = F.min(F.struct(F.col("text").isNull().alias("none"), F.xxhash64("text").alias("hash"), "text")).alias("d")
    each = found.groupBy("doc_id").agg(F.first("quality").alias("quality"), one)
    made = written(each.select("doc_id", "quality", vector(F.col("d.text")).alias("v")), "vectors")
    along = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = made.select("doc_id", F.sum(F.size("v.at")).over(along).alias("n")).where(F.col("n") <= most_features)  # of most_rows rows, without vectors
    got = made.join(F.broadcast(counted), "doc_id").select("doc_id", "quality", "v").toArrow().sort_by("doc_id")
    vectors = got.column("v").combine_chunks()
    at, x = vectors.field("at"), vectors.field("x")
    ends = at.offsets.to_numpy()  # numbers stay in Arrow's buffers: no Python object for each of them
    features_, values = at.values.to_numpy(), x.values.to_numpy()
    rows = [(features_[a:b], values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
    return learn(rows, np.array(got.column("quality").to_pylist(), np.float64))


def quality(text: Column, machine: Machine) -> Column:
    """Score of whole texts, 0 to 1; null and empty texts have one, too."""
    shared = SparkSession.active().sparkContext.broadcast(machine)  # FEATURES * (RANK + 1) numbers

    @arrow_udf("double")
    def of(column: pa.Array) -> pa.Array:
        score = shared.value.score
        return pa.array([score(t) for some in texts_of(column) for t in some], pa.float64())

    return of.asNondeterministic()(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row of
    ``docs``; other columns are ignored. Equal texts have equal scores; a null
    doc_id is not held out; empty tables give no rows."""
    scored = docs.select("doc_id", quality(F.col("text"), train(docs, labels)).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted 0; columns are as they were, whatever
    their names. Null and empty texts are judged like any other, rows that
    repeat each for themselves; empty tables give no rows, and without labels
    the score is one half for all."""
    scored = docs.select(F.struct(*docs.columns).alias("doc"), quality(F.col("text"), train(docs, labels)).alias("score"))
    return scored.where(F.col("score") >= THRESHOLD).select("doc.*")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` scored by what was learnt from ``labels``: ``doc_id``,
    ``held_out``, ``score``, ``predicted``. Null and empty texts have a score;
    repeated rows stay as often as they are; an empty table gives no rows."""
    return classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))

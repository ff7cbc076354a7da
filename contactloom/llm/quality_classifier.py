"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]): the low-rank
pairwise interactions of all features in time linear in their number, by the sum-of-squares
identity.  The x are L2-normalised log counts of hashed words, standardised statistics of the whole
text's structure, and its length as metadata.  Labels are learnt in numpy on the driver from a bounded
sample of labelled rows outside fold 0; every whole text is scored by Arrow batches.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, quoted, table

BUCKETS = 1 << 14
RANK = 8
TRAIN_ROWS = 8_000
CUT = 0.3
MEMO_WORDS = 500_000

#: Byte classes: 0 other, 1 upper, 2 lower, 3 digit, 4 symbol, 5 sentence mark, 6 space, 7 line end, 8 beyond ASCII.
_CLASS = np.zeros(256, dtype=np.uint8)
for _k, _chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&|<>{}[]=+@~^\\/_", b".,;:!?'\"()-", b" \t\r\v\f", b"\n"], 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 8
STATS = 20


def structure(text: str, words: list[bytes], counts: Counter, data: bytes) -> np.ndarray:
    """Statistics of a text's structure, each of a bounded range."""
    n, size = max(1, len(words)), max(1, len(data))
    kinds = np.bincount(_CLASS[np.frombuffer(data, dtype=np.uint8)], minlength=9) if data else np.zeros(9)
    letters = max(1, kinds[1] + kinds[2] + kinds[8])
    lines = [x for x in data.split(b"\n") if x.strip()]
    triples = set(zip(words, words[1:], words[2:], strict=False))
    top = max(counts.values(), default=0)
    ends = Counter(w[-1] for w in words)
    marked = sum(c for b, c in ends.items() if _CLASS[b] == 4)
    loud = ends.get(33, 0) + ends.get(63, 0)
    out = [np.log1p(len(words)), np.log1p(len(text)), np.log1p(len(lines)), len(words) == 0]
    out += list(kinds[[0, 2, 3, 4, 5, 7, 8]] / size) + [kinds[1] / letters]
    out += [(size - kinds[6] - kinds[7]) / n / 20, len(counts) / n, top / n, len(set(lines)) / max(1, len(lines)), len(triples) / max(1, len(words) - 2)]
    out += [marked / n, loud / n, n / max(1, len(lines)) / 100]
    return np.array(out, dtype=np.float64)


class Features:
    """Sparse features of one text: hashed words, then structure statistics."""

    def __init__(self) -> None:
        self._memo: dict[bytes, int] = {}

    def _bucket(self, word: bytes) -> int:
        memo = self._memo
        b = memo.get(word)
        if b is None:
            b = zlib.crc32(word.lower()) % BUCKETS
            if len(memo) >= MEMO_WORDS:
                memo.clear()
            if len(word) <= 64:
                memo[word] = b
        return b

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buckets, values, statistics)."""
        text = text or ""
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()
        counts = Counter(words)
        where = np.fromiter(map(self._bucket, counts), dtype=np.int64, count=len(counts))
        times = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
        index, inverse = np.unique(where, return_inverse=True)
        value = np.log1p(np.bincount(inverse, weights=times, minlength=len(index)))
        return index, value / max(1e-9, np.sqrt((value * value).sum())), structure(text, words, counts, data)


@dataclass
class Machine:
    """Weights; the statistics' features follow the ``BUCKETS`` of words."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4) * 0.25

    def score(self, index: np.ndarray, value: np.ndarray, stats: np.ndarray) -> float:
        """Probability of label 1, in time linear in the number of features."""
        at = np.concatenate([index, np.arange(BUCKETS, BUCKETS + len(stats))])
        x = np.concatenate([value, self.dense(stats)])
        v = self.v[at]
        first, squares = x @ v, (x * x) @ (v * v)
        z = self.w0 + self.w[at] @ x + 0.5 * float((first * first - squares).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, steps: int = 500, rate: float = 0.02, decay: float = 2e-5, seed: int = 0) -> Machine:
    """Adam on logistic loss with weight decay, for ``epochs`` passes and ``steps`` batches at least;
    deterministic for equal input."""
    rng = np.random.default_rng(seed)
    stats = np.array([r[2] for r in rows]) if rows else np.zeros((0, STATS))
    mean = stats.mean(axis=0) if rows else np.zeros(STATS)
    scale = np.maximum(stats.std(axis=0), 1e-3) if rows else np.ones(STATS)
    size = BUCKETS + STATS
    machine = Machine(0.0, np.zeros(size), rng.normal(0, 0.05, (size, RANK)), mean, scale)
    if not rows:
        return machine
    base = np.clip(labels.mean(), 0.01, 0.99)
    machine.w0 = float(np.log(base / (1 - base)))
    m = [np.zeros(1), np.zeros(size), np.zeros((size, RANK))]
    s, step = [np.zeros_like(x) for x in m], 0
    dense = machine.dense(stats)
    for _ in range(max(epochs, -(-steps * 64 // len(rows)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            own = order[at : at + 64]
            index = np.concatenate([np.r_[rows[i][0], BUCKETS : BUCKETS + STATS] for i in own])
            x = np.concatenate([np.r_[rows[i][1], dense[i]] for i in own])
            starts = np.cumsum([0, *(len(rows[i][0]) + STATS for i in own[:-1])])
            row = np.repeat(np.arange(len(own)), np.diff([*starts, len(x)]))
            v = machine.v[index]
            xv = v * x[:, None]
            first = np.add.reduceat(xv, starts, axis=0)
            pair = 0.5 * (first**2 - np.add.reduceat(xv * xv, starts, axis=0)).sum(axis=1)
            z = machine.w0 + np.add.reduceat(machine.w[index] * x, starts) + pair
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]) / len(own)
            gx = g[row] * x
            gw = np.bincount(index, weights=gx, minlength=size) + decay * machine.w
            local = gx[:, None] * (first[row] - xv)
            gv = np.stack([np.bincount(index, weights=local[:, f], minlength=size) for f in range(RANK)], axis=1) + decay * machine.v
            step += 1
            new = []
            for k, (value, grad) in enumerate(((machine.w0, np.array([g.sum()])), (machine.w, gw), (machine.v, gv))):
                m[k] += 0.1 * (grad - m[k])
                s[k] += 0.001 * (grad * grad - s[k])
                new.append(value - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8))
            machine.w0, machine.w, machine.v = float(new[0][0]), new[1], new[2]
    return machine


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int = TRAIN_ROWS) -> pd.DataFrame:
    """Features and labels of about ``rows`` labelled documents outside fold 0 (those whose id's
    hash falls below the share wanted; of rows with equal ids one, the least text), computed on the
    executors; their ids are broadcast."""
    marked = labels.select(quoted(id_col).alias("id"), F.col("quality").alias("label")).where("label in (0, 1)")
    marked = marked.where(F.col("id").isNotNull() & (fold_of(F.col("id")) != 0)).groupBy("id").agg(F.min("label").alias("label"))
    share = rows / max(1, marked.count())
    drawn = marked.where(F.pmod(F.xxhash64("id"), F.lit(1 << 32)) / float(1 << 32) < share)
    source = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).join(F.broadcast(drawn), "id")
    source = source.groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))  # repeated ids stay within the bound

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Features()
        for batch in batches:
            made = [make(t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "i": [x[0] for x in made], "x": [x[1] for x in made], "s": [x[2] for x in made]})

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInPandas(run, f"id {kind}, label int, i array<long>, x array<double>, s array<double>").toPandas().sort_values("id", kind="stable")


def train_machine(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """A machine fitted to the labelled documents; without any it scores every text 0.5."""
    sample = training_rows(docs, labels, id_col, text_col)
    rows = [(np.asarray(i), np.asarray(x), np.asarray(s)) for i, x, s in zip(sample["i"], sample["x"], sample["s"], strict=True)]
    return fit(rows, sample["label"].to_numpy(dtype=float))


@lru_cache(maxsize=1)
def _machine_of(blob: bytes) -> Machine:
    import pickle

    return pickle.loads(blob)


def score_quality(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """One row per row of ``docs``: the id, held_out, score (0 to 1), predicted.

    Null and empty texts are scored like any other, by their statistics.  Rows with null ids (in
    fold 0, so held out) or repeated ids each get their row; extra columns are not touched.
    """
    import pickle

    blob = pickle.dumps(machine)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, make = _machine_of(blob), Features()
        for texts in batches:
            yield pd.Series([own.score(*make(t)) for t in texts], dtype="float64")

    rows = docs.select(quoted(id_col).alias("id"), score(quoted(text_col)).alias("score"))
    return rows.select(F.col("id").alias(id_col), (fold_of(F.col("id")) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the whole ``documents`` table, learnt from ``labels``."""
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_machine(docs, table(spark, sf_dir, "labels")))

"""Language identification by a byte convolutional network trained in numpy.

Bytes become classes (rare bytes share one), classes an embedding; filters of several widths slide
over a fixed-length window, each keeps its maximum, and a linear softmax layer names the language.
Training uses windows of a bounded sample of labelled rows; prediction covers every window of every
whole text, in batches, and adds up the windows' log-probabilities weighted by their letters.

A convolution over byte classes is a sum of table rows, one table for each offset of a filter.
Prediction folds neighbouring offsets into one table of class pairs, so a window costs a few
gathers instead of a matrix product over embeddings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, free_name, quoted, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
CLASSES = 96
TRAIN_ROWS = 1_500
TRAIN_WINDOWS = 4
TRAIN_TOTAL, MOST_LANGS = 60_000, 1_000
BATCH_WINDOWS = 256
UNKNOWN = "und"


@dataclass
class Model:
    """Weights of a trained network; ``langs`` in the order of its outputs."""

    langs: list[str]
    class_of: np.ndarray  # uint8[256]
    conv: dict[int, np.ndarray]  # width -> float32[width, CLASSES, FILTERS]
    bias: dict[int, np.ndarray]
    out: np.ndarray  # float32[len(widths) * FILTERS, langs]
    out_bias: np.ndarray


def byte_classes(windows: np.ndarray) -> np.ndarray:
    """Class of each byte value: the most frequent ones their own, all others the last; 0 pads."""
    counts = np.bincount(windows.ravel(), minlength=256)
    counts[0] = 0
    order = np.argsort(-counts, kind="stable")[: CLASSES - 2]
    out = np.full(256, CLASSES - 1, dtype=np.uint8)
    out[order] = np.arange(1, len(order) + 1)
    out[0] = 0
    return out


def windows_of(data: bytes, window: int = WINDOW) -> np.ndarray:
    """All fixed-length windows of a text, the last one padded with zero bytes."""
    n = max(1, -(-len(data) // window))
    return np.frombuffer(data.ljust(n * window, b"\0"), dtype=np.uint8).reshape(n, window)


def train(windows: np.ndarray, target: np.ndarray, langs: list[str], epochs: int = 6, rate: float = 0.01, seed: int = 0) -> Model:
    """Adam on softmax cross-entropy, classes weighted evenly; deterministic for equal input."""
    rng = np.random.default_rng(seed)
    class_of = byte_classes(windows)
    x_all = class_of[windows].astype(np.int64)
    weight = len(target) / (len(langs) * np.maximum(1, np.bincount(target, minlength=len(langs))))
    params = {("conv", w): rng.normal(0, 0.3, (w, CLASSES, FILTERS)) for w in WIDTHS}
    params |= {("bias", w): np.zeros(FILTERS) for w in WIDTHS}
    params |= {("out", 0): rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(langs))), ("out_bias", 0): np.zeros(len(langs))}
    first, second, step = {k: np.zeros_like(v) for k, v in params.items()}, {k: np.zeros_like(v) for k, v in params.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(target))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            x, y = x_all[rows], target[rows]
            pooled, best = [], []
            for w in WIDTHS:
                span = x.shape[1] - w + 1
                act = params["bias", w] + sum(params["conv", w][o][x[:, o : o + span]] for o in range(w))
                top = act.argmax(axis=1)
                best.append(top)
                pooled.append(np.maximum(0, np.take_along_axis(act, top[:, None], 1)[:, 0]))
            hidden = np.concatenate(pooled, axis=1)
            logits = hidden @ params["out", 0] + params["out_bias", 0]
            logits -= logits.max(axis=1, keepdims=True)
            prob = np.exp(logits)
            prob /= prob.sum(axis=1, keepdims=True)
            prob[np.arange(len(y)), y] -= 1
            delta = prob * weight[y][:, None] / len(y)
            grads = {("out", 0): hidden.T @ delta, ("out_bias", 0): delta.sum(axis=0)}
            back = delta @ params["out", 0].T * (hidden > 0)
            for k, w in enumerate(WIDTHS):
                part, top = back[:, k * FILTERS : (k + 1) * FILTERS], best[k]
                grads["bias", w] = part.sum(axis=0)
                g = np.zeros_like(params["conv", w])
                filters = np.broadcast_to(np.arange(FILTERS), top.shape)
                for o in range(w):
                    np.add.at(g[o], (np.take_along_axis(x, top + o, 1), filters), part)
                grads["conv", w] = g
            step += 1
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    small = {k: v.astype(np.float32) for k, v in params.items()}
    return Model(langs, class_of, {w: small["conv", w] for w in WIDTHS}, {w: small["bias", w] for w in WIDTHS}, small["out", 0], small["out_bias", 0])


class Scorer:
    """Prediction with pair tables, built once for each Python worker."""

    def __init__(self, model: Model):
        self.model = model
        self.pairs, self.single = {}, {}
        for w, conv in model.conv.items():
            self.pairs[w] = [(conv[o][:, None, :] + conv[o + 1][None, :, :]).reshape(CLASSES * CLASSES, FILTERS) for o in range(0, w - 1, 2)]
            self.single[w] = conv[w - 1] if w % 2 else None

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        """float32[windows, langs]: log-softmax of each window."""
        out = np.empty((len(windows), len(self.model.langs)), dtype=np.float32)
        for at in range(0, len(windows), BATCH_WINDOWS):
            x = self.model.class_of[windows[at : at + BATCH_WINDOWS]]
            pair = x[:, :-1].astype(np.int32) * CLASSES + x[:, 1:]
            pooled = []
            for w in WIDTHS:
                span = x.shape[1] - w + 1
                act = None
                for k, rows in enumerate(self.pairs[w]):
                    part = rows.take(pair[:, 2 * k : 2 * k + span], axis=0)
                    act = part if act is None else np.add(act, part, out=act)
                if self.single[w] is not None:
                    np.add(act, self.single[w].take(x[:, w - 1 : w - 1 + span], axis=0), out=act)
                pooled.append(np.maximum(0, act.max(axis=1) + self.model.bias[w]))
            logits = np.concatenate(pooled, axis=1) @ self.model.out + self.model.out_bias
            logits -= logits.max(axis=1, keepdims=True)
            out[at : at + BATCH_WINDOWS] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and probability of each whole text; ``und`` and 0 without a letter."""
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        asked = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not asked or not self.model.langs:
            return langs, scores
        blocks = [windows_of(texts[i].encode("utf-8", "surrogatepass")) for i in asked]
        starts = np.cumsum([0, *(len(b) for b in blocks[:-1])])
        flat = np.concatenate(blocks)
        lp = self.log_probs(flat)
        share = (flat > 64).mean(axis=1).astype(np.float32)[:, None] + 1e-3  # letters and bytes of letters
        mean = np.add.reduceat(lp * share, starts, axis=0) / np.add.reduceat(share, starts, axis=0)
        prob = np.exp(mean - mean.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        for i, row in zip(asked, prob, strict=True):
            langs[i], scores[i] = self.model.langs[int(row.argmax())], float(row.max())
        return langs, scores


@lru_cache(maxsize=1)
def _scorer_of(blob: bytes) -> Scorer:
    import pickle

    return Scorer(pickle.loads(blob))


def training_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = TRAIN_ROWS, per_row: int = TRAIN_WINDOWS) -> pd.DataFrame:
    """(lang, window) of labelled rows outside fold 0: about ``rows`` of each language, and
    ``TRAIN_TOTAL`` in all (a row is taken where the hash of its id falls below that share of its
    language; of rows with equal id and language one, the least text), and at most ``per_row``
    windows evenly spread over its text.  More than ``MOST_LANGS`` languages are an error."""
    labelled = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), quoted(lang_col).alias("lang"))
    labelled = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0) & (fold_of(F.col("id")) != 0))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS + 1).collect()
    if len(counts) > MOST_LANGS:
        raise ValueError(f"{lang_col} holds more than {MOST_LANGS} languages")
    if not counts:
        return pd.DataFrame({"lang": pd.Series(dtype=str), "cut": pd.Series(dtype=str)})
    rows = min(rows, TRAIN_TOTAL // len(counts))
    rate = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], rows / r["n"])))
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 32)) / float(1 << 32) < F.coalesce(F.element_at(rate, F.col("lang")), F.lit(0.0))
    # Places of the windows of one text, in characters; a window of characters holds one of bytes.
    last = F.greatest(F.length("text") - WINDOW, F.lit(0))
    places = F.transform(F.sequence(F.lit(0), F.lit(per_row - 1)), lambda k: F.floor(last * k / F.lit(max(1, per_row - 1))).cast("int"))
    cuts = F.transform(F.array_distinct(places), lambda at: F.substring(F.col("text"), at + 1, F.lit(WINDOW)))
    one = labelled.where(drawn).groupBy("id", "lang").agg(F.min("text").alias("text"))  # repeated ids stay within the bound
    return one.select("lang", "id", F.explode(cuts).alias("cut")).toPandas().sort_values(["lang", "id", "cut"])


def train_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on the labelled rows of ``docs``; without any the model knows no language."""
    sample = training_windows(docs, id_col, text_col, lang_col)
    langs = sorted(sample["lang"].unique())
    if not langs:
        return Model([], np.zeros(256, np.uint8), {}, {}, np.zeros((0, 0)), np.zeros(0))
    windows = np.concatenate([windows_of(t.encode("utf-8", "surrogatepass")[:WINDOW]) for t in sample["cut"]])
    target = sample["lang"].map({lang: k for k, lang in enumerate(langs)}).to_numpy()
    return train(windows, target, langs)


def prediction_column(text: Column, model: Model) -> Column:
    """STRUCT<lang_pred, score> of whole texts, by Arrow batches."""
    import pickle

    blob = pickle.dumps(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _scorer_of(blob)
        for texts in batches:
            out: list[tuple[str, float]] = []
            some: list[str | None] = []
            for t in texts:  # bounded work at once, however long the texts are
                some.append(t)
                if sum(len(s or "") for s in some[-64:]) > 1 << 20 or len(some) == 64:
                    out += zip(*scorer.predict(some), strict=True)
                    some = []
            out += zip(*scorer.predict(some), strict=True)
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return predict(text)


def identify_languages(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: the id, held_out, lang_pred, score.

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learnt.
    Held-out rows (crc32 of the id modulo 5 is 0; null ids too) are never learnt from.  Rows with
    null or repeated ids each get their row; extra columns are not touched.
    """
    model = model or train_model(docs, id_col, text_col, lang_col)
    rows = docs.select(quoted(id_col).alias("id"), prediction_column(quoted(text_col), model).alias("x"))
    return rows.select(F.col("id").alias(id_col), (fold_of(F.col("id")) == 0).alias("held_out"), "x.lang_pred", "x.score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose language is known with at least ``min_score``."""
    to = free_name(docs, "language")
    marked = docs.withColumn(to, prediction_column(quoted(text_col), train_model(docs, id_col, text_col, lang_col)))
    known = (F.col(to)["lang_pred"] != UNKNOWN) & (F.col(to)["score"] >= min_score)
    return marked.where(known).select(*(quoted(c) for c in docs.columns))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the whole ``documents`` table, learnt from its own labelled rows."""
    return identify_languages(table(spark, sf_dir, "documents"))

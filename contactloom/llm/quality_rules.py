"""Quality rules on whole texts, in native expressions only.

Base statistics of words, lines, symbols and repeated 5-word windows give a first verdict.  The
method's verdict is a log-likelihood ratio of hashed n-grams (words and word pairs, in ``buckets``
hash buckets) between the multinomial of trusted documents and that of the whole raw corpus, divided
by the number of n-grams; a document is kept where it reaches a threshold.  That is taken from the
trusted documents' own scores, each against counts without its fold: all but a share ``SPARED`` of
them reach it by ``MARGIN``.

The raw counts cover every document, the trusted ones and the threshold every trusted document.
Which documents are trusted is found by joins on their ids; a broadcast table of hash bits, of bounded
size, first tells which ids cannot be trusted, so that only the texts of the others are shuffled, once.
Scores go to the threshold's join without their texts.  Only counts by bucket and fold, and by
thousandths of a score, ever reach the driver.  Values that a lambda reads more than once are bound by
``_let``: an inlined column would be computed again for every array element.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, free_name, persist, quoted, table

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
BUCKETS = 1 << 14
#: Counts, not a share of the trusted ones: with few of those, clean texts outside them would fall.
PRIOR = 1 << 17
#: Rows of 64 hash bits of trusted ids; with many more ids than bits more texts are shuffled.
BIT_WORDS = 1 << 18
FOLDS = 5
SPARED, MARGIN = 0.001, 0.02
#: Fewer words fail the base rules, and say nothing of the ratio.
LEAST_WORDS = 10


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also for lambdas inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text, repeats included; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more, first ones included.

    Each window becomes one LONG: the leading bits of its hash, then its place.  After sorting,
    equal windows are neighbours (their whole 64-bit hashes are compared); the places of those
    that have an equal neighbour, in order, cover min(window, gap) words each.
    """

    def count(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - window)
        hashes = F.transform(places, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(window))))
        return _let(hashes, lambda h: _let(F.ceil(F.log2(F.size(h) + F.lit(1.0))).cast("int"), lambda bits: from_hashes(h, bits)))

    def from_hashes(h: Column, bits: Column) -> Column:
        packed = F.transform(h, lambda x, i: F.call_function("shiftleft", F.call_function("shiftright", x, bits), bits) + i.cast("long"))
        return _let(F.sort_array(packed), lambda s: covered(s, h, bits))

    def covered(s: Column, h: Column, bits: Column) -> Column:
        def place(x: Column) -> Column:
            return x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")

        def same(x: Column, other: Column) -> Column:
            heads = F.call_function("shiftright", x, bits) == F.call_function("shiftright", other, bits)
            return F.coalesce(heads & (F.get(h, place(x)) == F.get(h, place(other))), F.lit(False))

        twins = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        order = F.sort_array(F.transform(twins, place))
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(window), x - acc["last"])).alias("n"))
        return F.aggregate(order, start, step, lambda acc: acc["n"])

    return F.when(F.size(words) > window, _let(words, count)).otherwise(F.lit(0).cast("long"))


def ngram_buckets(words: Column, buckets: int) -> Column:
    """Hash buckets of all words and word pairs of an array of words."""

    def both(w: Column) -> Column:
        one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
        two = F.transform(w, lambda x, i: F.pmod(F.xxhash64(x, F.get(w, i + 1)), F.lit(buckets)).cast("int"))
        return F.concat(one, F.slice(two, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))))

    return _let(words, both)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All ids that ``labels`` marks as good quality, and their folds."""
    ids = labels.where("quality = 1").select(quoted(id_col).alias("id")).where("id is not null").distinct()
    return ids.select("id", fold_of(F.col("id"), FOLDS).cast("int").alias("fold"))


def _bit_place(id_col: Column) -> tuple[Column, Column]:
    """Row and bit of an id in the table of hash bits."""
    h = F.xxhash64(id_col)
    return h.bitwiseAND(F.lit(BIT_WORDS - 1)), F.call_function("shiftrightunsigned", h, F.lit(58)).cast("int")


def sieved(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and ``likely`` of every row; where that is false the id is not a trusted one."""
    word, bit = _bit_place(F.col("id"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bits = trusted.select(word.alias("word"), one.alias("one")).groupBy("word").agg(F.bit_or("one").alias("bits"))  # at most BIT_WORDS rows
    rows = docs.select(quoted(id_col).cast(trusted.schema["id"].dataType).alias("id"), quoted(text_col).alias("text"))
    found = F.coalesce(F.getbit("bits", bit) == 1, F.lit(False))
    return rows.withColumn("word", word).join(F.broadcast(bits), "word", "left").select("id", "text", found.alias("likely"))


def bucket_counts(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS) -> tuple[list[float], list[list[float]]]:
    """N-grams by bucket: of all documents plus one, and of the trusted ones of each fold."""
    rows = sieved(docs, trusted, id_col, text_col)
    # The hint keeps texts out of a sort; the trusted ids of one task are few.
    near = rows.where("likely").join(trusted.hint("shuffle_hash"), "id", "left").select("fold", "text")
    marked = near.unionByName(rows.where("not likely").select(F.lit(None).cast("int").alias("fold"), "text"))
    grams = marked.select("fold", F.explode(ngram_buckets(words_of(F.col("text")), buckets)).alias("bucket"))
    raw, good = [1.0] * buckets, [[0.0] * buckets for _ in range(FOLDS)]
    for r in grams.groupBy("bucket", "fold").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `buckets` times FOLDS + 1 rows
        raw[r["bucket"]] += r["n"]
        if r["fold"] is not None:
            good[r["fold"]][r["bucket"]] += r["n"]
    return raw, good


def ratio_weights(raw: list[float], good: list[list[float]]) -> list[float]:
    """log(p_trusted / p_raw) of each bucket: the trusted counts of all given folds with a Dirichlet
    prior along the raw distribution, so that few trusted rows judge mildly."""
    sums = [math.fsum(x) for x in zip(*good, strict=True)]
    all_raw, all_good = math.fsum(raw), math.fsum(sums)
    # The trusted multinomial leans on the raw one with the weight of PRIOR counts.
    return [math.log((g + PRIOR * r / all_raw) / (all_good + PRIOR)) - math.log(r / all_raw) for g, r in zip(sums, raw, strict=True)]


def held_out_threshold(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, raw: list[float], good: list[list[float]]) -> float:
    """The score that all but ``SPARED`` of the trusted documents of enough words exceed by
    ``MARGIN`` when each is scored without its fold's counts; minus ``MARGIN`` where there are none."""
    weights = [ratio_weights(raw, good[:k] + good[k + 1 :]) for k in range(FOLDS)]
    of_fold = _literal(weights, "array<array<double>>")

    def bin_of(words: Column) -> Column:
        score = _let(F.get(of_fold, F.col("fold")), lambda table_of: mean_of(words, table_of, len(raw)))
        return F.when(F.size(words) >= LEAST_WORDS, F.floor(score * 1000))  # thousandths of a log-ratio

    rows = sieved(docs, trusted, id_col, text_col).where("likely").withColumn("fold", fold_of(F.col("id"), FOLDS).cast("int"))
    scored = rows.select("id", _let(words_of(F.col("text")), bin_of).alias("bin"))
    # An inner join: a semi-join would be pushed below the scores, and shuffle texts.
    found = scored.join(trusted.select("id").hint("shuffle_hash"), "id").groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()
    bins = [r for r in found if r["bin"] is not None]  # dropped here: a filter would be pushed down and score twice
    below, total = 0, sum(r["n"] for r in bins)
    for r in sorted(bins):
        below += r["n"]
        if below > SPARED * total:
            return r["bin"] / 1000 - MARGIN
    return -MARGIN


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, threshold: float | None = None) -> tuple[list[float], float]:
    """The weights and, where none is given, the threshold."""
    ids = quoted(id_col)
    kind = docs.select(ids).union(labels.select(ids)).schema[0].dataType  # equal ids of two types have equal hashes in one
    trusted = persist(trusted_ids(labels.select(ids.cast(kind).alias(id_col), "quality"), id_col), "trusted-ids")
    raw, good = bucket_counts(docs, trusted, id_col, text_col, buckets)
    return ratio_weights(raw, good), held_out_threshold(docs, trusted, id_col, text_col, raw, good) if threshold is None else threshold


def _literal(values: list, kind: str) -> Column:
    """A constant array; it is one literal of the plan after constant folding."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def mean_of(words: Column, table_of: Column, buckets: int) -> Column:
    """Mean of a table's values at the buckets of a text's n-grams; 0 without any."""
    total = lambda g: F.aggregate(g, F.lit(0.0), lambda acc, b: acc + F.get(table_of, b))
    return _let(ngram_buckets(words, buckets), lambda g: F.when(F.size(g) > 0, total(g) / F.size(g)).otherwise(F.lit(0.0)))


def mean_weight(words: Column, weights: list[float]) -> Column:
    """Mean weight of a text's n-grams; 0 without any."""
    return mean_of(words, _literal(weights, "array<double>"), len(weights))


def judgement(text: Column, weights: list[float], threshold: float) -> Column:
    """STRUCT of a text's base statistics, base_failed, llr and kept; its words are split once."""
    body = F.coalesce(text, F.lit(""))
    symbols = F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long")

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"), mean_weight(w, weights).alias("llr"))

    def verdict(x: Column) -> Column:
        failed = (x["n_words"] < LEAST_WORDS) | (100 * x["n_repeat_words"] > 20 * x["n_words"])
        return F.struct(
            x["n_words"].alias("n_words"),
            x["word_chars"].alias("word_chars"),
            symbols.alias("n_symbols"),
            duplicate_lines(text).alias("n_dup_lines"),
            x["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            x["llr"].alias("llr"),
            (~failed & (x["llr"] >= threshold)).alias("kept"),
        )

    return _let(_let(words_of(text), of_words), verdict)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, the base statistics, base_failed, llr and kept.

    A null text has no words and fails the base rules.  Rows with null or repeated ids each get
    their row; extra columns are not touched.  With no trusted row every weight is zero and only the
    base rules decide; with no documents the result is empty.  ``threshold`` overrides the derived
    one.
    """
    weights, threshold = learn(docs, labels, id_col, text_col, buckets, threshold)
    rows = docs.select(quoted(id_col).alias("id"), judgement(quoted(text_col), weights, threshold).alias("x"))
    return rows.select(F.col("id").alias(id_col), "x.*")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with their columns as they were."""
    weights, threshold = learn(docs, labels, id_col, text_col, threshold=threshold)
    to = free_name(docs, "judged")
    judged = docs.withColumn(to, judgement(quoted(text_col), weights, threshold))
    return judged.where(F.col(to)["kept"]).select(*(quoted(c) for c in docs.columns))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over the whole ``documents`` table, trusted rows from ``labels``."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

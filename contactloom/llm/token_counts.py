"""Token counts through a digest cache.

The cache is a table (content digest, tokenizer-version digest, n_tokens).  Documents are joined to
it by both digests; only distinct contents that it lacks are encoded, once each, and appended.

The content digest is that of the normalised text: where the tokenizer itself lower-cases texts and
drops white space between words, texts of plain characters that differ only so share one count.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import persist, quoted, scratch_path, table

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"
MEMO_WORDS = 1_000_000
#: Contents of one task whose repetitions are skipped.
MOST_SEEN = 100_000
#: So few misses are broadcast (their number is counted first); beyond, texts are shuffled to them.
FEW_MISSES = 10_000
#: Texts of these characters only are counted word by word; the library itself counts all others.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa0-\xac\xae-įı-ſ‐-‧€]*")
#: Fixed value: the split of the lower-case word vocabularies this fast path knows.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_digest(path: str) -> str:
    """sha256 of the vocabulary file: another version of it shares no counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class TokenCount:
    """Number of tokens of a text as the library gives it (no added, begin or end tokens)."""

    def __init__(self, path: str):
        self._memo: dict[str, int] = {}
        self._split = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._whole = lambda text: len(model.encode(text))
            return
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self._whole = lambda text: len(library.encode(text, add_special_tokens=False))
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._specials = [t["content"] for t in spec["added_tokens"]]
        steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        if steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": WORDS} and split.get("invert") and split.get("behavior") == "Removed":
            self._split = regex.compile(WORDS).findall

    def __call__(self, text: str) -> int:
        if self._split is None or not PLAIN.fullmatch(text) or any(s in text for s in self._specials):
            return self._whole(text)
        memo, total = self._memo, 0
        for word in self._split(text.lower()):
            n = memo.get(word)
            if n is None:
                n = self._whole(word)
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                if len(word) <= 64:
                    memo[word] = n
            total += n
        return total


    @property
    def folds(self) -> bool:
        """Whether plain texts without added tokens count the same in lower case and with any runs
        of white space between the same words."""
        return self._split is not None

    @property
    def added(self) -> list[str]:
        """Strings that are tokens of their own."""
        return self._specials if self._split is not None else []


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCount:
    """One counter for each Python worker."""
    return TokenCount(path)


def content_digest(text: Column, count: TokenCount) -> Column:
    """sha256 of a text's normal form.  Texts that the folding is not proven for are digested as
    they are, with a mark that keeps them apart from normal forms."""
    if not count.folds:
        return F.sha2(text.cast("binary"), 256)
    plain = ~text.rlike(f"[^{PLAIN.pattern[1:-2]}]")
    for token in count.added:
        plain = plain & ~text.contains(token)
    form = F.lower(text)
    for mark in "\t\n\r":
        form = F.replace(form, F.lit(mark), F.lit(" "))
    form = F.btrim(F.when(form.contains("  "), F.regexp_replace(form, " {2,}", " ")).otherwise(form))
    return F.sha2(F.when(plain, F.concat(F.lit("n"), form)).otherwise(F.concat(F.lit("r"), text)).cast("binary"), 256)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache, empty where nothing has been written yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, vocabulary: str, cache: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_bytes, n_tokens, over_limit.

    A null text counts as empty.  Rows with null or repeated ids each get their row; extra columns
    are not touched.  ``cache`` is a path in shared storage; it is created when missing and only
    ever appended to (a text counted twice by two runs at once gives two equal rows, of which one
    is read).  With few misses no text is shuffled; with many, each text is once.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(vocabulary)
    text = F.coalesce(quoted(text_col), F.lit(""))
    raw = F.unhex(F.sha2(text.cast("binary"), 256))
    known = read_cache(spark, cache).where(F.col("tokenizer") == version)

    # Normal forms are made once; everything but the texts of misses is read from this table.
    sized = docs.select(quoted(id_col).alias("id"), raw.alias("raw"), content_digest(text, counter(vocabulary)).alias("content"), F.octet_length(text).cast("long").alias("n_bytes"))
    sized = persist(sized, "token-digests")

    # One row of each missing content stands for all; its text is fetched by (id, raw digest).
    # Grouped before the join, so that copies shrink before they are shuffled.
    contents = sized.groupBy("content").agg(F.min(F.struct("id", "raw")).alias("x")).select("content", F.col("x.id").alias("chosen"), F.col("x.raw").alias("digest"))
    chosen = persist(contents.join(known.select("content"), "content", "left_anti"), "token-misses")
    misses = chosen.count()
    few = misses <= FEW_MISSES
    # The build side holds digests only, each once, so its partitions are even.
    rows = docs.select(quoted(id_col).alias("id"), text.alias("text"), raw.alias("raw"))
    texts = rows.join(F.broadcast(chosen) if few else chosen.hint("shuffle_hash"), (F.col("raw") == F.col("digest")) & F.col("id").eqNullSafe(F.col("chosen"))).select("content", "text")
    if few:
        texts = texts.dropDuplicates(["content"])  # rows that are equal in id and text; the shuffled join brings them together

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, seen = counter(vocabulary), set()
        for batch in batches:
            fresh = batch.drop_duplicates("content")
            fresh = fresh[~fresh["content"].isin(seen)]
            if len(seen) > MOST_SEEN:
                seen.clear()  # a content met again is counted again, and stands twice in the cache
            seen.update(fresh["content"])
            yield pd.DataFrame({"content": fresh["content"], "tokenizer": version, "n_tokens": [count(t) for t in fresh["text"]]})

    if misses:
        texts.mapInPandas(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    counts = persist(counts, "token-counts")  # a plain side, so that a join on a popular content can be split
    return sized.join(counts, "content").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of the whole ``documents`` table, through the cache that the session names in
    ``contactloom.token.cache``; where that is unset, through one that starts empty."""
    import public_tokenizers

    cache = spark.conf.get("contactloom.token.cache", None) or scratch_path(spark, "token-cache")
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache)

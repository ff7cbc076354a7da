"""Best-fit packing by minimum bin slack over the histogram of piece lengths.

A document is its token ids and an end token.  Only documents longer than a sequence are cut, from
the back, so all their pieces but the first fill a sequence.  Each bin starts from the longest piece
left; subset sums over the lengths still available (a bitset: bit s of a Python integer says that s tokens can be filled) find
the fullest feasible combination, which is removed.  Equal lengths are interchangeable, so the
search runs on counts by length, at most ``capacity`` of them whatever the corpus: a combination is
taken as often as its lengths last, and the plan is a table of at most a few thousand rows.  Pieces
get their place in it by their rank among pieces of the same length, from counts by input partition.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_chars
from .common import persist, quoted, table

#: Texts of these characters only take the fast encoder; the library itself encodes all others.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa0-\xac\xae-ſ‐-‧€]*")


#: Columns of a piece after its id.
PIECE = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "part": pa.int32(), "rank": pa.int64()}


class TokenIds:
    """Token ids as the tokenizers library gives them, faster for plain texts.

    A byte-level vocabulary whose merges stand in the order of their ids is the same thing as
    a table of ranks, for which there is a quicker encoder in ``tiktoken``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._quick = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"].get("vocab", {}), spec["model"].get("merges", [])
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self._specials = [t["content"] for t in spec["added_tokens"]]
        if plain and all(vocab[a + b] == 256 + k for k, (a, b) in enumerate(pairs)):
            import tiktoken
            from public_tokenizers import PATTERN

            byte_of = {c: b for b, c in enumerate(byte_chars())}
            ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
            self._quick = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self._quick is not None and PLAIN.fullmatch(text) and not any(s in text for s in self._specials):
            return self._quick.encode_ordinary(text)
        return self._library.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def token_ids(path: str) -> TokenIds:
    """One encoder for each Python worker."""
    return TokenIds(path)


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """id, piece, start, length, ids_crc32, and a rank among equal lengths within the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = token_ids(vocabulary), defaultdict(int)
        part = TaskContext.get().partitionId()
        for batch in batches:
            row_of, rows, own_ids = [], [], []
            for row, text in enumerate(batch.column("text")):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                at, piece = 0, 0
                end = len(ids) % capacity or capacity
                while at < len(ids):
                    own = ids[at:end]
                    row_of.append(row)
                    rows.append((piece, at, len(own), zlib.crc32(own.tobytes()), part, seen[len(own)]))
                    if keep_ids:
                        own_ids.append(own.astype(np.int64))
                    seen[len(own)] += 1
                    at, end, piece = end, end + capacity, piece + 1
            numbers = np.array(rows, dtype=np.int64).reshape(-1, len(PIECE)).T
            # The id stays an Arrow column: pandas would make floats of longs beside a null.
            made = {"id": batch.column("id").take(pa.array(row_of, pa.int64()))}
            made |= {name: pa.array(x, kind) for (name, kind), x in zip(PIECE.items(), numbers, strict=True)}
            if keep_ids:
                made["ids"] = pa.array(own_ids, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(list(made.values()), list(made))

    source = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<long>" * keep_ids)


def fullest(lengths: list[int], counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The combination of available lengths with the least slack, longest lengths preferred:
    [(length, times)].  ``lengths`` descend; bit s of a state says that s can be filled."""
    states, full = [1], (1 << capacity + 1) - 1
    for n in lengths:
        state, left, step = states[-1], counts[n], 1
        while left and n * step <= capacity:  # doubling: 1, 2, 4, ... copies, then the rest
            take = min(step, left)
            state |= (state << n * take) & full
            left, step = left - take, step * 2
        states.append(state)
        if state >> capacity & 1:
            break
    goal, out = states[-1].bit_length() - 1, []
    for k in range(len(states) - 2, -1, -1):  # walk back: as few copies as reach a known state
        n, times = lengths[k], 0
        while not states[k] >> goal & 1:
            goal, times = goal - n, times + 1
        if times:
            out.append((n, times))
    return out


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, [(length, times in each bin)])] that use up the histogram.

    Each bin holds the longest piece left, as every packing must somewhere, and the fullest
    combination of what else is available.
    """
    counts = {n: c for n, c in histogram.items() if c > 0}
    plan = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        others = sorted((n for n, c in counts.items() if c and n <= capacity - longest), reverse=True)
        times_of = dict(fullest(others, counts, capacity - longest)) if others else {}
        counts[longest] += 1
        times_of[longest] = times_of.get(longest, 0) + 1
        combination = sorted(times_of.items(), reverse=True)
        bins = min(counts[n] // times for n, times in combination)
        for n, times in combination:
            counts[n] -= bins * times
            if not counts[n]:
                del counts[n]
        plan.append((bins, combination))
    return plan


def placement(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """Of each length: rows (first rank, times, first sequence, offset), by rank."""
    table_of: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for bins, combination in plan:
        offset = 0
        for n, times in combination:
            table_of[n].append((used[n], times, sequence, offset))
            used[n] += bins * times
            offset += n * times
        sequence += bins
    return {n: np.array(rows, dtype=np.int64) for n, rows in table_of.items()}


def _placed(length: Column, rank: Column, plan: dict[int, np.ndarray]) -> Column:
    """(sequence_id, offset) of a piece by its length and its rank among equal lengths."""

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        size, rank = lengths.to_numpy(), ranks.to_numpy()
        out = np.empty((len(size), 2), dtype=np.int64)
        order = np.argsort(size, kind="stable")
        edges = np.nonzero(np.diff(size[order], prepend=-1))[0]
        for own in np.split(order, edges[1:]) if len(order) else []:
            rows, n = plan[int(size[own[0]])], size[own[0]]
            row = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
            past = rank[own] - row[:, 0]
            out[own, 0] = row[:, 2] + past // row[:, 1]
            out[own, 1] = row[:, 3] + past % row[:, 1] * n
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    return place(length, rank)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per piece: the id, piece, start, length, ids_crc32, sequence_id, offset; with
    ``keep_ids`` also its ``ids``.

    A null or empty text is the end token alone.  Rows with equal or null ids are documents of
    their own; extra columns of ``docs`` are not touched; an empty table gives no pieces.
    """
    pieces = persist(pieces_of(docs, vocabulary, capacity, end_id, id_col, text_col, keep_ids), "packing-pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = placement(minimum_bin_slack(histogram, capacity))
    ranked = pieces.join(ahead, ["part", "length"]).withColumn("at", _placed(F.col("length"), F.col("rank") + F.col("ahead"), plan))
    return ranked.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *(["ids"] if keep_ids else []))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table packed into sequences of 2048 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)

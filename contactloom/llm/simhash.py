"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of 64 bits are cut into ``max_bits + 1`` consecutive segments on a ring.  If two
fingerprints differ in at most ``max_bits`` bits, some segment starts a chain of consecutive
segments whose cumulative differences stay within 0, 1, 2, ... bits (the proportional budgets
``floor(l * t / (t + 1))`` of the pigeonring principle).  The first segments of such a chain are
the index key: the start segment must agree, and the following ``chain - 1`` segments together
differ in at most ``chain - 1`` bits, so of ``parts`` equal pieces of them all but ``chain - 1``
agree.  Candidates meet by equality of these masked keys, must then pass every budget of their
chain, and only then the full Hamming check.  The filter is exact: no pair is lost.

Keys that many different fingerprints share are lengthened by further segments of the chain.  Other
shared keys return spanning forests of one block, and what the longest keys leave is cut into blocks
whose pairs return spanning forests, so work and output of one task stay bounded.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_name, persist, quoted, table
from .graph import connected_components

BITS = 64
SEED = 42
SMALL_BUCKET = 64
BLOCK = 2048
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The unsigned 64-bit SimHash of one whole text (0 for null or no word)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        grams: list[bytes] = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], dtype=np.uint64)
    # Bit k of every byte lies alone in its byte lane; up to 255 rows add up without a carry.
    starts = np.arange(0, len(hashes), 255)
    counts = np.empty((8, 8), dtype=np.int64)  # [bit in byte, byte]
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, starts)
        counts[k] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    on = 2 * counts > len(hashes)
    return int.from_bytes(np.packbits(on, axis=0, bitorder="little").tobytes(), "little")


def fingerprint_column(text: Column, shingle: int = 4) -> Column:
    """SimHash as a signed LONG column, by Arrow batches."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
            yield pd.Series(out.view(np.int64))

    return simhash(text)


def segments(max_bits: int) -> list[int]:
    """Bit masks of ``max_bits + 1`` consecutive segments, as even as 64 bits allow."""
    m = max_bits + 1
    cuts = [round(i * BITS / m) for i in range(m + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in itertools.pairwise(cuts)]


def chain_masks(max_bits: int) -> list[list[int]]:
    """For each start segment, the masks of its chains of 1, 2, ... consecutive segments."""
    seg = segments(max_bits)
    m = len(seg)
    return [list(itertools.accumulate((seg[(i + j) % m] for j in range(m)), int.__or__)) for i in range(m)]


def key_masks(max_bits: int, chain: int, parts: int) -> list[tuple[int, int]]:
    """(start segment, mask): the bits that must agree in one of the index keys."""
    seg, out = segments(max_bits), []
    m = len(seg)
    chain = min(chain, m)
    for i in range(m):
        tail = [1 << b for j in range(1, chain) for b in range(BITS) if seg[(i + j) % m] >> b & 1]
        pieces = [sum(tail[round(p * len(tail) / parts) : round((p + 1) * len(tail) / parts)]) for p in range(parts)]
        for gone in itertools.combinations(range(parts), chain - 1):
            out.append((i, seg[i] | sum(x for p, x in enumerate(pieces) if p not in gone)))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def within_budgets(start: Column, a: Column, b: Column, max_bits: int) -> Column:
    """The pigeonring test of one candidate: each chain from ``start`` keeps its budget."""
    test = F.lit(False)
    for i, masks in enumerate(chain_masks(max_bits)):
        kept = F.lit(True)
        for length, mask in enumerate(masks, 1):
            kept = kept & (F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(_signed(mask)))) <= length * max_bits // (max_bits + 1))
        test = F.when(start == i, kept).otherwise(test)
    return test


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))  # of signed numbers it would count the absolute value's


def block_forest(left: np.ndarray, right: np.ndarray | None, max_bits: int, start: int) -> list[tuple[int, int]]:
    """A spanning forest of the links inside ``left`` (right None) or between two blocks that have
    their chain from segment ``start``.

    Breadth-first search over whole rows of candidates: each vertex is expanded once, candidates
    fall one chain budget after the other before the full Hamming check, at most one edge a vertex
    is returned and memory stays at one row.
    """
    cross = right is not None
    nodes = np.concatenate([left, right]) if cross else left
    side = np.r_[np.zeros(len(left), bool), np.ones(len(nodes) - len(left), bool)]
    budgets = [(np.int64(_signed(mask)), n * max_bits // (max_bits + 1)) for n, mask in enumerate(chain_masks(max_bits)[start], 1)]
    unseen = np.ones(len(nodes), bool)
    edges: list[tuple[int, int]] = []
    for root in range(len(nodes)):
        if not unseen[root]:
            continue
        unseen[root] = False
        queue = [root]
        while queue:
            v = queue.pop()
            near = np.nonzero(unseen & (side != side[v]) if cross else unseen)[0]
            apart = nodes[near] ^ nodes[v]
            for mask, budget in budgets:  # the last chain is the whole ring
                kept = _popcount(apart & mask) <= budget
                near, apart = near[kept], apart[kept]
            near = near[_popcount(apart) <= max_bits]
            unseen[near] = False
            edges += [(int(nodes[v]), int(nodes[u])) for u in near]
            queue += near.tolist()
    return edges


def key_bits(max_bits: int, chain: int, parts: int) -> int:
    """Bits that must agree in the narrowest index key of a level."""
    return min(mask.bit_count() for _, mask in key_masks(max_bits, chain, parts))


def ladder(max_bits: int) -> list[tuple[int, int]]:
    """(chain, parts) of the levels of index keys, from the narrowest (22 bits at four bits of
    difference) to the widest (38)."""
    return list(dict.fromkeys((min(chain, max_bits + 1), parts) for chain, parts in ((2, 3), (3, 5), (4, 7), (5, 8))))


def _keyed(wanted: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """fp, i, m, k of each (fp, start segment i): every key of that start."""
    starts = range(max(i for i, _ in masks) + 1)
    of_start = [", ".join(f"struct({n} AS m, {_signed(mask)}L AS mask)" for n, (j, mask) in enumerate(masks) if j == i) for i in starts]
    of_start = F.expr(f"array({', '.join(f'array({keys})' for keys in of_start)})")  # one literal of the plan
    keys = wanted.select("fp", "i", F.explode(F.get(of_start, F.col("i"))).alias("x"))
    return keys.select("fp", "i", "x.m", F.col("fp").bitwiseAND(F.col("x.mask")).alias("k"))


def _pairs(few: DataFrame, max_bits: int) -> DataFrame:
    """Links within small buckets, by budgets and then the Hamming check."""
    a = few.select("m", "k", "i", F.col("fp").alias("a"))
    b = few.select("m", "k", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    found = a.join(b, ["m", "k"]).where((F.col("a") < F.col("b")) & within_budgets(F.col("i"), F.col("a"), F.col("b"), max_bits) & near)
    return found.select("a", "b")


def _spans(many: DataFrame, max_bits: int) -> DataFrame:
    """Spanning forests of larger buckets: of one block, or of each pair of a bucket's blocks."""
    many = many.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    many = many.select("fp", "i", "m", "k", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    many = many.select("fp", "i", "m", "k", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def forest(group: pd.DataFrame) -> pd.DataFrame:
        fp, first, start = group["fp"].to_numpy(), (group["own"] == group["lo"]).to_numpy(), int(group["i"].iloc[0])
        one_block = bool((group["lo"] == group["hi"]).iloc[0])
        edges = block_forest(fp, None, max_bits, start) if one_block else block_forest(fp[first], fp[~first], max_bits, start)
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return many.groupBy("m", "k", "lo", "hi").applyInPandas(forest, "a long, b long")


def fingerprint_links(fps: DataFrame, max_bits: int = 4, level: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``, LONG) that span every component
    of the graph "differ in at most ``max_bits`` bits".

    Index keys stand on a ladder of longer chains.  Work starts on the rung (``level``) whose keys
    have about as many values as there are fingerprints; a bucket that holds more than one block is
    keyed again, from the same start segment, on the next rung, since a pair within all budgets
    also agrees in one of its longer keys.  What the last rung leaves is compared block by block.
    """
    fps = persist(fps.select("fp").where("fp is not null").distinct(), "simhash-distinct")
    rungs = ladder(max_bits)
    if level is None:
        n = fps.count()
        level = next((k for k, (chain, parts) in enumerate(rungs) if n <= 1 << key_bits(max_bits, chain, parts)), len(rungs) - 1)
    wanted, found = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(max_bits))).alias("i")), []
    for chain, parts in rungs[level:]:
        keyed = _keyed(wanted, key_masks(max_bits, chain, parts))
        # Written, so that the join can be split where many fingerprints share a key.
        shared = persist(keyed.groupBy("m", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-shared")
        met = persist(keyed.join(shared, ["m", "k"]), "simhash-keys")
        discard(shared)
        large = F.col("n") > BLOCK
        last = (chain, parts) == rungs[-1] or met.where(large).isEmpty()
        found += [_pairs(met.where(F.col("n") <= SMALL_BUCKET), max_bits), _spans(met.where((F.col("n") > SMALL_BUCKET) & (F.lit(last) | ~large)), max_bits)]
        if last:
            break
        wanted = persist(met.where(large).select("fp", "i").distinct(), "simhash-wanted")
    return reduce(DataFrame.union, found)


def fingerprint_components(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """(fp, root) for every distinct fingerprint that has a link; all others are alone."""
    found = connected_components(fingerprint_links(fps, max_bits), "simhash-components")
    return found.select(F.col("node").alias("fp"), "root")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 4, shingle: int = 4) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, fingerprint (hex), component_id.

    ``component_id`` is the smallest id reachable over links of at most ``max_bits`` differing
    bits.  Null, empty and blank texts have fingerprint zero and are linked like any other.  Rows
    without an id take part; where a whole component has no id, component_id is null.  Repeated
    rows come back as often as they came; other columns of ``docs`` are not touched.
    """
    rows = persist(docs.select(quoted(id_col).alias("id"), fingerprint_column(quoted(text_col), shingle).alias("fp")), "simhash-rows")
    lowest = persist(rows.groupBy("fp").agg(F.min("id").alias("id")), "simhash-lowest")
    roots = fingerprint_components(lowest.select("fp"), max_bits)
    of_fp = persist(lowest.join(roots, "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    of_root = persist(of_fp.groupBy("root").agg(F.min("id").alias("component_id")), "simhash-components")
    named = persist(of_fp.join(of_root, "root").select("fp", "component_id"), "simhash-named")
    discard(of_fp, of_root)
    joined = rows.join(named, "fp")
    return joined.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 4, shingle: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each component is kept: one with its smallest
    id, or any where no row has an id.  Columns are as they were."""
    fp, row = free_name(docs, "fp"), free_name(docs, "row")
    marked = docs.withColumn(fp, fingerprint_column(quoted(text_col), shingle)).withColumn(row, F.monotonically_increasing_id())
    marked = persist(marked, "simhash-docs")  # from here on the row numbers stand
    first = F.min(F.struct(quoted(id_col).isNull().alias("none"), quoted(id_col).alias("id"), F.col(row).alias("row"))).alias("x")
    lowest = marked.groupBy(F.col(fp).alias("fp")).agg(first)
    lowest = persist(lowest, "simhash-lowest")
    roots = fingerprint_components(lowest.select("fp"), max_bits)
    kept = lowest.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("x").alias("x"))
    stay = marked.join(kept.select(F.col("x.row").alias(row)), row, "left_semi")
    return stay.select(*(quoted(c) for c in docs.columns))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and components of the whole ``documents`` table."""
    return simhash_groups(table(spark, sf_dir, "documents"))

"""Embedding near-duplicates by dual traversal of cover trees, exact above a cosine threshold.

On unit vectors cosine >= t is a distance of at most sqrt(2 - 2t).  A cover tree has nested levels
whose radii halve; each node knows the true distance of its farthest member.  Two trees are walked
together, level by level: a pair of nodes whose centres lie farther apart than the link distance
plus both covering radii holds no link and is dropped with all below it.  The survivors are points,
which are tested in double precision.

Equal vectors are merged first and carry their number.  Large labels have a top level of the tree
for all of them: a bounded number of pivots, each vector in the cell of its nearest one.  Cells are
dealt into blocks of bounded size; the tree of a block is built once and stored with it.  Pairs of
blocks fall by the bounds of their roots before any vector is moved; those left are compared in
tiles of a few blocks by a few, so that a block is sent once for each tile, not for each partner.
A tile returns sums of links for each vector and a spanning forest, never the list of all pairs.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, persist, quoted, table
from .graph import connected_components

#: A block holds at most so many vectors, and fewer where they are long.
BLOCK, BLOCK_NUMBERS = 2_048, 1 << 20
#: Blocks along each side of a tile.
TILE = 4
#: Pivots of a label that needs several blocks, and of all labels.
LABEL_PIVOTS, ALL_PIVOTS = 256, 4_096
#: Room for rounding of single-precision distances; what passes is tested again in double.
SLACK = 2e-3


@dataclass
class Level:
    """Nodes of one level: centre (a row), parent in the level above, covering radius."""

    centre: np.ndarray
    parent: np.ndarray
    radius: np.ndarray


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unit vectors by their inner products."""
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def cover_tree(unit: np.ndarray, finest: float) -> list[Level]:
    """Levels of radius 2, 1, 1/2, ... down to ``finest``, then the points themselves.

    Centres of a level stay centres below it (nesting), lie farther apart than its radius
    (separation), and each point has one within it (covering).  Distances are computed from new
    centres to points that no centre covers yet, never for all pairs beforehand.
    """
    n = len(unit)
    centre, owner, far = np.zeros(1, np.int64), np.zeros(n, np.int64), _apart(unit, unit[:1])[:, 0]
    far[0] = 0  # rounding may say otherwise
    centres, parents, radius = [centre], [np.zeros(1, np.int64)], 2.0
    while radius / 2 >= finest and len(centre) < n:
        radius /= 2
        open_ = np.nonzero(far > radius)[0]
        if len(open_) and len(centre) > 1:  # another centre may cover them
            from_centres = _apart(unit[open_], unit[centre])
            best = from_centres.argmin(axis=1)
            near = from_centres[np.arange(len(open_)), best]
            hit = near <= radius
            owner[open_[hit]], far[open_[hit]] = best[hit], near[hit]
            open_ = open_[~hit]
        new, above = [], []
        while len(open_):
            c = open_[0]
            reach = _apart(unit[open_], unit[c : c + 1])[:, 0]
            reach[0] = 0
            hit = reach <= radius
            new.append(c)
            above.append(owner[c])
            owner[open_[hit]], far[open_[hit]] = len(centre) + len(new) - 1, reach[hit]
            open_ = open_[~hit]
        parents.append(np.r_[np.arange(len(centre)), np.array(above, np.int64)])
        centre = np.r_[centre, np.array(new, np.int64)]
        centres.append(centre)
    levels = [Level(np.arange(n), owner, np.zeros(n, unit.dtype))]
    for centre, parent in zip(reversed(centres), reversed(parents), strict=True):
        gap = np.sqrt(((unit - unit[centre[owner]]) ** 2).sum(axis=1))
        reach = np.zeros(len(centre), unit.dtype)
        np.maximum.at(reach, owner, gap)
        levels.append(Level(centre, parent, reach))
        owner = parent[owner]
    return levels[::-1]


def dual_traversal(a: np.ndarray, b: np.ndarray, left: list[Level], right: list[Level], link: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and of ``b`` that may lie within ``link``: a superset, pruned by the bounds."""

    def padded(levels: list[Level], depth: int) -> list[Level]:
        stay = [Level(x.centre, np.arange(len(x.centre)), x.radius) for x in levels[-1:]]
        return levels + stay * (depth - len(levels))

    depth = max(len(left), len(right))
    alive = np.ones((1, 1), bool)
    for k, (x, y) in enumerate(zip(padded(left, depth), padded(right, depth), strict=True)):
        if k:
            alive = alive[np.ix_(x.parent, y.parent)]
        rows, cols = np.nonzero(alive.any(axis=1))[0], np.nonzero(alive.any(axis=0))[0]
        if not len(rows):
            return rows, cols
        apart = _apart(a[x.centre[rows]], b[y.centre[cols]])
        near = apart <= link + SLACK + x.radius[rows][:, None] + y.radius[cols][None, :]
        kept = np.zeros_like(alive)
        kept[np.ix_(rows, cols)] = near
        alive &= kept
    return np.nonzero(alive)


@dataclass
class Block:
    """Vectors with their numbers of copies, and the cover tree of their directions."""

    rep: np.ndarray
    times: np.ndarray
    raw: np.ndarray  # scaled by powers of two, so that no square over- or underflows
    norm: np.ndarray
    unit: np.ndarray
    levels: list[Level]


def make_block(rep: np.ndarray, times: np.ndarray, raw: np.ndarray, threshold: float) -> Block:
    """A block with its tree, whose root is the vector nearest to the mean."""
    raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])
    norm = np.sqrt((raw * raw).sum(axis=1))
    unit = (raw / norm[:, None]).astype(np.float32)
    order = np.argsort(-(unit @ unit.mean(axis=0)), kind="stable")
    rep, times, raw, norm, unit = (x[order] for x in (rep, times, raw, norm, unit))
    return Block(rep, times, raw, norm, unit, cover_tree(unit, link_distance(threshold) / 4))


def link_distance(threshold: float) -> float:
    """Distance of unit vectors whose cosine is ``threshold``."""
    return math.sqrt(max(0.0, 2 - 2 * threshold))


def links_between(a: Block, b: Block, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Exact links (rows of a, rows of b); each pair once where b is a."""
    i, j = dual_traversal(a.unit, b.unit, a.levels, b.levels, link_distance(threshold))
    if b is a:
        i, j = i[i < j], j[i < j]
    sure = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        sure[at : at + len(p)] = np.einsum("nd,nd->n", a.raw[p], b.raw[q]) / (a.norm[p] * b.norm[q]) >= threshold
    return i[sure], j[sure]


def spanning_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component under the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def usable(vector: Column) -> Column:
    """True for a vector of at least one component, all of them finite, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _nearest(pivots: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Cell of each vector: the row of the pivot with the largest cosine."""
    return (np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None]) @ pivots.T).argmax(axis=1)


def _room(dim: Column) -> Column:
    """Vectors of ``dim`` components in a block."""
    return F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_NUMBERS) / dim).cast("int")))


def _pivots(distinct: DataFrame, sizes: DataFrame) -> dict[tuple, np.ndarray]:
    """Unit vectors by (label, dim) for the largest labels of more than one block: about one a block,
    drawn by digest, within both bounds.  Labels without any have one cell."""
    key = ["label", "dim"]
    large = sizes.where("n > room").orderBy(F.desc("n"), *key).limit(ALL_PIVOTS // 2).collect()
    if not large:
        return {}
    total = sum(r["n"] for r in large)
    wanted = [max(1, min(LABEL_PIVOTS, r["n"] // r["room"], ALL_PIVOTS * r["n"] // total)) for r in large]
    kinds = distinct.select(*key).schema
    rates = distinct.sparkSession.createDataFrame([(r["label"], r["dim"], w / r["n"]) for r, w in zip(large, wanted, strict=True)], kinds.add("rate", "double"))
    draw = F.pmod(F.xxhash64("digest"), F.lit(1 << 32)) / float(1 << 32)
    drawn = distinct.join(F.broadcast(rates), key).where(draw < F.col("rate")).orderBy(F.xxhash64("digest"), "digest", *key)  # `large` is bounded
    out: dict[tuple, list] = {}
    for r in drawn.select(*key, "vector").limit(2 * ALL_PIVOTS).collect():
        v = np.array(r["vector"], dtype=np.float64)
        v = np.ldexp(v, -np.frexp(np.abs(v).max())[1])
        out.setdefault((r["label"], r["dim"]), []).append(v / math.sqrt(float(v @ v)))
    return {k: np.array(v) for k, v in out.items()}


def stored_blocks(distinct: DataFrame, threshold: float) -> DataFrame:
    """Blocks of ``distinct`` (label, dim, rep, digest, vector, times), written with their trees:
    label, dim, at (number in the label), centre and radius of the root, block (pickled)."""
    key = ["label", "dim"]
    sizes = persist(distinct.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("room", _room(F.col("dim"))), "embedding-sizes")
    pivots = _pivots(distinct, sizes)
    rows = distinct.select(*key, "rep", "vector", "times")

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = np.zeros(len(batch), np.int32)
            for own, at in batch.groupby(key).indices.items():
                if own in pivots:
                    cells[at] = _nearest(pivots[own], np.array(batch["vector"].iloc[at].tolist(), dtype=np.float64))
            yield batch.assign(cell=cells)

    placed = persist(rows.mapInPandas(assign, f"{rows.schema.simpleString()[7:-1]},cell:int"), "embedding-cells")
    cells = placed.groupBy(*key, "cell").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / _room(F.col("dim"))).cast("int")
    before = Window.partitionBy(*key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = persist(cells.select(*key, "cell", blocks.alias("blocks"), F.coalesce(F.sum(blocks).over(before), F.lit(0)).alias("first")), "embedding-cell-sizes")
    dealt = placed.join(cells, [*key, "cell"]).select(*key, (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("blocks"))).alias("at"), "rep", "vector", "times")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        made = make_block(group["rep"].to_numpy(), group["times"].to_numpy(), np.array(group["vector"].tolist(), dtype=np.float64), threshold)
        root = made.levels[0]
        return pd.DataFrame({"label": group["label"].iloc[:1], "dim": group["dim"].iloc[:1], "at": group["at"].iloc[:1], "centre": [made.unit[root.centre[0]]], "radius": [float(root.radius[0])], "block": [pickle.dumps(made)]})

    kinds = rows.select(*key).schema.simpleString()[7:-1]
    stored = persist(dealt.groupBy(*key, "at").applyInPandas(pack, f"{kinds}, at long, centre array<float>, radius double, block binary"), "embedding-blocks")
    discard(sizes, placed, cells)
    return stored


def near_tiles(stored: DataFrame, threshold: float) -> DataFrame:
    """label, dim, tile (two numbers), at and partners of each block of each tile; a partner is a
    block in the tile, itself included, whose root is near enough for a link."""
    roots = stored.select("label", "dim", "at", "centre", "radius")
    a, b = (roots.select("label", "dim", *(F.col(c).alias(f"{c}_{x}") for c in ("at", "centre", "radius"))) for x in "ab")
    product = F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)
    bound = F.lit(link_distance(threshold) + SLACK) + F.col("radius_a") + F.col("radius_b")
    pairs = a.join(b, ["label", "dim"]).where((F.col("at_a") <= F.col("at_b")) & (F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * product)) <= bound))
    pairs = pairs.select("label", "dim", *(F.floor(F.col(f"at_{x}") / TILE).alias(f"tile_{x}") for x in "ab"), "at_a", "at_b")
    key = ["label", "dim", "tile_a", "tile_b"]
    both = pairs.select(*key, F.col("at_a").alias("at"), F.col("at_b").alias("partner")).union(pairs.select(*key, "at_b", F.lit(None)))
    return both.groupBy(*key, "at").agg(F.collect_set("partner").alias("partners"))  # at most TILE of them


def embedding_groups(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: the id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine
    in double precision reaches ``threshold``.  Null, empty and zero vectors and those with null or
    non-finite components link with nothing.  Repeated rows link with each other like any other
    rows; a row without an id counts as a link but cannot name a component, so ``kept`` is false
    for it.  Extra columns are not touched.
    """
    vector = quoted(vector_col)
    good = usable(vector) & quoted(label_col).isNotNull()
    # Vectors are joined and grouped by a digest of their components.
    digest = F.sha2(F.concat_ws(",", vector.cast("array<string>")), 256)
    rows = vectors.select(quoted(id_col).alias("id"), quoted(label_col).alias("label"), F.when(good, digest).alias("digest"), vector.alias("vector"))
    distinct = rows.where("digest is not null").groupBy("label", "digest").agg(F.first("vector").alias("vector"), F.min("id").alias("id"), F.count(F.lit(1)).alias("times"))
    distinct = persist(distinct.withColumn("rep", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "embedding-distinct")
    stored = stored_blocks(distinct, threshold)
    tiles = persist(near_tiles(stored, threshold), "embedding-tiles")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        blocks = {at: pickle.loads(block) for at, block in zip(group["at"], group["block"], strict=True)}
        first = dict(zip(blocks, np.cumsum([0, *(len(x.rep) for x in blocks.values())]), strict=False))
        rep, times = (np.concatenate([getattr(x, name) for x in blocks.values()]) for name in ("rep", "times"))
        ends = [(np.zeros(0, np.int64),) * 2]
        for at, partners in zip(group["at"], group["partners"], strict=True):
            for to in partners:
                i, j = links_between(blocks[at], blocks[to], threshold)
                ends.append((i + first[at], j + first[to]))
        i, j = (np.concatenate(x) for x in zip(*ends, strict=True))
        n = np.bincount(i, weights=times[j], minlength=len(rep)) + np.bincount(j, weights=times[i], minlength=len(rep))
        at = np.nonzero(n)[0]
        root = spanning_roots(len(rep), i, j)
        return pd.DataFrame({"rep": rep[at], "to": rep[root[at]], "n": n[at].astype(np.int64)})

    met = tiles.join(stored.select("label", "dim", "at", "block"), ["label", "dim", "at"])
    found = persist(met.groupBy("label", "dim", "tile_a", "tile_b").applyInPandas(compare, "rep long, to long, n long"), "embedding-links")
    discard(stored, tiles)
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = connected_components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")), "embedding-components")
    named = distinct.select("label", "digest", "id", "times", "rep").join(counts, "rep", "left").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    named = persist(named.select("label", "digest", "id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")), "embedding-named")
    lowest = persist(named.groupBy("root").agg(F.min("id").alias("component_id")), "embedding-lowest")
    # Written, so that a join on a vector with many copies can be split.
    named = persist(named.join(lowest, "root").select("label", "digest", "n_links", "component_id"), "embedding-results")
    linked = rows.where("digest is not null").select("id", "label", "digest").join(named, ["label", "digest"]).select("id", "n_links", "component_id")
    alone = rows.where("digest is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component_id").cast("long").alias("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of the whole ``embeddings`` table at cosine 0.93."""
    return embedding_groups(table(spark, sf_dir, "embeddings"))

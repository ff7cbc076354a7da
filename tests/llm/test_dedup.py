"""SimHash and embedding near-duplicates against brute force, and their edge cases."""

import itertools
import random

import numpy as np
import pytest
import xxhash

from contactloom.llm import simhash
from contactloom.llm.embedding_dedup import cover_tree, embedding_groups, links_between, make_block, spanning_roots
from contactloom.llm.graph import connected_components


def brute_fingerprint(text):
    words = []
    for c in (text or "").encode().split():
        words.append(bytes(b + 32 if 65 <= b <= 90 else b for b in c))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {n: find(n) for n in nodes}


TEXTS = [None, "", " \t", "One", "Ünïcode Ä B c d e", "a b c d", "a b c d " * 300, "x\x0by\x0cz\rw v", "no break space", "A B C D"]


def test_fingerprint():
    for t in TEXTS + ["w%d " % k * 3 for k in range(50)]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_spark_hash_is_the_same(spark):
    r = spark.sql("select xxhash64('a b c d') h").first()["h"]
    assert r % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_key_masks_lose_no_pair():
    rng = random.Random(5)
    assert [simhash.key_bits(4, *rung) for rung in simhash.ladder(4)] == sorted(simhash.key_bits(4, *rung) for rung in simhash.ladder(4))
    for chain, parts in simhash.ladder(4):
        masks = simhash.key_masks(4, chain, parts)
        for _ in range(3000):
            diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
            hits = [(i, m) for i, m in masks if diff & m == 0]
            chains = simhash.chain_masks(4)
            assert any(all((diff & c).bit_count() <= n for n, c in enumerate(chains[i])) for i, _ in hits)


def fingerprints(rng, n):
    base = [rng.getrandbits(64) for _ in range(n)]
    out = set(base)
    for b in base:
        x = b
        for _ in range(3):
            for k in rng.sample(range(64), rng.choice([1, 4, 5])):
                x ^= 1 << k
            out.add(x)
    return [v - (1 << 64) if v >> 63 else v for v in out]


@pytest.mark.parametrize("small,block,bits", [(64, 2048, 4), (3, 16, 4), (4, 24, 2), (64, 2048, 0)])
def test_links_span_brute_components(spark, monkeypatch, small, block, bits):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(small)
    fps = fingerprints(rng, 40) + [k << 2 for k in range(40)]
    fps = sorted(set(fps))
    found = {r["fp"]: r["root"] for r in simhash.fingerprint_components(spark.createDataFrame([(f,) for f in fps], "fp long"), bits).collect()}
    want = brute_components(fps, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= bits)
    assert {f: found.get(f, f) for f in fps} == want


def test_forests_keep_to_their_chain():
    rng = random.Random(3)
    fps = np.array(sorted(set(fingerprints(rng, 30))), dtype=np.int64)
    linked = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
    chains = simhash.chain_masks(4)
    for start in range(5):
        held = lambda a, b: linked(a, b) and all(((a ^ b) & c).bit_count() <= n * 4 // 5 for n, c in enumerate(chains[start], 1))  # noqa: B023, E731
        edges = simhash.block_forest(fps, None, 4, start)
        assert all(held(a, b) for a, b in edges)
        want = brute_components(fps.tolist(), held)
        assert len(edges) == len(want) - len(set(want.values()))


def test_simhash_groups(spark):
    rows = [(9, "q r s t u v"), (3, "q r s t u v"), (5, None), (6, ""), (None, "q r s t u v"), (None, "lonely words with no friend at all"), (3, "q r s t u v")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, fingerprint string, component_id int, FP int")
    got = sorted(((r["doc_id"], r["component_id"], r["fingerprint"]) for r in simhash.simhash_groups(docs).collect()), key=str)
    hexed = {t: f"{simhash.fingerprint(t):016x}" for _, t in rows}
    want = sorted([(9, 3, hexed[rows[0][1]]), (3, 3, hexed[rows[0][1]]), (3, 3, hexed[rows[0][1]]), (None, 3, hexed[rows[0][1]]), (5, 5, "0" * 16), (6, 5, "0" * 16), (None, None, hexed[rows[5][1]])], key=str)
    assert got == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == [3, 5, None]
    assert simhash.simhash_groups(docs.limit(0)).count() == 0 and simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_blocks_that_cannot_meet_are_apart(spark, monkeypatch):
    from contactloom.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "BLOCK", 10)
    rng = np.random.default_rng(9)
    x = np.repeat(np.eye(16)[:8], 40, axis=0) + rng.normal(scale=0.01, size=(320, 16))
    df = spark.createDataFrame([(k, v.tolist(), 1, f"{k:x}") for k, v in enumerate(x)], "rep long, vector array<float>, label int, digest string").selectExpr("label", "16 dim", "rep", "digest", "vector", "1L times")
    stored = embedding_dedup.stored_blocks(df, 0.93)
    blocks = stored.count()
    met = [(r["at"], p) for r in embedding_dedup.near_tiles(stored, 0.93).collect() for p in r["partners"]]
    assert blocks >= 32 and len(met) == len(set(met)) < blocks * (blocks + 1) / 4


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 102), (101, 102), (7, 7), (7, 8), (8, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 16))
    near = np.repeat(base[:12], 6, axis=0) + rng.normal(scale=0.09, size=(72, 16))
    return np.concatenate([base, near, near[:5] * 3]).astype(np.float32).astype(float)


def test_cover_tree_invariants():
    x = vectors()
    unit = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    far = np.linalg.norm(unit[:, None] - unit[None], axis=2)
    levels = cover_tree(unit, 0.1)
    assert len(levels) == 6 and len(levels[-1].centre) == len(x) and levels[-1].radius.max() == 0
    inner = levels[:-1]
    for k, level in enumerate(inner):
        assert set(inner[max(0, k - 1)].centre) <= set(level.centre)  # nesting
        between = far[np.ix_(level.centre, level.centre)] + 9 * np.eye(len(level.centre))
        assert between.min() > 2 / 2**k - 1e-3  # separation
        assert far[:, level.centre].min(axis=1).max() <= 2 / 2**k + 1e-3  # covering
    owner = np.arange(len(x))
    for below, level in zip(levels[:0:-1], levels[-2::-1], strict=True):
        owner = below.parent[owner]
        gap = far[np.arange(len(x)), level.centre[owner]]
        assert (gap <= level.radius[owner] + 1e-3).all()  # each node covers all below it


def block_of(x):
    return make_block(np.arange(len(x)), np.ones(len(x), int), x, 0.93)


@pytest.mark.parametrize("scale", [1.0, 1e-200, 1e200])
def test_links_between(scale):
    x = vectors()
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    want = {(i, j) for i, j in itertools.combinations(range(len(x)), 2) if cos[i, j] >= 0.93}
    a, b, c = block_of(x * scale), block_of(x[:50] * scale), block_of(x[50:] * scale)
    i, j = links_between(a, a, 0.93)
    assert {tuple(sorted(p)) for p in zip(a.rep[i], a.rep[j], strict=True)} == want and len(want) > 50
    i, j = links_between(b, c, 0.93)
    assert set(zip(b.rep[i], c.rep[j] + 50, strict=True)) == {(a, b) for a, b in want if a < 50 <= b}
    assert spanning_roots(4, np.array([3, 1]), np.array([1, 2])).tolist() == [0, 1, 1, 1]


@pytest.mark.parametrize("block,pivots", [(2048, 256), (16, 256), (7, 1)])
def test_embedding_groups(spark, monkeypatch, block, pivots):
    from contactloom.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "LABEL_PIVOTS", pivots)
    x = vectors()
    rows = [(k, v.tolist(), k % 2) for k, v in enumerate(x)] + [(500 + k, x[k].tolist(), k % 2) for k in range(6)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [1.0, None], 0), (903, [float("nan")], 0), (904, [float("inf")], 0), (905, x[0].tolist(), None), (906, [], 0), (907, x[0].tolist()[:8], 0)]
    df = spark.createDataFrame([(*r, 0, "z") for r in rows + odd], "vec_id long, embedding array<float>, label int, n_links int, vector string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_groups(df).collect()}
    data = {k: (np.array(v), lab) for k, v, lab in rows}
    linked = lambda a, b: data[a][1] == data[b][1] and float(data[a][0] @ data[b][0] / (np.linalg.norm(data[a][0]) * np.linalg.norm(data[b][0]))) >= 0.93
    roots = brute_components(sorted(data), linked)
    want = {a: (sum(linked(a, b) for b in data if b != a), roots[a], roots[a] == a) for a in data}
    assert got == want | {k: (0, k, True) for k, *_ in odd}
    assert embedding_groups(df.limit(0)).count() == 0


def test_green_table_with_links(spark, tmp_path):
    """The query and its SQL on a table that has links, which the given ones lack: near copies at
    several distances around the threshold, exact copies, chains and labels that keep copies apart."""
    import duckdb

    from contactloom.llm.queries import ORACLE_SQL, QUERIES

    source = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(300).toPandas()
    rng, rows = np.random.default_rng(4), []
    for k, (v, label) in enumerate(zip(source["embedding"], source["label"], strict=True)):
        v = np.array(v, dtype=np.float32)
        rows.append((10 * k, v.tolist(), label))
        for n, scale in enumerate(rng.choice([0.0, 0.2, 0.35, 0.4, 0.6], size=k % 4)):
            v = v + rng.normal(size=len(v)).astype(np.float32) * np.float32(scale * np.linalg.norm(v) / 8)
            rows.append((10 * k + n + 1, v.tolist(), label if n < 2 else None if k % 2 else label))
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(3).write.parquet(path)
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{path}/*.parquet'")
    want = db.sql(ORACLE_SQL["op8_embedding_dedup"])
    columns = want.columns
    want = sorted(want.fetchall())
    got = sorted(map(tuple, QUERIES["op8_embedding_dedup"](spark, str(tmp_path)).select(*columns).collect()))
    assert got == want and sum(r[columns.index("n_links")] > 0 for r in got) > 100

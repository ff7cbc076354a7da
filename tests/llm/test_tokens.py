"""Tokenizing operators against the library, and packing against its invariants."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from contactloom.llm import packing, token_counts
from contactloom.llm.bpe import encode_documents, load

BYTES, WORDS, PIECES = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
TEXTS = ["", "Hello  world's\n\n it'LL  do", "naïve Größe – “quotes”", "日本語 😀 ‍ é", "<|endoftext|> and <|startoftext|>x", "a" * 3000, "\x1c\x85  　", "İstanbul ΣΑΣ ﬁ", " ", "퟿"]


def fuzz(n):
    rng = random.Random(2)
    pool = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x3000, 0x1F600, 0x300, 0x4E2D]] + ["<|endoftext|>", "'s", "  ", "\n\n"]
    return ["".join(rng.choice(pool) if rng.random() < 0.5 else rng.choice("ab 1'\n.") for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_bpe_is_the_library():
    library, own, quick = Tokenizer.from_file(BYTES), load(BYTES), packing.token_ids(BYTES)
    for t in TEXTS + fuzz(1500):
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids == quick(t)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert own.decode([own.start[0xE4]]) == library.decode([own.start[0xE4]], skip_special_tokens=False) == "�"


def test_encode_documents(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, "x y", 6), (None, "<|endoftext|>", 7)], "doc_id long, text string, n_tokens int")
    got = {(r["doc_id"], r["decoded"]): (r["n_tokens"], list(r["ids"])) for r in encode_documents(docs, BYTES).collect()}
    assert got == {(1, ""): (0, []), (1, "x y"): (2, [87, 331]), (None, "<|endoftext|>"): (1, [50256])}
    assert encode_documents(docs.limit(0), BYTES).count() == 0


@pytest.mark.parametrize(("kind", "ids"), [("long", [(1 << 53) + 1, None, -(1 << 63), (1 << 63) - 1]), ("string", ["9007199254740993", None, ""]), ("int", [7, None])])
def test_ids_come_back_as_they_were(spark, kind, ids):
    docs = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], f"doc_id {kind}, text string").coalesce(1)
    for made in (encode_documents(docs, BYTES, keep=False), packing.pack(docs, BYTES, keep_ids=False), packing.pack(docs, BYTES, capacity=2)):
        assert made.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        assert {r["doc_id"] for r in made.collect()} == set(ids)


def test_counts_are_the_library():
    library, own = Tokenizer.from_file(WORDS), token_counts.counter(WORDS)
    for t in TEXTS + fuzz(1500):
        assert own(t) == len(library.encode(t, add_special_tokens=False))
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert [token_counts.counter(PIECES)(t) for t in TEXTS[:5]] == [len(model.encode(t)) for t in TEXTS[:5]]


@pytest.mark.parametrize("few", [10_000, 0])
def test_digest_cache(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(token_counts, "FEW_MISSES", few)
    path = f"file://{tmp_path}/cache"
    docs = spark.createDataFrame([(1, "a b", 0), (2, "a b", 0), (None, "a b", 0), (3, None, 0), (3, "", 0), (4, "c " * 3000, 0)], "doc_id long, text string, content int")
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs, WORDS, path).collect()), key=str)
    assert got == sorted([(1, 3, 2, False), (2, 3, 2, False), (None, 3, 2, False), (3, 0, 0, False), (3, 0, 0, False), (4, 6000, 3000, True)], key=str)
    first = token_counts.read_cache(spark, path)
    assert first.count() == first.select("content").distinct().count() == 3
    token_counts.count_tokens(docs.union(spark.createDataFrame([(9, "new", 0)], docs.schema)), WORDS, path).collect()
    assert token_counts.read_cache(spark, path).count() == 4  # only the miss was added
    token_counts.count_tokens(docs, PIECES, path).collect()
    assert token_counts.read_cache(spark, path).select("tokenizer").distinct().count() == 2
    assert token_counts.count_tokens(docs.limit(0), WORDS, path).count() == 0


def test_equal_digests_have_equal_counts(spark):
    library = Tokenizer.from_file(WORDS)
    texts = ["Hello  World's\n END", "hello world's end ", "\thello world's end", "hello world 's end", "<|startoftext|>x", "<|STARTOFTEXT|>x", "<|StartOfText|>x", "Größe ŠX", "größe  šx", "Σas ΣΑΣ", "σας σας", "a\x0bb", "a b", "A\u2028b", "İx", "ix", "e\u0301", "\u00e9", "a\u00a0b", "don 't", "don't"]
    texts += [f(t) for t in fuzz(400) for f in (str, str.lower, str.upper, lambda x: x.replace(" ", "  \n"))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    by: dict[str, set] = {}
    for r in rows.select("text", token_counts.content_digest(rows["text"], token_counts.counter(WORDS)).alias("d")).collect():
        by.setdefault(r["d"], set()).add(r["text"])
    for same in by.values():
        assert len({len(library.encode(t, add_special_tokens=False)) for t in same}) == 1
    assert any({*texts[:3]} <= same for same in by.values()) and len(by) < len(set(texts)) - 20
    plain = rows.select(token_counts.content_digest(rows["text"], token_counts.counter(PIECES)).alias("d"))
    assert plain.distinct().count() == len(set(texts))


def test_second_run_of_the_query_encodes_nothing(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    spark.conf.set("contactloom.token.cache", f"file://{tmp_path}/cache")
    try:
        first = sorted(map(tuple, token_counts.op5_token_counts(spark, data).collect()))
        size = token_counts.read_cache(spark, f"file://{tmp_path}/cache").count()
        assert sorted(map(tuple, token_counts.op5_token_counts(spark, data).collect())) == first
        assert token_counts.read_cache(spark, f"file://{tmp_path}/cache").count() == size > 0
    finally:
        spark.conf.unset("contactloom.token.cache")


def test_fullest_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        counts = {n: rng.randint(1, 3) for n in rng.sample(range(1, 40), rng.randint(1, 5))}
        best = {0}
        for n, c in counts.items():
            best = {s + n * k for s in best for k in range(c + 1) if s + n * k <= 40}
        if max(best) == 0:
            continue
        made = packing.fullest(sorted(counts, reverse=True), counts, 40)
        assert sum(n * k for n, k in made) == max(best) and all(0 < k <= counts[n] for n, k in made)


def test_plan_uses_every_piece():
    rng = random.Random(6)
    histogram = {n: rng.randint(1, 50) for n in rng.sample(range(1, 65), 40)}
    plan = packing.minimum_bin_slack(histogram, 64)
    used = {}
    for bins, combination in plan:
        assert sum(n * k for n, k in combination) <= 64
        for n, k in combination:
            used[n] = used.get(n, 0) + bins * k
    assert used == histogram
    bins: list[int] = []  # best fit, longest first
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        fits = [k for k, room in enumerate(bins) if room >= n]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= n
        else:
            bins.append(64 - n)
    assert sum(b for b, _ in plan) <= len(bins) + 2


@pytest.mark.parametrize("keep", [True, False])
def test_pack(spark, keep):
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice(["the", "zebra", "x1", "größe"]) for _ in range(rng.randint(0, 120)))) for k in range(60)] + [(60, None), (60, ""), (None, "a b c"), (61, "word " * 500)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int").repartition(5)
    got = packing.pack(docs, BYTES, capacity=64, keep_ids=keep).collect()
    library = Tokenizer.from_file(BYTES)
    whole = sorted([*library.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows)
    by_seq = {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(map(len, whole))
    assert len(by_seq) <= -(-total // 64) + 2
    if keep:
        docs_back = {}
        for r in got:
            assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        for r in sorted((r for r in got if r["doc_id"] not in (60, None)), key=lambda r: (r["doc_id"], r["piece"])):
            ids = docs_back.setdefault(r["doc_id"], [])
            assert r["start"] == len(ids) and (r["piece"] == 0 or r["length"] == 64)
            ids += r["ids"]
        assert sorted(docs_back.values()) == sorted([*library.encode(t or "", add_special_tokens=False).ids, 0] for k, t in rows if k not in (60, None))
    assert packing.pack(docs.limit(0), BYTES).count() == 0

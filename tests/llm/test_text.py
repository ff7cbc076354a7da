"""Chat formatting, classifiers, quality rules and HTML extraction."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contactloom.llm import chat_format as chat
from contactloom.llm import html_extract as web
from contactloom.llm import language_id as lang
from contactloom.llm import quality_classifier as fm
from contactloom.llm import quality_rules as rules

DATA = "/root/testdata/sf0.01"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a\nb", "<|text|>"]), st.text(alphabet="<|>\\[]/INSTendtur s\n", max_size=40) | st.sampled_from(chat.CONTROL) | st.text(max_size=20)), max_size=5))
def test_template_round_trip(turns):
    text, spans = chat.render(turns)
    assert chat.read_back(text) == turns
    assert [chat.unescape(text[a : a + n]) for a, n in spans] == [t for r, t in turns if r == "assistant"]
    for _, said in turns:
        assert not any(c in chat.escape(said) for c in chat.CONTROL)


def tree_rows():
    # 1 -> 2 -> (3, 4 -> 5), and a second root 9; tree "b" is one long chain.
    a = [("a", 1, None, "user", "q", 1.0), ("a", 2, 1, "assistant", "r", 1.0), ("a", 3, 2, "user", "low", 0.0), ("a", 4, 2, "user", "high", 3.0), ("a", 5, 4, "assistant", None, None), ("a", 9, None, None, "alone", 0.5)]
    return a + [("b", k, k - 1 if k else None, "user", f"t{k}", 1.0) for k in range(21)] + [(None, 1, 77, "assistant", "orphan", 1.0)]


def test_reply_trees(spark):
    messages = spark.createDataFrame(tree_rows(), "tree string, node long, parent long, role string, text string, score double")
    got = {(r["tree"], r["leaf"]): chat.read_back(r["formatted"]) for r in chat.format_trees(messages).collect()}
    assert got[("a", 3)] == [("user", "q"), ("assistant", "r"), ("user", "low")]
    assert got[("a", 5)] == [("user", "q"), ("assistant", "r"), ("user", "high"), ("assistant", "")]
    assert got[("a", 9)] == [("", "alone")] and got[(None, 1)] == [("assistant", "orphan")]
    assert [t for _, t in got[("b", 20)]] == [f"t{k}" for k in range(21)] and len(got) == 5
    best = {(r["tree"], r["leaf"]): r["rank"] for r in chat.format_trees(messages, branches=1).collect()}
    assert best == {("a", 5): 1, ("b", 20): 1, (None, 1): 1}
    assert {(r["tree"], r["leaf"]): r["rank"] for r in chat.format_trees(messages).collect()} == best | {("a", 3): 2, ("a", 9): 3}
    assert chat.format_trees(messages.limit(0)).count() == 0


def test_cycles_and_repeated_nodes(spark):
    rows = [("c", 1, 3, "user", "a", 1.0), ("c", 2, 1, "user", "b", 1.0), ("c", 3, 2, "user", "c", 1.0), ("c", 4, 3, "user", "below", 1.0), ("c", 5, 5, "user", "self", 1.0)]
    rows += [("d", k, k - 1 if k else None, "user", f"t{k}", 1.0) for k in range(300)] + [("d", 7, 6, "user", "t7", 1.0), ("d", 8, 299, "zzz", "later row of 8", 9.0)]
    messages = spark.createDataFrame([(*r, "x") for r in rows], "tree string, node long, parent long, role string, text string, score double, leaf string")
    got = chat.format_trees(messages).collect()
    assert [(r["tree"], r["leaf"], r["rank"]) for r in got] == [("d", 299, 1)]
    assert [t for _, t in chat.read_back(got[0]["formatted"])] == [f"t{k}" for k in range(300)]


def test_threads(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (None, 0, "user", "<|end|>\n")]
    c = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, node int")
    got = {r["conv_id"]: r for r in chat.read_formatted(chat.format_trees(chat.threads(c))).collect()}
    turns = {1: [("user", "a"), ("assistant", "b"), ("assistant", "b")], 2: [("", "")], None: [("user", "<|end|>\n")]}
    for k, want in turns.items():
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()
        assert got[k]["n_turns"] == len(want) and got[k]["formatted_chars"] == len(chat.render(want)[0])
    assert got[1]["loss_chars"] == 2 and got[1]["loss_sha256"] == hashlib.sha256(b"bb").hexdigest() and got[2]["loss_chars"] == 0


# Quality rules


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


CASES = [None, "", "  \n\t", "one two", "a b c d e", "a b c d e a b c d e", "x " * 40, "l1\nl1\n\nl1\r\nl2\n \n", "# é *\x0b|a <b>", "w%d " * 3 % (1, 2, 3) + "a b c d e f a b c d e g"]


def test_rule_columns(spark):
    docs = spark.createDataFrame([(k, t, 1, "y") for k, t in enumerate(CASES)], "doc_id long, text string, n_words int, KEPT string")
    labels = spark.createDataFrame([(5, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in rules.quality_rules(docs, labels).collect()}
    for k, t in enumerate(CASES):
        r, want = got[k], brute_rules(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    kept = rules.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert rules.quality_rules(docs.limit(0), labels.limit(0)).count() == 0


def test_likelihood_ratio_against_brute_force(spark):
    import math

    import xxhash

    texts = ["good words here", "good words again and again", "bad bad junk", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trusted = rules.trusted_ids(spark.createDataFrame([(0, 1), (1, 1), (1, 1), (2, 0), (None, 1), (77, 1)], "doc_id long, quality int"))
    weights = rules.ratio_weights(*rules.bucket_counts(docs, trusted, "doc_id", "text", 64))

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def grams(t):
        w = (t or "").split()
        one = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in w]
        two = [signed(xxhash.xxh64_intdigest(b.encode(), one[k] % (1 << 64))) for k, b in enumerate(w[1:])]
        return [h % 64 for h in one + two]

    raw, good = np.ones(64), np.zeros(64)
    for k, t in enumerate(texts):
        for b in grams(t):
            raw[b] += 1
            good[b] += k < 2
    want = [math.log((g + rules.PRIOR * r / raw.sum()) / (good.sum() + rules.PRIOR)) - math.log(r / raw.sum()) for g, r in zip(good, raw, strict=True)]
    assert np.allclose(weights, want)
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", rules.mean_weight(rules.words_of(docs["text"]), weights).alias("s")).collect()}
    for k, t in enumerate(texts):
        g = grams(t)
        assert got[k] == pytest.approx(sum(want[b] for b in g) / len(g) if g else 0.0)


def test_threshold_is_that_of_trusted_documents_without_their_fold(spark):
    import random

    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randint(4, 30))) for _ in range(60)] + ["q%d r s" % k * 5 for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(0, 60, 2)], "doc_id long, quality int")
    trusted = rules.trusted_ids(labels)
    raw, good = rules.bucket_counts(docs, trusted, "doc_id", "text", 64)
    lowest = 9.0
    for k in range(0, 60, 2):
        if len(texts[k].split()) >= 10:
            fold = zlib.crc32(str(k).encode()) % rules.FOLDS
            weights = rules.ratio_weights(raw, [g for f, g in enumerate(good) if f != fold])
            lowest = min(lowest, docs.where(f"doc_id = {k}").select(rules.mean_weight(rules.words_of(docs["text"]), weights).alias("s")).first()["s"])
    got = rules.held_out_threshold(docs, trusted, "doc_id", "text", raw, good)
    assert got == pytest.approx(np.floor(lowest * 1000) / 1000 - rules.MARGIN)
    assert rules.learn(docs, labels.limit(0), "doc_id", "text")[1] == -rules.MARGIN and rules.learn(docs, labels, "doc_id", "text", 64, -3.0)[1] == -3.0


@pytest.mark.parametrize("words", [rules.BIT_WORDS, 1])  # one word of hash bits: every id has to be joined
def test_every_trusted_document_counts(spark, monkeypatch, words):
    monkeypatch.setattr(rules, "BIT_WORDS", words)
    n, outside, odd = 21_000, 1_000, 40
    ids = spark.range(n).orderBy(F.xxhash64("id").desc()).limit(odd).select(F.col("id").alias("odd_id"))
    texts = F.when(F.col("odd_id").isNull(), F.lit("a b c d e f g h i j")).otherwise(F.lit("q r s t u v w x y z"))
    docs = spark.range(n + outside).join(F.broadcast(ids), F.col("id") == F.col("odd_id"), "left").select(F.col("id").alias("doc_id"), texts.alias("text"))
    labels = spark.range(n).select(F.col("id").cast("int").alias("doc_id"), F.lit(1).alias("quality"))
    trusted = rules.trusted_ids(labels.select(F.col("doc_id").cast("long"), "quality"))
    raw, good = rules.bucket_counts(docs, trusted, "doc_id", "text")
    assert sum(map(sum, good)) == 19 * n and sum(raw) == 19 * (n + outside) + len(raw)
    weights, threshold = rules.learn(docs, labels, "doc_id", "text")
    assert weights == rules.ratio_weights(raw, good)
    judged = docs.select("text", rules.mean_weight(rules.words_of(docs["text"]), weights).alias("s")).distinct().collect()
    assert len(judged) == 2 and all(r["s"] >= threshold for r in judged)  # more than SPARED are odd, so they set it


def test_rules_keep_clean_documents(spark):
    df = rules.op6_quality_rules(spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = df.join(labels, "doc_id").where("not base_failed").select("quality", "kept").collect()
    clean = [r["kept"] for r in rows if r["quality"] == 1]
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.2
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("size", "most"), [("0.001", 0.5), ("0.01", 0.2)])
def test_rules_reject_labelled_junk_and_spare_held_out_clean_documents(spark, size, most):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf{size}/{t}.parquet") for t in ("documents", "labels"))
    judged = rules.quality_rules(docs, labels.where("doc_id % 5 <> 0")).join(labels, "doc_id").where("not base_failed")
    rows = judged.select("doc_id", "quality", "kept").collect()
    assert np.mean([r["kept"] for r in rows if r["quality"] == 0]) < most
    assert all(r["kept"] for r in rows if r["quality"] == 1)


# Classifiers


def test_machine_is_linear_time_pairwise():
    m = fm.fit([], np.zeros(0))
    index, value, stats = np.array([3, 9]), np.array([0.6, 0.8]), np.zeros(fm.STATS)
    x = np.zeros(fm.BUCKETS + fm.STATS)
    x[index], x[fm.BUCKETS :] = value, m.dense(stats)
    at = np.nonzero(x)[0]
    pairs = sum(m.v[i] @ m.v[j] * x[i] * x[j] for k, i in enumerate(at) for j in at[k + 1 :])
    assert m.score(index, value, stats) == pytest.approx(1 / (1 + np.exp(-(m.w0 + m.w @ x + pairs))))


def test_quality_held_out(spark):
    got = fm.op4_quality_classifier(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.85
    assert all(got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]])


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (None, "some text", 0.0), (2, "x" * 100_000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = fm.score_quality(docs, fm.train_machine(docs, labels)).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got) and {r["held_out"] for r in got if r["doc_id"] is None} == {True}
    assert fm.score_quality(docs.limit(0), fm.fit([], np.zeros(0))).count() == 0


def test_repeated_ids_stay_within_the_samples(spark):
    docs = spark.createDataFrame([(1, f"some words here {k}", "en") for k in range(500)] + [(2, "autres mots", "fr"), (None, "x y", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 0), (3, 1)], "doc_id long, quality int")
    assert [(r["id"], r["label"]) for _, r in fm.training_rows(docs, labels, "doc_id", "text").iterrows()] == [(1, 1), (2, 0)]
    assert list(lang.training_windows(docs, "doc_id", "text", "lang")["lang"]) == ["en", "fr"]


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(lang, "MOST_LANGS", 2)
    docs = spark.createDataFrame([(k + 1, "text", f"l{k % 3}") for k in range(20)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 2 languages"):
        lang.train_model(docs)


def test_language_held_out(spark):
    got = lang.op7_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.95


def test_language_edges(spark):
    docs = spark.createDataFrame([(k, t, "en" if k % 2 else "de", 1) for k, t in enumerate(["das ist gut und schön", "this is good and fine"] * 30)] + [(90, None, None, 1), (91, "123 !?", None, 1), (92, "", None, 1), (None, "this is fine " * 9000, None, 1)], "doc_id long, text string, lang string, SCORE int")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lang.identify_languages(docs).collect()}
    assert got[90] == got[91] == got[92] == ("und", 0.0) and got[None][0] == "en" and got[0][0] == "de" and got[1][0] == "en"
    none = docs.where("lang is null")
    assert {r["lang_pred"] for r in lang.identify_languages(none).collect()} == {"und"} and lang.identify_languages(docs.limit(0)).count() == 0
    kept = lang.keep_identified(docs)
    assert kept.columns == docs.columns and {90, 91, 92}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_pair_tables_equal_the_network():
    rng = np.random.default_rng(0)
    windows = rng.integers(1, 255, (20, lang.WINDOW)).astype(np.uint8)
    model = lang.train(windows, np.arange(20) % 2, ["a", "b"], epochs=1)
    x = model.class_of[windows].astype(int)
    pooled = []
    for w in lang.WIDTHS:
        act = model.bias[w] + sum(model.conv[w][o][x[:, o : o + lang.WINDOW - w + 1]] for o in range(w))
        pooled.append(np.maximum(0, act.max(axis=1)))
    logits = np.concatenate(pooled, axis=1) @ model.out + model.out_bias
    want = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    assert np.allclose(lang.Scorer(model).log_probs(windows), want, atol=1e-4)


# HTML


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header>Top</header><nav><ul><li><a href=/>Home</a></ul></nav>"
    "<div class='cookie-notice'>We use cookies</div><article><h1>A &amp; B&nbsp;C &amp</h1><p><b>one\n two<br>three<p>four <i>five</i></b></p><div class=ad>Buy</div><form><p>x</form>"
    "<ul><li>l1<li>l2</ul><section class=comments><article class=comment>Nice</article></section><!-- c --></article><aside>Side</aside><footer>&copy;"
)


def test_declared_article():
    assert web.main_blocks(web.parse(PAGE), frozenset()) == ["A & B C &", "one two three", "four five", "l1", "l2"]
    for cut in range(0, len(PAGE), 7):
        web.main_blocks(web.parse(PAGE[:cut]), frozenset())


def test_style_tree_removes_what_a_host_repeats(spark):
    body = "<html><body><div class=w1>Terms of this shop, all rights</div><div class=w2><p>{0} alpha</p><p>{0} beta</p></div></body></html>"
    rows = [(k, "http://S.example.org/%d" % k, body.format(f"story {k}"), "z") for k in range(6)]
    rows += [(10, "http://other.example.org/", body.format("single"), "z"), (11, None, None, "z"), (12, "x", "", "z"), (None, "http://s.example.org/", "<p>tail", "z"), (0, "http://S.example.org/0", body.format("story 0"), "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in web.extract_main_text(pages).collect()]
    texts = {(i, t) for i, t, _ in got}
    assert {(k, f"story {k} alpha\n\nstory {k} beta") for k in range(6)} <= texts and (10, "Terms of this shop, all rights\n\nsingle alpha\n\nsingle beta") in texts
    assert (11, "") in texts and (12, "") in texts and (None, "tail") in texts and len(got) == 11 and all(n == len(t) for _, t, n in got)
    assert web.extract_main_text(pages.limit(0)).count() == 0


def test_articles_are_whole(spark):
    """Each page's article as a plain pattern sees it: the generator writes h1 and p blocks only."""
    import html

    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = re.split(r"</?(?:h1|p)>", inner.replace("<br>", " "))
        want = [x for b in blocks if (x := " ".join(html.unescape(re.sub(r"</?b>", "", b)).split()))]
        assert web.main_blocks(web.parse(r["html"]), frozenset()) == want


def test_what_a_host_repeats_inside_articles_goes(spark):
    """Also under a class that no list names; articles that a host repeats, unique parts and plain words stay."""
    body = "<body><nav>n{0}</nav><article><h1>Title {0}</h1><p>story <b>{0}</b> alpha</p><div class=kicker7>Read us <i>daily</i> at home<p class=own>part {0}</p></div><p>end {0}</p></article></body>"
    rows = [(k, f"http://a.example/{k}", body.format(k)) for k in range(5)]
    rows += [(10 + k, f"http://b.example/{k}", body.format("same")) for k in range(5)]
    rows += [(20, "http://c.example/", body.format("single"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n\n") for r in web.extract_main_text(pages).collect()}
    whole = lambda k: [f"Title {k}", f"story {k} alpha", "Read us daily at home", f"part {k}", f"end {k}"]
    for k in range(5):
        assert got[k] == [x for x in whole(k) if not x.startswith("Read")]
        assert got[10 + k] == whole("same")
    assert got[20] == whole("single")


def test_wrappers_of_the_main_text_open():
    def blocks(body):
        return web.main_blocks(web.parse(f"<body><nav>Menu</nav>{body}<div class=sidebar><article>Teaser</article></div><footer>F</footer></body>"), frozenset())

    for name in ("content-sidebar-wrap", "has-sidebar", "no-sidebar", "social-science", "notice-board"):
        assert blocks(f"<div class={name}><main><article><p>Text</p></article></main></div>") == ["Text"]
        assert blocks(f"<div id={name}><article><p>Text</p></article></div>") == ["Text"]
        assert blocks(f"<main><div class={name}><article><p>A</p></article></div><article>B</article></main>") == ["A", "B"]
    assert blocks("<div class=share><main>Text</main></div>") == ["Text"]
    assert blocks("<main><h1>Head</h1><p>lead</p><article>Text<div class=ad>Buy</div></article><div class=related><article>Other</article></div></main>") == ["Head", "lead", "Text"]
    lone = "<body><div class='layout sidebar'><article>Text</article></div><div class=comments><article>Nice</article></div></body>"
    assert web.main_blocks(web.parse(lone), frozenset()) == ["Text"]


def test_parsing_takes_linear_time():
    import time

    start = time.monotonic()
    for text in ("<div>" * 20_000 + "</x>" * 20_000, "<b>" * 20_000 + "<p>" * 20_000, "<li>" * 20_000 + "</ul>" * 20_000, "<ul><li>" * 10_000 + "</p>" * 10_000):
        web.main_blocks(web.parse(text), frozenset())
    assert time.monotonic() - start < 20


def test_open_elements_against_a_walk_of_the_stack():
    import random

    def outline(text):
        """Depth of each element, by walking the whole stack at each tag."""
        stack, out = [], []
        for shut, tag in re.findall(r"<(/?)([a-z]+)>", text):
            if shut:
                if tag in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(tag) :]
                continue
            gone, scope = web.CLOSES.get(tag, ((), ()))
            k = len(stack)
            while gone and k and (stack[k - 1] in gone or stack[k - 1] not in {*scope, *web.BLOCKS}):
                k -= 1
                if stack[k] in gone:
                    del stack[k:]
            out.append((len(stack), tag))
            stack.append(tag)
        return out

    def depths(node, depth=0):
        return [x for c in node.children for x in ([(depth, c.tag), *depths(c, depth + 1)])]

    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice(["<{}>", "<{}>", "</{}>"]).format(rng.choice("div p li ul td tr table b dd dl tbody".split())) for _ in range(40))
        assert depths(web.parse(text)) == outline(text)


def plain_site():
    """A host that declares nothing: a shop line and a menu on all pages, stories that differ, and a
    section whose look differs while its words are few."""
    page = "<body><div class=m1><a>Home</a><a>Shop</a></div><div class=w1>Terms of this shop</div><div class=w2><p>story {0}</p>{1}</div><div class=w3>{2}</div></body>"
    looks = ["<p>x{0}</p>", "<ul><li>x{0}</ul>", "<h2>x{0}</h2><p>y{0}</p>", ""]
    return [(k, f"http://plain.example/{k}", page.format(k, looks[k % 4].format(k), ["even", "odd"][k % 2])) for k in range(8)]


def test_importance_against_brute_force(spark):
    from collections import defaultdict
    from math import log

    rows = plain_site() + [(20 + k, f"http://art.example/{k}", f"<article><p class=a>own {k}</p><p class=b>Read us</p></article>") for k in range(5)] + [(30, "http://few.example", "<p>x"), (31, "http://few.example/2", "<p>x")]
    host = lambda url: url.split("/")[2]
    shows: dict = defaultdict(list)
    for _, url, text in rows:
        for path, kind, feature, article in web.style_features(web.parse(text)):
            shows[host(url), path].append((kind, feature, article))
    want = set()
    for key, seen in shows.items():
        looks, said = (Counter(f for kind, f, _ in seen if kind == k) for k in (0, 1))
        m = sum(looks.values())
        if m < web.LEAST_PAGES or not said:
            continue
        presentation = -sum(c / m * log(c / m, m) for c in looks.values())
        content = 1 - sum(c * log(c, m) for c in said.values()) / sum(said.values())
        if max(presentation, content) + (web.RAISE if any(a for *_, a in seen) else 0) < web.BOUND:
            want.add(key)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", web.host_of(web.quoted("url")))
    got = {(r["host"], r["path"]) for r in web.low_branches(pages).collect()}
    assert got == want and len(want) >= 3 and {h for h, _ in want} == {"plain.example", "art.example"}


def test_what_goes_without_the_tree(spark):
    """Ablation: with a bound of zero no branch goes, and pages of hosts that declare nothing keep
    what the host repeats."""
    pages = spark.createDataFrame(plain_site(), "page_id long, url string, html string")
    judged = {r["page_id"]: r["text"] for r in web.extract_main_text(pages).collect()}
    bare = {r["page_id"]: r["text"] for r in web.extract_main_text(pages, bound=0.0).collect()}
    for k in judged:
        assert "Terms of this shop" in bare[k] and "Home" in bare[k]
        assert "Terms" not in judged[k] and "Home" not in judged[k] and judged[k].startswith(f"story {k}")
    assert all(judged[k] != bare[k] for k in judged)

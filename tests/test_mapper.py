import random

import pytest
from pyspark.sql import functions as F

from contactloom import ContactMapper, NormalizationError, dedupe, profile_results
from contactloom.operators.dedupe import dedupe_single
from contactloom.operators.mapper import get_match


@pytest.fixture(scope="module")
def mapper():
    return ContactMapper()


def rows(results):
    return [(r["normalized"], r["unmapped"], r["matched"], r["unmatched"]) for r in results.collect()]


def test_column_names(spark, mapper):
    df = spark.createDataFrame([("a", "b", "c", "d")], "`E-Mail` string, `email_address` string, zq string, `email__2` string")
    out = mapper.map_columns(df)
    assert out.columns == ["email", "email__2", "zq", "email__3"]
    clash = spark.createDataFrame([("A@b.co", "x")], "`E-Mail` string, `email__2x` string")
    assert mapper.map_columns(clash, normalize=False).first()[0] == "A@b.co"
    with pytest.raises(ValueError):
        mapper.map_columns(df.select("zq", "zq"))


def test_strict_and_threshold(spark, mapper):
    df = spark.createDataFrame([("n/a",)], "phone string")
    with pytest.raises(NormalizationError):
        mapper.map_columns(df, strict=True)
    with pytest.raises(NormalizationError):
        mapper.map(df, strict=True)
    with pytest.raises(NormalizationError):
        mapper.compile_plan(["Compny"], confidence_threshold=0.99, strict=True)
    for bad in (-0.1, 1.1, True, "x"):
        with pytest.raises(ValueError):
            mapper.map(df, confidence_threshold=bad)


def test_merging(spark, mapper):
    df = spark.createDataFrame([("Ada", "Augusta", "alpha,beta", ["beta", "gamma"]), (" ", "Bob", None, None), (None, None, "x,x", [])], "fname string, first string, tags string, labels array<string>")
    got = [r["normalized"] for r in mapper.map(df).collect()]
    assert got[0] == {"first_name": ["Ada", "Augusta"], "tags": ["alpha", "beta", "gamma"]}
    assert got[1]["first_name"] == ["Bob"] and got[2]["first_name"] == [None] and got[2]["tags"] == ["x", "x"]


def test_types_and_depth(spark, mapper):
    df = spark.createDataFrame([(2025550143, True, ("A@b.co", ("Rome",)))], "phone long, verified boolean, contact struct<email:string,address:struct<city:string>>")
    n = mapper.map(df, depth=3).first()["normalized"]
    assert n == {"phone": ["2025550143"], "verified": ["true"], "email": ["a@b.co"], "city": ["Rome"]}
    assert mapper.map(df).first()["unmapped"].keys() == {"contact"} or mapper.map(df).first()["matched"] == 3


def test_shapes_warnings_and_matches(spark, mapper):
    df = spark.createDataFrame([("a@b.co", "1/2/2024"), ("junk", None)], "zq string, birthday string")
    a, b = mapper.map(df).orderBy(F.desc("matched")).collect()
    assert a["normalized"]["email"] == ["a@b.co"] and [w["category"] for w in a["warnings"]] == ["date_ambiguous"]
    assert b["unmapped"] == {"zq": "junk"} and b["match_rate"] == 0.5
    assert mapper.map(df).select(get_match("birthday")["canonical"]).first()[0] == "birthday"


def test_embedded_phones(spark, mapper):
    text = " ".join(f"202-555-01{k:02d}" for k in range(8))
    df = spark.createDataFrame([("202-555-0199", text, "x" * 9000), (None, "", None)], "phone string, notes string, zq string")
    a, b = mapper.map(df, extract_embedded_phones=True).collect()
    assert a["normalized"]["phone"] == ["+12025550199", *(f"+120255501{k:02d}" for k in range(5))]
    assert sorted(w["category"] for w in a["warnings"]) == ["embedded_phone_limit"] * 2 and b["normalized"]["phone"] == [None]
    assert sum(m["strategy"] == "embedded_phone" for m in a["field_matches"]) == 5


def test_embedded_phone_limits_of_a_row(spark, mapper):
    text = " ".join(f"202-555-0{k:03d}" for k in range(7))
    df = spark.createDataFrame([(text,) * 5, (text.replace("202", "303"),) * 3 + ("", None)], "zq1 string, zq2 string, zq3 string, zq4 string, zq5 string")
    a, b = mapper.map(df, extract_embedded_phones=True).collect()
    assert sum(m["strategy"] == "embedded_phone" for m in a["field_matches"]) == 20 and a["normalized"]["phone"] == [f"+12025550{k:03d}" for k in range(5)]
    said = [w["message"] for w in a["warnings"]]
    assert said == [f"'zq{k}': embedded phone extraction stopped after 5 matches for this field" for k in range(1, 5)] + ["embedded phone extraction stopped after 20 matches for this payload"]
    assert len(b["warnings"]) == 3


def test_threshold_text(spark, mapper):
    df = spark.createDataFrame([("x", "a@b.co")], "Compny string, zq string")
    said = [w["message"] for w in mapper.map(df, confidence_threshold=0.9).first()["warnings"]]
    assert said == ["'Compny': dropped low-confidence match to 'company' (confidence 0.85 < threshold 0.90)", "'zq': dropped low-confidence match to 'email' (confidence 0.60 < threshold 0.90)"]


def test_ragged_json(spark, mapper):
    df = spark.createDataFrame([('{"fname": "ada", "contact": {"email": "A@b.co"}, "n": 1}',), ('{"zq": null}',), ("broken",), ("[1]",), (None,)], "json string")
    got = rows(mapper.map_json(df, depth=2))
    assert got[0] == ({"first_name": ["Ada"], "email": ["a@b.co"]}, {"n": "1"}, 2, 1)
    assert [g[2] for g in got[2:]] == [0, 0, 0]


def test_profile(spark, mapper):
    df = spark.createDataFrame([("a@b.co", "x"), ("junk", "y")], "email string, zq string")
    p = mapper.profile(df).first()
    assert (p["rows_seen"], p["matched"], p["unmatched"], p["warning_count"], p["match_rate"]) == (2, 2, 2, 1, 0.5)
    assert p["canonical_counts"] == {"email": 2} and p["unmapped_counts"] == {"zq": 2} and p["warning_counts"] == {"email_validation": 1}
    assert mapper.profile(df, max_rows=1).first()["rows_seen"] == 1 and mapper.profile(df.limit(0)).first()["match_rate"] == 0.0
    assert profile_results(mapper.map(df)).count() == 1
    for bad, kind in ((-1, ValueError), ("x", TypeError), (True, TypeError)):
        with pytest.raises(kind):
            mapper.profile(df, max_rows=bad)


def greedy(table):
    seen, kept = set(), []
    for row, keys in sorted(table):
        own = {k for k in keys or [] if k is not None}
        if own & seen:
            continue
        seen |= own
        kept.append(row)
    return kept


def test_dedupe_against_greedy(spark):
    rng = random.Random(3)
    table = [(k, None if rng.random() < 0.1 else [f"k{rng.randrange(25)}" for _ in range(rng.randrange(4))] + [None] * (k % 7 == 0)) for k in range(120)]
    df = spark.createDataFrame(table, "_row_number long, identity_keys array<string>")
    assert sorted(r[0] for r in dedupe(df).collect()) == greedy(table)
    assert dedupe(df.limit(0)).count() == 0
    single = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "n long, k string")
    assert sorted(r["n"] for r in dedupe_single(single, "k", "n").collect()) == [1, 3, 4]


@pytest.mark.parametrize("most", [200_000, 300])
def test_dedupe_of_long_chains(spark, monkeypatch, most):
    """A path of many rows ends by components, not by a round for every other row."""
    from contactloom.operators import dedupe as module

    monkeypatch.setattr(module, "COMPONENT_KEYS", most)
    monkeypatch.setattr(module, "ROUNDS", 2)
    n = 160
    table = [(k, [f"c{k}", f"c{k + 1}"]) for k in range(n)] + [(1000 + k, [f"d{k}", f"d{k + 1}", "hub" if k % 7 == 0 else f"x{k}"]) for k in range(40)]
    if most == 300:
        table = table[: 2 * 12] + [(500 + k, [f"d{k % 5}", f"e{k}"]) for k in range(200)]
    df = spark.createDataFrame(table, "_row_number long, identity_keys array<string>")
    assert sorted(r["_row_number"] for r in dedupe(df).collect()) == greedy(table)


def test_too_many_keys_are_an_error(spark):
    from contactloom import ContactError
    from contactloom.operators.mapper import json_headers

    df = spark.createDataFrame([(f'{{"k{k}": 1}}',) for k in range(6)], "json string")
    assert len(json_headers(df, "json", most=6)) == 6
    with pytest.raises(ContactError, match="more than 5"):
        json_headers(df, "json", most=5)


def test_nothing_shuffles_in_map(spark, mapper):
    df = spark.createDataFrame([("a@b.co", "x")], "email string, zq string")
    assert "Exchange" not in mapper.map(df)._jdf.queryExecution().executedPlan().toString()


def test_no_columns(spark, mapper):
    r = mapper.map(spark.createDataFrame([(1,)], "k int"), keep=["k"]).first()
    assert r["normalized"] == {} and r["field_matches"] == [] and r["match_rate"] == 0.0

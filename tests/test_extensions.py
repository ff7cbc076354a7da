import json
import re

from contactloom import AliasRegistry, ContactMapper, FieldMatch, Strategy
from contactloom.headers import ExactStrategy, ShapeStrategy
from contactloom.operators.header_tables import resolve_headers
from contactloom.operators.mapper import profile_results
from contactloom.operators.reports import explain_profile, explain_result, profile_dict, result_json, run_stats


class LicencePlate(Strategy):
    """Values like AB-123 are source ids, values in capitals are tags."""

    name, fields = "plate", ("source_id", "tags")

    def match(self, header, value=None, **options):
        if isinstance(value, str) and re.fullmatch(r"\s*[A-Z]{2}-\d{3}\s*", value):
            return FieldMatch(header, "source_id", 0.8, self.name)
        if isinstance(value, str) and value.isupper():
            return FieldMatch(header, "tags", 0.4, self.name)
        return None


def test_custom_value_strategy(spark):
    mapper = ContactMapper(strategies=[ExactStrategy(AliasRegistry()), LicencePlate(), ShapeStrategy()])
    df = spark.createDataFrame([(" AB-123 ", "x"), ("ONE,TWO", "x"), ("a@b.co", "x"), ("?", "x"), (None, "x")], "zq string, email string")
    got = [(r["normalized"], r["unmapped"], r["field_matches"][0]["strategy"]) for r in mapper.map(df).collect()]
    assert got[0] == ({"source_id": ["AB-123"], "email": ["x"]}, {}, "plate")
    assert got[1] == ({"tags": ["ONE", "TWO"], "email": ["x"]}, {}, "plate")
    assert got[2] == ({"email": ["a@b.co", "x"]}, {}, "heuristic")
    assert got[3][1] == {"zq": "?"} and got[4][1] == {"zq": None}
    floor = [r["matched"] for r in mapper.map(df, confidence_threshold=0.5).collect()]
    assert floor == [2, 1, 2, 1, 1]


def test_reports(spark):
    mapper = ContactMapper()
    df = spark.createDataFrame([("A@b.co", "é\"", "yes", "1"), ("junk", None, "?", "2")], "`E-Mail` string, tags string, verified string, `zq` string")
    r = mapper.map(df)
    first, second = (json.loads(x[0]) for x in r.select(result_json(r)).collect())
    assert first["normalized"] == {"email": "a@b.co", "tags": ["é\""], "verified": True} and first["match_rate"] == 0.75
    assert second["normalized"]["verified"] == "?" and second["warnings"][0]["category"] == "email_validation"
    assert "'zq' -> unknown" in explain_result(r.first())
    p = profile_results(r).first()
    assert profile_dict(p)["match_rate"] == 0.75 and "match rate: 75.00%" in explain_profile(p)
    stats = {x["header"]: (x["rows"], x["dropped"], x["low"]) for x in run_stats(r).collect()}
    assert stats["zq"] == (2, True, False) and stats["E-Mail"] == (2, False, False)


def test_header_table(spark):
    df = spark.createDataFrame([("E-Mail",), ("email",), ("Compny",), ("xyzzy",), (None,), ("",), ("email",)], "h string")
    got = {r["header"]: (r["canonical"], r["confidence"], r["strategy"]) for r in resolve_headers(df, "h").collect()}
    assert got == {"E-Mail": ("email", 0.95, "normalized"), "email": ("email", 1.0, "exact"), "Compny": ("company", 0.85, "fuzzy"), "xyzzy": ("unknown", 0.0, "none"), "": ("unknown", 0.0, "none")}
    assert resolve_headers(df.limit(0), "h").count() == 0


def test_release(spark):
    from contactloom.storage import persist, release

    kept = persist(spark.range(3), "probe")
    assert kept.count() == 3 and release(spark) >= 1 and release(spark) == 0

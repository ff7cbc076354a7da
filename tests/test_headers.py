import json

import pytest

from contactloom.aliases import AliasRegistry, builtin_vocabulary
from contactloom.fields import ALL_FIELDS, UNKNOWN, VocabularyError
from contactloom.fuzzy import partial_ratio, ratio, similarity
from contactloom.headers import ExactStrategy, FieldMatch, HeaderResolver, Strategy, clean_header, default_strategies, hints, is_reference
from contactloom.operators.mapper import ContactMapper
from contactloom.plans.mapping import MappingPlan

VENDORS = {
    "E-mail 1 - Value": "email", "Family Name": "last_name", "Given Name": "first_name", "Organization 1 - Name": "company", "Organization 1 - Title": "job_title", "Phone 1 - Value": "phone",
    "hs_lead_status": "lead_status", "jobtitle": "job_title", "lifecyclestage": "lifecycle_stage", "mobilephone": "phone", "zip": "postal_code",
    "BIRTHDAY": "birthday", "FNAME": "first_name", "LNAME": "last_name", "Business City": "city", "Business Street": "address_line1", "E-mail Address": "email", "Home Phone": "home_phone",
    "Account.Name": "company", "MailingCity": "city", "MailingCountry": "country", "MailingPostalCode": "postal_code", "MailingState": "state", "MobilePhone": "phone", "Title": "job_title",
}
TYPOS = {"Compny": ("company", 0.85), "Job Titel": ("job_title", 0.7), "phne_nmbr": ("phone", 0.7), "First Nmae": ("first_name", 0.85), "emial": ("email", 0.7), "moblie": ("phone", 0.85), "ownerid": ("owner", 0.7), "source idd": ("source_id", 0.85), "adress line": ("address_line1", 0.7)}


@pytest.fixture(scope="module")
def mapper():
    return ContactMapper()


@pytest.mark.parametrize("header,field", VENDORS.items())
def test_vendor_headers(mapper, header, field):
    assert mapper.identify(header).canonical == field


@pytest.mark.parametrize("header,verdict", TYPOS.items())
def test_typos(mapper, header, verdict):
    m = mapper.identify(header)
    assert (m.canonical, m.confidence, m.strategy) == (*verdict, "fuzzy")


@pytest.mark.parametrize("header", ["reply_to_email", "Column 1", "tel-olcal", "supercalifragilistic", "primary_phone_id", "", "  "])
def test_unknown(mapper, header):
    assert mapper.identify(header).canonical == UNKNOWN


def test_every_field_has_aliases(mapper):
    assert set(mapper.registry.canonical_fields) == set(ALL_FIELDS) and len(ALL_FIELDS) == 62
    assert {layer for *_, layer in mapper.registry.rows()} == {"base", "form", "social"}


def test_registry_parameters(tmp_path):
    own = {"fields": {"pet_name": ["pet", "Animal"]}}
    assert AliasRegistry(own).lookup("animal") == "pet_name"
    path = tmp_path / "v.json"
    path.write_text(json.dumps(own))
    assert AliasRegistry(path=path).lookup("pet") == "pet_name"
    assert AliasRegistry(overrides={" MMERGE3 ": "tags"}).lookup("mmerge3") == "tags"
    for bad in ({}, {"fields": {}}, {"fields": {"x": []}}, {"fields": {"x": [1]}}, {"fields": {"": ["a"]}}, {"fields": {"x": ["a"]}, "expansion": []}):
        with pytest.raises(VocabularyError):
            AliasRegistry(bad)
    with pytest.raises(VocabularyError):
        AliasRegistry(path=tmp_path / "none.json")
    with pytest.raises(VocabularyError):
        AliasRegistry(overrides={"a": " "})
    assert builtin_vocabulary()["fields"]["email"][0] == "email"


def test_header_helpers():
    assert clean_header(" leadStatus-Code ") == "lead_status_code" and clean_header("XMLHttpURL") == "xml_http_url"
    assert is_reference("EmailRef") and not is_reference("email")
    assert hints("Cell") == {"phone"} and hints("date of birth") == {"birthday"} and hints("ZipCode") == {"postal"} and hints("x") == frozenset()


def test_similarity():
    assert ratio("abcd", "abcd") == 100 and ratio("", "") == 100 and ratio("a", "b") == 0
    assert similarity("compny", "company") > 90 and partial_ratio("mob", "moblie") == 100


def test_cache_and_custom_strategies():
    class Loud(Strategy):
        name, header_only = "loud", True
        calls = 0

        def match(self, header, value=None, **options):
            Loud.calls += 1
            return FieldMatch(header, "notes", 0.5, self.name)

    r = HeaderResolver([Loud()], cache_size=1)
    assert r.of_header("a").canonical == "notes" and r.of_header("a") and Loud.calls == 1
    r.of_header("b")
    r.of_header("a")
    assert Loud.calls == 3 and r.info()["size"] == 1
    r.clear()
    assert r.info()["size"] == 0
    with pytest.raises(ValueError):
        HeaderResolver([], cache_size=-1)
    registry = AliasRegistry()
    assert HeaderResolver([ExactStrategy(registry)]).identify("compny").canonical == UNKNOWN
    assert HeaderResolver(default_strategies(registry)).identify("zq", "a@b.co").strategy == "heuristic"


def test_plan_round_trip(mapper, tmp_path):
    plan = mapper.compile_plan(["E-Mail", "Compny", "zq"], confidence_threshold=0.9)
    assert plan.column_map() == {"E-Mail": "email"} and plan.unmatched_headers() == ["Compny", "zq"]
    path = tmp_path / "plan.json"
    plan.save(path)
    other = ContactMapper()
    again = MappingPlan.load(path, other)
    assert again.column_map() == {"E-Mail": "email"} and again.default_region == "US"
    assert other.resolver.of_header("Compny").canonical == "company"  # unknown verdicts are resolved anew
    assert MappingPlan.load(path, ContactMapper(), freeze_unknown=True).matches["Compny"].canonical == UNKNOWN
    for bad in ({}, {"schema_version": 1}, {"schema_version": 1, "columns": {"a": 1}}, {"schema_version": 1, "columns": {"a": {"canonical": "nope", "confidence": 1, "strategy": "x"}}}, {"schema_version": 1, "columns": {"a": {"canonical": "email", "confidence": 2, "strategy": "x"}}}):
        with pytest.raises(VocabularyError):
            MappingPlan.from_dict(bad, mapper)

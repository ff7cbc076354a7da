import json

import pytest

from contactloom import ContactMapper, cli, i18n
from contactloom.aliases import AliasRegistry
from contactloom.fields import ContactError
from contactloom.sources.readers import dedupe_headers, detect_format, looks_headerless, read_rows
from contactloom.sources.writers import collect_capped, unmapped_names


def test_formats_and_headers():
    assert [detect_format(p) for p in ("a.csv", "a.NDJSON", "a.json", "a")] == ["csv", "jsonl", "json", "csv"]
    assert dedupe_headers(["a", "", "a", " b ", None]) == ["a", "column_2", "a__2", "b", "column_5"]
    assert looks_headerless(["x", "a@b.co"]) and not looks_headerless(["email", "phone"])
    assert unmapped_names(["email", "zq"], ["email"]) == {"email": "email__unmapped", "zq": "zq"}
    with pytest.raises(ContactError):
        detect_format("a", "xml")


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes('﻿Name,E-Mail,E-Mail\n"Do, ""J""","a@b.co\nx"\nBob,b@c.de,c@d.ef,extra\n'.encode())
    _, rows, rejects = read_rows(spark, str(p))
    got = [tuple(r) for r in rows.orderBy("_row_number").collect()]
    assert rows.columns == ["_row_number", "Name", "E-Mail", "E-Mail__2"] and rejects.count() == 0
    assert got == [(2, 'Do, "J"', "a@b.co\nx", ""), (3, "Bob", "b@c.de", "c@d.ef")]


def test_jsonl_and_json(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"email": "a@b.co"}\n\nbroken\n[1]\n{"email": "é@b.co"}\n')
    _, rows, rejects = read_rows(spark, str(p))
    assert [r["_row_number"] for r in rows.collect()] == [1, 5]
    assert [(r["row"], r["raw"]) for r in rejects.orderBy("row").collect()] == [(3, "broken"), (4, "[1]")]
    with pytest.raises(ContactError, match="row 3"):
        read_rows(spark, str(p), fail_fast=True)
    q = tmp_path / "a.json"
    q.write_text('[{"z": 1, "a": 2}, 5]')
    _, rows, rejects = read_rows(spark, str(q))
    assert [r["json"] for r in rows.collect()] == ['{"z":1,"a":2}'] and rejects.count() == 1
    with pytest.raises(ContactError):
        read_rows(spark, str(q), max_json_bytes=3)
    q.write_text("7")
    assert read_rows(spark, str(q))[1].count() == 0
    q.write_text("{")
    with pytest.raises(ContactError):
        read_rows(spark, str(q))


def test_row_cap(spark):
    with pytest.raises(ContactError):
        collect_capped(spark.range(5), 4)
    assert len(collect_capped(spark.range(5), 5)) == len(collect_capped(spark.range(5), 0)) == 5


def test_json_lines_have_no_cap(spark, tmp_path, monkeypatch):
    from contactloom.sources import writers

    monkeypatch.setattr(writers, "collect_capped", None)  # never called for JSON lines
    results = ContactMapper().map(spark.createDataFrame([(f"u{k}@x.co",) for k in range(500)], "email string").repartition(3))
    out = tmp_path / "out.jsonl"
    writers.write_results(results, str(out), "jsonl", single_file=True, max_rows=10)
    assert sorted(out.read_text().splitlines()) == sorted(f'{{"email":"u{k}@x.co"}}' for k in range(500))


def test_map_command(spark, tmp_path, capsys):
    src, out, plan = tmp_path / "in.jsonl", tmp_path / "out.json", tmp_path / "plan.json"
    src.write_text('{"E-Mail": "A@b.co", "labels": "x,y", "verified": "yes", "zq": "1"}\nbroken\n{"E-Mail": "a@B.co"}\n')
    assert cli.main(["map", str(src), "-o", str(out)]) == 1
    code = cli.main(["map", str(src), "-o", str(out), "--on-error", "quarantine", "--dedupe", "--keep-unmapped", "--schema-out", str(plan)])
    said = capsys.readouterr().err
    assert code == 2 and "Mapped 1 row(s)" in said and "1 duplicate(s)" in said and "1 quarantined" in said
    assert json.loads(out.read_text()) == [{"email": "a@b.co", "tags": ["x", "y"], "verified": True, "zq": "1"}]
    assert json.loads(plan.read_text())["columns"]["E-Mail"]["canonical"] == "email"
    assert list((tmp_path / "out.json.quarantine.jsonl").glob("*.json"))
    assert cli.main(["map", str(src), "-o", str(src)]) == 1 and cli.main(["map", str(tmp_path / "none.csv")]) == 1
    assert cli.main(["map", str(src), "--on-error", "skip", "--quarantine-output", "q", "-o", str(out)]) == 1
    csv_out = tmp_path / "o.csv"
    assert cli.main(["map", str(src), "-o", str(csv_out), "--on-error", "skip", "--override", "zq=notes", "--schema-in", str(plan)]) == 2
    assert csv_out.read_text().splitlines()[0] == "email,tags,verified,notes"


def test_other_commands(spark, tmp_path, capsys):
    src = tmp_path / "in.csv"
    src.write_text("E-Mail,zq\na@b.co,1\nb@c.de,2\n")
    assert cli.main(["profile", str(src), "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["canonical_counts"] == {"email": 2}
    assert cli.main(["profile", str(src), "--max-rows", "1"]) == 0 and "rows: 1" in capsys.readouterr().out
    assert cli.main(["explain", "Compny"]) == 0 and "company" in capsys.readouterr().out
    assert cli.main(["explain", "x", "--override", "x=nope"]) == 1
    assert cli.main(["fields"]) == 0 and len(capsys.readouterr().out.splitlines()) == 63


def test_language_packs(tmp_path, capsys):
    words = {"first name": "Vorname", "city": "Stadt Ort", "email": "email"}

    def translate(phrases, code):
        if len(phrases) > 1:
            raise OSError("batch refused")
        return [words.get(p, "") for p in phrases]

    pack = i18n.generate_language("DE", translate, tmp_path, backoff=0)
    assert pack["fields"] == {"first_name": ["vorname"], "city": ["stadt ort", "stadt-ort", "stadt_ort", "stadtort"]}
    assert i18n.generate_language("de", lambda p, c: 1 / 0, tmp_path, backoff=0)["fields"] == pack["fields"]
    registry = AliasRegistry(languages="all", language_dirs=[tmp_path])
    assert registry.lookup("stadt_ort") == "city" and registry.loaded_languages == ("de",)
    (tmp_path / "fr.json").write_text('{"fields": {"x": [1]}}')
    assert i18n.load_pack("fr", [tmp_path]) is None and i18n.load_pack("../x", [tmp_path]) is None
    assert i18n.variants("é") == set() and "cafe" in i18n.variants("Café")
    with pytest.raises(ContactError):
        i18n.generate_language("es", lambda p, c: 1 / 0, tmp_path, backoff=0)
    assert i18n.main(["--list"]) == 0 and "German" in capsys.readouterr().out
    assert i18n.main(["--languages", "es", "--dry-run"]) == 0

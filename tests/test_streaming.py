from contactloom import ContactMapper
from contactloom.streaming import dedupe_stream, map_stream, profile_stream, quarantine_stream


def _feed(spark, folder, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_map_and_profile(spark, tmp_path):
    stream = _feed(spark, tmp_path / "in", [[(1, "A@b.co")], [(2, "junk")]], "k long, email string")
    mapped = map_stream(stream, ContactMapper(), keep=["k"])
    mapped.writeStream.format("memory").queryName("mapped_rows").trigger(availableNow=True).start().awaitTermination()
    assert {r["k"]: r["normalized"]["email"] for r in spark.table("mapped_rows").collect()} == {1: ["a@b.co"], 2: ["junk"]}
    profile_stream(mapped).writeStream.format("memory").queryName("profile_rows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {(r["kind"], r["name"]): r["n"] for r in spark.table("profile_rows").collect()}[("canonical", "email")] == 2


def test_dedupe_across_batches(spark, tmp_path):
    batches = [[(1, ["a"]), (2, ["a", "b"])], [(3, ["b"]), (4, ["a", "c"]), (5, None)], [(6, ["b"]), (7, ["c"])]]
    stream = _feed(spark, tmp_path / "in", batches, "_row_number long, identity_keys array<string>")
    out = tmp_path / "out"
    writer = dedupe_stream(stream, str(tmp_path / "state"), str(out))
    writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(str(out)).select("_row_number").collect()) == [1, 3, 5, 7]


def test_quarantine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"a": 1}\nbroken\n\n[2]\n')
    lines = spark.readStream.text(str(tmp_path / "in"))
    writer = quarantine_stream(lines, str(tmp_path / "good"), str(tmp_path / "bad"))
    writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1 and spark.read.json(str(tmp_path / "bad")).count() == 2

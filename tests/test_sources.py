import pytest

from graphloom.sources import readers, writers
from graphloom.streaming.ingest import counts_by_window, without_repeats


def test_images_and_documents(spark, tmp_path):
    for name in ("a.png", "sub/b.JPG", "sub/c.txt"):
        p = tmp_path / "pics" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"12")
    got = readers.find_images(spark, str(tmp_path / "pics")).collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["a.png", "b.JPG"] and {r.size for r in got} == {2}
    with pytest.raises(Exception):
        readers.find_images(spark, str(tmp_path / "none")).collect()


def test_tree_with_keys(spark, tmp_path):
    for d, s in (("domain_a", "sample_1"), ("domain_b", "sample_2")):
        p = tmp_path / d / s
        p.mkdir(parents=True)
        (p / "metadata.json").write_text('{"element_count": 3}' if d == "domain_a" else "{broken")
        (p / "diagram.xml").write_text("<a/>")
    docs = readers.read_documents(spark, str(tmp_path), "element_count int", {"domain": "domain_", "sample": "sample_"}).where("domain = 'domain_a'")
    assert {(r.domain, r.sample, r.element_count) for r in docs.collect() if r.element_count} == {("domain_a", "sample_1", 3)}
    texts = readers.read_texts(spark, str(tmp_path), {"domain": "domain_"}).collect()
    assert {(r.domain, r.value) for r in texts} == {("domain_a", "<a/>"), ("domain_b", "<a/>")}


def test_two_shapes_and_results(spark):
    docs = spark.createDataFrame([('{"samples": [{"a": 1}]}',), ('[{"a": 2}, {"a": 3}]',), ("{broken",), (None,)], "d string")
    assert sorted(r.a for r in readers.rows_of_documents(docs, "d", "array<struct<a:bigint>>", ["samples"]).collect()) == [1, 2, 3]
    a = spark.createDataFrame([("x", 1)], "k string, a int")
    b = spark.createDataFrame([("y", 2)], "k string, b int")
    whole = spark.createDataFrame([("x", 9)], "k string, a int")
    got = {r.k: (r.a, r.b, r.has_a, r.has_b) for r in readers.load_results({"a": a, "b": b}, ["k"], whole).collect()}
    assert got == {"x": (9, None, True, False), "y": (None, 2, False, True)}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "文"), ("b", 2, None)], "k string, n int, t string")
    writers.write_fragments(df, str(tmp_path / "f"), ["k"])
    assert readers.read_fragments(spark, str(tmp_path / "f"), "n int, t string, k string").where("k = 'a'").first().t == "文"
    writers.write_documents(df, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).count() == 2
    assert writers.delete_rows(df, "t IS NULL").count() == 1


def test_streaming_frames(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS ts, 'a' AS k UNION ALL SELECT timestamp'2024-01-01 00:01:00', 'a'").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    q = counts_by_window(without_repeats(stream, ["k", "ts"], "ts"), "ts", "k", lateness=None).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert counts_by_window(spark.read.parquet(str(tmp_path / "in")), "ts", "k").first().n == 2

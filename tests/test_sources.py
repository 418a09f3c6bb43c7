import pytest
from pyspark.sql import functions as F

from millrace.sources import objects
from millrace.streaming.ingest import dispatch, event_counts, ingest


@pytest.mark.parametrize(
    ("key", "name"),
    [("raw/t/d/f/a%20b+c.pdf", "a b c.pdf"), ("raw/t/d/f/x/y.pdf", "x"), ("raw/t/d/f", None), ("tmp/t/d/f/x", None), ("", None), (None, None)],
)
def test_keys(one, key, name):
    got = one(objects.parse_key(F.lit(key).cast("string")))
    assert (got["filename"] if got else None) == name


def test_form_feeds(one):
    got = one(objects.form_feed_pages(F.lit("one\f\ftwo  x\f \n")))
    assert [(p["page_number"], p["text"]) for p in got] == [(1, "one"), (2, ""), (3, "two x")]


def test_extract(spark):
    good, short, bad = b"x" * 60, b"tiny", b"\xff\xfe"
    df = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(short)), ("c", bytearray(bad)), ("d", None)], "id string, content binary")

    def primary(content):
        if bytes(content[0])[:1] == b"\xff":
            raise ValueError("no such format")
        return [bytes(content[0]).decode()]

    rows = {r["id"]: r for r in objects.extract(df, primary).collect()}
    assert rows["a"]["method"] == "primary" and rows["a"]["pages"][0]["page_number"] == 1
    assert rows["b"]["method"] is None and rows["b"]["pages"] is None
    assert "ValueError" in rows["c"]["primary_error"] and "UnicodeDecodeError" in rows["c"]["fallback_error"]
    assert rows["d"]["raw_sha256"] is None


def test_files_and_json(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.txt").write_bytes(b"hello")
    assert objects.raw_files(spark, str(tmp_path / "raw")).first()["length"] == 5
    assert objects.listed(spark, str(tmp_path / "raw")).columns == ["path", "modificationTime", "length"]
    assert objects.read_text(spark, str(tmp_path / "raw")).first()["value"] == "hello"
    df = spark.createDataFrame([("t", "d", "x")], "tenant_id string, dataset_id string, text string")
    objects.write_json(df, str(tmp_path / "j"))
    assert objects.read_lines(spark, str(tmp_path / "j"), df.schema).first()["text"] == "x"
    objects.write_text(df, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first()["value"] == "x"


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    df = spark.createDataFrame([("raw/t/d/1/a.pdf",), ("raw/t/d/1/a.pdf",), ("bad",), ("raw/t/d/2/b.pdf",)], "key string")
    df.write.parquet(str(src))
    known = spark.createDataFrame([("t", "d", "2")], "tenant_id string, dataset_id string, file_id string")
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    for _ in range(2):  # the second run finds nothing new
        ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), lambda b: dispatch(b, known)).awaitTermination()
    assert [r["file_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["1"]


def test_failed_batches_are_kept_with_their_error(spark, tmp_path):
    df = spark.createDataFrame([("raw/t/d/1/a.pdf",), ("raw/t/d/2/b.pdf",)], "key string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream, calls = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), []

    def work(b):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no store")
        return dispatch(b, None)

    ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), work).awaitTermination()
    assert len(calls) == 3 and spark.read.parquet(str(tmp_path / "out")).count() == 2  # the third try took it

    def never(b):
        raise OSError("no store")

    ingest(stream, str(tmp_path / "out2"), str(tmp_path / "cp2"), never, errors=str(tmp_path / "bad")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert {r["key"] for r in rows} == {"raw/t/d/1/a.pdf", "raw/t/d/2/b.pdf"} and {r["error"] for r in rows} == {"OSError: no store"}
    with pytest.raises(Exception, match="no store"):
        ingest(stream, str(tmp_path / "out3"), str(tmp_path / "cp3"), never, tries=1).awaitTermination()


def test_extractors_get_batches(spark):
    df = spark.createDataFrame([(i, bytearray(b"x" * 60)) for i in range(50)] + [(50, None)], "id long, content binary").coalesce(1)

    def primary(content):
        return [f"{len(content)} files in one call, and this text is long enough for it" for _ in content]

    rows = objects.extract(df, primary).collect()
    assert {r["pages"][0]["text"][:8] for r in rows if r["id"] < 50} == {"50 files"} and rows[-1]["pages"] is None


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"tenant_id": "t",\n "n": 1}')
    assert objects.read_json(spark, str(tmp_path / "a.json"), "tenant_id string, n long").first() == ("t", 1)
    df = spark.createDataFrame([("t", "d", "x"), ("u", "d", None)], "tenant_id string, dataset_id string, text string")
    objects.write_json(df, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out")).select(*df.columns)
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str) and (tmp_path / "out" / "tenant_id=t").exists()


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from millrace.session import shared_dir

    conf = {}
    fake = lambda master: SimpleNamespace(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(fake("spark://host:7077"))
    assert shared_dir(fake("local[2]")) == conf["spark.checkpoint.dir"] == shared_dir(fake("spark://host:7077"))


def test_windows(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type UNION ALL SELECT timestamp'2024-01-01 05:00:00', 'b'")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    counts = event_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")))
    q = counts.writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["event_type"], r["n"]) for r in spark.table("counts").collect()] == [("a", 1)]

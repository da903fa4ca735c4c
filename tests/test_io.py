"""Readers, sinks, the provider and the streams."""
import pytest

from pagewright.operators import provider
from pagewright.sources import latest, readers, writers
from pagewright.streaming import queue


def test_texts_and_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_text("--- Seite 1 von 2 ---\nerste\n\n--- Seite 2 von 2 ---\nzweite\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("ohne Marke", encoding="utf-8")
    p = readers.pages_of_text(readers.texts(spark, str(tmp_path)), "source", "text")
    assert {(r.doc_id, r.page_no, r.text) for r in p.collect()} == {("a.txt", 1, "erste"), ("a.txt", 2, "zweite"), ("b.txt", 1, "ohne Marke")}


def test_binary_errors(spark, tmp_path):
    for name, body in (("a.pdf", b"%PDF-1.4 /Type /Pages /Type /Page /Type/Page "), ("f.pdf", b"%PDF-1.5 /ObjStm"), ("g.pdf", b"%PDF-1.4 /Type /Pages"), ("b.PDF", b"nothing"), ("c.pdf", b"%PDF-1.7 /Encrypt"), ("d.txt", b"%PDF-"), ("e.pdf", b"")):
        (tmp_path / name).write_bytes(body)
    rows = readers.binary(spark, str(tmp_path)).collect()
    got = {r.path.rsplit("/", 1)[1]: r.error for r in rows}
    assert {r.path.rsplit("/", 1)[1]: r.n_pages for r in rows if r.n_pages is not None} == {"a.pdf": 2, "g.pdf": 0} and got["g.pdf"] == "empty" and got["f.pdf"] is None
    assert {k: got[k] for k in ("a.pdf", "b.PDF", "c.pdf")} == {"a.pdf": None, "b.PDF": "unreadable", "c.pdf": "locked"} and "d.txt" not in got


def test_markdown_and_history(spark, tmp_path):
    df = spark.createDataFrame([("x", "alt"), ("x", "neu"), ("y", None), (None, "z")], "stem STRING, markdown STRING")
    writers.save_markdown(df, str(tmp_path / "out"))
    assert {f.name: f.read_text() for f in (tmp_path / "out").iterdir()} == {"x.md": "neu", "y.md": ""}
    h = spark.sql("SELECT 'n' AS name, '/p' AS output_path, TIMESTAMP '2020-01-02 03:04:05' AS ts, CAST(NULL AS STRING) AS warning")
    writers.save_history(h, str(tmp_path / "h"))
    assert readers.history(spark, str(tmp_path / "h")).collect() == h.collect()


def test_latest_is_settled(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, None, "d"), (None, 1, "e")], "k INT, o INT, v STRING")
    assert {(r.k, r.v) for r in latest(df, "k", "o", "v").collect()} == {(1, "c"), (2, "d"), (None, "e")}


def test_provider_retries_and_falls_back(spark):
    p = spark.createDataFrame([(1, 0, "gut"), (1, 1, "voll hier"), (1, 2, "kaputt"), (2, 0, "  "), (2, 1, None)], "doc_id BIGINT, pos INT, prompt STRING")
    main = provider.Echo((("voll", 429), ("kaputt", 400)))
    got = {(r.doc_id, r.pos): (r.kind, r.attempts) for r in provider.call(p, main, fallback=provider.Echo(), wait=lambda s: None).collect()}
    assert got[1, 0] == ("success", 1) and got[1, 1] == ("success", 4) and got[1, 2] == ("providerError", 1) and got[2, 0][0] == "empty"
    assert [provider.delay(n, False) for n in (1, 2)] == [3, 6] and provider.delay(2, True) == 30
    pages = spark.createDataFrame([(1, 2, 1, "b"), (1, 1, 0, "a")], "doc_id BIGINT, page_no INT, pos INT, text STRING")
    assert provider.transcribe(pages, provider.Echo()).first().markdown == "## Seite 1\n\na\n\n---\n\n## Seite 2\n\nb"


def test_queue_as_stream(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rows = [("p", 1, "add"), ("p", 2, "start"), ("q", 1, "add"), ("p", 3, "finish"), ("q", 2, "cancel")]
    src = tmp_path / "in"
    src.mkdir()
    schema = "path STRING, seq BIGINT, command STRING, ts TIMESTAMP"
    for k, part in enumerate((rows[:2], rows[2:])):
        (src / f"{k}.csv").write_text("".join(f"{p},{s},{c},2020-01-01 00:00:0{s}\n" for p, s, c in part))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).csv(str(src))
    q = (queue.stream(stream).writeStream.outputMode("update").format("memory").queryName("queue_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    last = {}
    for r in spark.table("queue_out").collect():
        last[r.path] = max(last.get(r.path, (0, "")), (r.applied, r.state))
    assert {k: v[1] for k, v in last.items()} == {"p": "done", "q": "cancelled"}


def test_shared_folder(spark, tmp_path):
    import glob
    import types

    import pytest

    from pagewright import session

    ours = session.shared_dir(spark)
    before = len(glob.glob(ours.removeprefix("file://") + "/*.parquet"))
    df = session.written(spark.range(3))
    assert df.count() == 3 and len(glob.glob(ours.removeprefix("file://") + "/*.parquet")) == before + 1
    assert session.release(spark) >= 1 and session.release(spark) == 0
    unset = types.SimpleNamespace(get=lambda *_: None)
    cluster = types.SimpleNamespace(conf=unset, sparkContext=types.SimpleNamespace(master="spark://host:7077", getConf=lambda: unset))
    with pytest.raises(ValueError):
        session.shared_dir(cluster)

import pytest

from lodestream import config
from lodestream.operators import bulletins
from lodestream.schemas import BULLETIN, MANIFEST
from lodestream.sources import manifest as M
from lodestream.sources import store


def man(spark, rows):
    return spark.createDataFrame([(d, *[None] * 12, h) for d, h in rows], MANIFEST)


def test_sync(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"<html>%PDF-1.4 body")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 body")
    (tmp_path / "c.pdf").write_bytes(b"error page")
    files = M.clean_pdf(M.landed_files(spark, str(tmp_path)))
    by = {r.doc_id: r for r in files.collect()}
    assert by["a"].sha256 == by["b"].sha256 and by["c"].error
    same = by["a"].sha256
    status = M.sync_status(man(spark, [("a", same), ("b", "old"), ("c", same), ("d", ""), ("e", None)]), files)
    assert {r.doc_id: r.status.split(":")[0] for r in status.collect()} == {"a": "unchanged", "b": "changed", "c": "failed", "d": "failed", "e": "failed"}
    assert {r.status: r.n for r in M.status_histogram(status).collect()} == {"unchanged": 1, "changed": 1, "failed": 3}
    assert M.sync_status(man(spark, [("a", "")]), files).first().status == "new"
    assert [r.doc_id for r in M.unparsed(man(spark, [("a", "x"), ("b", "y")]), man(spark, [("a", "x")])).collect()] == ["b"]


def test_manifest_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'Title, "quoted"\nline', *[None] * 11, "h")], MANIFEST)
    path = str(tmp_path / "m")
    for _ in range(2):
        M.write_manifest(rows, path)
    assert M.read_manifest(spark, path).first().title == 'Title, "quoted"\nline'


def test_store(spark, tmp_path):
    root = str(tmp_path / "s")
    one, two = spark.createDataFrame([(1, "x", True)], "chunk_id int, text string, is_current boolean"), spark.createDataFrame([(2, "y", True)], "chunk_id int, text string, is_current boolean")
    store.write_version(one, root)
    store.write_version(two, root)
    assert store.current(spark, root).first().chunk_id == 2
    c = str(tmp_path / "c")
    assert [store.build_collection(x, c) for x in (one, one, two)] == [True, False, True]
    # New vectors for the same texts are another collection; an interrupted version is none; rows of one key are replaced.
    v = [one.selectExpr("*", f"array({x}, 1.0) AS vector") for x in (1, 2)]
    w = str(tmp_path / "w")
    assert [store.build_collection(x, w) for x in (v[0], v[0], v[1])] == [True, False, True]
    (tmp_path / "c" / "rows" / "v-99999999999999999999-part").mkdir()
    assert store.current(spark, f"{c}/rows").first().chunk_id == 2 and store.versions(spark, str(tmp_path / "none")) == []
    assert store.upsert(one, c) and store.current(spark, f"{c}/rows").count() == 2 and not store.upsert(one, c)
    store.write_lines(one, str(tmp_path / "j"))
    assert store.read_lines(spark, str(tmp_path / "j"), one.schema).collect() == one.collect()
    b = spark.createDataFrame([], BULLETIN)
    store.write_bulletins(b, str(tmp_path / "b"))
    assert store.read_bulletins(spark, str(tmp_path / "b")).count() == 0


def test_config():
    c = config.build(config.Pipeline, {"name": "x", "chunker": {"type": "fixed", "max_tokens": 500, "overlap": 50}})
    assert c.chunk_set == "fixed-500-50" and c.collection == "fixed-500-50__hashed-ngrams" and c.retrieval.k_final == 6
    for bad in ({"name": "x", "typo": 1}, {"name": "x", "retrieval": {"fusion": "sum"}}, {"name": "x", "chunker": {"overlap": 400}}, {"name": "x", "retrieval": {"typo": 1}}):
        with pytest.raises(ValueError):
            config.build(config.Pipeline, bad)


def test_stream(spark, tmp_path):
    import datetime as dt

    from lodestream.schemas import ARRIVING
    from lodestream.streaming import bulletins as SB

    t = dt.datetime(2024, 1, 1, 12)
    rows = [(1, "b", "c", dt.date(2024, 1, 1), 90, "Satisfactory", t), (2, "b", "c", dt.date(2024, 1, 1), 95, "Satisfactory", t), (3, "b", "d", dt.date(2024, 1, 1), 700, "Severe", t)]
    spark.createDataFrame(rows, ARRIVING).coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, df, want in (("kept", SB.first_of_day(SB.arriving(spark, str(tmp_path / "in"))), 2), ("totals", SB.daily_totals(SB.arriving(spark, str(tmp_path / "in"))), 1)):
        mode = "append" if name == "kept" else "complete"
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == want


def test_command_line(spark, tmp_path, monkeypatch):
    from lodestream import __main__ as cli

    monkeypatch.setattr(cli, "_session", lambda: spark)
    texts = spark.createDataFrame([("Air Quality Index on Nov 5, 2024\n1\nKanpur\nSevere\n420\nPM2.5\n3/4",)], "text string")
    texts.write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([("Kanpur",)], "city string").write.parquet(str(tmp_path / "c"))
    assert cli.main(["bulletins", str(tmp_path / "t"), str(tmp_path / "rows")]) == 0
    assert cli.main(["load", str(tmp_path / "rows"), str(tmp_path / "table")]) == 0
    assert cli.main(["quality-report", str(tmp_path / "table"), str(tmp_path / "c")]) == 0
    assert bulletins.load_stats(store.current(spark, str(tmp_path / "table"))).first().n_rows == 1

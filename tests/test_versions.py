"""Committed versions: what a reader sees, which files an upsert touches, what a crash leaves."""

import datetime as dt
import os

import pytest

from conftest import rows
from loomtable.sources import tables, versions
from loomtable.sources.manifests import commit, content_of, names_in
from loomtable.sources.tables import load_result, result_lineage, save_result
from loomtable.sources.versions import read_version, stream_versions, table_versions, upsert_version, write_version

BAR = "symbol string, trade_date date, close double"


def bar(symbol, month, close):
    return symbol, dt.date(2024, month, 1), close


def files_of(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


@pytest.fixture
def table(spark, frame, tmp_path):
    root = str(tmp_path / "bars")
    write_version(frame(BAR, *[bar(s, m, float(m)) for s in "AB" for m in range(1, 13)]), root, ["symbol", "trade_date"], ["month(trade_date)"], 8, "import", ["feed"])
    return root


def test_upsert_rewrites_only_its_buckets(spark, frame, table):
    before, old = files_of(table), content_of(spark, f"{table}/versions/000000000001.json")
    out = upsert_version(frame(BAR, bar("A", 3, 30.0), bar("C", 3, 33.0), ("A", dt.date(2024, 3, 2), 3.5)), table, "daily")
    assert out.filter("month(trade_date) = 3").count() == 4 and out.filter("symbol = 'A' and close = 30").count() == 1
    after, new = files_of(table), content_of(spark, f"{table}/versions/000000000002.json")
    assert {f: t for f, t in after.items() if f in before} == before
    changed = [b for b in new["files"] if new["files"][b] != old["files"].get(b)]
    assert len(changed) == 1 == len(new["rewritten"]) and len(set(new["files"]) - set(changed)) >= 4
    assert rows(table_versions(spark, table).select("version", "produced_by", "source_refs", "n_buckets"), "version") == [(1, "import", ["feed"], 8), (2, "daily", [], 8)]


def test_earlier_versions_stay_readable(spark, frame, table):
    upsert_version(frame(BAR, bar("A", 1, 100.0)), table)
    write_version(frame(BAR, bar("Z", 1, 1.0)), table, ["symbol", "trade_date"])
    assert read_version(spark, table).count() == 1
    assert read_version(spark, table, 2).filter("close = 100").count() == 1
    assert read_version(spark, table, 1).filter("close = 100").count() == 0 and read_version(spark, table, 1).count() == 24
    with pytest.raises(ValueError, match="no version 9"):
        read_version(spark, table, 9)


def test_a_run_that_dies_before_the_commit_changes_nothing(spark, frame, table, monkeypatch):
    def dies(*_):
        raise RuntimeError("killed")

    before = sorted(rows(read_version(spark, table)))
    with monkeypatch.context() as m:
        m.setattr(versions, "commit", dies)
        with pytest.raises(RuntimeError):
            upsert_version(frame(BAR, bar("A", 1, -1.0)), table)
    assert sorted(rows(read_version(spark, table))) == before and table_versions(spark, table).count() == 1
    upsert_version(frame(BAR, bar("A", 1, -1.0)), table)
    assert read_version(spark, table).filter("close = -1").count() == 1


def test_of_two_writers_one_is_refused(spark, frame, table, monkeypatch):
    first = versions._written

    def late(*args):
        monkeypatch.setattr(versions, "_written", first)
        upsert_version(frame(BAR, bar("B", 2, 70.0)), table)
        return first(*args)

    monkeypatch.setattr(versions, "_written", late)
    with pytest.raises(ValueError, match="another writer"):
        upsert_version(frame(BAR, bar("A", 2, 80.0)), table)
    assert read_version(spark, table).filter("close = 70").count() == 1 and read_version(spark, table).filter("close = 80").count() == 0


def test_edges(spark, frame, tmp_path, table):
    root = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no version yet"):
        upsert_version(frame(BAR, bar("A", 1, 1.0)), root)
    empty = write_version(frame(BAR, bar("A", 1, 1.0)).limit(0), root, ["symbol", "trade_date"])
    assert empty.columns == ["symbol", "trade_date", "close"] and empty.count() == 0
    twice = frame(BAR + ", load_seq int, extra int", (*bar("A", 1, 1.0), 1, 0), (*bar("A", 1, 2.0), 2, 0), (None, None, 5.0, 1, 0), (None, None, 6.0, 3, 0))
    assert sorted(rows(upsert_version(twice, root)), key=str) == sorted([bar("A", 1, 2.0), (None, None, 6.0)], key=str)
    assert upsert_version(twice.limit(0), root).count() == 2
    with pytest.raises(ValueError, match="no column 'close'"):
        upsert_version(frame("symbol string, trade_date date", ("A", None)), root)


def test_stream_batches_are_merged_once(spark, frame, tmp_path, table):
    source, check = str(tmp_path / "in"), str(tmp_path / "ck")
    for close in (50.0, 60.0):
        frame(BAR, bar("A", 5, close), bar("N", 5, close)).write.mode("append").parquet(source)
        stream_versions(spark.readStream.schema(BAR).parquet(source), table, check, "feed").awaitTermination()
    now = read_version(spark, table)
    assert rows(now.filter("month(trade_date) = 5"), "symbol") == [bar("A", 5, 60.0), bar("B", 5, 5.0), bar("N", 5, 60.0)]
    n = table_versions(spark, table).count()
    upsert_version(frame(BAR, bar("A", 5, -5.0)), table, stream="feed", batch_id=1)  # sent again
    assert table_versions(spark, table).count() == n and read_version(spark, table).filter("close = -5").count() == 0


def test_commits_are_whole_and_first_come(spark, tmp_path):
    path = str(tmp_path / "x" / "a.json")
    assert commit(spark, path, {"n": 1}) and not commit(spark, path, {"n": 2})
    assert content_of(spark, path) == {"n": 1} and names_in(spark, str(tmp_path / "x")) == ["a.json"]
    assert content_of(spark, str(tmp_path / "none.json")) is None and names_in(spark, str(tmp_path / "none")) == []


def test_a_result_is_there_with_its_lineage_or_not_at_all(spark, frame, tmp_path, monkeypatch):
    root = str(tmp_path / "r")

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(tables, "commit", dies)
        with pytest.raises(RuntimeError):
            save_result(frame("a int", (1,)), root, "r1", "test")
    with pytest.raises(ValueError, match="no result"):
        load_result(spark, root, "r1")
    save_result(frame("a int", (2,)), root, "r1", "test", ["t"])
    assert rows(load_result(spark, root, "r1")) == [(2,)]
    assert rows(result_lineage(spark, root).select("result_ref", "produced_by", "source_refs", "columns")) == [("r1", "test", ["t"], ["a"])]
    with pytest.raises(ValueError, match="already"):
        save_result(frame("a int", (3,)), root, "r1", "test")
    assert rows(load_result(spark, root, "r1")) == [(2,)]

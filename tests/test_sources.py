import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import column, rows
from loomtable import get_operator, list_operators, operator
from loomtable.sources.disclosures import build_disclosures, dedupe_key, exchange_bulletins, market_route, normalize_ticker
from loomtable.sources.exports import export_bundle, export_csv, load_bundle, verify_artifacts
from loomtable.sources.news import distinct_news, news_in_range, parse_articles
from loomtable.sources.prices import (clean_prices, import_price_csv, import_summary, provider_symbol, set_aside,
                                      sync_price_payloads, upsert_bars)
from loomtable.sources.statements import announcements, latest_statement
from loomtable.sources.tables import (canonicalize_header_paths, changed_files, filter_by_first_date, indicator_from_csv,
                                      infer_header, load_as_text, load_result, load_table_region, normalize_table,
                                      parse_region, read_cells, require_unchanged, result_lineage, save_result,
                                      source_fingerprint)
from loomtable.streaming.upserts import current_rows, stream_upserts


def test_header_names():
    assert canonicalize_header_paths([["Sales", "Amount (CNY)"], ["Sales", "Amount CNY"], ["客户"], []]) == (
        ["sales_amount_cny", "sales_amount_cny_2", "column_3", "column_4"], True)
    plain = infer_header([(1, ["User ID", "Sales"]), (2, ["1", "2"])])
    assert (plain["columns"], plain["schema_state"], plain["data_start_row"]) == (["user_id", "sales"], "confirmed", 2)
    titled = infer_header([(1, ["Report", ""]), (3, ["a", "b"]), (4, ["1", "2"])])
    assert (titled["columns"], titled["schema_state"], titled["data_start_row"]) == (["a", "b"], "pending", 4)
    double = infer_header([(1, ["East", "East"]), (2, ["q1", "q2"]), (3, ["1", "2"])])
    assert double["columns"] == ["east_q1", "east_q2"] and double["header_row_count"] == 2


def test_regions(spark, frame, tmp_path):
    assert parse_region(" b2:aa10 ") == (2, 2, 10, 27)
    for bad in ("A1", "B2:A1", "A0:B2", "1A:B2"):
        with pytest.raises(ValueError):
            parse_region(bad)
    (tmp_path / "s.csv").write_text('x,"Name, full",Qty\nx,a,1\n5,b,\nx,c,3\n')
    cells = read_cells(spark, str(tmp_path / "s.csv"))
    assert rows(load_table_region(cells, "B1:C3"), "row_number") == [(2, "a", "1"), (3, "b", "")]
    assert normalize_table(cells).columns == ["row_number", "x", "name_full", "qty"]
    with pytest.raises(ValueError, match="does not fit"):
        load_table_region(cells, "B1:C3", 4)


def test_results_lineage_and_fingerprints(spark, frame, tmp_path):
    root = str(tmp_path / "store")
    save_result(frame("a int, b date", (1, None)), root, "r1", "select_columns", ["t1"])
    assert load_result(spark, root, "r1").dtypes == [("a", "int"), ("b", "date")]
    line = result_lineage(spark, root).first()
    assert (line.result_ref, line.produced_by, line.source_refs, line.columns) == ("r1", "select_columns", ["t1"], ["a", "b"])
    folder = tmp_path / "src"
    folder.mkdir()
    (folder / "a.csv").write_text("a\n1\n")
    save_result(frame("a int", (1,)), root, "r2", "load", source_paths=[str(folder)])
    assert load_result(spark, root, "r2").count() == 1
    before = spark.createDataFrame(source_fingerprint(spark, str(folder)).collect())
    require_unchanged(before, source_fingerprint(spark, str(folder)))
    (folder / "a.csv").write_text("a\n1\n2\n")
    (folder / "b.csv").write_text("a\n")
    assert sorted(column(changed_files(before, source_fingerprint(spark, str(folder))), "status")) == ["changed", "new"]
    with pytest.raises(ValueError, match="source (changed|new)"):
        load_result(spark, root, "r2")
    with pytest.raises(ValueError, match="source"):
        require_unchanged(before, source_fingerprint(spark, str(folder)))


def test_exports(spark, frame, tmp_path):
    df = frame("a int, b string", (1, 'say "hi", ok'), (2, None), (3, " two\nlines "), (4, ""), (5, "null"))
    export_csv(df.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text()
    assert text.startswith('"a","b"\n"1","say ""hi"", ok"\n"2",') and '"3"," two\nlines "\n' in text
    assert load_as_text(spark, str(tmp_path / "csv"), "csv", escape='"').dtypes == [("a", "string"), ("b", "string")]
    export_bundle({"one": df, "two": df.select("a")}, str(tmp_path / "bundle"), "csv")
    back = load_bundle(spark, str(tmp_path / "bundle"))
    assert list(back) == ["one", "two"] and rows(back["one"], "a") == [
        (1, 'say "hi", ok'), (2, None), (3, " two\nlines "), (4, ""), (5, "null")]
    files = tmp_path / "files"
    files.mkdir()
    (files / "x.bin").write_bytes(b"abc")
    (files / "y.bin").write_bytes(b"abd")
    good = hashlib.sha256(b"abc").hexdigest()
    manifest = frame("file_name string, sha256 string", ("x.bin", good.upper()), ("y.bin", good), ("z.bin", good))
    assert column(verify_artifacts(spark, str(files), manifest), "status", "file_name") == ["matched", "mismatch", "missing"]


def test_price_csv(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text('Date,Open,HIGH,low,Close,Adj Close,Volume\n2025/1/2,"1,000.5",2,0.5,1.5,1.5,"12,000"\n20250103,1,2,1,2,2,10.6\n')
    out = import_price_csv(spark, str(f), "600000.SH")
    got = rows(out.withColumn("trade_date", F.col("trade_date").cast("string")), "trade_date")
    assert got[0] == ("600000.SH", "2025-01-02", 1000.5, 2.0, 0.5, 1.5, 1.5, 12000, "csv_import")
    assert got[1][7] == 11
    f.write_text("date,open,high,low,close,adjclose,volume\n2025-01-02,x,2,1,1,1,1\n")
    with pytest.raises(PySparkException, match="line 2: bad price cells: open"):
        import_price_csv(spark, str(f), "A").collect()
    f.write_text("date,open,high,low,close,adjclose,volume\n2025-01-02,x,2,1,1,1,1\n2025-01-03,1,2,1,1,1,1\n")
    good, bad = set_aside(import_price_csv(spark, str(f), "A", strict=False))
    assert good.count() == 1 and rows(bad.select("line_number", "bad_fields")) == [(2, "open")]
    f.write_text("date,open\n2025-01-02,1\n")
    with pytest.raises(ValueError, match="missing price columns: high"):
        import_price_csv(spark, str(f), "A")


def test_upsert_and_summary(frame):
    a = frame("symbol string, trade_date string, close double, load_seq int", ("A", "d1", 1.0, 1), ("A", "d1", 2.0, 2), ("A", "d2", 3.0, 1))
    b = frame("symbol string, trade_date string, close double", ("A", "d2", 9.0), ("B", "d1", 4.0))
    out = upsert_bars([a, b])
    assert rows(out, "symbol", "trade_date") == [("A", "d1", 2.0), ("A", "d2", 9.0), ("B", "d1", 4.0)]
    assert rows(import_summary(out), "symbol") == [("A", 2, "d1", "d2"), ("B", 1, "d1", "d1")]


def test_provider_payloads(frame):
    arrays = '{"code":0,"data":{"sh600519":{"qfqday":[["2025-01-02","10","11","12","9","1000.4"],["2024-01-02","1","1","1","1","1"]]}}}'
    objects = '[{"day":"2025-01-03","open":"5","high":"6","low":"4","close":"5.5","volume":"77"}]'
    landed = frame("symbol string, provider string, payload string", ("600519.SH", "tencent", arrays),
                   ("600519.SH", "sina", objects), ("000001", "tencent", '{"code":1,"msg":"down"}'), ("000001", "sina", objects))
    out = sync_price_payloads(landed, "2025-01-01", "2025-12-31")
    got = [(r.symbol, str(r.trade_date), r.open, r.high, r.low, r.close, r.volume, r.source) for r in out.orderBy("symbol").collect()]
    assert got == [("000001", "2025-01-03", 5.0, 6.0, 4.0, 5.5, 77, "sina_http_qfq"),
                   ("600519.SH", "2025-01-02", 10.0, 12.0, 9.0, 11.0, 1000, "tencent_http_qfq")]
    symbols = frame("s string", ("600519",), ("000001.sz",), ("300750",), ("510300.SH",), ("0700.HK",), ("12",))
    assert column(symbols.select(provider_symbol(F.col("s")).alias("p")), "p") == [
        "sh600519", "sz000001", "sz300750", "sh510300", None, None]
    with pytest.raises(ValueError, match="unknown providers"):
        sync_price_payloads(landed, "2025-01-01", "2025-12-31", ["yahoo"])


@pytest.mark.parametrize("hot", [None, 2])
def test_clean_prices(frame, hot):
    raw = frame("symbol string, Date string, Open string, Close string", ("A", "2025-01-01", None, "1"),
                ("A", "2025-01-02", "5", "2"), ("A", "2025-01-03", "x", "3"), ("A", "bad", "9", "4"), ("A", "2025-01-04", "9", ""))
    out = clean_prices(raw, block_rows=hot)
    assert [(r.Open, r.Close) for r in out.orderBy("Date").collect()] == [(5.0, 1.0), (5.0, 2.0), (5.0, 3.0)]


def test_dated_text(frame):
    df = frame("day string, v int", ("2025-01-01", 1), ("2025-02-01", 2))
    assert filter_by_first_date(df, "2025-01-15", "2025-03-01").count() == 1
    assert filter_by_first_date(frame("day string", ("soon",), ("2025-01-01",)), "2025-01-01", "2025-01-02").count() == 2
    csv = frame("time string, SMA string", ("2025-01-03", " 3 "), ("2025-01-01", "1"), ("junk", "9"), ("2024-01-01", "0"))
    assert column(indicator_from_csv(csv, "close_50_sma", "2025-01-03", 5), "value") == ["1", "3"]


def test_statements_and_announcements(frame):
    landed = frame("symbol string, payload string",
                   ("A", '[{"REPORT_DATE":"2025-09-30 00:00:00","TOTAL_OPERATE_INCOME":"1,234.5","YSTZ":-3.2,"ROEJQ":7}]'),
                   ("B", '{"data":[{"date":"2025","YSTZ":"x"}]}'), ("C", '{"oops":1}'))
    got = {r.symbol: r for r in latest_statement(landed).collect()}
    assert (got["A"].report_period, got["A"].revenue, got["A"].revenue_yoy_pct, got["A"].roe_pct) == ("2025-09-30", 1234.5, -3.2, 7.0)
    assert got["B"].statement_status == "available" and got["B"].revenue_yoy_pct is None
    assert got["C"].statement_status == "unavailable"
    doc = '{"data":{"list":[{"title":" "},{"title":" 年报 ","notice_date":"2025-03-01 x","columns":[{"column_name":"n"}]},{"title":"b"}]}}'
    out = announcements(frame("symbol string, payload string", ("A", doc)), limit=1)
    assert rows(out.select("position", "title", "published_at", "category")) == [(0, "年报", "2025-03-01", "n")]


def test_disclosures(frame):
    tickers = frame("m string, t string", ("SH", "600000"), ("HK", "700"), ("x", "1.sz"), ("CN-BJ", "8300-01"), ("US", "A"))
    assert column(tickers.select(normalize_ticker(F.col("m"), F.col("t")).alias("n")), "n") == [
        "600000.SH", "0700.HK", "000001.SZ", "830001.BJ", None]
    routes = frame("t string", ("000001",), ("600000.sh",), ("830001",), ("0700.HK",))
    assert column(routes.select(market_route(F.col("t"))["market"].alias("m")), "m") == ["CN-SZ", "CN-SH", "CN-BJ", "HK"]
    key = frame("a int", (1,)).select(dedupe_key(
        F.lit("cn-a"), F.lit("sse"), F.lit("600000.SH"), F.lit("  Big   NEWS "), F.lit("2026-03-01T09:59:00+08:00"),
        F.lit("https://x/y/Doc.PDF?q=1")).alias("k")).first()[0]
    raw = "CN-A|SSE|600000.SH|big news|2026-03-01T09|doc.pdf"
    assert key == hashlib.sha256(raw.encode()).hexdigest()
    landed = frame("announcement_id string, announcement_time bigint, market string, exchange string, sec_code string, "
                   "sec_name string, org_id string, title string, file_url string, adjunct_type string, content string",
                   ("7", 1767196800000, "CN-SH", "SSE", "600000", "n", "o", " 2025年半年度报告 ", "http://a/b.pdf", None, None),
                   ("8", 1767196799000, "CN-SH", "SSE", "600000", "n", "o", "关于收购的公告", None, "DOC", None))
    a, b = build_disclosures(landed).orderBy("event_id").collect()
    assert (a.document_date, a.published_at, a.category, a.document_url) == (
        "2026-01-01", "2026-01-01T00:00:00+08:00", "annual_report", "https://a/b.pdf")
    assert a.attachments[0].media_type == "application/pdf"
    assert (b.document_date, b.category, b.attachments, b.document_type) == ("2025-12-31", "mna_restructuring", [], "doc")
    payload = 'cb({"result":[[{"SECURITY_CODE":"600000","TITLE":" a ","URL":"/x.pdf"}],{"SECURITY_CODE":"1","URL":"https://u"}]})'
    out = exchange_bulletins(frame("payload string", (payload,), ("nope",))).collect()
    assert [(r.ticker_normalized, r.title, r.document_url) for r in out] == [
        ("600000.SH", "a", "https://www.sse.com.cn/x.pdf"), ("000001.SH", "", "https://u")]


def test_news(frame):
    landed = frame("id int, payload string", (
        1, '{"content":{"title":"T","pubDate":"2026-01-02T23:00:00Z","provider":{"displayName":"P"},"clickThroughUrl":{"url":"u"}}}'),
        (2, '{"title":"T","publisher":"Q","link":"l"}'), (3, '{"content":{"title":"old","pubDate":"2025-01-01T00:00:00Z"}}'), (4, "{}"))
    got = parse_articles(landed, keep=["id"])
    assert rows(got.select("title", "summary", "publisher", "link").filter("id < 3")) == [("T", "", "P", "u"), ("T", "", "Q", "l")]
    assert column(news_in_range(got, "2026-01-01", "2026-01-02"), "id", "id") == [1, 2, 4]
    assert column(distinct_news(got, ["id"]), "id", "id") == [1, 3, 4]


def test_stream_upserts(spark, frame, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, v int"
    for batch in ((("a", 1), ("b", 1)), (("a", 2), ("c", 3))):
        frame(schema, *batch).coalesce(1).write.mode("append").parquet(source)
        q = stream_upserts(spark.readStream.schema(schema).parquet(source), root, str(tmp_path / "ck"))
        q.awaitTermination(60)
    assert rows(current_rows(spark, root, ["k"]), "k") == [("a", 2), ("b", 1), ("c", 3)]


def test_registry():
    names = list_operators()
    assert {"filter_rows", "join_tables", "window_calculation", "navigate", "mask_values"} <= set(names)
    assert get_operator("sort_rows").__name__ == "sort_rows"

    @operator("test_only_operator")
    def mine(df):
        return df

    assert get_operator("test_only_operator") is mine
    with pytest.raises(ValueError, match="registered twice"):
        operator("sort_rows")(mine)
    with pytest.raises(ValueError, match="unknown operator"):
        get_operator("nope")

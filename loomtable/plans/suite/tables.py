"""Loading, header names, regions, saved results, exports and file hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtable.operators.columns import cast_column_types
from loomtable.operators.grouping import group_and_aggregate
from loomtable.plans.suite.base import Tables, day_text, query, saved, scratch_folder
from loomtable.sources.exports import compare_hashes, export_bundle, export_csv, import_csv, load_bundle, verify_artifacts
from loomtable.sources.tables import (changed_files, filter_by_first_date, indicator_from_csv, load_as_text,
                                      load_result, load_table_region, normalize_table, result_lineage,
                                      rows_by_position, save_result, source_fingerprint)


@query("text_columns", """
    SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey::VARCHAR AS s_nationkey,
           s_acctbal::VARCHAR AS s_acctbal FROM supplier""")
def text_columns(spark, sf):
    return load_as_text(spark, f"{sf}/supplier.parquet")


def _customer_sheet(spark, sf):
    """The customer table as a sheet: two header rows, then one row per customer."""
    c = Tables(spark, sf).customer
    body = c.select((F.col("c_custkey") + 3).alias("row_number"), F.col("c_custkey").cast("string").alias("_c0"),
                    F.col("c_name").alias("_c1"), F.concat(F.lit(" "), F.col("c_mktsegment")).alias("_c2"),
                    F.col("c_acctbal").cast("string").alias("_c3"))
    head = spark.createDataFrame([(1, "Customer", "Customer", "Market", "Market"),
                                  (2, "Key", "Full Name", "Segment", "segment ")], body.schema)
    return head.unionByName(body)


@query("sheet_with_headers", """
    SELECT c_custkey + 3 AS row_number, c_custkey::VARCHAR AS customer_key, c_name AS customer_full_name,
           ' ' || c_mktsegment AS market_segment, c_acctbal::VARCHAR AS market_segment_2 FROM customer""")
def sheet_with_headers(spark, sf):
    return normalize_table(_customer_sheet(spark, sf), confirm=True)


@query("sheet_region", """
    SELECT c_custkey + 3 AS row_number, c_name AS customer_full_name, c_mktsegment AS market_segment
    FROM customer WHERE c_custkey + 3 <= 1200""")
def sheet_region(spark, sf):
    return load_table_region(_customer_sheet(spark, sf), "B1:C1200", 2)


@query("rows_by_position", """
    SELECT row_number, o_orderkey, o_custkey FROM (
      SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS row_number, o_orderkey, o_custkey
      FROM orders) WHERE row_number BETWEEN 101 AND 600""")
def rows_by_place(spark, sf):
    return rows_by_position(Tables(spark, sf).orders,
                            [{"column": "o_totalprice", "descending": True}, "o_orderkey"], 101, 600,
                            ["o_orderkey", "o_custkey"])


@query("saved_result_with_lineage", """
    SELECT o_orderstatus, count(*) AS o_orderkey_count, 'order_status' AS result_ref,
           'group_and_aggregate' AS produced_by, 'orders' AS sources
    FROM orders GROUP BY o_orderstatus""")
def saved_result_with_lineage(spark, sf):
    root = scratch_folder(spark)
    counts = group_and_aggregate(Tables(spark, sf).orders, ["o_orderstatus"],
                                 [{"column": "o_orderkey", "operator": "count"}])
    save_result(counts, root, "order_status", "group_and_aggregate", ["orders"])
    line = result_lineage(spark, root).filter("result_ref = 'order_status'")
    return load_result(spark, root, "order_status").withColumns({
        "result_ref": F.lit("order_status"), "produced_by": line.select("produced_by").scalar(),
        "sources": line.select(F.array_join("source_refs", ",")).scalar()})


@query("source_files", """
    SELECT c_nationkey, status, 1::BIGINT AS files FROM (SELECT DISTINCT c_nationkey FROM customer),
           (VALUES ('missing'), ('new')) v(status)
    UNION ALL SELECT NULL, 'unchanged', 0""")
def source_files(spark, sf):
    """Customers written by nation, then written again: every file is another one; before that none had changed."""
    path = scratch_folder(spark) + "/customer"
    rows = Tables(spark, sf).customer.repartition("c_nationkey")
    rows.write.partitionBy("c_nationkey").parquet(path)
    first = saved(source_fingerprint(spark, path))
    same = changed_files(first, source_fingerprint(spark, path)).agg(F.count(F.lit(1)).alias("files"))
    same = saved(same).select(F.lit(None).cast("int").alias("c_nationkey"), F.lit("unchanged").alias("status"), "files")
    rows.write.mode("overwrite").partitionBy("c_nationkey").parquet(path)
    nation = F.regexp_extract("file_path", r"c_nationkey=(\d+)", 1).cast("int")
    return changed_files(first, source_fingerprint(spark, path)).groupBy(nation.alias("c_nationkey"), "status").agg(
        F.count(F.lit(1)).alias("files")).unionByName(same)


@query("csv_round_trip", """
    SELECT p_partkey::VARCHAR AS p_partkey, p_name || ' "' || p_brand || '", x' AS label,
           p_retailprice::VARCHAR AS p_retailprice FROM part""")
def csv_round_trip(spark, sf):
    p = Tables(spark, sf).part.select(
        "p_partkey", F.concat("p_name", F.lit(' "'), "p_brand", F.lit('", x')).alias("label"), "p_retailprice")
    return import_csv(spark, export_csv(p, scratch_folder(spark)))


@query("csv_texts", """
    SELECT doc_id, n_chars, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 = 0 THEN 'null'
           ELSE ' "' || text || chr(10) || ', ' END AS text FROM documents""")
def csv_texts(spark, sf):
    """Whole texts with line breaks, quotes, outer blanks, empty cells, nulls and the word null, through a typed bundle."""
    d, n = Tables(spark, sf).documents, F.col("doc_id")
    rows = d.select("doc_id", "n_chars", F.when(n % 5 == 0, None).when(n % 7 == 0, "").when(n % 11 == 0, "null").otherwise(
        F.concat(F.lit(' "'), "text", F.lit("\n, "))).alias("text"))
    root = scratch_folder(spark)
    export_bundle({"documents": rows}, root, "csv")
    return load_bundle(spark, root)["documents"]


@query("table_bundle", """
    SELECT 'nation' AS table_name, n_nationkey AS id, n_name AS name FROM nation
    UNION ALL SELECT 'region', r_regionkey, r_name FROM region""")
def table_bundle(spark, sf):
    t, root = Tables(spark, sf), scratch_folder(spark)
    export_bundle({"nation": t.nation, "region": t.region}, root)
    back = load_bundle(spark, root)
    return back["nation"].select(F.lit("nation").alias("table_name"), F.col("n_nationkey").alias("id"),
                                 F.col("n_name").alias("name")).unionByName(
        back["region"].select(F.lit("region").alias("table_name"), F.col("r_regionkey").alias("id"),
                              F.col("r_name").alias("name")))


@query("artifact_hashes", """
    SELECT m.doc_id::VARCHAR AS file_name, sha256(m.text) AS expected_sha256,
           CASE WHEN m.doc_id % 5 = 0 THEN NULL WHEN m.doc_id % 7 = 0 THEN sha256(m.text || '!')
                ELSE sha256(m.text) END AS actual_sha256,
           CASE WHEN m.doc_id % 5 = 0 THEN 'missing' WHEN m.doc_id % 7 = 0 THEN 'mismatch'
                ELSE 'matched' END AS status
    FROM documents m""")
def artifact_hashes(spark, sf):
    d = Tables(spark, sf).documents
    name = F.col("doc_id").cast("string").alias("file_name")
    manifest = d.select(name, F.sha2("text", 256).alias("sha256"))
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    found = d.filter("doc_id % 5 != 0").select(name, F.sha2(changed, 256).alias("actual_sha256"))
    return compare_hashes(manifest, found)


@query("artifact_files", """
    WITH f AS (SELECT n_regionkey AS region, sha256(string_agg(n_name || chr(10), '' ORDER BY n_name)) AS sha FROM nation GROUP BY 1)
    SELECT region, CASE WHEN region = 3 THEN sha256('other') ELSE sha END AS expected_sha256, sha AS actual_sha256,
           CASE WHEN region = 3 THEN 'mismatch' ELSE 'matched' END AS status FROM f
    UNION ALL SELECT NULL, sha256('gone'), NULL, 'missing'""")
def artifact_files(spark, sf):
    """Names of nations in one text file per region; the files are read and hashed."""
    n, path = Tables(spark, sf).nation, scratch_folder(spark)
    (n.select(F.col("n_name").alias("value"), "n_regionkey").repartition("n_regionkey").sortWithinPartitions("n_regionkey", "value")
     .write.partitionBy("n_regionkey").text(path))
    file = F.regexp_extract("file_path", r"(n_regionkey=.*)$", 1)
    files = source_fingerprint(spark, path).select(
        file.alias("file_name"), F.regexp_extract("file_path", r"n_regionkey=(\d+)", 1).cast("int").alias("region"))
    texts = n.groupBy(F.col("n_regionkey").alias("region")).agg(F.array_join(F.sort_array(F.collect_list("n_name")), "\n").alias("t"))
    sha = F.when(F.col("region") == 3, F.sha2(F.lit("other"), 256)).otherwise(F.sha2(F.concat("t", F.lit("\n")), 256))
    listed = files.join(texts, "region").select("file_name", sha.alias("sha256"))
    gone = spark.range(1).select(F.lit("gone").alias("file_name"), F.sha2(F.lit("gone"), 256).alias("sha256"))
    out = verify_artifacts(spark, path, listed.unionByName(gone), folders=True)
    return out.join(files, "file_name", "left").select("region", "expected_sha256", "actual_sha256", "status")


@query("rows_in_date_range", """
    SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey FROM orders
    WHERE o_orderdate BETWEEN DATE '1997-03-01' AND DATE '1998-02-15'""")
def rows_in_date_range(spark, sf):
    o = Tables(spark, sf).orders.select(day_text("o_orderdate").alias("day"), "o_orderkey")
    return filter_by_first_date(o, "1997-03-01", "1998-02-15")


@query("indicator_rows", """
    SELECT strftime(o_orderdate, '%Y-%m-%d') AS time, round(sum(o_totalprice), 2) AS value
    FROM orders WHERE o_orderdate BETWEEN DATE '1999-06-30' - 90 AND DATE '1999-06-30'
    GROUP BY o_orderdate""")
def indicator_rows(spark, sf):
    daily = (Tables(spark, sf).orders.groupBy(day_text("o_orderdate").alias("time"))
             .agg(F.round(F.sum("o_totalprice"), 2).cast("string").alias("RSI")))
    out = indicator_from_csv(daily, "rsi", "1999-06-30", 90)
    return cast_column_types(out, [{"column": "value", "target_type": "float64"},
                                   {"column": "time", "target_type": "string"}])

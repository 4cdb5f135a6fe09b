"""Capacity, inventory, masking and report tables over events as metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtable.operators.capacity import (capacity_assessment, capacity_from_inventory, latest_metrics, matched_processes,
                                          parse_inventory)
from loomtable.operators.masking import mask_table, mask_values
from loomtable.operators.reports import capacity_report_tables, diagnostics_report_tables
from loomtable.operators.statistics import diagnostics_report
from loomtable.plans.suite.base import SQL, Tables, day_text, query, rounded, scratch_folder
from loomtable.sources.exports import export_bundle

# A service per user; an event is a reading of one or two metrics.
_METRICS_SQL = """
    m AS (SELECT 'svc' || user_id AS service, event_id, CASE WHEN user_id % 11 <> 0 THEN strftime(ts, '%Y-%m-%d %H') END AS ts,
                 CASE WHEN user_id % 4 <> 0 AND event_type IN ('click', 'view') THEN 2 + user_id % 9 END AS instances,
                 CASE WHEN event_type IN ('click', 'view', 'error') THEN (20 + (value * 7)::INTEGER % 79) / 100.0::DOUBLE END AS cpu,
                 CASE WHEN event_type IN ('click', 'signup') AND user_id % 5 <> 0
                      THEN (30 + (value * 3)::INTEGER % 69) / 100.0::DOUBLE END AS memory,
                 CASE WHEN user_id % 7 <> 0 THEN value END AS qps
          FROM events)"""


def _metrics(spark, sf):
    e = Tables(spark, sf).events
    u, v = F.col("user_id"), F.col("value")
    whole = lambda k: F.rint(v * k).cast("int")
    kind = F.col("event_type")
    return e.select(
        F.concat(F.lit("svc"), u.cast("string")).alias("service"), "event_id",
        F.when(u % 11 != 0, F.date_format("ts", "yyyy-MM-dd HH")).alias("ts"),
        F.when((u % 4 != 0) & kind.isin("click", "view"), (2 + u % 9).cast("string")).alias("replicas"),
        F.when(kind.isin("click", "view", "error"), F.concat((20 + whole(7) % 79).cast("string"), F.lit("%"))).alias("cpu_usage"),
        F.when(kind.isin("click", "signup") & (u % 5 != 0), (30 + whole(3) % 69) / 100.0).alias("mem_ratio"),
        F.when(u % 7 != 0, v).alias("workload_qps"))


_LATEST_SQL = _METRICS_SQL + """,
    k AS (SELECT *, (CASE WHEN cpu IS NOT NULL OR memory IS NOT NULL THEN 1 ELSE 0 END,
                     coalesce(ts, printf('%020d', event_id)), event_id) AS o,
                 cpu IS NOT NULL OR memory IS NOT NULL OR instances IS NOT NULL OR qps IS NOT NULL AS signal FROM m),
    l AS (SELECT service, max(o) FILTER (WHERE signal) AS o, count(ts) AS timed_rows,
                 count(memory) FILTER (WHERE ts IS NOT NULL) AS mp, count(qps) FILTER (WHERE ts IS NOT NULL) AS wp,
                 arg_min(memory, (ts, event_id)) FILTER (WHERE ts IS NOT NULL AND memory IS NOT NULL) AS m0,
                 arg_max(memory, (ts, event_id)) FILTER (WHERE ts IS NOT NULL AND memory IS NOT NULL) AS m1,
                 arg_min(qps, (ts, event_id)) FILTER (WHERE ts IS NOT NULL AND qps IS NOT NULL) AS w0,
                 arg_max(qps, (ts, event_id)) FILTER (WHERE ts IS NOT NULL AND qps IS NOT NULL) AS w1 FROM k GROUP BY 1),
    now AS (SELECT l.*, k.instances::DOUBLE AS instances, k.cpu, k.memory, k.qps AS workload,
                   CASE WHEN mp >= 2 THEN CASE WHEN m1 - m0 > 1e-12 THEN 'upward' WHEN m1 - m0 < -1e-12 THEN 'downward'
                                               ELSE 'flat' END END AS memory_direction,
                   CASE WHEN mp >= 2 THEN (m1 - m0) / m0 END AS memory_change_rate,
                   CASE WHEN wp >= 2 THEN CASE WHEN w1 - w0 > 1e-12 THEN 'upward' WHEN w1 - w0 < -1e-12 THEN 'downward'
                                               ELSE 'flat' END END AS workload_direction
            FROM l LEFT JOIN k ON k.service = l.service AND k.o = l.o)"""


@query("latest_metrics", "WITH " + _LATEST_SQL + """
    SELECT service, instances, cpu, memory, workload, timed_rows, memory_direction,
           round(memory_change_rate, 6) AS memory_change_rate, workload_direction FROM now""")
def newest_metrics(spark, sf):
    out = latest_metrics(_metrics(spark, sf), "service", "event_id")
    return rounded(out.select("service", "instances", "cpu", "memory", "workload", "timed_rows", "memory_direction",
                              "memory_change_rate", "workload_direction"), ["memory_change_rate"], 6)


def _profiles(spark, sf):
    u = F.col("user_id")
    users = Tables(spark, sf).events.select("user_id").distinct()
    return users.select(
        F.concat(F.when(u % 3 == 0, "other-svc").otherwise("svc"), u.cast("string")).alias("service"),
        F.when(u % 3 == 1, F.when(u % 2 == 0, "core").otherwise("important")).alias("service_tier"),
        F.when(u % 3 == 1, "burst").alias("peak_pattern"), F.when(u % 6 == 1, "critical").alias("failure_impact"),
        F.when(u % 3 == 2, "n_plus_one").alias("redundancy_mode"), F.when(u % 3 == 2, 4).alias("scaling_step"),
        F.when(u % 9 == 2, 12).alias("max_instance_count"), F.when(u % 6 == 2, 5).alias("current_instance_count"))


@query("capacity_assessment", "WITH " + _LATEST_SQL + """,
    pr AS (SELECT DISTINCT 'svc' || user_id AS service, user_id AS u FROM events),
    f AS (SELECT now.*, coalesce(instances, CASE WHEN u % 6 = 2 THEN 5 END) AS cur,
                 CASE WHEN instances IS NOT NULL THEN 'sheet_metric' WHEN u % 6 = 2 THEN 'deployment_profile' END AS instance_source,
                 u % 3 = 1 AS scenario, u % 3 = 2 AS deployment,
                 1.2 * 1.1 * CASE WHEN u % 3 = 1 THEN CASE WHEN u % 2 = 0 THEN 1.10 ELSE 1.05 END * 1.10 ELSE 1 END
                 * CASE WHEN u % 6 = 1 THEN 1.08 ELSE 1 END AS demand,
                 CASE WHEN u % 3 = 2 THEN 1 ELSE 0 END AS extra, CASE WHEN u % 3 = 2 THEN 4 ELSE 1 END AS step,
                 CASE WHEN u % 9 = 2 THEN 12 END AS cap FROM now JOIN pr USING (service)),
    r AS (SELECT *, CASE WHEN cpu <= 0.7 THEN cpu / 0.7 ELSE (cpu / 0.7) ** 1.35 END AS cp,
                 CASE WHEN memory <= 0.75 THEN memory / 0.75 ELSE (memory / 0.75) ** 1.35 END AS mp2,
                 demand * CASE WHEN memory_direction = 'upward'
                               THEN 1 + least(greatest(memory_change_rate, 0), 2) ** 1.1 * 0.25 ELSE 1 END AS md FROM f),
    n AS (SELECT *, CASE WHEN cur > 0 AND cpu IS NOT NULL THEN least(ceil((greatest(ceil(cur * demand * cp), 1) + extra) / step) * step,
                         coalesce(cap, 1e18)) END::BIGINT AS cpu_required,
                 CASE WHEN cur > 0 AND memory IS NOT NULL THEN least(ceil((greatest(ceil(cur * md * mp2), 1) + extra) / step) * step,
                         coalesce(cap, 1e18)) END::BIGINT AS memory_required FROM r),
    z AS (SELECT *, greatest(cpu_required, memory_required) AS rec, round(cur)::BIGINT AS have,
                 concat_ws(',', CASE WHEN cur IS NULL THEN 'instance_count' END, CASE WHEN cpu IS NULL THEN 'cpu' END,
                           CASE WHEN memory IS NULL THEN 'memory' END, CASE WHEN workload IS NULL THEN 'workload' END,
                           CASE WHEN NOT scenario THEN 'scenario_profile' END,
                           CASE WHEN NOT deployment THEN 'deployment_or_inventory' END,
                           CASE WHEN timed_rows = 0 THEN 'time' END) AS missing_inputs FROM n)
    SELECT service, CASE WHEN have IS NULL OR rec IS NULL THEN 'guidance_only'
               WHEN instance_source <> 'sheet_metric' OR cpu IS NULL OR memory IS NULL
                    OR (missing_inputs <> '' AND (scenario OR deployment)) THEN 'partial' ELSE 'quantified' END AS evidence_level,
           CASE WHEN have IS NULL OR rec IS NULL THEN 'unknown' WHEN rec > have THEN 'insufficient' ELSE 'sufficient' END AS capacity_status,
           have AS current_instance_count, rec AS recommended_instance_count,
           CASE WHEN memory_required >= coalesce(cpu_required, 0) THEN 'memory' WHEN cpu_required IS NOT NULL THEN 'cpu' END
           AS limiting_resource, instance_source, memory_required, round(CASE WHEN memory_required IS NOT NULL THEN md END, 6)
           AS memory_demand, round(CASE WHEN memory_required IS NOT NULL THEN mp2 END, 6) AS memory_penalty, missing_inputs FROM z""")
def assessed(spark, sf):
    out = _assessed(spark, sf)
    return rounded(out.select("service", "evidence_level", "capacity_status", "current_instance_count",
                              "recommended_instance_count", "limiting_resource", "instance_source", "memory_required",
                              "memory_demand", "memory_penalty", F.array_join("missing_inputs", ",").alias("missing_inputs")),
                   ["memory_demand", "memory_penalty"], 6)


def _assessed(spark, sf):
    # the CPU readings are percent texts: they give levels but no trend
    return capacity_assessment(_metrics(spark, sf), "service", "event_id", _profiles(spark, sf), growth_rate=0.1,
                               peak_multiplier=1.2)


# Collected outputs per user: host facts and one process line per event.
_OUTPUTS_SQL = """
    o AS (SELECT user_id, 'svc' || user_id AS service, 'host-' || user_id AS hostname, 2 + user_id % 30 AS cores,
                 1000 + user_id AS mem, count(*) FILTER (WHERE event_type IN ('purchase', 'error')) AS hits, count(*) AS n
          FROM events GROUP BY user_id)"""


def _outputs(spark, sf):
    e = Tables(spark, sf).events
    u = F.col("user_id")
    line = F.concat(F.lit("root  1 0 "), F.lpad(F.col("event_id").cast("string"), 9, "0"), F.lit(" /srv/"), F.col("event_type"))
    per = e.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("ps"))
    outputs = {"hostname": F.concat(F.lit(" host-"), u.cast("string"), F.lit("\n")),
               "nproc": F.concat((2 + u % 30).cast("string"), F.lit("\n")),
               "free -m": F.concat(F.lit("       total used\nMem:   "), (1000 + u).cast("string"), F.lit("  20\nSwap: 7 1")),
               "ps -ef": F.concat(F.lit("UID PID\n\n"), F.col("ps"))}
    cells = F.array(*[F.struct(F.lit(c).alias("command"), o.alias("output")) for c, o in outputs.items()])
    return per.select(F.concat(F.lit("svc"), u.cast("string")).alias("service"), u.cast("string").alias("host"),
                      F.explode(cells).alias("x")).select("service", "host", "x.*")


@query("inventory_facts", "WITH " + _OUTPUTS_SQL + """,
    p AS (SELECT user_id, list('root  1 0 ' || printf('%09d', event_id) || ' /srv/' || event_type ORDER BY event_id) AS w
          FROM events GROUP BY 1)
    SELECT user_id::VARCHAR AS host, hostname, cores AS cpu_core_count, mem AS memory_total_mb,
           md5('UID PID' || chr(10) || chr(10) || array_to_string(w[1:10], chr(10))) AS excerpt_md5,
           NULL::VARCHAR AS top_excerpt FROM o JOIN p USING (user_id)""")
def inventory_facts(spark, sf):
    out = parse_inventory(_outputs(spark, sf))
    return out.withColumn("excerpt_md5", F.md5("process_excerpt")).drop("process_excerpt")


@query("matched_processes", "WITH " + _OUTPUTS_SQL + """
    SELECT service, nullif(hits, 0) AS discovered_instance_count FROM o""")
def processes(spark, sf):
    return matched_processes(_outputs(spark, sf), ["/srv/purchase", "/srv/error"], ["service"])


@query("capacity_from_inventory", "WITH " + _LATEST_SQL + "," + _OUTPUTS_SQL + """,
    f AS (SELECT service, coalesce(instances, nullif(hits, 0)) AS cur, cpu, memory,
                 CASE WHEN instances IS NOT NULL THEN 'sheet_metric' WHEN hits > 0 THEN 'inventory_evidence' END AS instance_source,
                 CASE WHEN memory_direction = 'upward' THEN 1 + least(greatest(memory_change_rate, 0), 2) ** 1.1 * 0.25
                      ELSE 1 END AS rise FROM now JOIN o USING (service)),
    r AS (SELECT *, CASE WHEN cur > 0 AND cpu IS NOT NULL THEN greatest(ceil(cur * CASE WHEN cpu <= 0.7 THEN cpu / 0.7
                         ELSE (cpu / 0.7) ** 1.35 END), 1) END::BIGINT AS c,
                 CASE WHEN cur > 0 AND memory IS NOT NULL THEN greatest(ceil(cur * rise * CASE WHEN memory <= 0.75 THEN memory / 0.75
                         ELSE (memory / 0.75) ** 1.35 END), 1) END::BIGINT AS m FROM f)
    SELECT service, instance_source, round(cur)::BIGINT AS current_instance_count, greatest(c, m) AS recommended_instance_count,
           CASE WHEN cur IS NULL OR greatest(c, m) IS NULL THEN 'unknown' WHEN greatest(c, m) > round(cur) THEN 'insufficient'
                ELSE 'sufficient' END AS capacity_status FROM r""")
def from_inventory(spark, sf):
    out = capacity_from_inventory(_metrics(spark, sf), "service", "event_id", _outputs(spark, sf),
                                  ["/srv/purchase", "/srv/error"])
    return out.select("service", "instance_source", "current_instance_count", "recommended_instance_count", "capacity_status")


@query("capacity_tables", f"""
    WITH a AS ({SQL['capacity_assessment']}),
         n AS (SELECT count(*) AS services, sum(CASE WHEN current_instance_count > 0 THEN
                      (NOT list_contains(string_split(missing_inputs, ','), 'cpu'))::INTEGER
                      + (NOT list_contains(string_split(missing_inputs, ','), 'memory'))::INTEGER ELSE 0 END)::BIGINT AS resources,
                      sum(CASE WHEN missing_inputs = '' THEN 1 ELSE len(string_split(missing_inputs, ',')) END)::BIGINT AS todo FROM a)
    SELECT 'conclusion' AS name, 0 AS position, services * 6 AS rows FROM n UNION ALL SELECT 'resources', 1, resources FROM n
    UNION ALL SELECT 'evidence', 2, services * 10 FROM n UNION ALL SELECT 'actions', 3, todo + services FROM n""")
def capacity_tables(spark, sf):
    """Four result tables written as one bundle; how many rows each has."""
    return _bundle_counts(spark, capacity_report_tables(_assessed(spark, sf)))


@query("capacity_table_cells", f"""
    WITH a AS ({SQL['capacity_assessment'].replace("END, 6)", "END, 14)")}),
         c AS (SELECT 'conclusion' AS name, service, unnest(['evidence_level', 'capacity_status', 'current_instance_count', 'recommended_instance_count',
                      'limiting_resource']) AS item, unnest([evidence_level, capacity_status, current_instance_count::VARCHAR,
                      recommended_instance_count::VARCHAR, limiting_resource]) AS value FROM a)
    SELECT name, service, item, coalesce(value, '-') AS value FROM c
    UNION ALL SELECT 'resources', service, 'memory', concat(printf('%.4f', memory_demand), ' ', printf('%.4f', memory_penalty), ' ', memory_required, ' ',
                     CASE WHEN memory_required > current_instance_count THEN 'insufficient' ELSE 'sufficient' END) FROM a WHERE memory_required IS NOT NULL
    UNION ALL SELECT 'actions', service, 'missing_input', unnest(CASE WHEN missing_inputs = '' THEN ['none'] ELSE string_split(missing_inputs, ',') END) FROM a
    UNION ALL SELECT 'actions', service, 'next_step', CASE capacity_status WHEN 'insufficient' THEN 'scale_out' WHEN 'unknown' THEN 'collect_inputs'
                     ELSE 'keep_watching' END FROM a""")
def capacity_table_cells(spark, sf):
    """The cells of the result tables, read back from their bundle."""
    root = scratch_folder(spark)
    export_bundle(capacity_report_tables(_assessed(spark, sf)), root)
    conclusion, resources, actions = (spark.read.parquet(f"{root}/{n}") for n in ("conclusion", "resources", "actions"))
    memory = resources.filter("resource = 'memory'").select(
        F.lit("resources").alias("name"), "service", F.col("resource").alias("item"),
        F.concat_ws(" ", "projected_demand", "saturation_penalty", F.col("required_instances").cast("string"), "status").alias("value"))
    return (conclusion.filter("metric <> 'trend_metrics'").select(F.lit("conclusion").alias("name"), "service", F.col("metric").alias("item"), "value")
            .unionByName(memory).unionByName(actions.select(F.lit("actions").alias("name"), "service", F.col("action").alias("item"), F.col("detail").alias("value"))))


@query("diagnostics_tables", """
    WITH c AS (SELECT corr(l_extendedprice, l_quantity) AS a, corr(l_extendedprice, l_tax) AS b FROM lineitem)
    SELECT 'summary' AS name, 0 AS position, 5::BIGINT AS rows UNION ALL SELECT 'overview', 1, 3
    UNION ALL SELECT 'correlation_outlier', 2, 1 + (a >= 0 OR b >= 0)::INTEGER + (a < 0 OR b < 0)::INTEGER FROM c
    UNION ALL SELECT 'distribution_trend', 3, 1""")
def diagnostics_tables(spark, sf):
    report = diagnostics_report(Tables(spark, sf).lineitem,
                                correlation={"target_column": "l_extendedprice", "feature_columns": ["l_quantity", "l_tax"]},
                                outlier={"columns": ["l_extendedprice"]}, distribution={"column": "l_discount"})
    return _bundle_counts(spark, diagnostics_report_tables(report))


def _bundle_counts(spark, tables):
    root = scratch_folder(spark)
    manifest = export_bundle(tables, root)
    counts = None
    for name in tables:
        one = spark.read.parquet(f"{root}/{name}").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"))
        counts = one if counts is None else counts.unionByName(one)
    return manifest.select("position", "name").join(counts, "name")


_MASK_RULES = {
    "orders": [{"column": "o_custkey", "kind": "token", "purpose": "customer", "prefix": "c-"},
               {"column": "o_orderdate", "kind": "shift_date", "key": "o_custkey", "purpose": "days", "span": 20},
               {"column": "o_totalprice", "kind": "scale_number", "key": "o_custkey", "purpose": "money", "spread": 0.1, "digits": 6},
               {"column": "o_orderpriority", "kind": "word", "purpose": "level"}],
    "customer": [{"column": "c_custkey", "kind": "token", "purpose": "customer", "prefix": "c-"},
                 {"column": "c_name", "kind": "token"}]}
_DRAW = "('0x' || substr(sha256('pepper|{}|' || {}), 1, 15))::BIGINT % {}"


@query("masked_orders", f"""
    WITH v AS (SELECT p_brand AS word, row_number() OVER (ORDER BY p_brand) - 1 AS n FROM (SELECT DISTINCT p_brand FROM part)),
         o AS (SELECT 'c-' || substr(sha256('pepper|customer|' || o_custkey), 1, 16) AS customer,
                      o_orderdate::DATE + ({_DRAW.format('days', 'o_custkey', 41)} - 20)::INTEGER AS day,
                      round(o_totalprice * (1 + ({_DRAW.format('money', 'o_custkey', 2001)} - 1000) / 1000 * 0.1), 6) AS price,
                      {_DRAW.format('level', 'o_orderpriority', '(SELECT count(*) FROM v)')} AS k FROM orders),
         c AS (SELECT 'c-' || substr(sha256('pepper|customer|' || c_custkey), 1, 16) AS customer,
                      substr(sha256('pepper|c_name|' || c_name), 1, 16) AS name, c_mktsegment FROM customer)
    SELECT o.customer, name, c_mktsegment, strftime(min(day), '%Y-%m-%d') AS first_day, round(sum(price), 0) AS total,
           count(DISTINCT word) AS levels, count(*) AS orders
    FROM o JOIN v ON v.n = o.k JOIN c ON c.customer = o.customer GROUP BY ALL""")
def masked_orders(spark, sf):
    """Both tables masked on their own; the join on the masked key still holds."""
    t = Tables(spark, sf)
    words = t.part.select("p_brand").distinct()
    o = mask_values(t.orders.select("o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority"), _MASK_RULES["orders"], "pepper", words)
    c = mask_values(t.customer.select("c_custkey", "c_name", "c_mktsegment"), _MASK_RULES["customer"], "pepper")
    return (o.join(c, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.col("o_custkey").alias("customer"), F.col("c_name").alias("name"), "c_mktsegment")
            .agg(day_text(F.min("o_orderdate")).alias("first_day"), F.round(F.sum("o_totalprice"), 0).alias("total"),
                 F.count_distinct("o_orderpriority").alias("levels"), F.count("*").alias("orders")))


def _permuted_sql(text: str, purpose: str, leading: bool) -> str:
    """The text after four rounds, as nested selects of its halves."""
    def shifted(half: str, other: str, turn: int, first: bool) -> str:
        by = f"('0x' || substr(sha256('pepper|{purpose}|{turn}|' || {other}), ((i - 1) * 2) % 60 + 1, 4))::INTEGER"
        lead = f"WHEN i = 1 AND c BETWEEN '1' AND '9' THEN chr((ord(c) - 49 + {by}) % 9 + 49) WHEN i = 1 THEN c" if leading and first else ""
        blocks = " ".join(f"WHEN ord(c) BETWEEN {a} AND {a + n - 1} THEN chr((ord(c) - {a} + {by}) % {n} + {a})" for a, n in ((48, 10), (65, 26), (97, 26)))
        return f"list_aggregate(list_transform(string_split({half}, ''), lambda c, i: CASE {lead} {blocks} ELSE c END), 'string_agg', '')"

    sql = f"SELECT substr(t, 1, ceil(length(t) / 2)::INTEGER) AS a, substr(t, ceil(length(t) / 2)::INTEGER + 1) AS b FROM (SELECT {text} AS t)"
    for turn in (1, 2, 3, 4):
        new = (f"{shifted('a', 'b', turn, True)} AS a, b" if turn % 2 else f"a, coalesce({shifted('b', 'a', turn, False)}, '') AS b")
        sql = f"SELECT {new} FROM ({sql})"
    return f"(SELECT a || b FROM ({sql}))"


@query("masked_customers", f"""
    SELECT {_permuted_sql('c_custkey::VARCHAR', 'customer', True)}::BIGINT AS c_custkey, {_permuted_sql('c_name', 'c_name', False)} AS c_name,
           c_nationkey, {_permuted_sql('c_mktsegment', 'c_mktsegment', False)} AS c_mktsegment FROM customer""")
def masked_customers(spark, sf):
    """A table masked without naming its columns; only the nation is kept."""
    t = Tables(spark, sf)
    return mask_table(t.customer, "pepper", ["c_nationkey"], {"c_custkey": "customer"}).select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query("masked_keys_join", """
    SELECT c_mktsegment, count(*) AS orders, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderkey) AS keys
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def masked_keys_join(spark, sf):
    """Two tables masked on their own: joins hold, and different keys stay different."""
    t = Tables(spark, sf)
    c = mask_table(t.customer.select("c_custkey", "c_mktsegment"), "pepper", ["c_mktsegment"], {"c_custkey": "customer"})
    o = mask_table(t.orders, "pepper", [], {"o_custkey": "customer"})
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(
        F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderkey").alias("keys"))

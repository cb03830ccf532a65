"""Changes of tables, generated columns, time to live, and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightloom.operators import dml, stats
from brightloom.plans.registry import Tables, query

_O = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


def _orders(t: Tables):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 100, n_name || '_new' FROM nation WHERE n_regionkey = 1")
def insert_select(t: Tables):
    new = t.nation.filter("n_regionkey = 1").select((F.col("n_nationkey") + 100).alias("n_nationkey"), F.concat("n_name", F.lit("_new")).alias("n_name"))
    return dml.insert(t.nation.select("n_nationkey", "n_name"), new, ["n_nationkey"])


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN round(o_totalprice * 1.1, 4) ELSE o_totalprice END AS o_totalprice FROM orders")
def update_expr(t: Tables):
    return dml.update(_orders(t), F.col("o_orderstatus") == "P", {"o_totalprice": F.round(F.col("o_totalprice") * 1.1, 4)})


@query("SELECT o_orderkey, o_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def update_join(t: Tables):
    other = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return dml.update_join(_orders(t), other, ["o_custkey"], {"o_orderstatus": F.lit("B")}, F.col("c_mktsegment") == "BUILDING")


@query(f"{_O} WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_subq(t: Tables):
    poor = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return dml.delete_matching(_orders(t), poor, ["o_custkey"])


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice <= 300000 OR o_totalprice IS NULL")
def delete_where(t: Tables):
    return dml.delete(_orders(t), F.col("o_totalprice") > 300000)


_NEW = "SELECT o_orderkey * 2 AS o_orderkey, o_custkey, 'N' AS o_orderstatus, 1.0 AS o_totalprice FROM orders WHERE o_orderkey % 10 = 0"


def _new(t: Tables):
    return _orders(t).filter("o_orderkey % 10 = 0").select((F.col("o_orderkey") * 2).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"))


@query(f"WITH new AS ({_NEW}) {_O} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new) UNION ALL SELECT * FROM new")
def replace_into(t: Tables):
    return dml.replace(_orders(t), _new(t), ["o_orderkey"])


@query(f"WITH new AS ({_NEW}) SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(o.o_custkey, n.o_custkey) AS o_custkey, coalesce(o.o_orderstatus, n.o_orderstatus) AS o_orderstatus, "
       "CASE WHEN o.o_orderkey IS NULL THEN n.o_totalprice WHEN n.o_orderkey IS NULL THEN o.o_totalprice ELSE round(o.o_totalprice + n.o_totalprice, 2) END AS o_totalprice FROM orders o FULL JOIN new n ON o.o_orderkey = n.o_orderkey")
def upsert_iodku(t: Tables):
    return dml.upsert(_orders(t), _new(t), ["o_orderkey"], {"o_totalprice": F.round(F.col("o_totalprice") + F.col("new_o_totalprice"), 2)})


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def update_subq(t: Tables):
    return dml.update_in(_orders(t), "o_custkey", t.customer.filter("c_acctbal < 0").select("c_custkey"), {"o_orderstatus": F.lit("X")})


@query(f"{_O} WHERE NOT coalesce(o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0), false)")
def delete_not_in(t: Tables):
    return dml.delete_not_in(_orders(t), "o_custkey", t.customer.filter("c_acctbal > 0").select("c_custkey"))


@query(f"{_O}")
def delete_not_in_null(t: Tables):
    keys = t.customer.select(F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).alias("k"))
    return dml.delete_not_in(_orders(t), "o_custkey", keys)


# two unique keys: the order's own, and the customer with the status
_TWO = "SELECT min(o_orderkey) AS k, o_custkey AS c, o_orderstatus AS s, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 2, 3"
_TWO_NEW = "SELECT k + 1 AS k, c, CASE WHEN k % 3 = 0 THEN s ELSE 'Z' END AS s, 100 + n AS n, k AS o FROM t WHERE k % 5 = 0"


def _two(t: Tables):
    return t.orders.groupBy(F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s")).agg(F.min("o_orderkey").alias("k"), F.count("*").alias("n")).select("k", "c", "s", "n")


def _two_new(two):
    return two.filter("k % 5 = 0").selectExpr("k + 1 as k", "c", "case when k % 3 = 0 then s else 'Z' end as s", "100 + n as n", "k as o")


@query(f"WITH t AS ({_TWO}), new AS ({_TWO_NEW}) SELECT k, c, s, n FROM t WHERE k NOT IN (SELECT k FROM new) AND (c, s) NOT IN (SELECT (c, s) FROM new) "
       "UNION ALL SELECT k, c, s, n FROM new WHERE o = (SELECT max(x.o) FROM new x WHERE x.k = new.k) AND o = (SELECT max(x.o) FROM new x WHERE x.c = new.c AND x.s = new.s)")
def replace_two_keys(t: Tables):
    two = _two(t)
    return dml.replace(two, _two_new(two), [["k"], ["c", "s"]], "o")


@query(f"WITH t AS ({_TWO}), new AS (SELECT CASE WHEN k % 2 = 0 THEN k ELSE k + 100000000 END AS k, c, s, 100 AS n FROM t WHERE k % 5 = 0), fresh AS (SELECT c + 1000000 AS c, k + 200000000 AS k, s, 100 AS n FROM t WHERE k % 7 = 0) "
       "SELECT t.k, t.c, t.s, CASE WHEN new.k IS NOT NULL THEN t.n + 100 ELSE t.n END AS n FROM t LEFT JOIN new ON t.c = new.c AND t.s = new.s UNION ALL SELECT k, c, s, n FROM fresh")
def upsert_two_keys(t: Tables):
    two = _two(t)
    met = two.filter("k % 5 = 0").selectExpr("case when k % 2 = 0 then k else k + 100000000 end as k", "c", "s", "100L as n")
    fresh = two.filter("k % 7 = 0").selectExpr("k + 200000000 as k", "c + 1000000 as c", "s", "100L as n")
    return dml.upsert(two, met.unionByName(fresh), [["k"], ["c", "s"]], {"n": F.col("n") + F.col("new_n")})


@query("WITH b AS (SELECT o_custkey AS k, count(*) AS times FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1), t AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer WHERE c_custkey % 2 = 0) "
       "SELECT coalesce(t.k, b.k) AS k, CAST(CASE WHEN t.k IS NULL THEN 1 + 10 * (times - 1) WHEN b.k IS NULL THEN n ELSE n + 10 * times END AS BIGINT) AS n FROM t FULL JOIN b ON t.k = b.k")
def upsert_repeated(t: Tables):
    batch = t.orders.filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("k"), F.lit(1).cast("long").alias("n"), F.col("o_orderkey").alias("o"))
    table = t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("n"))
    return dml.upsert(table, batch, ["k"], {"n": F.col("n") + 10}, "o")


@query("WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN c_custkey * 3 END AS given FROM customer), n AS (SELECT *, sum(CASE WHEN given IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY c_custkey) AS k FROM a) "
       "SELECT c_custkey, CAST(coalesce(given, k + greatest(1000, coalesce(max(given - k) OVER (ORDER BY c_custkey), 0))) AS BIGINT) AS id FROM n")
def auto_increment_jump(t: Tables):
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 50 == 0, F.col("c_custkey") * 3).alias("id"))
    return dml.auto_increment(rows, "id", ["c_custkey"], 1000)


def _second(ts: str):
    """The nearest whole second of a time, halves to the even one, as epoch(ts)::BIGINT gives it."""
    return F.timestamp_seconds(F.rint(F.unix_micros(F.col(ts).cast("timestamp")) / 1000000).cast("long"))


@query("SELECT event_id FROM events WHERE event_type = 'click' OR epoch(ts)::BIGINT + 1296000 > epoch(TIMESTAMP '2024-01-20')::BIGINT")
def ttl_after_update(t: Tables):
    kept = dml.with_ttl(t.events, _second("ts"), table_ttl=1296000)
    renewed = dml.update_ttl(kept, F.col("event_type") == "click", {"value": F.lit(0.0)}, F.lit("2024-01-19").cast("timestamp"), table_ttl=1296000)
    return dml.visible(renewed, F.lit("2024-01-20").cast("timestamp")).select("event_id")


@query("SELECT c_name, 1000 + row_number() OVER (ORDER BY c_custkey) AS id FROM customer WHERE c_acctbal > 5000")
def auto_increment(t: Tables):
    return dml.auto_increment(t.customer.filter("c_acctbal > 5000").select("c_name", "c_custkey"), "id", ["c_custkey"], 1000).select("c_name", F.col("id").cast("long").alias("id"))


@query("SELECT event_id FROM events WHERE event_type = 'purchase' OR epoch(ts)::BIGINT + CASE WHEN event_type = 'click' THEN 864000 ELSE 1296000 END > epoch(TIMESTAMP '2024-01-20')::BIGINT")
def ttl_visible(t: Tables):
    own = t.events.withColumn("ttl", F.when(F.col("event_type") == "click", 864000).otherwise(0))
    kept = dml.with_ttl(own.filter("not event_type <=> 'purchase'"), _second("ts"), table_ttl=1296000, row_ttl="ttl")
    forever = dml.with_ttl(own.filter("event_type = 'purchase'"), F.col("ts"))
    return dml.visible(kept.unionByName(forever), F.lit("2024-01-20").cast("timestamp")).select("event_id")


@query(f"{_O} WHERE false")
def truncate(t: Tables):
    return dml.truncate(_orders(t))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(t: Tables):
    return dml.violations(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey < 10 THEN 99 WHEN n_nationkey < 20 THEN n_regionkey ELSE NULL END AS extra FROM nation")
def add_column_default(t: Tables):
    rows = t.nation.select("n_nationkey", "n_name", F.when(F.col("n_nationkey").between(10, 19), F.col("n_regionkey")).alias("extra"), F.when(F.col("n_nationkey") < 10, 1).otherwise(2).alias("v"))
    return dml.add_column(rows, "extra", F.lit(99), F.col("v"), 2).drop("v")


@query("SELECT r_regionkey AS id, r_name FROM region")
def rename_column(t: Tables):
    return t.region.withColumnRenamed("r_regionkey", "id")


@query("SELECT n_nationkey, n_name FROM nation")
def drop_column(t: Tables):
    return t.nation.drop("n_regionkey")


@query("SELECT l_orderkey, l_partkey, round(l_quantity * l_extendedprice, 2) AS total, round(l_quantity * l_extendedprice * (1 + l_tax), 5) AS taxed, concat(l_returnflag, '-', l_linestatus) AS tag FROM lineitem")
def generated_cols(t: Tables):
    rows = dml.generated(t.lineitem, {
        "raw": F.col("l_quantity") * F.col("l_extendedprice"), "total": F.round("raw", 2), "taxed": F.round(F.col("raw") * (1 + F.col("l_tax")), 5),
        "tag": F.concat("l_returnflag", F.lit("-"), "l_linestatus")})
    return rows.select("l_orderkey", "l_partkey", "total", "taxed", "tag")


@query("SELECT 'o_custkey' AS columns, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_distinct, greatest(count(*) // count(DISTINCT o_custkey), 1) AS rec_per_key FROM orders UNION ALL "
       "SELECT 'o_custkey,o_orderpriority', count(*), count(DISTINCT (o_custkey, o_orderpriority)), greatest(count(*) // count(DISTINCT (o_custkey, o_orderpriority)), 1) FROM orders")
def analyze_rec_per_key(t: Tables):
    return stats.rec_per_key(t.orders, ["o_custkey", "o_orderpriority"])


@query("SELECT greatest(count(*), 1) AS n_rows FROM orders WHERE o_custkey BETWEEN 10 AND 40")
def range_estimate_exact(t: Tables):
    return stats.range_count(t.orders, F.col("o_custkey").between(10, 40))


_HIST = ("SELECT event_type, count(*) AS calls, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, "
         "round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max, round(sum(value), 2) AS total FROM events{} GROUP BY 1")


@query(_HIST.format(""))
def perf_histogram(t: Tables):
    h = stats.histogram(t.events, "event_type", "value")
    return h.select("event_type", "calls", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")), "max", F.round("total", 2).alias("total"))


@query(f"WITH a AS ({_HIST.format(' WHERE event_id % 2 = 0')}), b AS ({_HIST.format(' WHERE event_id % 2 = 1')}) SELECT coalesce(a.event_type, b.event_type) AS event_type, "
       "greatest(coalesce(a.calls, 0), coalesce(b.calls, 0)) AS calls, round(coalesce(b.p50, 0) - coalesce(a.p50, 0), 4) AS d_p50, round(coalesce(b.p99, 0) - coalesce(a.p99, 0), 4) AS d_p99, "
       "round(coalesce(b.total, 0) - coalesce(a.total, 0), 2) AS d_total FROM a FULL JOIN b ON a.event_type = b.event_type")
def perf_diff(t: Tables):
    a, b = (stats.histogram(t.events.filter(F.col("event_id") % 2 == k), "event_type", "value") for k in (0, 1))
    d = stats.difference(a, b, "event_type")
    return d.select("event_type", "calls", F.round("d_p50", 4).alias("d_p50"), F.round("d_p99", 4).alias("d_p99"), F.round("d_total", 2).alias("d_total"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(t: Tables):
    from brightloom.streaming import windows

    return windows.windowed(t.events, "ts", "1 day", "1 hour", "event_type").select("start", "event_type", "n")

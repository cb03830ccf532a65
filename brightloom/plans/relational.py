"""Scans, filters, joins, subqueries, aggregates, sorts, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brightloom.functions import dialect
from brightloom.operators import multirange, subquery
from brightloom.plans.registry import Tables, query

# --- scans


@query("SELECT * FROM nation")
def scan_full(t: Tables):
    return t.nation


@query("SELECT * FROM orders WHERE o_orderkey = 77")
def pk_point(t: Tables):
    return t.orders.filter("o_orderkey = 77")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 100")
def pk_prefix(t: Tables):
    return t.lineitem.filter("l_orderkey = 100").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 180")
def pk_range(t: Tables):
    return t.orders.filter(F.col("o_orderkey").between(100, 180)).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000")
def range_gt(t: Tables):
    return t.customer.filter("c_acctbal > 9000").select("c_custkey", "c_acctbal")


@query("SELECT o_custkey, max(o_orderkey) AS last_order, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY o_custkey")
def reverse_top1(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last_order"), F.max_by("o_totalprice", "o_orderkey").alias("last_price"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey <= 50 ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 1")
def reverse_seek(t: Tables):
    return t.orders.filter("o_custkey <= 50").select("o_orderkey", "o_custkey").orderBy(F.desc("o_custkey"), F.desc("o_orderkey")).limit(1)


@query("SELECT min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders")
def index_first_last(t: Tables):
    return t.orders.agg(F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (3, 5, 8, 13, 21, 34, 55, 89, 144, 999999)")
def mrr_in_list(t: Tables):
    return t.part.filter(F.col("p_partkey").isin(3, 5, 8, 13, 21, 34, 55, 89, 144, 999999)).select("p_partkey", "p_name")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size % 7 = 0)")
def mrr_keys(t: Tables):
    keys = t.part.filter("p_size % 7 = 0").select("p_partkey")
    return multirange.in_keys(t.lineitem, {"l_partkey": "p_partkey"}, keys).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 0 AND o_totalprice BETWEEN c_acctbal * 30 AND c_acctbal * 30 + 500)")
def mrr_ranges(t: Tables):
    ranges = t.customer.filter("c_acctbal > 0").select((F.col("c_acctbal") * 30).alias("lo"), (F.col("c_acctbal") * 30 + 500).alias("hi"))
    return multirange.in_ranges(t.orders, "o_totalprice", ranges).select("o_orderkey", "o_totalprice")


@query("SELECT p_brand, p_size FROM part WHERE p_size > 40")
def covering_projection(t: Tables):
    return t.part.filter("p_size > 40").select("p_brand", "p_size")


@query("SELECT 'orders' AS table_name, count(*) AS row_count, 6 AS column_count FROM orders")
def table_status(t: Tables):
    from brightloom.sources import tables

    return tables.table_stats(t.orders, "orders", f"{t.directory}/orders.parquet").select("table_name", "row_count", "column_count")


# --- filters


@query("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000")
def between(t: Tables):
    return t.orders.filter(F.col("o_totalprice").between(100000, 150000)).select("o_orderkey")


@query("SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)")
def in_list(t: Tables):
    return t.nation.filter(F.col("n_regionkey").isin(1, 3)).select("n_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%'")
def like_ci(t: Tables):
    return t.part.filter(dialect.like_ci(F.col("p_name"), "%RED%")).select("p_partkey", "p_name")


@query("SELECT c_custkey, CAST(o_orderkey IS NULL AS INT) AS no_order FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def is_null_flag(t: Tables):
    first = t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return t.customer.join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", dialect.flag(F.col("o_orderkey").isNull()).alias("no_order"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'high' WHEN c_acctbal > 0 THEN 'low' ELSE 'none' END AS band FROM customer")
def case_when(t: Tables):
    return t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 5000, "high").when(F.col("c_acctbal") > 0, "low").otherwise("none").alias("band"))


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-04-01' AND l_partkey % 7 = 3 AND NOT l_returnflag = 'R'")
def icp_combo(t: Tables):
    return t.lineitem.filter("l_shipdate >= timestamp'1998-01-01' and l_shipdate < timestamp'1998-04-01' and l_partkey % 7 = 3 and not l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_quantity")


# --- joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def inner(t: Tables):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
def left_on_cond(t: Tables):
    return t.customer.join(t.orders, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_totalprice") > 400000), "left").select("c_custkey", "o_orderkey")


@query("SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
def right(t: Tables):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "right").select("o_orderkey", "c_custkey")


@query("SELECT coalesce(s_nationkey, c_nationkey) AS nationkey, suppliers, customers FROM (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) "
       "FULL JOIN (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_acctbal < 0 GROUP BY 1) ON s_nationkey = c_nationkey")
def full_outer(t: Tables):
    a = t.supplier.filter("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    b = t.customer.filter("c_acctbal < 0").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return a.join(b, F.col("s_nationkey") == F.col("c_nationkey"), "full_outer").select(F.coalesce("s_nationkey", "c_nationkey").alias("nationkey"), "suppliers", "customers")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey = n_regionkey")
def cross_where(t: Tables):
    return t.region.crossJoin(t.nation).filter("r_regionkey = n_regionkey").select("r_name", "n_name")  # planned as an equi-join


@query("SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey")
def comma_join(t: Tables):
    return t.sql("select s_name, n_name from {supplier}, {nation} where s_nationkey = n_nationkey", "supplier", "nation")


@query("SELECT n_name, count(*) AS n_items, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM nation JOIN customer ON n_nationkey = c_nationkey "
       "JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY n_name")
def chain4(t: Tables):
    items = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))  # before the joins
    met = t.nation.join(t.customer, F.col("n_nationkey") == F.col("c_nationkey")).join(t.orders, F.col("c_custkey") == F.col("o_custkey")).join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    return met.groupBy("n_name").agg(F.sum("n").alias("n_items"), F.round(F.sum("r"), 4).alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_group(t: Tables):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))


@query("SELECT a.s_suppkey AS low_key, b.s_suppkey AS high_key FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def self_theta(t: Tables):
    a, b = t.supplier.alias("a"), t.supplier.alias("b")
    return a.join(b, F.expr("a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey")).select(F.col("a.s_suppkey").alias("low_key"), F.col("b.s_suppkey").alias("high_key"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_in(t: Tables):
    return t.customer.join(t.orders.filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def semi_exists(t: Tables):
    return t.customer.join(t.orders.filter("o_totalprice > 450000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_not_exists(t: Tables):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def not_in_plain(t: Tables):
    return subquery.not_in(t.customer, "c_custkey", t.orders.select("o_custkey")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders UNION ALL SELECT NULL)")
def not_in_null_aware(t: Tables):
    values = t.orders.select(F.nullif("o_custkey", F.lit(1)).alias("k")).union(t.spark.range(1).select(F.lit(None).cast("long")))
    return subquery.not_in(t.customer, "c_custkey", values).select("c_custkey")


# --- subqueries


@query("SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 2) AS above FROM orders")
def scalar_diff(t: Tables):
    return t.orders.crossJoin(F.broadcast(t.orders.agg(F.avg("o_totalprice").alias("m")))).select("o_orderkey", F.round(F.col("o_totalprice") - F.col("m"), 2).alias("above"))


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def correlated_max(t: Tables):
    return t.sql("select o_orderkey, o_custkey from {orders} o where o_totalprice = (select max(o_totalprice) from {orders} i where i.o_custkey = o.o_custkey)", "orders")


@query("SELECT o_orderpriority, n FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) WHERE n > 10")
def derived(t: Tables):
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")).filter("n > 10")


@query("SELECT round(max(m), 4) AS max_avg FROM (SELECT c_mktsegment, avg(c_acctbal) AS m FROM customer GROUP BY 1)")
def max_of_avg(t: Tables):
    return t.customer.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("m")).agg(F.round(F.max("m"), 4).alias("max_avg"))


def _quantified(name: str, function, word: str, where: str):
    sql = f"SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > {word} (SELECT s_acctbal FROM supplier WHERE {where})"

    def run(t: Tables):
        return function(t.customer, F.col("c_acctbal"), t.supplier.filter(where).select("s_acctbal")).select("c_custkey", "c_acctbal")

    run.__name__ = name
    query(sql)(run)


_quantified("gt_all", subquery.greater_than_all, "ALL", "s_nationkey < 3")
_quantified("gt_any", subquery.greater_than_any, "ANY", "s_nationkey < 3")
_quantified("gt_all_empty", subquery.greater_than_all, "ALL", "s_nationkey < 0")
_quantified("gt_any_empty", subquery.greater_than_any, "ANY", "s_nationkey < 0")

# --- aggregates


@query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem")
def global_agg(t: Tables):
    return t.lineitem.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_extendedprice"), 4).alias("price"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(avg(l_discount), 6) AS disc FROM lineitem GROUP BY 1, 2")
def group_agg(t: Tables):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("disc"))


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 HAVING count(*) >= 5 AND sum(o_totalprice) > 1000000")
def having(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s")).filter("n >= 5 and s > 1000000").select("o_custkey", "n", F.round("s", 2).alias("total"))


@query("SELECT count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem")
def count_distinct(t: Tables):
    return t.lineitem.agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct(t: Tables):
    return t.part.select("p_brand", "p_type").distinct()


@query("SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def group_concat(t: Tables):
    return t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(dialect.group_concat(F.col("n_name"), ", ").alias("nations"))


@query("SELECT CAST(year(o_orderdate) AS INT) AS yr, count(*) AS n FROM orders GROUP BY 1")
def group_by_year(t: Tables):
    return t.orders.groupBy(F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(nullif(o_orderstatus, 'F')) AS not_f FROM orders")
def count_nulls(t: Tables):
    return t.orders.agg(F.count("*").alias("n"), F.count(F.nullif("o_orderstatus", F.lit("F"))).alias("not_f"))


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
def rollup(t: Tables):
    return t.customer.rollup("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))


# --- windows (host capability)


@query("SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, "
       "lag(o_totalprice) OVER w AS prev, lead(o_totalprice) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def window_ranks(t: Tables):
    w, p = Window.partitionBy("o_custkey").orderBy("o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return t.orders.select("o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(p).cast("long").alias("rk"), F.dense_rank().over(p).cast("long").alias("dr"),
                           F.lag("o_totalprice").over(w).alias("prev"), F.lead("o_totalprice").over(w).alias("next"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS running FROM events")
def window_running_sum(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.round(F.sum("value").over(w), 2).alias("running"))


# --- sorts and set operations


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 100")
def order_multi(t: Tables):
    return t.customer.select("c_custkey", "c_mktsegment", "c_acctbal").orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey").limit(100)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def limit_offset(t: Tables):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(20)


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t: Tables):
    return t.customer.filter("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT * FROM (SELECT o_orderkey AS k, o_totalprice AS v FROM orders ORDER BY v DESC, k LIMIT 5) UNION ALL SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2, 1 LIMIT 5)")
def union_limited_branches(t: Tables):
    o = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return o.orderBy(F.desc("v"), "k").limit(5).union(o.orderBy("v", "k").limit(5)).orderBy("v", "k")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def except_(t: Tables):
    return t.nation.select(F.col("n_nationkey").alias("k")).subtract(t.supplier.filter("s_acctbal > 0").select("s_nationkey"))


# --- scalar functions


@query("SELECT p_partkey, concat(p_name, '/', p_brand) AS c, upper(p_name) AS u, CAST(strlen(p_name) AS INT) AS b, substring(p_name, 2, 4) AS s, repeat(p_brand, 2) AS r, CAST(strpos(p_name, 'e') AS INT) AS l, hex(p_type) AS h FROM part")
def string_fns(t: Tables):
    return t.part.select("p_partkey", F.concat("p_name", F.lit("/"), "p_brand").alias("c"), F.upper("p_name").alias("u"), dialect.length_bytes(F.col("p_name")).alias("b"), F.substring("p_name", 2, 4).alias("s"),
                         F.repeat("p_brand", 2).alias("r"), F.locate("e", "p_name").alias("l"), F.hex("p_type").alias("h"))


@query("SELECT l_orderkey, l_partkey, round(l_extendedprice * l_discount, 6) AS d, round(l_extendedprice / l_quantity, 9) AS unit, l_partkey % 7 AS m, CAST(floor(l_quantity) AS BIGINT) AS f, round(pi() * l_quantity, 6) AS p FROM lineitem")
def math_fns(t: Tables):
    return t.lineitem.select("l_orderkey", "l_partkey", F.round(F.col("l_extendedprice") * F.col("l_discount"), 6).alias("d"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 9).alias("unit"),
                             (F.col("l_partkey") % 7).alias("m"), F.floor("l_quantity").alias("f"), F.round(F.pi() * F.col("l_quantity"), 6).alias("p"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(epoch(o_orderdate) AS BIGINT) AS unix, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS days FROM orders")
def date_fns(t: Tables):
    return t.orders.select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.unix_timestamp("o_orderdate").alias("unix"),
                           F.expr("timestampdiff(DAY, timestamp'1992-01-01', o_orderdate)").alias("days"))


@query("SELECT o_orderkey, nullif(o_orderstatus, 'O') AS n, coalesce(nullif(o_orderstatus, 'O'), 'open') AS c, if(o_totalprice > 200000, 'big', 'small') AS i, ifnull(nullif(o_custkey, 1), -1) AS f FROM orders")
def null_fns(t: Tables):
    return t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("n"), F.coalesce(F.nullif("o_orderstatus", F.lit("O")), F.lit("open")).alias("c"),
                           F.expr("if(o_totalprice > 200000, 'big', 'small')").alias("i"), F.ifnull(F.nullif("o_custkey", F.lit(1)), F.lit(-1)).alias("f"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_value(t: Tables):
    return t.events.select("event_id", dialect.json_value(F.col("props"), "$.k").cast("int").alias("k"))


@query("SELECT event_id, CAST(len(json_keys(props)) AS INT) AS n, json_type(props) AS kind FROM events")
def json_length(t: Tables):
    return t.events.select("event_id", dialect.json_length(F.col("props")).alias("n"), dialect.json_type(F.col("props")).alias("kind"))


@query("SELECT event_id, json_extract(props, '$.k')::VARCHAR AS k, (json_extract(props, '$.k')::VARCHAR = '7') AS has, json_object('k', event_id, 'n', json_extract(props, '$.k'))::VARCHAR AS changed FROM events")
def json_change(t: Tables):
    doc = F.col("props")
    changed = dialect.json_set(dialect.json_set(doc, "$.n", F.get_json_object(doc, "$.k").cast("long")), "$.k", F.col("event_id"))
    return t.events.select("event_id", dialect.json_extract(doc, "$.k").alias("k"), dialect.json_contains(doc, "7", "$.k").alias("has"), F.regexp_replace(changed, " ", "").alias("changed"))


@query("SELECT c_nationkey, string_agg(c_mktsegment, ';' ORDER BY c_acctbal DESC, c_mktsegment DESC) AS by_balance, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY 1")
def group_concat_ordered(t: Tables):
    return t.customer.groupBy("c_nationkey").agg(
        dialect.group_concat(F.col("c_mktsegment"), ";", F.col("c_acctbal"), descending=True).alias("by_balance"), dialect.group_concat(F.col("c_mktsegment"), distinct=True).alias("segments"))


@query("SELECT page_id, split_part(url, '/', 1) || '/' || split_part(url, '/', 2) || '/' || split_part(url, '/', 3) AS site FROM pages")
def substring_index(t: Tables):
    return t.pages.select("page_id", F.substring_index("url", "/", 3).alias("site"))


@query("SELECT p_partkey, CAST(list_position(['ECONOMY', 'STANDARD', 'PROMO'], p_type) AS INT) AS place FROM (SELECT p_partkey, p_type FROM part WHERE p_type IN ('ECONOMY', 'STANDARD', 'PROMO'))")
def find_in_set(t: Tables):
    return t.part.select("p_partkey", F.find_in_set("p_type", F.lit("ECONOMY,STANDARD,PROMO")).alias("place")).filter("place > 0")

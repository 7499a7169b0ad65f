"""A query for each of the library's own operators over the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import parsing, scalars, stats
from weftline.operators import categorical, columns, joins, missing, modelling, reductions, reshape, rolling, rows, sets
from weftline.plans.order import ROW_ID, with_row_ids
from weftline.sources import readers, writers

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None):
    def add(fn):
        Q[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def r6(x):
    return F.round(x, 6)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({x: F.round(F.col(f"`{x}`"), digits) for x in cols})


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 8) AS avg_disc, count(DISTINCT l_suppkey) AS n_supp FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(s, d):
    li = t(s, d, "lineitem").withColumn("disc_price", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    out = reductions.group_by_column_agg(["l_returnflag", "l_linestatus"], {"n": reductions.row_count(), "sum_qty": reductions.sum("l_quantity"), "revenue": reductions.sum("disc_price"), "avg_disc": reductions.mean("l_discount"), "n_supp": reductions.count_distinct("l_suppkey")}, li, F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return out.withColumns({"sum_qty": F.round("sum_qty", 4), "revenue": F.round("revenue", 2), "avg_disc": F.round("avg_disc", 8)})


@query("SELECT * FROM lineitem WHERE l_quantity > 45")
def filter_column(s, d):
    return rows.filter_column(t(s, d, "lineitem"), "l_quantity", lambda x: x > 45)


@query("SELECT * FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
def filter_rows(s, d):
    return rows.filter_rows(t(s, d, "orders"), "o_totalprice > 100000 AND o_orderstatus = 'O'")


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders")
def select_rename(s, d):
    return columns.select(t(s, d, "orders"), {"o_orderkey": "id", "o_totalprice": "price"})


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def select_numeric(s, d):
    from weftline.operators import selectors

    return selectors.numeric(t(s, d, "part"))


@query("SELECT p_name, p_brand, p_type FROM part")
def select_categorical(s, d):
    from weftline.operators import selectors

    return selectors.categorical(t(s, d, "part"))


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def remove_columns(s, d):
    return columns.remove_columns(t(s, d, "customer"), ["c_name", "c_mktsegment", "not there"])


@query("SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation")
def rename_columns(s, d):
    return columns.rename_columns(columns.select_columns(t(s, d, "nation"), ["n_nationkey", "n_name", "n_regionkey"]), ["key", "name", "region"])


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
def column_map(s, d):
    out = columns.column_map(t(s, d, "lineitem"), "charge", lambda p, x, y: p * (1 - x) * (1 + y), ["l_extendedprice", "l_discount", "l_tax"])
    return out.select("l_orderkey", "l_linenumber", "charge")


@query("SELECT event_id, CAST(value AS BIGINT) AS whole, TRY_CAST(event_type AS INTEGER) AS bad FROM (SELECT event_id, floor(value) AS value, event_type FROM events)")
def column_cast(s, d):
    ev = t(s, d, "events").select("event_id", F.floor("value").cast("double").alias("value"), "event_type")
    out = columns.column_cast(columns.column_cast(ev, ("value", "whole"), "bigint"), ("event_type", "bad"), "int", strict=False)
    return out.select("event_id", "whole", "bad")


@query("SELECT s_suppkey, s_acctbal * s_acctbal AS sq, abs(s_acctbal) AS mag, greatest(s_acctbal, 0.0) AS pos FROM supplier")
def scalar_functions(s, d):
    x = F.col("s_acctbal")
    return t(s, d, "supplier").select("s_suppkey", scalars.call("sq", x).alias("sq"), scalars.call("abs", x).alias("mag"), scalars.call("max", x, 0.0).alias("pos"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 6) AS top, count(DISTINCT user_id) AS users FROM events WHERE value > 10 GROUP BY ALL")
def agg_index_filter(s, d):
    a = reductions
    return rounded(rounded(a.group_by_column_agg("event_type", {"n": a.row_count(), "total": a.sum("value"), "top": a.maximum("value"), "users": a.count_distinct("user_id")}, t(s, d, "events"), "value > 10"), "total", digits=4), "top")


@query("SELECT count(*) AS n, round(avg(o_totalprice), 4) AS mean_price, max(o_totalprice) AS max_price, min(o_totalprice) AS min_price FROM orders")
def aggregate_global(s, d):
    a = reductions
    return rounded(a.aggregate({"n": a.row_count(), "mean_price": a.mean("o_totalprice"), "max_price": a.maximum("o_totalprice"), "min_price": a.minimum("o_totalprice")}, t(s, d, "orders")), "mean_price", digits=4)


@query("SELECT event_type, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value FROM events GROUP BY ALL")
def first_value(s, d):
    return reductions.group_by_column_agg("event_type", {"first_value": reductions.first_value("value", "event_id"), "last_value": reductions.last_value("value", "event_id")}, t(s, d, "events"))


@query("SELECT n_regionkey, list_sort(list(DISTINCT n_name)) AS names FROM nation GROUP BY ALL")
def distinct(s, d):
    return reductions.group_by_column_agg("n_regionkey", {"names": reductions.distinct("n_name")}, t(s, d, "nation"))


@query("SELECT c_mktsegment, count(*) AS n FROM (SELECT c_mktsegment FROM customer UNION ALL SELECT c_mktsegment FROM customer) GROUP BY ALL")
def agg_sequence(s, d):
    c_ = t(s, d, "customer")
    return reductions.group_by_column_agg("c_mktsegment", {"n": reductions.row_count()}, [c_, c_])


@query("SELECT key, list_sort(list(i)) AS row_ids FROM (SELECT n_regionkey AS key, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) GROUP BY ALL")
def group_by_indexes(s, d):
    return reductions.group_by_column_indexes(t(s, d, "nation"), "n_regionkey", "n_nationkey")


@query()
def sketches(s, d):
    a = reductions
    return a.group_by_column_agg("event_type", {"card": a.prob_set_cardinality("user_id"), "median": a.prob_median("value"), "iqr": a.prob_interquartile_range("value"), "cdf": a.prob_cdf("value", 50.0), "cdfs": a.prob_cdfs("value", [10.0, 50.0]), "pmfs": a.prob_pmfs("value", [10.0, 50.0]), "qs": a.prob_quantiles("value", [0.1, 0.9])}, t(s, d, "events"))


@query()
def reservoirs(s, d):
    a = reductions
    return a.group_by_column_agg("event_type", {"n": a.row_count(), "mean": a.reservoir_desc_stat("value", 100, "mean"), "rows": a.reservoir_dataset(5, ["event_id", "value"])}, t(s, d, "events"))


@query("SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_nationkey, c_acctbal, c_mktsegment FROM orders JOIN customer ON o_custkey IS NOT DISTINCT FROM c_custkey")
def inner_join(s, d):
    return joins.inner_join(("o_custkey", "c_custkey"), t(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), t(s, d, "customer"))


@query("SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")
def left_join(s, d):
    return joins.left_join(("c_custkey", "o_custkey"), t(s, d, "customer").select("c_custkey", "c_name"), t(s, d, "orders").select("o_orderkey", "o_custkey"))


@query('SELECT l.k AS k, l.a AS a, r.k AS "right.k", r.a AS "right.a" FROM (SELECT r_regionkey AS k, r_name AS a FROM region) l RIGHT JOIN (SELECT n_nationkey AS k, n_name AS a FROM nation) r USING (k)')
def right_join(s, d):
    """Keys of regions against those of nations, most of which have no match."""
    left = t(s, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("a"))
    return joins.right_join("k", left, t(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a")))


@query("SELECT coalesce(l.k, r.k) AS k, l.a AS a, r.b AS b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) l FULL JOIN (SELECT s_suppkey AS k, s_nationkey AS b FROM supplier) r ON l.k IS NOT DISTINCT FROM r.k")
def outer_merge(s, d):
    """Keys of nations against those of suppliers; either side has keys that the other lacks."""
    right = t(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("b"))
    return joins.pd_merge(t(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a")), right, "outer")


@query("SELECT r_name, n_name FROM region, nation")
def cross_merge(s, d):
    return joins.pd_merge(t(s, d, "region").select("r_name"), t(s, d, "nation").select("n_name"), "cross")


@query("SELECT a.k, a.v, b.w FROM (SELECT CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey END AS k, n_name AS v FROM nation) a JOIN (SELECT CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE n_nationkey END AS k, n_regionkey AS w FROM nation) b ON a.k IS NOT DISTINCT FROM b.k")
def null_key_join(s, d):
    n = t(s, d, "nation")
    return joins.inner_join("k", n.selectExpr("CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey END AS k", "n_name AS v"), n.selectExpr("CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE n_nationkey END AS k", "n_regionkey AS w"))


@query("SELECT l.l_orderkey, l.l_suppkey, l.l_quantity, x.total FROM lineitem l JOIN (SELECT l_orderkey, l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY ALL) x ON l.l_orderkey = x.l_orderkey AND l.l_suppkey = x.l_suppkey")
def pd_merge_multi(s, d):
    li = t(s, d, "lineitem")
    return joins.pd_merge(li.select("l_orderkey", "l_suppkey", "l_quantity"), li.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_linenumber").alias("total")), "inner", ["l_orderkey", "l_suppkey"])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(s, d):
    return joins.semi_join(("c_custkey", "o_custkey"), t(s, d, "customer").select("c_custkey"), t(s, d, "orders"), anti=True)


def _asof(s, d, op):
    ev = t(s, d, "events")
    left = ev.where("event_type = 'click'").select("event_id", "ts")
    right = ev.where("event_type = 'purchase'").select(F.col("ts").alias("rts"), F.col("event_id").alias("rid"))
    return joins.left_join_asof(("ts", "rts"), left, right, op, tie=["rid"])


_ASOF = "SELECT l.event_id, l.ts, r.ts AS rts, r.event_id AS rid FROM (SELECT * FROM events WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.ts {} r.ts"
for _name, _op in (("asof_lt", "<"), ("asof_le", "<="), ("asof_gt", ">"), ("asof_ge", ">=")):
    Q[_name] = lambda s, d, _op=_op: _asof(s, d, _op)
    SQL[_name] = _ASOF.format(_op)


@query("""SELECT event_id, ts, CASE WHEN a.rts IS NULL OR (b.rts IS NOT NULL AND epoch_us(b.rts) - epoch_us(ts) <= epoch_us(ts) - epoch_us(a.rts)) THEN b.rts ELSE a.rts END AS rts,
    CASE WHEN a.rts IS NULL OR (b.rts IS NOT NULL AND epoch_us(b.rts) - epoch_us(ts) <= epoch_us(ts) - epoch_us(a.rts)) THEN b.rid ELSE a.rid END AS rid
    FROM (SELECT l.event_id, l.ts, r.ts AS rts, r.event_id AS rid FROM (SELECT * FROM events WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.ts >= r.ts) a
    JOIN (SELECT l.event_id, r.ts AS rts, r.event_id AS rid FROM (SELECT * FROM events WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.ts < r.ts) b USING (event_id)""")
def asof_nearest(s, d):
    return _asof(s, d, "nearest")


@query("SELECT l.event_id, l.user_id, l.ts, r.ts AS rts FROM (SELECT * FROM events WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND l.ts >= r.ts")
def asof_by_key(s, d):
    ev = t(s, d, "events")
    return joins.left_join_asof(("ts", "rts"), ev.where("event_type = 'click'").select("event_id", "user_id", "ts"), ev.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("rts")), ">=", "user_id")


def _rolled(s, d, position):
    ev = t(s, d, "events").select("event_id", "ts", "value")
    out = rolling.rolling(ev, 10, {"mean": rolling.mean("value"), "low": rolling.min("value"), "high": rolling.max("value"), "total": rolling.sum("value")}, "ts", position)
    return rounded(out.select("event_id", "mean", "low", "high", "total"), "mean", "total", digits=5)


def _rolled_sql(lo: int, hi: int) -> str:
    frame = f"ROWS BETWEEN {-lo} PRECEDING AND {hi} FOLLOWING"
    return f"""WITH b AS (SELECT event_id, ts, value, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n, first_value(value) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f, last_value(value) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM events),
        w AS (SELECT *, sum(value) OVER (ORDER BY ts {frame}) + greatest(-(i + {lo}), 0) * f + greatest(i + {hi} - n + 1, 0) * l AS tot, min(value) OVER (ORDER BY ts {frame}) AS low, max(value) OVER (ORDER BY ts {frame}) AS high FROM b)
        SELECT event_id, round(tot / 10, 5) AS mean, low, high, round(tot, 5) AS total FROM w"""


for _position in ("center", "left", "right"):
    Q[f"rolling_{_position}"] = lambda s, d, _p=_position: _rolled(s, d, _p)
    SQL[f"rolling_{_position}"] = _rolled_sql(*rolling.bounds(10, _position))


@query("SELECT l.event_id, round(sum(r.value * 100), 0) AS total, max(r.value) AS high, count(*) AS n FROM events l JOIN events r ON r.ts >= l.ts AND r.ts < l.ts + INTERVAL 1 HOUR GROUP BY ALL")
def rolling_variable(s, d):
    ev = t(s, d, "events").select("event_id", "ts", "value", (F.col("value") * 100).alias("cents"), F.lit(1.0).alias("one"))
    out = rolling.rolling(ev, {"column": "ts", "size": 3600}, {"total": rolling.sum("cents"), "high": rolling.max("value"), "n": rolling.sum("one")}, "ts", "right")
    return rounded(out.select("event_id", "total", "high", F.col("n").cast("bigint").alias("n")), "total", digits=0)


@query("SELECT event_id, round(sum(value * 100) OVER w, 0) AS total, max(value) OVER w AS high FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def expanding_by_group(s, d):
    cents = t(s, d, "events").withColumn("cents", F.col("value") * 100)
    out = rolling.expanding(cents, {"total": rolling.sum("cents"), "high": rolling.max("value")}, "ts", "event_type")
    return rounded(out.select("event_id", "total", "high"), "total", digits=0)


@query("SELECT event_id, round(sum(value) OVER w, 4) AS total, min(value) OVER w AS low, max(value) OVER w AS high FROM events WINDOW w AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def expanding(s, d):
    out = rolling.expanding(t(s, d, "events"), {"total": rolling.sum("value"), "low": rolling.min("value"), "high": rolling.max("value")}, "ts")
    return rounded(out.select("event_id", "total", "low", "high"), "total", digits=4)


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def head(s, d):
    return rows.head(t(s, d, "orders"), "o_orderkey")


@query("SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 5")
def tail(s, d):
    return rows.tail(t(s, d, "orders"), "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders QUALIFY (row_number() OVER (ORDER BY o_orderkey) - 1) % 10 = 0")
def take_nth(s, d):
    return rows.take_nth(t(s, d, "orders").select("o_orderkey", "o_totalprice"), 10, "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")
def min_n_by_column(s, d):
    return rows.min_n_by_column(t(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20, "o_orderkey")


@query("SELECT p_partkey, p_retailprice FROM part")
def sort_by_column(s, d):
    return rows.sort_by_column(t(s, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", descending=True)


@query("SELECT event_id, row_number() OVER (ORDER BY ts) - 1 AS row_id FROM events")
def row_ids(s, d):
    return with_row_ids(t(s, d, "events"), "ts").select("event_id", F.col(ROW_ID).alias("row_id"))


@query("SELECT n_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) WHERE i IN (0, 3, 24)")
def select_rows(s, d):
    return rows.select_rows(t(s, d, "nation"), [0, 3, -1], "n_nationkey").select("n_name")


@query("SELECT n_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) WHERE i NOT IN (0, 3, 24)")
def drop_rows(s, d):
    return rows.drop_rows(t(s, d, "nation"), [0, 3, -1], "n_nationkey").select("n_name")


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def unique_by_column(s, d):
    return rows.unique_by_column(t(s, d, "events"), "user_id", "event_id")


@query("SELECT DISTINCT p_brand FROM part")
def unique(s, d):
    return rows.unique(t(s, d, "part"), "p_brand")


_A = "SELECT o_custkey AS p, o_orderstatus AS s FROM orders"
_B = "SELECT c_custkey AS p, 'O' AS s FROM customer"


def _two(s, d):
    """The customer and status of each order, and each customer with one status."""
    return t(s, d, "orders").selectExpr("o_custkey AS p", "o_orderstatus AS s"), t(s, d, "customer").selectExpr("c_custkey AS p", "'O' AS s")


@query(f"SELECT p, s FROM (SELECT p, s, max(n) AS n FROM (SELECT p, s, count(*) AS n FROM ({_A}) GROUP BY ALL UNION ALL SELECT p, s, count(*) AS n FROM ({_B}) GROUP BY ALL) GROUP BY ALL), generate_series(1, n) g(k)")
def set_union(s, d):
    return sets.union(*_two(s, d))


@query(f"({_A}) INTERSECT ALL ({_B})")
def set_intersection(s, d):
    return sets.intersection(*_two(s, d))


@query(f"SELECT * FROM ({_A}) a WHERE NOT EXISTS (SELECT 1 FROM ({_B}) b WHERE a.p IS NOT DISTINCT FROM b.p AND a.s IS NOT DISTINCT FROM b.s)")
def set_difference(s, d):
    return sets.difference(*_two(s, d))


@query("SELECT c_custkey, c_acctbal, NULL::BIGINT AS s_suppkey FROM customer UNION ALL SELECT NULL, NULL, s_suppkey FROM supplier")
def concat(s, d):
    return sets.concat(t(s, d, "customer").select("c_custkey", "c_acctbal"), t(s, d, "supplier").select("s_suppkey"))


@query('SELECT p_partkey, name AS "column", value FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part) UNPIVOT (value FOR name IN (p_size, p_retailprice))')
def columnwise_concat(s, d):
    return reshape.columnwise_concat(t(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_size", "p_retailprice"])


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS idx, embedding[i] AS embedding FROM embeddings, generate_series(1, len(embedding)) g(i)")
def unroll_column(s, d):
    return reshape.unroll_column(t(s, d, "embeddings").select("vec_id", "embedding"), "embedding", "idx")


_BY_REGION = "(SELECT n_regionkey AS k, CAST(min(n_nationkey) AS DOUBLE) AS lo, CAST(max(n_nationkey) AS DOUBLE) AS hi FROM nation GROUP BY ALL)"


@query(" UNION ALL ".join(f"SELECT '{x}' AS col, " + ", ".join(f'sum(CASE WHEN k = {k} THEN {x} END) AS "{k}"' for k in range(5)) + f" FROM {_BY_REGION}" for x in ("lo", "hi")))
def transpose_by_key(s, d):
    g = t(s, d, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.min("n_nationkey").cast("double").alias("lo"), F.max("n_nationkey").cast("double").alias("hi"))
    return reshape.transpose_by_key(g, "k", keys=[0, 1, 2, 3, 4])


@query("SELECT *, s_acctbal * 2 AS twice FROM supplier")
def row_map(s, d):
    return reshape.row_map(t(s, d, "supplier"), lambda r: {"twice": r["s_acctbal"] * 2}, "twice double")


@query("SELECT r_regionkey, r_name, CAST(k AS BIGINT) AS k FROM region, generate_series(0, r_regionkey - 1) g(k)")
def row_mapcat(s, d):
    return reshape.row_mapcat(t(s, d, "region").select("r_regionkey", "r_name"), lambda r: [{"k": k} for k in range(r["r_regionkey"])], "k bigint")


_HOLES = "SELECT event_id, ts, CASE WHEN event_id % 7 < 3 THEN NULL ELSE value END AS value FROM events"


def _holes(s, d):
    return t(s, d, "events").selectExpr("event_id", "ts", "CASE WHEN event_id % 7 < 3 THEN NULL ELSE value END AS value")


@query(f"SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM ({_HOLES})")
def replace_missing_down(s, d):
    return missing.replace_missing(_holes(s, d), "value", "down", order=["ts", "event_id"]).select("event_id", "value")


@query(f"SELECT event_id, first_value(value IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM ({_HOLES})")
def replace_missing_up(s, d):
    return missing.replace_missing(_holes(s, d), "value", "up", order=["ts", "event_id"]).select("event_id", "value")


@query(f"SELECT event_id, coalesce(last_value(value IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(value IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM ({_HOLES})")
def replace_missing_downup(s, d):
    return missing.replace_missing(_holes(s, d), "value", "downup", order=["ts", "event_id"]).select("event_id", "value")


_AROUND = f"""WITH b AS (SELECT *, row_number() OVER (ORDER BY ts) AS i FROM ({_HOLES})),
    w AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi, last_value(value IGNORE NULLS) OVER p AS pv, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER n AS ni, first_value(value IGNORE NULLS) OVER n AS nv
    FROM b WINDOW p AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) """


@query(_AROUND + "SELECT event_id, CASE WHEN value IS NOT NULL THEN value WHEN pv IS NULL OR nv IS NULL THEN coalesce(pv, nv) WHEN i - pi <= ni - i THEN pv ELSE nv END AS value FROM w")
def replace_missing_nearest(s, d):
    return missing.replace_missing(_holes(s, d), "value", "nearest", order=["ts", "event_id"]).select("event_id", "value")


@query(_AROUND + "SELECT event_id, round(CASE WHEN value IS NOT NULL THEN value WHEN pv IS NULL OR nv IS NULL THEN coalesce(pv, nv) ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END, 6) AS value FROM w")
def replace_missing_lerp(s, d):
    return rounded(missing.replace_missing(_holes(s, d), "value", "lerp", order=["ts", "event_id"]).select("event_id", "value"), "value")


@query(f"SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM ({_HOLES}))), 6) AS value FROM ({_HOLES})")
def replace_missing_value(s, d):
    return rounded(missing.replace_missing(_holes(s, d), "value", "value", F.avg).select("event_id", "value"), "value")


@query(f"SELECT event_id FROM ({_HOLES}) WHERE value IS NOT NULL")
def drop_missing(s, d):
    return rows.drop_missing(_holes(s, d)).select("event_id")


@query(f"SELECT event_id FROM ({_HOLES}) WHERE value IS NULL")
def select_missing(s, d):
    return rows.select_missing(_holes(s, d)).select("event_id")


@query("""WITH k AS (SELECT DISTINCT CAST(p_size AS DOUBLE) * p_size AS k FROM part), b AS (SELECT k, lag(k) OVER (ORDER BY k) AS a FROM k), m AS (SELECT a, k, CAST(ceil((k - a) / 6) AS BIGINT) AS n FROM b WHERE k - a > 6)
    SELECT round(k, 6) AS k, round(k, 6) AS v FROM k UNION ALL SELECT round(a + (k - a) * i / n, 6) AS k, round(a, 6) AS v FROM m, generate_series(1, n - 1) g(i)""")
def fill_range_replace(s, d):
    src = t(s, d, "part").select((F.col("p_size").cast("double") * F.col("p_size")).alias("k")).distinct().withColumn("v", F.col("k"))
    return rounded(missing.fill_range_replace(src, "k", 6.0), "k", "v")


@query("""SELECT 'p_size' AS "col-name", count(p_size) AS "n-valid", count(*) - count(p_size) AS "n-missing", CAST(min(p_size) AS DOUBLE) AS "min", round(avg(p_size), 6) AS mean, CAST(max(p_size) AS DOUBLE) AS "max", round(stddev_samp(p_size), 6) AS "standard-deviation" FROM part
    UNION ALL SELECT 'p_retailprice', count(p_retailprice), count(*) - count(p_retailprice), min(p_retailprice), round(avg(p_retailprice), 6), max(p_retailprice), round(stddev_samp(p_retailprice), 6) FROM part""")
def descriptive_stats(s, d):
    out = stats.descriptive_stats(t(s, d, "part"), "p_partkey", ["n-valid", "n-missing", "min", "mean", "max", "standard-deviation"], ["p_size", "p_retailprice"])
    return rounded(out.drop("datatype"), "mean", "standard-deviation")


@query("""SELECT 'l_quantity' AS lhs, 'l_extendedprice' AS rhs, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem
    UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem""")
def correlation_table(s, d):
    return rounded(stats.correlation_table(t(s, d, "lineitem"), "pearson", ["l_quantity", "l_extendedprice", "l_discount"]), "correlation")


@query("""WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part)
    SELECT 'p_size' AS lhs, 'p_retailprice' AS rhs, round(corr(a, b), 6) AS correlation FROM r""")
def correlation_spearman(s, d):
    return rounded(stats.correlation_table(t(s, d, "part"), "spearman", ["p_size", "p_retailprice"]), "correlation")


@query("SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 6) AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS p_retailprice FROM part")
def std_scale(s, d):
    p = t(s, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(stats.transform_std_scale(p, stats.fit_std_scale(p, ["p_size", "p_retailprice"])), "p_size", "p_retailprice")


@query("SELECT p_partkey, round((p_size - min(p_size) OVER ()) / CAST(max(p_size) OVER () - min(p_size) OVER () AS DOUBLE) - 0.5, 6) AS p_size FROM part")
def minmax(s, d):
    p = t(s, d, "part").select("p_partkey", "p_size")
    return rounded(stats.transform_minmax(p, stats.fit_minmax(p, ["p_size"])), "p_size")


@query("SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS c_mktsegment FROM customer")
def categorical_to_number(s, d):
    return categorical.categorical_to_number(t(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("""SELECT o_orderkey, CAST(o_orderstatus = 'F' AS TINYINT) AS "o_orderstatus-F", CAST(o_orderstatus = 'O' AS TINYINT) AS "o_orderstatus-O", CAST(o_orderstatus = 'P' AS TINYINT) AS "o_orderstatus-P" FROM orders""")
def categorical_to_one_hot(s, d):
    return categorical.categorical_to_one_hot(t(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"])


@query("SELECT c_custkey, c_mktsegment FROM customer")
def reverse_categorical(s, d):
    return categorical.reverse_map_categorical_xforms(categorical.categorical_to_number(t(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment"))


@query("SELECT event_id, user_id FROM events")
def k_fold(s, d):
    folds = modelling.k_fold_datasets(t(s, d, "events").select("event_id", "user_id"), 3, "event_id")
    return sets.concat(*[f["test-ds"] for f in folds])


@query("SELECT CAST(round(count(*) * 0.7) AS BIGINT) AS train, count(*) - CAST(round(count(*) * 0.7) AS BIGINT) AS test FROM customer")
def train_test_split(s, d):
    got = modelling.train_test_split(t(s, d, "customer"), "c_custkey")
    return got["train-ds"].agg(F.count(F.lit(1)).alias("train")).crossJoin(got["test-ds"].agg(F.count(F.lit(1)).alias("test")))


@query()
def pca(s, d):
    e = t(s, d, "embeddings")
    wide = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return modelling.transform_pca(wide, modelling.fit_pca(wide, [f"e{i}" for i in range(64)], 3))


@query()
def regression(s, d):
    p = t(s, d, "part").select("p_size", "p_retailprice", F.col("p_partkey").cast("double").alias("p_partkey"))
    m = modelling.train_regression(modelling.trainer("linear-regression"), p, "p_retailprice")
    return modelling.predict_regression(m, p)


@query()
def loess(s, d):
    daily = t(s, d, "events").groupBy(F.datediff("ts", F.lit("1970-01-01")).cast("double").alias("day")).agg(F.avg("value").alias("value"))
    return stats.interpolate_loess(daily, "day", "value")


@query("SELECT event_id, try_cast(x AS SMALLINT) AS x FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'NA' ELSE CAST(event_id % 100 AS VARCHAR) END AS x FROM events)")
def promotion(s, d):
    raw = t(s, d, "events").select("event_id", F.expr("CASE WHEN event_id % 5 = 0 THEN 'NA' ELSE CAST(event_id % 100 AS STRING) END").alias("x"))
    return parsing.parsed(raw, parsing.infer(raw, ["x"]))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def fold_batches(s, d):
    from weftline.streaming.incremental import fold_batches as fold

    ev = t(s, d, "events")
    return rounded(fold([ev.where(f"event_id % 3 = {i}") for i in range(3)], "event_type", {"total": "value"}), "total", digits=4)


def _scratch(s: SparkSession, name: str) -> str:
    """A new path in the folder that driver and workers share; a single machine may do without that setting."""
    base = s.conf.get("spark.checkpoint.dir", None)
    if not base and not s.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and workers share")
    return f"{(base or tempfile.mkdtemp()).rstrip('/')}/{uuid.uuid4().hex}/{name}"


def _written(s: SparkSession, df: DataFrame, name: str, **options) -> DataFrame:
    """df written to a file type by the ending of name, read back, with the types that it had."""
    path = _scratch(s, name)
    writers.write_dataset(df, path)
    back = readers.read_dataset(s, path, **options)
    return back.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in df.schema if f.name in back.columns])


@query("SELECT * FROM orders")
def parquet_file(s, d):
    return _written(s, t(s, d, "orders"), "orders.parquet")


@query("SELECT * FROM lineitem")
def orc_file(s, d):
    return _written(s, t(s, d, "lineitem"), "lineitem.orc")


@query("SELECT * FROM orders")
def json_lines_file(s, d):
    return _written(s, t(s, d, "orders"), "orders.jsonl")


@query("SELECT * FROM lineitem")
def csv_file(s, d):
    return _written(s, t(s, d, "lineitem"), "lineitem.csv")


@query("SELECT event_id, user_id, event_type, value, nullif(trim(props), '') AS props FROM events")
def csv_quotes(s, d):
    """Values with quotes and separators."""
    return _written(s, t(s, d, "events").drop("ts"), "events.csv")


@query("SELECT * FROM orders")
def tsv_gz_file(s, d):
    return _written(s, t(s, d, "orders"), "orders.tsv.gz")


@query("SELECT p_partkey, p_size FROM part")
def csv_columns(s, d):
    """Of all columns two are read."""
    return _written(s, t(s, d, "part"), "part.csv", columns=["p_partkey", "p_size"])


@query("SELECT o_orderkey AS \"column-0\", CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS \"column-1\", CASE WHEN o_orderkey % 3 = 0 THEN 'late' END AS \"column-2\" FROM orders")
def csv_ragged(s, d):
    """Rows of one to three fields without a header, and a comment after each."""
    k, v = F.col("o_orderkey").cast("string"), F.when(F.expr("o_orderkey % 2 = 0"), F.col("o_custkey").cast("string"))
    line = F.when(F.expr("o_orderkey % 3 = 0"), F.concat_ws(",", k, F.coalesce(v, F.lit("")), F.lit("late"))).otherwise(F.concat_ws(",", k, v))
    path = _scratch(s, "ragged.csv")
    t(s, d, "orders").select(F.concat(line, F.lit("\n# note")).alias("value")).write.text(path)
    return readers.read_csv(s, path, header=False, parser={"column-0": "bigint", "column-1": "bigint"})


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def arrow_file(s, d):
    """One file, which the driver writes batch by batch."""
    path = _scratch(s, "customer.arrow").removeprefix("file://").replace("file:", "", 1)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    writers.write_dataset(t(s, d, "customer"), path)
    return readers.read_dataset(s, path)


@query("SELECT o_orderkey, o_totalprice AS \"o.price\", o_orderstatus AS \"o.status\" FROM orders")
def flatten_nested(s, d):
    nested = t(s, d, "orders").select("o_orderkey", F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")).alias("o"))
    return readers.flatten_nested(nested)


_MATHS = {
    "cube": "pow({x}, 3)", "cbrt": "cbrt({x})", "expm1": "exp({x} / 100000) - 1", "log10": "log10({x})", "log1p": "ln(1 + {x})", "floor": "floor({x})", "ceil": "ceil({x})", "signum": "sign({x})",
    "sin": "sin({x})", "cos": "cos({x})", "atan": "atan({x})", "tanh": "tanh({x} / 100000)", "to-degrees": "degrees({x})", "to-radians": "radians({x})", "logistic": "1 / (1 + exp(-{x} / 100000))", "negate": "-{x}", "sqrt": "sqrt({x})",
}


@query("SELECT o_orderkey, " + ", ".join(f'round(CAST({v.format(x="o_totalprice")} AS DOUBLE), 4) AS "{k}"' for k, v in _MATHS.items()) + " FROM orders")
def scalar_maths(s, d):
    x = F.col("o_totalprice")
    arg = {"expm1", "tanh", "logistic"}
    return t(s, d, "orders").select("o_orderkey", *[F.round(scalars.call(k, x / 100000 if k in arg else x).cast("double"), 4).alias(k) for k in _MATHS])


_PAIRS = {
    "quot": "(l_partkey - l_partkey % l_linenumber) / l_linenumber", "rem": "l_partkey % l_linenumber", "/": "l_partkey / l_linenumber", "hypot": "sqrt(l_partkey * l_partkey + l_linenumber * l_linenumber)", "atan2": "atan2(l_partkey, l_linenumber)",
    "bit-and": "l_partkey & l_linenumber", "bit-or": "l_partkey | l_linenumber", "bit-xor": "xor(l_partkey, l_linenumber)", "min": "least(l_partkey, l_linenumber)", "max": "greatest(l_partkey, l_linenumber)",
}


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f'round(CAST({v} AS DOUBLE), 6) AS "{k}"' for k, v in _PAIRS.items()) + ", l_partkey = l_linenumber AS eq, l_partkey < l_linenumber AS below, l_partkey % 2 = 0 AS even FROM lineitem")
def scalar_pairs(s, d):
    a, b = F.col("l_partkey"), F.col("l_linenumber").cast("bigint")
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(scalars.call(k, a, b).cast("double"), 6).alias(k) for k in _PAIRS], scalars.call("eq", a, b).alias("eq"), scalars.call("<", a, b).alias("below"), scalars.call("even?", a).alias("even"))


@query("SELECT event_id, year(ts) AS years, month(ts) AS months, day(ts) AS days, hour(ts) AS hours, minute(ts) AS minutes, dayofweek(ts) + 1 AS day_of_week, dayofyear(ts) AS day_of_year, weekofyear(ts) AS week_of_year, CAST(CAST(ts AS DATE) + 7 AS DATE) AS next_week FROM events")
def scalar_dates(s, d):
    parts = {k.replace("-", "_"): scalars.call(k, F.col("ts")).cast("bigint") for k in ("years", "months", "days", "hours", "minutes", "day-of-week", "day-of-year", "week-of-year")}
    return t(s, d, "events").select("event_id", *[v.alias(k) for k, v in parts.items()], scalars.call("plus-days", F.col("ts").cast("date"), 7).alias("next_week"))


@query("SELECT l_returnflag, round(sum(l_quantity), 4) AS sum, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS min, max(l_quantity) AS max, round(var_samp(l_quantity), 4) AS variance, round(stddev_samp(l_quantity), 6) AS standard_deviation, median(l_quantity) AS median, count(*) AS n_elems FROM lineitem GROUP BY ALL")
def scalar_reductions(s, d):
    digits = {"sum": 4, "mean": 6, "variance": 4, "standard-deviation": 6}
    made = {k: scalars.REDUCTIONS[k](F.col("l_quantity")) for k in ("sum", "mean", "min", "max", "variance", "standard-deviation", "median", "n-elems")}
    return t(s, d, "lineitem").groupBy("l_returnflag").agg(*[(F.round(v, digits[k]) if k in digits else v).alias(k.replace("-", "_")) for k, v in made.items()])


@query("SELECT event_type, true AS card, true AS median, true AS quantiles, true AS cdf FROM events GROUP BY ALL")
def sketch_errors(s, d):
    """Whether each sketch is within its stated error of the exact value: 5 % of distinct values, 2 % of ranks."""
    a, ev = reductions, t(s, d, "events")
    got = a.group_by_column_agg("event_type", {"card": a.prob_set_cardinality("user_id"), "median": a.prob_median("value"), "qs": a.prob_quantiles("value", [0.1, 0.9]), "cdf": a.prob_cdf("value", 50.0)}, ev)
    n, below = F.count("value"), lambda x: F.count_if(F.col("value") < x)
    seen = ev.join(got, "event_type").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.first("card").alias("card"), F.first("cdf").alias("cdf"), *[(below(x) / n).alias(f"lo{i}") for i, x in enumerate((F.col("median"), F.col("qs")[0], F.col("qs")[1], F.lit(50.0)))], *[(F.count_if(F.col("value") <= x) / n).alias(f"hi{i}") for i, x in enumerate((F.col("median"), F.col("qs")[0], F.col("qs")[1], F.lit(50.0)))])
    near = lambda i, q: (F.col(f"lo{i}") <= q + 0.02) & (F.col(f"hi{i}") >= q - 0.02)
    return seen.select("event_type", (F.abs(F.col("card") - F.col("users")) <= 0.05 * F.col("users") + 1).alias("card"), near(0, 0.5).alias("median"), (near(1, 0.1) & near(2, 0.9)).alias("quantiles"), near(3, F.col("cdf")).alias("cdf"))

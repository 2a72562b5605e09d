"""The operators over the star-schema tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, values
from ..operators import analytics, relational, revise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- ids ------------------------------------------------------------------------------------


def _sql_id(group: str, chain: list[tuple[str, str]]) -> str:
    """DuckDB text of a content id from (heading, SQL of the value)."""
    le = lambda n: "".join(f"{b:02X}" for b in n.to_bytes(4, "little"))
    const = lambda s: f"unhex('{le(len(s))}{s.encode().hex()}')"
    parts = [const(group), f"unhex('{le(len(chain))}')"]
    for name, value in chain:
        # keys here are decimal texts of under 256 bytes
        parts += [const(name), f"unhex(printf('%02X000000', strlen({value})))", f"encode({value})"]
    h = f"sha256({' || '.join(parts)})"
    return f"(SELECT substr(h,1,8)||'-'||substr(h,9,4)||'-8'||substr(h,14,3)||'-'||substr('89ab', 1 + (instr('0123456789abcdef', substr(h,17,1)) - 1) % 4, 1)||substr(h,18,3)||'-'||substr(h,21,12) FROM (SELECT {h} AS h))"


def _orders_id(c):
    return keys.content_id("ORDR", [("ORDR_ID", c)])


_ORDERS_ID = _sql_id("ORDR", [("ORDR_ID", "CAST(o_orderkey AS VARCHAR)")])
_PARENT_ID = _sql_id("ORDR", [("ORDR_ID", "CAST(l_orderkey AS VARCHAR)")])


@query(f"SELECT o_orderkey, {_ORDERS_ID} AS _id FROM orders")
def content_id_orders(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", _orders_id(F.col("o_orderkey")).alias("_id"))


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_PARENT_ID} AS _parent_id FROM lineitem")
def parent_id_lineitem(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", _orders_id(F.col("l_orderkey")).alias("_parent_id"))


@query("SELECT o_orderstatus, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def content_key_join(spark, sf_dir):
    child = t(spark, sf_dir, "lineitem").select(_orders_id(F.col("l_orderkey")).alias("_parent_id"))
    parent = t(spark, sf_dir, "orders").select(_orders_id(F.col("o_orderkey")).alias("_id"), "o_orderstatus")
    # children are counted by id before they meet their parents
    counted = child.groupBy("_parent_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(parent, counted["_parent_id"] == parent["_id"]).groupBy("o_orderstatus").agg(F.sum("n").alias("n"))


@query("SELECT sha256(s_name) AS digest, count(*) AS n FROM supplier GROUP BY 1")
def value_digest(spark, sf_dir):
    return t(spark, sf_dir, "supplier").groupBy(F.sha2("s_name", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS n_values FROM lineitem")
def content_hash_lineitem(spark, sf_dir):
    cells = [(c.upper(), "", F.col(c).cast("string")) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    rows = t(spark, sf_dir, "lineitem").select(keys.content_hash("LINE", cells).alias("_content_hash"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("_content_hash").alias("n_values"))


# -- joins ----------------------------------------------------------------------------------


@query("SELECT c_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def key_join_using(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return orders.join(t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


@query("""
    SELECT o_custkey, max(o_orderdate) AS latest,
           arg_max(o_totalprice, (o_orderdate, o_orderkey, o_totalprice)) AS price
    FROM orders GROUP BY 1""")
def deepest_arg_max(spark, sf_dir):
    order = F.struct("o_orderdate", "o_orderkey", "o_totalprice")
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("latest"), analytics.value_at_greatest(F.col("o_totalprice"), order).alias("price"))


@query("""
    SELECT c_custkey, n_name FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) c
    LEFT JOIN (SELECT n_name, nullif(n_nationkey, 3) AS k FROM nation) n ON c.k IS NOT DISTINCT FROM n.k""")
def null_safe_left_join(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", F.expr("nullif(c_nationkey, 3)").alias("ck"))
    n = t(spark, sf_dir, "nation").select("n_name", F.expr("nullif(n_nationkey, 3)").alias("nk"))
    return relational.null_safe_join(c, n, [("ck", "nk")]).select("c_custkey", "n_name")


_BANDS = """
    bands AS (SELECT user_id AS band_user, band, band * 25.0 AS top, band * 25.0 + 25.0 AS base
              FROM (SELECT DISTINCT user_id FROM events), range(0, 4) r(band))"""


@query(f"""
    WITH {_BANDS}
    SELECT event_id, CAST(band AS BIGINT) AS band FROM events JOIN bands ON user_id = band_user AND value >= top AND value < base""")
def depth_band_join(spark, sf_dir):
    events = t(spark, sf_dir, "events").select("event_id", "user_id", "value")
    bands = events.select(F.col("user_id").alias("band_user")).distinct().withColumn("band", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    bands = bands.withColumn("top", F.col("band") * 25.0).withColumn("base", F.col("top") + 25.0)
    return relational.band_join(events, bands, [("user_id", "band_user")], "value", "top", "base").select("event_id", "band")


@query("""
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'F')""")
def orphan_rows(spark, sf_dir):
    parent = t(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_orderkey")
    child = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return relational.orphans(child, parent, [("l_orderkey", "o_orderkey")])


@query("""
    SELECT l_returnflag, count(*) AS orphans FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1""")
def orphan_counts(spark, sf_dir):
    parent = t(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_orderkey")
    lost = relational.orphans(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"), parent, [("l_orderkey", "o_orderkey")])
    return lost.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("orphans"))


@query("""
    SELECT 'customer' AS tbl, count(*) AS n FROM customer WHERE c_custkey IN (1, 7, 42)
    UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey IN (1, 7, 42)
    UNION ALL SELECT 'nation', count(*) FROM nation""")
def related_semi_filter(spark, sf_dir):
    tables = {"customer": t(spark, sf_dir, "customer"), "orders": t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "nation": t(spark, sf_dir, "nation")}
    out = None
    for name, df in relational.at(tables, "c_custkey", [1, 7, 42]).items():
        n = df.agg(F.lit(name).alias("tbl"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS key_rows FROM lineitem
    QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1""")
def duplicate_keys(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return relational.duplicate_keys(rows, ["l_orderkey", "l_linenumber"])


@query("""
    WITH o AS (SELECT o_orderkey, o_custkey, 'CUST|' || (o_custkey + o_orderkey % 2 * 1000000000) AS link FROM orders)
    SELECT o_orderkey AS row_id, link, count(c_custkey) AS n FROM o LEFT JOIN customer ON link = 'CUST|' || c_custkey GROUP BY 1, 2""")
def record_link_count(spark, sf_dir):
    link = F.concat(F.lit("CUST|"), (F.col("o_custkey") + F.col("o_orderkey") % 2 * 1000000000).cast("string"))
    rows = t(spark, sf_dir, "orders").select("o_orderkey", link.alias("link"))
    return relational.resolved_links(rows, "link", "|", {"CUST": (t(spark, sf_dir, "customer"), ["c_custkey"])}, "o_orderkey")


@query("""
    SELECT s_suppkey, round(sqrt(pow(x - q * 100, 2) + pow(y - q * 50, 2)), 6) AS distance FROM (
        SELECT s_suppkey, x, y, greatest(0.0, least(1.0, (x * 100 + y * 50) / 12500.0)) AS q FROM (
            SELECT s_suppkey, CAST(s_suppkey % 97 AS DOUBLE) AS x, CAST(s_suppkey % 53 AS DOUBLE) AS y FROM supplier))
    WHERE sqrt(pow(x - q * 100, 2) + pow(y - q * 50, 2)) <= 20""")
def spatial_distance_join(spark, sf_dir):
    p = t(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 97).cast("double").alias("x"), (F.col("s_suppkey") % 53).cast("double").alias("y"))
    d = relational.point_segment_distance(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(50.0))
    return p.select("s_suppkey", d.alias("distance")).where("distance <= 20").withColumn("distance", F.round("distance", 6))


@query("""
    SELECT o_orderkey, o_custkey, coalesce(a.n, 0) AS lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) a ON l_orderkey = o_orderkey""")
def graph_attach(spark, sf_dir):
    """Children nested under their parents, then counted."""
    lines = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber")).alias("lines"))
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").select("o_orderkey", "o_custkey", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("lines"))


# -- aggregates -----------------------------------------------------------------------------

for _m, _f in (("count", "count(*)"), ("sum", "sum(o_totalprice)"), ("avg", "avg(o_totalprice)"), ("min", "min(o_totalprice)"), ("max", "max(o_totalprice)")):

    def _chart(spark, sf_dir, m=_m):
        out = analytics.chart(t(spark, sf_dir, "orders"), "o_orderpriority", m, "o_totalprice")
        return out if m == "count" else out.withColumn("value", F.round("value", 2))

    QUERIES[f"chart_{_m}"] = _chart
    SQL[f"chart_{_m}"] = f"SELECT o_orderpriority AS x, {_f if _m == 'count' else f'round({_f}, 2)'} AS value FROM orders GROUP BY 1"

_TOP_BRANDS = "SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 5"


@query(f"""
    SELECT CASE WHEN p_brand IN ({_TOP_BRANDS}) THEN p_brand ELSE 'Other' END AS brand, p_size, count(*) AS n FROM part GROUP BY 1, 2""")
def topk_fold_other(spark, sf_dir):
    return analytics.folded(t(spark, sf_dir, "part"), "p_brand", 5).groupBy(F.col("folded").alias("brand"), "p_size").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 7")
def cardinality_probe(spark, sf_dir):
    return analytics.top_values(t(spark, sf_dir, "part"), "p_brand", 7)


@query("""
    WITH s AS (SELECT nullif(p_brand, 'Brand#11') AS brand, nullif(p_size, 7) AS size, p_name AS name FROM part)
    SELECT c AS column_name, f AS filled, n AS total, round(f * 100.0 / n, 2) AS pct FROM (
        SELECT unnest(['brand', 'size', 'name']) AS c, unnest([count(brand), count(size), count(name)]) AS f, count(*) AS n FROM s)""")
def completeness(spark, sf_dir):
    part = t(spark, sf_dir, "part").select(F.expr("nullif(p_brand, 'Brand#11')").alias("brand"), F.expr("nullif(p_size, 7)").alias("size"), F.col("p_name").alias("name"))
    return analytics.completeness(part)


@query("""
    SELECT k AS value, count(*) FILTER (WHERE tbl = 'customer') AS customer, count(*) FILTER (WHERE tbl = 'supplier') AS supplier
    FROM (SELECT c_nationkey AS k, 'customer' AS tbl FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier) GROUP BY 1""")
def coverage_matrix(spark, sf_dir):
    tables = {"customer": t(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "k"), "supplier": t(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "k")}
    return analytics.coverage(tables, "k")


# -- windows, dedup, sets -------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return relational.latest_per_key(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate")


#: Two versions of the whole of ``part``: in the second, a third of the keys is other, and a fifth of the sizes.
_SLICES = """(
    SELECT p_partkey, p_brand, p_size, 1 AS ver FROM part
    UNION ALL SELECT CASE WHEN p_partkey % 3 = 0 THEN -p_partkey ELSE p_partkey END, p_brand, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END, 2 FROM part)"""


def _slices(spark, sf_dir):
    part = t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    two = part.withColumns({"p_partkey": F.expr("if(p_partkey % 3 = 0, -p_partkey, p_partkey)"), "p_size": F.expr("if(p_partkey % 5 = 0, p_size + 1, p_size)")})
    return part.withColumn("ver", F.lit(1)), two.withColumn("ver", F.lit(2))


@query(f"SELECT DISTINCT ON (p_partkey) p_partkey, p_size FROM {_SLICES} ORDER BY p_partkey, ver")
def distinct_on_key(spark, sf_dir):
    both = relational.union_by_name(*_slices(spark, sf_dir)).withColumn("_id", keys.content_id("PART", [("PART_ID", F.col("p_partkey"))]))
    return revise.identity_dedup(both, "_id", ["ver"]).select("p_partkey", "p_size")


@query(f"SELECT p_partkey, p_brand, p_size FROM {_SLICES} GROUP BY ALL")
def distinct_on_value(spark, sf_dir):
    both = relational.union_by_name(*_slices(spark, sf_dir))
    value = keys.content_hash("PART", [(c.upper(), "", F.col(c).cast("string")) for c in ("p_partkey", "p_brand", "p_size")])
    return revise.identity_dedup(both.withColumn("_content_hash", value), "_content_hash", ["ver"]).select("p_partkey", "p_brand", "p_size")


@query("SELECT n_name AS name, n_regionkey AS region, NULL::DOUBLE AS balance FROM nation UNION ALL BY NAME SELECT s_name AS name, s_acctbal AS balance FROM supplier")
def union_by_name(spark, sf_dir):
    a = t(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    b = t(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return relational.union_by_name(a, b)


@query(f"""
    WITH s AS (SELECT * FROM {_SLICES}), a AS (SELECT p_partkey, p_brand, p_size FROM s WHERE ver = 1), b AS (SELECT p_partkey, p_brand, p_size FROM s WHERE ver = 2)
    (SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) UNION ALL (SELECT *, 'b' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))""")
def except_both_ways(spark, sf_dir):
    a, b = _slices(spark, sf_dir)
    return relational.except_both_ways(a.drop("ver"), b.drop("ver"))


@query(f"WITH s AS (SELECT * FROM {_SLICES}) SELECT p_partkey, p_brand, p_size FROM s WHERE ver = 1 INTERSECT SELECT p_partkey, p_brand, p_size FROM s WHERE ver = 2")
def intersect_rows(spark, sf_dir):
    a, b = _slices(spark, sf_dir)
    return a.drop("ver").intersect(b.drop("ver"))


@query("""
    SELECT event_id, before FROM (
        SELECT event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)
    WHERE value < before""")
def running_max_regression(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return relational.regressions(rows, ["user_id"], ["ts", "event_id"], "value").select("event_id", "before")


@query("""
    SELECT event_id, last_value(g IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS context
    FROM (SELECT event_id, user_id, ts, CASE WHEN event_id % 5 = 0 THEN event_type END AS g FROM events)""")
def fill_forward(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("event_id") % 5 == 0, F.col("event_type")), ignorenulls=True).over(w).alias("context"))


_NAT = "list_aggregate(list_transform(regexp_extract_all({c}, '([0-9]+|[^0-9]+)', 1), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(CAST(length(coalesce(nullif(ltrim(p, '0'), ''), '0')) AS VARCHAR), 4, '0') || coalesce(nullif(ltrim(p, '0'), ''), '0') ELSE p END), 'string_agg', '')"


@query(f"SELECT s_suppkey, {_NAT.format(c='s_name')} AS sort_key FROM supplier")
def key_sort_natural(spark, sf_dir):
    return t(spark, sf_dir, "supplier").select("s_suppkey", relational.natural_key(F.col("s_name")).alias("sort_key"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def limit_offset_page(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)


# -- diff and merge -------------------------------------------------------------------------

#: Two versions of the whole of ``supplier``: some keys are only in one of them, some cells differ.
_VERSIONS = """
    a AS (SELECT CASE WHEN s_suppkey % 7 = 0 THEN -s_suppkey ELSE s_suppkey END AS s_suppkey, s_name, s_acctbal AS bal FROM supplier),
    b AS (SELECT CASE WHEN s_suppkey % 11 = 0 THEN -s_suppkey ELSE s_suppkey END AS s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN s_name || ' x' ELSE s_name END AS s_name,
          CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS bal FROM supplier)"""


def _versions(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").alias("bal"))
    a = s.withColumn("s_suppkey", F.expr("if(s_suppkey % 7 = 0, -s_suppkey, s_suppkey)"))
    other = {"s_name": "if(s_suppkey % 5 = 0, s_name || ' x', s_name)", "bal": "if(s_suppkey % 4 = 0, bal + 1, bal)", "s_suppkey": "if(s_suppkey % 11 = 0, -s_suppkey, s_suppkey)"}
    return a, s.withColumns({c: F.expr(e) for c, e in other.items()})


@query(f"""
    WITH {_VERSIONS}, j AS (SELECT a.s_suppkey AS ka, b.s_suppkey AS kb, a.s_name <> b.s_name OR a.bal <> b.bal AS changed FROM a FULL JOIN b ON a.s_suppkey = b.s_suppkey)
    SELECT CASE WHEN ka IS NULL THEN 'added' WHEN kb IS NULL THEN 'removed' ELSE 'changed' END AS kind, count(*) AS n FROM j WHERE ka IS NULL OR kb IS NULL OR changed GROUP BY 1""")
def diff_counts(spark, sf_dir):
    a, b = _versions(spark, sf_dir)
    return revise.diff_rows(a, b, ["s_suppkey"], ["s_suppkey"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    WITH {_VERSIONS}, j AS (SELECT a.s_suppkey AS k, a.s_name AS na, b.s_name AS nb, a.bal AS ba, b.bal AS bb FROM a JOIN b ON a.s_suppkey = b.s_suppkey)
    SELECT CAST(k AS VARCHAR) AS key, 's_name' AS heading, na = nb AS same_text FROM j WHERE na <> nb UNION ALL SELECT CAST(k AS VARCHAR), 'bal', ba = bb FROM j WHERE ba <> bb""")
def diff_cells(spark, sf_dir):
    a, b = _versions(spark, sf_dir)
    cells = revise.diff_cells(revise.diff_rows(a, b, ["s_suppkey"], ["s_suppkey"]))
    return cells.select(F.col("key")[0].alias("key"), "heading", (F.col("a") == F.col("b")).alias("same_text"))


_THREE = """
    v AS (SELECT 0 AS f, CASE WHEN s_suppkey % 3 = 0 THEN -s_suppkey ELSE s_suppkey END AS k, s_name AS name, s_acctbal AS bal, NULL AS note FROM supplier
          UNION ALL SELECT 1, CASE WHEN s_suppkey % 4 = 0 THEN -s_suppkey ELSE s_suppkey END, s_name || '*', NULL, CASE WHEN s_suppkey % 2 = 0 THEN 'n' END FROM supplier
          UNION ALL SELECT 2, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey ELSE -s_suppkey END, NULL, s_acctbal * 2, NULL FROM supplier)"""


def _three(spark, sf_dir):
    s = t(spark, sf_dir, "supplier")
    one = s.selectExpr("if(s_suppkey % 3 = 0, -s_suppkey, s_suppkey) k", "s_name name", "s_acctbal bal")
    two = s.selectExpr("if(s_suppkey % 4 = 0, -s_suppkey, s_suppkey) k", "s_name || '*' name", "if(s_suppkey % 2 = 0, 'n', null) note")
    three = s.selectExpr("if(s_suppkey % 5 = 0, s_suppkey, -s_suppkey) k", "s_acctbal * 2 bal")
    return [one, two, three]


@query(f"""
    WITH {_THREE}
    SELECT k, arg_max({{'x': name}}, f) FILTER (WHERE f IN (0, 1)).x AS name, round(arg_max({{'x': bal}}, f) FILTER (WHERE f IN (0, 2)).x, 2) AS bal, arg_max({{'x': note}}, f) FILTER (WHERE f = 1).x AS note
    FROM v GROUP BY k""".replace("arg_max({'x': name}, f) FILTER (WHERE f IN (0, 1)).x", "(arg_max({'x': name}, f) FILTER (WHERE f IN (0, 1))).x").replace("arg_max({'x': bal}, f) FILTER (WHERE f IN (0, 2)).x", "(arg_max({'x': bal}, f) FILTER (WHERE f IN (0, 2))).x").replace("arg_max({'x': note}, f) FILTER (WHERE f = 1).x", "(arg_max({'x': note}, f) FILTER (WHERE f = 1)).x"))
def merge_latest(spark, sf_dir):
    """Later versions win for each cell they carry; a blank they carry overwrites."""
    return revise.merge(_three(spark, sf_dir), ["k"], ["k"]).select("k", "name", F.round("bal", 2).alias("bal"), "note")


@query(f"""
    WITH {_THREE}, n AS (SELECT k, f, name, lag(name) OVER w AS was FROM v WHERE f IN (0, 1) WINDOW w AS (PARTITION BY k ORDER BY f) QUALIFY row_number() OVER w > 1),
         b AS (SELECT k, f, bal, lag(bal) OVER w AS was FROM v WHERE f IN (0, 2) WINDOW w AS (PARTITION BY k ORDER BY f) QUALIFY row_number() OVER w > 1)
    SELECT k, f AS file_idx, 'name' AS heading FROM n WHERE name IS DISTINCT FROM was UNION ALL SELECT k, f, 'bal' FROM b WHERE bal IS DISTINCT FROM was""")
def merge_revisions(spark, sf_dir):
    return revise.revisions(_three(spark, sf_dir), ["k"], ["k"]).select("k", "file_idx", "heading")


# -- text -----------------------------------------------------------------------------------

for _k, _p, _fn in (("contains", "'%example%'", lambda c: c.contains("example")), ("starts", "'https://%'", lambda c: c.startswith("https://")), ("ends", "'%.html'", lambda c: c.endswith(".html"))):

    def _like(spark, sf_dir, f=_fn):
        return t(spark, sf_dir, "pages").where(f(F.col("url"))).select("page_id", "url")

    QUERIES[f"like_{_k}"] = _like
    SQL[f"like_{_k}"] = "SELECT page_id, url FROM pages WHERE " + {"contains": "contains(url, 'example')", "starts": "starts_with(url, 'https://')", "ends": "ends_with(url, '.html')"}[_k]


@query("""
    SELECT user_id, 'ID' || lpad(CAST(dense_rank() OVER (ORDER BY first_seen, user_id) AS VARCHAR), 6, '0') AS pseudonym
    FROM (SELECT user_id, min(event_id) AS first_seen FROM events GROUP BY 1)""")
def censor_pseudonym(spark, sf_dir):
    from ..operators import censor

    return censor.pseudonyms(t(spark, sf_dir, "events"), "user_id", "event_id", "ID", 6).select("user_id", "pseudonym")


@query(r"""
    SELECT s_suppkey, regexp_matches(v, '^-?\d+\.\d{2}$') AS ok FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN printf('%.1f', s_acctbal) ELSE printf('%.2f', s_acctbal) END AS v FROM supplier)""")
def type_conformance(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select("s_suppkey", F.expr("if(s_suppkey % 3 = 0, format_string('%.1f', s_acctbal), format_string('%.2f', s_acctbal))").alias("v"))
    return s.select("s_suppkey", values.is_ndp(F.col("v"), 2).alias("ok"))


_CELLS = ["1.5", " 2 ", "1d", "1f", "NaN", "inf", "-3e2", "", "x", ".5", "5.", "+7", "1_0", "0x10", "1e400"]
_CELLS_SQL = ", ".join(f"'{c}'" for c in _CELLS)


@query(f"""
    SELECT s_suppkey, v, CASE WHEN regexp_full_match(trim(v), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') AND isfinite(TRY_CAST(trim(v) AS DOUBLE)) THEN TRY_CAST(trim(v) AS DOUBLE) END AS parsed
    FROM (SELECT s_suppkey, ([{_CELLS_SQL}])[1 + s_suppkey % {len(_CELLS)}] AS v FROM supplier)""")
def parse_decimal(spark, sf_dir):
    cells = F.array(*map(F.lit, _CELLS))
    s = t(spark, sf_dir, "supplier").select("s_suppkey", F.element_at(cells, (F.col("s_suppkey") % len(_CELLS) + 1).cast("int")).alias("v"))
    return s.withColumn("parsed", values.parse_decimal(F.col("v")))


@query("""
    SELECT o_orderkey, CASE upper(o_orderstatus) WHEN 'O' THEN NULL WHEN 'F' THEN false ELSE true END AS parsed FROM orders""")
def parse_bool(spark, sf_dir):
    text = F.expr("case o_orderstatus when 'F' then 'no' when 'O' then 'maybe' else ' Y ' end")
    return t(spark, sf_dir, "orders").select("o_orderkey", values.parse_bool(text).alias("parsed"))


@query("SELECT o_orderkey, date_trunc('day', o_orderdate) AS parsed FROM orders")
def parse_datetime(spark, sf_dir):
    text = F.expr("case o_orderkey % 3 when 0 then date_format(o_orderdate, 'yyyy-MM-dd') when 1 then date_format(o_orderdate, 'dd/MM/yyyy') else date_format(o_orderdate, \"yyyy-MM-dd'T'00:00\") end")
    return t(spark, sf_dir, "orders").select("o_orderkey", values.parse_datetime(text).alias("parsed"))


@query("SELECT part AS code, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS part FROM part) WHERE part NOT IN ('STEEL', 'BRASS', 'LARGE') GROUP BY 1")
def referenced_codes(spark, sf_dir):
    """Code parts that a catalogue lacks; parts are made distinct before the lookup."""
    parts = t(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    known = spark.createDataFrame([("STEEL",), ("BRASS",), ("LARGE",)], "code string")
    return parts.join(known, "code", "left_anti")


_FINDINGS = """
    f AS (SELECT '10b' AS rule, 'error' AS severity, p_partkey AS line FROM part WHERE p_brand = 'Brand#11'
          UNION ALL SELECT '8', 'warning', p_partkey FROM part WHERE p_size > 45 UNION ALL SELECT '1', 'fyi', p_partkey FROM part WHERE p_partkey % 50 = 0)"""


def _findings(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    one = part.where("p_brand = 'Brand#11'").selectExpr("'10b' rule", "'error' severity", "p_partkey line")
    two = part.where("p_size > 45").selectExpr("'8' rule", "'warning' severity", "p_partkey line")
    return one.unionByName(two).unionByName(part.where("p_partkey % 50 = 0").selectExpr("'1' rule", "'fyi' severity", "p_partkey line"))


@query("SELECT p_partkey, concat_ws('|', coalesce(nullif(p_brand, 'Brand#11'), '??p_brand??'), p_name) AS echo FROM part WHERE p_brand = 'Brand#11'")
def required_blank(spark, sf_dir):
    part = t(spark, sf_dir, "part").select("p_partkey", F.expr("nullif(p_brand, 'Brand#11')").alias("p_brand"), "p_name")
    return part.where("p_brand is null").select("p_partkey", F.concat_ws("|", F.coalesce("p_brand", F.lit("??p_brand??")), "p_name").alias("echo"))


@query(f"WITH {_FINDINGS} SELECT count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'fyi') AS notes FROM f")
def verdict_by_severity(spark, sf_dir):
    return analytics.verdict(_findings(spark, sf_dir))


@query(f"WITH {_FINDINGS} SELECT rule, line, total FROM (SELECT *, count(*) OVER (PARTITION BY rule) AS total, row_number() OVER (PARTITION BY rule ORDER BY line) AS turn FROM f) WHERE turn <= 5")
def findings_cap(spark, sf_dir):
    return analytics.capped(_findings(spark, sf_dir), 5, ["line"]).select("rule", "line", "total")


@query(f"WITH {_FINDINGS} SELECT rule, count(*) AS n FROM f GROUP BY 1")
def rule_profile(spark, sf_dir):
    return _findings(spark, sf_dir).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'nation' AS tbl, unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS column_name UNION ALL SELECT 'region', unnest(['r_regionkey', 'r_name'])")
def schema_catalog(spark, sf_dir):
    rows = [(n, c) for n in ("nation", "region") for c in t(spark, sf_dir, n).columns]
    return spark.createDataFrame(rows, "tbl string, column_name string")


@query("SELECT n_name AS nation, s_name AS name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 100 ORDER BY s_acctbal DESC, s_name LIMIT 25")
def select_composer(spark, sf_dir):
    from ..plans import composer

    spec = composer.Select("supplier", ["s_name", "s_acctbal"], [composer.Condition("s_acctbal", ">", "100")], order_by="s_acctbal", order_dir="desc", limit=25, joins=[composer.Join("nation", [("s_nationkey", "n_nationkey")], ["n_name"])])
    out = composer.frame(spec, {n: t(spark, sf_dir, n) for n in ("supplier", "nation")}, tie=["s_name"])
    return out.withColumnsRenamed({"n_name": "nation", "s_name": "name"})

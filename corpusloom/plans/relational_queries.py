"""The relational vocabulary on the order tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from corpusloom.operators.skew import last_per_key
from corpusloom.plans.catalog import query, r6
from corpusloom.sources.tables import read_table


@query(
    "inner_join",
    """SELECT c_mktsegment, o_orderpriority, count(*) AS lines,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    GROUP BY ALL""",
)
def inner_join(spark, sf):
    lines, orders, customers = (
        read_table(spark, sf, t) for t in ("lineitem", "orders", "customer")
    )
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customers, orders.o_custkey == customers.c_custkey)
        .groupBy("c_mktsegment", "o_orderpriority")
        .agg(F.count(F.lit(1)).alias("lines"), F.round(revenue, 2).alias("revenue"))
    )


@query(
    "left_outer_join",
    """SELECT n_name, count(s_suppkey) AS suppliers, round(coalesce(sum(s_acctbal), 0), 2)
    AS balance FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""",
)
def left_outer_join(spark, sf):
    nations, suppliers = read_table(spark, sf, "nation"), read_table(spark, sf, "supplier")
    return nations.join(
        suppliers, nations.n_nationkey == suppliers.s_nationkey, "left"
    ).groupBy("n_name").agg(
        F.count("s_suppkey").alias("suppliers"),
        F.round(F.coalesce(F.sum("s_acctbal"), F.lit(0.0)), 2).alias("balance"),
    )


@query(
    "semi_join",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders "
    "WHERE o_totalprice > 300000)",
)
def semi_join(spark, sf):
    big = read_table(spark, sf, "orders").filter("o_totalprice > 300000")
    customers = read_table(spark, sf, "customer")
    return customers.join(big, customers.c_custkey == big.o_custkey, "left_semi").select(
        "c_custkey", "c_name"
    )


@query(
    "anti_join",
    """SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN
    (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def anti_join(spark, sf):
    """Customers without any urgent order."""
    customers = read_table(spark, sf, "customer")
    orders = read_table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    return customers.join(orders, customers.c_custkey == orders.o_custkey, "left_anti").select(
        "c_custkey", "c_name"
    )


@query(
    "full_outer_join",
    """SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS returned, coalesce(b.n, 0) AS open
    FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R'
        AND l_quantity > 45 GROUP BY 1) a
    FULL JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'O'
        AND l_quantity < 5 GROUP BY 1) b ON a.k = b.k""",
)
def full_outer_join(spark, sf):
    lines = read_table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "k")
    count = lambda rows, name: rows.groupBy("k").agg(F.count(F.lit(1)).alias(name))
    returned = count(lines.filter("l_returnflag = 'R' and l_quantity > 45"), "returned")
    still_open = count(lines.filter("l_linestatus = 'O' and l_quantity < 5"), "open")
    return returned.join(still_open, "k", "outer").fillna(0, ["returned", "open"])


@query(
    "self_join",
    """SELECT a.l_returnflag AS first_flag, b.l_returnflag AS next_flag, count(*) AS n,
    round(sum(b.l_quantity - a.l_quantity), 2) AS change
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
    AND b.l_linenumber = a.l_linenumber + 1 GROUP BY ALL""",
)
def self_join(spark, sf):
    lines = read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"
    )
    following = lines.select(
        "l_orderkey",
        (F.col("l_linenumber") - 1).alias("l_linenumber"),
        F.col("l_returnflag").alias("next_flag"),
        F.col("l_quantity").alias("next_quantity"),
    )
    return (
        lines.join(following, ["l_orderkey", "l_linenumber"])
        .groupBy(F.col("l_returnflag").alias("first_flag"), "next_flag")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.sum(F.col("next_quantity") - F.col("l_quantity")), 2).alias("change"),
        )
    )


@query(
    "hash_aggregate",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers,
    max(l_shipdate) AS last_shipped, round(avg(l_quantity), 6) AS mean_quantity,
    round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY ALL""",
)
def hash_aggregate(spark, sf):
    return read_table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("l_suppkey").alias("suppliers"),
        F.max("l_shipdate").alias("last_shipped"),
        r6(F.avg("l_quantity"), "mean_quantity"),
        F.round(F.sum("l_extendedprice"), 2).alias("total"),
    )


@query("distinct_values", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct_values(spark, sf):
    return read_table(spark, sf, "part").select("p_brand", "p_type").distinct()


@query(
    "sort_limit_offset",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey "
    "LIMIT 10 OFFSET 20",
)
def sort_limit_offset(spark, sf):
    """Page three of the dearest orders."""
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(20).limit(10)


@query(
    "latest_per_group",
    """SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders QUALIFY row_number()
    OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def latest_per_group(spark, sf):
    orders = read_table(spark, sf, "orders").select(
        "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"
    )
    return last_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(
    "running_totals",
    """SELECT l_orderkey, l_linenumber, row_number() OVER w AS place,
    round(sum(l_quantity) OVER w, 2) AS running, lag(l_quantity) OVER w AS previous,
    lead(l_quantity) OVER w AS following FROM lineitem
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
        l_extendedprice)""",
)
def running_totals(spark, sf):
    # line numbers repeat within an order here, so the order is made total
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    return read_table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.row_number().over(w).alias("place"),
        F.round(F.sum("l_quantity").over(w), 2).alias("running"),
        F.lag("l_quantity").over(w).alias("previous"),
        F.lead("l_quantity").over(w).alias("following"),
    )


@query(
    "set_operations",
    """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'),
    b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 48)
    SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b)
    UNION ALL SELECT 'except', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
    UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)""",
)
def set_operations(spark, sf):
    lines = read_table(spark, sf, "lineitem")
    keys = lambda rule: lines.filter(rule).select(F.col("l_partkey").alias("k")).distinct()
    a, b = keys("l_returnflag = 'R'"), keys("l_quantity > 48")
    label = lambda df, op: df.select(F.lit(op).alias("op"), "k")
    return (
        label(a.union(b).distinct(), "union")
        .union(label(a.subtract(b), "except"))
        .union(label(a.intersect(b), "intersect"))
    )


@query(
    "string_functions",
    """SELECT p_partkey, lower(trim(p_name)) AS name, string_split(p_type, ' ')[1] AS first_word,
    instr(p_name, 'a') AS a_at, substr(p_brand, 1, 5) AS brand,
    concat_ws('-', p_brand, p_type) AS label, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS masked
    FROM part""",
)
def string_functions(spark, sf):
    return read_table(spark, sf, "part").select(
        "p_partkey",
        F.lower(F.trim("p_name")).alias("name"),
        F.split("p_type", " ")[0].alias("first_word"),
        F.instr("p_name", "a").alias("a_at"),
        F.substring("p_brand", 1, 5).alias("brand"),
        F.concat_ws("-", "p_brand", "p_type").alias("label"),
        F.regexp_replace("p_type", "[AEIOU]", "_").alias("masked"),
    )


@query(
    "math_functions",
    """SELECT c_custkey, round(ln(abs(c_acctbal) + 1), 6) AS ln_balance,
    round(sqrt(abs(c_acctbal)), 6) AS root, greatest(c_acctbal, 0.0) AS positive,
    round_even(c_nationkey / 2.0::DOUBLE, 0) AS half_even, c_custkey % 7 AS remainder
    FROM customer""",
)
def math_functions(spark, sf):
    balance = F.col("c_acctbal")
    return read_table(spark, sf, "customer").select(
        "c_custkey",
        r6(F.log(F.abs(balance) + 1), "ln_balance"),
        r6(F.sqrt(F.abs(balance)), "root"),
        F.greatest(balance, F.lit(0.0)).alias("positive"),
        F.bround(F.col("c_nationkey") / F.lit(2.0), 0).alias("half_even"),
        (F.col("c_custkey") % 7).alias("remainder"),
    )


@query(
    "arrays_maps_json",
    """WITH e AS (SELECT user_id, event_type, (props->>'k')::INT AS k FROM events)
    SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds, sum(k)::BIGINT AS total_k,
    count(*) FILTER (event_type = 'click') AS clicks,
    '{"clicks":' || count(*) FILTER (event_type = 'click') || '}' AS payload
    FROM e GROUP BY user_id""",
)
def arrays_maps_json(spark, sf):
    events = read_table(spark, sf, "events").withColumn(
        "k", F.from_json("props", "struct<k:int>")["k"]
    )
    clicks = F.count_if(F.col("event_type") == "click")
    out = events.groupBy("user_id").agg(
        F.sort_array(F.collect_set("event_type")).alias("kinds"),
        F.sum("k").alias("total_k"),
        clicks.alias("clicks"),
    )
    return out.withColumn("payload", F.to_json(F.create_map(F.lit("clicks"), F.col("clicks"))))


@query(
    "date_comparison",
    """SELECT o_orderstatus, count(*) AS n, min(o_orderdate) AS first_order,
    count(*) FILTER (o_orderdate > TIMESTAMP '1997-01-01') AS recent FROM orders
    WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY o_orderstatus""",
)
def date_comparison(spark, sf):
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    orders = read_table(spark, sf, "orders").filter(F.col("o_orderdate") < day("1999-01-01"))
    return orders.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("o_orderdate").alias("first_order"),
        F.count_if(F.col("o_orderdate") > day("1997-01-01")).alias("recent"),
    )

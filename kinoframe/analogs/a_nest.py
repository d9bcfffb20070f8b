"""Nest / unnest analogs."""

from pyspark.sql import functions as F

from kinoframe.analogs import register
from kinoframe.analogs.common import r6, t
from kinoframe.operators.nest import (attach, nest_by_role, nest_list, nest_map, nest_map2, nest_values,
                                      unnest_list, unnest_map2, unnest_roles)

TYPES = ["click", "error", "purchase", "signup", "view"]


@register("nest_list", """
SELECT conv_id, count(*) AS n_turns,
       string_agg(CAST(turn AS VARCHAR) || ':' || role || ':' || md5(text), '|'
                  ORDER BY turn, role, text) AS transcript
  FROM conversations GROUP BY conv_id
""")
def nest_list_query(spark, sf_dir):
    conv = t(spark, sf_dir, "conversations")
    nested = nest_list(conv, "conv_id", ["turn", "role", "text"], order=["turn"], alias="turns")
    return nested.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: F.concat(
            x["turn"].cast("string"), F.lit(":"), x["role"], F.lit(":"), F.md5(x["text"]))), "|")
        .alias("transcript"))


def _per_type_cols(m):
    cols = []
    for ty in TYPES:
        cols.append(r6(m[ty]["avg_value"]).alias(f"avg_{ty}"))
        cols.append(m[ty]["n"].alias(f"n_{ty}"))
    return cols


@register("nest_map", """
SELECT user_id,
       string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types,
""" + ",\n".join(
    f"       round(avg(value) FILTER (WHERE event_type = '{ty}'), 6) AS avg_{ty},\n"
    f"       CASE WHEN count(*) FILTER (WHERE event_type = '{ty}') = 0 THEN NULL"
    f" ELSE count(*) FILTER (WHERE event_type = '{ty}') END AS n_{ty}" for ty in TYPES) + """
  FROM events GROUP BY user_id
""")
def nest_map_query(spark, sf_dir):
    ev = t(spark, sf_dir, "events")
    per = ev.groupBy("user_id", "event_type").agg(F.avg("value").alias("avg_value"),
                                                  F.count("*").alias("n"))
    m = nest_map(per, "user_id", "event_type", ["avg_value", "n"], alias="by_type")
    return m.select("user_id", F.array_join(F.array_sort(F.map_keys("by_type")), ",").alias("types"),
                    *_per_type_cols(F.col("by_type")))


FLAGS, STATUSES = ["A", "N", "R"], ["F", "O"]


@register("nest_map2", """
SELECT l_suppkey,
       string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags,
""" + ",\n".join(
    f"       round(sum(l_quantity) FILTER (WHERE l_returnflag = '{f}' AND l_linestatus = '{s}'), 6) AS qty_{f}_{s}"
    for f in FLAGS for s in STATUSES) + """
  FROM lineitem GROUP BY l_suppkey
""")
def nest_map2_query(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    per = li.groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"))
    m = nest_map2(per, "l_suppkey", "l_returnflag", "l_linestatus", "qty", alias="qty_map")
    return m.select("l_suppkey", F.array_join(F.array_sort(F.map_keys("qty_map")), ",").alias("flags"),
                    *[r6(F.col("qty_map")[f][s]).alias(f"qty_{f}_{s}") for f in FLAGS for s in STATUSES])


@register("assemble_records", """
SELECT c.c_custkey, c.c_name, o.n_orders, o.first_order, o.order_list,
       coalesce(s.n_status, 0) AS n_status, s.status_f, s.status_o, s.status_p
  FROM customer c
  LEFT JOIN (SELECT o_custkey, count(*) AS n_orders,
                    arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order,
                    string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS order_list
               FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey
  LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_status,
                    nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS status_f,
                    nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS status_o,
                    nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS status_p
               FROM orders GROUP BY o_custkey) s ON c.c_custkey = s.o_custkey
""")
def assemble_query(spark, sf_dir):
    """B1 + J2: header with a nested list and a nested map; missing list
    stays NULL, missing map becomes an empty map."""
    cust = t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    lists = nest_values(orders, "c_custkey", "o_orderkey", order=["o_orderdate"], alias="orders")
    counts = orders.groupBy("c_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    maps = nest_map(counts, "c_custkey", "o_orderstatus", ["n"], alias="status")
    rec = attach(cust, "c_custkey", [lists, maps], empty_map_cols=["status"])
    return rec.select(
        "c_custkey", "c_name",
        F.when(F.col("orders").isNotNull(), F.size("orders").cast("long")).alias("n_orders"),
        F.element_at("orders", 1).alias("first_order"),
        F.array_join(F.transform("orders", lambda x: x.cast("string")), ",").alias("order_list"),
        F.size("status").cast("long").alias("n_status"),
        F.col("status")["F"]["n"].alias("status_f"),
        F.col("status")["O"]["n"].alias("status_o"),
        F.col("status")["P"]["n"].alias("status_p"))


@register("unnest_pos", """
SELECT vec_id, generate_subscripts(embedding, 1) AS rank,
       round(CAST(unnest(embedding) AS DOUBLE), 6) AS value
  FROM embeddings
""")
def unnest_pos_query(spark, sf_dir):
    emb = t(spark, sf_dir, "embeddings")
    out = unnest_list(emb, "vec_id", "embedding", rank="rank", value="value")
    return out.select("vec_id", F.col("rank").cast("long").alias("rank"),
                      r6(F.col("value").cast("double")).alias("value"))


@register("unnest_sorted", """
SELECT p_partkey, generate_subscripts(w, 1) AS rank, unnest(w) AS word
  FROM (SELECT p_partkey, list_sort(string_split(p_name, ' ')) AS w FROM part)
""")
def unnest_sorted_query(spark, sf_dir):
    part = t(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    out = unnest_list(part, "p_partkey", "words", rank="rank", sort=True, value="word")
    return out.select("p_partkey", F.col("rank").cast("long").alias("rank"), "word")


@register("unnest_map", """
SELECT l_suppkey, l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS qty
  FROM lineitem GROUP BY ALL
""")
def unnest_map_query(spark, sf_dir):
    """Round trip nest_map2 -> unnest_map2 gives back the grouped rows."""
    li = t(spark, sf_dir, "lineitem")
    per = li.groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"))
    m = nest_map2(per, "l_suppkey", "l_returnflag", "l_linestatus", "qty", alias="qty_map")
    out = unnest_map2(m, "l_suppkey", "qty_map", "l_returnflag", "l_linestatus", value_name="qty")
    return out.select("l_suppkey", "l_returnflag", "l_linestatus", r6("qty").alias("qty"))


@register("unnest_roles", """
SELECT l_orderkey AS o_orderkey, l_returnflag AS role,
       row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS rank,
       l_partkey
  FROM lineitem
""")
def unnest_roles_query(spark, sf_dir):
    """B2: per-role nested lists (one per return flag) exploded back to one
    table with role and rank per role."""
    li = t(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    lists = nest_by_role(li, "o_orderkey", "l_returnflag", {f: f"list_{f}" for f in FLAGS},
                         ["l_partkey"], order=["l_linenumber"], single=True)
    rec = attach(t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", [lists])
    out = unnest_roles(rec, "o_orderkey", {f: f"list_{f}" for f in FLAGS}, role="role", rank="rank",
                       value="l_partkey")
    return out.select("o_orderkey", "role", F.col("rank").cast("long").alias("rank"), "l_partkey")

"""wide_export: orders as header, lineitem as the child table.

Role = l_returnflag, rank = l_linenumber, value = l_partkey as text; pivot =
average discount per flag, average tax of open lines.
"""

from kinoframe.analogs import register
from kinoframe.analogs.common import r6, t
from kinoframe.operators.export import ChildPart, CondAvg, ListAgg, wide_export

SQL = """
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, o.o_orderpriority,
       c.line_statuses, c.returned_parts, c.accepted_parts, c.open_parts,
       round(c.disc_r, 6) AS disc_r, round(c.disc_a, 6) AS disc_a,
       round(c.disc_n, 6) AS disc_n, round(c.tax_open, 6) AS tax_open
  FROM orders o
  LEFT JOIN (
    SELECT l_orderkey,
           string_agg(l_linestatus, ' / ' ORDER BY l_linestatus) AS line_statuses,
           string_agg(CAST(l_partkey AS VARCHAR), ' / ' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR))
             FILTER (WHERE l_returnflag = 'R' AND l_linenumber <= 5) AS returned_parts,
           string_agg(CAST(l_partkey AS VARCHAR), ' / ' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR))
             FILTER (WHERE l_returnflag = 'A' AND l_linenumber <= 3) AS accepted_parts,
           string_agg(CAST(l_partkey AS VARCHAR), ' / ' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR))
             FILTER (WHERE l_returnflag = 'N' AND l_linenumber <= 3) AS open_parts,
           avg(l_discount) FILTER (WHERE l_returnflag = 'R') AS disc_r,
           avg(l_discount) FILTER (WHERE l_returnflag = 'A') AS disc_a,
           avg(l_discount) FILTER (WHERE l_returnflag = 'N') AS disc_n,
           avg(l_tax) FILTER (WHERE l_linestatus = 'O') AS tax_open
      FROM lineitem
     GROUP BY l_orderkey) c
    ON o.o_orderkey = c.l_orderkey
"""


def wide_export_query(spark, sf_dir):
    orders, lineitem = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    part = ChildPart(lineitem, [
        ListAgg("line_statuses", "l_linestatus"),
        ListAgg("returned_parts", "l_partkey", ["l_linenumber"], "l_returnflag = 'R' AND l_linenumber <= 5"),
        ListAgg("accepted_parts", "l_partkey", ["l_linenumber"], "l_returnflag = 'A' AND l_linenumber <= 3"),
        ListAgg("open_parts", "l_partkey", ["l_linenumber"], "l_returnflag = 'N' AND l_linenumber <= 3"),
        CondAvg("disc_r", "l_discount", "l_returnflag = 'R'"),
        CondAvg("disc_a", "l_discount", "l_returnflag = 'A'"),
        CondAvg("disc_n", "l_discount", "l_returnflag = 'N'"),
        CondAvg("tax_open", "l_tax", "l_linestatus = 'O'"),
    ])
    child = part.df.withColumnRenamed("l_orderkey", "o_orderkey")
    part.df = child
    out = wide_export(orders, "o_orderkey", [part])
    return out.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
        "line_statuses", "returned_parts", "accepted_parts", "open_parts",
        r6("disc_r").alias("disc_r"), r6("disc_a").alias("disc_a"),
        r6("disc_n").alias("disc_n"), r6("tax_open").alias("tax_open"))


register("wide_export", SQL)(wide_export_query)

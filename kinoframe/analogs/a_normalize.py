"""Normalisation analogs: raw strings in the source formats are built from
the testdata tables, parsed back with the library's expressions, and checked
against the source columns (the oracle never repeats the regex)."""

from pyspark.sql import functions as F

from kinoframe.analogs import register
from kinoframe.analogs.common import t, ts_text
from kinoframe.functions.text import (parse_aka, parse_release, parse_votes, people_list,
                                      strip_author, to_int_or_null)
from kinoframe.operators.priority import median_int, pick_release_dates, pick_titles, shortest_text

# priority -> tag text appended after the date (three tags: only the last two survive)
TAGS = {"1-URGENT": " (re-release)", "2-HIGH": " (limited)", "3-MEDIUM": " (Oporto)\n (premiere)",
        "4-NOT SPECIFIED": " (a)\n (b)\n (limited)", "5-LOW": ""}
TAGS_SQL = ("CASE o_orderpriority WHEN '1-URGENT' THEN 're-release' WHEN '2-HIGH' THEN 'limited' "
            "WHEN '3-MEDIUM' THEN 'Oporto,premiere' WHEN '4-NOT SPECIFIED' THEN 'b,limited' END")


def _release_strings(spark, sf_dir):
    """One release string per order: country = the customer's nation, date
    precision by order status (F: day, O: month, P: year)."""
    o = t(spark, sf_dir, "orders")
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    x = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    fmt = (F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "d MMMM yyyy"))
           .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "MMMM yyyy"))
           .otherwise(F.date_format("o_orderdate", "yyyy")))
    tag = F.coalesce(*[F.when(F.col("o_orderpriority") == k, F.lit(v)) for k, v in TAGS.items()])
    return x.select("o_orderkey", "o_custkey",
                    F.concat(F.col("n_name"), F.lit("::"), fmt, tag).alias("release"))


RELEASE_CTE = f"""
WITH r AS (
  SELECT o.o_orderkey, o.o_custkey, n.n_name AS country,
         CASE o.o_orderstatus WHEN 'F' THEN o.o_orderdate
              WHEN 'O' THEN date_trunc('month', o.o_orderdate)
              ELSE date_trunc('year', o.o_orderdate) END AS date,
         {TAGS_SQL} AS tags
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)
"""


@register("parse_release", RELEASE_CTE + """
SELECT o_orderkey, country, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, tags FROM r
""")
def parse_release_query(spark, sf_dir):
    """N1 + N2."""
    p = _release_strings(spark, sf_dir).select("o_orderkey", parse_release("release").alias("r"))
    return p.select("o_orderkey", F.col("r.country").alias("country"), ts_text("r.date").alias("date"),
                    F.array_join("r.tags", ",").alias("tags"))


@register("priority_date", RELEASE_CTE + """
, k AS (SELECT * FROM r WHERE tags IS NULL OR tags <> 're-release')
SELECT o_custkey,
       strftime(coalesce(min(date) FILTER (WHERE tags IS NULL),
                         min(date) FILTER (WHERE tags LIKE '%limited%'),
                         min(date)), '%Y-%m-%d %H:%M:%S') AS original_release_date,
       strftime(coalesce(min(date) FILTER (WHERE tags IS NULL AND country = 'GERMANY'),
                         min(date) FILTER (WHERE tags LIKE '%limited%' AND country = 'GERMANY'),
                         min(date) FILTER (WHERE country = 'GERMANY')), '%Y-%m-%d %H:%M:%S') AS local_release_date
  FROM k GROUP BY o_custkey
""")
def priority_date_query(spark, sf_dir):
    """N1 + N2 + N3 + A11: per customer (film) over its orders (releases)."""
    p = _release_strings(spark, sf_dir).select("o_custkey", parse_release("release").alias("r")).select(
        "o_custkey", "r.*")
    out = pick_release_dates(p, "o_custkey", country="GERMANY")
    return out.select("o_custkey", ts_text("original_release_date").alias("original_release_date"),
                      ts_text("local_release_date").alias("local_release_date"))


AKA_FORMS = {"ECONOMY": "(original title)::", "LARGE": "World-wide (English title)::",
             "MEDIUM": "World-wide::", "PROMO": "Japan (festival title) (English title)::",
             "SMALL": "USA::", "STANDARD": "Canada (French title)::"}


def _aka_strings(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    prefix = F.coalesce(*[F.when(F.col("p_type") == k, F.lit(v)) for k, v in AKA_FORMS.items()],
                        F.lit("Elsewhere::"))
    return p.select("p_partkey", "p_brand", "p_type", F.concat(prefix, F.col("p_name")).alias("aka"))


@register("parse_title", """
SELECT p_partkey,
       CASE p_type WHEN 'ECONOMY' THEN '' WHEN 'LARGE' THEN 'World-wide' WHEN 'MEDIUM' THEN 'World-wide'
            WHEN 'PROMO' THEN 'Japan' WHEN 'SMALL' THEN 'USA' WHEN 'STANDARD' THEN 'Canada'
            ELSE 'Elsewhere' END AS country,
       CASE p_type WHEN 'ECONOMY' THEN 'original title' WHEN 'LARGE' THEN 'English title'
            WHEN 'PROMO' THEN 'English title' WHEN 'STANDARD' THEN 'French title' END AS tag,
       p_name AS title
  FROM part
""")
def parse_title_query(spark, sf_dir):
    """N4 (parsing)."""
    a = _aka_strings(spark, sf_dir).select("p_partkey", parse_aka("aka").alias("a"))
    return a.select("p_partkey", "a.country", "a.tag", "a.title")


@register("priority_title", """
SELECT p_brand,
       min(p_name) FILTER (WHERE p_type = 'ECONOMY') AS original_title,
       CASE WHEN min(p_name) FILTER (WHERE p_type = 'ECONOMY') IS NULL THEN NULL
            ELSE coalesce(min(p_name) FILTER (WHERE p_type = 'LARGE'),
                          min(p_name) FILTER (WHERE p_type IN ('LARGE', 'MEDIUM')),
                          min(p_name) FILTER (WHERE p_type IN ('LARGE', 'PROMO')),
                          min(p_name) FILTER (WHERE p_type = 'SMALL')) END AS english_title
  FROM part GROUP BY p_brand
""")
def priority_title_query(spark, sf_dir):
    """N4 + A12: per brand (film) over its parts (alternate titles)."""
    a = _aka_strings(spark, sf_dir).select("p_brand", parse_aka("aka").alias("a")).select("p_brand", "a.*")
    return pick_titles(a, "p_brand")


@register("parse_votes", """
SELECT c_custkey,
       CASE c_custkey % 4 WHEN 0 THEN CAST(floor(abs(c_acctbal * 100)) AS BIGINT)
                          WHEN 1 THEN CAST(floor(abs(c_acctbal * 100)) AS BIGINT) END AS votes,
       CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS metascore
  FROM customer
""")
def parse_votes_query(spark, sf_dir):
    """Vote texts in three shapes ('1234', 'x (1,234)', junk) and NULL;
    N7: a score text to int or NULL."""
    c = t(spark, sf_dir, "customer")
    n = F.floor(F.abs(F.col("c_acctbal") * 100)).cast("long")
    raw = (F.when(F.col("c_custkey") % 4 == 0, n.cast("string"))
           .when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("x ("), F.format_number(n, 0), F.lit(")")))
           .when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("xdfw"), F.format_number(n, 0), F.lit(")"))))
    score_txt = F.when(F.col("c_custkey") % 3 == 0, F.lit("n/a")).otherwise(F.col("c_nationkey").cast("string"))
    return c.select("c_custkey", parse_votes(raw).alias("votes"), to_int_or_null(score_txt).alias("metascore"))


@register("person_names", """
WITH p AS (
  SELECT p_partkey // 8 AS film, p_partkey,
         upper(w[1][1]) || w[1][2:] AS first, upper(w[2][1]) || w[2][2:] AS last,
         CAST(p_size AS BIGINT) AS person_id
    FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)
   WHERE p_size % 7 <> 0),
d AS (SELECT film, last || ', ' || first AS canonical_name, first || ' ' || last AS name, person_id,
             min(p_partkey) AS first_pos
        FROM p GROUP BY ALL)
SELECT film, canonical_name, name, person_id,
       row_number() OVER (PARTITION BY film ORDER BY first_pos) AS rank
  FROM d
""")
def person_names_query(spark, sf_dir):
    """N5 + W5: person records of each film (a film = 8 consecutive parts, so
    the list stays small like a real cast), half in 'Last, First' form, ids
    that do not parse for p_size divisible by 7; normalised, de-duplicated
    keeping the first occurrence, ranked."""
    p = t(spark, sf_dir, "part").withColumn("film", F.floor(F.col("p_partkey") / 8).cast("long"))
    w = F.split("p_name", " ")
    first, last = F.initcap(w[0]), F.initcap(w[1])
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", first, last)).otherwise(F.concat_ws(", ", last, first))
    pid = F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("string")).otherwise(F.lit("n/a"))
    persons = p.select("film", "p_partkey", F.struct(name.alias("name"), pid.alias("personID")).alias("person"))
    lists = persons.groupBy("film").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "person"))), lambda x: x["person"]).alias("raw"))
    clean = lists.select("film", people_list("raw").alias("people"))
    out = clean.select("film", F.posexplode("people").alias("pos", "pp"))
    return out.select("film", "pp.canonical_name", "pp.name", "pp.person_id",
                      (F.col("pos") + 1).cast("long").alias("rank"))


@register("shortest_text", """
SELECT source, md5(arg_min(text, (length(text), doc_id))) AS text_md5,
       min(length(text)) AS n_chars
  FROM documents WHERE text IS NOT NULL GROUP BY source
""")
def shortest_text_query(spark, sf_dir):
    """Shortest document per source (first by doc_id on ties)."""
    d = t(spark, sf_dir, "documents")
    s = shortest_text(d, "source", "text", "doc_id")
    return s.select("source", F.md5("text").alias("text_md5"),
                    F.length("text").cast("long").alias("n_chars"))


@register("strip_author", """
SELECT conv_id, turn, md5(trim(text)) AS plot_md5, role AS author
  FROM conversations
""")
def strip_author_query(spark, sf_dir):
    """N8: 'text::author' -> text (texts of whole conversation turns)."""
    c = t(spark, sf_dir, "conversations")
    raw = F.concat(F.col("text"), F.lit("::"), F.col("role"))
    return c.select("conv_id", "turn", F.md5(strip_author(raw)).alias("plot_md5"),
                    F.regexp_extract(raw, r"(?s)::([^:]*)$", 1).alias("author"))


@register("median_runtime", """
SELECT p_brand, CAST(CASE WHEN m - floor(m) = 0.5 THEN
                         CASE WHEN floor(m) % 2 = 0 THEN floor(m) ELSE floor(m) + 1 END
                     ELSE round(m) END AS INTEGER) AS p_size
  FROM (SELECT p_brand, median(p_size) AS m FROM part GROUP BY p_brand)
""")
def median_runtime_query(spark, sf_dir):
    """Median of listed sizes (runtimes), half to even, as int."""
    return median_int(t(spark, sf_dir, "part"), "p_brand", "p_size")

"""Ingest, lookup and selection analogs (S5-S8, N9, N13, N14, A9, A15, A16,
J5, P4, P5, P9, P10, P12, P16, O1, W4, W5, X1-X3)."""

from pyspark.sql import functions as F

from kinoframe.analogs import register
from kinoframe.analogs.common import r6, t, ts_text
from kinoframe.operators.lookup import (append_frames, bridge, bridge_sets, dedupe_first_words,
                                        exclude_blocked, first_by_alternate, genre_catalogue,
                                        get_one, popularity_tiers, recent_first, stale_first,
                                        tier_select)
from kinoframe.session import work_path
from kinoframe.sources.catalogue import (GENRE_PAGE_SCHEMA, catalogue_items, clean_catalogue_items,
                                         genre_page_index)
from kinoframe.sources.pages import extract_fields, page_popularity
from kinoframe.sources.tables import TableStore, write_genre_catalogue

PAGE_FIELDS = {"title": r"<title>(.*?)</title>", "lang": r'<html lang="([^"]*)"',
               "h1": r"<h1>(.*?)</h1>", "first_link": r'<a href="([^"]*)"'}


@register("pages_extract", """
SELECT page_id,
       nullif(regexp_extract(html, '<title>(.*?)</title>', 1), '') AS title,
       nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS lang,
       nullif(regexp_extract(html, '<h1>(.*?)</h1>', 1), '') AS h1,
       nullif(regexp_extract(html, '<a href="([^"]*)"', 1), '') AS first_link,
       CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS n_links
  FROM pages
""")
def pages_extract_query(spark, sf_dir):
    """Whole raw pages -> typed columns by pattern."""
    p = t(spark, sf_dir, "pages").select("page_id", "html")
    x = extract_fields(p, "html", PAGE_FIELDS)
    return x.select("page_id", "title", "lang", "h1", "first_link",
                    F.size(F.regexp_extract_all("html", F.lit("<a href="), 0)).cast("long").alias("n_links"))


@register("json_props", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       json_extract_string(props, '$.missing') AS missing
  FROM events
""")
def json_props_query(spark, sf_dir):
    """N14-style JSON field access on a string column."""
    e = t(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"),
                    F.get_json_object("props", "$.missing").alias("missing"))


ITEMS_CTE = """
WITH items AS (
  SELECT CAST(p_partkey AS VARCHAR) AS netflixid, p_name AS title,
         CASE WHEN p_size % 5 = 0 THEN '' ELSE CAST(p_retailprice AS VARCHAR) END AS rating,
         CASE p_partkey % 10 WHEN 0 THEN 'notfound' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'unknown'
              ELSE 'tt' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') END AS imdbid,
         p_retailprice, p_partkey, p_size
    FROM part)
"""


def _catalogue_pages(spark, sf_dir):
    """Catalogue pages as landed JSON text, one page per part row (all values
    strings, sentinel ids for some rows), parsed back with the S7 schema."""
    p = t(spark, sf_dir, "part")
    imdb = (F.when(F.col("p_partkey") % 10 == 0, "notfound").when(F.col("p_partkey") % 10 == 1, "")
            .when(F.col("p_partkey") % 10 == 2, F.lit(None)).when(F.col("p_partkey") % 10 == 3, "unknown")
            .otherwise(F.format_string("tt%07d", F.col("p_partkey"))))
    item = F.struct(F.col("p_partkey").cast("string").alias("netflixid"), F.col("p_name").alias("title"),
                    F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(F.col("p_retailprice").cast("string"))
                    .alias("rating"), imdb.alias("imdbid"))
    doc = F.to_json(F.struct(F.lit("1").alias("COUNT"), F.array(item).alias("ITEMS")))
    from kinoframe.sources.catalogue import CATALOGUE_SCHEMA
    return p.select(F.from_json(doc, CATALOGUE_SCHEMA).alias("j")).select("j.*")


@register("catalogue_clean", ITEMS_CTE + """
SELECT CAST(i.netflixid AS BIGINT) AS netflix_id, i.title AS netflix_title,
       round(TRY_CAST(i.rating AS DOUBLE), 6) AS netflix_rating, i.p_partkey AS imdbid,
       m.l_suppkey AS crit_id
  FROM items i JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) m ON i.p_partkey = m.l_partkey
 WHERE i.imdbid IS NOT NULL AND i.imdbid NOT IN ('', 'notfound', 'unknown')
""")
def catalogue_clean_query(spark, sf_dir):
    """S7 + N9 + P10 + J5: items parsed, sentinels dropped, bridged to
    internal ids (external id = part key; it maps to every supplier that
    shipped the part: a bounded fan-out)."""
    items = clean_catalogue_items(catalogue_items(_catalogue_pages(spark, sf_dir)))
    mapping = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("imdbid"),
                                                  F.col("l_suppkey").alias("crit_id"))
    out = bridge(items, mapping, "imdbid", "crit_id")
    return out.select("netflix_id", "netflix_title", r6("netflix_rating").alias("netflix_rating"),
                      "imdbid", "crit_id")


@register("bridge_fanout", """
SELECT l_partkey AS imdbid,
       string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) AS crit_ids, count(*) AS n
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) GROUP BY l_partkey
""")
def bridge_fanout_query(spark, sf_dir):
    """J5 map view: external id (part) -> set of internal ids (suppliers)."""
    m = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("imdbid"),
                                            F.col("l_suppkey").alias("crit_id"))
    s = bridge_sets(m, "imdbid", "crit_id")
    return s.select("imdbid", F.array_join(F.transform("crit_ids", lambda x: x.cast("string")), ",").alias("crit_ids"),
                    F.size("crit_ids").cast("long").alias("n"))


@register("inverted_index", """
SELECT CAST(p_size AS BIGINT) AS genreid, string_agg(DISTINCT name, ',' ORDER BY name) AS genre_names
  FROM (SELECT p_size, p_brand AS name FROM part UNION ALL SELECT p_size, p_type FROM part)
 GROUP BY p_size
""")
def inverted_index_query(spark, sf_dir):
    """S7 genre pages + A16: pages {name: [ids]} -> id -> distinct names."""
    p = t(spark, sf_dir, "part")
    ids = F.array(F.col("p_size").cast("long"))
    doc = F.to_json(F.struct(F.array(F.create_map(F.col("p_brand"), ids),
                                     F.create_map(F.col("p_type"), ids)).alias("ITEMS")))
    pages = p.select(F.from_json(doc, GENRE_PAGE_SCHEMA).alias("j")).select("j.*")
    idx = genre_page_index(pages)
    return idx.select("genreid", F.array_join("genre_names", ",").alias("genre_names"))


@register("genre_catalogue", """
SELECT CAST(p_size AS BIGINT) AS genreid, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS genre_names,
       strftime(max(CASE WHEN p_type <> 'PROMO' THEN TIMESTAMP '2018-01-01' + to_days(CAST(p_partkey AS INTEGER)) END),
                '%Y-%m-%d %H:%M:%S') AS movies_updated
  FROM part GROUP BY p_size
""")
def genre_catalogue_query(spark, sf_dir):
    """S6 + A9: genre catalogue written (truncate + reload) to the shared
    work folder, read back and summarised per id."""
    p = t(spark, sf_dir, "part")
    stamp = F.when(F.col("p_type") != "PROMO",
                   F.timestamp_add("DAY", F.col("p_partkey"), F.lit("2018-01-01").cast("timestamp")))
    per = p.groupBy(F.col("p_size").cast("long").alias("genreid"), "p_brand").agg(
        F.max(stamp).alias("movies_updated"))
    genres = per.groupBy("genreid", "movies_updated").agg(F.collect_list("p_brand").alias("genre_names"))
    store = TableStore(spark, work_path(spark, "catalogue"))
    write_genre_catalogue(store, genres)
    back = store.read("netflix_genres")
    g = genre_catalogue(back)
    return g.select("genreid", F.array_join("genre_names", ",").alias("genre_names"),
                    ts_text("movies_updated").alias("movies_updated"))


@register("stale_first", """
SELECT user_id, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS movies_updated,
       row_number() OVER (ORDER BY last_ts, user_id) AS order_no
  FROM (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id)
 WHERE floor(epoch_us(TIMESTAMP '2024-02-06 12:00:00' - last_ts) / 86400000000) >= 7
""")
def stale_first_query(spark, sf_dir):
    """Per user the last event time as stamp; never or >= 7 whole
    days before as_of, oldest first."""
    last = t(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("movies_updated"))
    s = stale_first(last, "user_id", "movies_updated", "2024-02-06 12:00:00")
    return s.select("user_id", ts_text("movies_updated").alias("movies_updated"), "order_no")


@register("recent_first", """
SELECT o.o_orderkey,
       strftime(greatest(coalesce(o.o_orderdate, TIMESTAMP '1970-01-01'),
                         coalesce(l.last_ship, TIMESTAMP '1970-01-01')), '%Y-%m-%d %H:%M:%S') AS last_touched
  FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) l
    ON o.o_orderkey = l.l_orderkey
 ORDER BY greatest(coalesce(o.o_orderdate, TIMESTAMP '1970-01-01'),
                   coalesce(l.last_ship, TIMESTAMP '1970-01-01')) DESC, o.o_orderkey
 LIMIT 10
""")
def recent_first_query(spark, sf_dir):
    """O1: the 10 most recently touched orders (top-k is the feature)."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    ship = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_shipdate").alias("last_ship"))
    r = recent_first(o.join(ship, "o_orderkey", "left"), "o_orderkey", ["o_orderdate", "last_ship"], n=10)
    return r.select("o_orderkey", ts_text("last_touched").alias("last_touched"))


@register("tier_select", """
WITH tiers(band, min_year) AS (VALUES (6, 2000), (7, 1998), (8, 1995), (9, 1990), (10, 1982))
SELECT o.o_orderkey, tiers.band, tiers.min_year
  FROM orders o JOIN tiers ON 5 + CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) = tiers.band
 WHERE year(o.o_orderdate) >= tiers.min_year
""")
def tier_select_query(spark, sf_dir):
    """band = 5 + priority digit (6..10); tiers from start band 6 with
    as_of year 2000."""
    o = t(spark, sf_dir, "orders").select(
        "o_orderkey", (F.lit(5) + F.substring("o_orderpriority", 1, 1).cast("int")).alias("band_no"),
        F.year("o_orderdate").alias("o_year"))
    tiers = popularity_tiers(spark, 6, 2000)
    s = tier_select(o, "band_no", "o_year", tiers)
    return s.select("o_orderkey", F.col("band_no").alias("band"), "min_year")


@register("page_popularity", """
SELECT l_orderkey, l_linenumber, l_partkey,
       round(CASE WHEN n > 1 THEN 10 - (l_linenumber - 1) / (n - 1) ELSE 10.0 END, 6) AS crit_popularity
  FROM (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
""")
def page_popularity_query(spark, sf_dir):
    """List position -> popularity (line number as page, lines per order
    as pages; one page keeps p)."""
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    pages = li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"))
    x = li.join(pages, "l_orderkey")
    return x.select("l_orderkey", "l_linenumber", "l_partkey",
                    r6(page_popularity(F.lit(10), F.col("l_linenumber"), F.col("n"))).alias("crit_popularity"))


@register("dedupe_first", """
SELECT doc_id, word, min(pos) AS first_pos
  FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word,
               generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents)
 GROUP BY doc_id, word
""")
def dedupe_first_query(spark, sf_dir):
    """W5 on rows: each distinct word of each whole document with its first
    position."""
    return dedupe_first_words(t(spark, sf_dir, "documents"), "doc_id", "text", " ")


@register("distinct_sorted", """
SELECT p_brand, string_agg(DISTINCT w, ',' ORDER BY w) AS words
  FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY p_brand
""")
def distinct_sorted_query(spark, sf_dir):
    """Distinct + sorted words per brand."""
    from kinoframe.operators.lookup import distinct_sorted
    # collect_set de-duplicates map-side: a task holds the distinct words of
    # its brands, never all rows of a brand.
    p = t(spark, sf_dir, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("w"))
    g = p.groupBy("p_brand").agg(F.collect_set("w").alias("w"))
    return g.select("p_brand", F.array_join(distinct_sorted("w"), ",").alias("words"))


@register("append", """
SELECT c_custkey, c_name, c_acctbal, NULL::INTEGER AS s_nationkey FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_acctbal, s_nationkey FROM supplier
""")
def append_query(spark, sf_dir):
    """Column-aligned append with a column missing on one side."""
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"),
                                            F.col("s_acctbal").alias("c_acctbal"), "s_nationkey")
    return append_frames(c, s)


@register("point_lookup", """
SELECT * FROM (SELECT 'by_key' AS how, * FROM customer WHERE c_custkey = 7)
UNION ALL
SELECT * FROM (SELECT 'by_alternate' AS how, * FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 1)
""")
def point_lookup_query(spark, sf_dir):
    """P4 + P5: lookup by key (error when absent) and by an alternate id
    (first hit)."""
    c = t(spark, sf_dir, "customer")
    a = get_one(c, "c_custkey", 7).select(F.lit("by_key").alias("how"), "*")
    b = first_by_alternate(c, "c_nationkey", 3, "c_custkey").select(F.lit("by_alternate").alias("how"), "*")
    return a.unionByName(b)


@register("blocked_ids", """
SELECT d.doc_id, d.source FROM documents d
 WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")
def blocked_ids_query(spark, sf_dir):
    """Drop ids on a block list (toxic-labelled documents)."""
    blocked = t(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select("doc_id")
    return exclude_blocked(t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", blocked)


@register("copy_table", """
SELECT r_regionkey, r_name FROM region
""")
def copy_table_query(spark, sf_dir):
    """Copy table as select into the shared work folder, read back."""
    store = TableStore(spark, work_path(spark, "copy"))
    store.write("region", t(spark, sf_dir, "region"))
    store.copy("region", "region_copy")
    return store.read("region_copy")

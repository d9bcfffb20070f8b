"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinoframe.llm.shards import written


def connected_components(links: DataFrame) -> DataFrame:
    """(id, class) of every id in ``links`` (a, b: long): class is the
    smallest id of its component.

    Large-star and small-star steps in turn; a hub's neighbours are reduced
    map-side to their smallest one, and the join that hands it out may split
    the hub. Each step is a written table, so a lost executor costs one step;
    the driver learns two sums.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(low, F.col("u") == F.col("k")).select("u", "v", "m")
        small = (small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        edges = written(small, "links")
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == before:
            break
        before = tuple(row)
    return (edges.groupBy("u").agg(F.min("v").alias("class")).select(F.col("u").alias("id"), "class")
            .unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("class")).distinct()))


def with_class(members: DataFrame, classes: DataFrame, id_col: str = "id") -> DataFrame:
    """``members`` with their class; an id without links is its own."""
    return (members.join(classes.withColumnRenamed("id", "__cid"), F.col(id_col) == F.col("__cid"), "left")
            .withColumn("class", F.coalesce("class", id_col)).drop("__cid"))


def star_pairs(members: DataFrame, bucket: str = "bucket") -> DataFrame:
    """(a, b): every member of a bucket with its smallest member, once."""
    centre = (members.groupBy(bucket).agg(F.min("id").alias("b"), F.max("id").alias("__max")).where("b < __max")
              .select(F.col(bucket).alias("__bucket"), "b"))
    return (members.join(centre, F.col(bucket) == F.col("__bucket")).where("id <> b")
            .select(F.col("id").alias("a"), "b").distinct())


def open_members(members: DataFrame, classes: DataFrame, bucket: str = "bucket") -> DataFrame:
    """The members of buckets that still hold several classes, with a mark on
    those outside their bucket's first class."""
    named = with_class(members, classes)
    several = (named.groupBy(bucket).agg(F.min("class").alias("__first"), F.max("class").alias("__last"))
               .where("__first < __last").select(F.col(bucket).alias("__bucket"), "__first"))
    return (named.join(several, F.col(bucket) == F.col("__bucket"))
            .withColumn("minor", F.col("class") != F.col("__first")).drop("__bucket", "__first"))


def shared_buckets(banded: DataFrame, name: str) -> DataFrame:
    """(bucket, id) of the buckets with several ids, written. One exchange; a
    window streams a bucket's rows, however many."""
    whole = Window.partitionBy("bucket")
    shared = banded.withColumn("__lo", F.min("id").over(whole)).withColumn("__hi", F.max("id").over(whole))
    return written(shared.where("__lo < __hi").select("bucket", "id").distinct(), name + "-buckets")


def star_links(members: DataFrame, info: DataFrame, plausible: Callable[[str, str], Column],
               verified: Callable[[DataFrame], DataFrame], name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, star, links): ``members`` (bucket, id) with their bucket's
    most connected member b and its size, the plausible pairs of the two, and
    those of them that ``verified`` links (see :func:`bucket_classes`)."""
    facts = [c for c in info.columns if c != "id"]
    ties = members.groupBy("id").agg(F.count(F.lit(1)).alias("__ties"))
    members = members.join(ties, "id")
    centre = members.groupBy("bucket").agg(F.max_by("id", F.struct("__ties", "id")).alias("b"), F.count(F.lit(1)).alias("size"))
    members = written(members.join(centre, "bucket").where("id <> b").select("bucket", "id", "b", "size"), name + "-centred")
    of = lambda c: info.select(F.col("id").alias(c), *[F.col(f).alias(f"{c}_{f}") for f in facts])
    star = (members.select(F.col("id").alias("a"), "b").distinct().join(of("a"), "a").join(of("b"), "b")
            .where(plausible("a_", "b_")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    star = written(star, name + "-star")
    return members, star, written(verified(star).select("a", "b"), name + "-links")


def bucket_classes(members: DataFrame, info: DataFrame, plausible: Callable[[str, str], Column],
                   verified: Callable[[DataFrame], DataFrame], between: Callable[[DataFrame], DataFrame],
                   name: str) -> DataFrame:
    """(id, class) of the ids that links within buckets connect.

    ``members`` are (bucket, id); ``info`` has what ``plausible`` compares for
    each id (it gets the two rows' column prefixes); ``verified`` gives the
    linked ones of pairs (a, b). A bucket's members first meet its most
    connected one. Of buckets that then still hold several classes the members
    go to ``between`` as (id, class, minor), once each, minor being those
    outside the first class of some bucket; it gives the pairs (a > b) of
    different classes, one of them minor, that may be linked.
    """
    members, star, links = star_links(members, info, plausible, verified, name)
    named = with_class(members.where("size > 2").select("bucket", "id"), connected_components(links))
    several = named.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    rest = (named.join(several.select("bucket", "low"), "bucket").groupBy("id", "class")
            .agg(F.max(F.col("class") != F.col("low")).alias("minor")))
    more = between(written(rest, name + "-rest")).join(star, ["a", "b"], "left_anti")
    return connected_components(links.unionByName(verified(more).select("a", "b")))

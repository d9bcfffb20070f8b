"""The film instance of the generic operators: wide export, nested film
records, their unnesting back to tables, applying a batch of partial film
records, and the key checks (B1-B7, J1, J2, U1-U7, S9, S10)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinoframe.operators.export import ChildPart, CondAvg, ListAgg, wide_export
from kinoframe.operators.merge import fold_log, merge_entries, merge_nested_maps, merge_null_safe, replace_children
from kinoframe.operators.nest import (attach, nest_by_role, nest_map, nest_map2, nest_values,
                                      unnest_list, unnest_map, unnest_map2, unnest_roles)
from kinoframe.operators.quality import check_unique, find_orphans
from kinoframe.schemas import CHILD_TABLES, HEADER_COLUMNS, KEYS, ROLES
from kinoframe.session import cut_lineage

KEY = "crit_id"
# Export list limits per role, and the score types pivoted.
ROLE_LIMITS = {"cast": ("actors", 5), "director": ("directors", 3), "writer": ("writers", 3)}
PIVOT_TYPES = ["rating", "psi", "pred_rating", "pred_seeit", "pred_score", "seen_probability"]
EXPORT_HEADER = [
    "crit_id", "imdbid", "year", "imdb_year", "title", "imdb_title", "original_title", "crit_rating", "crit_votes",
    "imdb_rating", "imdb_votes", "metacritic_score", "kind", "runtime", "plot_summary", "plot_storyline",
    "original_release_date", "dutch_release_date", "crit_popularity", "crit_url", "tomato_url", "poster_url",
    "trailer_url", "ptp_url", "ptp_hd_available", "netflix_id", "netflix_title", "netflix_rating", "date_added",
    "criticker_updated", "imdb_main_updated", "imdb_release_updated", "imdb_metacritic_updated",
    "imdb_keywords_updated", "imdb_taglines_updated", "imdb_vote_details_updated", "imdb_plot_updated",
    "omdb_updated", "ptp_updated", "netflix_updated"]


def film_wide_export(t: dict[str, DataFrame], user: str) -> DataFrame:
    """J1 + P1: one row per film, 52 columns. Persons are aggregated in ONE
    pass (three filtered ordered lists), ratings pivoted in one pass; every
    child is aggregated before the join."""
    persons = ChildPart(t["persons"], [
        ListAgg(alias, "name", ["rank"], f"role = '{role}' AND rank <= {limit}")
        for role, (alias, limit) in ROLE_LIMITS.items()])
    ratings = ChildPart(t["ratings"], [
        CondAvg(f"{ty}_{user}", "score", (F.col("user") == F.lit(user)) & (F.col("type") == F.lit(ty)))
        for ty in PIVOT_TYPES])
    parts = [ChildPart(t["genres"], [ListAgg("genres", "genre")]),
             ChildPart(t["languages"], [ListAgg("languages", "language", ["rank"])]),
             ChildPart(t["countries"], [ListAgg("countries", "country", ["rank"])]),
             persons, ratings]
    return wide_export(t["movies"], KEY, parts, header_cols=[c for c in EXPORT_HEADER if c != KEY])


def assemble_films(t: dict[str, DataFrame]) -> DataFrame:
    """B1: one nested record per film from the header and 8 child tables."""
    parts = [
        nest_by_role(t["persons"], KEY, "role", ROLES, ["canonical_name", "name", "person_id"], order=["rank"]),
        nest_values(t["genres"], KEY, "genre", alias="genres"),
        nest_values(t["countries"], KEY, "country", order=["rank"], alias="countries"),
        nest_values(t["languages"], KEY, "language", order=["rank"], alias="languages"),
        nest_values(t["keywords"], KEY, "keyword", alias="keywords"),
        nest_values(t["taglines"], KEY, "tagline", order=["rank"], alias="taglines"),
        nest_map(t["vote_details"], KEY, "demographic", ["rating", "votes"], alias="vote_details"),
        nest_map2(t["ratings"], KEY, "user", "type", "score", alias="my_ratings"),
    ]
    return attach(t["movies"], KEY, parts, empty_map_cols=["my_ratings"])


def explode_films(films: DataFrame) -> dict[str, DataFrame]:
    """Nested records back to the 8 child tables (NULL and empty
    lists give no rows; languages and keywords are ranked after sorting)."""
    f = films
    out = {
        "persons": unnest_roles(f.select(KEY, *ROLES.values()), KEY, ROLES).select(
            KEY, "person_id", "rank", "name", "canonical_name", "role"),
        "genres": unnest_list(f, KEY, "genres", rank=None, value="genre"),
        "countries": unnest_list(f, KEY, "countries", value="country"),
        "languages": unnest_list(f, KEY, "languages", sort=True, value="language"),
        "keywords": unnest_list(f, KEY, "keywords", rank=None, sort=True, value="keyword"),
        "taglines": unnest_list(f, KEY, "taglines", value="tagline"),
        "vote_details": unnest_map(f, KEY, "vote_details", "demographic").select(
            KEY, "demographic", "votes", "rating"),
        "ratings": unnest_map2(f, KEY, "my_ratings", "user", "type", "score"),
    }
    return out


def fold_film_batch(batch: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One record per film of a batch that may hold a film several times: the
    latest non-NULL value of each column by ``order`` (default: arrival);
    ratings are merged entry by entry. A batch holds few records of a film."""
    order = list(order) or ["_seq"]
    seq = batch.withColumn("_seq", F.monotonically_increasing_id()) if order == ["_seq"] else batch
    columns = [c for c in batch.columns if c not in (KEY, "my_ratings", *order)]
    folded = fold_log(seq, KEY, order, columns, keep_first=["date_added"])
    if "my_ratings" not in batch.columns:
        return folded
    empty = F.create_map().cast(_LIST_TYPES["my_ratings"])
    rated = (seq.where(F.col("my_ratings").isNotNull()).groupBy(KEY)
             .agg(F.array_sort(F.collect_list(F.struct(*order, F.to_json("my_ratings").alias("r")))).alias("_all")))
    each = F.transform("_all", lambda x: F.from_json(x["r"], _LIST_TYPES["my_ratings"]))
    rated = rated.select(F.col(KEY), F.aggregate(each, empty, lambda acc, x: merge_nested_maps(acc, x)).alias("my_ratings"))
    return folded.join(rated, KEY, "left")


def apply_film_batch(t: dict[str, DataFrame], batch: DataFrame, order: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Apply a batch of partial nested film records (any subset of the
    header columns plus any nested lists) to all tables: header null-safe
    merge (date_added kept first), ratings deep-merged entry by entry, people
    replaced per film and role, other children per film, where the batch
    supplies the list. A film's records are folded first, by ``order``. Rows
    without a film key are left out (U9: report them with
    ``merge.quarantine(batch, "crit_id")``) instead of failing the batch."""
    batch = cut_lineage(fold_film_batch(batch.filter(F.col(KEY).isNotNull()), order), "film-batch")
    return dict(t) | apply_folded(t, batch)


def apply_folded(t: dict[str, DataFrame], batch: DataFrame, null_keys: bool = True) -> dict[str, DataFrame]:
    """The tables that a batch of one record a film changes (see
    :func:`apply_film_batch`); ``null_keys=False`` where no header lacks its
    key."""
    header_cols = [c for c in HEADER_COLUMNS if c in batch.columns and c != KEY]
    new_t = {"movies": merge_null_safe(t["movies"], batch.select(KEY, *header_cols), KEY,
                                       columns=[c for c in t["movies"].columns if c != KEY],
                                       keep_first=["date_added"], null_keys=null_keys)}
    nested_cols = [c for c in batch.columns if c not in HEADER_COLUMNS]
    exploded = explode_films(_with_all_lists(batch))
    for name in CHILD_TABLES:
        if name == "ratings":
            if "my_ratings" in nested_cols:
                new_t[name] = merge_entries(t[name], exploded[name], KEYS["ratings"])
            continue
        supplied = _list_columns(name)
        if any(c in nested_cols for c in supplied):
            key = [KEY, "role"] if name == "persons" else KEY
            new_t[name] = replace_children(t[name], exploded[name].select(*t[name].columns), key)
    return new_t


def _list_columns(table: str) -> list[str]:
    return {"persons": list(ROLES.values()), "genres": ["genres"], "countries": ["countries"],
            "languages": ["languages"], "keywords": ["keywords"], "taglines": ["taglines"],
            "vote_details": ["vote_details"], "ratings": ["my_ratings"]}[table]


_LIST_TYPES = {
    "cast": "array<struct<canonical_name:string,name:string,person_id:bigint>>",
    "director": "array<struct<canonical_name:string,name:string,person_id:bigint>>",
    "writer": "array<struct<canonical_name:string,name:string,person_id:bigint>>",
    "genres": "array<string>", "countries": "array<string>", "languages": "array<string>",
    "keywords": "array<string>", "taglines": "array<string>",
    "vote_details": "map<string,struct<rating:double,votes:int>>",
    "my_ratings": "map<string,map<string,double>>",
}


def _with_all_lists(batch: DataFrame) -> DataFrame:
    for c, ty in _LIST_TYPES.items():
        if c not in batch.columns:
            batch = batch.withColumn(c, F.lit(None).cast(ty))
    return batch


def check_tables(t: dict[str, DataFrame]) -> DataFrame:
    """S9 + S10 for every table: (table, check, n_violations), one row per
    check; each check is an aggregation, nothing is collected."""
    rows = None
    for name, df in t.items():
        if name not in KEYS:
            continue
        dup = check_unique(df, KEYS[name]).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("table"), F.lit("duplicate_key").alias("check"), "n")
        rows = dup if rows is None else rows.unionByName(dup)
        if name in CHILD_TABLES:
            orph = find_orphans(df.select(KEY), t["movies"], KEY).agg(F.count(F.lit(1)).alias("n")).select(
                F.lit(name).alias("table"), F.lit("orphan").alias("check"), "n")
            rows = rows.unionByName(orph)
    return rows

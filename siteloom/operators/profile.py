"""All pages of a site to one company profile.

Every page contributes facts ``(site, field, key, rank, seq, source, pos, value)``. Facts with the
same key are copies of one thing, and the least one in (rank, seq, source, pos) wins. That is a
minimum, so copies collapse on the map side. The result is long: one row per fact with its place in
the field, numbered in buckets, so no site or field, however large, is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom import constants as K
from siteloom.functions import classify as C
from siteloom.operators.prefix import running_rank

LIST_FIELDS = ["other_locations", *K.BUCKET_TYPES, "emails", "phones"]
# Ordered by value, all others by first appearance.
SORTED_FIELDS = ["emails", "phones", "social"]
#: Pages whose facts of one field are numbered together.
BUCKET_PAGES = 256
#: First letters that values share in a bucket.
BUCKET_LETTERS = 8


def _fact(
    field: Column, key: Column, rank: Column, pos: Column, value: Column, source: int = 0
) -> Column:
    return F.struct(
        field.alias("field"),
        key.alias("key"),
        rank.cast("int").alias("rank"),
        F.lit(source).alias("source"),
        pos.cast("int").alias("pos"),
        value.alias("value"),
    )


def _one(name: str, rank: Column, value: Column) -> Column:
    """Candidate for a field with a single value; nothing if the value is missing."""
    fact = _fact(F.lit(name), F.lit(""), rank, F.lit(0), value)
    return F.when(F.coalesce(value != "", F.lit(False)), F.array(fact))


def _many(name: Column, items: Column, key, source: int = 0) -> Column:
    return F.transform(items, lambda x, i: _fact(name, key(x), F.lit(0), i, x, source))


def _page_facts() -> Column:
    page_type = F.col("page_type")
    on_hq_page = page_type.isin(K.HQ_PAGE_TYPES)
    addresses = F.col("address_candidates")
    offices = F.col("other_location_candidates")

    def same(x: Column) -> Column:
        return x

    # The first address of an HQ page is claimed below (claimed_addresses), not here.
    rest = F.slice(addresses, F.lit(2), F.greatest(F.size(addresses), F.lit(1)))
    unclaimed = F.when(on_hq_page, rest).otherwise(addresses)
    parts = [
        _one(
            "company_name",
            C.rank_of(page_type, K.NAME_RANKS),
            F.col("company_name_guess"),
        ),
        _one(
            "description",
            C.rank_of(page_type, K.DESCRIPTION_RANKS),
            F.col("meta_description"),
        ),
        _one("hq_label", F.lit(0), F.get("headquarters_candidates", F.lit(0))),
        F.when(on_hq_page, _one("hq_address", F.lit(0), F.get(addresses, F.lit(0)))),
        _many(F.lit("other_locations"), unclaimed, same, 1),
        _many(F.lit("other_locations"), offices, same, 2),
        F.when(
            page_type.isin(K.BUCKET_TYPES),
            _many(page_type, F.col("heading_list_items"), F.lower),
        ),
        F.when(
            page_type.isin(K.CONTACT_TRUSTED_TYPES),
            F.concat(
                _many(F.lit("emails"), F.col("emails"), same),
                _many(F.lit("phones"), F.col("phones"), same),
            ),
        ),
        F.transform(
            "social_links",
            lambda s, i: _fact(F.lit("social"), s["platform"], F.lit(0), i, s["href"]),
        ),
    ]
    empty = F.array().cast("array<struct<field:string,key:string,rank:int,source:int,pos:int,value:string>>")
    return F.concat(*[F.coalesce(p, empty) for p in parts])


def _claimed_addresses(pages: DataFrame) -> DataFrame:
    """First addresses of HQ pages, except the one address per site that is taken as
    headquarters. Only that occurrence is taken: the same text on another page stays."""
    firsts = pages.filter(
        F.col("page_type").isin(K.HQ_PAGE_TYPES) & (F.size("address_candidates") > 0)
    ).select("site", "seq", F.get("address_candidates", F.lit(0)).alias("value"))
    taken = firsts.groupBy("site").agg(F.min("seq").alias("seq"))
    # Keyed by page, not by site, so that a large site spreads over all tasks.
    return firsts.join(taken, ["site", "seq"], "left_anti").select(
        "site",
        "seq",
        F.lit("other_locations").alias("field"),
        F.col("value").alias("key"),
        F.lit(0).alias("rank"),
        F.lit(0).alias("source"),
        F.lit(0).alias("pos"),
        "value",
    )


def profile_facts(extract: DataFrame) -> DataFrame:
    """``site, field, place, key, value`` of all surviving facts. ``extract`` has one row per page
    with ``site`` and ``seq`` (the order in which pages count as seen) and the fields of
    ``page_fields``; it is read more than once, so pass a stored table."""
    pages = extract.filter(~F.col("is_third_party"))
    facts = (
        pages.select("site", "seq", F.explode(_page_facts()).alias("f"))
        .select("site", "seq", "f.*")
        .unionByName(_claimed_addresses(pages))
    )
    best = (
        facts.groupBy("site", "field", "key")
        .agg(F.min(F.struct("rank", "seq", "source", "pos", "value")).alias("b"))
        .select("site", "field", "key", "b.*")
    )
    by_value = F.col("field").isin(SORTED_FIELDS)
    order = [
        F.when(by_value, F.col("key")).otherwise(""),
        *map(F.col, ("rank", "seq", "source", "pos", "key")),
    ]
    # Both follow the order: the first letters of a key, the page of a fact.
    bucket = F.when(by_value, F.substring("key", 1, BUCKET_LETTERS)).otherwise(
        F.lpad(F.floor(F.col("seq") / BUCKET_PAGES).cast("string"), 19, "0")
    )
    ranked = running_rank(best, ["site", "field"], order, bucket)
    return ranked.select(
        "site", "field", F.col("running_rank").cast("bigint").alias("place"), "key", "value"
    )


def company_facts(facts: DataFrame) -> DataFrame:
    """``website, field, place, value``: the stored form of all profiles. The label of a
    headquarters wins over its address."""
    # Only addresses are looked up, at most one a site; all other facts stay where they are.
    labelled = facts.filter("field = 'hq_label'").select("site")
    addresses = facts.filter("field = 'hq_address'").join(labelled, "site", "left_anti")
    named = facts.filter("field <> 'hq_address'").unionByName(addresses).select(
        F.col("site").alias("website"),
        F.when(F.col("field").isin("hq_label", "hq_address"), "headquarters")
        .when(F.col("field") == "social", F.concat(F.lit("social_"), F.col("key")))
        .otherwise(F.col("field"))
        .alias("field"),
        F.when(F.col("field") == "social", 1).otherwise(F.col("place")).alias("place"),
        "value",
    )
    return named


def build_profiles(
    extract: DataFrame, sites: DataFrame | None = None, most: int | None = None
) -> DataFrame:
    """One nested row per site, as reports hold it; with ``sites`` (column ``site``) sites without any
    usable page get a row too. A row holds all distinct items of its site, unless the caller says
    how many of a list (``most``) are enough; for sites of any size use ``company_facts``."""
    facts = profile_facts(extract)
    if most is not None:
        facts = facts.filter((F.col("place") <= most) | (F.col("field") == "social"))

    def single(field: str) -> Column:
        return F.max(F.when(F.col("field") == field, F.col("value")))

    def listed(field: str) -> Column:
        mine = F.when(F.col("field") == field, F.struct("place", "value"))
        return F.transform(F.array_sort(F.collect_list(mine)), lambda x: x["value"]).alias(field)

    social = F.map_from_entries(
        F.array_sort(F.collect_list(F.when(F.col("field") == "social", F.struct("key", "value"))))
    )
    profiles = facts.groupBy("site").agg(
        single("company_name").alias("company_name"),
        single("description").alias("description"),
        F.coalesce(single("hq_label"), single("hq_address")).alias("headquarters"),
        *[listed(f) for f in LIST_FIELDS],
        social.alias("social_links"),
    )
    if sites is not None:
        empty = F.array().cast("array<string>")
        profiles = sites.select("site").distinct().join(profiles, "site", "left")
        for f in LIST_FIELDS:
            profiles = profiles.withColumn(f, F.coalesce(f, empty))
        profiles = profiles.withColumn(
            "social_links",
            F.coalesce("social_links", F.map_from_arrays(empty, empty)),
        )
    return profiles.withColumnRenamed("site", "website")

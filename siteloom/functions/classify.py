"""Page categories and queue priority as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom import constants as K
from siteloom.functions import text as T
from siteloom.functions import urls as U


def _bound(value: Column, rule: Callable[[Column], Column]) -> Column:
    """Work out ``value`` once for a rule that uses it many times; branches share nothing otherwise."""
    return F.transform(F.array(value), rule)[0]


def _by_keywords(haystack: Column, fallback: Column) -> Column:
    def first_hit(text: Column) -> Column:
        out = None
        for category, keywords in K.CATEGORY_KEYWORDS:
            hit = T.contains_any(text, keywords)
            out = F.when(hit, category) if out is None else out.when(hit, category)
        return out.otherwise(fallback)

    return _bound(haystack, first_hit)


def classify_url(url: Column, anchor_text: Column | None = None) -> Column:
    anchor = F.lit("") if anchor_text is None else F.lower(F.coalesce(anchor_text, F.lit("")))
    return _bound(
        F.lower(U.url_path(url)),
        lambda path: F.when(path.isin("", "/"), "home")
        .when(path.rlike(K.INDUSTRY_PATH_PATTERN), "industries")
        .otherwise(_by_keywords(F.concat(path, F.lit(" "), anchor), F.lit("other"))),
    )


def classify_content(url: Column, title: Column, h1: Column, guess: Column) -> Column:
    """Title and heading decide only where the URL said nothing."""
    text = F.lower(
        F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(h1, F.lit("")))
    )

    def decided(said: Column) -> Column:
        refined = F.when(
            F.lower(U.url_path(url)).rlike(K.INDUSTRY_PATH_PATTERN), "industries"
        ).otherwise(_by_keywords(text, said))
        return F.when(said != "other", said).otherwise(refined)

    return _bound(guess, decided)


def url_guess(url: Column, depth: Column) -> Column:
    """Category before the page is read: the start page is always the home page."""
    return F.when(depth == 0, "home").otherwise(classify_url(url))


def audit_type(page_type: Column, third_party: Column) -> Column:
    return F.when(third_party, "third_party_listing").otherwise(page_type)


def priority_class(category: Column) -> Column:
    return F.when(category.isin(K.PRIORITY_CATEGORIES), 0).otherwise(1)


def rank_of(page_type: Column, ranks: dict[str, int]) -> Column:
    out = None
    for name, rank in ranks.items():
        out = F.when(page_type == name, rank) if out is None else out.when(page_type == name, rank)
    return out.otherwise(K.OTHER_RANK)

"""Merging pages into profiles: small cases by hand, random ones against a plain loop."""

import random
import re

from pyspark.sql import functions as F

from siteloom import constants as K
from siteloom.operators.profile import build_profiles, company_facts, profile_facts

SCHEMA = """site string, seq long, page_type string, is_third_party boolean, company_name_guess string,
meta_description string, emails array<string>, phones array<string>,
social_links array<struct<platform:string,href:string>>, address_candidates array<string>,
headquarters_candidates array<string>, other_location_candidates array<string>,
heading_list_items array<string>"""
FIELDS = [f.split()[0] for f in " ".join(SCHEMA.split()).split(", ")]


def page(site, seq, page_type, third=False, name=None, text=None, emails=(), phones=(), social=(),
         addresses=(), hq=(), other=(), items=()):
    return (site, seq, page_type, third, name, text, list(emails), list(phones), list(social),
            list(addresses), list(hq), list(other), list(items))


def profiles(spark, pages, sites=None):
    df = spark.createDataFrame(pages, SCHEMA)
    if sites is not None:
        sites = spark.createDataFrame([(s,) for s in sites], "site string")
    return {r.website: r.asDict() for r in build_profiles(df, sites).collect()}


def test_policy(spark):
    got = profiles(
        spark,
        [
            page("a", 0, "other", name="Blog Title", text="Other text"),
            page("a", 1, "about", name="Acme", text="Full text"),
            page("a", 2, "home", text="Home text", emails=["x@a.io"], phones=["2"]),
            page("a", 3, "contact", emails=["b@a.io", "x@a.io"], phones=["1"]),
            page("a", 4, "products", emails=["stray@b.io"], items=["Wide Saw", "Thin Saw"]),
            page("a", 5, "products", items=["wide saw", "Long Saw"]),
            page("a", 6, "home", True, name="Other Mill", addresses=["Elsewhere 99"]),
            page("b", 0, "about", addresses=["HQ street"], social=[("x", "first")]),
            page("b", 1, "contact", addresses=["Second street"], social=[("x", "later"), ("y", "why")]),
            page("c", 0, "home", addresses=["Home street", "Other street"]),
            page("c", 1, "other", hq=["Registered Office: far"], addresses=["Home street"]),
        ],
        ["a", "b", "c", "d"],
    )
    a, b, c, d = (got[s] for s in "abcd")
    assert (a["company_name"], a["description"]) == ("Acme", "Full text")
    assert a["emails"] == ["b@a.io", "x@a.io"] and a["phones"] == ["1", "2"]
    assert a["products"] == ["Wide Saw", "Thin Saw", "Long Saw"]
    assert a["headquarters"] is None and a["other_locations"] == []
    assert b["headquarters"] == "HQ street" and b["other_locations"] == ["Second street"]
    assert b["social_links"] == {"x": "first", "y": "why"}
    # The label wins; the address taken as headquarters is lost, its copy elsewhere is not.
    assert c["headquarters"] == "Registered Office: far"
    assert c["other_locations"] == ["Other street", "Home street"]
    assert d["company_name"] is None and d["products"] == [] and d["social_links"] == {}


def expected_profile(pages):
    """The merge policy as a plain loop over pages in order."""
    ranks = {"home": 0, "about": 1, "contact": 2}
    out = {f: [] for f in ("other_locations", "products", "services", "solutions", "industries")}
    names, texts, labels, claimed = [], [], [], []
    mails, numbers, social = set(), set(), {}
    for p in sorted((p for p in pages if not p["is_third_party"]), key=lambda p: p["seq"]):
        kind = p["page_type"]
        if p["company_name_guess"]:
            names.append((ranks.get(kind, 5), len(names), p["company_name_guess"]))
        if p["meta_description"]:
            place = {"about": 0, "home": 1, "contact": 2}.get(kind, 5)
            texts.append((place, len(texts), p["meta_description"]))
        for address in p["address_candidates"]:
            if kind in ("home", "about", "contact") and not claimed:
                claimed.append(address)
            elif address not in out["other_locations"]:
                out["other_locations"].append(address)
        labels += p["headquarters_candidates"]
        for address in p["other_location_candidates"]:
            if address not in out["other_locations"]:
                out["other_locations"].append(address)
        if kind in ("home", "about", "contact", "locations"):
            mails.update(p["emails"])
            numbers.update(p["phones"])
        for platform, href in p["social_links"]:
            social.setdefault(platform, href)
        if kind in K.BUCKET_TYPES:
            known = {i.lower() for i in out[kind]}
            for item in p["heading_list_items"]:
                if item.lower() not in known:
                    known.add(item.lower())
                    out[kind].append(item)
    return {
        "company_name": min(names)[2] if names else None,
        "description": min(texts)[2] if texts else None,
        "headquarters": (labels or claimed or [None])[0],
        "other_locations": out["other_locations"],
        **{b: out[b] for b in K.BUCKET_TYPES},
        "emails": sorted(mails),
        "phones": sorted(numbers),
        "social_links": social,
    }


def test_random_sites(spark):
    rng = random.Random(5)
    kinds = ["home", "about", "contact", "locations", "products", "services", "solutions", "industries", "other"]

    def some(prefix, n, most):
        # Pages list each thing once, as the page rules see to.
        return list(dict.fromkeys(f"{prefix}{rng.randrange(n)}" for _ in range(rng.randrange(most))))

    pages = []
    for s in range(12):
        # One site holds most of the pages.
        for seq in range(150 if s == 0 else rng.randrange(1, 8)):
            items = [i if rng.random() < 0.5 else i.upper() for i in some("item", 60, 8)]
            lowered = {}
            for i in items:
                lowered.setdefault(i.lower(), i)
            pages.append(
                page(
                    f"s{s}", seq, rng.choice(kinds), rng.random() < 0.2,
                    rng.choice([None, "", f"name{seq}"]), rng.choice([None, "", f"text{seq}"]),
                    some("m", 30, 4), some("p", 30, 4),
                    [(k, f"{k}{seq}") for k in sorted({rng.choice("abc") for _ in range(rng.randrange(3))})],
                    some("addr", 25, 4), some("hq", 9, 2) if rng.random() < 0.1 else [], some("addr", 25, 3),
                    list(lowered.values()),
                )
            )
    got = profiles(spark, pages)
    for s in range(12):
        mine = [dict(zip(FIELDS, p)) for p in pages if p[0] == f"s{s}"]
        want = expected_profile(mine)
        have = got.get(f"s{s}")
        if have is None:
            assert not any(want.values())
            continue
        assert {k: have[k] for k in want} == want, s


def test_large_site_is_not_ordered_in_one_task(spark):
    df = spark.createDataFrame([page("a", 0, "home")], SCHEMA)
    plan = profile_facts(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Exchange hashpartitioning(site#0, field#0, _bucket#0" in re.sub("#\\d+L?", "#0", plan)
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_nothing_is_cut_unless_asked(spark):
    pages = [page("a", i, "products", items=[f"x{i}"]) for i in range(600)]
    df = spark.createDataFrame(pages, SCHEMA)
    facts = company_facts(profile_facts(df)).collect()
    assert sorted((r.place, r.value) for r in facts) == [(i + 1, f"x{i}") for i in range(600)]
    sizes = [r.n for most in (None, 25) for r in build_profiles(df, most=most).select(F.size("products").alias("n")).collect()]
    assert sizes == [600, 25]

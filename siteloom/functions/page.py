"""Field rules over one page outline (``elems``, ``texts``), as SQL text.

A page is bounded by the size cap on its body, so its arrays are too, and everything that
concerns one page alone is computed in the row it lives in: no shuffle, no join.

Arguments are SQL expressions. Where one is used inside a lambda it must be a column of
the input, not something longer, or it would be computed anew for every array element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom import constants as K
from siteloom.functions import noise as N
from siteloom.functions import text as T
from siteloom.functions.noise import clean, let, literal, strip
from siteloom.functions.urls import NETLOC_PATTERN

PLAIN = "x.kind = 'text' and not x.in_script"
MAIN = f"{PLAIN} and not x.in_chrome"
# noscript content is part of a listing, script and style (kind 'raw') are not.
LISTING = "x.kind = 'text' and not x.in_chrome"


def elements(condition: str, var: str = "e") -> str:
    """Elements outside script, style, noscript and template that satisfy a condition."""
    return f"filter(elems, {var} -> not {var}.in_script and ({condition}))"


def _inside(e: str) -> str:
    return f"slice(texts, {e}.t0 + 1, {e}.t1 - {e}.t0)"


def _clean_join(strings: str, keep: str) -> str:
    """Clean text of those strings that are to be kept; each is clean by itself already."""
    return f"nullif(array_join(transform(filter({strings}, x -> {keep}), x -> coalesce(x.c, x.s)), ' '), '')"


def full_text(e: str) -> str:
    return _clean_join(_inside(e), PLAIN)


def main_text(e: str) -> str:
    return _clean_join(_inside(e), MAIN)


def listing_text(e: str) -> str:
    return _clean_join(_inside(e), LISTING)


def _glued(e: str) -> str:
    return f"array_join(transform(filter({_inside(e)}, x -> x.kind = 'text'), x -> x.s), '')"


def anchor_text(e: str) -> str:
    """Strings joined without a separator, white space inside them untouched."""
    return _glued(e)


# --- whole page -------------------------------------------------------------------


def title() -> str:
    first = f"get({elements("e.tag = 'title'")}, 0)"
    return let(first, "t", clean(_glued("t")))


def h1() -> str:
    return let(f"get({elements("e.tag = 'h1'")}, 0)", "t", full_text("t"))


def visible_text() -> str:
    return _clean_join("texts", PLAIN)


def is_js_shell() -> str:
    """The static body is likely filled in by a script. An absent body (``has_body``) is
    not a shell. White space inside strings counts here, other than in visible_text."""
    mount = "exists(elems, e -> not e.in_script and coalesce({}, false))".format(
        N.equals_any("e.elem_id", K.SPA_ROOT_IDS)
    )
    verdict = (
        f"case when n >= {K.THIN_TEXT_CHARS} then false"
        f" else n < {K.EMPTY_SHELL_CHARS} or {mount} end"
    )
    uncleaned = f"length(array_join(transform(filter(texts, x -> {PLAIN}), x -> x.s), ' '))"
    return f"(has_body and {let(uncleaned, 'n', verdict)})"


def _meta(attribute: str, value: str) -> str:
    """Content of the first matching meta element; null when absent or empty."""
    first = elements(f"e.tag = 'meta' and e.{attribute} = '{value}'")
    return f"nullif(get({first}, 0).content, '')"


def _prefer(first: str, var: str, otherwise: str) -> str:
    """Cleaned ``first`` if it is there at all, even when cleaning leaves nothing."""
    return let(first, var, f"case when {var} is not null then {clean(var)} else {otherwise} end")


def meta_description() -> str:
    return _prefer(_meta("name", "description"), "d", clean(_meta("property", "og:description")))


def _logo_name() -> str:
    """Alternative text of the first logo image; nothing if it only says 'logo'."""
    banners = elements(
        "e.tag = 'header' or (e.tag = 'a' and array_contains(e.classes, 'navbar-brand'))"
    )

    def below(tag: str) -> str:
        return f"exists(b, s -> s.tag = '{tag}' and i.id > s.id and i.id <= s.last)"

    logos = elements(
        "i.tag = 'img' and (coalesce(contains(i.alt, 'logo'), false)"
        " or array_contains(i.classes, 'logo')"
        f" or {below('a')} or (i.alt is not null and {below('header')}))",
        "i",
    )
    alt = clean(let(banners, "b", f"get({logos}, 0).alt"))
    return let(alt, "a", "case when not contains(lower(a), 'logo') then a end")


def name_in_title(title_: str) -> str:
    """Longest part of a title that is no generic page word; of equals the first."""
    parts = (
        f"filter(split({title_}, {literal(K.TITLE_SEPARATOR_PATTERN)}),"
        f" p -> not {N.equals_any(f'lower({strip('p')})', K.GENERIC_TITLE_WORDS)})"
    )
    ranked = f"transform({parts}, (p, i) -> named_struct('n', length(p), 'i', -i, 'p', p))"
    return f"coalesce({strip(f'array_max({ranked}).p')}, {title_})"


def company_name(
    title_: str, h1_: str, domain_name: str,
    site_name: str | None = None, app_name: str | None = None, logo: str | None = None,
) -> str:
    """Site name from the most trusted signal present on the page. The signals that stand in metas and
    images are read off the outline, unless they are given."""
    bare_title = f"regexp_replace(lower({title_}), {literal(r'^\.+|\.+$')}, '')"
    generic = f"({title_} is null or {N.equals_any(bare_title, K.GENERIC_TITLE_WORDS)})"
    from_content = (
        f"coalesce({logo or _logo_name()}, case when {generic} then {h1_} end,"
        f" case when {title_} is not null then {name_in_title(title_)} end, {domain_name})"
    )
    by_app_name = _prefer(app_name or _meta("name", "application-name"), "n", from_content)
    return _prefer(site_name or _meta("property", "og:site_name"), "g", by_app_name)


# --- contact ------------------------------------------------------------------------


def tel_phones() -> Column:
    hrefs = F.expr(
        f"transform({elements("e.tag = 'a' and lower(e.href) like 'tel:%'")}, e -> e.href)"
    )
    numbers = F.filter(F.transform(hrefs, T.tel_number), lambda n: n.isNotNull())
    return F.array_sort(F.array_distinct(numbers))


def phones(visible: str) -> Column:
    from_text = T.phones_in(F.coalesce(F.col(visible), F.lit("")))
    return F.array_sort(F.array_union(from_text, tel_phones()))


def social_links(own_site: str) -> str:
    """First link per platform to another site than ``own_site``, as an array of
    (platform, href) in platform order."""
    netloc = f"regexp_extract(e.href, {literal(NETLOC_PATTERN)}, 1)"
    host = f"regexp_replace(lower(substring_index({netloc}, ':', 1)), {literal(r'^www\.')}, '')"
    found = (
        f"filter(transform({elements("e.tag = 'a' and contains(e.href, '//')")},"
        f" e -> named_struct('host', {host}, 'href', e.href)),"
        f" l -> l.host <> {own_site} and"
        f" l.host in ({', '.join(f"'{d}'" for d, _ in K.SOCIAL_DOMAINS)}))"
    )

    def first_on(platform: str) -> str:
        domains = ", ".join(f"'{d}'" for d, p in K.SOCIAL_DOMAINS if p == platform)
        pick = f"get(filter(ls, l -> l.host in ({domains})), 0).href"
        return f"named_struct('platform', '{platform}', 'href', {pick})"

    picks = ", ".join(first_on(p) for p in sorted({p for _, p in K.SOCIAL_DOMAINS}))
    return let(found, "ls", f"filter(array({picks}), p -> p.href is not null)")


# --- addresses ----------------------------------------------------------------------


def address_candidates() -> str:
    tagged = f"transform({elements("e.tag = 'address'")}, e -> {full_text('e')})"
    hinted = elements(
        f"{N.contains_any("array_join(e.classes, ' ')", K.ADDRESS_CLASS_HINTS)}"
        f" or coalesce({N.contains_any('e.elem_id', K.ADDRESS_ID_HINTS)}, false)"
        f" or coalesce(contains(e.itemtype, '{K.ADDRESS_ITEMTYPE_HINT}'), false)"
    )
    low, high = K.ADDRESS_LENGTH
    return (
        f"array_distinct(concat(filter({tagged}, a -> a is not null),"
        f" filter(transform({hinted}, e -> {full_text('e')}),"
        f" a -> length(a) between {low} and {high})))"
    )


# A few short texts such that every office keyword holds one of them.
_LABELS = K.HQ_OFFICE_KEYWORDS + K.OTHER_OFFICE_KEYWORDS
OFFICE_STEMS = sorted({next(w for w in reversed(k.split()) if len(w) > 4) for k in _LABELS})


def office_addresses() -> str:
    """Struct of ``hq`` and ``other``: the blocks around an explicit office label."""
    # Plain searches for a common part rule out nearly all text before the pattern is tried.
    stems = " or ".join(f"contains(l, '{stem}')" for stem in OFFICE_STEMS)
    keywords = N.contains_any("l", K.HQ_OFFICE_KEYWORDS + K.OTHER_OFFICE_KEYWORDS)
    labels = (
        "filter(texts, t -> not t.in_script and t.kind <> 'raw' and t.parent >= 0 and "
        f"{let('lower(t.s)', 'l', f'({stems}) and {keywords}')})"
    )
    low, high = K.ADDRESS_LENGTH
    block = let("get(elems, t.parent)", "u", full_text("u"))
    blocks = (
        f"filter(transform({labels}, t -> named_struct("
        f"'hq', {N.contains_any('lower(t.s)', K.HQ_OFFICE_KEYWORDS)},"
        f" 'other', {N.contains_any('lower(t.s)', K.OTHER_OFFICE_KEYWORDS)},"
        f" 'block', {block})), b -> length(b.block) between {low} and {high})"
    )
    hq_blocks = "transform(bs, b -> case when b.hq then b.block else '' end)"
    # A block already listed as headquarters counts as another office when it comes up
    # again with such a label.
    other = (
        "filter(bs, (b, i) -> b.other and"
        " (not b.hq or array_position(hs, b.block) between 1 and i))"
    )
    lists = (
        "named_struct("
        "'hq', array_distinct(filter(hs, h -> h <> '')),"
        f" 'other', array_distinct(transform({other}, b -> b.block)))"
    )
    return let(blocks, "bs", let(hq_blocks, "hs", lists))


# --- items --------------------------------------------------------------------------


def distinct_items(items: str) -> str:
    """First spelling of each item, case ignored, in order. Equal ones are brought together by
    sorting, so that long lists do not compare all with all."""
    sorted_ = (
        f"array_sort(transform({items}, (t, i) -> named_struct('l', lower(t), 'i', i, 't', t)))"
    )
    firsts = "filter(xs, (x, j) -> j = 0 or get(xs, j - 1).l <> x.l)"
    placed = f"array_sort(transform({firsts}, x -> named_struct('i', x.i, 't', x.t)))"
    return let(sorted_, "xs", f"transform({placed}, x -> x.t)")


CHROMELESS_LINKS = "filter(elems, e -> e.tag = 'a' and not e.in_chrome)"


def heading_items(name: str) -> str:
    """Headings, then list entries with a link, outside chrome and free of boilerplate."""
    headings = elements("e.tag in ('h2', 'h3', 'h4') and not e.in_chrome")
    linked = elements(
        "e.tag = 'li' and e.in_list and not e.in_chrome and"
        " exists(slice(links, e.a0 + 1, e.a1 - e.a0), a -> not a.in_script)"
    )
    entries = let(CHROMELESS_LINKS, "links", f"transform({linked}, e -> {main_text('e')})")
    low, high = K.HEADING_LENGTH
    good = (
        f"coalesce(length(t) between {low} and {high}, false)"
        f" and not {N.boilerplate('lower(t)', name)}"
    )
    both = f"concat(transform({headings}, e -> {main_text('e')}), {entries})"
    return distinct_items(f"filter({both}, t -> {good})")


def _usable(text: str, bucket: str, name: str) -> str:
    """The text if it may name an item, else null."""
    low, high = K.ITEM_LENGTH
    return let(
        text,
        "u",
        f"case when length(u) between {low} and {high}"
        f" and not {N.listing_noise('u', bucket, name)} then u end",
    )


# Members of card groups: groups by parent, then by their first member.
CARDS = (
    "transform(array_sort(transform("
    f"filter(elems, c -> not c.in_chrome and c.twins >= {K.CARD_GROUP_MIN}),"
    " c -> named_struct('parent', c.parent, 'eldest', c.eldest, 'id', c.id, 'card', c))),"
    " k -> k.card)"
)


def taxonomy_items(links: str) -> str:
    """Usable texts of links into a category, industry or filter view."""
    hinted = f"coalesce({N.contains_any('a.href', K.TAXONOMY_HREF_HINTS)}, false)"
    return f"transform(filter({links}, a -> {hinted}), a -> a.text)"


def titled_links(bucket: str, name: str) -> str:
    return (
        f"transform({CHROMELESS_LINKS}, a -> named_struct("
        f"'text', {_usable(listing_text('a'), bucket, name)}, 'href', lower(a.href)))"
    )


def card_items(links: str, bucket: str, name: str) -> str:
    """One title per card: its first heading, or else the first usable link, or else its
    own text. A card is an element with two or more siblings of the same tag and classes."""
    heading = let("get(elems, c.heading)", "h", _usable(listing_text("h"), bucket, name))
    inside = f"slice({links}, c.a0 + 1, c.a1 - c.a0)"
    # A text is never shorter than its ink: whoever has more than allowed is out.
    own = f"case when c.ink <= {K.ITEM_LENGTH[1]} then {_usable(listing_text('c'), bucket, name)} end"
    return (
        f"transform({CARDS}, c -> coalesce("
        f"case when c.heading is not null then {heading} end,"
        f" get(filter({inside}, a -> a.text is not null), 0).text, {own}))"
    )


def listing_items(bucket: str, name: str) -> str:
    """Items of a listing page: links that point into a taxonomy, then cards."""
    both = f"concat({taxonomy_items('ls')}, {card_items('ls', bucket, name)})"
    found = let(titled_links(bucket, name), "ls", f"filter({both}, t -> t is not null)")
    return distinct_items(found)


def bucket_items(page_type: str, name: str, url_name: str) -> str:
    """Listing items plus the name in the URL for the four listing page types; headings
    where that yields nothing and for all other pages."""
    known = f"array_contains(transform(its, t -> lower(t)), lower({url_name}))"
    listed = let(
        listing_items(page_type, name),
        "its",
        f"case when {url_name} is not null and not {known}"
        f" then concat(array({url_name}), its) else its end",
    )
    buckets = ", ".join(f"'{b}'" for b in K.BUCKET_TYPES)
    return let(
        f"case when {page_type} in ({buckets}) then {listed} end",
        "r",
        f"case when coalesce(size(r), 0) > 0 then r else {heading_items(name)} end",
    )


def count_below(outer: str, inner: str) -> str:
    """How many times an element ``inner`` stands somewhere below an element ``outer``; one below two of them
    counts twice.

    One sweep over the elements in document order, with the open ``outer`` ones (the ends of them) on a
    stack."""
    live = "filter(s.open, l -> l >= e.id)"
    return (
        f"aggregate(filter(elems, e -> e.tag in ('{outer}', '{inner}')),"
        " named_struct('open', cast(array() as array<int>), 'n', 0L), (s, e) -> named_struct("
        f"'open', case when e.tag = '{outer}' then concat({live}, array(e.last)) else {live} end,"
        f" 'n', s.n + case when e.tag = '{inner}' then size({live}) else 0 end), s -> s.n)"
    )

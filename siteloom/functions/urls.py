"""URL rules as Column expressions.

``parse_url`` rejects paths the pipeline must accept (a bare ``|``, a bad ``%zz``), so
URLs are taken apart by the generic syntax of RFC 3986, and relative references are
resolved by section 5.2.2 of the same text.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom import constants as K
from siteloom.functions import noise as N
from siteloom.functions import text as T

NETLOC_PATTERN = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def url_netloc(url: Column) -> Column:
    return F.regexp_extract(url, NETLOC_PATTERN, 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def site_key(netloc: Column) -> Column:
    host = F.lower(F.substring_index(netloc, ":", 1))
    return F.regexp_replace(host, r"^www\.", "")


def site_key_of(url: Column) -> Column:
    return site_key(url_netloc(url))


def is_same_site(url: Column, root_url: Column) -> Column:
    # The authority ends at the third slash at the latest.
    alike = F.substring_index(url, "/", 3) == F.substring_index(root_url, "/", 3)
    return F.when(alike, True).otherwise(site_key_of(url) == site_key_of(root_url))


def path_key(canonical: Column) -> Column:
    return F.substring_index(canonical, "?", 1)


def has_query(canonical: Column) -> Column:
    return canonical.contains("?")


_PLAIN_HOST = r"^https?://[a-z0-9.\-]+"
# Printable ASCII without ? # and ;, no dot segments, no empty segments.
_PLAIN_PATH = r"^(?!.*/[/.])/[!-\"$-:<->@-~]*$"
_CANONICAL = _PLAIN_HOST + r"(?!.*/[/.])/[!-\"$-:<->@-~]*$"


def _parts(u: str) -> str:
    """Pieces of a URL as a struct: scheme ``s``, authority ``n`` and whether there is one
    ``h``, path ``p``, query ``q``. A missing piece is the empty string."""
    query = "case when contains(f, '?') then substr(f, instr(f, '?') + 1) else '' end"
    # After the scheme: either an authority up to the next slash, or the path at once.
    authority = "case when startswith(o.r, '//') then substring_index(substr(o.r, 3), '/', 1) else '' end"
    path = "case when startswith(o.r, '//') then substr(o.r, 3 + length(a)) else o.r end"
    struct = (
        f"named_struct('s', lower(o.s), 'n', a, 'h', startswith(o.r, '//'), 'p', {path}, 'q', {query})"
    )
    scheme = N.literal(r"^([A-Za-z][A-Za-z0-9+.\-]*):")
    opened = (
        f"named_struct('s', regexp_extract(g, {scheme}, 1),"
        f" 'r', regexp_replace(g, {scheme}, ''))"
    )
    rest = N.let("substring_index(f, '?', 1)", "g", N.let(opened, "o", N.let(authority, "a", struct)))
    return N.let(f"substring_index({u}, '#', 1)", "f", rest)


def _walk(path: str, keep_empty: bool) -> str:
    """Segments of a path with '.' and '..' resolved, and empty ones if not kept."""
    skip = "seg = '.'" if keep_empty else "seg in ('', '.')"
    least = 1 if keep_empty else 0
    return (
        f"aggregate(split({path}, '/'), cast(array() as array<string>), (acc, seg) ->"
        f" case when {skip} then acc"
        f" when seg = '..' and size(acc) > {least} then slice(acc, 1, greatest(size(acc) - 1, 0))"
        f" when seg = '..' then acc else concat(acc, array(seg)) end)"
    )


_DOTS = r"/\.{1,2}(?:/|$)"


def _normal_path(p: str) -> str:
    """Dot segments and repeated slashes removed; a trailing slash is kept; exactly two
    leading slashes are kept as two, the way POSIX paths are normalised."""
    lead = f"case when {N.matches(p, '^//(?!/)')} then '//' else '/' end"
    closed = f"case when endswith({p}, '/') and body <> '/' then concat(body, '/') else body end"
    rebuilt = N.let(f"concat({lead}, array_join({_walk(p, False)}, '/'))", "body", closed)
    plain = f"startswith({p}, '/') and not {N.matches(p, '//|' + _DOTS)}"
    return f"case when {p} = '' then '/' when {plain} then {p} else {rebuilt} end"


def _dot_free(p: str) -> str:
    """Dot segments of a merged reference; empty segments survive until _normal_path."""
    closing = f"case when {N.matches(p, r'/\.{1,2}$')} then '/' else '' end"
    rebuilt = f"concat(array_join({_walk(p, True)}, '/'), {closing})"
    return f"case when {N.matches(p, _DOTS)} then {rebuilt} else {p} end"


def _form_decode(s: str) -> str:
    lone_percent = f"regexp_replace({s}, '%(?![0-9A-Fa-f]{{2}})', '%25')"
    decoded = f"coalesce(try_url_decode({lone_percent}), {s})"
    return f"case when contains({s}, '%') or contains({s}, '+') then {decoded} else {s} end"


def _form_encode(s: str) -> str:
    encoded = f"replace(replace(url_encode({s}), '%7E', '~'), '*', '%2A')"
    return f"case when {N.matches(s, '[^A-Za-z0-9_.~-]')} then {encoded} else {s} end"


def _normal_query(q: str) -> str:
    """Tracking parameters dropped, the rest sorted by name and value and re-encoded.
    Parameters with an empty value are kept, empty pairs are not."""
    value = _form_decode("substr(x, instr(x, '=') + 1)")
    pairs = (
        f"transform(filter(split({q}, '&'), x -> x <> ''), x -> named_struct("
        f"'k', {_form_decode("substring_index(x, '=', 1)")},"
        f" 'v', case when contains(x, '=') then {value} else '' end))"
    )
    kept = f"array_sort(filter({pairs}, x -> not {N.equals_any('lower(x.k)', K.TRACKING_PARAMS)}))"
    encoded = f"transform({kept}, x -> concat({_form_encode('x.k')}, '=', {_form_encode('x.v')}))"
    return (
        f"case when {q} = '' then '' else"
        f" {N.let(f"array_join({encoded}, '&')", 'z', "case when z = '' then '' else concat('?', z) end")} end"
    )


def _assemble(t: str) -> str:
    netloc = (
        f"case {t}.s when 'http' then regexp_replace(lower({t}.n), ':80$', '')"
        f" else regexp_replace(lower({t}.n), ':443$', '') end"
    )
    # ';params' belong to the last path segment and name no page of their own.
    path = N.let(f"regexp_replace({t}.p, ';[^/]*$', '')", "path", _normal_path("path"))
    return (
        f"case when {t}.s in ('http', 'https') then"
        f" concat({t}.s, '://', {netloc}, {path}, {_normal_query(t + '.q')}) end"
    )


def _resolved(r: str, b: str) -> str:
    """Pieces of reference ``r`` as seen from the absolute URL ``b``."""
    own_netloc = f"(({r}.s <> '' and {r}.s <> {b}.s) or {r}.h)"
    merged = (
        f"concat(case when {b}.p = '' then '/' else regexp_replace({b}.p, '[^/]*$', '') end, {r}.p)"
    )
    path = (
        f"case when {own_netloc} then {r}.p when {r}.p = '' then {b}.p"
        f" when startswith({r}.p, '/') then {_dot_free(r + '.p')}"
        f" else {N.let(merged, 'm', _dot_free('m'))} end"
    )
    return (
        f"named_struct('s', case when {r}.s <> '' then {r}.s else {b}.s end,"
        f" 'n', case when {own_netloc} then {r}.n else {b}.n end, 'p', {path},"
        f" 'q', case when not {own_netloc} and {r}.p = '' and {r}.q = '' then {b}.q else {r}.q end)"
    )


def canonical_url(url: str, base: str | None = None) -> Column:
    """One spelling per page, or null for anything that is not an http(s) page. ``url`` and
    ``base`` are column names; relative URLs are resolved against an absolute ``base``.

    Every piece is bound once and reused; see links.with_canonical_url for using the result
    in filters without computing it again."""
    page = _assemble("r")
    if base is not None:
        page = N.let(_parts(base), "b", N.let(_resolved("r", "b"), "t", _assemble("t")))
    page = N.let(_parts("u"), "r", page)
    not_page = f"u = '' or {N.starts_with_any('u', ['mailto:', 'tel:', 'javascript:', '#'])}"
    # Control characters that browsers drop from inside a URL are dropped here too.
    text = f"translate({N.strip(url)}, '\t\r\n', '')"
    slow = N.let(text, "u", f"case when {not_page} then null else {page} end")
    # Most URLs are canonical but for a fragment, or are plain paths seen from a plain host.
    quick = f"when {N.matches('d', _CANONICAL)} then d"
    if base is not None:
        quick += (
            f" when {N.matches('d', _PLAIN_PATH)} and {N.matches(base, _PLAIN_HOST + '(?:[/?#]|$)')}"
            f" then concat(regexp_extract({base}, {N.literal(_PLAIN_HOST)}, 0), d)"
        )
    return F.expr(N.let(f"substring_index({url}, '#', 1)", "d", f"case {quick} else {slow} end"))


def _listed(*ranges: str) -> str:
    """A class that lists its characters one by one: told by one look into a table, not range by range."""
    chars = [chr(c) for r in ranges for c in range(ord(r[0]), ord(r[-1]) + 1)]
    return "[" + "".join(c if c.isalnum() else f"\\x{ord(c):02x}" for c in chars) + "]"


#: Characters of paths that are taken as they are; without a colon, a reference has no scheme.
_PATH_CHAR = _listed("/", "!", '"', "$.", "09", "<", "=", ">", "@~")
_NAMED_HOST = rf"\Ahttps?://[a-z0-9]{_listed('az', '09', '.', '-')}*+"
_QUERY_WORD = _listed("AZ", "az", "09", "_", ".", "~", "-")
_PAIR = rf"{_QUERY_WORD}++={_QUERY_WORD}*+"
_SIMPLE_QUERY = rf"(?:\?{_PAIR}(?:&{_PAIR})*+)?+"
_ABSOLUTE = rf"{_NAMED_HOST}/{_PATH_CHAR}*+{_SIMPLE_QUERY}\z"
_REFERENCE = rf"\A(?!//){_PATH_CHAR}++{_SIMPLE_QUERY}\z"
_NAMED_PAGE = rf"{_NAMED_HOST}/{_PATH_CHAR}*+\z"
# A segment with the '..' behind it; the host is none.
_STEP_UP = r"(?<!/)/(?!\.\.?/)[^/]+/\.\./"


def with_common_url(df: DataFrame, url: str, base: str | None, name: str) -> DataFrame:
    """Add ``canonical_url`` of common spellings as column ``name``, null for all others.

    Plain hosts, paths with few dot segments, and queries that need no decoding are done step by step, a
    projection each: these are compiled, whereas the lambdas of canonical_url are not. A step asks a pattern
    only where a plain search finds what it is about."""
    d, joined, q, page = f"_{name}_d", f"_{name}_joined", f"_{name}_q", f"_{name}_page"
    kept = df.columns
    cut = df.select("*", F.expr(f"substring_index({url}, '#', 1)").alias(d))
    place = f"when startswith({d}, 'http') and {N.matches(d, _ABSOLUTE)} then substring_index({d}, '?', 1)"
    if base is not None:
        cut = cut.select("*", F.expr(f"substring_index(substring_index({base}, '#', 1), '?', 1)").alias(page))
        folder = f"substr({page}, 1, length({page}) - length(substring_index({page}, '/', -1)))"
        # Pages with an empty segment behind the scheme are left to the whole rule.
        place += (
            f" when {N.matches(d, _REFERENCE)} and {N.matches(page, _NAMED_PAGE)} and not contains(substr({page}, 9), '//')"
            f" then concat(case when startswith({d}, '/') then substring_index({page}, '/', 3) else {folder} end,"
            f" substring_index({d}, '?', 1))"
        )
    query = f"case when contains({d}, '?') then substr({d}, instr({d}, '?') + 1) else '' end"
    placed = cut.select(*kept, F.expr(f"case {place} end").alias(joined), F.expr(query).alias(q))
    told = f"btrim(regexp_replace(concat('&', {q}), {N.literal('(?i)&' + T._any_of(K.TRACKING_PARAMS) + '=[^&]*')}, ''), '&')"
    walked = placed.withColumn(q, F.expr(f"case when {q} = '' then '' else {told} end"))
    # Two steps up in a row are done here, more are not.
    for found, pattern in (("/./", r"/(?:\./)+"), ("/../", _STEP_UP), ("/../", _STEP_UP)):
        flat = f"regexp_replace({joined}, {N.literal(pattern)}, '/')"
        walked = walked.withColumn(joined, F.expr(f"case when contains({joined}, '{found}') then {flat} else {joined} end"))
    # Sorted by name, then by value: the sign between them sorts before all that may stand in a name.
    ordered = f"translate(array_join(sort_array(split(translate({q}, '=', '\x01'), '&')), '&'), '\x01', '=')"
    tail = f"case when {q} = '' then '' when contains({q}, '&') then concat('?', {ordered}) else concat('?', {q}) end"
    # A colon stands behind the scheme only, where the two slashes are no empty segment.
    rough = f"contains(substr({joined}, 9), '//') or (contains({joined}, '/.') and {N.matches(joined, _DOTS)})"
    return walked.select(*kept, F.expr(f"case when not ({rough}) then concat({joined}, {tail}) end").alias(name))


# --- gates ------------------------------------------------------------------------


def has_non_html_extension(url: Column) -> Column:
    return T.ends_with_any(F.lower(url_path(url)), K.NON_HTML_EXTENSIONS)


def is_skip_path(url: Column) -> Column:
    return T.contains_any(F.lower(url_path(url)), K.SKIP_PATH_KEYWORDS)


#: Both gates in one search; at most places the first character tells that none of the words begins there.
_UNREAD = (
    f"(?=[{''.join(sorted({w[0] for w in K.SKIP_PATH_KEYWORDS + K.NON_HTML_EXTENSIONS}))}])"
    rf"(?:{T._any_of(K.SKIP_PATH_KEYWORDS)}|{T._any_of(K.NON_HTML_EXTENSIONS)}\z)"
)


def is_worth_reading(url: Column) -> Column:
    return ~F.lower(url_path(url)).rlike(_UNREAD)


def is_third_party_listing(url: Column) -> Column:
    """The page describes another entity: a detail-page segment followed by a slug."""
    path = F.lower(url_path(url))

    def hit(hint: str) -> Column:
        # The reluctant start makes this the first occurrence of the hint.
        slug = F.regexp_extract(path, "(?s)^.*?" + hint + "/*([^/]*)", 1)
        return slug.contains("-") | (F.length(slug) > K.THIRD_PARTY_SLUG_CHARS)

    return T.contains_any(path, K.THIRD_PARTY_PATH_HINTS) & reduce(
        or_, [hit(h) for h in K.THIRD_PARTY_PATH_HINTS]
    )


# --- names that a URL gives away ----------------------------------------------------


def name_from_domain(url: Column) -> Column:
    host = F.regexp_replace(F.lower(url_netloc(url)), r"^www\.", "")
    return F.nullif(T.capitalize(F.substring_index(host, ".", 1)), F.lit(""))


def humanize_slug(slug: Column) -> Column:
    kept = F.filter(F.split(slug, "-"), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
    return F.nullif(F.array_join(F.transform(kept, T.capitalize), " "), F.lit(""))


_INDUSTRY_SLUG = r"(?i)/industr(?:y|ies)/([a-z0-9][a-z0-9\-]*)"
_SOLUTION_SLUG = r"(?i)/solutions?/(?!industr(?:y|ies)\b)([a-z0-9][a-z0-9\-]*)"


def taxonomy_name(url: Column, bucket: Column) -> Column:
    """Industry or solution named by the path itself; null for other buckets."""
    path = url_path(url)
    slug = F.when(bucket == "industries", F.regexp_extract(path, _INDUSTRY_SLUG, 1)).when(
        bucket == "solutions", F.regexp_extract(path, _SOLUTION_SLUG, 1)
    )
    return humanize_slug(F.nullif(slug, F.lit("")))

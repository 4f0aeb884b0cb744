"""The registered queries once more, as SQL over the given tables.

Nothing here looks at generated pages where the answer follows from the tables they are made
of: a supplier's profile, say, is computed from the supplier's row. Word lists are the fixed
values of ``siteloom.constants``; the rules around them are written anew."""

from __future__ import annotations

from siteloom import constants as K


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _any(fn: str, s: str, values) -> str:
    return "(" + " OR ".join(f"{fn}({s}, '{v}')" for v in values) + ")"


def _category(haystack: str, fallback: str) -> str:
    whens = " ".join(
        f"WHEN {_any('contains', haystack, words)} THEN '{name}'"
        for name, words in K.CATEGORY_KEYWORDS
    )
    return f"CASE {whens} ELSE {fallback} END"


def _classify(path: str, anchor: str = "''") -> str:
    return (
        f"CASE WHEN {path} IN ('', '/') THEN 'home'"
        f" WHEN regexp_matches({path}, '/industr(y|ies)(/|$)') THEN 'industries'"
        f" ELSE {_category(f"({path} || ' ' || {anchor})", "'other'")} END"
    )


def _skip(path: str) -> str:
    return _any("contains", path, K.SKIP_PATH_KEYWORDS)


def _is_file(path: str) -> str:
    return _any("ends_with", path, K.NON_HTML_EXTENSIONS)


def _initcap(s: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({s}, ' '),"
        f" lambda x: upper(x[1]) || lower(x[2:])), ' ')"
    )


def _clean(s: str) -> str:
    return rf"nullif(trim(regexp_replace({s}, '\s+', ' ', 'g')), '')"


def _unescape(s: str) -> str:
    for entity, char in (
        ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"),
        ("&#39;", "''"), ("&amp;", "&"),
    ):
        s = f"replace({s}, '{entity}', '{char}')"
    return s


ORACLES: dict[str, str] = {}

# --- URLs of the raw pages ---------------------------------------------------------------

CANON = f"""
canon AS (
  SELECT page_id, base || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END
         AS canonical_url, base AS path_key,
         regexp_replace(split_part(base, '/', 3), '^www\\.', '') AS site_key, url, html
  FROM (SELECT page_id, url, html, split_part(u, '?', 1) AS base,
               list_sort(list_filter(string_split(CASE WHEN contains(u, '?')
                 THEN split_part(u, '?', 2) ELSE '' END, '&'),
                 lambda p: p <> '' AND split_part(p, '=', 1) NOT IN {_in(K.TRACKING_PARAMS)})) AS kept
        FROM (SELECT page_id, url, html, split_part(url, '#', 1) AS u FROM pages)))
"""
ORACLES["canonical_urls"] = f"WITH {CANON} SELECT page_id, canonical_url, site_key, path_key FROM canon"
ORACLES["site_page_counts"] = f"""
WITH {CANON} SELECT site_key, CAST(count(*) AS BIGINT) AS n_pages,
       count(DISTINCT canonical_url) AS n_urls FROM canon GROUP BY 1"""

ORACLES["messy_urls"] = """
WITH c AS (SELECT c_custkey, lower(c_mktsegment) AS seg, c_nationkey AS n FROM customer)
SELECT c_custkey, 'full' AS kind,
  'https://www.cust' || c_custkey || '.test/' || seg || '/x/?a=&a=~q+r&b=' || n AS canonical_url FROM c
UNION ALL SELECT c_custkey, 'parent', 'http://h' || c_custkey || '.test/a/' || seg || '|x?y=' FROM c
UNION ALL SELECT c_custkey, 'query', 'http://h' || c_custkey || '.test/a/b/c?p=' || c_custkey FROM c
UNION ALL SELECT c_custkey, 'host', 'http://other.test/' || c_custkey || '%zz/' FROM c
UNION ALL SELECT c_custkey, 'bare', 'https://www.cust' || c_custkey || '.test/' FROM c
UNION ALL SELECT c_custkey, 'port', 'http://cust' || c_custkey || '.test:8080/a/' FROM c
UNION ALL SELECT c_custkey, 'slashes', 'https://cust' || c_custkey || '.test//a' FROM c
UNION ALL SELECT c_custkey, unnest(['mail', 'anchor', 'ftp']), NULL FROM c"""

ORACLES["url_variants"] = """
WITH l AS (
  SELECT l_orderkey, l_partkey, l_suppkey, min(l_linenumber) AS ln FROM lineitem GROUP BY 1, 2, 3),
o AS (
  SELECT l.*, o_custkey,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY ln, l_partkey, l_suppkey) - 1 AS ord
  FROM l JOIN orders ON l_orderkey = o_orderkey),
u AS (
  SELECT 'https://shop-' || o_custkey || '.test/products/part-' || l_partkey AS path_key,
    l_suppkey, min(l_orderkey * 1000 + ord) AS place FROM o GROUP BY 1, 2)
SELECT path_key || '?supplier=' || l_suppkey AS canonical_url, path_key,
  row_number() OVER (PARTITION BY path_key ORDER BY place) - 1 AS variant_rank FROM u"""

ORACLES["url_gates"] = f"""
WITH u AS (
  SELECT 'https://c' || c_custkey || '.test/' || unnest([
    'login/' || c_custkey, 'a/Report-' || c_custkey || '.PDF', 'research/' || c_custkey,
    'blueprint/' || c_custkey, 'v/page/' || c_custkey, 'products/' || c_custkey,
    'business/' || c_custkey || '-co', 'business/register', 'biz/abcdefghijklm' || c_custkey,
    'x/member/' || c_custkey || '/a-b', 'vendor//' || c_custkey || '-x', 'profile/']) AS url
  FROM customer),
p AS (SELECT url, lower(regexp_replace(url, '^https://[^/]*', '')) AS path FROM u),
h AS (SELECT unnest({list(K.THIRD_PARTY_PATH_HINTS)}) AS hint),
t AS (
  SELECT DISTINCT url FROM p, h WHERE contains(path, hint)
    AND (contains(split_part(ltrim(substr(path, strpos(path, hint) + length(hint)), '/'), '/', 1), '-')
      OR length(split_part(ltrim(substr(path, strpos(path, hint) + length(hint)), '/'), '/', 1)) > 15))
SELECT p.url, {_is_file('path')} AS is_file, {_skip('path')} AS is_trap,
  NOT {_is_file('path')} AND NOT {_skip('path')} AS is_worth, t.url IS NOT NULL AS is_third_party
FROM p LEFT JOIN t ON p.url = t.url"""

ORACLES["url_names"] = f"""
SELECT 'https://www.mart' || c_custkey || '.test/Solutions/industry/' || lower(c_mktsegment) || '-'
    || c_custkey || '-trade' AS url,
  {_initcap('c_mktsegment')} || ' Trade' AS industry, CAST(NULL AS VARCHAR) AS solution,
  CAST(NULL AS VARCHAR) AS product, 'Mart' || c_custkey AS domain_name FROM customer
UNION ALL
SELECT 'https://hub' || c_custkey || '.test/solution/' || lower(c_mktsegment) || '-x2-flow/y', NULL,
  {_initcap('c_mktsegment')} || ' X2 Flow', NULL, 'Hub' || c_custkey FROM customer"""

# --- links of the raw pages ------------------------------------------------------------------

RAW_LINKS = """
raw_links AS (
  SELECT page_id, i - 1 AS ord, a, regexp_extract(a, 'href="([^"]*)"', 1) AS href,
    regexp_extract(a, '>([^<]*)</a>', 1) AS anchor, root, site_key
  FROM (SELECT page_id, unnest(ls) AS a, generate_subscripts(ls, 1) AS i,
          regexp_extract(url, '^https?://[^/]+') AS root,
          regexp_replace(split_part(url, '/', 3), '^www\\.', '') AS site_key
        FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS ls
              FROM pages)))
"""
ORACLES["link_inventory"] = f"""
WITH {RAW_LINKS} SELECT page_id, ord, href, anchor, root || href AS canonical_url FROM raw_links"""
ORACLES["link_graph"] = f"""
WITH {RAW_LINKS}
SELECT {_classify('lower(href)', 'lower(anchor)')} AS category, count(*) AS n_links,
  count(DISTINCT root || href) AS n_targets
FROM raw_links WHERE NOT {_is_file('lower(href)')} AND NOT {_skip('lower(href)')} GROUP BY 1"""
ORACLES["orphan_links"] = f"""
WITH {CANON}, {RAW_LINKS}
SELECT site_key, count(*) AS n_links FROM raw_links
WHERE root || href NOT IN (SELECT canonical_url FROM canon) GROUP BY 1"""

# --- fields of the raw pages --------------------------------------------------------------------

ORACLES["tag_counts"] = """
WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)) AS tag
           FROM pages)
SELECT tag, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM t GROUP BY 1"""
ORACLES["article_paragraphs"] = """
SELECT page_id, len(regexp_extract_all(regexp_extract(html, '(?s)<article>.*</article>'), '<p>'))
  AS n_paragraphs FROM pages WHERE contains(html, '<article>')
  AND len(regexp_extract_all(regexp_extract(html, '(?s)<article>.*</article>'), '<p>')) > 0"""

_COUNTS = {
    ("nav", "a"): r"len(regexp_extract_all(regexp_extract(html, '(?s)<nav>.*</nav>'), '<a '))",
    ("ul", "li"): "len(regexp_extract_all(html, '<li>'))",
    ("article", "p"): "len(regexp_extract_all(regexp_extract(html, '(?s)<article>.*</article>'), '<p>'))",
    ("body", "p"): "len(regexp_extract_all(html, '<p>'))",
    ("html", "title"): "len(regexp_extract_all(html, '<title>'))",
    ("article", "article"): "0",
}
ORACLES["nested_tags"] = " UNION ALL ".join(
    f"SELECT page_id, '{o}' AS outer_tag, '{i}' AS inner_tag, CAST({n} AS BIGINT) AS n FROM pages"
    for (o, i), n in _COUNTS.items()
)

RAW_FIELDS = rf"""
raw_fields AS (
  SELECT page_id, url, html,
    {_clean(_unescape("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))} AS title,
    {_clean(_unescape("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} AS h1,
    {_clean(_unescape(
        "regexp_replace(html, '(?s)<script>.*?</script>|<style>.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g')"
    ))} AS visible,
    lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*', '')) AS path
  FROM pages),
raw_typed AS (
  SELECT *, {_classify('path')} AS url_type FROM raw_fields),
raw_named AS (
  SELECT *, CASE WHEN url_type <> 'other' THEN url_type
    ELSE {_category("lower(coalesce(title, '') || ' ' || coalesce(h1, ''))", "'other'")} END AS page_type,
    CASE WHEN lower(title) IN {_in(K.GENERIC_TITLE_WORDS)} THEN h1 ELSE
      list_reduce(list_filter(string_split_regex(title, '\s*[|–:-]\s*'),
        lambda p: lower(trim(p)) NOT IN {_in(K.GENERIC_TITLE_WORDS)}),
        lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) END AS company_name
  FROM raw_typed)
"""
ORACLES["page_titles"] = f"WITH {RAW_FIELDS} SELECT page_id, title, h1 FROM raw_fields"
ORACLES["page_names"] = f"WITH {RAW_FIELDS} SELECT page_id, company_name FROM raw_named"
ORACLES["page_types"] = f"WITH {RAW_FIELDS} SELECT page_id, url_type, page_type FROM raw_named"
ORACLES["page_texts"] = f"""
WITH {RAW_FIELDS}
SELECT page_id, coalesce(length(visible), 0) AS visible_chars, md5(visible) AS visible_md5,
  coalesce(length(visible), 0) < 200 AS is_thin
FROM raw_fields"""

EMAIL = "[a-zA-Z0-9][a-zA-Z0-9._%+-]*@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"


def _good_email(e: str) -> str:
    return (
        f"NOT regexp_matches(lower({e}), '\\.(png|jpe?g|gif|svg|webp)$')"
        f" AND split_part(lower({e}), '@', 2) NOT IN {_in(K.PLACEHOLDER_DOMAINS)}"
        f" AND split_part(lower({e}), '@', 1) NOT IN {_in(K.PLACEHOLDER_LOCALS)}"
    )


def _emails(s: str) -> str:
    return (
        f"list_sort(list_distinct(list_filter(regexp_extract_all({s}, '{EMAIL}'),"
        f" lambda e: {_good_email('e')})))"
    )


# RE2 has no look-around. Runs of digits are bracketed first, so that a match can be made to
# begin with a run (or a sign that does not follow one) and to end with one.
def _phone_list(s: str) -> str:
    marked = f"regexp_replace({s}, '([0-9]+)', '‹\\1›', 'g')"
    marked = f"replace(replace({marked}, '›+', '›¤'), '›(', '›¶')"
    group = r"[(¶]?‹?[0-9]{2,4}›?\)?[\s.-]?"
    pattern = (
        rf"(?:\+?‹[0-9]{{1,3}}›?[\s.-]?(?:{group}){{2,4}}"
        rf"|\(?‹[0-9]{{2,4}}›?\)?[\s.-]?(?:{group}){{1,3}})‹?[0-9]{{3,4}}›"
    )
    bare = "trim(replace(replace(replace(p, '‹', ''), '›', ''), '¶', '('))"
    return f"list_transform(regexp_extract_all({marked}, '{pattern}'), lambda p: {bare})"


def _is_range_list(p: str) -> str:
    return (
        f"len(list_filter(string_split({p}, ' '), lambda t: regexp_matches(t, '^[0-9]{{1,4}}-[0-9]{{1,4}}$')"
        " AND try_cast(split_part(t, '-', 2) AS INT) > try_cast(split_part(t, '-', 1) AS INT))) >= 2"
    )


def _good_phone(p: str) -> str:
    return (
        f"length(regexp_replace({p}, '[^0-9]', '', 'g')) BETWEEN 7 AND 15 AND NOT ({_is_range_list(p)})"
    )


def _phones(s: str) -> str:
    return f"list_sort(list_distinct(list_filter({_phone_list(s)}, lambda q: {_good_phone('q')})))"


_SOCIAL = "|".join(d.replace(".", "\\.") for d, _ in K.SOCIAL_DOMAINS)
ORACLES["page_fields"] = rf"""
WITH {RAW_FIELDS}
SELECT page_id, nullif(regexp_extract(html, '<meta name="description" content="([^"]*)"', 1), '') AS meta_description,
  array_to_string({_emails('html')}, '|') AS emails,
  array_to_string({_phones("coalesce(visible, '')")}, '|') AS phones,
  array_to_string(regexp_extract_all(html, 'href="(https?://(?:www\.)?(?:{_SOCIAL})[^"]*)"', 1), '|') AS social_links,
  array_to_string(regexp_extract_all(html, '(?s)<address>(.*?)</address>', 1), '|') AS address_candidates,
  array_to_string(regexp_extract_all(lower(visible), '{"|".join(K.HQ_OFFICE_KEYWORDS)}'), '|') AS headquarters_candidates,
  array_to_string(regexp_extract_all(lower(visible), '{"|".join(K.OTHER_OFFICE_KEYWORDS)}'), '|')
    AS other_location_candidates,
  array_to_string(regexp_extract_all(html, '<h[234]>(.*?)</h[234]>', 1), '|') AS heading_list_items,
  {_any("contains", "path", K.THIRD_PARTY_PATH_HINTS)} AS is_third_party
FROM raw_fields"""
ORACLES["site_profiles"] = rf"""
WITH {RAW_FIELDS},
read AS (
  SELECT *, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') AS website,
    CASE page_type WHEN 'home' THEN 0 WHEN 'about' THEN 1 WHEN 'contact' THEN 2 ELSE 5 END AS rank FROM raw_named),
mails AS (
  SELECT DISTINCT website, unnest({_emails('html')}) AS value FROM read WHERE page_type IN {_in(K.CONTACT_TRUSTED_TYPES)}),
numbers AS (
  SELECT DISTINCT website, unnest({_phones("coalesce(visible, '')")}) AS value FROM read
  WHERE page_type IN {_in(K.CONTACT_TRUSTED_TYPES)})
SELECT website, 'company_name' AS field, CAST(1 AS BIGINT) AS place,
  arg_min(company_name, rank * 1000000000000 + page_id) AS value FROM read WHERE company_name <> '' GROUP BY 1
UNION ALL SELECT website, 'emails', row_number() OVER (PARTITION BY website ORDER BY value), value FROM mails
UNION ALL SELECT website, 'phones', row_number() OVER (PARTITION BY website ORDER BY value), value FROM numbers"""
ORACLES["page_emails"] = f"SELECT page_id, unnest({_emails('html')}) AS email FROM pages"
ORACLES["document_emails"] = f"SELECT doc_id, unnest({_emails('text')}) AS email FROM documents"
ORACLES["document_phones"] = f"""
WITH d AS (SELECT doc_id, {_clean('text')} AS t FROM documents)
SELECT doc_id, unnest({_phones('t')}) AS phone FROM d"""
ORACLES["conversation_contacts"] = f"""
WITH c AS (SELECT conv_id, turn, text, coalesce({_clean('text')}, '') AS t FROM conversations)
SELECT conv_id, turn, array_to_string({_emails('text')}, '|') AS emails,
  array_to_string({_phones('t')}, '|') AS phones FROM c"""
ORACLES["email_verdicts"] = f"""
WITH e AS (SELECT unnest(['c' || c_custkey || '@' || lower(c_mktsegment) || '.test',
    'You@shop' || c_custkey || '.test', 'info' || c_custkey || '@Example.com',
    'pic' || c_custkey || '@2x.JPEG', 'a' || c_custkey || '@sentry.io.test']) AS email FROM customer)
SELECT email, {_good_email('email')} AS is_valid FROM e"""
ORACLES["phone_verdicts"] = f"""
WITH p AS (SELECT unnest(['+' || c_nationkey || ' ' || lpad(c_custkey::VARCHAR, 7, '0'),
    c_custkey::VARCHAR, '10 10-99 100-' || (100 + c_nationkey) || ' ' || c_custkey,
    '99-10 999-100 ' || lpad(c_custkey::VARCHAR, 6, '7'),
    '1' || lpad(c_custkey::VARCHAR, 9, '5') || lpad(c_custkey::VARCHAR, 6, '4')]) AS phone FROM customer)
SELECT phone, length(regexp_replace(phone, '[^0-9]', '', 'g')) AS digits,
  {_is_range_list('phone')} AS is_range_list, {_good_phone('phone')} AS is_valid FROM p"""

# --- item noise --------------------------------------------------------------------------------


def _boilerplate(company: str) -> str:
    return (
        f"(low IN {_in(K.BOILERPLATE_HEADINGS)} OR {_any('starts_with', 'low', K.GENERIC_HEADING_PREFIXES)}"
        f" OR {_any('contains', 'low', K.ID_LABEL_KEYWORDS)} OR low = lower({company}))"
    )


def _lead(k: int) -> str:
    return (
        f"(len(w) >= {2 * k} AND contains(array_to_string(w[{k + 1}:], ' '),"
        f" array_to_string(w[1:{k}], ' ')))"
    )


def _noise(company: str) -> dict[str, str]:
    general = [s for s in K.ENTITY_NAME_SUFFIXES if s not in ("industries", "industry")]
    return {
        "cta": _any("contains", "low", K.LISTING_NOISE_PHRASES),
        "date": r"(regexp_matches(low, '^(established\s*(in)?\s*)?[0-9]{4}$')"
        r" OR regexp_matches(low, '^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}$')"
        r" OR regexp_matches(low, '^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+[0-9]{4}$'))",
        "location": r"regexp_matches(t, '^[A-Z][a-zA-Z.]+(\s[A-Z][a-zA-Z.]+)?,\s*[A-Z][a-zA-Z]+$')",
        "rating": r"regexp_matches(low, '^[0-9](\.[0-9])?\s*(/|out of)\s*5([^0-9\pL_]|$)')",
        "sentence": "(len(w) > 9 OR (right(t, 1) IN ('.', '!', '?') AND len(w) > 5))",
        "metric": r"regexp_matches(low, '^[0-9][0-9,.]*\s*(%|k\+|m\+|x([^0-9\pL_]|$))')",
        "duplicated": "(len(w) >= 2 AND len(w) % 2 = 0 AND w[1:len(w) // 2] = w[len(w) // 2 + 1:])",
        "repeated_lead": f"(len(w) >= 4 AND ({_lead(2)} OR {_lead(3)} OR {_lead(4)}))",
        "numeric": r"regexp_matches(t, '^[0-9,.\s]+$')",
        "required_field": "right(t, 1) = '*'",
        "action": f"(len(w) >= 2 AND trim(w[1], ',.:;') IN {_in(K.ACTION_LEAD_WORDS)})",
        "boilerplate": _boilerplate(company),
        "entity": f"({_any('ends_with', 'low', general)} OR (coalesce(bucket, '') <> 'industries'"
        " AND (ends_with(low, 'industries') OR ends_with(low, 'industry')))"
        " OR (upper(t) = t AND low <> t AND len(w) >= 3))",
    }


def _viewed(source: str) -> str:
    return (
        "SELECT *, lower(t) AS low, list_filter(string_split(lower(t), ' '), lambda x: x <> '') AS w"
        f" FROM ({source}) WHERE t IS NOT NULL"
    )


_CANDIDATES = f"""
SELECT {_clean('text')} AS t, bucket FROM (
  SELECT unnest(string_split(text, chr(10))) AS text, lang AS bucket FROM documents
  UNION ALL SELECT unnest([strftime(o_orderdate, '%d/%m/%Y'), strftime(o_orderdate, '%b %Y'),
    strftime(o_orderdate, '%Y'), 'Established ' || strftime(o_orderdate, '%Y'),
    CAST(trunc(o_totalprice) AS BIGINT) || '.5', o_orderkey || '% less ' || lower(o_orderstatus),
    'Order ' || o_orderkey || ' *']), 'products' FROM orders
  UNION ALL SELECT unnest([{_initcap('c_mktsegment')} || ', Nation', (c_nationkey % 10) || '.5 out of 5 stars',
    c_name || ' ' || c_name, c_mktsegment || ' & Sons', {_initcap('c_mktsegment')} || ' Industry',
    c_mktsegment || ' WORKS ' || c_mktsegment,
    'Smart ' || c_mktsegment || ' this is smart ' || lower(c_mktsegment) || ' text', 'Boost: ' || c_name,
    'Located in ' || c_name, 'Kingston ' || c_custkey, c_name || ' gst ' || c_custkey,
    'Contact us ' || c_custkey, {_initcap('c_mktsegment')}]),
    CASE WHEN c_nationkey < 12 THEN 'industries' ELSE 'solutions' END FROM customer
  UNION ALL SELECT s_name, NULL FROM supplier)"""
_RULES = _noise("'Automobile'")
_UNPIVOT = " UNION ALL ".join(
    f"SELECT '{name}' AS rule, CAST(coalesce(sum(CASE WHEN {name} THEN 1 ELSE 0 END), 0) AS BIGINT) AS n FROM f"
    for name in ["any_rule", *_RULES]
)
ORACLES["noise_audit"] = f"""
WITH f AS MATERIALIZED (
  SELECT {', '.join(f'{rule} AS {name}' for name, rule in _RULES.items())},
    {' OR '.join(_RULES.values())} AS any_rule FROM ({_viewed(_CANDIDATES)}))
SELECT 'candidates' AS rule, count(*) AS n FROM f UNION ALL {_UNPIVOT}"""


def _line_items(keep: str, low_len: int, high_len: int) -> str:
    lines = (
        f"SELECT doc_id, i, {_clean('line')} AS t, 'products' AS bucket FROM"
        " (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM"
        " (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"
    )
    return f"""
WITH v AS ({_viewed(lines)}),
good AS (SELECT * FROM v WHERE length(t) BETWEEN {low_len} AND {high_len} AND {keep}),
firsts AS (SELECT doc_id, min(i) AS i, arg_min(t, i) AS t FROM good GROUP BY doc_id, low),
items AS (SELECT doc_id, count(*) AS n, string_agg(t, '|' ORDER BY i) AS items
          FROM firsts GROUP BY 1)
SELECT documents.doc_id AS page_id, coalesce(n, 0) AS n_items, coalesce(items, '') AS items
FROM documents LEFT JOIN items ON documents.doc_id = items.doc_id"""


ORACLES["heading_items"] = _line_items(f"NOT {_boilerplate("'Images'")}", 2, 80)
ORACLES["card_items"] = _line_items(f"NOT ({' OR '.join(_noise("'Images'").values())})", 2, 100)

# --- supplier sites --------------------------------------------------------------------------------

SUPPLIERS = """
sup AS (
  SELECT s_suppkey AS k, s_name, n_name, r_name, n_regionkey AS r, s_nationkey, s_acctbal,
    'https://www.supplier-' || lpad(s_suppkey::VARCHAR, 9, '0') || '.test/' AS site,
    CASE n_regionkey WHEN 0 THEN s_name || ' Ltd' WHEN 1 THEN s_name || ' App' WHEN 2 THEN s_name || ' Group'
      WHEN 3 THEN s_name || ' works' ELSE s_name || ' of ' || n_name END AS home_name,
    CASE n_regionkey WHEN 3 THEN 'Welcome.' WHEN 4 THEN 'Home | ' || s_name || ' of ' || n_name || ' : Docs'
      ELSE 'Start | Home' END AS home_title,
    s_name || ' is based in ' || n_name || ', ' || r_name || '.' AS about,
    s_name || ', Plot ' || s_suppkey || ', ' || n_name || ', ' || r_name AS plot,
    'Branch hall ' || s_suppkey || ', Dock Road, ' || n_name AS hall,
    'Yard ' || s_suppkey || ', Quay Road, ' || n_name AS yard,
    'Branch Office: ' || s_suppkey || ' Side Street, ' || n_name AS branch,
    CASE WHEN s_acctbal >= 5000 THEN 'Registered Office: ' || s_suppkey || ' Main Street, ' || n_name END AS label,
    'sales' || s_suppkey || '@supplier-' || s_suppkey || '.test' AS sales,
    'support' || s_suppkey || '@supplier-' || s_suppkey || '.test' AS support,
    '+1 (' || (200 + s_nationkey) || ') 555-' || lpad((s_suppkey % 10000)::VARCHAR, 4, '0') AS landline,
    '+91-' || lpad(s_suppkey::VARCHAR, 10, '9') AS mobile, right(s_name, 9) AS name_digits
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""
PARTS = f"""
makers AS (SELECT l_partkey, min(l_suppkey) AS k FROM lineitem GROUP BY 1),
parts AS (
  SELECT p_partkey, p_name, p_brand, p_type, p_size, k, site, site || 'products/p' || p_partkey AS url,
    {_initcap('p_type')} || ' range' AS i1, {_initcap('p_name')} || ' ' || p_size AS i2,
    p_type || ' Kit' AS i3, {_initcap('p_name')} || ' spares' AS i4
  FROM part JOIN makers ON p_partkey = l_partkey JOIN sup USING (k)),
inds AS (
  SELECT site, p_type, min(p_partkey) AS p_partkey,
    site || 'solutions/industry/' || lower(p_type) || '-goods' AS url,
    {_initcap('p_type')} || ' Goods' AS i1, {_initcap('p_type')} || ' Handling' AS i2,
    {_initcap('p_type')} || ' Automotive Industry' AS i3 FROM parts GROUP BY site, p_type)
"""
MEMBERS = """
hosts AS (SELECT s_nationkey AS n, min(s_suppkey) AS k FROM supplier GROUP BY 1),
members AS (
  SELECT c_custkey, c_name, n_name, site, site || 'business/member-' || c_custkey || '-' || lower(c_mktsegment) AS url
  FROM customer JOIN hosts ON c_nationkey = hosts.n JOIN sup USING (k))
"""
ALL = f"WITH {SUPPLIERS}, {PARTS}, {MEMBERS}"

ORACLES["supplier_fields"] = f"""{ALL}
SELECT site AS url, 'home' AS page_type, false AS is_third_party, home_title AS title,
  home_name AS company_name_guess, CAST(NULL AS VARCHAR) AS meta_description FROM sup
UNION ALL SELECT site || 'about-us', 'about', false, 'About | ' || s_name, s_name, about FROM sup
UNION ALL SELECT site || 'contact', 'contact', false, 'Contact | ' || s_name, s_name, NULL FROM sup
UNION ALL SELECT url, 'products', false, p_name || ' | ' || p_brand,
  CASE WHEN length(p_brand) > length(p_name) THEN p_brand ELSE p_name END, NULL FROM parts
UNION ALL SELECT url, 'industries', false, p_type, p_type, NULL FROM inds
UNION ALL SELECT url, 'third_party_listing', true, c_name || ' Pvt Ltd', c_name || ' Pvt Ltd', NULL FROM members"""
ORACLES["supplier_contacts"] = f"""{ALL}
SELECT site AS url, sales AS emails, name_digits AS phones FROM sup
UNION ALL SELECT site || 'about-us', '', name_digits FROM sup
UNION ALL SELECT site || 'contact', support, landline || '|' || mobile || '|' || name_digits FROM sup
UNION ALL SELECT url, 'maintainer' || p_partkey || '@parts.test', '' FROM parts
UNION ALL SELECT url, '', '' FROM inds
UNION ALL SELECT url, 'contact@member-' || c_custkey || '.test', right(c_name, 9) FROM members"""
ORACLES["supplier_social"] = f"""WITH {SUPPLIERS}
SELECT site AS url, 'linkedin' AS platform, 'https://www.linkedin.com/company/supplier-' || k AS href FROM sup
UNION ALL SELECT site, 'twitter', 'https://x.com/supplier' || k FROM sup"""
ORACLES["supplier_addresses"] = f"""{ALL}
SELECT site AS url, '' AS address_candidates, '' AS headquarters_candidates, '' AS other_location_candidates FROM sup
UNION ALL SELECT site || 'about-us', plot || '|' || hall, '', '' FROM sup
UNION ALL SELECT site || 'contact', yard, coalesce(label, ''), branch FROM sup
UNION ALL SELECT url, '', '', '' FROM parts
UNION ALL SELECT url, '', '', '' FROM inds
UNION ALL SELECT url, c_name || ', Elsewhere Road, ' || n_name, '', '' FROM members"""
ORACLES["supplier_items"] = f"""{ALL}
SELECT unnest([site, site || 'about-us', site || 'contact']) AS url, '' AS heading_list_items FROM sup
UNION ALL SELECT url, i1 || '|' || i2 || '|' || i3 || '|' || i4 FROM parts
UNION ALL SELECT url, i1 || '|' || i2 || '|' || i3 FROM inds
UNION ALL SELECT url, '' FROM members"""
ORACLES["supplier_links"] = f"""{ALL},
home AS (SELECT site, CASE WHEN r = 2 THEN 1 ELSE 0 END AS o, r FROM sup)
SELECT site AS url, CAST(o AS BIGINT) AS ord, site || 'about-us' AS canonical_url, 'Aboutus' AS anchor,
  'about' AS category, CAST(0 AS BIGINT) AS priority, true AS in_chrome FROM home
UNION ALL SELECT site, o + 1, site || 'contact', 'Contact', 'contact', 0, true FROM home
UNION ALL SELECT site, o + 4, site || '?page=2', 'More', 'home', 0, true FROM home
UNION ALL SELECT site, o + 8, site || 'blog', 'own', 'blog_news', 1, true FROM home
UNION ALL SELECT site, 0, site, '', 'home', 0, true FROM home WHERE r = 2
UNION ALL SELECT url, 0, site || 'categories', 'All categories', 'other', 1, true FROM parts
UNION ALL SELECT url, 1, site || 'products?category=' || p_type, i1, 'products', 0, false FROM parts
UNION ALL SELECT url, 2, site || 'quote', 'Ask for Quote', 'other', 1, false FROM parts
UNION ALL SELECT url, 3, site || 'kits/' || p_partkey, i3, 'other', 1, false FROM parts
UNION ALL SELECT url, 4, site || 'kits', 'Know More', 'other', 1, false FROM parts
UNION ALL SELECT url, 5, site || 'x', 'View Profile', 'about', 0, false FROM parts"""

PRODUCTS = """
prod AS (
  SELECT site, p_partkey, unnest([i1, i2, i3, i4]) AS item, unnest([1, 2, 3, 4]) AS pos FROM parts),
prod1 AS (
  SELECT site, min(p_partkey * 10 + pos) AS o, arg_min(item, p_partkey * 10 + pos) AS item
  FROM prod GROUP BY site, lower(item)),
prod2 AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY o) AS n FROM prod1),
facts AS (
  SELECT site AS website,
    unnest(['company_name', 'description', 'headquarters', 'other_locations', 'other_locations',
      'other_locations', 'emails', 'emails', 'phones', 'phones', 'phones', 'social_linkedin', 'social_twitter'])
      AS field, unnest([1, 1, 1, 1, 2, 3, 1, 2, 1, 2, 3, 1, 1]) AS place,
    unnest([home_name, about, coalesce(label, plot), hall, yard, branch, sales, support, landline, mobile,
      name_digits, 'https://www.linkedin.com/company/supplier-' || k, 'https://x.com/supplier' || k]) AS value
  FROM sup
  UNION ALL SELECT site, 'products', n, item FROM prod2
  UNION ALL SELECT site, 'industries', row_number() OVER (PARTITION BY site ORDER BY p_partkey, pos), item FROM
    (SELECT site, p_partkey, unnest([i1, i2, i3]) AS item, unnest([1, 2, 3]) AS pos FROM inds))
"""
ORACLES["company_profiles"] = f"{ALL}, {PRODUCTS} SELECT website, field, CAST(place AS BIGINT) AS place, value FROM facts"
ORACLES["feed_profiles"] = ORACLES["company_profiles"]

ORACLES["rendered_pages"] = """
SELECT 'https://spa-' || c_custkey || '.test/' AS url,
  CASE WHEN shell AND live THEN 'dynamic' ELSE 'static' END AS rendered_with,
  CASE WHEN shell THEN 'Loading' ELSE c_name END AS title,
  CASE WHEN shell AND live THEN c_name || ' app' WHEN shell THEN 'Loading' ELSE c_name END AS company_name_guess,
  shell AND NOT live AS is_thin_content,
  CASE WHEN shell AND NOT live THEN 'partial_static_only' ELSE 'success' END AS extraction_result
FROM (SELECT *, c_nationkey < 15 AS shell, c_acctbal > 2000 AND c_mktsegment <> 'BUILDING' AS live FROM customer)"""

# --- frontier -------------------------------------------------------------------------------------------

SHOPS = """
ord AS (
  SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, 'https://shop-' || o_custkey || '.test/' AS site,
    'https://shop-' || o_custkey || '.test/' || CASE o_orderstatus WHEN 'F' THEN 'news' WHEN 'O' THEN 'projects'
      ELSE 'account' END || '/order-' || o_orderkey AS url,
    CASE o_orderstatus WHEN 'O' THEN 0 ELSE 1 END AS priority,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS o FROM orders),
open AS (SELECT * FROM ord WHERE o_orderstatus <> 'P'),
shop AS (SELECT 'https://shop-' || c_custkey || '.test/' AS site FROM customer),
bought AS (
  SELECT site, url, o_orderkey, l_partkey, l_suppkey,
    site || 'products/part-' || l_partkey || '?supplier=' || l_suppkey AS product,
    min(l_linenumber) AS ln
  FROM lineitem JOIN ord ON l_orderkey = o_orderkey GROUP BY ALL)
"""
ORACLES["frontier_round"] = f"""WITH {SHOPS}
SELECT site, site AS url, CAST(0 AS BIGINT) AS priority, CAST(0 AS BIGINT) AS depth, CAST(0 AS BIGINT) AS variant_rank,
  CAST(0 AS BIGINT) AS ord, CAST(NULL AS VARCHAR) AS discovered_from FROM shop
UNION ALL SELECT site, url, priority, 1, 0, o, site FROM open"""
ORACLES["next_urls"] = f"""WITH {SHOPS}
SELECT site, url, place FROM
  (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY priority, o) AS place FROM open) WHERE place <= 3"""
ORACLES["queue_places"] = f"""WITH {SHOPS}
SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY priority, o) AS place,
  row_number() OVER (PARTITION BY site ORDER BY priority, o) AS seq FROM open"""
ORACLES["visit_replay"] = f"""WITH {SHOPS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY priority, o) AS n FROM open),
one AS (SELECT * FROM ranked WHERE n = 1),
first_product AS (
  SELECT b.site, b.url AS source, arg_min(product, (ln, l_partkey, l_suppkey)) AS url
  FROM bought b JOIN one ON b.url = one.url AND one.o_totalprice <= 400000 GROUP BY 1, 2),
two AS (
  SELECT site, url, 1 AS depth, priority, site AS discovered_from, o_totalprice <= 400000 AS fetched_ok
  FROM ranked WHERE n = 2
  UNION ALL SELECT site, url, 2, 0, source, true FROM first_product),
third AS (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY priority, depth) AS pick FROM two)
SELECT site, site AS url, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS depth,
  CAST(NULL AS VARCHAR) AS discovered_from, true AS fetched_ok FROM shop
UNION ALL SELECT site, url, 1, 1, site, o_totalprice <= 400000 FROM one
UNION ALL SELECT site, url, 2, depth, discovered_from, fetched_ok FROM third WHERE pick = 1"""
ORACLES["visit_stops"] = f"""WITH {SHOPS},
n AS (SELECT shop.site, 1 + count(open.url) AS seen FROM shop LEFT JOIN open ON shop.site = open.site GROUP BY 1)
SELECT site, least(seen, 10) AS tried,
  CASE WHEN seen > 10 THEN 'max_pages_reached' ELSE 'queue_exhausted' END AS stop_reason FROM n"""
ORACLES["site_reach"] = f"""WITH {SHOPS},
reached AS (
  SELECT site, 0 AS hops, site AS url FROM shop
  UNION SELECT site, 1, url FROM open
  UNION SELECT b.site, 2, product FROM bought b JOIN open USING (url)
  UNION SELECT b.site, 3, b.site || 'help/part-' || l_partkey FROM bought b JOIN open USING (url))
SELECT site, CAST(hops AS BIGINT) AS hops, count(*) AS n_urls FROM reached GROUP BY 1, 2"""
ORACLES["discovery_tree"] = f"""WITH {SHOPS},
edges AS (
  SELECT site, url, 1 AS depth, site AS source FROM ord
  UNION ALL SELECT site, product, 2, url FROM bought
  UNION ALL SELECT site, site || 'help/part-' || l_partkey, 3, product FROM bought),
tree AS (
  SELECT site, url, min(depth) AS depth, min(source) AS source FROM edges
  WHERE url NOT LIKE '%/account/%' GROUP BY 1, 2
  UNION ALL SELECT site, site, 0, NULL FROM shop),
kids AS (SELECT source AS url, count(*) AS c FROM tree WHERE source IS NOT NULL GROUP BY 1)
SELECT t.site, CAST(t.depth AS BIGINT) AS depth, count(*) AS pages, count(c) AS leading_on,
  max(coalesce(c, 0)) AS most_children,
  count(CASE WHEN t.source IS NOT NULL AND p.url IS NULL THEN 1 END) AS orphans
FROM tree t LEFT JOIN kids ON t.url = kids.url LEFT JOIN tree p ON p.url = t.source GROUP BY 1, 2"""

# --- fetch log ----------------------------------------------------------------------------------------------

ATTEMPTS = """
att AS (
  SELECT l_orderkey AS k, o_custkey, l_linenumber AS attempt, max(l_returnflag) AS flag, max(l_linestatus) AS ls,
    max(CAST(round(l_tax * 100) AS INT)) AS tax, max(CAST(l_quantity AS INT)) AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
judged AS (
  SELECT *, 'https://shop-' || o_custkey || '.test/orders/' || k AS url,
    CASE WHEN flag = 'N' THEN CASE ls WHEN 'F' THEN 503 ELSE 500 END
         WHEN flag = 'A' THEN CASE WHEN ls = 'F' AND tax > 5 THEN 404 ELSE 200 END END AS status,
    CASE WHEN flag = 'R' THEN CASE WHEN ls = 'F' THEN 'ReadTimeout' WHEN tax <= 4 THEN 'ConnectionError'
         ELSE 'InvalidURL' END END AS exc
  FROM att),
ended AS (
  SELECT *, CASE WHEN exc IS NOT NULL THEN exc || ': line ' || attempt
      WHEN tax = 8 THEN 'non_html_content_type:application/pdf' WHEN tax = 7 THEN 'non_html_content_type:unknown'
      WHEN status <> 200 THEN 'http_' || status END AS error,
    CASE WHEN exc IS NOT NULL THEN exc = 'InvalidURL' ELSE tax >= 7 OR status < 500 END AS terminal FROM judged),
picked AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY NOT terminal,
    CASE WHEN terminal THEN attempt ELSE -attempt END) AS n FROM ended),
final AS (
  SELECT url, k, o_custkey, CAST(attempt AS BIGINT) AS attempts, error IS NULL AS ok, CAST(status AS BIGINT) AS status,
    error, CASE WHEN exc IS NULL AND q BETWEEN 40 AND 45 THEN url || '/moved' ELSE url END AS final_url,
    CASE WHEN error IS NULL THEN 'order ' || k END AS html FROM picked WHERE n = 1)
"""


def _robots(k: str) -> str:
    return (
        f"CASE c_mktsegment WHEN 'BUILDING' THEN NOT starts_with({k}::VARCHAR, '1')"
        f" WHEN 'AUTOMOBILE' THEN starts_with({k}::VARCHAR, '2')"
        f" OR NOT starts_with({k}::VARCHAR, (c_nationkey % 10)::VARCHAR)"
        f" WHEN 'FURNITURE' THEN NOT starts_with({k}::VARCHAR, '3') ELSE true END"
    )


ORACLES["retry_final"] = (
    f"WITH {ATTEMPTS} SELECT url, attempts, ok, status, error, final_url, html FROM final"
)
ORACLES["fetch_outcomes"] = f"""WITH {ATTEMPTS},
r AS (SELECT final.*, {_robots('k')} AS allowed FROM final JOIN customer ON o_custkey = c_custkey)
SELECT ok AND allowed AS ok, CASE WHEN allowed THEN error ELSE 'blocked_by_robots_txt' END AS error,
  CASE WHEN allowed THEN status END AS status, count(*) AS n,
  CAST(sum(CASE WHEN allowed THEN attempts ELSE 0 END) AS BIGINT) AS attempts
FROM r GROUP BY 1, 2, 3"""
ORACLES["robots_decisions"] = f"""
SELECT 'https://shop-' || o_custkey || '.test/orders/' || o_orderkey AS url, {_robots('o_orderkey')} AS allowed
FROM orders JOIN customer ON o_custkey = c_custkey"""
ORACLES["politeness"] = """
WITH r AS (
  SELECT event_id, user_id, epoch_us(ts) // 1000 AS ready,
    row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) * 43200000 AS step FROM events)
SELECT event_id, 'user-' || user_id || '.test' AS netloc,
  max(ready - step) OVER (PARTITION BY user_id ORDER BY ready, event_id) + step AS start_ms FROM r"""

# --- reports and stores -----------------------------------------------------------------------------------------

AUDIT = f"""{ALL},
texts AS (
  SELECT *, home_title || ' About us Contact Login Brochure More ' || s_name || ' works Supplying ' || n_name
    || ' since 1998 & counting. in x t own ' || sales || ', you@company.com, icon' || k || '@2x.png' AS home_text,
    'About | ' || s_name || ' About ' || s_name || ' ' || plot || ' ' || hall || ' Depot office ' || k || ', '
    || r_name AS about_text,
    'Contact | ' || s_name || ' Contact Us ' || coalesce(label || ' ', '') || branch || ' ' || yard || ' Call '
    || landline || ' now ' || support AS contact_text FROM sup),
audit AS (
  SELECT site, CAST(0 AS BIGINT) AS seq, site AS url, 'home' AS page_type, CAST(NULL AS VARCHAR) AS final_url,
    home_title AS title, CAST(200 AS BIGINT) AS http_status, true AS fetched_ok,
    CASE WHEN length(home_text) < 200 THEN 'partial_static_only' ELSE 'success' END AS extraction_result,
    CAST(NULL AS VARCHAR) AS error, CAST(0 AS BIGINT) AS depth, CAST(NULL AS VARCHAR) AS discovered_from,
    false AS is_third_party FROM texts
  UNION ALL SELECT site, 1, site || 'about-us', 'about', NULL, 'About | ' || s_name, 200, true,
    CASE WHEN length(about_text) < 200 THEN 'partial_static_only' ELSE 'success' END, NULL, 1, site, false FROM texts
  UNION ALL SELECT site, 2, site || 'contact', 'contact', site || 'contact/', 'Contact | ' || s_name, 200, true,
    CASE WHEN length(contact_text) < 200 THEN 'partial_static_only' ELSE 'success' END, NULL, 1, site, false FROM texts
  UNION ALL SELECT site, 1099511627776, site || 'news/gone', 'blog_news', NULL, NULL, 404, false, 'failed',
    'http_404', 1, site, false FROM texts
  UNION ALL SELECT site, 1000000000000 + p_partkey, url, 'products', NULL, p_name || ' | ' || p_brand, 200, true,
    CASE WHEN length(p_name || ' | ' || p_brand || ' All categories ' || p_name || ' ' || i1 || ' ' || i2 || ' MOQ: '
      || p_size || ' units Ask for Quote Fits all ' || i3 || ' Know More ACME ' || upper(p_name)
      || ' TRADING CO View Profile ' || i4 || ' First name * maintainer' || p_partkey || '@parts.test') < 200
      THEN 'partial_static_only' ELSE 'success' END, NULL, 2, site, false FROM parts
  UNION ALL SELECT site, 100 + p_partkey, url, 'industries', NULL, p_type, 200, true,
    CASE WHEN length(p_type || ' ' || p_type || ' goods ' || i2 || ' ' || i3 || ' Reduce ' || p_type || ' waste') < 200
      THEN 'partial_static_only' ELSE 'success' END, NULL, 2, site, false FROM inds
  UNION ALL SELECT site, 2000000000000 + c_custkey, url, 'third_party_listing', NULL, c_name || ' Pvt Ltd', 200, true,
    CASE WHEN length(c_name || ' Pvt Ltd ' || c_name || ' ' || c_name || ', Elsewhere Road, ' || n_name
      || ' contact@member-' || c_custkey || '.test') < 200
      THEN 'partial_static_only' ELSE 'success' END, NULL, 2, site, true FROM members)
"""
ORACLES["page_audit"] = f"""{AUDIT}
SELECT *, 'static' AS rendered_with FROM audit"""
ORACLES["status_rollup"] = f"""{AUDIT}
SELECT site, page_type, count(*) AS pages, round(avg(CASE WHEN fetched_ok THEN 0 ELSE 1 END), 6) AS failed_rate,
  round(avg(CASE WHEN is_third_party THEN 1 ELSE 0 END), 6) AS third_party_rate, CAST(0 AS DOUBLE) AS dynamic_rate
FROM audit GROUP BY ROLLUP (site, page_type)"""
ORACLES["report_files"] = f"""{AUDIT}
SELECT site AS input_url, pages_discovered, pages_discovered - 1 AS pages_fetched_ok,
  CAST(1 AS BIGINT) AS pages_failed, CAST(NULL AS BIGINT) AS max_pages_limit, 'queue_exhausted' AS stop_reason,
  home_name AS company_name, coalesce(label, plot) AS headquarters, sales || '|' || support AS emails,
  'https://x.com/supplier' || k AS twitter, results, errors
FROM texts JOIN (SELECT site, count(*) AS pages_discovered, string_agg(extraction_result, '|' ORDER BY seq) AS results,
    string_agg(coalesce(error, '-'), '|' ORDER BY seq) AS errors FROM audit GROUP BY 1)
  USING (site)"""
ORACLES["site_reports"] = f"""WITH {SUPPLIERS}
SELECT unnest([upper(site), site]) AS input_url, site, CAST(4 AS BIGINT) AS pages_discovered, CAST(3 AS BIGINT) AS pages_fetched_ok,
  CAST(1 AS BIGINT) AS pages_failed, CAST(4 AS BIGINT) AS max_pages_limit, 'max_pages_reached' AS stop_reason,
  home_name AS company_name, coalesce(label, plot) AS headquarters,
  landline || '|' || mobile || '|' || name_digits AS phones, 'home|about|contact|home' AS page_types,
  '-|-|-|unknown_error' AS errors FROM sup"""
ORACLES["stored_tables"] = f"""{AUDIT}
SELECT site AS website, home_name AS company_name, '["' || sales || '","' || support || '"]' AS emails, url, page_type,
  http_status, fetched_ok, extraction_result, error FROM audit JOIN texts USING (site)"""
ORACLES["companies_upsert"] = """
SELECT 'https://s' || s_suppkey || '.test/' AS website, s_name AS company_name,
  s_name || CASE WHEN s_acctbal > 3000 THEN ' new' ELSE ' old' END AS description,
  '["é","Nation ' || s_nationkey || '"]' AS other_locations,
  CASE WHEN s_acctbal > 3000 THEN '2024-02-01T00:00:00+00:00' ELSE '2024-01-01T00:00:00+00:00' END AS seen_at
FROM supplier"""
ORACLES["pages_replace"] = """
SELECT 'https://shop-' || o_custkey || '.test/' AS website,
  'https://shop-' || o_custkey || '.test/orders/' || o_orderkey AS url,
  CASE WHEN o_orderstatus = 'F' THEN 'other' ELSE 'products' END AS page_type, o_orderkey AS http_status,
  CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS BIGINT) AS seen_at FROM orders"""

# --- streams ------------------------------------------------------------------------------------------------------

ORACLES["feed_extract"] = f"""WITH {RAW_FIELDS}
SELECT page_id, title, page_type, company_name AS company_name_guess,
  CAST(coalesce(length(visible), 0) AS BIGINT) AS visible_chars, array_to_string({_emails('html')}, '|') AS emails
FROM raw_named"""
ORACLES["feed_first_sightings"] = """
SELECT DISTINCT 'http://u' || user_id || '.test/' || event_type AS canonical_url FROM events"""
_HEALTH = """
SELECT CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS window_start, count(*) AS fetches,
  round(avg(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END), 6) AS failed_rate,
  round(avg(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END), 6) AS dynamic_rate,
  round(avg(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END), 6) AS third_party_rate
FROM events GROUP BY 1"""
ORACLES["fetch_health"] = _HEALTH
ORACLES["feed_health"] = _HEALTH

# Along a customer's orders the path is known from the place in them.
ORACLES["discovery_paths"] = """
WITH o AS (SELECT o_custkey, 'https://shop-' || o_custkey || '.test/' AS site,
    'https://shop-' || o_custkey || '.test/orders/' || o_orderkey AS url,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r,
    count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
least AS (SELECT o_custkey, min(url) AS head, arg_min(r, url) AS at FROM o GROUP BY o_custkey)
SELECT site, url, CASE o_custkey % 3 WHEN 0 THEN site WHEN 1 THEN site || 'old' ELSE head END AS root,
  CASE WHEN o_custkey % 3 = 2 THEN (r - least.at + n) % n ELSE r END AS hops,
  o_custkey % 3 = 2 AS looped, o_custkey % 3 <> 1 AS known
FROM o JOIN least USING (o_custkey)
UNION ALL
SELECT 'https://shop-' || c_custkey || '.test/', 'https://shop-' || c_custkey || '.test/',
  'https://shop-' || c_custkey || '.test/', 0, false, true FROM customer
"""

ORACLES["redirect_chains"] = """
WITH RECURSIVE lines AS (SELECT l_orderkey AS o, l_linenumber AS n, max(l_returnflag) AS flag,
    max(round(l_tax * 100)::int) AS tax, max(l_quantity::int) AS q FROM lineitem GROUP BY ALL),
sizes AS (SELECT o, max(n) AS last, count(*) = max(n) AS whole FROM lines GROUP BY o),
own AS MATERIALIZED (
  SELECT o, n, 'https://shop-' || o_custkey || '.test/orders/' || o || '/' AS base, q,
    CASE WHEN n < last THEN n + 1 WHEN o_orderstatus = 'P' THEN 1 END AS next,
    whole AND o_orderstatus = 'P' AS loops,
    CASE WHEN n < last THEN 301 WHEN o_orderstatus = 'P' THEN 302 WHEN flag = 'R' THEN 404 ELSE 200 END AS status,
    CASE WHEN tax = 7 THEN 'application/pdf' ELSE 'text/html' END AS content_type,
    CASE WHEN tax = 8 AND NOT (tax = 7) THEN 2 ELSE 1 END AS attempts
  FROM lines JOIN sizes USING (o) JOIN orders ON o = o_orderkey),
walk AS (
  SELECT o, n, n AS place, []::VARCHAR[] AS path, 0 AS cost FROM own
  UNION ALL
  SELECT w.o, w.n, s.next, list_append(w.path, s.base || s.n), w.cost + s.q
  FROM walk w JOIN own s ON s.o = w.o AND s.n = w.place WHERE s.next IS NOT NULL AND NOT (s.loops AND s.n = 1)),
done AS (
  SELECT w.*, f.status, f.content_type, f.attempts, f.q, f.n IS NOT NULL AS reached, coalesce(f.loops, false) AS looped
  FROM walk w LEFT JOIN own f ON f.o = w.o AND f.n = w.place
  WHERE f.n IS NULL OR f.next IS NULL OR (f.loops AND f.n = 1))
SELECT s.base || d.n AS requested_url, s.base || d.place AS final_url, array_to_string(d.path, '|') AS redirect_chain,
  d.looped, d.status::BIGINT AS status, d.content_type,
  coalesce(d.status = 200 AND d.content_type = 'text/html' AND NOT d.looped, false) AS ok,
  CASE WHEN d.looped THEN 'redirect_loop' WHEN NOT d.reached THEN 'unknown_error'
    WHEN d.content_type <> 'text/html' THEN 'non_html_content_type:' || d.content_type
    WHEN d.status <> 200 THEN 'http_' || d.status END AS error,
  d.attempts::BIGINT AS attempts, (d.cost + CASE WHEN d.looped THEN 0 ELSE coalesce(d.q, 0) END)::BIGINT AS elapsed_ms
FROM done d JOIN own s ON s.o = d.o AND s.n = d.n
"""

ORACLES["report_shapes"] = """
WITH s AS (SELECT *, s_suppkey % 6 AS kind, 'https://s' || s_suppkey || '.test/' AS u FROM supplier)
SELECT CASE WHEN kind < 3 THEN u END AS input_url,
  CASE WHEN kind < 2 THEN s_nationkey::BIGINT WHEN kind = 2 THEN -1 END AS pages_discovered,
  CASE WHEN kind < 2 THEN 'queue_exhausted' END AS stop_reason,
  CASE WHEN kind < 2 THEN s_name END AS company_name,
  CASE kind WHEN 0 THEN 'a@s' || s_suppkey || '.test|b@s' || s_suppkey || '.test' WHEN 1 THEN 'a@s' || s_suppkey || '.test' END AS emails,
  CASE WHEN kind < 2 THEN 'https://x.com/s' || s_suppkey END AS twitter,
  CASE kind WHEN 0 THEN 1::BIGINT WHEN 2 THEN 2 END AS n_pages,
  CASE kind WHEN 0 THEN 200::BIGINT WHEN 2 THEN 404 END AS status,
  CASE kind WHEN 3 THEN left('{"input_url":"' || u || '","run_meta":{"pages_discovered":' || s_nationkey || ',"stop_reason":"queue_exhausted"}', 60)
    WHEN 4 THEN '[' || s_suppkey || ']' WHEN 5 THEN '{"input_url":null,"n":' || s_suppkey || '}' END AS record,
  CASE kind WHEN 3 THEN 'not_json' WHEN 4 THEN 'not_an_object' WHEN 5 THEN 'no_input_url' END AS reason
FROM s"""

ORACLES["daily_figures"] = """
WITH v AS (SELECT 'site-' || (user_id % 10) AS site, user_id || '/' || event_type AS url, event_type = 'error' AS bad FROM events),
w AS (SELECT * FROM v UNION ALL SELECT 'all', url, bad FROM v)
SELECT site, count(*) AS visits, round(avg(CASE WHEN bad THEN 1 ELSE 0 END), 6) AS failed_rate,
  count(DISTINCT url) AS n_urls, true AS urls_near, true AS times_near FROM w GROUP BY site"""

"""Fields that need no tree, read off the body by patterns: title, first heading, metas, texts, links.

Everything is a native expression over the ``html`` column. Comments, scripts and the like are taken out
first as a whole, each leaving a mark, so that what looks like a tag inside them is none. An
element ends at its end tag or at a start tag that closes it. Where end tags are missing or crossed, a tree
(``sources.html``) can give such an element a longer or shorter text; strings, attributes and their order
are the same. Loops in the patterns are possessive: they need no stack and never go back.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import text as T

_NAME_END = r"(?=[\s/>])"
_ATTRS = r"[^\"'>]*+(?:(?:\"[^\"]*+\"|'[^']*+'|[\"'])[^\"'>]*+)*+"
# All begin with the one character that decides most places.
_TAG = rf"<(?:/?[a-zA-Z]{_ATTRS}>|[!?/][^>]*+(?:>|\z))"
_COMMENT = r"!--.*?(?:-->|\z)"
#: What a part that was taken out leaves behind: it parts strings as a tag does.
_MARK = "<!>"


def _raw(tags: str) -> str:
    return rf"({tags}){_NAME_END}{_ATTRS}>.*?(?:</\1[^>]*+>|\z)"


def without_scripts(body: Column) -> Column:
    """The body without comments, scripts and styles."""
    return _cut(body, rf"(?is)<(?:{_COMMENT}|{_raw('script|style')})")


def without_hidden(body: Column) -> Column:
    """The body without comments, scripts, styles, noscript and template elements."""
    return _cut(body, rf"(?is)<(?:{_COMMENT}|{_raw('script|style|noscript|template')})")


def _cut(body: Column, pattern: str) -> Column:
    """No tag ends behind the last ``>``, so none is looked for there."""
    tail = F.substring_index(body, ">", -1)
    head = F.when(F.contains(body, F.lit(">")), F.substring(body, F.lit(1), F.length(body) - F.length(tail))).otherwise("")
    cut = F.regexp_replace(body, pattern, _MARK)

    def parted() -> Column:
        # A part that was never closed swallows the tail; else the tail is text.
        inside = F.regexp_replace(head, pattern, _MARK)
        swallowed = inside.endswith(_MARK) & ~head.rlike(r"(?is)(?:-->|</(?:script|style|noscript|template)[^>]*+>)\z")
        # What looks like a tag there is text, but for declarations without an end.
        text = F.replace(F.regexp_replace(tail, "(?s)<[!?/].*", ""), F.lit("<"), F.lit("&lt;"))
        return F.when(swallowed, inside).otherwise(F.concat(inside, text))

    return F.when(body.endswith(">"), cut).otherwise(parted())


# --- entities ------------------------------------------------------------------------------


def _characters(code: Column) -> Column:
    """The character of a code point, by the rules for numbers in markup."""
    # What the numbers 128 to 159 stand for.
    windows = bytes(range(128, 160)).decode("cp1252", "replace").replace("�", "\0")
    letter = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    named = F.nullif(F.substring(F.lit(windows), (code - 127).cast("int"), F.lit(1)), F.lit("\0"))
    control = (code < 9) | code.between(14, 31) | (code == 11) | (code == 127) | code.between(0xFDD0, 0xFDEF)
    return (
        F.when((code > 0x10FFFF) | code.between(0xD800, 0xDFFF) | (code == 0), "�")
        .when(code.between(128, 159), F.coalesce(named, letter))
        .when(control | ((code % 0x10000) >= 0xFFFE), "")
        .otherwise(letter)
    )


#: Names looked up before all others, as maps are searched from the front.
_COMMON = "amp; lt; gt; quot; apos; nbsp; copy; reg; middot; hellip; ndash; mdash; rsquo; lsquo; rdquo; ldquo;".split()


def _entities(names: list[str] | None = None) -> Column:
    table = html.entities.html5
    return F.from_json(F.lit(json.dumps({n: table[n] for n in names or table})), "map<string,string>")


#: Names that count without a semicolon.
_BARE_NAMES = [n for n in html.entities.html5 if not n.endswith(";")]



def unescaped(s: Column) -> Column:
    """Text with its character references replaced."""

    def decoded(piece: Column, i: Column) -> Column:
        number = F.regexp_extract(piece, r"^#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?", 1)
        decimal = F.regexp_extract(piece, r"^#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?", 2)
        whole = F.regexp_extract(piece, r"^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", 0)
        # Long numbers stand for no character.
        code = F.when(F.length(F.ltrim(F.lit("0"), F.concat(number, decimal))) > 9, F.lit(0x110000).cast("bigint")).otherwise(
            F.coalesce(F.conv(F.nullif(number, F.lit("")), 16, 10).cast("bigint"), F.nullif(decimal, F.lit("")).cast("bigint"))
        )
        name = F.regexp_extract(piece, "^[^\t\n\f <&#;]{1,32};?", 0)
        found = [
            F.when(F.length(name) > n, F.concat(F.element_at(_entities(_BARE_NAMES), F.substring(name, 1, n)), _rest(piece, F.lit(n))))
            for n in range(max(map(len, _BARE_NAMES)), 1, -1)
        ]
        whole_name = F.coalesce(F.element_at(_entities(_COMMON), name), F.element_at(_entities(), name))
        named = F.coalesce(F.concat(whole_name, _rest(piece, F.length(name))), *found)
        return (
            F.when(i == 0, piece)
            .when(whole != "", F.concat(_characters(code), _rest(piece, F.length(whole))))
            .otherwise(F.coalesce(named, F.concat(F.lit("&"), piece)))
        )

    return F.when(F.contains(s, F.lit("&")), F.array_join(F.transform(F.split(s, "&"), decoded), "")).otherwise(s)


def _rest(s: Column, n: Column) -> Column:
    return F.substr(s, n + 1)


# --- texts and attributes --------------------------------------------------------------------


def strings(part: Column) -> Column:
    """The strings of a part, without white space at their ends."""
    split = F.transform(F.split(part, _TAG), lambda s: T.strip_text(unescaped(s)))
    return F.filter(split, lambda s: s != "")


def spaced(part: Column) -> Column:
    """All strings of a part, cleaned, or null."""
    return T.clean_text(unescaped(F.regexp_replace(part, _TAG, " ")))


def glued(part: Column) -> Column:
    return F.array_join(strings(part), "")


def _element(body: Column, tag: str, closed_by: str, ends: str) -> Column:
    """What is inside the first element of a tag."""
    stop = rf"<(?:/(?:{tag}|{ends})|{closed_by}){_NAME_END}"
    return F.regexp_extract(body, rf"(?is)<{tag}{_NAME_END}{_ATTRS}>([^<]*+(?:(?!{stop})<[^<]*+)*+)", 1)


def title(body: Column) -> Column:
    return T.clean_text(glued(_element(body, "title", "body|frameset", "head|body|html")))


def h1(body: Column) -> Column:
    inside = _element(body, "h1", "fieldset|form|li|p|table", "td|th|tr|body|html")
    # The end tag of something around it ends it as well.
    return spaced(F.regexp_replace(inside, "(?is)^((?:(?!<div[ >]).)*?)</div.*", "$1"))


def visible_text(body: Column) -> Column:
    return spaced(body)


def attribute(tag: Column, name: str) -> Column:
    """Value of the first attribute of a name in a start tag; null without it."""
    other = rf"(?!{name}(?=[\s=/>]))[^\s\"'>/=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"']++))?+"
    before = rf"(?is)^<[a-z][^\s/>]*+(?:[\s/\"'=]*+{other})*+[\s/\"'=]*+{name}"
    values = [F.regexp_extract(tag, rf"{before}\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", g) for g in (1, 2, 3)]
    return F.when(tag.rlike(rf"{before}(?=[\s=/>])"), unescaped(F.concat(*values)))


def _closed(tag: Column) -> Column:
    """Whether a start tag ends its element at once; the slash may also be the end of a bare value."""
    return tag.endswith("/>") & ~tag.rlike(r"=\s*[^\s\"'>]*/>$")


def _tags(body: Column, names: str) -> Column:
    return F.regexp_extract_all(body, F.lit(rf"(?is)</?(?:{names}){_NAME_END}{_ATTRS}>"), F.lit(0))


def meta(body: Column, key: str, value: str) -> Column:
    """Content of the first meta element with that value; null when absent or empty."""
    told = F.transform(
        _tags(body, "meta"), lambda m: F.struct(attribute(m, key).alias("key"), attribute(m, "content").alias("content"))
    )
    return F.nullif(F.get(F.filter(told, lambda m: m["key"] == value), F.lit(0))["content"], F.lit(""))


def logo_name(body: Column) -> Column:
    """Alternative text of the first logo image; nothing if it only says 'logo'.

    An image is a logo if it says so, stands in the link of the site's brand, or has a text and stands in a header."""
    marks = F.transform(
        _tags(body, "img|header|a"),
        lambda m, i: F.struct(
            i.alias("i"),
            F.lower(F.regexp_extract(m, r"^</?([a-zA-Z]+)", 1)).alias("tag"),
            m.startswith("</").alias("ends"),
            _closed(m).alias("closed"),
            attribute(m, "alt").alias("alt"),
            F.split(T.strip_text(F.coalesce(attribute(m, "class"), F.lit(""))), T.WHITESPACE).alias("classes"),
        ),
    )

    def first(marks: Column) -> Column:
        def within(i: Column, opens: Column, closes) -> Column:
            # Nothing that closes it between its start and here.
            return F.exists(opens, lambda o: (o["i"] < i) & ~F.exists(
                marks, lambda c: (c["i"] > o["i"]) & (c["i"] < i) & closes(c)))

        images = F.filter(marks, lambda m: (m["tag"] == "img") & ~m["ends"])
        headers = F.filter(marks, lambda m: (m["tag"] == "header") & ~m["ends"] & ~m["closed"])
        brands = F.filter(marks, lambda m: (m["tag"] == "a") & ~m["ends"] & ~m["closed"] & F.array_contains(m["classes"], "navbar-brand"))
        logos = F.filter(
            images,
            lambda m: F.coalesce(F.contains(m["alt"], F.lit("logo")), F.lit(False))
            | F.array_contains(m["classes"], "logo")
            | within(m["i"], brands, lambda c: c["tag"] == "a")
            | (m["alt"].isNotNull() & within(m["i"], headers, lambda c: (c["tag"] == "header") & c["ends"])),
        )
        return T.clean_text(F.get(logos, F.lit(0))["alt"])

    alt = F.get(F.transform(F.array(marks), first), F.lit(0))
    return F.when(body.rlike(r"(?i)<img[\s/>]"), F.when(~F.contains(F.lower(alt), F.lit("logo")), alt))


def with_links(pages: DataFrame) -> DataFrame:
    """A row per ``a[href]`` of ``html``: its place ``ord``, ``href`` and ``anchor`` beside the other columns."""
    stop = rf"/a{_NAME_END}|(?:a|fieldset|table|td|th){_NAME_END}"
    inner = rf"[^<]*+(?:<(?!{stop})[^<]*+)*+"
    whole = F.lit(rf"(?is)<a{_NAME_END}{_ATTRS}>{inner}")
    found = F.regexp_extract_all(without_scripts(F.col("html")), whole, F.lit(0))

    def opened(link: Column) -> Column:
        return F.regexp_extract(link, rf"(?is)^<a{_ATTRS}>", 0)

    told = F.transform(found, lambda x: F.struct(attribute(opened(x), "href").alias("href"), x.alias("link")))
    kept = [c for c in pages.columns if c != "html"]
    rows = pages.select(*kept, F.posexplode(F.filter(told, lambda x: x["href"].isNotNull())).alias("ord", "x"))
    inside = F.regexp_replace("x.link", rf"(?is)^<a{_ATTRS}>", "")
    anchor = F.when(_closed(opened(F.col("x.link"))), "").otherwise(glued(inside))
    return rows.select(*kept, "ord", "x.href", anchor.alias("anchor"))

"""HTML pages to page outlines: one parse per page, inside the tasks that scan it.

This is the only place where data crosses into Python workers. A page comes back as one
row with two arrays, ``elems`` (elements in document order, each knowing its parent and
the end of its subtree) and ``texts`` (strings in document order). An element covers
``texts[t0:t1]``, so the text of any subtree is a slice, and no text is stored twice.
All extraction rules are native expressions over these arrays.

Recovery from broken markup follows the well-known rules of libxml2's HTML reader: start
tags close certain open elements, stray end tags are ignored by priority, text outside
any body is put into a paragraph, and the end of input closes what is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siteloom import constants as K
from siteloom.session import ship_package

CHROME_TAGS, CHROME_CLASS_HINTS, CHROME_ID_HINTS = (
    frozenset(K.CHROME_TAGS), K.CHROME_CLASS_HINTS, K.CHROME_ID_HINTS,
)

ELEMENT = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("parent", T.IntegerType(), False),
        T.StructField("last", T.IntegerType(), False),
        T.StructField("tag", T.StringType(), False),
        T.StructField("classes", T.ArrayType(T.StringType(), False), False),
        T.StructField("elem_id", T.StringType(), True),
        T.StructField("href", T.StringType(), True),
        T.StructField("name", T.StringType(), True),
        T.StructField("property", T.StringType(), True),
        T.StructField("content", T.StringType(), True),
        T.StructField("alt", T.StringType(), True),
        T.StructField("itemtype", T.StringType(), True),
        T.StructField("t0", T.IntegerType(), False),
        T.StructField("t1", T.IntegerType(), False),
        T.StructField("a0", T.IntegerType(), False),  # links outside chrome before it
        T.StructField("a1", T.IntegerType(), False),  # ... and up to its end
        T.StructField("heading", T.IntegerType(), True),  # first h1-h5 below it
        T.StructField("ink", T.IntegerType(), False),  # non-blank characters outside chrome
        T.StructField("twins", T.IntegerType(), False),  # siblings with tag and classes alike
        T.StructField("eldest", T.IntegerType(), False),  # ... the first of them
        T.StructField("in_script", T.BooleanType(), False),
        T.StructField("in_chrome", T.BooleanType(), False),
        T.StructField("in_list", T.BooleanType(), False),
    ]
)
TEXT = T.StructType(
    [
        T.StructField("parent", T.IntegerType(), False),
        T.StructField("s", T.StringType(), False),  # trimmed
        T.StructField("c", T.StringType(), True),  # with single spaces, if that differs
        T.StructField("kind", T.StringType(), False),  # text | comment | raw
        T.StructField("in_script", T.BooleanType(), False),
        T.StructField("in_chrome", T.BooleanType(), False),
    ]
)
OUTLINE_FIELDS = [
    T.StructField("elems", T.ArrayType(ELEMENT, False), False),
    T.StructField("texts", T.ArrayType(TEXT, False), False),
]

# --- fixed values of the recovery rules --------------------------------------------
VOID = frozenset(
    "area base basefont br col embed frame hr img input isindex link meta param".split()
)
HEAD_ONLY = frozenset("title meta link script style base noscript template".split())
# open element -> start tags that close it
CLOSED_BY = {
    tag: frozenset(closers.split())
    for tag, closers in {
        "a": "a fieldset table td th",
        "address": "dd dl dt form li ul",
        "b": "center p td th",
        "big": "p",
        "caption": "col colgroup tbody tfoot thead tr",
        "dd": "dt",
        "dl": "form li",
        "dt": "dd dl",
        "font": "center td th",
        "form": "form",
        "h1": "fieldset form li p table",
        "h2": "fieldset form li p table",
        "h3": "fieldset form li p table",
        "h4": "fieldset form li p table",
        "h5": "fieldset form li p table",
        "h6": "fieldset form li p table",
        "i": "center p td th",
        "li": "li",
        "ol": "form",
        "option": "optgroup option",
        "p": "address blockquote body caption center col colgroup dd dir div dl dt fieldset "
        "form frameset h1 h2 h3 h4 h5 h6 head hr li listing menu multicol ol p pre table "
        "tbody td tfoot th title tr ul xmp",
        "s": "p",
        "small": "p",
        "span": "td th",
        "strike": "p",
        "tbody": "tbody tfoot",
        "td": "tbody td tfoot th tr",
        "tfoot": "tbody",
        "th": "tbody td tfoot th tr",
        "thead": "tbody tfoot",
        "title": "body frameset",
        "tr": "tbody tfoot tr",
        "tt": "p",
        "u": "p td th",
        "ul": "address form menu ol pre",
    }.items()
}
END_PRIORITY = {
    "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180,
    "table": 190, "head": 200, "body": 200, "html": 220,
}
DEFAULT_END_PRIORITY = 100

SCRIPT_TAGS = frozenset(["script", "style", "noscript", "template"])
RAW_TEXT_TAGS = frozenset(["script", "style", "template", "rt", "rp"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5"])
NOT_CARDS = frozenset(["script", "style", "br", "hr"])


# Places in the row of an element, which is a list in the order of ELEMENT.
(
    _ID, _PARENT, _LAST, _TAG, _CLASSES, _ELEM_ID, _HREF, _NAME, _PROPERTY, _CONTENT, _ALT, _ITEMTYPE,
    _T0, _T1, _A0, _A1, _HEADING, _INK, _TWINS, _ELDEST, _IN_SCRIPT, _IN_CHROME, _IN_LIST,
) = range(len(ELEMENT))
_ATTRIBUTE_PLACES = {
    "id": _ELEM_ID, "href": _HREF, "name": _NAME, "property": _PROPERTY, "content": _CONTENT, "alt": _ALT,
    "itemtype": _ITEMTYPE, "class": _CLASSES,
}

# State inherited by everything below an open element: its row, its tag, and whether what is below is
# in a script, raw, in chrome, in a list.
_OUTSIDE = ([-1], None, False, False, False, False)


def _any_hint(hints: list[str]) -> re.Pattern:
    return re.compile("|".join(map(re.escape, hints)))


_CHROME_CLASS, _CHROME_ID = _any_hint(CHROME_CLASS_HINTS), _any_hint(CHROME_ID_HINTS)


def _is_chrome(tag: str, classes: list[str], elem_id: str | None) -> bool:
    return (
        tag in CHROME_TAGS
        or bool(classes and _CHROME_CLASS.search(" ".join(classes)))
        or bool(elem_id and _CHROME_ID.search(elem_id))
    )


# Comment, tag with its attributes, or declaration. A tag ends at the first > outside quotes.
_MARKUP = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^\"'>]+|\"[^\"]*\"|'[^']*'|[\"'])*+)>"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
# The same behind the last > of a page, where no tag can end; so none is looked for.
_TAIL = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|(?P<end>(?!))(?P<tag>)(?P<attrs>)|<[!?/][^>]*(?:>|\Z)", re.DOTALL
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SLASH_IN_VALUE = re.compile(r"=\s*[^\s\"'>]*/$")
_RAW_END = {tag: re.compile(f"</{tag}", re.IGNORECASE) for tag in ("script", "style")}


def _text(s: str) -> str:
    return unescape(s) if "&" in s else s


class _Outline:
    def __init__(self) -> None:
        self.elems: list[list] = []
        self.texts: list[tuple] = []
        self.stack: list[tuple] = []
        self.links = 0
        self.ink = 0
        self.seen: set[str] = set()
        self.families: dict[tuple, list[list]] = {}

    # -- tree ------------------------------------------------------------------
    def _pop(self) -> None:
        e = self.stack.pop()[0]
        e[_LAST], e[_T1], e[_A1] = len(self.elems) - 1, len(self.texts), self.links
        e[_INK] = self.ink - e[_INK]

    def _push(self, tag: str, attrs: str | None, keep_open: bool) -> None:
        stack, elems, texts = self.stack, self.elems, self.texts
        up, _, script, raw, chrome, in_list = stack[-1] if stack else _OUTSIDE
        here, n_texts, links = len(elems), len(texts), self.links
        parent = up[_ID]
        script = script or tag in SCRIPT_TAGS
        e = [
            here, parent, here, tag, [], None, None, None, None, None, None, None, n_texts, n_texts, links,
            links, None, self.ink if keep_open else 0, 0, here, script, False, in_list,
        ]
        if attrs:
            met = set()
            for name, double, single, bare in _ATTRIBUTE.findall(attrs):
                name = name.lower()
                place = _ATTRIBUTE_PLACES.get(name)
                # Of an attribute given twice the first counts.
                if place is not None and name not in met:
                    met.add(name)
                    value = double or single or bare
                    e[place] = unescape(value) if "&" in value else value
            if "class" in met:
                e[_CLASSES] = e[_CLASSES].split()
        classes = e[_CLASSES]
        chrome = chrome or _is_chrome(tag, classes, e[_ELEM_ID])
        e[_IN_CHROME] = chrome
        elems.append(e)
        if not chrome:
            if tag in HEADINGS:
                for o in reversed(stack):
                    if o[0][_HEADING] is not None:
                        break
                    o[0][_HEADING] = here
            if tag == "a":
                self.links = e[_A1] = links + 1
            if tag not in NOT_CARDS:
                kin = (parent, tag, *sorted(classes)) if classes else (parent, tag)
                family = self.families.get(kin)
                if family is None:
                    self.families[kin] = [e]
                else:
                    family.append(e)
        if keep_open:
            stack.append((e, tag, script, raw or tag in RAW_TEXT_TAGS, chrome, in_list or tag in ("ul", "ol")))

    def _outside_body(self) -> bool:
        return not self.stack or self.stack[-1][1] in ("html", "head")

    def _start(self, tag: str, attrs: str | None, keep_open: bool) -> None:
        stack = self.stack
        if tag in ("html", "head", "body"):
            if tag in self.seen:
                return
            self.seen.add(tag)
            page_part = True
        else:
            page_part = False
        while stack and (closers := CLOSED_BY.get(stack[-1][1])) is not None and tag in closers:
            self._pop()
        if tag not in HEAD_ONLY:
            if stack and stack[-1][1] == "head":
                self._pop()
            if not page_part and "body" not in self.seen:
                self._imply_body()
        self._push(tag, attrs, keep_open and tag not in VOID)

    def _imply_body(self) -> None:
        if self._outside_body() and "body" not in self.seen:
            while self.stack and self.stack[-1][1] == "head":
                self._pop()
            self.seen.add("body")
            self._push("body", None, True)

    def _end(self, tag: str) -> None:
        stack = self.stack
        if stack and stack[-1][1] == tag:
            self._pop()
            return
        priority = END_PRIORITY.get(tag, DEFAULT_END_PRIORITY)
        for o in reversed(stack):
            if o[1] == tag:
                while stack[-1] is not o:
                    self._pop()
                self._pop()
                return
            if END_PRIORITY.get(o[1], DEFAULT_END_PRIORITY) > priority:
                break
        if tag == "p":
            self._start("p", None, False)

    # -- strings -----------------------------------------------------------------
    def _flush(self, run: str) -> None:
        """One string per run of character data."""
        if run and not run.isspace():
            if self._outside_body():
                self._imply_body()
                self._push("p", None, True)
            self._string(run, "text")

    def _string(self, s: str, kind: str) -> None:
        s = s.strip()
        if s:
            up, _, script, raw, chrome, _ = self.stack[-1] if self.stack else _OUTSIDE
            kind = "raw" if raw and kind == "text" else kind
            words = s.split()
            single = " ".join(words)
            self.texts.append((up[_ID], s, None if single == s else single, kind, script, chrome))
            if kind == "text" and not chrome:
                self.ink += len(single) - len(words) + 1

    # -- page ----------------------------------------------------------------------
    def outline(self, html: str) -> tuple[list[list], list[tuple]]:
        at, last, data = 0, html.rfind(">"), ""
        while markup := (_MARKUP if at <= last else _TAIL).search(html, at):
            start, stop = markup.span()
            if start > at:
                data += _text(html[at:start])
            at = stop
            comment, end, tag, attrs = markup.groups()
            if tag is None:
                self._flush(data)
                data = ""
                if comment:
                    self._string(comment, "comment")
                continue
            if data:
                self._flush(data)
                data = ""
            tag = tag.lower()
            if end:
                self._end(tag)
                continue
            closed = attrs.endswith("/") and not _SLASH_IN_VALUE.search(attrs)
            self._start(tag, attrs, not closed)
            if tag in _RAW_END:
                raw_end = _RAW_END[tag].search(html, at)
                stop = raw_end.start() if raw_end else len(html)
                data = html[at:stop]
                at = stop
        data += _text(html[at:])
        self._flush(data)
        while self.stack:
            self._pop()
        for family in self.families.values():
            n, eldest = len(family), family[0][_ID]
            for e in family:
                e[_TWINS], e[_ELDEST] = n, eldest
        return self.elems, self.texts


def _arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(pa.field("element", _arrow(t.elementType), t.containsNull))
    if isinstance(t, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType), f.nullable) for f in t])
    return {
        T.IntegerType: pa.int32(), T.StringType: pa.string(), T.BooleanType: pa.bool_(),
    }[type(t)]


_ELEM_ARROW, _TEXT_ARROW = _arrow(ELEMENT), _arrow(TEXT)
# An output batch is sent off once it holds this many elements and strings.
_BATCH_NODES = 20_000


def _list_of_structs(columns: list[tuple], counts: list[int], kind: pa.DataType) -> pa.Array:
    arrays = [pa.array(c, type=kind.field(i).type) for i, c in enumerate(columns)]
    offsets = [0]
    for n in counts:
        offsets.append(offsets[-1] + n)
    values = pa.StructArray.from_arrays(arrays, fields=[kind.field(i) for i in range(kind.num_fields)])
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), values, type=pa.list_(pa.field("element", kind, False))
    )


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        html = batch.column(batch.schema.names.index("html"))
        rest = [n for n in batch.schema.names if n != "html"]
        done = 0
        while done < batch.num_rows:
            elems, texts, n_elems, n_texts, at = [], [], [], [], done
            while at < batch.num_rows and len(elems) + len(texts) < _BATCH_NODES:
                e, t = _Outline().outline(html[at].as_py() or "")
                elems += e
                texts += t
                n_elems.append(len(e))
                n_texts.append(len(t))
                at += 1
            part = batch.slice(done, at - done)
            columns = [part.column(part.schema.names.index(n)) for n in rest]
            for rows, counts, kind in ((elems, n_elems, _ELEM_ARROW), (texts, n_texts, _TEXT_ARROW)):
                transposed = list(zip(*rows, strict=True)) or [()] * kind.num_fields
                columns.append(_list_of_structs(transposed, counts, kind))
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, "elems", "texts"])
            done = at


def outlines(pages: DataFrame) -> DataFrame:
    """Replace the ``html`` column by ``elems`` and ``texts``; other columns pass through."""
    kept = [f for f in pages.schema.fields if f.name != "html"]
    ship_package(pages.sparkSession)
    return pages.mapInArrow(_parse_batches, T.StructType(kept + OUTLINE_FIELDS))


def dom_nodes(parsed: DataFrame) -> DataFrame:
    """One row per element, for node-level joins and audits."""
    return parsed.selectExpr("page_id", "inline(elems)").withColumnRenamed("id", "node_id")

"""Item noise rules, as SQL text.

The rules run inside array functions, once per candidate, and there are many of them.
Written as SQL a whole rule set reaches the planner in one piece; arguments and results
are SQL expressions, e.g. ``F.expr(listing_noise("text", "bucket", "company_name"))``.
Candidates are clean text: trimmed, with single spaces.
"""

from __future__ import annotations

from siteloom import constants as K
from siteloom.functions.text import WHITESPACE, WHITESPACE_CHARS, _any_of


def literal(pattern: str) -> str:
    """Raw SQL string literal; none of the fixed patterns holds a quote."""
    assert "'" not in pattern
    return f"r'{pattern}'"


def matches(s: str, pattern: str) -> str:
    return f"({s} rlike {literal(pattern)})"


def contains_any(s: str, needles: list[str]) -> str:
    return matches(s, _any_of(needles))


def equals_any(s: str, values: list[str]) -> str:
    return matches(s, r"\A" + _any_of(values) + r"\z")


def starts_with_any(s: str, needles: list[str]) -> str:
    return matches(s, r"\A" + _any_of(needles))


def ends_with_any(s: str, needles: list[str]) -> str:
    return matches(s, _any_of(needles) + r"\z")


def strip(s: str) -> str:
    return f"btrim({s}, '{WHITESPACE_CHARS}')"


def clean(s: str) -> str:
    return f"nullif(trim(regexp_replace({s}, {literal(WHITESPACE)}, ' ')), '')"


def let(value: str, var: str, body: str) -> str:
    """Evaluate ``value`` once and use it many times as ``var`` in ``body``."""
    return f"transform(array({value}), {var} -> {body})[0]"


def boilerplate(low: str, company_name: str) -> str:
    """Section labels, widget titles, registration labels and the company's own name;
    ``low`` is the candidate in lower case."""
    return (
        f"({equals_any(low, K.BOILERPLATE_HEADINGS)}"
        f" or {starts_with_any(low, K.GENERIC_HEADING_PREFIXES)}"
        f" or {contains_any(low, K.ID_LABEL_KEYWORDS)}"
        f" or coalesce({company_name} <> '' and {low} = lower({strip(company_name)}), false))"
    )


def _repeated_lead(n: str) -> str:
    def again(k: int) -> str:
        rest = f"array_join(slice(v.w, {k + 1}, greatest({n} - {k}, 0)), ' ')"
        return f"({n} >= {2 * k} and contains({rest}, array_join(slice(v.w, 1, {k}), ' ')))"

    return f"({n} >= 4 and ({' or '.join(again(k) for k in (2, 3, 4))}))"


def _entity(bucket: str, n: str) -> str:
    general = [s for s in K.ENTITY_NAME_SUFFIXES if s not in K.INDUSTRY_SUFFIXES]
    return (
        f"({ends_with_any('v.low', general)}"
        f" or (coalesce({bucket}, '') <> 'industries'"
        f" and {ends_with_any('v.low', K.INDUSTRY_SUFFIXES)})"
        f" or (upper(v.t) = v.t and v.low <> v.t and {n} >= 3))"
    )


def _rules(bucket: str, company_name: str) -> dict[str, str]:
    """Each rule over ``v``: the text, its lower case, and the words of the latter."""
    n = "size(v.w)"
    half = f"cast({n} div 2 as int)"
    lead = f"regexp_replace(get(v.w, 0), {literal('^[,.:;]+|[,.:;]+$')}, '')"
    return {
        "cta": contains_any("v.low", K.LISTING_NOISE_PHRASES),
        "date": matches("v.t", "(?U)" + K.DATE_PATTERN),
        "location": matches("v.t", "(?U)" + K.LOCATION_PATTERN),
        "rating": matches("v.t", "(?U)" + K.RATING_PATTERN),
        "sentence": f"({n} > {K.MAX_ITEM_WORDS}"
        f" or ({matches('v.t', '[.!?]$')} and {n} > {K.MAX_PUNCTUATED_WORDS}))",
        "metric": matches("v.t", "(?U)" + K.METRIC_PATTERN),
        "duplicated": f"({n} >= 2 and {n} % 2 = 0"
        f" and slice(v.w, 1, {half}) = slice(v.w, {half} + 1, {half}))",
        "repeated_lead": _repeated_lead(n),
        "numeric": matches("v.t", "(?U)" + K.NUMERIC_PATTERN),
        "required_field": "endswith(v.t, '*')",
        "action": f"coalesce({n} >= 2 and {equals_any(lead, K.ACTION_LEAD_WORDS)}, false)",
        "boilerplate": boilerplate("v.low", company_name),
        "entity": _entity(bucket, n),
    }


def _view(text: str) -> str:
    words = f"filter(split(lower({text}), ' '), w -> w <> '')"
    return f"named_struct('t', {text}, 'low', lower({text}), 'w', {words})"


def listing_noise(text: str, bucket: str, company_name: str) -> str:
    """True when any rule says that a listing candidate is not the name of an offering."""
    return let(_view(text), "v", "(" + " or ".join(_rules(bucket, company_name).values()) + ")")


def noise_flags(text: str, bucket: str, company_name: str) -> str:
    """Struct with one flag per rule, for audits that count each rule separately."""
    flags = ", ".join(f"'{name}', {rule}" for name, rule in _rules(bucket, company_name).items())
    return let(_view(text), "v", f"named_struct({flags})")


RULE_NAMES = list(_rules("''", "''"))

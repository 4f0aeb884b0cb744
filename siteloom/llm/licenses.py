"""Licence scans by sentence and rule.

Sentences of a text are normalised (lower case, runs of other characters than letters and digits as
one blank) and mapped to the identifiers of known licence sentences. The identifiers, in the order of
the text, are matched against ordered licence rules: a rule fits where its identifiers follow each
other; the rules for whole texts come first and use up what they match.

Licence texts are often wrapped, so a line end may close a sentence or be a blank in it: every run of
whole lines between two sentence ends is looked up, from each line the longest known one, and nothing
known is dropped for what stands elsewhere. All of it is local to a row and native. Null and empty
texts have no sentence. Repeated rows get equal results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, normalised.
SENTENCES = {
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",  # noqa: E501
    "mit-copy": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",  # noqa: E501
    "as-is-upper": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",  # noqa: E501
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",  # noqa: E501
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",  # noqa: E501
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",  # noqa: E501
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",  # noqa: E501
    "reserved": "all rights reserved",
}
# Known sentences that hold a ``:`` or ``;`` before white space in the published text, and
# the words before it.
ENDS_WITHIN = {
    "gpl-free": "this program is free software",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty",
}
# Ordered rules, whole texts before notices.
RULES = [
    ("MIT", ["mit-grant", "mit-copy", "as-is-upper"]),
    ("MIT", ["mit-grant", "mit-copy"]),
    ("Apache-2.0", ["apache-header", "apache-comply", "apache-copy"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("BSD", ["reserved", "bsd-grant"]),
    ("BSD", ["bsd-grant"]),
    ("ISC", ["isc-grant"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-licensed"]),
    ("Apache-2.0", ["apache-notice"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("CC-BY-4.0", ["cc-by-work"]),
    ("proprietary", ["reserved"]),
]
# Every known sentence holds one of these; texts without any are done.
HINTS = ["licen[cs]e", "permission", "rights reserved", "software", "redistribut", "warrant"]
_HINT = "(?i)" + "|".join(HINTS).replace(" ", "[^a-z0-9]+")
# Sentence ends: punctuation before white space, or an empty line; a line end may be one.
BY_LINE = r"[.!?:;]+\s+|\n"
ACROSS_LINES = r"[.!?:;]+\s+|\n\s*\n"


def marked(text: Column) -> Column:
    """Normalised text with ``|`` at sentence ends and at both ends, line ends kept."""
    ended = F.regexp_replace(F.translate(F.lower(text), "|", "-"), ACROSS_LINES, "|")
    words = F.regexp_replace(ended, "[^a-z0-9|\n]+", " ")
    lines = F.regexp_replace(words, " ?\n[ \n]*", "\n")
    return F.regexp_replace(F.concat(F.lit("|"), lines, F.lit("|")), r"[ \n]?\|[ \n|]*", "|")


def _pattern() -> str:
    """Every known sentence between marks, wrapped anywhere; the longest of those at one place."""
    known = []
    for i, s in sorted(SENTENCES.items(), key=lambda x: (-len(x[1]), x[1])):
        if i in ENDS_WITHIN:
            s = s.replace(f"{ENDS_WITHIN[i]} ", f"{ENDS_WITHIN[i]}|")
        known.append(s.replace("|", r"[\s|]").replace(" ", r"\s"))
    return r"(?<=[|\n])(?:" + "|".join(known) + r")(?=[|\n])"


def known_sentences(text: Column) -> Column:
    """Identifiers of the known sentences, in order, each between blanks."""
    table = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, i)])
    found = F.regexp_extract_all(marked(text), F.lit(_pattern()), F.lit(0))
    named = F.transform(found, lambda s: F.element_at(table, F.translate(s, "\n|", "  ")))
    ids = F.array_join(named, "  ")
    return F.when(text.rlike(_HINT) & (ids != ""), F.concat(F.lit(" "), ids, F.lit(" "))).otherwise("")


def _match(ids: Column) -> tuple[list[Column], Column]:
    """Whether each rule fits, and the identifiers no rule uses."""
    fits = []
    for _, rule in RULES:
        run = F.lit("".join(f" {i} " for i in rule))
        fits.append(F.contains(ids, run))
        # A mark stays, so that what stood apart does not come together.
        ids = F.replace(ids, run, F.lit("|"))
    return fits, ids


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, sentence_ids, n_known, licenses, n_left`` per row: the identifiers, how many, the
    licences in the order of the rules, and the number of identifiers outside any rule."""
    read = docs.select("doc_id", known_sentences(F.col("text")).alias("ids"))
    fits, left = _match(F.col("ids"))
    names = list(dict.fromkeys(name for name, _ in RULES))
    licenses = [
        F.when(_any([f for (n, _), f in zip(RULES, fits, strict=True) if n == name]), F.lit(name))
        for name in names
    ]
    return read.select(
        "doc_id",
        F.trim(F.replace("ids", F.lit("  "), F.lit(" "))).alias("sentence_ids"),
        _count(F.col("ids")).alias("n_known"),
        F.concat_ws(",", *licenses).alias("licenses"),
        _count(left).alias("n_left"),
    )


def _count(ids: Column) -> Column:
    return F.size(F.filter(F.split(ids, " "), lambda s: s.rlike("[a-z]"))).cast("long")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out

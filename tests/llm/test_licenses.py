import re

from siteloom.llm import licenses
from siteloom.llm.licenses import ACROSS_LINES, BY_LINE, RULES, SENTENCES

MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
TEXTS = [
    None, "", "plain words", "Released under the MIT License.", "x | y |\nLicensed under CC BY-NC 4.0.\nmore",
    "Licensed under the Apache License, Version 2.0.\nAll rights reserved.", MIT, MIT.replace("\n", "\r\n"),
    "All rights reserved. Released under the MIT License! released UNDER the mit  licence",
    "All rights reserved. Redistribution and use in source and binary forms, with or without\nmodification, are"
    " permitted provided that the following conditions are met:", "released under the MIT license",
    "This work is licensed under the GNU General Public License, version 3.\n" * 400,
    "All rights reserved.\nSome licence words\nAll rights reserved.", "Not released under the MIT License. Nor this",
]
BY_ID = {s: i for i, s in SENTENCES.items()}


def plain(text):
    readings = []
    for ends in (BY_LINE, ACROSS_LINES):
        parts = re.split(ends, text or "")
        ids = [BY_ID.get(re.sub("[^a-z0-9]+", " ", p.lower()).strip()) for p in parts]
        readings.append([i for i in ids if i])
    ids = max(readings, key=len)
    names, rest = set(), "".join(f" {i} " for i in ids)
    for name, rule in RULES:
        run = "".join(f" {i} " for i in rule)
        if run in rest:
            names.add(name)
        rest = rest.replace(run, "|")
    order = dict.fromkeys(n for n, _ in RULES)
    left = len(re.findall("[a-z0-9-]+", rest))
    return " ".join(ids), len(ids), ",".join(n for n in order if n in names), left


def test_scan(spark, texts):
    every = TEXTS + texts + [TEXTS[3]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(every)], "doc_id long, text string, licenses string")
    got = licenses.scan(docs).collect()
    assert len(got) == len(every)
    for r in got:
        assert tuple(r)[1:] == plain(every[r.doc_id]), every[r.doc_id]
    found = {r.doc_id: r.licenses for r in got}
    assert found[3] == found[6] == found[7] == "MIT" and found[9] == "BSD" and found[0] == ""
    assert found[13] == "" and licenses.scan(docs.limit(0)).count() == 0


def test_tables_agree():
    assert {i for _, rule in RULES for i in rule} <= set(SENTENCES)
    for s in SENTENCES.values():
        assert re.sub("[^a-z0-9]+", " ", s.lower()).strip() == s
        assert any(re.search(h, s) for h in licenses.HINTS), s


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.licenses for r in sorted(licenses.scan(docs).collect(), key=lambda r: r.doc_id)]


def test_both_readings_count_in_one_text(spark):
    line = "Released under the MIT License\nplain text\n"
    wrapped = APACHE.replace("Version 2.0 (the", "Version\n2.0 (the")
    texts = [line + "\n" + wrapped, line + wrapped, wrapped + line, "Released under the MIT License\n" + wrapped,
             "All rights\nreserved\nplain\nLicensed under CC BY 4.0\nmore", "Not\nReleased under the MIT License or so"]
    assert found(spark, texts) == ["MIT,Apache-2.0"] * 4 + ["CC-BY-4.0,proprietary", ""]


GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
BSD = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""


def test_published_texts(spark):
    first = GPL.split("\n\n")[0]
    texts = [GPL, GPL.replace("\n", "\r\n"), GPL.replace("\n\n", " ").replace("\n", " "), first,
             "".join(f" * {line}\n" for line in GPL.splitlines()), first.replace("version 3", "version 2"),
             MIT, APACHE, BSD, ISC, "This program is free software: you can use it."]
    assert found(spark, texts) == ["GPL-3.0-or-later"] * 5 + ["", "MIT", "Apache-2.0", "BSD", "ISC", ""]
    whole = licenses.scan(spark.createDataFrame([(1, GPL)], "doc_id long, text string")).first()
    assert (whole.sentence_ids, whole.n_known, whole.n_left) == ("gpl-free gpl-warranty", 2, 0)

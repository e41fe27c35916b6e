"""Licence notices as they are published: in comments, wrapped, by SPDX line, against a plain version."""

import re
import textwrap

import pytest

from tracemill.llm import license_rules as rules
from tracemill.llm.common import table

GPL = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version.\n\nThis {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU {2} Public License for more details."
MIT = 'MIT License\n\nCopyright (c) 2020 Some Body\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.'
BSD = "Copyright 2001, A. Body\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
HEADERS = {
    "GPL-2.0-or-later": [GPL.format("program", ";", "General", ";", "2"), GPL.format("package", ":", "General", ",", "2")],
    "GPL-3.0-or-later": [GPL.format("program", ":", "General", ",", "3"), GPL.format("file", ";", "General", ";", "3")],
    "LGPL-2.1-or-later": [GPL.format("library", ";", "Lesser General", ";", "2.1")],
    "LGPL-3.0-or-later": [GPL.format("library", ":", "Lesser General", ",", "3")],
    "AGPL-3.0-or-later": [GPL.format("program", ":", "Affero General", ",", "3")],
    "GPL-2.0-only": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Apache-2.0": ['Copyright 2020 Some Body\n\nLicensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
    "MIT": [MIT],
    "MIT-0": [MIT.replace(", subject to the following conditions:", ".").replace("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n", "")],
    "BSD-2-Clause": [BSD],
    "BSD-3-Clause": [BSD + "\n\n3. Neither the name of Acme, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "BSD-4-Clause": [BSD + "\n\n3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by A. Body.\n\n4. Neither the name of A. Body nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote it."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)"],
}


def plain_ids(sentence):
    """Identifiers of one sentence: all of an SPDX expression, or what the sentence, or its part before "see ...", is or calls a licence."""
    if m := re.search(rules.SPDX_LINE, sentence):
        words = [w.lower() for w in re.findall(r"[A-Za-z0-9][A-Za-z0-9.:+-]*", m[1]) if w.upper() not in ("AND", "OR", "WITH")]
        return [f"SPDX-{rules.SPDX[w]}" if w in rules.SPDX else "unknown" for w in words]
    for s in (sentence, re.sub(rules.TAIL, "", sentence)):
        n = rules.normalise(s)
        name = re.sub(rules.VERB, "", n)
        name = re.sub(r"\bv(?:er)? ?(?=[0-9])", "", re.sub(rules.NOISE, " ", name))
        found = rules.SENTENCES.get(n) or rules.CALLED.get(" ".join(name.split()))
        if found:
            return [found]
    return ["unknown"]


def plain_scan(text):
    """Names of the licences of a text, with loops."""
    text = re.sub("\r\n?", "\n", text or "")
    text = "\n".join(re.sub(rf"^[ \t]*{rules.MARKS}[ \t]*", "", x) for x in text.split("\n"))
    text = re.sub(r"(?im)^(.*spdx-license-identifier:.*)$", r"\n\1\n", text)
    paragraphs = re.sub(r"(?<!\n)\n(?!\n)", " ", text)
    best, most = [], -1
    for t in (text, paragraphs):
        ids = [i for x in re.split(rules.SENTENCE_END, t) if any(h in x.lower() for h in rules.HINTS) for i in plain_ids(x)]
        known = sum(i != "unknown" for i in ids)
        if known > most:
            best, most = ids, known
    names = []
    for name, rule in rules.RULES:
        if rule == ["MITref"] and "MIT0grant" in best:
            continue
        at = 0
        for i in best:
            if at < len(rule) and i == rule[at]:
                at += 1
        if at == len(rule) and name not in names:
            names.append(name)
    return [n for n in names if not set(rules.COVERED.get(n, ())) & set(names)], best


def in_comments(text):
    wrapped = "\n\n".join("\n".join(textwrap.wrap(p, 72, break_on_hyphens=False)) for p in text.split("\n\n"))
    lines = wrapped.split("\n")
    marked = lambda mark: "\n".join((mark + x).rstrip() for x in lines)
    return [wrapped, text, marked("# "), marked("// "), "/*\n" + marked(" * ") + "\n */", marked(";; "), marked("-- "), wrapped.replace("\n", "\r\n")]


def test_published_headers_in_comments_name_their_licence(spark):
    rows = [(name, t) for name, texts in HEADERS.items() for text in texts for t in in_comments(text)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    for r in rules.scan(df).collect():
        name, text = rows[r.doc_id]
        assert r.licences == [name], (name, text, r.sentence_ids)
        assert (r.licences, r.sentence_ids) == plain_scan(text)


def test_every_sentence_of_the_table_is_found_as_it_is_written(spark):
    df = spark.createDataFrame([(i, "Some prose first. " + t + " More prose.") for i, (_, t) in enumerate(rules.TEXTS) if not t.startswith(rules.SPDX_LINE)], "doc_id long, text string")
    for r in rules.scan(df).collect():
        name, text = rules.TEXTS[r.doc_id]
        assert rules.SENTENCES[rules.cut(text)[-1]] in r.sentence_ids or text[-1] not in ".:;", (name, text, r.sentence_ids)


@pytest.mark.parametrize("shape", ["// {}\nint main() {{}}", "# {}", "/* {} */", "<!-- {} -->"])
def test_spdx_lines(spark, shape):
    ids = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-2.0+": "GPL-2.0-or-later", "GPL-3.0": "GPL-3.0-only", "BSD-3-Clause": "BSD-3-Clause", "LGPL-2.1-or-later": "LGPL-2.1-or-later"}
    df = spark.createDataFrame([(k, shape.format("SPDX-License-Identifier: " + k)) for k in ids], "doc_id string, text string")
    assert {r.doc_id: r.licences for r in rules.scan(df).collect()} == {k: [v] for k, v in ids.items()}


def test_documents_match_the_plain_version(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = rules.scan(docs).collect()
    assert any(r.licences for r in got)
    for r in got:
        want = plain_scan(texts[r.doc_id])
        assert (r.licences, r.sentence_ids) == (want if any(h in (texts[r.doc_id] or "").lower() for h in rules.HINTS) else ([], []))

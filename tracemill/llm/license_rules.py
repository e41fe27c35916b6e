"""Licence scan by sentence rules, with DataFrame functions only.

A text is cut into sentences, each is normalised and looked up in a table of known licence
sentences; the identifiers found, in order, are matched against ordered licence rules.
Table and rules are fixed and small; everything happens inside the row, without a shuffle.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every known sentence holds one of these words, and a sentence that holds one without being known counts as unknown.
HINTS = ("license", "licence", "redistribut", "permission", "warrant", "unencumbered", "gnu general", "copy of the", "acknowledg", "misrepresented")
#: "v." as in "v. 2.0" ends no sentence, nor does a stop before "nor" ("Acme Inc. nor the names") or the colon of an SPDX line.
SENTENCE_END = "(?<=[.!?;:])(?<!\\b[vV]\\.)(?<![Ii]dentifier:)[\\x20\\t]++(?!nor\\b)|\\n+"
#: Marks that open a line of a comment, and a line that has nothing else.
MARKS = "(?:/\\*+|\\*+/?|//+!?|#+|;+|--+|%+|<!--|\"\"\"|REM\\b)"
#: The holder in a normalised BSD clause, and what stands for it.
HOLDER, ANY_HOLDER = "^neither the name of .{1,200}? nor the names of its contributors may", "neither the name of the copyright holder nor the names of its contributors may"

# Sentences of the published licences and of the notices that refer to them, by identifier.
TEXTS = [
    ("MITref", "Released under the MIT License."),
    ("MITref", "Licensed under the MIT License."),
    ("MITref", "This project is licensed under the MIT License."),
    ("MITref", "Distributed under the MIT License."),
    ("MITref", "This software is released under the MIT License."),
    ("MITgrant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MITnotice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT0grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."),
    ("Apache2ref", "Licensed under the Apache License, Version 2.0."),
    ("Apache2ref", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache2ref", "This project is licensed under the Apache License, Version 2.0."),
    ("Apache2ref", "Licensed under the Apache License 2.0."),
    ("Apache2comply", "you may not use this file except in compliance with the License."),
    ("Apache2copy", "You may obtain a copy of the License at"),
    ("Apache2asis", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("Apache2see", "See the License for the specific language governing permissions and limitations under the License."),
    ("GPL3ref", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL2ref", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL3ref", "Licensed under the GNU General Public License, version 3."),
    ("GPL2ref", "Licensed under the GNU General Public License, version 2."),
    ("GPL3ref", "Licensed under the GNU GPL v3."),
    ("GPL2ref", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL3ref", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation."),
    ("GPLwarranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
    ("GPLwarranty", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
    ("GPLwarranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY, without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("GPLfitness", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("GPLsee", "See the GNU General Public License for more details."),
    ("GPLsee", "See the GNU Lesser General Public License for more details."),
    ("GPLsee", "See the GNU Affero General Public License for more details."),
    ("LGPL3ref", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL21ref", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL3ref", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL2ref", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL2ref", "Licensed under the Mozilla Public License, version 2.0."),
    ("MPL2copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSDgrant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSDsource", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSDbinary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSDendorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSDadvert", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("BSDadvert", "All advertising materials mentioning features or use of this software must display the following acknowledgment:"),
    ("BSD2ref", "Licensed under the BSD 2-Clause License."),
    ("BSD3ref", "Licensed under the BSD 3-Clause License."),
    ("ISCgrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISCgrant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISCref", "Licensed under the ISC License."),
    ("0BSDgrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ZlibAsIs", "This software is provided 'as-is', without any express or implied warranty."),
    ("ZlibGrant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("ZlibOrigin", "The origin of this software must not be misrepresented;"),
    ("Boostgrant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("Boostref", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL2ref", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL2ref", "Licensed under the Eclipse Public License 2.0."),
    ("EPL1ref", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL1ref", "Licensed under the Eclipse Public License 1.0."),
    ("Artistic2ref", "Licensed under the Artistic License 2.0."),
    ("Artistic2ref", "you can redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("CCBY4ref", "Licensed under CC BY 4.0."),
    ("CCBYSA4ref", "Licensed under CC BY-SA 4.0."),
    ("CCBYNC4ref", "Licensed under CC BY-NC 4.0."),
    ("CCBYND4ref", "Licensed under CC BY-ND 4.0."),
    ("CCBYNCSA4ref", "Licensed under CC BY-NC-SA 4.0."),
    ("CCBYNCND4ref", "Licensed under CC BY-NC-ND 4.0."),
    ("CCBY4ref", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CCBYSA4ref", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CCBYNC4ref", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0ref", "This work is licensed under CC0 1.0."),
    ("CC0ref", "Licensed under CC0 1.0."),
]
# Titles and openings of full texts, and notices that name a foundation.
TEXTS += [
    ("Apache2title", "Apache License Version 2.0, January 2004"),
    ("Apache2title", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache2title", "Apache License Version 2.0, January 2004 https://www.apache.org/licenses/"),
    ("Apache2define", "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("Apache2define", "\"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."),
    ("Apache2grantC", "Grant of Copyright License."),
    ("Apache2grantP", "Grant of Patent License."),
    ("ASFcontrib", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements."),
    ("Apache2ref", "The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\");"),
    ("FSFverbatim", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL3title", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL3open", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL2title", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL2open", "The licenses for most software are designed to take away your freedom to share and change it."),
    ("LGPL3title", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL21title", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL3title", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL3open", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("MPL2title", "Mozilla Public License Version 2.0"),
    ("WTFPLtitle", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004"),
    ("WTFPLtitle", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("PSFtitle", "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2"),
    ("PSFopen", "This LICENSE AGREEMENT is between the Python Software Foundation (\"PSF\"), and the Individual or Organization (\"Licensee\") accessing and otherwise using this software (\"Python\") in source or binary form and its associated documentation."),
    ("BSDstyle", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
]
# The grants of the GNU licences: name, short name, versions.
GNU = [("General", "GPL", ("2", "3")), ("Lesser General", "LGPL", ("2.1", "3")), ("Library General", "LGPL", ("2",)), ("Affero General", "AGPL", ("3",))]
for _name, _short, _versions in GNU:
    _terms = f"you can redistribute it and/or modify it under the terms of the GNU {_name} Public License as published by the Free Software Foundation"
    TEXTS.append((f"{_short}terms", _terms + ";"))
    for _v in _versions:
        _later = f"either version {_v} of the License, or (at your option) any later version."
        TEXTS += [(f"{_short}{_v}orLater", f"{_terms}, {_later}"), (f"Either{_v}", _later)]

#: Ordered rules: the first rule whose identifiers occur in this order, with anything between, takes its place; all that match are named.
RULES = [
    ("GPL-3.0-or-later", ["GPL3orLater"]),
    ("GPL-2.0-or-later", ["GPL2orLater"]),
    ("GPL-3.0-or-later", ["GPLterms", "Either3"]),
    ("GPL-2.0-or-later", ["GPLterms", "Either2"]),
    ("LGPL-3.0-or-later", ["LGPL3orLater"]),
    ("LGPL-3.0-or-later", ["LGPLterms", "Either3"]),
    ("LGPL-2.1-or-later", ["LGPL2.1orLater"]),
    ("LGPL-2.1-or-later", ["LGPLterms", "Either2.1"]),
    ("LGPL-2.0-or-later", ["LGPL2orLater"]),
    ("LGPL-2.0-or-later", ["LGPLterms", "Either2"]),
    ("AGPL-3.0-or-later", ["AGPL3orLater"]),
    ("AGPL-3.0-or-later", ["AGPLterms", "Either3"]),
    ("AGPL-3.0-only", ["AGPL3ref"]),
    ("LGPL-3.0-only", ["LGPL3ref"]),
    ("LGPL-2.1-only", ["LGPL21ref"]),
    ("GPL-3.0-only", ["GPL3ref"]),
    ("GPL-2.0-only", ["GPL2ref"]),
    ("Apache-2.0", ["Apache2ref"]),
    ("Apache-2.0", ["Apache2comply", "Apache2asis"]),
    ("MPL-2.0", ["MPL2ref"]),
    ("BSD-4-Clause", ["BSDgrant", "BSDsource", "BSDbinary", "BSDadvert"]),
    ("BSD-3-Clause", ["BSDgrant", "BSDsource", "BSDbinary", "BSDendorse"]),
    ("BSD-2-Clause", ["BSDgrant", "BSDsource", "BSDbinary"]),
    ("BSD-3-Clause", ["BSD3ref"]),
    ("BSD-2-Clause", ["BSD2ref"]),
    ("MIT", ["MITgrant", "MITnotice"]),
    ("MIT", ["MITref"]),
    ("MIT-0", ["MIT0grant"]),
    ("ISC", ["ISCgrant"]),
    ("ISC", ["ISCref"]),
    ("0BSD", ["0BSDgrant"]),
    ("Zlib", ["ZlibAsIs", "ZlibGrant"]),
    ("BSL-1.0", ["Boostgrant"]),
    ("BSL-1.0", ["Boostref"]),
    ("EPL-2.0", ["EPL2ref"]),
    ("EPL-1.0", ["EPL1ref"]),
    ("Artistic-2.0", ["Artistic2ref"]),
    ("CC-BY-4.0", ["CCBY4ref"]),
    ("CC-BY-SA-4.0", ["CCBYSA4ref"]),
    ("CC-BY-NC-4.0", ["CCBYNC4ref"]),
    ("CC-BY-ND-4.0", ["CCBYND4ref"]),
    ("CC-BY-NC-SA-4.0", ["CCBYNCSA4ref"]),
    ("CC-BY-NC-ND-4.0", ["CCBYNCND4ref"]),
    ("CC0-1.0", ["CC0ref"]),
    ("Unlicense", ["Unlicense"]),
    ("Apache-2.0", ["Apache2title"]),
    ("Apache-2.0", ["Apache2define", "Apache2grantC"]),
    ("Apache-2.0", ["Apache2grantC", "Apache2grantP"]),
    ("GPL-3.0-only", ["GPL3title"]),
    ("GPL-3.0-only", ["FSFverbatim", "GPL3open"]),
    ("GPL-2.0-only", ["GPL2title"]),
    ("GPL-2.0-only", ["FSFverbatim", "GPL2open"]),
    ("LGPL-3.0-only", ["LGPL3title"]),
    ("LGPL-2.1-only", ["LGPL21title"]),
    ("AGPL-3.0-only", ["AGPL3title"]),
    ("AGPL-3.0-only", ["FSFverbatim", "AGPL3open"]),
    ("MPL-2.0", ["MPL2title"]),
    ("WTFPL", ["WTFPLtitle"]),
    ("WTFPL", ["WTFPLref"]),
    ("PSF-2.0", ["PSFtitle"]),
    ("PSF-2.0", ["PSFopen"]),
    ("PSF-2.0", ["PSFref"]),
    ("LGPL-2.0-only", ["LGPL2ref"]),
    ("BSD-4-Clause", ["BSD4ref"]),
    ("Zlib", ["Zlibref"]),
    ("OFL-1.1", ["OFL11ref"]),
    ("LicenseRef-BSD-style", ["BSDstyle"]),
]
#: What sentences such as "licensed under X" or a heading may call a licence, without the words that NOISE takes out.
NAMES = {
    "MITref": ["mit", "mit x11", "expat", "mit expat"],
    "Apache2ref": ["apache 2", "apache 2 0", "apache software 2 0", "asl 2 0", "apache2"],
    "MPL2ref": ["mpl 2 0", "mpl 2", "mozilla public 2 0", "mozilla public 2"],
    "BSD2ref": ["bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd"],
    "BSD3ref": ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd"],
    "BSD4ref": ["bsd 4 clause", "original bsd"],
    "BSDstyle": ["bsd", "bsd style", "bsd style that can be found in file"],
    "ISCref": ["isc"],
    "Zlibref": ["zlib", "zlib libpng"],
    "Boostref": ["boost software 1 0", "boost 1 0", "bsl 1 0", "boost"],
    "EPL2ref": ["eclipse public 2 0", "epl 2 0", "epl 2"],
    "EPL1ref": ["eclipse public 1 0", "epl 1 0"],
    "Artistic2ref": ["artistic 2 0", "artistic 2"],
    "Unlicense": ["unlicense"],
    "CC0ref": ["cc0", "cc0 1 0", "creative commons zero"],
    "CCBY4ref": ["cc by 4 0"],
    "CCBYSA4ref": ["cc by sa 4 0"],
    "CCBYNC4ref": ["cc by nc 4 0"],
    "CCBYND4ref": ["cc by nd 4 0"],
    "CCBYNCSA4ref": ["cc by nc sa 4 0"],
    "CCBYNCND4ref": ["cc by nc nd 4 0"],
    "WTFPLref": ["wtfpl", "wtfpl 2", "do what fuck you want to public"],
    "PSFref": ["psf", "psf 2", "psf 2 0", "python software foundation", "python software foundation 2"],
    "OFL11ref": ["sil open font 1 1", "ofl 1 1"],
}
# Those of the GNU licences by rule: long and short names, versions with and without a nought, or later.
for _short, _long, _versions in (("gpl", "general public", {"2": "GPL2", "3": "GPL3"}), ("lgpl", "lesser general public", {"2 1": "LGPL2.1", "3": "LGPL3", "2": "LGPL2"}), ("agpl", "affero general public", {"3": "AGPL3"})):
    for _v, _id in _versions.items():
        for _called in (_short, f"gnu {_short}", f"gnu {_long}", _long):
            for _n in dict.fromkeys([_v, _v if " " in _v else f"{_v} 0"]):
                NAMES.setdefault(_id.replace("2.1", "21") + "ref", []).append(f"{_called} {_n}")
                NAMES.setdefault(_id + "orLater", []).extend([f"{_called} {_n} or later", f"{_called} {_n}+", f"{_called} {_n} or at your option any later", f"{_called} {_n} or any later"])
#: What stands before a licence's name, words that its name may have or not, and what a notice says of where to read it.
VERB = "^(?:.* )?(?:licensed|licenses|released|distributed|available|provided|published|governed|covered|offered)(?: this [a-z]+)?(?: to you)?(?: exclusively| solely)? (?:under|by|with|according to) "
NOISE = "\\b(?:the|a|an|terms of|terms and conditions of|license|licence|licenses|licensed|version|as published by free software foundation)\\b"
TAIL = "(?i)\\s+[-\u2013\u2014(]+\\s*see\\b.*$|[,;]\\s+see\\s.*$|\\s+\\((?:see|https?:)[^)]*\\)?.*$|\\s+as (?:described|stated|found) in .*$"
#: Identifiers that SPDX expressions may name beside those of the rules, and their exceptions.
SPDX_MORE = "AFL-3.0 Apache-1.1 BlueOak-1.0.0 BSD-1-Clause CC-BY-3.0 CC-BY-SA-3.0 CDDL-1.0 CDDL-1.1 ECL-2.0 EUPL-1.1 EUPL-1.2 GPL-1.0-only GPL-1.0-or-later LGPL-2.0-only MPL-1.1 MS-PL MulanPSL-2.0 NCSA ODbL-1.0 OpenSSL PostgreSQL Python-2.0 Ruby Unicode-3.0 UPL-1.0 Vim X11 curl libpng-2.0".split()
SPDX_EXCEPTIONS = "Autoconf-exception-3.0 Bison-exception-2.2 Classpath-exception-2.0 Font-exception-2.0 GCC-exception-3.1 LLVM-exception Linux-syscall-note OpenJDK-assembly-exception-1.0 openvpn-openssl-exception Qt-GPL-exception-1.0 u-boot-exception-2.0".split()
SPDX_NAMES = list(dict.fromkeys([n for n, _ in RULES] + SPDX_MORE))
#: Lower-case identifier, also in the older forms of the GNU licences: the name that is reported.
SPDX = {form.lower(): name for name in SPDX_NAMES for form in (name, name.replace("-only", ""), name.replace("-or-later", "+"))} | {n.lower(): n for n in SPDX_NAMES} | {n.lower(): n for n in SPDX_EXCEPTIONS}
RULES = [*RULES, *((n, [f"SPDX-{n}"]) for n in [*SPDX_NAMES, *SPDX_EXCEPTIONS])]
_ID = "[A-Za-z0-9][A-Za-z0-9.:+-]*"
#: An SPDX line with the expression behind it, as far as it is one: identifiers in brackets or not, joined by AND, OR and WITH.
SPDX_LINE = rf"(?i)spdx-license-identifier:[\x20\t]*((?:\([\x20\t]*)*{_ID}(?:[\x20\t]*\))*(?:[\x20\t]+(?:AND|OR|WITH)[\x20\t]+(?:\([\x20\t]*)*{_ID}(?:[\x20\t]*\))*)*)"

#: Rules that a longer one of theirs makes superfluous.
COVERED = {"BSD-2-Clause": ("BSD-3-Clause", "BSD-4-Clause"), "BSD-3-Clause": ("BSD-4-Clause",)}

#: A heading that says nothing beside the grant of a licence of like name: rule and that grant.
HEADINGS = {("MITref",): "MIT0grant"}


def normalise(sentence: str) -> str:
    """What SQL does to a sentence: lower case, other characters than letters, digits and a closing + to single spaces, any holder in the BSD clause to a fixed one."""
    return re.sub(HOLDER, ANY_HOLDER, re.sub("[^a-z0-9+]+|\\+(?=[^\\s])", " ", sentence.lower()).strip(" "))


def _normal(sentence: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9+]+|\\+(?=[^\\s])", " ")), HOLDER, ANY_HOLDER)


def cut(text: str) -> list[str]:
    """The normalised sentences of a text that hold a hint word, cut as SQL cuts them."""
    return [normalise(x) for x in re.split(SENTENCE_END, text) if any(h in x.lower() for h in HINTS)]


#: Normalised sentence: identifier. The table's sentences go through the same cutting as a text's.
SENTENCES = {piece: name for name, text in TEXTS for piece in cut(text)}


def plain_lines(text: Column) -> Column:
    """The text without comment marks at the beginnings of lines; a line of marks alone is a blank one, and an SPDX line a paragraph."""
    bare = F.regexp_replace(F.regexp_replace(text, "\\r\\n?", "\n"), f"(?m)^[\\x20\\t]*+{MARKS}[\\x20\\t]*+", "")
    return F.regexp_replace(bare, "(?im)^(.*spdx-license-identifier:.*)$", "\n$1\n")


#: Slots of a lookup: what is asked for is held against the entries of one of them only.
SLOTS = 256


def looked_up(table: dict[str, str], key: Column) -> Column:
    """table[key], or null; the table is a constant array of small maps, by crc32 of the key."""
    slots: list[dict[str, str]] = [{} for _ in range(SLOTS)]
    for k, v in table.items():
        slots[zlib.crc32(k.encode()) % SLOTS][k] = v
    none = F.create_map().cast("map<string,string>")
    maps = F.array(*[F.create_map(*[F.lit(x) for kv in slot.items() for x in kv]) if slot else none for slot in slots])
    return F.try_element_at(F.get(maps, (F.crc32(key.cast("binary")) % SLOTS).cast("int")), key)


def called(sentence: Column) -> Column:
    """What a normalised sentence calls a licence: behind the last "licensed under" or its like, or all of it, without words that say nothing."""
    name = F.regexp_replace(sentence, VERB, "")
    name = F.regexp_replace(F.regexp_replace(name, NOISE, " "), "\\bv(?:er)? ?(?=[0-9])", "")
    return F.trim(F.regexp_replace(name, " +", " "))


#: Name: identifier of the sentence that it makes.
CALLED = {name: id_ for id_, names in NAMES.items() for name in names}


def identified(sentence: Column) -> Column:
    """The identifiers of a sentence as an array: of an SPDX line all that its expression names, else one."""
    spdx = F.regexp_extract(sentence, SPDX_LINE, 1)
    words = F.filter(F.regexp_extract_all(spdx, F.lit(_ID), F.lit(0)), lambda w: ~F.upper(w).isin("AND", "OR", "WITH"))
    ids = F.transform(words, lambda w: F.coalesce(F.concat(F.lit("SPDX-"), looked_up(SPDX, F.lower(w))), F.lit("unknown")))
    # Each reading of the sentence is worked out once.
    one = F.get(F.transform(F.array(_normal(sentence)), lambda n: F.coalesce(looked_up(SENTENCES, n), looked_up(CALLED, called(n)))), F.lit(0))
    cut_ = F.regexp_replace(sentence, TAIL, "")
    short = F.get(F.transform(F.array(_normal(cut_)), lambda n: F.coalesce(looked_up(SENTENCES, n), looked_up(CALLED, called(n)))), F.lit(0))
    return F.when(spdx != "", ids).otherwise(F.array(F.coalesce(one, F.when(F.length(cut_) < F.length(sentence), short), F.lit("unknown"))))


def licence_sentences(text: Column) -> Column:
    """Identifiers of the known licence sentences of a text, in order; `unknown` for others that have a hint word."""
    hint = F.lit("(?i)" + "|".join(HINTS))
    pieces = lambda t: F.filter(F.split(t, SENTENCE_END), lambda s: F.regexp_like(s, hint))
    sentences = pieces(plain_lines(text))
    # Long licence texts wrap their lines; a paragraph is also read as one line.
    joined = pieces(F.regexp_replace(plain_lines(text), "(?<!\\n)\\n(?!\\n)", " "))
    ids = lambda a: F.flatten(F.transform(a, identified))
    count = lambda a: F.size(F.filter(a, lambda x: x != "unknown"))
    # Each reading is worked out once and the one that knows more is taken, that by lines if both know as much.
    best = F.reduce(F.array(ids(sentences), ids(joined)), F.lit(None).cast("array<string>"), lambda a, b: F.when(a.isNull() | (count(b) > count(a)), b).otherwise(a))
    return best


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentence_ids (array), licences (array), n_known, n_unknown, a row per row of docs.

    licences are the rules' licences in the rules' order, without repeats; of an SPDX
    expression all that it names, its exceptions by their own names. Null, empty and
    other texts without a hint word have none. Repeated rows give repeated results, null ids
    are carried along, other columns play no part, an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Only a text with a hint word can hold a known sentence, so the others need no cutting.
    ids = F.when(F.regexp_like(text, F.lit("(?i)" + "|".join(HINTS))), licence_sentences(text)).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(id_col).alias("doc_id"), ids.alias("sentence_ids"))
    line = F.concat(F.lit(","), F.array_join("sentence_ids", ","), F.lit(","))
    apart = lambda rule: ~F.contains(line, F.lit(f",{HEADINGS[tuple(rule)]},")) if tuple(rule) in HEADINGS else F.lit(True)
    hits = [F.when(F.regexp_like(line, F.lit(",(?:.*,)?".join(["", *map(re.escape, rule), ""]))) & apart(rule), F.lit(name)) for name, rule in RULES]
    names = F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull()))
    for less, more in COVERED.items():
        names = F.when(F.arrays_overlap(names, F.array(*map(F.lit, more))), F.array_remove(names, less)).otherwise(names)
    out = rows.select("*", F.when(F.size("sentence_ids") > 0, names).otherwise(F.array().cast("array<string>")).alias("licences"))
    known = F.size(F.filter("sentence_ids", lambda x: x != "unknown")).cast("long")
    return out.select("*", known.alias("n_known"), (F.size("sentence_ids") - known).cast("long").alias("n_unknown"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, licences and sentence_ids (comma-joined), n_known, n_unknown."""
    return scan(docs).select("doc_id", F.array_join("licences", ",").alias("licences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), "n_known", "n_unknown")

"""License scans by sentence rules, with DataFrame functions only.

A text is cut into sentences at marks and into lines, all normalised (lower case, runs of other characters than
a-z and 0-9 to one space). A line, or a run of lines within a sentence, that makes up a known license sentence
gives its identifier; of runs from one line the longest counts, and the next one begins after it. The sequence
of identifiers, in text order, is then matched against ordered rules. A rule matches if its identifiers stand
next to each other in the sequence; sentences without an identifier don't separate them. The SQL takes single
lines and sentences without inner ends only: it gives the same rows where no known sentence is wrapped or holds one.

Defined results: null, empty and blank texts have no sentences; very long texts are read whole; a repeated license
counts once; ties: of sentences that begin at one place the longest counts, and the lists are sorted by rule order
(licenses) or text order (identifiers); repeated rows each get their row; an empty table gives no rows; columns beside
doc_id and text are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# License sentences as they are published, by identifier.
SENTENCES = {
    "apache-named": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit-named": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-heading": "The MIT License (MIT)",
    "mit-title": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl3-named": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "cc0-title": "CC0 1.0 Universal",
    "cc0-marked": "This work is licensed under a Creative Commons Zero v1.0 Universal License.",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "epl2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "boost": "Distributed under the Boost Software License, Version 1.0.",
    "mpl2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "reserved": "All rights reserved.",
    "gpl3-title": "GNU General Public License v3.0",
    "gpl3-heading": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl2-title": "GNU General Public License v2.0",
    "gpl2-heading": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl3-heading": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-heading": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "agpl3-heading": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "apache-heading": "Apache License Version 2.0, January 2004",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "bsd3-title": "BSD 3-Clause License",
    "bsd2-title": "BSD 2-Clause License",
    "isc-title": "ISC License",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "cc-by-nd-long": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "artistic2-title": "The Artistic License 2.0",
}
# Identifiers of the SPDX list whose tags are known.
TAGS = (
    "Apache-2.0 MIT MIT-0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later "
    "AGPL-3.0-only AGPL-3.0-or-later BSD-2-Clause BSD-3-Clause ISC MPL-2.0 EPL-2.0 BSL-1.0 Zlib Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 Artistic-2.0 WTFPL"
).split()
SENTENCES |= {f"spdx-{name.lower()}": f"SPDX-License-Identifier: {name}" for name in TAGS}
# Rules as identifier sequences, with the license each shows.
RULES = [
    ("Apache-2.0", ["apache-named"]),
    ("Apache-2.0", ["apache-grant", "apache-comply", "apache-copy"]),
    ("MIT", ["mit-named"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-heading"]),
    ("MIT", ["mit-title"]),
    ("GPL-3.0", ["gpl3-named"]),
    ("GPL-3.0", ["gpl-free", "gpl-hope", "gpl-received"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-long"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-4.0", ["cc-by-long"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-disclaimer"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]),
    ("AGPL-3.0-or-later", ["agpl3-free"]),
    ("ISC", ["isc-grant"]),
    ("CC0-1.0", ["cc0-title"]),
    ("CC0-1.0", ["cc0-marked"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-long"]),
    ("Unlicense", ["unlicense"]),
    ("EPL-2.0", ["epl2"]),
    ("BSL-1.0", ["boost"]),
    ("MPL-2.0", ["mpl2"]),
    ("Proprietary", ["reserved"]),
    ("GPL-3.0", ["gpl3-title"]),
    ("GPL-3.0", ["gpl3-heading"]),
    ("GPL-2.0", ["gpl2-title"]),
    ("GPL-2.0", ["gpl2-heading"]),
    ("LGPL-3.0", ["lgpl3-heading"]),
    ("LGPL-2.1", ["lgpl21-heading"]),
    ("AGPL-3.0", ["agpl3-heading"]),
    ("Apache-2.0", ["apache-heading"]),
    ("Apache-2.0", ["apache-as-is"]),
    ("BSD-3-Clause", ["bsd3-title"]),
    ("BSD-2-Clause", ["bsd2-title"]),
    ("ISC", ["isc-title"]),
    ("Zlib", ["zlib-grant"]),
    ("MPL-2.0", ["mpl2-title"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-long"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-long"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-long"]),
    ("WTFPL", ["wtfpl"]),
    ("Artistic-2.0", ["artistic2-title"]),
    ("MIT", ["mit-warranty"]),
]
RULES += [(name, [f"spdx-{name.lower()}"]) for name in TAGS]
#: Every known sentence holds one of these parts of words (no white space, so that no line break parts it); a text without
#: any of them needs no cutting.
KEYWORDS = ("licen", "permission", "redistribut", "warrant", "reserved", "cc0", "unencumbered")
#: A sentence ends at these marks before white space, but not before a digit ("v. 2.0").
_END = r"([.;!?])[ \t\r\n]+([^0-9 \t\r\n])"


def _plain(text: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())


#: Between sentences that marks end. A text's own ones become another character that is no letter, digit or space.
_CUT = "\x01"


def lines(text: Column) -> Column:
    """One string of normalised lines, without empty ones: a line break between two, _CUT between sentences."""
    cut = F.regexp_replace(F.translate(F.lower(text), _CUT, "_"), _END, f"$1{_CUT}$2")
    plain = F.regexp_replace(cut, f"[^a-z0-9\n{_CUT}]+", " ")
    plain = F.regexp_replace(plain, "[ \n]*\n[ \n]*", "\n")
    return F.trim(F.regexp_replace(plain, f"[ \n]*{_CUT}[ \n{_CUT}]*", _CUT))


def known() -> dict[str, str]:
    """Normalised sentence to identifier; a published sentence with inner sentence ends keys by its whole."""
    out = {}
    for name, text in SENTENCES.items():
        out[_plain(text)] = name
    return out


def _run(text: str) -> str:
    """A pattern of a known sentence in the string of lines; a published sentence can hold sentence ends itself."""
    parts = re.sub(_END, rf"\1{_CUT}\2", text.lower()).split(_CUT)
    return _CUT.join(_plain(p) for p in parts).replace(" ", "[ \n]")


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    table = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    lower = F.lower(text)
    may = F.lit(False)
    for word in KEYWORDS:
        may = may | F.contains(lower, F.lit(word))
    # From a line's start to a line's end; alternatives are tried in order, so the longest first.
    runs = "|".join(sorted(map(_run, SENTENCES.values()), key=lambda s: (-len(s), s)))
    whole = f"(?<![^\n{_CUT}])(?:{runs})(?![^\n{_CUT}])"
    found = F.transform(F.regexp_extract_all(lines(text), F.lit(whole), F.lit(0)), lambda s: F.element_at(table, F.translate(s, f"\n{_CUT}", "  ")))
    return F.when(may, found).otherwise(F.array().cast("array<string>"))


def licenses(ids: Column) -> Column:
    """Licenses whose rules match the sequence, each once, in rule order."""
    line = F.concat(F.lit(","), F.array_join(ids, ","), F.lit(","))
    hits = [F.when(F.contains(line, F.lit("," + ",".join(rule) + ",")), F.lit(name)) for name, rule in RULES]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, identifiers, licenses) of every row."""
    found = documents.select("doc_id", identifiers(F.coalesce(F.col("text"), F.lit(""))).alias("ids"))
    return found.select("doc_id", F.col("ids").alias("identifiers"), licenses(F.col("ids")).alias("licenses"))


def oracle() -> str:
    """The same in DuckDB SQL, ids and licenses joined by commas."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in known().items())
    rules = ", ".join(f"({i}, {quote(name)}, {quote(',' + ','.join(rule) + ',')})" for i, (name, rule) in enumerate(RULES))
    return f"""
WITH known(s, id) AS (VALUES {table}), rules(r, license, ids) AS (VALUES {rules}),
cut AS (SELECT doc_id, string_split(regexp_replace(lower(coalesce(text, '')), '{_END}', '\\1' || chr(10) || '\\2', 'g'), chr(10)) AS parts FROM documents),
parts AS (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS p FROM cut),
named AS (SELECT doc_id, p, id FROM (SELECT doc_id, p, trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) AS s FROM parts) JOIN known USING (s)),
seq AS (SELECT doc_id, string_agg(id, ',' ORDER BY p) AS identifiers, count(*) AS n FROM named GROUP BY doc_id),
found AS (SELECT doc_id, license, min(r) AS r FROM seq JOIN rules ON contains(',' || seq.identifiers || ',', rules.ids) GROUP BY doc_id, license),
lists AS (SELECT doc_id, string_agg(license, ',' ORDER BY r) AS licenses, count(*) AS m FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_identifiers, coalesce(identifiers, '') AS identifiers, coalesce(m, 0) AS n_licenses, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN seq USING (doc_id) LEFT JOIN lists USING (doc_id)"""

"""Licence scanning by canonical digests.

A text's canonical form has its letters A-Z in lower case, no copyright lines, one blank for every
run of other ASCII characters than letters and digits, and one spelling for equivalent ones. The
SHA-256 of that is joined to the digests of known licence texts, whole text against whole text, and
each line is looked up too. The list of known texts is fixed and short, so its
digests are broadcast; nothing is shuffled. Long licences are listed by the digest alone.

Defined cases: a null text counts as empty; an empty text, or one of copyright lines alone, has the
digest of the empty string and no licence; of known texts with equal canonical forms the first in the
list counts; repeated rows are looked up alike; a very long text is one text; an empty table gives an empty
result; other columns are ignored, however they are named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright[^a-z0-9\n]*(\(c\)|©|[0-9]{4})|\(c\)|©)[^\n]*"
BETWEEN = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"

#: Spellings that count as the second one.
SPELLINGS = [("licence", "license"), ("licencing", "licensing"), ("sub license", "sublicense"), ("authorised", "authorized"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("https", "http")]

#: Known licence texts and notices.
KNOWN = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0 notice", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Proprietary", "All rights reserved."),
]


def _bsd(marks: list[str]) -> str:
    """The BSD licence of so many clauses, marked by these."""
    clauses = [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ]
    return (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
        + "\n\n".join(f"{m} {c}" for m, c in zip(marks, clauses, strict=False))
        + "\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    )


KNOWN += [("BSD-2-Clause", _bsd(["1.", "2."])), ("BSD-2-Clause", _bsd(["*", "*"])), ("BSD-3-Clause", _bsd(["1.", "2.", "3."])), ("BSD-3-Clause", _bsd(["*", "*", "*"]))]
TITLES = {"MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"], "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License"]}
KNOWN += [(name, f"{title}\n\n{text}") for name, text in KNOWN if len(text) > 400 for title in TITLES.get(name, [])]

#: SPDX identifiers, whose "SPDX-License-Identifier:" line is a notice.
SPDX = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0+ GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0+ GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL OFL-1.1 PostgreSQL PSF-2.0 Unlicense WTFPL Zlib".split()
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _code, _title in CC.items():
    for _version, _port in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic")):
        SPDX.append(f"CC-{_code}-{_version}")
        KNOWN += [(SPDX[-1], f"{lead} {form}") for lead in ("Licensed under", "This work is licensed under") for form in (f"CC {_code} {_version}.", f"the CC {_code} {_version} license.", f"a Creative Commons {_title} {_version} {_port} License.", f"the Creative Commons {_title} {_version} {_port} License.")]
KNOWN += [(name, f"SPDX-License-Identifier: {name}") for name in SPDX]
KNOWN += [
    (name, f"{lead} {title}.")
    for name, title in (("MIT", "the MIT License"), ("ISC", "the ISC License"), ("BSD-2-Clause", "the BSD 2-Clause License"), ("BSD-3-Clause", "the BSD 3-Clause License"), ("Apache-2.0", "the Apache License, Version 2.0"), ("Apache-2.0", "the Apache License 2.0"), ("MPL-2.0", "the Mozilla Public License 2.0"), ("MPL-2.0", "the Mozilla Public License, version 2.0"), ("GPL-2.0", "the GNU General Public License, version 2"), ("GPL-3.0", "the GNU General Public License, version 3"), ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1"), ("LGPL-3.0", "the GNU Lesser General Public License, version 3"), ("AGPL-3.0", "the GNU Affero General Public License, version 3"), ("Unlicense", "the Unlicense"), ("CC0-1.0", "CC0 1.0"), ("CC0-1.0", "CC0 1.0 Universal"))
    for lead in ("Licensed under", "Released under", "This work is licensed under", "This software is licensed under", "Distributed under")
]

#: Digests of the canonical forms of long licence texts.
DIGESTS = [
    ("Apache-2.0", "93651fc3b3c9c21033cf07999bdb593e0138192678d4743ddf7ee126fefab052"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("Unlicense", "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd"),
    ("Zlib", "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7"),
]


def canonical(text: Column) -> Column:
    t = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    t = F.regexp_replace(F.regexp_replace(t, COPYRIGHT_LINE, "$1"), BETWEEN, " ")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(t)


def known_digests(spark, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest and license of each known text."""
    rows = [(i, name, text) for i, (name, text) in enumerate(known or KNOWN)]
    table = spark.createDataFrame(rows, "place int, license string, known string")
    digests = table.select(F.sha2(canonical(F.col("known")), 256).alias("digest"), "license", "place")
    if known is None:
        digests = digests.union(spark.createDataFrame([(d, name, len(rows) + i) for i, (name, d) in enumerate(DIGESTS)], digests.schema))
    return digests.groupBy("digest").agg(F.min_by("license", "place").alias("license"))


def license_scan(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, digest of the canonical text, the license that it is (or null) and notices: names of
    the licences whose known texts are whole lines of it, in order, joined by commas."""
    table = known_digests(docs.sparkSession, known)
    lookup = {r["digest"]: r["license"] for r in table.collect()}  # the known list's length
    named = F.create_map(*(F.lit(x) for pair in lookup.items() for x in pair))
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    notices = F.array_join(F.filter(F.transform(lines, lambda s: named[F.sha2(canonical(s), 256)]), lambda n: n.isNotNull()), ",")
    found = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), notices.alias("notices"))
    # the table has a row for each known text at most, so its broadcast is bounded
    return found.join(F.broadcast(table), "digest", "left").select("doc_id", "digest", "license", "notices")


def oracle() -> str:
    """The same in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(x: str) -> str:
        x = f"translate(coalesce({x}, ''), '{UPPER}', '{LOWER}')"
        x = f"regexp_replace({x}, {quote(COPYRIGHT_LINE)}, '\\1', 'g')"
        x = f"regexp_replace({x}, {quote(BETWEEN)}, ' ', 'g')"
        for a, b in SPELLINGS:
            x = f"replace({x}, '{a}', '{b}')"
        return f"sha256(trim({x}))"

    rows = ", ".join(f"({i}, {quote(n)}, {quote(t)})" for i, (n, t) in enumerate(KNOWN))
    return f"""
        WITH known AS (SELECT {form("t")} AS digest, arg_min(n, i) AS license FROM (VALUES {rows}) AS k(i, n, t) GROUP BY 1),
        lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
        noted AS (SELECT doc_id, string_agg(license, ',' ORDER BY place) AS notices FROM (SELECT doc_id, place, {form("line")} AS digest FROM lines WHERE regexp_matches(line, '(?i)licen[cs]e|rights')) JOIN known USING (digest) GROUP BY doc_id),
        whole AS (SELECT doc_id, {form("text")} AS digest FROM documents)
        SELECT doc_id, digest, license, coalesce(notices, '') AS notices FROM whole LEFT JOIN known USING (digest) LEFT JOIN noted USING (doc_id)"""

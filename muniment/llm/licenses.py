"""Licence scans by canonical digests; DataFrame and SQL functions only.

A text is brought to canonical form once: lower case; copyright and title lines marked; list bullets and
punctuation to spaces; equivalent spellings to one, word by word. The SHA-256 of its words without the marked
lines is joined to the digests of known licence texts: short ones are here as text and go through the same
expression, long ones are here as digests of their canonical form. Lines are looked up alike among the known
one-line notices, so a notice inside other text is found too. The known texts are a small table that the
caller may replace; its size is bounded by KNOWN rows (more raise an error), so its digests may be broadcast.

A copyright line begins with the mark or word and goes on with the other, a year, a placeholder in brackets, "by"
or "the"; a sentence wrapped at "copyright notice" or "copyright holder", or a list item (c), is none. A title
line is nothing but a short licence's name.

Defined results: null text has neither digest nor licence; an empty text, or one of marked lines alone, has the
digest of the empty string and matches nothing; repeated rows repeat; a text known under two names takes the first
by name; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KNOWN = 10_000
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: (name, text) of short licences.
TEXTS = (
    ("0BSD", f"{_ISC_GRANT}. {_ISC_WARRANTY}"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", f"{_BSD_HEAD}3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD_TAIL}"),
    ("BSL-1.0", f'Boost Software License - Version 1.0 - August 17th, 2003\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. {_WARRANTY.replace("PURPOSE AND NONINFRINGEMENT", "PURPOSE, TITLE AND NON-INFRINGEMENT").replace("THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT", "THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT")}'),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}"),
    ("MIT", f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY}'),
    ("Unlicense", f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_WARRANTY.replace('AUTHORS OR COPYRIGHT HOLDERS', 'AUTHORS')} For more information, please refer to <https://unlicense.org/>"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
)
#: (name, digest) of long licences, as digest_of() gives them: fixed values. Apache-2.0 with and without its appendix and its last line.
DIGESTS = (
    ("Apache-2.0", "1cf41422d292ab1a4e3f5cb98ed54a5067a49287191822d53c0ddf420c12d692"),
    ("Apache-2.0", "4986127a1387801b7604ac1058836a2718273c670f6ff9f5f11d36f7f25cf284"),
    ("Apache-2.0", "578e8a908cf04c687b7455c7ecd945a81752083ecfc175f9ea85bd45ee92172e"),
    ("Artistic-1.0", "4834e699353522cfb463bd8b374752ecf02156bb3f5dfb53d0edb502a112a651"),
    ("CC0-1.0", "51c4bf27767d074bdefc84db7420b4c55e27827dac6d8de3ef0d37b2042fb6fa"),
    ("GFDL-1.2", "eedc97731019cf7f877348af55410bd5089234242adc64a169fb416eaff9478a"),
    ("GFDL-1.3", "c891b769e658b5d3ee6ba43b5b9f67df85e176ac97a42b644905282e4d058433"),
    ("GPL-1.0", "fe80ccaae90d81557cc6613b788c47dd1819c7a5ae034f77e7d60bb6b879677e"),
    ("GPL-2.0", "9c942f6942a3d44037aa20b92138b7de02aafd88adea708e7c93f34a145aeaa1"),
    ("GPL-3.0", "7e60bac7ad3d68309a78deeef1d0316a925262fd9e97ae550b6523e610cb97b7"),
    ("LGPL-2.0", "76e95bde887e452fdbf364b6e132f70904f43582182b76e0f71d88a2d8911ef7"),
    ("LGPL-2.1", "3c172029ca14deedef915e5d03e83bcc73647736d10c2be07d384571ca06b440"),
    ("LGPL-3.0", "d565922026c948f183f12ed772c5971cef065877e1c9f2a0fc02cae158258eaf"),
    ("MPL-1.1", "58ab4a44883a12e4f7761316b6c1ded94acc33fb85eccad8733cf3de36f16f4c"),
    ("MPL-2.0", "eee5a471aa6f0deea908eda4a70e7954f12062a5318c068b16221e279cf3970b"),
)
#: (name, line) of notices that stand on a line of their own.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License);"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("reserved", "All rights reserved."),
)
#: Spellings taken as one, as whole words of canonical text.
EQUIVALENT = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("licencee", "licensee"), ("sub license", "sublicense"), ("sub licenses", "sublicenses"), ("sub licensed", "sublicensed"),
    ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"), ("judgement", "judgment"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("organisation", "organization"), ("organisations", "organizations"), ("authorisation", "authorization"), ("authorised", "authorized"), ("recognise", "recognize"), ("recognised", "recognized"), ("utilisation", "utilization"),
    ("favour", "favor"), ("labour", "labor"), ("modelled", "modeled"), ("cancelled", "canceled"), ("programme", "program"), ("whilst", "while"), ("wilful", "willful"), ("fulfil", "fulfill"), ("merchantibility", "merchantability"),
    ("gnu gpl", "gnu general public license"), ("v 2", "version 2"), ("v 3", "version 3"), ("v2", "version 2"), ("v3", "version 3"), ("http", "https"),
)
_MARK = "\ue000"  # a private-use character: no letter, so no word of a text, and kept where other marks go
_YEAR = "(?:19|20)[0-9][0-9]"
_HEAD = r"[^\p{L}\p{N}\n]*"
_COPYRIGHT = rf"(?:portions )?copyright {{0,3}}(?:\(c\)|©|[<\[{{]|by |the )|(?:portions )?copyright[^\p{{L}}\p{{N}}\n]*{_YEAR}|(?:\(c\)|©) {{0,3}}(?:copyright|{_YEAR})|all rights reserved{_HEAD}$"
_BSD = r'(?:modified |simplified |new |revised |original )?bsd(?:[- ]?[0-4])?(?:[- ]clause)?(?: [(\"]?(?:simplified|"?new"? or "?revised|new|revised|original)[)\"]?)?'
_TITLE = rf"(?:the )?(?:mit|isc|expat|zlib|{_BSD})[ -]licen[sc]e{_HEAD}(?:mit|isc|expat|zlib|x11|bsd)?{_HEAD}$"
_MARKED = rf"^({_HEAD}(?:{_COPYRIGHT}|{_TITLE}))"
_BULLET = rf"(^|\n|[.:;])[^\p{{L}}\p{{N}}\n{_MARK}]*(?:[0-9][0-9]?|[a-z])[.)][ \t]+"
_OTHER = rf"[^\p{{L}}\p{{N}}\n{_MARK}]+"


def canonical(text: Column) -> Column:
    """Canonical words by line: each word framed by spaces of its own, marked lines led by a mark, lines parted by line feeds."""
    out = F.regexp_replace(F.replace(F.lower(text), F.lit(_MARK), F.lit(" ")), f"(?dm){_MARKED}", f"{_MARK} $1")
    out = F.regexp_replace(F.regexp_replace(out, _BULLET, "$1 "), _OTHER, "  ")
    out = F.concat(F.lit(" "), F.replace(out, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for old, new in EQUIVALENT:
        old, new = (x.replace(" ", "  ") for x in (old, new))
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return out


def _digest(words: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(F.replace(words, F.lit(_MARK), F.lit(" ")), " +", " ")), 256)


def _whole(words: Column) -> Column:
    """The digest of canonical words without the marked lines."""
    return _digest(F.array_join(F.filter(F.split(words, "\n"), lambda x: ~F.contains(x, F.lit(_MARK))), " "))


def digest_of(texts: DataFrame) -> DataFrame:
    """(name, digest) of (name, text) rows: the entries of a table of known digests."""
    return texts.select("name", canonical(F.col("text")).alias("c")).select("name", _whole(F.col("c")).alias("digest"))


def known_table(spark: SparkSession, rows: tuple, whole: bool, digests: tuple = ()) -> DataFrame:
    """(known, digest, width) of (name, text) rows and of (name, digest) ones: one name a digest; width: of the canonical text."""
    if len(rows) + len(digests) > KNOWN:
        raise ValueError(f"{len(rows) + len(digests)} known texts; the table is bounded by {KNOWN}")
    cell = lambda n, t: F.struct(F.lit(n).cast("string").alias("known"), F.lit(t).cast("string").alias("t"))
    table = lambda x: spark.range(1).select(F.inline(F.array(*[cell(n, t) for n, t in x] or [cell(None, None)]))).where("t IS NOT NULL")
    read = table(rows).select("known", canonical(F.col("t")).alias("c")).select("known", (_whole if whole else _digest)(F.col("c")).alias("digest"), F.length("c").alias("width"))
    return read.unionAll(table(digests).select("known", F.col("t").alias("digest"), F.lit(0).alias("width"))).groupBy("digest").agg(F.min("known").alias("known"), F.max("width").alias("width"))


def scan(docs: DataFrame, texts: tuple = TEXTS, notices: tuple = NOTICES, digests: tuple = DIGESTS) -> DataFrame:
    """(doc_id, digest, license, notices): the whole text's digest and licence, and the names of the
    notices that are lines of it, in order."""
    spark = docs.sparkSession
    whole = known_table(spark, texts, True, digests).select("digest", "known")
    # The notices' digests are few (KNOWN at most): they go into the plan as one literal map.
    found = known_table(spark, notices, False).collect()
    by_line = F.create_map(*[F.lit(x) for r in sorted(found) for x in (r["digest"], r["known"])]) if found else F.create_map().cast("map<string,string>")
    # A longer line than the longest notice is none: canonical frames are at most doubled by the marks they come from.
    longest = max([0, *(r["width"] for r in found)])
    lines = F.filter(F.split("c", "\n"), lambda x: F.length(F.regexp_replace(x, " +", " ")) <= longest)
    hits = F.filter(F.transform(lines, lambda x: F.element_at(by_line, _digest(x))), lambda x: x.isNotNull())
    read = docs.select("doc_id", canonical(F.col("text").cast("string")).alias("c"))
    read = read.select("doc_id", _whole(F.col("c")).alias("digest"), F.array_join(F.array_sort(F.array_distinct(hits)), ",").alias("notices"))
    return read.join(F.broadcast(whole), "digest", "left").select("doc_id", "digest", F.col("known").alias("license"), F.coalesce("notices", F.lit("")).alias("notices"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def _sql_canonical(x: str) -> str:
    q = lambda t: t.replace("'", "''")
    out = rf"regexp_replace(replace(lower({x}), '{_MARK}', ' '), '(?m){q(_MARKED)}', '{_MARK} \1', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '{q(_BULLET)}', '\1 ', 'g'), '{_OTHER}', '  ', 'g')"
    out = f"' ' || replace({out}, chr(10), ' ' || chr(10) || ' ') || ' '"
    for old, new in EQUIVALENT:
        old, new = (t.replace(" ", "  ") for t in (old, new))
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return out


def _sql_digest(x: str) -> str:
    return rf"sha256(trim(regexp_replace(replace({x}, '{_MARK}', ' '), ' +', ' ', 'g')))"


def _sql_whole(c: str) -> str:
    return _sql_digest(f"array_to_string(list_filter(string_split({c}, chr(10)), lambda l: NOT contains(l, '{_MARK}')), ' ')")


def _sql_rows(rows: tuple) -> str:
    return ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in rows)


OP4_SQL = f"""
WITH texts(known, t) AS (VALUES {_sql_rows(TEXTS)}),
notes(known, t) AS (VALUES {_sql_rows(NOTICES)}),
digests(known, digest) AS (VALUES {_sql_rows(DIGESTS) or "(NULL, NULL)"}),
tc AS MATERIALIZED (SELECT known, {_sql_canonical("t")} AS c FROM texts),
nc AS MATERIALIZED (SELECT known, {_sql_canonical("t")} AS c FROM notes),
dc AS MATERIALIZED (SELECT doc_id, {_sql_canonical("text")} AS c FROM documents),
whole AS (SELECT digest, min(known) AS known FROM (SELECT known, {_sql_whole("c")} AS digest FROM tc UNION ALL SELECT known, digest FROM digests) GROUP BY 1),
note AS (SELECT {_sql_digest("c")} AS digest, min(known) AS known FROM nc GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(c, chr(10))) AS x FROM dc),
hits AS (SELECT doc_id, string_agg(DISTINCT known, ',' ORDER BY known) AS notices
         FROM (SELECT doc_id, {_sql_digest("x")} AS digest FROM lines) JOIN note USING (digest) GROUP BY doc_id),
d AS (SELECT doc_id, {_sql_whole("c")} AS digest FROM dc)
SELECT d.doc_id, d.digest, whole.known AS license, coalesce(hits.notices, '') AS notices
FROM d LEFT JOIN whole USING (digest) LEFT JOIN hits ON d.doc_id = hits.doc_id
"""

"""Licence scans by canonical digests.

A text is brought to a canonical form: lower case, no copyright lines, one spelling of equivalent words, no
punctuation; its digest names the text. What is known is found by a second form, which doesn't depend on where lines
are wrapped: of copyright only statements (a mark, a year or a holder, up to the licence's body) are left out. The
digest of the whole text's form is looked up among the known licence texts and notices; so is that of each line, for
notices that stand in a line of their own. The known texts are a small table with a fixed bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.checkpointing import cut
from corpusmill.functions.joins import bounded
from corpusmill.llm.text import whole_text

#: Equivalent spellings, each with the one that stays.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("sub licence", "sublicense"), ("non commercial", "noncommercial"), ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"), ("authorisation", "authorization"), ("favour", "favor"), ("fulfil", "fulfill"),
    ("copyright holder", "copyright owner"), ("http", "https"), ("per cent", "percent"), ("whilst", "while"),
]
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
#: Known texts and notices, with their SPDX identifiers.
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("0BSD", f"{_ISC_GRANT}.\n{_ISC_END}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
]
_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_NO_ENDORSEMENT = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and
the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of
the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by
a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE
COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BODIES = {name: text for name, text in reversed(KNOWN) if "\n" in text} | {"MIT": _MIT}
_BODIES |= {"BSD-2-Clause": _CONDITIONS + _BSD_END, "BSD-3-Clause": _CONDITIONS + _NO_ENDORSEMENT + _BSD_END, "BSL-1.0": _BSL, "Zlib": _ZLIB}
_TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"], "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License"], "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "Zlib": ["zlib License", "The zlib License"],
}
#: Whole texts, without a title and with each.
WHOLE: list[tuple[str, str]] = [(name, f"{title}\n{body}") for name, body in _BODIES.items() for title in ["", *_TITLES[name]]]
#: Digests of the wrapping-independent form of longer texts, whole or up to the end of their terms.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "ef9aa6097e8b8724e8bedf9a9a264cbc3142b55ef97f3c3f079b7aa1aeac425c"),
    ("GPL-2.0-only", "52c324a693eed2ed98ad6a32da829a40745305278a13bfce51c97ee46788d1b0"),
    ("GPL-3.0-only", "3a97ad9ebb292a87018fe28810ac91c985bda8782d0b89d9fa0fbc5bd93e123e"),
    ("LGPL-2.1-only", "fad621c642bf91a2ded762485094d969685657f15d55b0db2da1aff770a7be10"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-2.0", "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.3-only", "80f2e0837e77742c3c18742ea577379665082b9263d769270c976fe9e60abd7f"),
    ("Artistic-1.0-Perl", "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a"),
    ("AGPL-3.0-only", "e1478258f29cc31662e729e7109ed2bff7f6cd8c2b815464d662ccd3b2990e7c"),
    ("Apache-2.0", "65bfb6f56a10dc6dd6135cf4adeee0f5bc238b3d404067ac48dbf48c0ced3b32"),
    ("Apache-2.0", "ed44d69699f98d45c0c3e52ef4574fb05d6045eb6e2cd0e5e3810f6177e87f84"),
    ("GPL-2.0-only", "68b4a7d8e79501b237338455331f9e70afcbca26b98c238331f61782208b200b"),
    ("GPL-2.0-only", "59b21cf3f4042472d8f959d1221944fb3538563b279a28f535a94302fe86543f"),
    ("GPL-3.0-only", "ca3ff8bddc7036125f44c461a453589adc977f6609b0fcb6611152dcda80da48"),
    ("GPL-3.0-only", "3f915ad52cbf1d360b14fe7d4d15d6f6aa9d752118aed3e20ebcbf1b3990ecda"),
    ("LGPL-2.1-only", "0bd60015dfd53eefd471e446c5e4524c61883ba7077cf5b618d0be06ae281ccf"),
    ("LGPL-2.1-only", "22947f9704d78b4cf06a5fdc09b64b0ac5c3079896fdf86d989b45f0c097be98"),
    ("AGPL-3.0-only", "57e59fab54902229aeb7183eda8d7bc2929c5861fa3820fba45d1de2755b373a"),
    ("AGPL-3.0-only", "aed049430bade3910b222e619759366e143992ae9e0de75112861a1306da99c1"),
]
COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
APART = r"[^\p{L}\p{M}\p{N}]+"
#: In the SQL, lines of more characters are no notices.
LONGEST_NOTICE = 2000
_YEAR = "(?:19|20)[0-9]{2}"
#: How a licence's body begins; what stands between a mark of copyright and this is its holder.
_OPENING = ("permission~+(?:is~+hereby|is~+granted|to~+use)|redistribution~+and~+use|(?:dual~+)?licensed~+under|released~+under|everyone~+is~+permitted|gnomovision~+comes|"
            "this~+(?:program|library|software|work|project|file|license|package|document)~|spdx-license-identifier|all~+rights~+reserved|(?:the~+)?mit~+license")
#: Words that no holder has: what has one is a sentence and stays.
_SENTENCE = "(?:is|are|was|be|may|must|shall|will|can|cannot|not|you|your|that|which|if|without|permitted|prohibited|subject)"
_NO_HOLDER = "(?:notices?|holders?|owners?|licen[sc]es?|laws?|acts?|statements?|interests?|disclaimers?|and|or|in|on|to|of|for|permission|protection|treaty|status|infringement)"


def _statements(within_lines: bool) -> list[str]:
    """Patterns of copyright statements; ``~`` is white space, within lines or over their ends."""
    apart = r"(?:[^\S\n]|[^\S\n]*[*#;/]+[^\S\n])" if within_lines else r"(?:\s|\s[*#;/]+\s)"
    mark = rf"(?:copyright~*[:,]?~*(?:\(c\)|©)|(?:\(c\)|©)~*copyright|(?:\(c\)|©)(?=~*{_YEAR})|copyright(?![^\p{{L}}\p{{N}}]+{_NO_HOLDER}\b))"
    holder = rf"(?<![\p{{L}}\p{{N}}]){mark}~*(?:(?!{_OPENING})(?!{_SENTENCE}(?![\p{{L}}\p{{N}}]))[^\s]++~*){{0,30}}?(?={_OPENING})"
    line = rf"(?m)^[^\p{{L}}\p{{N}}\n]*(?:copyright|\(c\)|©)[^\p{{L}}\n]*(?:\(c\))?[^\p{{L}}\n]*{_YEAR}[^\n]*"
    return [p.replace("~", apart) for p in (holder, line, r"(?<![\p{L}\p{N}])all~+rights~+reserved(?![\p{L}\p{N}])")]


def _one_spelling(words: Column) -> Column:
    """Words in one spelling each, apart by one blank; ``words`` are apart by two, so that no two share a blank and none is passed over."""
    words = F.concat(F.lit(" "), F.trim(words), F.lit(" "))
    for other, one in SPELLINGS:
        words = F.replace(words, F.lit(f" {other.replace(' ', '  ')} "), F.lit(f" {one} "))
    return F.trim(F.replace(words, F.lit("  "), F.lit(" ")))


def canonical(text: Column) -> Column:
    """The canonical form: words apart by one space."""
    return _one_spelling(F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, " "), APART, "  "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def unwrapped(text: Column, within_lines: bool = False) -> Column:
    """The form by which known texts are found: words apart by one space, wherever lines are wrapped.

    ``within_lines``: of each line by itself, the lines still apart by line feeds.
    """
    low = F.lower(text)
    out = low
    for pattern in _statements(within_lines):
        out = F.regexp_replace(out, pattern, " ")
    out = F.when(low.rlike(r"copyright|\(c\)|©|reserved"), out).otherwise(low)
    apart = APART.replace("]", r"\n]") if within_lines else APART
    out = F.regexp_replace(out, apart, "  ")
    if within_lines:
        out = F.regexp_replace(out, r"[\x20]*\n[\x20]*", " \n ")
    return _one_spelling(out)


def known_digests(spark, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id) of both forms of the known texts, one row per digest."""
    rows = spark.createDataFrame([*KNOWN, *WHOLE] if known is None else known, "license_id string, text string")
    rows = rows.select(F.explode(F.array(digest(F.col("text")), F.sha2(unwrapped(F.col("text")), 256))).alias("digest"), "license_id")
    if known is None:
        rows = rows.unionByName(spark.createDataFrame(DIGESTS, "license_id string, digest string"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, license_id of the whole text, n_notices, notices (ids in its lines).

    A missing text counts as empty and has neither; ``license_id`` is missing where the text is no known one, and
    ``notices`` is empty where no line is. Repeated rows come out repeated; a missing doc_id stays missing. Texts of any
    length are read whole, and an empty table has no rows. Only doc_id and text are read. Whole texts are joined with the
    known digests by hash, by both their forms; if there are at most ``ROWS`` of these they are broadcast. Lines are
    looked up in a map of them, so ``known`` should be a table of licences, not of texts.
    """
    known = cut(known_digests(docs.sparkSession) if known is None else known)
    rows = docs.select("doc_id", whole_text().alias("_text"))
    lines = F.split(unwrapped(F.col("_text"), within_lines=True), "\n", -1)
    rows = rows.select("doc_id", digest(F.col("_text")).alias("digest"), F.sha2(unwrapped(F.col("_text")), 256).alias("_form"), lines.alias("_lines"))
    whole, form = (bounded(known.select(F.col("digest").alias(c), F.col("license_id").alias(n))) for c, n in (("digest", "_whole"), ("_form", "_unwrapped")))
    table = known.groupBy(F.lit(1).alias("_one")).agg(F.map_from_entries(F.collect_list(F.struct("digest", "license_id"))).alias("_known"))
    rows = rows.join(whole, "digest", "left").join(form, "_form", "left").withColumns({"_one": F.lit(1), "license_id": F.coalesce("_whole", "_unwrapped")}).join(F.broadcast(table), "_one", "left")
    found = F.filter(F.transform("_lines", lambda line: F.col("_known")[F.sha2(F.trim(line), 256)]), lambda x: x.isNotNull())
    rows = rows.withColumn("_found", found)
    return rows.select("doc_id", "digest", "license_id", F.size("_found").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("_found")), ",").alias("notices"))


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{COPYRIGHT}', ' ', 'g')"
    out = f"' ' || trim(regexp_replace({out}, '{APART}', '  ', 'g')) || ' '"
    for other, one in SPELLINGS:
        out = f"replace({out}, ' {other.replace(' ', '  ')} ', ' {one} ')"
    return f"trim(replace({out}, '  ', ' '))"


def sql(table: str = "documents", known: list[tuple[str, str]] = KNOWN) -> str:
    """The query ``scan`` in SQL."""
    values = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in known)
    return f"""
WITH known AS (SELECT sha256({_sql_canonical('text')}) AS digest, min(license_id) AS license_id FROM (VALUES {values}) AS v(license_id, text) GROUP BY 1),
rows AS (SELECT doc_id, coalesce(text, '') AS text, sha256({_sql_canonical("coalesce(text, '')")}) AS digest FROM {table}),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM rows),
found AS (SELECT doc_id, k.license_id FROM (SELECT doc_id, sha256({_sql_canonical('line')}) AS digest FROM lines WHERE length(line) <= {LONGEST_NOTICE} AND regexp_matches(lower(line), 'licen[sc]e')) l JOIN known k USING (digest)),
counted AS (SELECT doc_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(license_id))), ',') AS notices FROM found GROUP BY 1)
SELECT r.doc_id, r.digest, k.license_id, coalesce(c.n, 0) AS n_notices, coalesce(c.notices, '') AS notices
FROM rows r LEFT JOIN known k USING (digest) LEFT JOIN counted c USING (doc_id)
"""

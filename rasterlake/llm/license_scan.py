"""Licence scans by canonical digests.

A text is brought to a canonical form (lower case, lines that state an owner dropped, marks and blanks made single
blanks, equivalent spellings made one), and its SHA-256 is joined to the digests of known licences. A text matches only as a
whole. Lines, too, are looked up as texts of their own, which finds one-line notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import fresh, table

# Texts of public licences and notices, by identifier.
_WARRANTY_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_WARRANTY_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by "
    "the Free Software Foundation, either version {version} of the License, or (at your option) any later version.\nThis "
    "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {short} for more details.\nYou should have received a copy of "
    "the {short} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
LICENSES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.\n" + _WARRANTY_MIT
    ),
    "MIT-0": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so.\n" + _WARRANTY_MIT
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _WARRANTY_ISC
    ),
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _WARRANTY_ISC,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": (
        _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, '
        "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
        "Software is furnished to do so, all subject to the following:\nThe copyright notices in the Software and this entire "
        "statement, including the above license grant, this restriction and the following disclaimer, must be included in all "
        "copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or "
        "derivative works are solely in the form of machine-executable object code generated by a source language processor.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
        "THE SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would "
        "be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software.\n3. This notice may not be removed or altered from any source "
        "distribution."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author "
        "or authors of this software dedicate any and all copyright interest in the software to the public domain. We make "
        "this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
        "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        'under copyright law.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n"
        "For more information, please refer to <https://unlicense.org/>"
    ),
    "header:Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "header:MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "header:GPL-2.0-or-later": _GNU.format(name="GNU General Public License", version="2", short="GNU General Public License"),
    "header:GPL-3.0-or-later": _GNU.format(name="GNU General Public License", version="3", short="GNU General Public License"),
    "header:LGPL-3.0-or-later": _GNU.format(name="GNU Lesser General Public License", version="3", short="GNU Lesser General Public License"),
    "header:AGPL-3.0-or-later": _GNU.format(name="GNU Affero General Public License", version="3", short="GNU Affero General Public License"),
    "notice:MIT": "Released under the MIT License.",
    "notice:Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice:GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice:CC-BY-4.0": "Licensed under CC BY 4.0.",
    "notice:CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "notice:CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "notice:CC0-1.0": "Released under CC0 1.0.",
    "notice:reserved": "All rights reserved.",
}
# Title lines that may stand above a licence's text.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License, Version 1.0"),
    "Zlib": ("zlib License", "The zlib License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
# Spellings that count as one, in lower case, as whole words.
EQUIVALENT = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "sub license": "sublicense",
    "organisation": "organization", "favour": "favor", "merchantibility": "merchantability", "non infringement": "noninfringement",
    "per cent": "percent", "acknowledgement": "acknowledgment", "judgement": "judgment", "fulfil": "fulfill", "wilful": "willful",
    "copyright owner": "copyright holder", "copyright owners": "copyright holders", "authors": "author",
}
#: A line that only says whose the copyright is, in lower case: it has a mark, a year, "by" or a place for a name after the
#: word, or it begins with the mark; and what parts words.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}\n©(]*(copyright[ \t:]*(\(c\)|©|[0-9]{4}|by[ \t]|<|\[|\{)|\(c\)[ \t]*(copyright|[0-9]{4})|©)[^\n]*$"
BETWEEN = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text; null stays null, and a text of copyright lines, marks and blanks is empty."""
    c = F.regexp_replace(F.lower(text), "(?md)" + COPYRIGHT_LINE, "")
    c = F.concat(F.lit(" "), F.trim(F.regexp_replace(c, BETWEEN, " ")), F.lit(" "))
    for a, b in EQUIVALENT.items():
        c = F.replace(c, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(c)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def telling_words(canonicals: list[str]) -> str:
    """A pattern of words, one for each canonical text, of which a text must hold one in lower case to match any.

    A word counts if no other spelling becomes it, so that it stands in the text just as it does in the canonical form.
    If a canonical text has no such word, the pattern is empty, and any text may match.
    """
    made = {w for v in EQUIVALENT.values() for w in v.split()}
    found = {max((w for w in c.split() if w not in made), key=lambda w: (len(w), w), default="") for c in canonicals}
    return "" if "" in found else "|".join(sorted(found))


def known_texts(texts: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(licence, text) of all texts, and of those with a title also with each of their titles above."""
    texts = LICENSES if texts is None else texts
    return [*texts.items(), *((k, f"{title}\n{texts[k]}") for k, titles in TITLES.items() if k in texts for title in titles)]


def texts_of(spark, path: str) -> dict[str, str]:
    """The catalogue of a folder of plain texts in any store that Spark reads, by file name without its ending.

    For scan(texts=...): a catalogue's texts are broadcast as digests, so it is as large as the licences there are.
    """
    rows = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(\.txt)?$", 1).alias("k"), F.decode("content", "UTF-8").alias("t"))
    return {r["k"]: r["t"] for r in rows.collect()}


def known_digests(spark, texts: dict[str, str] | None = None) -> DataFrame:
    """license, digest, canonical of the known texts, each digest once; a table of fixed size."""
    rows = spark.createDataFrame(known_texts(texts), "license string, known string").dropDuplicates(["known"])
    return rows.select("license", digest(F.col("known")).alias("digest"), canonical(F.col("known")).alias("canonical"))


def scan(docs: DataFrame, text: str = "text", texts: dict[str, str] | None = None) -> DataFrame:
    """docs with `license`, the known licence that a whole text is (or null), and `notices`.

    `notices` are the distinct licences that single whole lines are, sorted; an empty array if none or for a null text.
    Known digests are few and fixed, so the join needs no shuffle, and rows pass one by one: repeated rows get equal
    answers. If docs has columns of these names, they are replaced.
    """
    spark = docs.sparkSession
    (key,) = fresh(docs, "digest")
    few = known_digests(spark, texts).collect()  # as few as the known texts
    few = [min((r for r in few if r["digest"] == d), key=lambda r: r["license"]) for d in sorted({r["digest"] for r in few})]
    known = spark.createDataFrame(few, "license string, digest string, canonical string")
    by_digest = F.create_map(*[F.lit(v) for r in few for v in (r["digest"], r["license"])])
    words = telling_words([r["canonical"] for r in few])
    able = lambda x: F.lower(x).rlike(words)
    # only texts and lines with a telling word are brought to their canonical form; no other can match
    lines = F.filter(F.split(F.col(text), "\n"), able)
    lines = F.filter(F.transform(lines, lambda x: F.element_at(by_digest, digest(x))), lambda x: x.isNotNull())
    lines = F.when(able(F.col(text)), lines)
    return (
        docs.drop("license", "notices")
        .withColumn("notices", F.coalesce(F.array_sort(F.array_distinct(lines)), F.array().cast("array<string>")))
        .withColumn(key, F.when(able(F.col(text)), digest(F.col(text))))
        .join(F.broadcast(known.select("license", F.col("digest").alias(key))), key, "left")
        .drop(key)
    )


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """doc_id, license (or null), n_notices and notices of every row; null, empty and repeated rows as in scan()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "license", F.size("notices").cast("long").alias("n_notices"), F.array_join("notices", ",").alias("notices"))


def _sql_canonical(x: str) -> str:
    c = f"regexp_replace(lower({x}), '(?m){COPYRIGHT_LINE}', '', 'g')"
    c = f"' ' || trim(regexp_replace({c}, '{BETWEEN}', ' ', 'g')) || ' '"
    for a, b in EQUIVALENT.items():
        c = f"replace({c}, ' {a} ', ' {b} ')"
    return f"trim({c})"


LICENSE_SCAN_SQL = f"""
WITH known AS (
  SELECT min(license) AS license, sha256({_sql_canonical("t")}) AS digest
  FROM (VALUES {", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in kv) + ")" for kv in known_texts())}) AS k(license, t) GROUP BY 2),
d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
l AS (SELECT DISTINCT rid, known.license FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) JOIN known ON known.digest = sha256({_sql_canonical("line")})),
n AS (SELECT rid, count(*) AS n, string_agg(license, ',' ORDER BY license) AS notices FROM l GROUP BY rid)
SELECT doc_id, known.license, coalesce(n.n, 0)::BIGINT AS n_notices, coalesce(n.notices, '') AS notices
FROM d LEFT JOIN known ON known.digest = sha256({_sql_canonical("text")}) LEFT JOIN n USING (rid)
"""

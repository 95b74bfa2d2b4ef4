"""Licence scan by canonical digests, in DataFrame operations only.

A text is brought to a canonical form: lower case, without copyright lines, with
equivalent spellings made one, and with everything but letters and digits turned
into single spaces, so it doesn't matter where lines were wrapped. A copyright line
says whose or from when: the word is followed by a sign, a year, a name or a
placeholder for one, so a wrapped line that goes on with "copyright notice" stays.
The SHA-256 of the canonical form is looked up among the digests of
known licences and notices, by a hash join. Entire texts are compared: a document
is looked up as a whole and, line by line, for notices that stand on their own.
Entire texts are known of those in TEXTS and, by digest, of those in ``license_digests``;
the other licences in NAMES are known by their notices only.

Scale: the known digests are a constant table of about 100 rows, so the join
is a broadcast. A unit whose canonical form is as long as no known one can't be one and
is left out before it is hashed; what remains is written with the row's id, joined and
brought back to the rows by that id.

Defined results: null counts as empty and matches nothing. Repeated rows are rows
of their own. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_digests import DIGESTS
from .tables import Scratch, read

#: Spellings that count as equal, as in public licence matching guidelines.
EQUIVALENT = {
    "licence": "license", "licenced": "licensed", "licences": "licenses", "sub-license": "sublicense", "sub license": "sublicense",
    "acknowledgement": "acknowledgment", "analogue": "analog", "authorisation": "authorization", "authorise": "authorize",
    "favour": "favor", "fulfil": "fulfill", "initialise": "initialize", "judgement": "judgment", "labour": "labor",
    "modifications": "modification", "non-infringement": "noninfringement", "non commercial": "noncommercial",
    "non-commercial": "noncommercial", "organisation": "organization", "per cent": "percent", "recognise": "recognize", "utilise": "utilize",
    "wilful": "willful", "&": "and", "https://": "http://",
}
#: Openings of a notice that all say "licensed under".
OPENINGS = r"^(?:(?:this|the) (?:work|software|project|program|file|code|library|document|content|material) is )?(?:licensed|released|distributed|published|available|made available) under (?:the terms (?:and conditions )?of )?(?:the |an? )?"
#: Names by which notices call a licence.
NAMES = {
    "MIT": ("MIT License", "MIT licence", "MIT", "Expat License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0", "Apache 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL version 2", "GNU GPL v2", "GPL v2", "GPLv2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL version 3", "GNU GPL v3", "GPL v3", "GPLv3", "GPL-3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL v2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL v3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL v3", "AGPL-3.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD-3-Clause"),
    "ISC": ("ISC License", "ISC"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "EPL-2.0"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0"),
    "CC0-1.0": ("CC0 1.0", "CC0", "Creative Commons Zero v1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,'
    " FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER"
    " LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal'
    " in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"
    " copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice"
    " and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"
    " and/or other materials provided with the distribution.\n\n"
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"
    " without specific prior written permission.\n\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED'
    " WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY"
    " DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF"
    " USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING"
    " NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of"
    " this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it"
    " freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original"
    " software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source"
    " versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any"
    " source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software,"
    " either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright"
    " laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit"
    " of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present"
    ' and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT'
    " LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR"
    " OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE"
    " SOFTWARE.\n\nFor more information, please refer to {0}"
)
_BOOST = (
    "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software"
    ' and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare'
    " derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in"
    " the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the"
    " Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object"
    ' code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE'
    " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE"
    " SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR"
    " OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{0}.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND'
    " FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF"
    " USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Texts of short licences, and notices that name none.
TEXTS = (
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies")),
    ("ISC", "ISC License\n\n" + _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies")),
    ("0BSD", _ISC.format("")), ("0BSD", "BSD Zero Clause License\n\n" + _ISC.format("")),
    *((name, title + rights + _BSD_HEAD + third + _BSD_TAIL) for name, titles, third in (
        ("BSD-2-Clause", ("", "BSD 2-Clause License\n\n", "The BSD 2-Clause License\n\n", "Simplified BSD License\n\n"), ""),
        ("BSD-3-Clause", ("", "BSD 3-Clause License\n\n", "The BSD 3-Clause License\n\n", "New BSD License\n\n"), _BSD_THIRD),
    ) for title in titles for rights in ("", "All rights reserved.\n\n")),
    ("Zlib", _ZLIB), ("Zlib", "zlib License\n\n" + _ZLIB), ("Zlib", "The zlib License\n\n" + _ZLIB),
    *(("Unlicense", _UNLICENSE.format(link)) for link in ("<https://unlicense.org>", "<https://unlicense.org/>", "<http://unlicense.org/>")),
    ("BSL-1.0", _BOOST),
    ("All-rights-reserved", "All rights reserved."), ("All-rights-reserved", "All rights are reserved."),
)
#: A line that states a copyright: the word with a sign, a year, a name or a placeholder after it, or a sign with either.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n(]*(?:copyright[ \t]*(?:\(c\)|©|&copy;|[0-9]{4}|by[ \t]|[:,<\[{])|\(c\)[ \t]*(?:copyright|[0-9]{4}|<|\[|\{)|©)[^\n]*$"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, letters and digits with single spaces."""
    text = F.lower(F.coalesce(text, F.lit("")))
    changed = F.regexp_replace(text, COPYRIGHT_LINE, " ")
    for spelling, one in EQUIVALENT.items():
        changed = F.regexp_replace(changed, _whole(spelling), one)
    # one pass tells whether any of the replacements can apply
    text = F.when(text.rlike("|".join(["copyright", r"\(c\)", "©", *EQUIVALENT])), changed).otherwise(text)
    text = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(text, OPENINGS, "licensed under ")


def _whole(spelling: str) -> str:
    return rf"\b{spelling}\b" if spelling[0].isalpha() and spelling[-1].isalpha() else spelling


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession, more: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """digest, license and length of the canonical form: of the built-in licences and ``more`` pairs (licence, text)."""
    notices = [(name, f"Licensed under the {spelling}.") for name, spellings in NAMES.items() for spelling in spellings]
    rows = spark.createDataFrame([*notices, *TEXTS, *more], "license string, text string")
    whole = spark.createDataFrame(DIGESTS, "license string, digest string, length int").select("digest", "license", "length")
    built = rows.select(digest(F.col("text")).alias("digest"), "license", F.length(canonical(F.col("text"))).alias("length"))
    return built.unionByName(whole).groupBy("digest").agg(F.min("license").alias("license"), F.max("length").alias("length"))


def license_scan(docs: DataFrame, licenses: DataFrame, scratch: Scratch, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Per row: the kept columns, whole_license (null: the text as a whole is none), n_notices (lines that
    are a licence or notice) and licenses (their names, sorted, comma-joined). ``licenses`` as from ``known``."""
    lengths = [r.length for r in licenses.select("length").distinct().collect()]  # of a constant table
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n", -1)
    # a text of one line is looked up once, as its line
    units = F.when(F.size(lines) > 1, F.concat(F.array(text), lines)).otherwise(F.array(F.lit(None).cast("string"), text))
    forms = F.transform(units, lambda u, i: F.struct(i.alias("at"), F.when(u.isNotNull(), canonical(u)).alias("form")))
    forms = F.transform(F.filter(forms, lambda u: F.length(u["form"]).isin(lengths)), lambda u: F.struct(u["at"].alias("at"), F.sha2(u["form"], 256).alias("digest")))
    rows = docs.select(F.struct(*keep).alias("kept"), (F.size(lines) == 1).alias("single"), forms.alias("units")).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.cut(rows, "units")
    # a constant table
    found = rows.where(F.size("units") > 0).select("row", "single", F.inline("units")).join(F.broadcast(licenses.select("digest", "license")), "digest")
    out = found.groupBy("row").agg(
        F.max(F.when((F.col("at") == 0) | F.col("single"), F.col("license"))).alias("whole_license"),
        F.count(F.when(F.col("at") > 0, F.col("license"))).alias("n_notices"),
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),
    )
    return rows.select("row", "kept").join(out, "row", "left").select("kept.*", "whole_license", F.coalesce("n_notices", F.lit(0)).alias("n_notices"), F.coalesce("licenses", F.lit("")).alias("licenses"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"), known(spark), Scratch(spark, "op6"))


def _sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    text = "lower(coalesce(t, ''))"
    text = f"regexp_replace({text}, {quote(COPYRIGHT_LINE)}, ' ', 'g')"
    for spelling, one in EQUIVALENT.items():
        text = f"regexp_replace({text}, {quote(_whole(spelling))}, {quote(one)}, 'g')"
    text = rf"trim(regexp_replace({text}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    text = f"regexp_replace({text}, {quote(OPENINGS)}, 'licensed under ')"
    notices = [(name, f"Licensed under the {spelling}.") for name, spellings in NAMES.items() for spelling in spellings]
    rows = ", ".join(f"({quote(name)}, {quote(t)})" for name, t in [*notices, *TEXTS])
    digests = ", ".join(f"({quote(name)}, '{found}')" for name, found, _ in DIGESTS)
    return f"""
WITH known AS (
  SELECT c, min(license) AS license FROM (
    SELECT sha256({text}) AS c, license FROM (VALUES {rows}) AS v(license, t) UNION ALL SELECT c, license FROM (VALUES {digests}) AS w(license, c)
  ) b GROUP BY c
),
u AS (
  SELECT doc_id, 0 AS part, coalesce(text, '') AS t FROM documents
  UNION ALL SELECT doc_id, 1, unnest(string_split(coalesce(text, ''), chr(10))) FROM documents
),
f AS (SELECT doc_id, part, license FROM (SELECT doc_id, part, sha256({text}) AS c FROM u) n JOIN known USING (c)),
g AS (
  SELECT doc_id, max(license) FILTER (part = 0) AS whole_license, count(*) FILTER (part = 1) AS n_notices,
         array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses
  FROM f GROUP BY doc_id
)
SELECT d.doc_id, g.whole_license, coalesce(g.n_notices, 0) AS n_notices, coalesce(g.licenses, '') AS licenses
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""


SQL = _sql()

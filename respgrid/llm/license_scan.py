"""License scans by canonical digest lookup (DataFrame functions only).

A text is brought to a canonical form - lower case, copyright lines and list marks removed,
equivalent spellings made one, punctuation and white space reduced to single blanks - and the SHA-256
of the whole form is hash-joined to the digests of known licences, which go through the same form.

The registry is a table of whole licence texts and of notices. Its size is checked before it is
broadcast; a larger one is joined by a shuffle. Notices, which are forms of one line, are looked for among a
text's lines where it lies: only lines as long as some notice are digested.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from respgrid.llm.common import text_or_empty

#: Up to so many licences are broadcast; so many notices at most are held in a query's expressions.
BROADCAST_ROWS, MOST_NOTICES = 100_000, 5_000
#: The folder of longer licences, a file each, named by its id.
LONGER = "licenses"

# Spellings that count as equal, each pair (variant, canonical), as whole words.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

# Whole texts of short public licences, without their copyright lines; longer ones are in files. Notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(""", provided that the above copyright notice and this permission notice appear in all copies.""", ".")
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be
appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
3. This notice may not be removed or altered from any source distribution."""
BSD_LIST = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
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
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
MIT_0 = MIT.replace(""", subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.
""", ".\n")
KNOWN = [
    ("MIT-0", MIT_0),
    ("MIT-0", "MIT No Attribution\n" + MIT_0),
    ("BSD-2-Clause", BSD_LIST + BSD_WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD_LIST + BSD_WARRANTY),
    ("BSD-3-Clause", BSD_LIST + BSD_NAMES + BSD_WARRANTY),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + BSD_LIST + BSD_NAMES + BSD_WARRANTY),
    ("Unlicense", UNLICENSE),
    ("Unlicense", UNLICENSE + "\nFor more information, please refer to <https://unlicense.org>"),
    ("Unlicense", UNLICENSE + "\nFor more information, please refer to <http://unlicense.org/>"),
    ("BSL-1.0", BOOST),
    ("MIT", MIT),
    ("MIT", "MIT License\n" + MIT),
    ("MIT", "The MIT License (MIT)\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n" + ISC),
    ("0BSD", ZERO_BSD),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n" + ZLIB),
]
# How notices name licences, and what they say of them.
NOTICED = [
    ("MIT", ["the MIT License"]),
    ("Apache-2.0", ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0"]),
    ("BSD-2-Clause", ["the BSD 2-Clause License"]),
    ("BSD-3-Clause", ["the BSD 3-Clause License"]),
    ("GPL-2.0", ["the GNU General Public License, version 2", "the GPLv2"]),
    ("GPL-3.0", ["the GNU General Public License, version 3", "the GPLv3"]),
    ("LGPL-2.1", ["the GNU Lesser General Public License, version 2.1", "the LGPLv2.1"]),
    ("LGPL-3.0", ["the GNU Lesser General Public License, version 3", "the LGPLv3"]),
    ("AGPL-3.0", ["the GNU Affero General Public License, version 3", "the AGPLv3"]),
    ("MPL-2.0", ["the Mozilla Public License, Version 2.0", "the MPL 2.0"]),
    ("ISC", ["the ISC License"]),
    ("Zlib", ["the zlib License"]),
    ("BSL-1.0", ["the Boost Software License, Version 1.0"]),
    ("CC0-1.0", ["CC0 1.0"]),
    ("CC-BY-4.0", ["CC BY 4.0"]),
    ("CC-BY-SA-4.0", ["CC BY-SA 4.0"]),
    ("CC-BY-NC-4.0", ["CC BY-NC 4.0"]),
    ("CC-BY-ND-4.0", ["CC BY-ND 4.0"]),
]
SAYINGS = ["Released under {}.", "Licensed under {}.", "This work is licensed under {}.", "This software is licensed under {}.", "This file is licensed under {}.", "Distributed under {}."]


def built_in() -> list[tuple[str, str]]:
    """(license_id, text) of all licences and notices that come with the library."""
    files = sorted(resources.files("respgrid.llm").joinpath(LONGER).iterdir(), key=lambda f: f.name)
    longer = [(f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in files if f.name.endswith(".txt")]
    notices = [(key, saying.format(name)) for key, names in NOTICED for name in names for saying in SAYINGS]
    tags = [(key, f"SPDX-License-Identifier: {key}{end}") for key, _ in NOTICED for end in (["-only", "-or-later"] if "GPL" in key else [""])]
    return KNOWN + longer + notices + tags


def _spelled(form: Column, pairs: list[tuple[str, str]]) -> Column:
    out = form
    for variant, one in pairs:
        out = F.regexp_replace(out, rf"(?<!\S){variant}(?!\S)", one)
    some = "|".join(variant for variant, _ in pairs)
    return F.when(form.rlike(rf"(?<!\S)(?:{some})(?!\S)"), out).otherwise(form)


#: A line of at most so many characters that begins with copyright and goes on with a year, a sign or a name is a copyright line.
COPYRIGHT = (
    r"^(?=.{1,200}$)[^\p{L}\p{N}©(]*(?:(?i)portions )?(?:"
    r"(?i:copyright|copr\.|©|\(c\))(?![\p{L}\p{N}])(?=.*(?i:[12][0-9]{3}|\(c\)|©|<year>|\[yyyy\]|(?:authors|contributors)\W*$))"
    r"|(?=.*\p{Ll})(?i:copyright)\W+(?:by )?(?!(?i:notice|holder|owner|law|and\b|or\b))(?:[\p{Lu}][\p{L}\p{N}.&'’-]*[, ]*){1,6}$"
    r"|(?i:all rights reserved)\W*$)"
)
MARK = r"^\W*(?:[0-9]{1,2}|[a-z]|[ivx]{1,4})[.)](?=\s)"


def canonical_lines(text: Column) -> Column:
    """The canonical forms of a text's lines, without those that are empty or copyright lines."""
    # One step a transform, so that each step's result is computed once.
    lines = F.filter(F.split(text, "[\n\r]+"), lambda x: ~x.rlike(COPYRIGHT))
    plain = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), MARK, " "), r"[^\p{L}\p{N}]+", " ")))
    return F.transform(F.filter(plain, lambda x: x != ""), lambda x: _spelled(x, SPELLINGS))


def whole_form(lines: Column) -> Column:
    """A text's canonical form; pairs of words that a line break had split are made one, too."""
    pairs = [x for x in SPELLINGS if " " in x[0]]
    return F.transform(F.array(F.array_join(lines, " ")), lambda x: _spelled(x, pairs))[0]


def registry(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """The given licences (license_id, text), else the built-in ones, as digests without repeats."""
    rows = spark.createDataFrame(built_in() if known is None else known, "license_id string, text string")
    return digests(rows)


def digests(licenses: DataFrame) -> DataFrame:
    """digest, license_id, notice (whether the form is one line's) and points (its length) for each form that isn't empty."""
    lines = licenses.select("license_id", canonical_lines(text_or_empty()).alias("lines"))
    forms = lines.select("license_id", whole_form(F.col("lines")).alias("form"), (F.size("lines") == 1).alias("notice")).where("form != ''")
    return forms.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"), F.max("notice").alias("notice"), F.max(F.length("form")).alias("points"))


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, text_digest, license_id, notice_ids, n_notices.

    license_id: the licence that the whole text is, else null. notice_ids: sorted, without
    repeats, those that one of its lines is as a whole; n_notices counts such lines. known comes from digests.

    Defined cases: a null or empty text, or one of copyright lines and punctuation only, has the
    digest of the empty form and no licence. Where two licences have equal forms, the first id
    by name is given. Rows that repeat a doc_id are scanned each for itself. An empty table gives an empty
    result; further columns are ignored.
    """
    notices = known.where("notice").select("digest", "license_id", "points").limit(MOST_NOTICES + 1).collect()
    if len(notices) > MOST_NOTICES:
        raise ValueError(f"more than {MOST_NOTICES} notices: scan for them in parts")
    whole = known.select(F.col("digest").alias("text_digest"), "license_id")
    whole = F.broadcast(whole) if known.count() <= BROADCAST_ROWS else whole
    lines = docs.select("doc_id", canonical_lines(text_or_empty()).alias("lines"))
    none = F.array().cast("array<string>")
    found = none
    if notices:
        ids = F.create_map(*[F.lit(x) for r in notices for x in (r["digest"], r["license_id"])])
        as_long = F.filter("lines", lambda x: F.length(x).isin(sorted({r["points"] for r in notices})))
        listed = F.filter(F.transform(as_long, lambda x: F.sha2(whole_form(F.array(x)), 256)), lambda d: d.isin([r["digest"] for r in notices]))
        found = F.transform(listed, lambda d: F.element_at(ids, d))
    rows = lines.select("doc_id", F.sha2(whole_form(F.col("lines")), 256).alias("text_digest"), found.alias("__found"))
    return rows.join(whole, "text_digest", "left").select(
        "doc_id", "text_digest", "license_id", F.array_sort(F.array_distinct("__found")).alias("notice_ids"), F.size("__found").cast("long").alias("n_notices")
    )

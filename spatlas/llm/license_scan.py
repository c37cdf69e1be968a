"""Licence scan by canonical digests, from SQL functions alone.

A text is normalised (case, copyright lines, equivalent spellings, punctuation and space) and hashed; the hashes of whole
texts and of their lines are joined to those of known licences. The table of known digests is made from the texts below, or from
those that a caller gives, by the same expressions; only a list of a driver's own program is broadcast, so its size is known."""

from __future__ import annotations

import re
from functools import reduce
from itertools import product
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatlas.llm.common import row_uid

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
    "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
    "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
    "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
#: Public licence texts and the usual one-line notices.
KNOWN = [
    ("MIT", _MIT), ("MIT", "MIT License\n\nCopyright (c) holders\n\n" + _MIT), ("ISC", _ISC), ("ISC", "ISC License\n\nCopyright (c) holders\n\n" + _ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("all-rights-reserved", "All rights reserved."),
]


def whole_texts() -> list[tuple[str, str]]:
    """The texts of the folder ``licenses``, with the forms in which they are usual: with and without what follows or precedes the terms."""
    texts = {f.stem: f.read_text() for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
    out, bsd = [], texts.pop("BSD-3-Clause")
    third = re.search(r"3\. Neither.*?permission\.\n\n", bsd, re.S).group()
    for name, terms in (("BSD-3-Clause", bsd), ("BSD-2-Clause", bsd.replace(third, ""))):
        title = f"{name[4]}-Clause License\n\n"
        for head, reserved, numbered, holder in product(("", f"BSD {title}", f"The BSD {title}"), ("", "All rights reserved.\n\n"), (True, False), ("HOLDER", "OWNER")):
            body = terms if numbered else re.sub(r"(?m)^[123]\. ", "* ", terms)
            out.append((name, head + reserved + body.replace("COPYRIGHT HOLDER OR", f"COPYRIGHT {holder} OR")))
    for name, text in texts.items():
        forms = {text}
        for end in (r"END OF TERMS AND CONDITIONS", r"Exhibit A - Source Code Form License Notice", r"EXHIBIT A -Mozilla Public License"):
            for cut in re.finditer(end, text):
                forms |= {text[: cut.start()], text[: cut.end()]}
        forms.add(text.replace("Copyright [yyyy] [name of copyright owner]", ""))
        if name == "CC-BY-4.0":
            parts = re.split(r"(?m)^=+$", text)
            forms |= {"".join(parts[:-1]), parts[-2]}
        out += [(name, x) for x in sorted(forms)]
    return out


KNOWN += whole_texts()
#: (pattern, replacement) after lower-casing, in this order; both Java's and RE2's syntax.
STEPS = [
    (r"(?m)^[^\n]*(copyright[^\n]*[0-9]{4}|copyright *(\(c\)|©)|\(c\) *[0-9]{4}|© *[0-9]{4})[^\n]*$", ""),
    (r"licence", "license"), (r"sub-license", "sublicense"), (r"non-infringement", "noninfringement"), (r"https", "http"), (r"&", " and "),
    (r"[^a-z0-9]+", " "),
]


def canonical(lowered: Column) -> Column:
    """Of a text in lower case."""
    (pattern, replacement), *rest = STEPS
    marked = lowered.contains("copyright") | lowered.contains("(c)") | lowered.contains("©")
    out = F.when(marked, F.regexp_replace(lowered, pattern, replacement)).otherwise(lowered)
    for pattern, replacement in rest:
        out = F.replace(out, F.lit(pattern), F.lit(replacement)) if re.fullmatch(r"[\w&-]+", pattern) else F.regexp_replace(out, pattern, replacement)
    return F.trim(out)


def anchors(known: list[tuple[str, str]]) -> list[str] | None:
    """Words of which every text with a known canonical form has one, in lower case and whole; None if a form has no such word.

    Words that a spelling step can make (or a part of which) are not taken, as the text may have them in another spelling."""
    found = set()
    for _, text in known:
        form = canonical_text(text)
        safe = [w for w in form.split() if not any(r.strip() and r.strip() in w for _, r in STEPS)]
        if not safe:
            return None
        if not any(a in form.split() for a in found):
            found.add(max(safe, key=lambda w: (len(w), w)))
    return sorted(found)


def canonical_text(text: str) -> str:
    """The same in Python, for tables of known texts and tests."""
    out = text.lower()
    for pattern, replacement in STEPS:
        out = re.sub(pattern, replacement, out)
    return out.strip(" ")


def license_scan(documents: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, text_license (of the whole text, or null), notices (the licences of its
    lines, sorted, comma-joined, '' if none), n_notices (lines that match), uid.

    A null or empty text matches nothing. Repeated rows get equal results. A text known under two names gets the first
    by name. Lines are cut at line feeds; other columns aren't read; an empty table gives an empty result."""
    spark = documents.sparkSession
    known = sorted(set(KNOWN if known is None else known))
    words = anchors(known)
    possible = lambda x: F.lit(True) if words is None else reduce(Column.__or__, [x.contains(w) for w in words])
    texts = spark.createDataFrame(known, "license string, known string")
    digests = F.broadcast(texts.select("license", F.sha2(canonical(F.lower("known")), 256).alias("digest")).groupBy("digest").agg(F.min("license").alias("license")))
    docs = documents.select(F.col("doc_id").cast("long"), "text", row_uid().alias("uid"))
    lowered = docs.select("doc_id", "uid", F.lower("text").alias("low")).where((F.length("low") > 0) & possible(F.col("low")))
    lines = F.transform(F.filter(F.split("low", "\n"), possible), lambda line: F.sha2(canonical(line), 256))
    units = lowered.select("doc_id", "uid", F.sha2(canonical(F.col("low")), 256).alias("whole"), F.posexplode_outer(lines).alias("at", "line"))
    whole, line = digests.select(F.col("digest").alias("whole"), F.col("license").alias("text_license")), digests.withColumnRenamed("digest", "line")
    found = units.join(line, "line", "left").join(whole, "whole", "left").where("license IS NOT NULL OR text_license IS NOT NULL")
    by_doc = found.groupBy(F.col("doc_id").alias("d"), F.col("uid").alias("u")).agg(
        F.min("text_license").alias("text_license"), F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"), F.countDistinct(F.when(F.col("license").isNotNull(), F.col("at"))).alias("n_notices")
    )
    rows = docs.select("doc_id", "uid").join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("uid") == F.col("u")), "left")
    return rows.select("doc_id", "text_license", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), "uid")


def _sql_canonical(text: str) -> str:
    for pattern, replacement in STEPS:
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return f"trim({text}, ' ')"


_VALUES = ", ".join(f"('{a}', '{canonical_text(b)}')" for a, b in KNOWN)
ORACLE = f"""
WITH k AS (SELECT t, min(l) AS l FROM (VALUES {_VALUES}) v(l, t) GROUP BY t),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
w AS (SELECT r, {_sql_canonical('lower(text)')} AS t FROM d WHERE length(text) > 0),
n AS (SELECT r, {_sql_canonical('lower(x)')} AS t FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d WHERE length(text) > 0)),
m AS (SELECT r, count(*) AS c, string_agg(DISTINCT l, ',' ORDER BY l) AS s FROM n JOIN k USING (t) GROUP BY r)
SELECT doc_id, k.l AS text_license, coalesce(m.s, '') AS notices, coalesce(m.c, 0)::BIGINT AS n_notices
FROM d LEFT JOIN w USING (r) LEFT JOIN k ON k.t = w.t LEFT JOIN m USING (r)"""

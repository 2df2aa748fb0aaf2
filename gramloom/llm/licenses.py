"""Licence scan by sentence rules: normalised sentences are looked up among known licence sentences, and the sequence of
their identifiers is matched against ordered licence rules. Built-in column functions only; one narrow pass, no shuffle.

Sentences end at . ! ? : ; before white space, at blank lines, and at a line end before anything but a small letter or a
figure (so wrapped lines are joined). They're compared in lower case with only letters and figures. Known sentences are cut
in the same way, so one may be several sentences of a text; it may also be wrapped before a capital, and the list number
("1.", "(b)") of one that stands in a list goes with it. A line with an SPDX identifier ends there. Known sentences of a text are written as a sequence, "_" standing for a run of others; a rule matches its identifiers side by side, and what it
matched can't match again. Rules are tried in their order, so a licence's full text comes before its short notices.

Defined cases: a null or empty text has no sentence and no licence; a known sentence that no rule used is listed in
unmatched; rows with equal or null ids are scanned on their own; an empty table gives an empty result; other columns
aren't read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.llm.common import text_or_empty

_MIT = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
]
_APACHE = [
    "you may not use this file except in compliance with the License.",
    "You may obtain a copy of the License at",
    "http://www.apache.org/licenses/LICENSE-2.0",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "See the License for the specific language governing permissions and limitations under the License.",
]
_BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
]
_GPL_TAIL = [
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "See the GNU General Public License for more details.",
]

#: identifier -> sentences that are known by it.
SENTENCES: dict[str, list[str]] = {
    "mit-grant": [_MIT[0]], "mit-notice": [_MIT[1]], "mit-as-is": [_MIT[2]], "mit-liability": [_MIT[3]],
    "mit-name": ["Released under the MIT License.", "Licensed under the MIT License.", "This work is licensed under the MIT License.", "SPDX-License-Identifier: MIT", "MIT License"],
    "apache2-name": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "This work is licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "apache2-grant": ["Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "apache2-comply": [_APACHE[0]], "apache2-obtain": [_APACHE[1]], "apache2-url": [_APACHE[2], "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"], "apache2-basis": [_APACHE[3]], "apache2-see": [_APACHE[4]],
    "bsd-grant": [_BSD[0]], "bsd-source": [_BSD[1]], "bsd-binary": [_BSD[2]],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd-name": ["SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License.", "Released under the BSD License."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "gpl3-name": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl2-name": ["Licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "gpl-grant": ["This program is free software;", "This program is free software:"],
    "gpl2-later": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl3-later": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"],
    "gpl2-choice": ["either version 2 of the License, or (at your option) any later version."],
    "gpl-hope": [_GPL_TAIL[0]], "gpl-implied": [_GPL_TAIL[1]], "gpl-see": [_GPL_TAIL[2]],
    "lgpl-name": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "mpl2-grant": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "mpl2-url": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "ccby-name": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "ccbysa-name": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "ccbync-name": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0-name": ["Licensed under CC0 1.0.", "This work is dedicated to the public domain."],
    "reserved": ["All rights reserved."],
}

#: Forms that only the scan knows, not the SQL.
FORMS = {"mpl2-url": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."]}

#: What stands in numbered lists.
LISTED = {"bsd-source", "bsd-binary", "bsd-endorse"}

#: Licences and the identifiers that make them, in the order in which they are tried.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("Apache-2.0", ["apache2-grant", "apache2-comply", "apache2-obtain", "apache2-url", "apache2-basis", "apache2-see"]),
    ("Apache-2.0", ["apache2-grant", "apache2-comply", "apache2-url", "apache2-basis", "apache2-see"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-2.0-or-later", ["gpl-grant", "gpl2-later", "gpl-hope", "gpl-implied", "gpl-see"]),
    ("GPL-2.0-or-later", ["gpl-grant", "gpl-terms", "gpl2-choice", "gpl-hope", "gpl-implied", "gpl-see"]),
    ("GPL-3.0-or-later", ["gpl-grant", "gpl3-later", "gpl-hope", "gpl-implied", "gpl-see"]),
    ("GPL-2.0-or-later", ["gpl-grant", "gpl2-later"]),
    ("GPL-2.0-or-later", ["gpl-grant", "gpl-terms", "gpl2-choice"]),
    ("GPL-3.0-or-later", ["gpl-grant", "gpl3-later"]),
    ("MPL-2.0", ["mpl2-grant", "mpl2-url"]),
    ("MPL-2.0", ["mpl2-grant"]),
    ("MIT", ["mit-grant"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache2-grant"]),
    ("MIT", ["mit-name"]),
    ("Apache-2.0", ["apache2-name"]),
    ("BSD-3-Clause", ["bsd-name"]),
    ("GPL-3.0-only", ["gpl3-name"]),
    ("GPL-2.0-only", ["gpl2-name"]),
    ("LGPL-3.0-only", ["lgpl-name"]),
    ("CC-BY-4.0", ["ccby-name"]),
    ("CC-BY-SA-4.0", ["ccbysa-name"]),
    ("CC-BY-NC-4.0", ["ccbync-name"]),
    ("CC0-1.0", ["cc0-name"]),
]

# A sentence's end is \x1f. The patterns mean the same to Java's and to RE2's engine.
_ENDS = "([.!?:;])[ \\t\\n\\r\\f\\x0B]+"
_BLANK = "\\n[ \\t\\r]*\\n[ \\t\\r\\n]*"
_WRAPPED = "[ \\t\\r]*\\n[ \\t\\r#*/;-]*([\\p{Ll}0-9(])"
_NOISE = "[^\\p{L}\\p{N}\\x1f]+"
# For the scan, a line end that doesn't end a sentence for sure is \x1e, and \x1d stands around what is known.
_SPDX = "(SPDX-License-Identifier:[ \\t]*[A-Za-z0-9.+-]+)[ \\t\\r*/#>-]*\\n"
_SCAN_NOISE = "[^\\p{L}\\p{N}\\x1e\\x1f]+"
_LIST = "(?:[0-9]{1,2}|[a-z]|[ivx]{2,4})[ \\x1f]"


def normalise(sentence: str) -> str:
    return re.sub(r"[\W_]+", " ", sentence.lower()).strip()


def known() -> dict[str, str]:
    return {normalise(s): k for k, sentences in SENTENCES.items() for s in sentences}


def pieces(sentence: str) -> list[str]:
    """The normalised sentences that a text's cutter makes of a known sentence."""
    return [n for part in re.sub(_ENDS, "\\1\x1f", sentence).split("\x1f") if (n := normalise(part))]


def scan_table() -> dict[str, str]:
    return known() | {normalise(s): k for k, forms in FORMS.items() for s in forms}


def _known_pattern() -> str:
    """All known sentences, the longest first: breaks of wrapped lines anywhere, breaks of sentences where the cutter makes them."""
    forms = {normalise(s): "[ \\x1e\\x1f]".join(p.replace(" ", "[ \\x1e]") for p in pieces(s)) for table in (SENTENCES, FORMS) for of in table.values() for s in of}
    listed = "(?:" + "|".join(forms[s] for s, k in scan_table().items() if k in LISTED) + ")(?:[\\x1e\\x1f])"
    return f"(?<=[\\x1e\\x1f])(?:{_LIST}(?={listed}))?({'|'.join(forms[s] for s in sorted(forms, key=len, reverse=True))})(?=[\\x1e\\x1f])"


def sentences(text: Column) -> Column:
    """The normalised sentences of a text, in their order; what is known is one sentence."""
    marked = F.regexp_replace(F.translate(text, "\x1d\x1e", "__"), _SPDX, "$1\x1f")
    marked = F.regexp_replace(marked, _ENDS, "$1\x1f")
    marked = F.regexp_replace(F.regexp_replace(marked, _BLANK, "\x1f"), _WRAPPED, " $1")
    plain = F.regexp_replace(F.lower(F.translate(marked, "\n", "\x1e")), _SCAN_NOISE, " ")
    plain = F.concat(F.lit("\x1f"), plain, F.lit("\x1f"))
    plain = F.regexp_replace(F.regexp_replace(plain, "[ \\x1e]*\\x1f[ \\x1e\\x1f]*", "\x1f"), " *\\x1e[ \\x1e]*", "\x1e")
    parts = F.split(F.regexp_replace(plain, _known_pattern(), "\x1d$1\x1d"), "\x1d")
    return F.flatten(F.transform(parts, lambda p, k: F.when(k % 2 == 1, F.array(F.translate(p, "\x1e\x1f", "  "))).otherwise(F.filter(F.split(p, "[\\x1e\\x1f]"), lambda s: s != ""))))


def match(sequence: Column) -> Column:
    """Rewrites " id id _ id " by the rules; what they matched stands as <licence>."""
    for licence, ids in RULES:
        sequence = F.replace(sequence, F.lit(f" {'  '.join(ids)} "), F.lit(f" <{licence}> "))
    return sequence


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_sentences, n_known, sequence, licences (distinct, in their order), unmatched."""
    table = F.create_map(*[F.lit(x) for pair in scan_table().items() for x in pair])
    rows = docs.select(F.col("doc_id"), sentences(text_or_empty()).alias("s"))
    rows = rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.transform("s", lambda s: F.coalesce(F.try_element_at(table, s), F.lit("_"))).alias("ids"))
    rows = rows.withColumn("n_known", F.size(F.filter("ids", lambda x: x != "_")).cast("long"))
    sequence = F.regexp_replace(F.array_join("ids", " "), "_( _)+", "_")
    rows = rows.withColumn("sequence", F.when(F.col("n_known") > 0, sequence).otherwise(F.lit("")))
    # Each identifier gets blanks of its own, so that neighbours can match one after the other.
    matched = rows.withColumn("m", match(F.concat(F.lit(" "), F.replace(F.col("sequence"), F.lit(" "), F.lit("  ")), F.lit(" "))))
    left = F.filter(F.split("m", " +"), lambda x: (x != "") & (x != "_") & ~x.startswith("<"))
    return matched.select(
        "doc_id", "n_sentences", "n_known", "sequence",
        F.array_join(F.array_distinct(F.regexp_extract_all("m", F.lit("<([^>]+)>"), F.lit(1))), ",").alias("licences"), F.array_join(left, ",").alias("unmatched"),
    )


def oracle_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = f"MAP {{{', '.join(f'{quote(s)}: {quote(k)}' for s, k in known().items())}}}"
    matched = "' ' || replace(sequence, ' ', '  ') || ' '"
    for licence, ids in RULES:
        matched = f"replace({matched}, {quote(' ' + '  '.join(ids) + ' ')}, {quote(f' <{licence}> ')})"
    marked = rf"regexp_replace(coalesce(text, ''), {quote(_ENDS)}, '\1' || chr(31), 'g')"
    marked = rf"regexp_replace(regexp_replace({marked}, {quote(_BLANK)}, chr(31), 'g'), {quote(_WRAPPED)}, ' \1', 'g')"
    plain = f"regexp_replace(lower(replace({marked}, chr(10), chr(31))), {quote(_NOISE)}, ' ', 'g')"
    return f"""
WITH s AS (
  SELECT doc_id, list_filter(list_transform(string_split({plain}, chr(31)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents
), i AS (
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, list_transform(s, lambda x: coalesce({table}[x], '_')) AS ids FROM s
), q AS (
  SELECT doc_id, n_sentences, CAST(len(list_filter(ids, lambda x: x <> '_')) AS BIGINT) AS n_known, ids FROM i
), r AS (
  SELECT doc_id, n_sentences, n_known, CASE WHEN n_known > 0 THEN regexp_replace(array_to_string(ids, ' '), '_( _)+', '_', 'g') ELSE '' END AS sequence FROM q
), m AS (
  SELECT *, {matched} AS m FROM r
)
SELECT doc_id, n_sentences, n_known, sequence,
       coalesce(array_to_string(list_transform(list_filter(list_transform(regexp_extract_all(m, '<([^>]+)>', 1), lambda x, k: struct_pack(x := x, k := k)), lambda p: list_position(regexp_extract_all(m, '<([^>]+)>', 1), p.x) = p.k), lambda p: p.x), ','), '') AS licences,
       coalesce(array_to_string(list_filter(string_split_regex(m, ' +'), lambda x: x <> '' AND x <> '_' AND NOT starts_with(x, '<')), ','), '') AS unmatched
FROM m
"""

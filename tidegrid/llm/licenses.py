"""Licence scan by sentence rules: normalised sentences map to identifiers, identifier sequences to licences.

A text is cut into sentences; each is normalised and looked up in a table of known licence sentences; the identifiers
that were found, in order, are matched against ordered rules, and what a rule matches is used up. All of it is built-in
expressions on the row itself: no shuffle, one pass, the tables are literals of the plan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and licence notices, and the identifier of each.
SENTENCES: dict[str, str] = {
    "Licensed under the Apache License, Version 2.0.": "apache-2-notice",
    "Licensed under the Apache License, Version 2.0 (the \"License\");": "apache-2-notice",
    "you may not use this file except in compliance with the License.": "apache-2-compliance",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "apache-2-copy",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.": "apache-2-as-is",
    "See the License for the specific language governing permissions and limitations under the License.": "apache-2-see",
    "Released under the MIT License.": "mit-notice",
    "Licensed under the MIT License.": "mit-notice",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:": "mit-grant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "mit-condition",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.": "mit-as-is",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.": "mit-liability",
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3-notice",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl-3-or-later",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "gpl-2-or-later",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": "gpl-warranty",
    "See the GNU General Public License for more details.": "gpl-see",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd-grant",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "bsd-source",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": "bsd-binary",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd-endorse",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc-grant",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc-4-notice",
    "Licensed under CC BY 4.0.": "cc-by-4-notice",
    "Licensed under CC BY-SA 4.0.": "cc-by-sa-4-notice",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by-4-notice",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc-4-notice",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2-notice",
    "This is free and unencumbered software released into the public domain.": "unlicense-notice",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa-4-notice",
    "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.": "cc0-deed",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "agpl-3-or-later",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": "lgpl-2-1-or-later",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.": "gpl-2-only",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/": "epl-2-notice",
    "Distributed under the Boost Software License, Version 1.0.": "bsl-1-notice",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.": "0bsd-grant",
    "This software is provided 'as-is', without any express or implied warranty.": "zlib-as-is",
    "In no event will the authors be held liable for any damages arising from the use of this software.": "zlib-liability",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:": "zlib-grant",
}

# Other layouts of sentences above, as their notices are printed.
LAYOUTS: dict[str, str] = {
    "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0": "apache-2-copy",
}

# Rules in order of trial, the sentence sequence and the licence it stands for.
RULES: list[tuple[tuple[str, ...], str]] = [
    (("apache-2-notice", "apache-2-compliance", "apache-2-copy", "apache-2-as-is", "apache-2-see"), "Apache-2.0"),
    (("apache-2-notice",), "Apache-2.0"),
    (("mit-grant", "mit-condition", "mit-as-is", "mit-liability"), "MIT"),
    (("mit-notice",), "MIT"),
    (("gpl-3-or-later", "gpl-warranty", "gpl-see"), "GPL-3.0-or-later"),
    (("gpl-2-or-later", "gpl-warranty", "gpl-see"), "GPL-2.0-or-later"),
    (("gpl-3-or-later",), "GPL-3.0-or-later"),
    (("gpl-2-or-later",), "GPL-2.0-or-later"),
    (("gpl-3-notice",), "GPL-3.0-only"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("isc-grant",), "ISC"),
    (("cc-by-nc-4-notice",), "CC-BY-NC-4.0"),
    (("cc-by-sa-4-notice",), "CC-BY-SA-4.0"),
    (("cc-by-4-notice",), "CC-BY-4.0"),
    (("mpl-2-notice",), "MPL-2.0"),
    (("unlicense-notice",), "Unlicense"),
    (("cc0-deed",), "CC0-1.0"),
    (("agpl-3-or-later",), "AGPL-3.0-or-later"),
    (("lgpl-2-1-or-later",), "LGPL-2.1-or-later"),
    (("gpl-2-only",), "GPL-2.0-only"),
    (("epl-2-notice",), "EPL-2.0"),
    (("bsl-1-notice",), "BSL-1.0"),
    (("0bsd-grant",), "0BSD"),
    (("zlib-as-is", "zlib-liability", "zlib-grant"), "Zlib"),
]

#: A sentence ends at . ! ? : or ; before white space, or at a blank line.
SENTENCE_END = r"(?<=[.!?:;])(?:[\x20\t\r\x0B\f]*\n[\x20\t\r\x0B\f\n]*|[\x20\t\r\x0B\f]+)|\n[\x20\t\r]*\n[\x20\t\r\n]*"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(sentence: str) -> str:
    """normalise() for a table entry."""
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in sentence.translate(str.maketrans(_UPPER, _LOWER)))
    return " ".join(kept.split())


def normalise(sentence: Column) -> Column:
    """A-Z lower-cased, every run of other than a-z and 0-9 one space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(sentence, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def scan_licenses(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[tuple[str, ...], str]] = RULES) -> DataFrame:
    """Rows (doc_id, text, ...) to (doc_id, sentence_ids, licenses, unmatched), one row for each input row.

    sentence_ids holds the identifiers of the known sentences in the text, in order; licenses those that the rules give,
    in order of the text; unmatched the identifiers that no rule used. All are arrays, empty if there is nothing.

    A sentence may run over several lines; if it isn't known as a whole, each of its lines is looked up alone, so a
    notice on a line of its own is found whether or not the line before it ends in a stop. Null or empty text gives
    empty arrays; repeated rows give repeated rows; other columns are ignored; an empty table gives no rows. Texts of
    any length are read whole. Lines that aren't near the length of a known sentence are not normalised at all.
    """
    table, joined = {plain(k): v for k, v in sentences.items()}, {}
    for k, v in [*sentences.items(), *((k, v) for k, v in LAYOUTS.items() if v in sentences.values())]:
        pieces = [plain(x) for x in re.split(SENTENCE_END, k)]
        if len(pieces) > 1:  # a table sentence that SENTENCE_END cuts: its pieces, one after the other, are put together
            joined["".join(f"<{table.setdefault(x, f'#{len(table)}')}>" for x in pieces)] = v
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv]).cast("map<string,string>")
    shortest = min(len(k) for k in table)
    find = lambda s: F.when(F.length(s) >= shortest, F.element_at(known, normalise(s)))
    lines = lambda s: F.transform(F.split(s, "\n"), find)
    one = lambda s: F.when(F.instr(s, "\n") == 0, F.array(find(s))).otherwise(F.coalesce(F.when(find(s).isNotNull(), F.array(find(s))), lines(s)))
    pieces = docs.select("doc_id", F.flatten(F.transform(F.split(F.coalesce("text", F.lit("")), SENTENCE_END), one)).alias("pieces"))
    whole = F.array_join(F.transform("pieces", lambda x: F.coalesce(F.concat(F.lit("<"), x, F.lit(">")), F.lit("|"))), "")
    for sequence, name in joined.items():
        whole = F.replace(whole, F.lit(sequence), F.lit(f"<{name}>"))
    cut = F.exists("pieces", lambda x: F.coalesce(x.startswith("#"), F.lit(False)))
    found = F.when(cut, F.regexp_extract_all(whole, F.lit("<([^#>][^>]*)>"), 1)).otherwise(F.filter("pieces", lambda x: x.isNotNull()))
    ids = pieces.select("doc_id", found.alias("sentence_ids"))
    # a chain: each identifier as <id>; a rule turns its sequence into [licence]
    chain = F.array_join(F.transform("sentence_ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    for sequence, name in rules:
        chain = F.replace(chain, F.lit("".join(f"<{x}>" for x in sequence)), F.lit(f"[{name}]"))
    return ids.withColumn("chain", F.when(F.size("sentence_ids") > 0, chain).otherwise(F.lit(""))).select(
        "doc_id",
        "sentence_ids",
        F.regexp_extract_all("chain", F.lit(r"\[([^\]]+)\]"), 1).alias("licenses"),
        F.regexp_extract_all("chain", F.lit("<([^>]+)>"), 1).alias("unmatched"),
    )


def license_digest(docs: DataFrame) -> DataFrame:
    """The query's columns: doc_id, n_sentences, sentence_ids, licenses and unmatched, lists joined by commas."""
    return scan_licenses(docs).select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        *[F.array_join(c, ",").alias(c) for c in ("sentence_ids", "licenses", "unmatched")],
    )


def license_sql() -> str:
    """The same in DuckDB SQL, by unnesting sentences and lines."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(plain(k))}, {quote(v)})" for k, v in SENTENCES.items())
    norm = lambda x: f"trim(regexp_replace(translate({x}, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    chain = "coalesce(c.chain, '')"
    for sequence, name in RULES:
        chain = f"replace({chain}, {quote(''.join(f'<{x}>' for x in sequence))}, {quote(f'[{name}]')})"
    # RE2 has no look-behind: mark the ends of sentences first, then cut at the marks
    ends = r"regexp_replace(regexp_replace(coalesce(text, ''), '([.!?:;])(?:[\x20\t\r\x0B\f]*\n[\x20\t\r\x0B\f\n]*|[\x20\t\r\x0B\f]+)', '\1' || chr(1), 'g'), '\n[\x20\t\r]*\n[\x20\t\r\n]*', chr(1), 'g')"
    return f"""
WITH known(norm, id) AS (SELECT DISTINCT * FROM (VALUES {values})),
base AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
cut AS (SELECT r, unnest(string_split(s, chr(1))) AS s, unnest(range(len(string_split(s, chr(1))))) AS k FROM (SELECT r, {ends} AS s FROM base)),
whole AS (SELECT r, k, s, id FROM cut LEFT JOIN known ON {norm('s')} = norm),
parts AS (
  SELECT r, k, 0 AS j, id FROM whole WHERE id IS NOT NULL
  UNION ALL
  SELECT l.r, l.k, l.j, known.id FROM (SELECT r, k, unnest(string_split(s, chr(10))) AS l, unnest(range(len(string_split(s, chr(10))))) AS j FROM whole WHERE id IS NULL AND contains(s, chr(10))) l
  JOIN known ON {norm('l.l')} = norm),
c AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY k, j) AS ids, string_agg('<' || id || '>', '' ORDER BY k, j) AS chain FROM parts GROUP BY r),
d AS (SELECT doc_id, coalesce(c.n, 0)::BIGINT AS n_sentences, coalesce(c.ids, '') AS sentence_ids, {chain} AS chain FROM base LEFT JOIN c USING (r))
SELECT doc_id, n_sentences, sentence_ids,
  array_to_string(regexp_extract_all(chain, '\\[([^\\]]+)\\]', 1), ',') AS licenses,
  array_to_string(regexp_extract_all(chain, '<([^>]+)>', 1), ',') AS unmatched
FROM d
"""

"""License scans by Dice coefficient over word bigrams, with DataFrame functions only.

Text is normalised to lower case words of letters and digits. A unit matches
a template if ``2 * |A & B| / (|A| + |B|)`` of their sets of word bigrams is
THRESHOLD or more. The units of a document are its lines, its paragraphs of
several lines, the whole text, and, for each template, the windows of as many
words as the template has that start at one of its bigrams (cut off at the end
of the text). So a notice is found where it stands alone, and also inside a
line or paragraph, or wrapped over lines.

As the intersection is no larger than either set, only templates of between
t / (2 - t) and (2 - t) / t times the unit's bigrams can match, and a document
must hold t / (2 - t) of a template's bigrams anywhere. Templates that fail
these bounds are pruned before units are made; most documents end there.

Each row is decided on its own, from its whole text: no shuffle, no join, no
group. The bigram hashes of the templates go into the plan as literals, so
their number is checked (MOST_BIGRAMS).

Defined cases: a null text counts as empty; an empty text or unit of one word
matches nothing; of several matches the highest coefficient is the document's
license, then the first by name; repeated rows get equal results; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Bigrams of all templates together, at most.
MOST_BIGRAMS = 200_000

# License notices and texts as their publishers word them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # Whole texts.
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.'),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)


def load_templates(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """Templates from a folder of text files, each named after its license (a list of licenses, so of bounded size)."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[A-Za-z]+$", "")
    files = spark.read.format("binaryFile").load(folder).select(name.alias("license"), F.decode("content", "utf-8").alias("text"))
    return sorted(map(tuple, files.collect()))


def normalised(text: Column) -> Column:
    """Lower-case letters, digits, single spaces and line ends."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " "))


def sequence_of(unit: Column) -> Column:
    """The word bigrams of a normalised unit in order, as hashes; null if it has no two words."""
    words = F.array_remove(F.split(unit, "[ \n]+"), "")
    pairs = F.transform(F.array(words), lambda w: F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
    return F.get(pairs, F.lit(0))


def bigrams(unit: Column) -> Column:
    """The distinct word bigrams of a normalised unit, as hashes."""
    return F.array_distinct(sequence_of(unit))


def _template_literal(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> tuple[Column, list[int]]:
    """The templates as one constant array of (license, n, length, bigrams), and all their bigrams."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "i int, license string, text string")
    unit = normalised(F.col("text"))
    found = [r for r in rows.select("i", "license", bigrams(unit).alias("b"), F.size(sequence_of(unit)).alias("length")).orderBy("i").collect() if r["b"]]
    if sum(len(r["b"]) for r in found) > MOST_BIGRAMS:
        raise ValueError(f"templates of over {MOST_BIGRAMS} bigrams")
    values = lambda b: F.expr(f"cast(split('{','.join(map(str, b))}', ',') as array<bigint>)")
    literal = F.array(*[F.struct(F.lit(r["license"]).alias("license"), F.lit(len(r["b"])).alias("n"), F.lit(r["length"]).alias("length"), values(r["b"]).alias("bigrams")) for r in found])
    return literal, sorted({x for r in found for x in r["b"]})


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, matches of each row: matches is an array of (dice, license), one per matching unit and template."""
    known, every = _template_literal(docs.sparkSession, templates)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    rows = docs.select("doc_id", normalised(F.coalesce("text", F.lit(""))).alias("t"))
    in_order = rows.select("doc_id", "t", sequence_of(F.col("t")).alias("b"))
    # bigrams of any template: a set lookup each
    held = F.array_distinct(F.expr(f"filter(b, x -> x in ({','.join(map(str, every))}))"))
    hits = in_order.select("*", held.alias("hits"))
    may = F.filter(known, lambda t: (F.size("hits") >= low * t["n"]) & (F.size(F.array_intersect(F.col("hits"), t["bigrams"])) >= low * t["n"]))
    pruned = hits.select("doc_id", "t", "b", may.alias("may"))

    def dice(unit: Column, t: Column) -> Column:
        return (F.lit(2.0) * F.size(F.array_intersect(unit, t["bigrams"]))) / (F.size(unit) + t["n"])

    def close(scores: Column) -> Column:
        return F.filter(scores, lambda m: m["dice"] >= threshold)

    def matches(unit: Column) -> Column:
        fit = F.filter("may", lambda t: (t["n"] >= low * F.size(unit)) & (t["n"] <= high * F.size(unit)))
        return close(F.transform(fit, lambda t: F.struct(dice(unit, t).alias("dice"), t["license"].alias("license"))))

    def in_windows(t: Column) -> Column:
        starts = F.filter(F.transform("b", lambda x, i: F.when(F.array_contains(t["bigrams"], x), i)), lambda i: i.isNotNull())
        window = lambda i: F.array_distinct(F.slice("b", i + 1, t["length"]))
        return close(F.transform(starts, lambda i: F.struct(dice(window(i), t).alias("dice"), t["license"].alias("license"))))

    paragraphs = F.split("t", r"\n *\n[ \n]*")
    several = F.filter(paragraphs, lambda p: F.contains(p, F.lit("\n")))
    units = F.concat(F.split("t", "\n"), several, F.when(F.size(paragraphs) > 1, F.array("t")).otherwise(F.array().cast("array<string>")))
    unit_sets = F.filter(F.transform(units, bigrams), lambda b: F.size(b) > 0)
    nothing = F.array().cast("array<struct<dice:double,license:string>>")
    found = pruned.select("doc_id", F.when(F.size("may") > 0, F.concat(F.flatten(F.transform(unit_sets, matches)), F.flatten(F.transform("may", in_windows)))).otherwise(nothing).alias("matches"))
    ordered = found.select("doc_id", "matches", F.array_max(F.transform("matches", lambda m: m["dice"])).alias("dice"))
    best = F.array_min(F.transform(F.filter("matches", lambda m: m["dice"] == F.col("dice")), lambda m: m["license"]))
    return ordered.select("doc_id", best.alias("license"), "dice", "matches")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document scanned; licenses are all that any unit matches."""
    from .common import table

    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",")
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "license", "dice", names.alias("licenses"))


def _values() -> str:
    return ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))


_NORMAL = r"lower(regexp_replace({}, '[^\pL\pN\n]+', ' ', 'g'))"
_BIGRAMS = "list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"
_WORDS = r"list_filter(string_split_regex({}, '[ \n]+'), lambda x: x <> '')"
ORACLE_SQL = rf"""
WITH templates(i, license, text) AS (VALUES {_values()}),
known AS (SELECT i, license, len(w) - 1 AS length, list_distinct({_BIGRAMS.format(w="w")}) AS b FROM (SELECT i, license, {_WORDS.format(_NORMAL.format("text"))} AS w FROM templates)),
grams AS (SELECT i, license, length, len(b) AS n, unnest(b) AS g FROM known),
rows AS (SELECT row_number() OVER () AS r, doc_id, {_NORMAL.format("coalesce(text, '')")} AS t FROM documents),
sequences AS (SELECT r, {_BIGRAMS.format(w="w")} AS b FROM (SELECT r, {_WORDS.format("t")} AS w FROM rows)),
places AS (SELECT r, unnest(b) AS g, unnest(range(1, len(b) + 1)) AS p FROM sequences),
held AS (SELECT r, i, p, n FROM places JOIN grams USING (g)),
may AS (SELECT r, i FROM (SELECT r, i, any_value(n) AS n, count(DISTINCT g) AS c FROM places JOIN grams USING (g) GROUP BY r, i) WHERE c >= {THRESHOLD / (2 - THRESHOLD)} * n),
windows AS (
  SELECT r, i, list_distinct(s.b[h.p : h.p + k.length - 1]) AS u FROM held h JOIN may USING (r, i) JOIN sequences s USING (r) JOIN known k USING (i)
), parts AS (SELECT r, t, string_split(t, chr(10)) AS lines, string_split_regex(t, '\n *\n[ \n]*') AS paragraphs FROM rows),
units AS (
  SELECT r, unnest(lines || list_filter(paragraphs, lambda p: contains(p, chr(10))) || CASE WHEN len(paragraphs) > 1 THEN [t] ELSE [] END) AS u FROM parts
), sets AS (SELECT r, list_distinct({_BIGRAMS.format(w="w")}) AS b FROM (SELECT r, {_WORDS.format("u")} AS w FROM units)),
matches AS (
  SELECT r, license, 2.0::DOUBLE * len(list_intersect(s.b, k.b)) / (len(s.b) + len(k.b)) AS dice
  FROM sets s JOIN known k ON len(s.b) > 0 AND len(k.b) BETWEEN {THRESHOLD / (2 - THRESHOLD)} * len(s.b) AND {(2 - THRESHOLD) / THRESHOLD} * len(s.b)
  UNION ALL
  SELECT r, license, 2.0::DOUBLE * len(list_intersect(w.u, k.b)) / (len(w.u) + len(k.b)) AS dice FROM windows w JOIN known k USING (i)
), best AS (
  SELECT r, max(dice) AS dice, arg_min(license, (-dice, license)) AS license, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM matches WHERE dice >= {THRESHOLD} GROUP BY r
)
SELECT doc_id, license, dice, coalesce(licenses, '') AS licenses FROM rows LEFT JOIN best USING (r)
"""

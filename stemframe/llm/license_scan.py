"""License scans; DataFrame functions only, in one pass without a shuffle.

Documents are cut into overlapping windows of word shingles. MinHash bands over the windows retrieve
templates, and a retrieved template counts only if the window holds at least ``percent`` of its shingles,
compared as strings.

Templates of similar length share a window length and a step: a window is so much longer than a template
that each occurrence lies in one as a whole, and no longer, so that its similarity to the template stays
high. From the least similarity of a true match follows how many bands (of one minimum each) are needed to
miss at most one in ``1 / MISS``.

A window has a template's minimum in a band only if it holds the very shingle that gives this minimum. So
a stretch of text without any such shingle has no window to look at, and elsewhere the minima are taken
for the windows over these places; which windows retrieve a template is the same as if all were taken.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 5
MISS = 1e-6
#: Shingles that are worked on at a time; a multiple of every step.
CHUNK = 512

# Public notices and license texts, as they are printed in works under these licenses.
TEMPLATES = {
    "Apache-2.0 (short)": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 (short)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 (short)": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0 (short)": "Licensed under CC BY 4.0.",
    "GPL-3.0 (short)": "This work is licensed under the GNU General Public License, version 3.",
    "MIT (short)": "Released under the MIT License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; none for a null text."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _hashes(w: Column) -> Column:
    """A hash of the five words from each place on."""

    def five(h: Column) -> Column:
        n = F.size(h)
        pairs = F.zip_with(F.slice(h, 1, n - 1), F.slice(h, 2, n - 1), lambda a, b: F.xxhash64(a, b))
        fours = _let(pairs, lambda p: F.zip_with(F.slice(p, 1, n - 3), F.slice(p, 3, n - 3), lambda a, b: F.xxhash64(a, b)))
        return F.zip_with(F.slice(fours, 1, n - 4), F.slice(h, 5, n - 4), lambda a, b: F.xxhash64(a, b))

    none = F.array().cast("array<bigint>")
    return F.when(F.size(w) < WIDTH, none).otherwise(_let(F.transform(w, lambda x: F.xxhash64(x)), five))


def _shingles(w: Column, first: Column | int, n: Column | int) -> Column:
    """``n`` shingles as strings from place ``first`` (0-based) on."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, first + i + 1, WIDTH), " "))


@dataclass(frozen=True)
class Geometry:
    """Window length and step in shingles, and number of bands, for templates of ``low`` to ``high`` shingles."""

    window: int
    step: int
    bands: int
    templates: tuple  # (name, shingles, minima by band)


def geometry(low: int, high: int, percent: int) -> tuple[int, int, int]:
    """(window, step, bands) for templates of ``low`` to ``high`` distinct shingles.

    >>> geometry(1, 1, 80)
    (1, 1, 1)
    """
    step = 1 << max(0, (low // 4).bit_length() - 1)
    window = high + step - 1
    need = math.ceil(percent * low / 100)
    similarity = need / (low + window - need)
    return window, step, 1 if similarity >= 1 else math.ceil(math.log(MISS) / math.log(1 - similarity))


def _seed(k: int) -> int:
    """The k-th seed, a signed 64-bit integer (a Weyl sequence)."""
    s = (k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    return s - (1 << 64) if s >= 1 << 63 else s


def prepare(spark: SparkSession, templates: dict[str, str], percent: int) -> list[Geometry]:
    """Shingles and minima of the template library, by length. The library is configuration: it fits the driver."""
    if not templates:
        return []
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string").select("name", words(F.col("text")).alias("w"))
    n = F.size("w") - (WIDTH - 1)
    rows = rows.filter(F.size("w") >= WIDTH).select("name", _hashes(F.col("w")).alias("h"), _shingles(F.col("w"), F.lit(0), n).alias("s")).collect()
    rows = sorted(rows, key=lambda r: (len(set(r["s"])), r["name"]))
    found: list[Geometry] = []
    while rows:
        low = len(set(rows[0]["s"]))
        group = [r for r in rows if len(set(r["s"])) <= max(low, 1.25 * low)]
        window, step, bands = geometry(low, max(len(r["s"]) for r in group), percent)
        found.append(Geometry(window, step, bands, tuple((r["name"], sorted(set(r["s"])), [min(x ^ _seed(k) for x in r["h"]) for k in range(bands)]) for r in group)))
        rows = rows[len(group) :]
    return found


def _in_chunk(w: Column, geometries: list[Geometry], percent: int) -> Column:
    """Names of the templates that a stretch of words holds."""
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    no_names, no_places = F.array().cast("array<string>"), F.array().cast("array<int>")

    def decisive(gs: list[Geometry]) -> Column:
        """The shingles that give the templates' minima."""
        return longs(sorted({t[2][k] ^ _seed(k) for g in gs for t in g.templates for k in range(g.bands)}))

    def of_class(g: Geometry, h: Column) -> Column:
        minima = F.array(*[longs(t[2][k] for t in g.templates) for k in range(g.bands)])
        seeds, step = longs(_seed(k) for k in range(g.bands)), F.lit(g.step)
        places = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(decisive([g]), F.get(h, i)))
        over = F.transform(places, lambda p: F.sequence((F.ceil(F.greatest(p - (g.window - 1), F.lit(0)) / step) * step).cast("int"), p, step))
        starts = F.filter(F.array_distinct(F.flatten(over)), lambda at: at < CHUNK)
        agrees = lambda k, own: F.array_contains(F.get(minima, k), F.array_min(F.transform(own, lambda x: x.bitwiseXOR(F.get(seeds, k)))))
        retrieved = F.filter(starts, lambda at: _let(F.slice(h, at + 1, g.window), lambda own: F.exists(F.sequence(F.lit(0), F.lit(g.bands - 1)), lambda k: agrees(k, own))))
        library = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, s)).alias("s")) for name, s, _ in g.templates])

        def verified(windows: Column) -> Column:
            own = F.transform(windows, lambda at: _shingles(w, at, F.least(F.lit(g.window), F.size(h) - at)))
            holds = lambda t: F.exists(own, lambda s: 100 * F.size(F.array_intersect(t["s"], s)) >= percent * F.size(t["s"]))
            return F.when(F.size(windows) == 0, no_names).otherwise(F.transform(F.filter(library, holds), lambda t: t["name"]))

        return _let(F.when(F.size(places) == 0, no_places).otherwise(retrieved), verified)

    hit = lambda h: F.arrays_overlap(h, decisive(geometries))
    return _let(_hashes(w), lambda h: F.when(hit(h), F.concat(*[of_class(g, h) for g in geometries])).otherwise(no_names))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, n_words (runs of letters and digits), licenses (sorted names), n_licenses.

    A template is found where one window holds at least ``percent`` of its distinct five-word shingles;
    case and punctuation don't matter. Templates below five words can't be found.

    * A null or empty text has no words and no licenses; without templates nothing is found.
    * Equally good templates are all reported; repeated rows and null ids are carried through.
    * An empty table gives no rows; other columns are ignored.
    """
    geometries = prepare(docs.sparkSession, TEMPLATES if templates is None else templates, percent)
    rows = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    n = F.size("w")
    if geometries:
        reach = CHUNK + max(g.window for g in geometries) + WIDTH - 2
        chunks = F.sequence(F.lit(0), F.floor(F.greatest(n - WIDTH, F.lit(0)) / CHUNK).cast("int"))
        found = F.flatten(F.transform(chunks, lambda c: _let(F.slice(F.col("w"), c * CHUNK + 1, reach), lambda w: _in_chunk(w, geometries, percent))))
    else:
        found = F.array().cast("array<string>")
    rows = rows.select("doc_id", n.cast("long").alias("n_words"), F.array_sort(F.array_distinct(found)).alias("licenses"))
    return rows.withColumn("n_licenses", F.size("licenses").cast("long"))


def oracle(templates: dict[str, str] = TEMPLATES, percent: int = 80) -> str:
    """DuckDB SQL for the query: every window of every document against every template, without MinHash."""
    quoted = ", ".join("('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in sorted(templates.items()))
    lengths = sorted({len(_plain(v)) - WIDTH + 1 for v in templates.values() if len(_plain(v)) >= WIDTH})
    cases, rest = [], lengths
    while rest:
        group = [n for n in rest if n <= max(rest[0], 1.25 * rest[0])]
        window, step, _ = geometry(group[0], group[-1], percent)
        cases += [f"({n}, {window}, {step})" for n in group]
        rest = rest[len(group) :]
    grams = "array_to_string(w[i:i + 4], ' ')"
    return rf"""WITH tpl AS (SELECT name, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM (VALUES {quoted}) v(name, text)),
  geo(n, win, step) AS (VALUES {", ".join(cases)}),
  tg AS (SELECT DISTINCT name, n, {grams} AS gram FROM (SELECT name, w, len(w) - 4 AS n, unnest(range(1, len(w) - 3)) AS i FROM tpl)),
  need AS (SELECT name, count(*) AS wanted FROM tg GROUP BY name),
  d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
  dg AS (SELECT doc_id, i - 1 AS pos, {grams} AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
  m AS (SELECT doc_id, name, gram, pos, win, step FROM dg JOIN tg USING (gram) JOIN geo USING (n)),
  x AS (SELECT doc_id, name, gram, unnest(range(CAST(ceil(greatest(pos - win + 1, 0) / step) AS BIGINT), CAST(floor(pos / step) AS BIGINT) + 1)) AS win_no FROM m),
  hit AS (SELECT DISTINCT doc_id, name FROM (SELECT doc_id, name, win_no, count(DISTINCT gram) AS got FROM x GROUP BY ALL) JOIN need USING (name) WHERE 100 * got >= {percent} * wanted),
  g AS (SELECT doc_id, list_sort(list(name)) AS licenses FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(licenses, []::VARCHAR[]) AS licenses, coalesce(len(licenses), 0) AS n_licenses FROM d LEFT JOIN g USING (doc_id)"""


def _plain(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()

"""Operator 3: license scans with MinHash bands over overlapping windows, native SQL only.

Texts and templates become words: ASCII letters in lower case, and every character that
is no letter or digit (comment marks, punctuation, line ends) a gap.  Five-word shingles
are hashed with built-in functions.

A text is cut into windows of ``WINDOW`` shingles, one every ``STRIDE``; a template is cut
into sections of ``SECTION = WINDOW - STRIDE + 1`` shingles, so a section of a copy lies
whole in one window, wherever it begins.  The sketch of either is a MinHash signature:
for each of some fixed 64-bit numbers c the least ``hash XOR c``, which is the least of a
random order.  It is made of the signatures of strides, so each shingle is looked at once
a number.  ``ROWS`` signature values make a band.  A copy that holds a share of
``CONTAINMENT`` of the template does so in one section at least; that section and its
window have a Jaccard similarity of ``least_similarity()`` or more, so with
``bands_for()`` bands they share none with a chance below ``MISS``.

A template of fewer shingles than a section is a small part of any window.  Its bands
have one row and are as many as its window has shingles, which amounts to an index of
its shingles.

A document that shares a band with a template is a candidate.  Candidates' shingles are
compared as strings with all of the template's, and a license is reported where the
found share of its distinct shingles is high enough.

Defined results: null and empty texts, and texts shorter than a shingle, match nothing;
rows that repeat a ``doc_id`` count as one document; templates shorter than a shingle
are refused, templates of a repeated id are one template's parts; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math
import random
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, CONTAINMENT = 5, 0.8
#: Shingles of a window, between two windows, and of a template's section.
WINDOW, STRIDE = 96, 24
SECTION = WINDOW - STRIDE + 1
#: Signature values of a band, and the chance of a miss that is allowed.
ROWS, MISS, SEED = 2, 1e-3, 42

#: Public notices and texts; a caller may pass any table of templates.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("mit-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc-text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd-3-clause-text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("zlib-text", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense-text", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache-2.0-header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-3.0-header", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("mpl-2.0-header", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
)

GAP = r"[^\p{L}\p{N}]+"


def least_similarity(containment: float = CONTAINMENT) -> float:
    """Jaccard similarity of a window and a section of which it holds that share."""
    return containment * SECTION / (WINDOW + (1 - containment) * SECTION)


def bands_for(miss: float = MISS, containment: float = CONTAINMENT, rows: int = ROWS) -> int:
    """Bands that a section and its window share none of with a chance below ``miss``."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - least_similarity(containment) ** rows)))


def _words(text):
    return F.filter(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), GAP), lambda w: w != "")


def _bound(value, body):
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _shingles(words):
    """Hashes of the shingles, from the words' hashes (empty for fewer words)."""
    last = F.size(words) - SHINGLE
    of = lambda h: F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(SHINGLE))))
    return F.when(last >= 0, _bound(F.transform(words, lambda w: F.xxhash64(w)), of)).otherwise(F.array().cast("array<bigint>"))


def _shingle_strings(words):
    every = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(SHINGLE))))
    return F.when(F.size(words) >= SHINGLE, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def _orders(bands: int) -> list[int]:
    rnd = random.Random(SEED)
    return [rnd.getrandbits(64) - (1 << 63) for _ in range(ROWS * bands)]


def _signature(hashes, bands: int):
    least = lambda c: F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(c).cast("long"))))
    return F.array(*map(least, _orders(bands)))


def _band_keys(signatures: list, bands: int):
    """Band keys of the union of the sets that the signatures belong to (null ones are of empty sets)."""
    value = lambda j: F.least(*(F.get(s, j) for s in signatures)) if len(signatures) > 1 else F.get(signatures[0], j)
    return F.array(*(F.xxhash64(F.lit(b), *(value(ROWS * b + r) for r in range(ROWS))) for b in range(bands)))


def window_bands(hashes, bands: int):
    """The band keys of all windows of a text's shingles."""
    # element by element: a slice would read the whole array each time
    places = lambda s: F.sequence(s * STRIDE, F.least(s * STRIDE + STRIDE, F.size(hashes)) - 1)
    strides = F.transform(F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / STRIDE).cast("int")), lambda s: F.transform(places(s), lambda i: F.get(hashes, i)))
    per = WINDOW // STRIDE
    windows = lambda m: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(m) - per)), lambda w: _band_keys([F.get(m, w + k) for k in range(per)], bands))
    keys = F.flatten(_bound(F.transform(strides, lambda s: _signature(s, bands)), windows))
    return F.when(F.size(hashes) > 0, keys).otherwise(F.array().cast("array<bigint>"))


def section_bands(hashes, bands: int):
    """The band keys of a template's sections; the last one ends with the template."""
    starts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(hashes) / SECTION).cast("int") - 1), lambda k: F.least(k * SECTION, F.size(hashes) - SECTION))
    keys = lambda at: _bound(_signature(F.slice(hashes, at + 1, F.lit(SECTION)), bands), lambda m: _band_keys([m], bands))
    return F.array_distinct(F.flatten(F.transform(starts, keys)))


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license_id string, text string")


def _prepared(templates: DataFrame, bands: int) -> DataFrame:
    """license_id, its shingles as strings, and its band keys, by parts."""
    t = templates.select("license_id", _words("text").alias("words"))
    short = t.where(F.size("words") < SHINGLE).select("license_id").first()
    if short:
        raise ValueError(f"the template {short[0]} has fewer than {SHINGLE} words")
    t = t.select("license_id", _shingle_strings(F.col("words")).alias("wanted"), _shingles(F.col("words")).alias("hashes"))
    keys = F.when(F.size("hashes") < SECTION, F.array_distinct("hashes")).otherwise(section_bands(F.col("hashes"), bands))
    return common.materialize(t.select("license_id", "wanted", keys.alias("bands")), "license-templates")


def scan(docs: DataFrame, templates: DataFrame | None = None, containment: float = CONTAINMENT, miss: float = MISS) -> DataFrame:
    """doc_id, license_id, n_shingles, n_found and containment of every license found."""
    bands = bands_for(miss, containment)
    known = _prepared(templates if templates is not None else default_templates(docs.sparkSession), bands)
    keys = common.materialize(known.select("license_id", F.explode("bands").alias("band")).distinct(), "license-bands")
    # a shingle is the one-row band of the short notices
    every = _bound(_words("text"), lambda w: _bound(_shingles(w), lambda h: F.concat(h, window_bands(h, bands))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode_outer(every).alias("band"))
    found = common.join_small(rows, keys, ["band"], ["doc_id"]).select("doc_id", "license_id").distinct()
    found = common.materialize(found, "license-candidates")
    wanted = known.groupBy("license_id").agg(F.array_distinct(F.flatten(F.collect_list("wanted"))).alias("wanted"))
    # candidates only: the words of a document that shares a band, and the templates that it shares one with
    ids = found.groupBy("doc_id").agg(F.collect_set("license_id").alias("licenses"))
    texts = docs.select(F.col("doc_id").cast("long").alias("own_id"), "text").join(ids, F.col("own_id").eqNullSafe(F.col("doc_id")))
    strings = texts.select("doc_id", _bound(_words("text"), _shingle_strings).alias("strings"), F.explode_outer("licenses").alias("license_id"))
    shared = common.join_small(strings, common.materialize(wanted, "license-shingles"), ["license_id"], ["doc_id"])
    got = shared.select("doc_id", "license_id", F.size("wanted").alias("n_shingles"), F.explode(F.array_intersect("wanted", "strings")).alias("shingle")).distinct()
    out = got.groupBy("doc_id", "license_id", "n_shingles").agg(F.count("*").cast("int").alias("n_found"))
    return out.where(F.col("n_found") >= containment * F.col("n_shingles")).withColumn("containment", F.round(F.col("n_found") / F.col("n_shingles"), 4))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


QUERIES = {"op3_license_scan": op3_license_scan}

_VALUES = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in TEMPLATES)
#: Exact containment of every template in every document.
ORACLES = {
    "op3_license_scan": f"""
WITH t(license_id, text) AS (VALUES {_VALUES}),
w AS (
  SELECT license_id AS key, NULL::BIGINT AS doc_id, list_filter(string_split_regex(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM t
  UNION ALL
  SELECT NULL, doc_id, list_filter(string_split_regex(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') FROM documents
), s AS (
  SELECT DISTINCT key, doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
  FROM (SELECT key, doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), n AS (SELECT key, CAST(count(*) AS INTEGER) AS n_shingles FROM s WHERE key IS NOT NULL GROUP BY key)
SELECT d.doc_id, t.key AS license_id, n_shingles, CAST(count(*) AS INTEGER) AS n_found, round(count(*) / n_shingles, 4) AS containment
FROM s t JOIN s d ON t.shingle = d.shingle AND t.key IS NOT NULL AND d.key IS NULL JOIN n ON n.key = t.key
GROUP BY d.doc_id, t.key, n_shingles HAVING count(*) >= 0.8 * n_shingles
"""
}

"""License scan (native): normalised text against licence templates by the Dice coefficient over word bigrams.

Units of a document are its whole text, its paragraphs and its lines.  A unit's number of bigrams bounds the coefficient, so
units of a size that fits no template are dropped by their word count alone.  The others must hold one of some keywords (without
any of a template's, too few of its bigrams can be shared) and as many template bigrams as their size asks for; what is left
is compared, and only with templates of a fitting size.  Everything happens within the row: no shuffle.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices and texts as licences word them.
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
APACHE_HEAD = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
APACHE_WARRANTY = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
GPL_3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
GPL_2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
AGPL_3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
LGPL_2 = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
GPL_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."
#: A notice that several licences share stands for the family: their names with a slash between.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", MIT_GRANT),
    ("MIT", MIT_NOTICE),
    ("MIT", MIT_WARRANTY),
    ("MIT", f"{MIT_GRANT} {MIT_NOTICE} {MIT_WARRANTY}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", APACHE_HEAD),
    ("Apache-2.0", f"{APACHE_HEAD} {APACHE_WARRANTY}"),
    ("Apache-2.0", APACHE_WARRANTY),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", GPL_3),
    ("GPL-3.0", f"{GPL_3} {GPL_WARRANTY}"),
    ("GPL-2.0", GPL_2),
    ("GPL-2.0", f"{GPL_2} {GPL_WARRANTY}"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", LGPL_2),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", AGPL_3),
    ("BSD-2-Clause/BSD-3-Clause", BSD_GRANT),
    ("BSD-2-Clause/BSD-3-Clause", BSD_WARRANTY),
    ("BSD-2-Clause/BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", f"{BSD_GRANT} {BSD_TWO} {BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{BSD_GRANT} {BSD_TWO} {BSD_THIRD} {BSD_WARRANTY}"),
    ("BSD-3-Clause", BSD_THIRD),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", ISC_GRANT),
    ("ISC", f"{ISC_GRANT} {ISC_WARRANTY}"),
    ("Zlib", ZLIB),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: What is neither a letter, a digit nor above ASCII stands for a space; line ends are kept apart where they matter.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PARAGRAPH = r"\n[\x20\t\r]*\n"


def template_words(text: str) -> list[str]:
    return "".join(c if c in LOWER + "0123456789" or c > "\x7f" else " " for c in (x.lower() if x in UPPER else x for x in text)).split()


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def size_bounds(size: int, least: float) -> tuple[int, int]:
    """Fewest and most bigrams of a unit whose coefficient with a template of `size` can reach `least`."""
    return math.ceil(size * least / (2 - least) - 1e-9), math.floor(size * (2 - least) / least + 1e-9)


def needed(size: int, least: float) -> int:
    """Bigrams that a unit must share with a template of `size` for the coefficient to reach `least`, at the least."""
    return math.ceil(least * (size + size_bounds(size, least)[0]) / 2 - 1e-9)


def keywords(templates, least: float) -> list[str]:
    """Words of which a unit must hold one: of each template enough that too few bigrams are left without them.

    Words that few templates use and long ones come first.
    """
    shared = Counter(w for _, t in templates for w in set(template_words(t)))
    out: set[str] = set()
    for _, t in templates:
        words, grams, without = template_words(t), template_bigrams(t), set()
        for w in sorted(set(words), key=lambda w: (-min(len(w), 8), shared[w], w)):
            if sum(not without & set(g.split(" ")) for g in grams) < needed(len(grams), least):
                break
            without.add(w)
        out |= without
    return sorted(out)


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), MARKS, " "))


def units(text: Column) -> Column:
    """Normalised, different units of a text: whole, paragraphs and lines."""
    parts = F.concat(F.array(text), F.split(text, PARAGRAPH, -1), F.split(text, "\n", -1))
    return F.array_distinct(F.transform(F.array_distinct(parts), normal))


def bigrams(words: Column) -> Column:
    n = F.size(words) - 1
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def scan(docs: DataFrame, least: float = 0.8, templates=TEMPLATES) -> DataFrame:
    """Of every row of `docs` (doc_id, text): matches, an array of (dice, license, unit), best first.

    One entry for each different normalised unit and template with 2 * shared / (bigrams of both) >= `least`; bigrams
    count as often as they occur.  Units of fewer than two words match nothing; null and empty texts have no matches;
    repeated rows stay repeated.  Ties in dice go by license, then unit.
    """
    if not templates:
        raise ValueError("no templates")
    sizes = [len(template_bigrams(t)) for _, t in templates]
    bounds = [size_bounds(n, least) for n in sizes]
    low, high = max(1, min(b[0] for b in bounds)), max(b[1] for b in bounds)
    all_grams, wanted = sorted({g for _, t in templates for g in template_bigrams(t)}), keywords(templates, least)
    text = F.coalesce(F.col("text"), F.lit(""))
    split = F.transform(units(text), lambda u: F.struct(u.alias("unit"), F.split(u, " ").alias("words")))
    fitting = F.filter(split, lambda u: (F.size(u["words"]) - 1).between(low, high) & F.exists(u["words"], lambda w: w.isin(wanted)))
    paired = F.transform(fitting, lambda u: F.struct(u["unit"].alias("unit"), bigrams(u["words"]).alias("grams")))
    # A template that fits has least / (2 - least) of the unit's size at least, so the unit shares that part of its own bigrams.
    near = F.filter(paired, lambda u: F.size(F.filter(u["grams"], lambda g: g.isin(all_grams))) >= F.ceil(F.size(u["grams"]) * (least / (2 - least)) - 1e-9))
    rows_ = [
        {"license": name, "grams": [{"g": g, "n": n} for g, n in sorted(Counter(template_bigrams(t)).items())], "size": size, "lo": lo, "hi": hi}
        for (name, t), size, (lo, hi) in zip(templates, sizes, bounds, strict=True)
    ]
    # One literal, which Spark folds to the table.
    table = F.from_json(F.lit(json.dumps(rows_)), "array<struct<license: string, grams: array<struct<g: string, n: int>>, size: int, lo: int, hi: int>>")

    def against(u: Column) -> Column:
        def dice(t: Column) -> Column:
            shared = F.aggregate(t["grams"], F.lit(0), lambda acc, x: acc + F.least(x["n"], F.size(F.filter(u["grams"], lambda g: g == x["g"]))))
            return F.struct((2.0 * shared / (t["size"] + F.size(u["grams"]))).alias("dice"), t["license"].alias("license"), u["unit"].alias("unit"))

        return F.transform(F.filter("_templates", lambda t: F.size(u["grams"]).between(t["lo"], t["hi"])), dice)

    found = F.filter(F.flatten(F.transform("_near", against)), lambda m: m["dice"] >= least)
    by_rank = lambda a, b: F.when(a["dice"] != b["dice"], F.when(a["dice"] > b["dice"], -1).otherwise(1)).when(a["license"] != b["license"], F.when(a["license"] < b["license"], -1).otherwise(1)).when(a["unit"] < b["unit"], -1).when(a["unit"] > b["unit"], 1).otherwise(0)
    rows = docs.select("doc_id", near.alias("_near")).withColumn("_templates", F.when(F.size("_near") > 0, table))
    none = F.filter(F.array(F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("license"), F.lit("").alias("unit"))), lambda x: F.lit(False))
    return rows.select("doc_id", F.when(F.size("_near") > 0, F.array_sort(found, by_rank)).otherwise(none).alias("matches"))

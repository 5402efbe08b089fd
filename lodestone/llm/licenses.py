"""Licence statements, notices and texts by Dice coefficient over word bigrams.

Main path: DataFrame functions only, and no shuffle. A text is normalised to words, across
line ends. Each template is compared with the windows of the text that have as many words
as it (fewer at the text's end), by their distinct word bigrams. A Dice coefficient of at
least d needs that the window has d / (2 - d) of the template's bigrams: a window begins at
one, and without that many in its length it is pruned before its bigrams are formed. Of
windows that overlap, the closest counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (licence, one-line statement): fixed values of the query.
STATEMENTS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the terms of the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MPL-2.0", "This work is subject to the terms of the Mozilla Public License, version 2.0."),
)


#: (licence, standard notice of a file's head): fixed values of the query.
NOTICES = (
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License."""),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        Affero General Public License for more details. You should have received a copy of the GNU Affero General Public
        License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
        Public License for more details. You should have received a copy of the GNU General Public License along with
        this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA
        02110-1301 USA."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
        Public License for more details. You should have received a copy of the GNU General Public License along with
        this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("LGPL-3.0", """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        Lesser General Public License for more details."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
)

_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
    INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
    DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
    SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
    SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
    WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
    OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_TWO_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
    the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
    of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
    notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
    with the distribution."""
_THIRD_CLAUSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
    promote products derived from this software without specific prior written permission."""

#: (licence, its whole text after the copyright line): fixed values of the query.
TEXTS = (
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
        SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
        WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", f"{_TWO_CLAUSES} {_AS_IS}"),
    ("BSD-3-Clause", f"{_TWO_CLAUSES} {_THIRD_CLAUSE} {_AS_IS}"),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
        and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
        execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties
        to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software
        and this entire statement, including the above license grant, this restriction and the following disclaimer, must
        be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless
        such copies or derivative works are solely in the form of machine-executable object code generated by a source
        language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND
        NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY
        DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
        THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
        any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the
        author or authors of this software dedicate any and all copyright interest in the software to the public domain.
        We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.
        We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to
        this software under copyright law."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that
        you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such,
        and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from
        any source distribution."""),
)
TEMPLATES = STATEMENTS + NOTICES + TEXTS


def normalised(text: Column) -> Column:
    """Lower case; runs of anything but ASCII letters and digits become one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _bigrams_of(template: str) -> tuple[int, list[str]]:
    """How many bigrams a template has, and the distinct ones."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in template.lower()).split()
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return len(pairs), sorted(set(pairs))


def _needed(distinct: int, least: float) -> int:
    """Bigrams that a window must share with a template for the coefficient ``least``."""
    return max(1, math.ceil(distinct * least / (2 - least) - 1e-9))


def scan_licenses(docs: DataFrame, *, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each window of words close to a template: key, word (its first, from 1), n_words, license, template (from 1), dice.

    A window begins at a bigram of the template and has as many words, or what is left of the
    text. Of windows that overlap the one of the highest coefficient stays, then the longer
    template's, the first template's, the first window. Null and empty texts, and texts of one
    word, have no match; texts of any length are compared whole; null keys and repeated rows each
    give their matches; an empty table gives none; other columns are not read.
    """
    known = [(name, *_bigrams_of(t)) for name, t in templates]
    every = sorted({b for _, _, bigrams in known for b in bigrams})
    openers = sorted({b.split(" ")[0] for b in every})

    def once(value: Column, f: Callable[[Column], Column]) -> Column:
        """``f(value)`` with the value computed once, as a lambda's argument."""
        return F.get(F.transform(F.array(value), f), F.lit(0))

    def bigram(words: Column, i: Column) -> Column:
        return F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1))

    def windows(words: Column, hits: Column, turn: int, size: int, bigrams: list[str]) -> Column:
        """The windows of one template as (-dice, -size, template, first word, last word)."""
        needed = _needed(len(bigrams), least)

        def judged(at: Column) -> Column:
            last = F.least(at + size, F.size(words) - 1)
            found = F.array_distinct(F.transform(F.sequence(at, last - 1), lambda i: bigram(words, i)))
            dice = 2.0 * F.size(F.filter(found, lambda b: b.isin(bigrams))) / (F.size(found) + len(bigrams))
            return F.struct((-dice).alias("far"), F.lit(-size).alias("size"), F.lit(turn).alias("template"), at.alias("first"), last.alias("last"))

        def near(own: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(own) - needed), lambda i: F.get(own, i + (needed - 1)) < F.get(own, i) + size)
            return F.filter(F.transform(starts, lambda i: judged(F.get(own, i))), lambda w: w["far"] <= -least)

        none = F.array().cast("array<struct<far:double,size:int,template:int,first:int,last:int>>")
        return once(F.filter(hits, lambda i: bigram(words, i).isin(bigrams)), lambda own: F.when(F.size(own) >= needed, near(own)).otherwise(none))

    def apart(found: Column, size: Column) -> Column:
        """The windows that overlap none before them, of a text of ``size`` words.

        Taken words are bits: 64 in a number, 64 numbers in a page. A window is tested against the
        few numbers that hold its words, and changes its pages only, so that work grows with the
        windows, however many are kept. Kept windows are pages of 256 as well.
        """

        def bits(w: Column, base: Column) -> Column:
            low, high = F.greatest(w["first"] - base, F.lit(0)), F.least(w["last"] - base, F.lit(63))
            mask = F.call_function("shiftrightunsigned", F.call_function("shiftleft", F.lit(-1).cast("long"), low + 63 - high), F.lit(63) - high)
            return F.when(low <= high, mask).otherwise(F.lit(0).cast("long"))

        def clash(taken: Column, w: Column) -> Column:
            cells = F.sequence(F.floor(w["first"] / 64).cast("int"), F.floor(w["last"] / 64).cast("int"))
            return F.exists(cells, lambda k: F.get(F.get(taken, F.floor(k / 64).cast("int")), k % 64).bitwiseAND(bits(w, k * 64)) != 0)

        def marked(taken: Column, w: Column) -> Column:
            low, high = F.floor(w["first"] / 4096).cast("int"), F.floor(w["last"] / 4096).cast("int")
            pages = F.transform(F.slice(taken, low + 1, high - low + 1), lambda p, i: F.transform(p, lambda x, j: x.bitwiseOR(bits(w, (i + low) * 4096 + j * 64))))
            return F.concat(F.slice(taken, F.lit(1), low), pages, F.slice(taken, high + 2, F.size(taken)))

        def added(kept: Column, w: Column) -> Column:
            last = F.element_at(kept, -1)
            return F.when(F.size(last) < 256, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(F.array_append(last, w)))).otherwise(F.array_append(kept, F.array(w)))

        free = F.transform(F.sequence(F.lit(0), F.floor(size / 4096).cast("int")), lambda _: F.array_repeat(F.lit(0).cast("long"), F.lit(64)))
        start = F.struct(free.alias("taken"), F.array(F.slice(found, 1, 0)).alias("kept"))
        step = lambda s, w: F.when(clash(s["taken"], w), s).otherwise(F.struct(marked(s["taken"], w).alias("taken"), added(s["kept"], w).alias("kept")))
        return F.flatten(F.aggregate(F.array_sort(found), start, step)["kept"])

    def of_words(words: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.get(words, i).isin(openers) & bigram(words, i).isin(every))
        found = lambda h: once(F.flatten(F.array(*(windows(words, h, k, *x[1:]) for k, x in enumerate(known, 1)))), lambda w: apart(w, F.size(words)))
        return once(hits, lambda h: F.when(F.size(h) > 0, found(h)))

    found = once(F.split(normalised(F.col(text)), " "), lambda words: F.when(F.size(words) > 1, of_words(words)))
    out = docs.select(F.col(key).alias("key"), F.explode(found).alias("w"))
    name = F.element_at(F.array(*(F.lit(x[0]) for x in known)), F.col("w.template"))
    return out.select(F.col("key").alias(key), (F.col("w.first") + 1).alias("word"), (F.col("w.last") - F.col("w.first") + 1).alias("n_words"), name.alias("license"), F.col("w.template").alias("template"), F.round(-F.col("w.far"), 6).alias("dice"))


def oracle_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.8) -> str:
    rows = []
    for k, (name, t) in enumerate(templates, 1):
        size, bigrams = _bigrams_of(t)
        rows.append(f"({k}, '{name}', {size}, {len(bigrams)}, {_needed(len(bigrams), least)}, [{', '.join(repr(b) for b in bigrams)}])")
    return rf"""
WITH t AS (SELECT * FROM (VALUES {", ".join(rows)}) v(template, license, size, bigrams, needed, grams)),
g AS (SELECT template, size, unnest(grams) AS g FROM t),
w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, s, w[s + 1] || ' ' || w[s + 2] AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 1)) AS s FROM w)),
h AS (SELECT doc_id, template, size, s, b.g FROM b JOIN g ON g.g = b.g),
c AS (SELECT a.doc_id, a.template, a.s, count(DISTINCT z.g) AS shared FROM h a JOIN h z ON z.doc_id = a.doc_id AND z.template = a.template AND z.s >= a.s AND z.s < a.s + a.size GROUP BY ALL),
e AS (SELECT c.*, t.size, t.bigrams, t.license FROM c JOIN t ON t.template = c.template WHERE c.shared >= t.needed),
d AS (SELECT e.doc_id, template, e.s, e.size, license, 2.0 * any_value(shared) / (count(DISTINCT b.g) + any_value(bigrams)) AS dice, max(b.s) + 1 AS last FROM e JOIN b ON b.doc_id = e.doc_id AND b.s >= e.s AND b.s < e.s + e.size GROUP BY e.doc_id, template, e.s, e.size, license),
l AS (SELECT doc_id, list([{{'s': s, 'e': last, 'template': template, 'license': license, 'dice': dice}}] ORDER BY dice DESC, size DESC, template, s) AS x FROM d WHERE dice >= {least} GROUP BY doc_id),
r AS (SELECT doc_id, unnest(list_reduce(x, lambda kept, y: CASE WHEN len(list_filter(kept, lambda k: k.s <= y[1].e AND y[1].s <= k.e)) > 0 THEN kept ELSE list_concat(kept, y) END)) AS k FROM l)
SELECT doc_id, (k.s + 1)::INT AS word, (k.e - k.s + 1)::INT AS n_words, k.license AS license, k.template::INT AS template, round(k.dice, 6) AS dice FROM r"""

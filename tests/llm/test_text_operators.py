"""Near duplicates, packing, line runs, encoding, licences."""

import hashlib
import random
import textwrap
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.data import ROWS, documents, empty
from tests.oracle import connect, same
from tidemark.llm import bpe, license_scan, line_dedup, minhash_dedup, packing, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], connect(SF))


# -- near duplicates


def sets_of(texts, k):
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute_components(texts, k):
    sets, parent = sets_of(texts, k), {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for a, x in enumerate(ids):
        for y in ids[a + 1 :]:
            common = len(sets[x] & sets[y])
            if sets[x] and 100 * common >= 80 * (len(sets[x]) + len(sets[y]) - common) and common:
                p, q = find(x), find(y)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_texts():
    rng = random.Random(5)
    texts = {}
    for base in range(6):
        words = [f"w{rng.randrange(400)}" for _ in range(120)]
        for copy in range(9):
            own = list(words)
            for _ in range(copy):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10_000)}"
            texts[base * 100 + rng.randrange(100)] = " ".join(own)
    chain = [f"c{i}" for i in range(260)]
    texts |= {1000 + s: " ".join(chain[s * 8 : s * 8 + 100]) for s in range(15)}  # neighbours alike, ends not
    return texts


def test_components_match_brute_force(spark):
    texts = near_texts()
    df = documents(spark, [(i, t, None, None, None) for i, t in texts.items()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(df, minhash_dedup.MinMaxConfig(shingle_words=3, block_shingles=400)).collect()}
    assert got == brute_components(texts, 3)


def test_near_duplicates_of_odd_rows(spark):
    rows = [tuple(r) for r in minhash_dedup.near_duplicates(documents(spark)).collect()]
    assert len(rows) == len(ROWS)
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r[1:])
    assert by[1] == [(6, 1, True)] * 2
    assert by[None] == [(6, None, True)]
    for empty_id in (2, 3, 4):
        assert by[empty_id] == [(0, empty_id, True)]
    assert by[5] == [(1, 5, True)] and by[6] == [(1, 6, True)] and by[8] == [(2, 8, True)]
    assert minhash_dedup.near_duplicates(empty(spark)).count() == 0


def test_components_of_documents_match_brute_force(spark):
    larger = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.op1_minhash_dedup(spark, larger).collect()}
    assert got == brute_components(docs, 4)
    assert sum(i != comp for i, (_, comp) in got.items()) > 50


def test_blocks_give_the_links_between_components():
    """A pair is looked at in its first bucket alone, and rows that only stand on the right start nothing."""
    c = minhash_dedup.MinMaxConfig()
    drawn = minhash_dedup._permutations(c)
    sets = [minhash_dedup.shingle_set(" ".join(f"w{i}" for i in range(a, a + 120)), 5) for a in (0, 2, 4, 90)]
    sketches = [minhash_dedup.signature(s, c, drawn)[1] for s in sets]

    def block(comps, keys, role=(0, 0, 0, 0)):
        columns = {"id": [0, 1, 2, 3], "comp": comps, "n": [len(s) for s in sets], "role": list(role), "sketch": sketches, "keys": keys, "set": [s.tobytes() for s in sets], "outside": [x != 1 for x in comps]}
        return pa.table({k: pa.array(v, pa.list_(pa.int64()) if k == "keys" else None) for k, v in columns.items()})

    assert minhash_dedup.block_links(5, block([0, 1, 1, 3], [[5]] * 4), c) == [(0, 1)]
    assert minhash_dedup.block_links(5, block([0, 1, 2, 3], [[5]] * 4), c) == [(0, 1), (0, 2)]
    assert minhash_dedup.block_links(5, block([0, 1, 1, 3], [[5], [4, 5], [5], [5]]), c) == [(0, 1)]
    assert minhash_dedup.block_links(5, block([0, 1, 1, 3], [[4, 5], [4, 5], [5], [5]]), c) == [(0, 2)]
    assert minhash_dedup.block_links(5, block([0, 1, 1, 3], [[5]] * 4, (2, 2, 2, 2)), c) == []
    assert minhash_dedup.block_links(5, block([1, 1, 1, 1], [[5]] * 4), c) == []


def test_ids_with_two_texts_tie_components(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    df = documents(spark, [(1, a, None, None, None), (2, a, None, None, None), (2, b, None, None, None), (3, b, None, None, None)])
    assert {r.component_id for r in minhash_dedup.near_duplicates(df).collect()} == {1}


# -- packing


def test_cuts_are_the_cheapest():
    rng = random.Random(2)
    for _ in range(60):
        length = rng.choice([64, 100, 128])
        points = [0]
        while len(points) < 40:
            points.append(points[-1] + rng.randint(1, length // 2))
        soft = [False, *(rng.random() < 0.5 for _ in points[1:])]
        cost = [0] + [10**9] * (len(points) - 1)
        for j in range(1, len(points)):
            for i in range(j):
                size = points[j] - points[i]
                if size <= length:
                    pad = 0 if size >= 64 and size & (size - 1) == 0 else length - size
                    cost[j] = min(cost[j], cost[i] + pad + 8 * soft[j])
        got = packing.window_cuts(np.array(points), np.array(soft), length, 8)
        total = at = 0
        for j in got:
            size = points[j] - at
            total += (0 if size >= 64 and size & (size - 1) == 0 else length - size) + 8 * soft[j]
            at = points[j]
        assert total == cost[-1] and at == points[-1]


def packed_ids(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    return by


def test_pieces_are_the_tokenizers_ids(spark):
    t = Tokenizer.from_file(packing.PackConfig().path())
    rows = packing.pack(documents(spark), packing.PackConfig(length=256, block_windows=4)).collect()
    by = packed_ids(rows)
    for doc in (1, None):  # ids of several rows: the pieces of each row, in some order
        texts = [r[1] for r in ROWS if r[0] == doc]
        ids = np.array([*t.encode(texts[0], add_special_tokens=False).ids, 1], "<u4")
        assert sum(r.length for r in by[doc]) == len(ids) * len(texts) and {r.doc_tokens for r in by[doc]} == {len(ids)}
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in by[doc])
    for doc, text in {(r[0], r[1]) for r in ROWS if r[0] != 1 and r[0] is not None}:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(by[doc], key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for w in windows.values():
        w.sort()
        assert w[-1][0] + w[-1][1] <= 256 and all(a + n == b for (a, n), (b, _) in zip(w, w[1:])) and w[0][0] == 0
    assert packing.pack(empty(spark)).count() == 0


def test_packing_wastes_little(spark):
    sizes = defaultdict(int)
    for r in packing.op2_packing(spark, "/root/testdata/sf0.01").collect():
        sizes[r.sequence_id] += r.length
    pad = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes.values())
    assert max(sizes.values()) <= 2048 and pad < 0.05 * sum(sizes.values())


# -- encoding

ALPHABET = ["a", "b", " ", "  ", "\n", "é", "ß", " ", "\x1c", "日本", "'s", "'", "<|endoftext|>", "12", "!!", "\t", "İ", "🙂", "aaaaaaa", "hello", "\r\n", "́"]


def test_encoding_is_the_librarys():
    t = Tokenizer.from_file(bpe.BpeConfig().path())
    own = bpe.tokenizer(bpe.BpeConfig())
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["a" * 3000, "ab " * 200, ""]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert [int(x) for x in ids.split(",") if x] == t.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == text


def test_encoding_of_odd_rows(spark):
    t = Tokenizer.from_file(bpe.BpeConfig().path())
    rows = bpe.encoding_digests(documents(spark)).collect()
    assert len(rows) == len(ROWS)
    for r, (doc, text, *_) in zip(sorted(rows, key=lambda r: r.doc_id or 0), sorted(ROWS, key=lambda r: r[0] or 0), strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens, r.ids_sha256) == (doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = bpe.decode_ids(bpe.encode_texts(documents(spark)))
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r[0], r[1] or "") for r in ROWS}
    assert bpe.encoding_digests(empty(spark)).count() == 0


# -- repeated lines


def brute_lines(docs, least):
    """Longest earlier match from every line, the plain way."""
    at = [(d, i) for d in sorted(docs) for i in range(len(docs[d]))]
    gone = defaultdict(set)
    for q, (d, i) in enumerate(at):
        for e, j in at[:q]:
            n = 0
            while i + n < len(docs[d]) and j + n < len(docs[e]) and docs[d][i + n] == docs[e][j + n]:
                n += 1
            if sum(len(x.split()) for x in docs[d][i : i + n]) >= least:
                gone[d] |= set(range(i, i + n))
    return {d: "\n".join(x for i, x in enumerate(docs[d]) if i not in gone[d]) for d in docs}


def test_runs_match_brute_force(spark):
    rng = random.Random(8)
    pool = [" ".join(f"p{k}" for _ in range(rng.randint(0, 5))) for k in range(12)]
    docs = {d: [rng.choice(pool) for _ in range(rng.randint(1, 25))] for d in range(25)}
    docs[30] = docs[3] + ["tail"]
    docs[31] = ["same line"] * 12
    df = documents(spark, [(d, "\n".join(x), None, None, None) for d, x in docs.items()])
    got = {r.doc_id: r["_text"] for r in line_dedup.delete_repeats(df, line_dedup.LineConfig(min_words=6)).collect()}
    assert got == brute_lines(docs, 6)


def test_lines_of_odd_rows(spark):
    rows = {(r.doc_id, r["_text"]) for r in line_dedup.delete_repeats(documents(spark)).collect()}
    assert rows == {(r[0], r[1]) for r in ROWS}
    assert line_dedup.delete_repeats(empty(spark)).count() == 0


# -- licences


def test_licence_rules(spark):
    mit = "\n".join(x[0] for k, x in license_scan.SENTENCES.items() if k.startswith("mit-"))
    wrapped = mit.replace("without restriction, including", "without restriction,\nincluding")
    bsd3 = "\n".join(license_scan.SENTENCES[k][0] for k in ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"))
    bsd2 = "\n".join(license_scan.SENTENCES[k][0] for k in ("bsd-redistribute", "bsd-source", "bsd-binary"))
    apache = "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#     http://www.apache.org/licenses/LICENSE-2.0\n# Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n# See the License for the specific language governing permissions and limitations under the License."
    texts = [mit, wrapped, bsd3, bsd2, "Some text. released under  the mit license! More.", "\n".join(mit.split("\n")[::-1]), apache, "All rights reserved.\nAll rights reserved."]
    df = documents(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    got = {r.doc_id: r.licenses for r in license_scan.scan_licenses(df).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "BSD-3-Clause", 3: "BSD-2-Clause", 4: "MIT", 5: "", 6: "Apache-2.0", 7: "All-Rights-Reserved"}
    odd = license_scan.scan_licenses(documents(spark)).collect()
    assert len(odd) == len(ROWS) and {r.licenses for r in odd} == {""}
    assert license_scan.scan_licenses(empty(spark)).count() == 0


def wrapped_header(rule, width, sign, glue):
    fill = lambda x: textwrap.fill(x, width, initial_indent=sign, subsequent_indent=sign, break_long_words=False, break_on_hyphens=False)
    sentences = [license_scan.SENTENCES[k][0] if k in license_scan.SENTENCES else f"Licensed under the {license_scan.NOTICES[k.removesuffix('-notice')][0]} license." for k in rule]
    return "\n".join(map(fill, sentences)) if glue == "\n" else fill(glue.join(sentences))


MIT_FILE = """MIT License

Copyright (c) 2019 Jo Doe
All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice (including the next
paragraph) shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""

BSD_FILE = """Copyright (c) 2011, Jo Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""

ZLIB_FILE = """/* Copyright (C) 1999 Jo Doe

  This software is provided 'as-is', without any express or implied
  warranty.  In no event will the authors be held liable for any damages
  arising from the use of this software.

  Permission is granted to anyone to use this software for any purpose,
  including commercial applications, and to alter it and redistribute it
  freely, subject to the following restrictions:

  1. The origin of this software must not be misrepresented; you must not
     claim that you wrote the original software. If you use this software
     in a product, an acknowledgment in the product documentation would be
     appreciated but is not required.
  2. Altered source versions must be plainly marked as such, and must not be
     misrepresented as being the original software.
  3. This notice may not be removed or altered from any source distribution.
*/"""

ISC_FILE = """-- Copyright (c) 2004 Jo Doe
--
-- Permission to use, copy, modify, and/or distribute this software for any
-- purpose with or without fee is hereby granted, provided that the above
-- copyright notice and this permission notice appear in all copies.
--
-- THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
-- REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
-- AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
-- INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
-- LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
-- OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
-- PERFORMANCE OF THIS SOFTWARE.
"""

LGPL_FILE = """<!-- This library is free software; you can redistribute it and/or -->
<!-- modify it under the terms of the GNU Lesser General Public -->
<!-- License as published by the Free Software Foundation; either -->
<!-- version 2.1 of the License, or (at your option) any later version. -->
<!-- -->
<!-- This library is distributed in the hope that it will be useful, -->
<!-- but WITHOUT ANY WARRANTY; without even the implied warranty of -->
<!-- MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU -->
<!-- Lesser General Public License for more details. -->
"""

REM_FILE = "REM Licensed under the Apache License, Version 2.0 (the \"License\");\nREM you may not use this file except in compliance with the License.\nREM You may obtain a copy of the License at\nREM\nREM     http://www.apache.org/licenses/LICENSE-2.0\nREM\nREM Unless required by applicable law or agreed to in writing, software\nREM distributed under the License is distributed on an \"AS IS\" BASIS,\nREM WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nREM See the License for the specific language governing permissions and\nREM limitations under the License."


def test_whole_licence_files(spark):
    cut = BSD_FILE[: BSD_FILE.index("3. Neither")] + BSD_FILE[BSD_FILE.index("THIS SOFTWARE") :]
    cases = [("MIT", MIT_FILE), ("BSD-3-Clause", BSD_FILE), ("BSD-2-Clause", cut), ("Zlib", ZLIB_FILE), ("ISC", ISC_FILE), ("LGPL-2.1-or-later", LGPL_FILE), ("Apache-2.0", REM_FILE)]
    cases += [("LGPL-2.1-only", "This library is distributed under the terms of the GNU Lesser General Public License v2.1."), ("CC-BY-NC-SA-4.0", "Fine words. The content is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."), ("GPL-2.0-or-later", "Released under GPLv2+."), ("AGPL-3.0-only", "Licensed under AGPL-3.0-only"), ("", "It was released under the bridge."), ("", "They were licensed under the MIT License of old")]
    df = documents(spark, [(i, t, None, None, None) for i, (_, t) in enumerate(cases)])
    got = {r.doc_id: r.licenses for r in license_scan.scan_licenses(df).collect()}
    assert [(n, got[i]) for i, (n, _) in enumerate(cases) if got[i] != n] == []


def test_the_table_holds_many_licences():
    assert len({name for name, _ in license_scan.RULES}) >= 60
    assert {k for _, rule in license_scan.RULES for k in rule} <= set(license_scan.KNOWN.values())


def test_every_rule_matches_its_wrapped_header(spark):
    ends = lambda rule: all(license_scan.SENTENCES[k][0][-1] in ".:;" for k in rule[:-1])
    cases = [(name, wrapped_header(rule, width, sign, glue)) for name, rule in license_scan.RULES for width in range(20, 100, 7) for sign in ("", "# ", " * ") for glue in ("\n", "  ") if glue == "\n" or ends(rule)]
    gpl = "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n\n    This program is distributed in the hope that it will be useful,\n    but WITHOUT ANY WARRANTY; without even the implied warranty of\n    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n    GNU General Public License for more details.\n\n    You should have received a copy."
    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\r\n// License, v. 2.0. If a copy of the MPL was not distributed with this\r\n// file, You can obtain one at http://mozilla.org/MPL/2.0/."
    cases += [("GPL-3.0-or-later", gpl), ("MPL-2.0", mpl), ("", "Not\nAll rights\n\nreserved."), ("", "All rights reserved here.")]
    df = documents(spark, [(i, t, None, None, None) for i, (_, t) in enumerate(cases)])
    got = {r.doc_id: r.licenses for r in license_scan.scan_licenses(df).collect()}
    assert [(n, t, got[i]) for i, (n, t) in enumerate(cases) if got[i] != n] == []

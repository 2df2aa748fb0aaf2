"""What the first round's review found missing."""

import numpy as np

from gramloom.llm import licenses, near_dedup, rnn_lm
from test_index_operators import plain_shingles
from test_text_operators import frame

# --- the language model -----------------------------------------------------------------------------------------------


def test_every_training_document_gives_gradients(spark, monkeypatch):
    monkeypatch.setattr(rnn_lm, "SAMPLE_DOCS", 1)
    docs = frame(spark, [f"own{i} and own{i}" for i in range(24)])
    v = rnn_lm.vocabulary(rnn_lm.count_words(docs))
    moved = np.abs(rnn_lm.train(docs, v)["embed"] - rnn_lm.start_weights(v)["embed"]).max(1) > 0
    assert all(moved[v.words.index(b"own%d" % i)] for i in range(24))


# --- licences ---------------------------------------------------------------------------------------------------------

BSD = """Copyright (c) 2020, Someone

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MPL = """ * This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
GPL = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_every_known_sentence_is_found_without_exclusion(spark):
    rows = [(k, s) for table in (licenses.SENTENCES, licenses.FORMS) for k, of in table.items() for s in of]
    got = licenses.scan(frame(spark, ["Before this. " + s + "\n\nAfter that." for _, s in rows])).collect()
    assert [rows[r.doc_id] for r in got if r.sequence != f"_ {rows[r.doc_id][0]} _" or r.n_sentences != 3] == []


def test_licences_as_they_are_written(spark):
    want = {
        BSD: "BSD-2-Clause", BSD + BSD3: "BSD-3-Clause", BSD.replace("1. ", "(a) ").replace("2. ", "(b) "): "BSD-2-Clause", MPL: "MPL-2.0", APACHE: "Apache-2.0",
        GPL.format(";", ";", 2): "GPL-2.0-or-later", GPL.format(":", ",", 3): "GPL-3.0-or-later", MIT: "MIT",
        "# SPDX-License-Identifier: MIT\nimport os\n": "MIT", "// SPDX-License-Identifier: GPL-2.0-only\n\nint x;": "GPL-2.0-only", "/* SPDX-License-Identifier: MPL-2.0 */\nint x;": "MPL-2.0",
        "SPDX-License-Identifier: MIT OR Apache-2.0": "", "MIT. License.": "", "Mit\x1eLicense": "MIT",
    }
    got = licenses.scan(frame(spark, [*want])).orderBy("doc_id").collect()
    assert [r.licences for r in got] == [*want.values()] and [r.unmatched for r in got if r.licences.startswith(("BSD", "MPL", "Apache", "GPL"))] == [""] * 9


# --- near-duplicates --------------------------------------------------------------------------------------------------


def test_near_copies_with_a_repeated_passage_are_candidates(spark):
    texts = []
    for i in range(20):
        base = " ".join(f"b{i}x{k}" for k in range(104))
        texts += [base, base + (" " + " ".join(f"p{i}x{k}" for k in range(20))) * 20]
    shared = [(plain_shingles(a).keys(), plain_shingles(b).keys()) for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert all(len(a & b) / len(a | b) >= 0.8 for a, b in shared)
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(frame(spark, texts)).collect()}
    assert [got[i] for i in range(40)] == [i - i % 2 for i in range(40)]


def test_training_carries_the_state_through_a_long_text(monkeypatch):
    from test_index_operators import small_vocabulary

    v = small_vocabulary()
    w = rnn_lm.start_weights(v, 8)
    r = np.random.default_rng(3)
    docs = [r.integers(0, v.head, n) for n in (200, 50, 3)]
    seen = []

    class Still(rnn_lm.Trainer):
        def _step(self, name, slope, rows=slice(None)):
            pass

        def window(self, inputs, targets, opens, going, h):
            seen.append(super().window(inputs, targets, opens, going, h))
            return seen[-1]

    Still(v, w).texts(docs, 0, lanes=2)
    h, before = np.zeros((1, 8), np.float32), 0
    for at, s in enumerate(docs[0], 1):
        h = rnn_lm._cell(w, w["embed"][[before]], h)[-1]
        before = s
        if at % rnn_lm.WINDOW == 0:
            assert np.allclose(seen[at // rnn_lm.WINDOW - 1][0], h[0], atol=1e-5)
    assert len(seen) == -(-200 // rnn_lm.WINDOW)


def test_known_words_are_those_above_a_count(spark):
    texts = ["a a a a b b b c c d d e f g", "END b a c"]
    counts = rnn_lm.count_words(frame(spark, texts))
    all_words = {r.word: r.c for r in counts.collect()}
    for known in (1, 2, 4, 5, 100):
        v = rnn_lm.vocabulary(counts, head=3, known=known)
        got = dict(zip(v.words, v.counts.tolist(), strict=True))
        assert rnn_lm.END in got and all(all_words[w] == c for w, c in got.items()) and len(got) <= known + 1
        least = min((c for w, c in got.items() if w != rnn_lm.END), default=10**9)
        assert all(c <= least or w in got for w, c in all_words.items()) and v.total == sum(all_words.values()) and v.types == len(all_words)

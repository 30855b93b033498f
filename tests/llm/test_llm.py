"""The training-data operators against oracles and brute-force versions, and their edge cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from conftest import SF, rows_of

import corpus_pipeline
from scanfuse.llm import bpe, chat, decontaminate, exact_dedup, html, licences, line_dedup, quality, sharding, simhash

DOC = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, "  \n\t"), (4, "a b c"), (5, "abc"), (5, "abc"), (6, "word " * 30_000), (None, "abc"), (7, "ünïcödé 漢字 😀 <|endoftext|>")]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, repeats, a long text and extra columns with clashing names."""
    rows = [(*r, "x", 1) for r in ODD]
    return spark.createDataFrame(rows, DOC + ", keep_id string, fp int")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)


def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").df()


def test_op1_oracle(spark, duck):
    assert rows_of(exact_dedup.op1_exact_dedup(spark, SF).toPandas()) == rows_of(duck.sql(exact_dedup.ORACLE).df())


def test_op1_odd(odd, none):
    got = exact_dedup.exact_groups(odd, hot_share=4).toPandas()  # a low share, so that the hot way is taken
    assert len(got) == len(ODD) and exact_dedup.exact_groups(none).count() == 0
    g = {r.doc_id: r for r in got.itertuples() if r.doc_id == r.doc_id}
    assert (g[1].keep_id, g[1].group_size) == (3, 3) and not g[1].kept and g[3].kept
    assert (g[5].keep_id, g[5].group_size) == (4, 4)
    kept = exact_dedup.drop_exact_copies(odd, hot_share=4)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 6, 7]
    assert [r["kept"] for r in exact_dedup.exact_groups(odd.where("doc_id = 5")).collect()].count(True) == 1


def test_op2_equals_the_library(spark, odd, none):
    from tokenizers import Tokenizer

    tok, path = Tokenizer.from_file(bpe.public_path()), bpe.public_path()
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for df in (spark.read.parquet(f"{SF}/documents.parquet"), odd) for r in bpe.round_trip(df, path).collect()}
    for i, text in [*documents().itertuples(index=False), *ODD]:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        i = None if i is None else int(i)
        assert (i, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))) in got
    assert bpe.round_trip(none, path).count() == 0


def test_op2_refuses_other_files():
    spec = {"model": {"type": "BPE"}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "decoder": {"type": "ByteLevel"}, "added_tokens": []}
    bpe.check_supported(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"model": {"type": "BPE", "ignore_merges": True}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"added_tokens": [{"content": "x", "lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.check_supported(spec | change)


def test_op2_cuts_are_certain():
    b = bpe.ByteBpe(bpe.public_path())
    for piece in (" Ascociónrr", "zqxjé", "漢字", "\n\n"):
        assert "".join(b.fragments(piece)).translate({ord(c): k for k, c in b.letters.items()}).encode("latin-1").decode() == piece
        assert [t.id for f in b.fragments(piece) for t in b.model.tokenize(f)] == [t.id for t in b.model.tokenize(piece.encode().decode("latin-1").translate(b.letters))]


def brute_leaks(doc: list, item: list, least: int) -> int:
    """Covered item tokens by greedy string tiling, the plain way."""
    used_d, used_i, least = [False] * len(doc), [False] * len(item), min(least, len(item))
    covered = 0
    while item:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and doc[d + n] == item[i + n] and not used_d[d + n] and not used_i[i + n]:
                    n += 1
                best = max(best, (n, -d, -i))
        if best[0] < least:
            return covered
        for k in range(best[0]):
            used_d[-best[1] + k] = used_i[-best[2] + k] = True
        covered += best[0]
    return covered


def test_op3_tiles_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    for _ in range(40):
        item, doc = rng.integers(1, 5, rng.integers(1, 30)), rng.integers(1, 5, rng.integers(0, 60))
        assert sum(n for _, _, n in decontaminate.tiles(doc, item, 3)) == brute_leaks(list(doc), list(item), 3)


def test_op3_reordered_partial_and_both_ways(spark, odd, none):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, "intro text " + item), (2, "Seven eight nine ten eleven twelve! one two three four five six"), (3, "one two three four five and no more"), (4, None), (5, "xx short item here xx")], DOC)
    bench = spark.createDataFrame([(10, item), (11, None), (12, "short item here")], "item_id long, text string")
    for size in (1 << 20, 0):
        got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontaminate.leaks(docs, bench, index_bytes=size).collect()}
        assert got == {(1, 10): 1.0, (2, 10): 1.0, (5, 12): 1.0}
    assert sorted(r[0] for r in decontaminate.drop_contaminated(docs, bench).select("doc_id").collect()) == [3, 4]
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(odd, bench.limit(0)).count() == 0


def test_op3_repetitive_item_both_ways(spark):
    item = " ".join(["one two three four five"] * 9)
    docs = spark.createDataFrame([(1, "x " + item + " y"), (2, "one two three four five only")], DOC)
    bench = spark.createDataFrame([(10, item)], "item_id long, text string")
    for size in (1 << 20, 0):
        assert [(r["doc_id"], r["coverage"]) for r in decontaminate.leaks(docs, bench, index_bytes=size).collect()] == [(1, 1.0)]


def test_op4_equals_brute_force(spark):
    docs = documents().sort_values("doc_id").head(120)
    occ, first = [], {}
    for i, text in docs.itertuples(index=False):
        for k, line in enumerate((text or "").split("\n")):
            if line := line_dedup.normalised(line):
                occ.append((i, k, line))
                first.setdefault(line, (i, k))
    lines = list(first)
    sets = [{x[k : k + 6] for k in range(max(1, len(x) - 5))} for x in lines]
    root = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                ra, rb = root[a], root[b]
                root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    keep, at = {}, {x: k for k, x in enumerate(lines)}
    for k, x in enumerate(lines):
        keep[root[k]] = min(keep.get(root[k], first[x]), first[x])
    want = {}
    for i, k, x in occ:
        if keep[root[at[x]]] != (i, k):
            want.setdefault(int(i), []).append(k)
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.line_classes(spark.createDataFrame(docs)).collect()}
    assert got == want


def test_op4_odd(odd, none):
    got = line_dedup.dedup_lines(odd)
    assert got.columns == odd.columns and got.count() == len(ODD)
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[1] is None and texts[4] == "a b c" and line_dedup.line_classes(none).count() == 0


def test_op5_equals_brute_force(spark, odd, none):
    docs = documents()
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def fingerprint(t: str) -> int:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        h = Counter(xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))) if w else Counter()
        return sum(1 << b for b in range(64) if 2 * sum(n for x, n in h.items() if x >> b & 1) > sum(h.values()))

    ids = sorted(docs["doc_id"])
    fp = {i: fingerprint(t or "") for i, t in docs.itertuples(index=False)}
    comp = {i: i for i in ids}
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fp[i] ^ fp[j]).bit_count() <= 4 and comp[i] != comp[j]:
                a, b = comp[i], comp[j]
                comp = {x: min(a, b) if c in (a, b) else c for x, c in comp.items()}
    got = simhash.op5_simhash(spark, SF).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{fp[i]:016x}", comp[i]) for i in ids}
    assert simhash.near_groups(odd).count() == len(ODD) and simhash.near_groups(none).count() == 0
    assert {r["component_id"] for r in simhash.near_groups(odd).collect() if r["doc_id"] in (1, 2, 3)} == {1}


@pytest.mark.parametrize("hot", [20_000, 3])
def test_op5_links_reach_all(spark, hot):
    rng, codes = np.random.default_rng(5), set()
    for _ in range(15):
        at = int(rng.integers(0, 2**63))
        for _ in range(20):
            codes.add(at)
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                at ^= 1 << int(b)
    codes = sorted(codes)
    group = {c: c for c in codes}
    for k, a in enumerate(codes):
        for b in codes[:k]:
            if (a ^ b).bit_count() <= 4 and group[a] != group[b]:
                x, y = group[a], group[b]
                group = {c: min(x, y) if g in (x, y) else g for c, g in group.items()}
    e = simhash.links(spark.createDataFrame([(simhash._signed(c),) for c in codes], "fp long"), 4, hot)
    from scanfuse.llm.common import components

    got = {r["node"]: r["component"] for r in components(e).collect()}
    mine = [got.get(simhash._signed(c), simhash._signed(c)) for c in codes]
    assert len(set(zip(mine, group.values()))) == len(set(mine)) == len(set(group.values()))


def test_op6_oracle_and_sequences(spark, duck, none):
    assert rows_of(licences.op6_licences(spark, SF).toPandas()) == rows_of(duck.sql(licences.ORACLE).df())
    text = "Intro.\nLicensed under the Apache License, Version 2.0! You may not use this file except in compliance with the License. You may obtain a copy of the License at\nReleased under the MIT License.\nall rights reserved"
    r = licences.scan(spark.createDataFrame([(1, text), (2, None), (3, "no licence here")], DOC)).collect()
    assert len(r) == 1 and r[0]["licences"] == ["Apache-2.0", "MIT"] and r[0]["unmatched"] == 1
    assert licences.scan(none).count() == 0


MIT = """MIT License

Copyright (c) 2020 Some One

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
import os
"""
GPL = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 *
 * You should have received a copy of the GNU General Public License
 * along with this program.  If not, see <https://www.gnu.org/licenses/>.
 */
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

(2) Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
ENDORSE = """
* Neither the name of the Example
  Project nor the names of its contributors may be used to endorse or promote
  products derived from this software without specific prior written permission.
"""


def test_op6_licences_own_texts(spark):
    texts = {"MIT": MIT, "Apache-2.0": APACHE, "GPL-3.0": GPL, "BSD-3-Clause": BSD.format(ENDORSE), "BSD-2-Clause": BSD.format("")}
    for change in (str, lambda t: " ".join(t.split()), lambda t: t.replace("\n", "\r\n")):
        docs = [(k, change(t)) for k, t in enumerate(texts.values())]
        got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(docs, DOC)).collect()}
        for k, name in enumerate(texts):
            assert got[k]["licences"] == [name] and got[k]["unmatched"] == 0
    headers = {
        "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
        "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
        "LGPL-2.1": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU\nLesser General Public License for more details.",
        "AGPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published\nby the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
        "Unlicense": "This is free and unencumbered software released into the public domain.",
        "GPL-2.0": "// SPDX-License-Identifier: GPL-2.0-or-later\nint main() {}",
        "": "All rights  reserved\nand nothing else",
    }
    got = {r["doc_id"]: r["licences"] for r in licences.scan(spark.createDataFrame(list(enumerate(headers.values())), DOC)).collect()}
    assert got == {k: [name] if name else [] for k, name in enumerate(headers)}
    # no sentence: other words follow or go before
    assert licences.scan(spark.createDataFrame([(1, "Not licensed under the MIT license\nfoo"), (2, "Licensed under the MIT license terms."), (3, "Licensed. Under the MIT license.")], DOC)).count() == 0


PAGE = "<html><head><title>t</title><script>x='<p>no</p>'</script></head><body><nav><a>menu</a></nav><main><h1>T &amp; U</h1><p>one <b>tw</b>o<br>three</p>{}<div class='ad-box'>buy</div><p>last&nbsp;&#33;</p></main><div id=comments><article class=comment>c</article></div><footer>f</footer></body></html>"


def test_op7_wrappers_and_text(spark):
    pages = [(k, "http://a.example/x", PAGE.format("<ul><li>i</li><li>j</li></ul>" * (k % 3))) for k in range(6)] + [(7, None, None), (8, "odd", ""), (9, "http://b.example/", "plain text only")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert got[0] == "T & U one two three last !" and got[1] == "T & U one two three i j last !"
    assert got[7] == got[8] == "" and got[9] == "plain text only"
    assert html.extract(df.limit(0)).count() == 0
    w = html.Compiled(html._load(html.wrappers(df.where("url LIKE '%a.example%'")).first()["wrapper"]))
    assert all(w.path(html.skeleton(p)[0]) for _, u, p in pages[:6])


def test_op7_marked_loose_and_inline_elements_are_hidden():
    page = lambda body: f"<body><article>{body}</article></body>"
    for body, want in {
        '<p>a</p><p class="ad">buy</p><p>b</p>': "a b",
        '<p>a<p class="ad">buy<p>b': "a b",
        '<p>a <span class="ad">buy <span>it</span> now</span>b</p>': "a b",
        '<p>a <a class="share">tell</a>b <a href="x">c</a></p>': "a b c",
        '<table><tr><td>a</td><td class="sidebar"><table><tr><td>x</td></tr></table>y</td><td>b</td></tr></table>': "a b",
        '<table><tr><td>a<td class="sidebar">x<tr><td>b</table>c': "a b c",
        '<ul><li>a<li class="promo">x</ul><div>b</div>': "a b",
        '<ul><li class="promo"><ul><li>x</li></ul>y</li><li>b</li></ul>': "b",
        '<div><p class="ad">buy</div><p>b</p>': "b",
        '<p class="ad">buy <b>now</b></p><p>b <br>c</p>': "b c",
        '<pre>x <span class="hljs-comment"># y</span></pre>': "x # y",
        '<div class="ad"><p>x</p></div><p>b</p>': "b",
        '<p><span class="ad">buy</p><p>b</p>': "b",
        '<div><span class="ad"><p>x</p>y</span>b</div>': "b",
    }.items():
        assert html.main_text(page(body), None) == want, body


def test_op7_articles_of_the_pages(spark):
    import html as entities

    pages = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").df()
    got = {r["page_id"]: r for r in html.op7_html(spark, SF).collect()}
    for i, page in pages.itertuples(index=False):
        body = re.sub(r"<[^>]*>", "\n", re.sub(r"</?(b|i|em|a)\b[^>]*>", "", re.search("<article>(.*)</article>", page, re.S)[1]))
        want = " ".join(x for x in (" ".join(entities.unescape(t).split()) for t in body.split("\n")) if x)
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)


def test_op8_held_out_accuracy(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    got = quality.op8_quality(spark, sf).toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got["doc_id"], got["held_out"]))
    on = got[got["held_out"]].merge(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").df(), on="doc_id")
    assert on.loc[on["quality"] == 1, "score"].median() > 0.7 and (on["predicted"] == on["quality"]).mean() > 0.9
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, None)], "doc_id long, quality int")
    assert quality.score_documents(odd, labels).count() == len(ODD) and quality.score_documents(none, labels).count() == 0
    assert {r["score"] for r in quality.score_documents(odd, labels.limit(0)).collect()} == {0.5}


def test_op9_links_and_order(spark):
    rows = [(1, 0, "user", "Hello there.\n\nHow do I sort?"), (1, 1, "assistant", "> How do I sort?\nUse sort().\n\nIt is stable."), (1, 2, "user", "On Mon, X wrote:\n>> how do  I sort?\n> use SORT().\n>\n> It is stable.\nThanks!"), (2, 0, "user", "> It is stable.\nReally?"), (2, 1, None, "Yes"), (3, 0, "user", "> Really?\nstill?"), (4, 0, None, None)]
    got = {(r["conv_id"], r["turn"]): r for r in chat.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    parent = {k: (r["parent_conv"], r["parent_turn"]) for k, r in got.items()}
    assert parent == {(1, 0): (None, None), (1, 1): (1, 0), (1, 2): (1, 1), (2, 0): (1, 1), (2, 1): (2, 0), (3, 0): (2, 0), (4, 0): (None, None)}
    assert {k: r["thread"] for k, r in got.items() if k[0] < 4} == {k: 1 for k in got if k[0] < 4}
    assert [got[k]["position"] for k in sorted(got) if k[0] < 4] == list(range(6)) and got[1, 2]["body"] == "Thanks!" and got[4, 0]["body"] == ""
    assert got[1, 2]["quotes"] == got[1, 2]["links"] == 2
    assert chat.op9_chat(spark, SF).count() == spark.read.parquet(f"{SF}/conversations.parquet").count()


def test_op9_quotes_of_a_part(spark):
    one, two = "First part.\r\n\r\nSecond part.\r\n\r\nThird part.", "line one\nline two\nline three"
    rows = [(1, 0, "user", one), (1, 1, "user", "Other."), (1, 2, "user", "> First part.\n>\n> Second part.\nyes"), (1, 3, "user", two), (1, 4, "user", "Aside."), (1, 5, "user", "> line two\n> line three\nno"), (2, 0, "user", "> Second part.\r\n>\r\n> Third part.\r\nhm"), (2, 1, "user", "> never said\nok"), (2, 2, "user", "> Aside.\n> > never\nok"), (2, 2, "user", "> Aside.\n> > never\nok")]
    got = {(r["conv_id"], r["turn"]): r for r in chat.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    at = lambda *k: (got[k]["parent_conv"], got[k]["parent_turn"], got[k]["quotes"], got[k]["links"])
    assert at(1, 2) == (1, 0, 1, 1) and at(1, 5) == (1, 3, 1, 1) and at(2, 0) == (1, 0, 1, 1)
    assert at(2, 1) == (2, 0, 1, 0) and at(2, 2) == (1, 4, 4, 2)
    assert got[2, 0]["thread"] == got[2, 1]["thread"] == 1 and got[1, 0]["body"] == one.replace("\r\n", "\n")


def test_op10_law_and_slots(spark, odd, none):
    got = sharding.op10_sharding(spark, SF).toPandas()
    docs = documents().set_index("doc_id")["text"].fillna("")
    assert all(s == len(docs[i].encode()) + 16 and c == zlib.crc32(docs[i].encode()) for i, s, c in zip(got["doc_id"], got["size"], got["text_crc32"]))
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    moved = got[got["shard"] != got["grown_shard"]]
    assert set(moved["grown_shard"]) <= {40} and got["shard"].between(0, 39).all()
    assert sharding.shard_documents(odd).count() == len(ODD) and sharding.shard_documents(none).count() == 0


def test_op10_movement_stays_in_changed_subtrees(spark):
    from pyspark.sql import functions as F

    old = sharding.layout(40)
    new = [(r, k, s, 3.0 if s == 7 else w) for r, k, s, w in old]
    rows = spark.range(4000).select("id", sharding.place(F.col("id"), old, top=4.0).alias("a"), sharding.place(F.col("id"), new, top=4.0).alias("b")).where("a <> b").collect()
    region = {s: r for r, _, s, _ in old}
    rack = {s: k for _, k, s, _ in old}
    for r in rows:  # into the region, the rack or the shard whose weight rose
        assert region[r["b"]] == region[7] and (region[r["a"]] != region[7] or rack[r["b"]] == rack[7] and (rack[r["a"]] != rack[7] or r["b"] == 7))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("source", "source")
    last = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        docs = corpus_pipeline.staged(kept, "t")
        assert docs.count() <= last
        last = docs.count()
    texts = docs.toPandas()
    assert texts["text"].map(lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")).is_unique
    assert corpus_pipeline.run(spark, SF).count() == last
    pd.testing.assert_series_equal(texts["doc_id"].sort_values().reset_index(drop=True), texts["doc_id"].sort_values().drop_duplicates().reset_index(drop=True))

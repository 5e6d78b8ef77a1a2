import base64
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from layerlens.llm import bpe, hosts, html, lattice, licenses, line_dedup, minhash, mixing, quality, queries, substrings
from layerlens.llm.common import map_arrow, table
from layerlens.session import Scratch
from tests.llm import brute
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


def rows_of(spark, rows, name="text"):
    return spark.createDataFrame(rows, f"doc_id long, {name} string")


EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, "a b " * 5000), (6, "a b " * 5000)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    from layerlens.llm.common import SCHEMAS

    for table_name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table_name}.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []


# Embeddings


def test_repeated_vectors_count_once_each(spark):
    v, w = [1.0, 0.0, 0.1], [1.0, 0.01, 0.1]
    rows = [(1, v, 0), (1, v, 0), (2, w, 0), (3, [0.0, 1.0, 0.0], 0), (4, v, 1)]
    out = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.id, r.n_links, r.component_id) for r in out) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4)]



def test_lattice_points():
    x = np.random.default_rng(3).normal(size=(500, 8)) * 2
    points = lattice.decode(x)
    doubled = 2 * points
    assert (doubled == np.rint(doubled)).all()
    assert (points.sum(axis=1) % 2 == 0).all()
    assert ((doubled % 2).min(axis=1) == (doubled % 2).max(axis=1)).all()
    # No neighbour is closer.
    own = ((x - points) ** 2).sum(axis=1)
    others = ((x[:, None] - points[:, None] - lattice.NEIGHBOURS) ** 2).sum(axis=2)
    assert len(lattice.NEIGHBOURS) == 240
    assert (own <= others.min(axis=1) + 1e-9).all()


def test_vectors_at_the_threshold_are_found(spark):
    random = np.random.default_rng(8)
    rows = []
    for i in range(400):
        a = random.normal(size=32)
        a /= np.linalg.norm(a)
        b = random.normal(size=32)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        c = 0.9802
        rows += [(2 * i, a.tolist(), 1), (2 * i + 1, (3 * (c * a + np.sqrt(1 - c * c) * b)).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = lattice.near_duplicates(df).collect()
    assert all(r.n_links == 1 and r.component_id == r.id - r.id % 2 for r in out)


def test_vectors_that_link_with_nothing(spark):
    v = [1.0, 2.0]
    rows = [
        (1, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, v, None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0], 1),
        (9, [1.0, None], 1), (10, [float("nan"), 1.0], 1), (11, [2.0, 4.0], 1), (12, [1.0, 2.0, 0.0], 1), (None, v, 3),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = {r.id: (r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(df).collect()}
    assert {i: out[i] for i in (1, 2, 11)} == {1: (2, 1, True), 2: (2, 1, False), 11: (2, 1, False)}
    assert all(out[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 12))
    assert out[None][0] == 0 and out[None][2]


# Pages


def test_article_only():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body>
    <header><p>Site</p></header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="ad">Buy, now.</div>
    <article><header><h1>The   head</h1></header><p><b>First &amp; second,<br>third.<br><p>Fourth&nbsp;x, fifth. <i>in</i>line
    <form>Mail <input></form><section class="comments"><p>Nice, very nice, so nice, indeed.</p></section></article>
    <aside>More, more.</aside><footer>&copy; 2020</footer></body></html>"""
    assert html.main_text(page) == "The head\nFirst & second, third.\nFourth x, fifth. inline"


_LONG = "A sentence of some words, and of some more, ends here."


@pytest.mark.parametrize("page", [
    "<article><section><p>" + "</p><p>".join([_LONG] * 6) + "</p></section><section><p>" + "</p><p>".join([_LONG] * 4) + "</p></section></article>",
    f"<article><h1>Title</h1><p>Lead.</p><section><p>{_LONG}</p><p>{_LONG}</p></section></article>",
    f"<main><h1>Title</h1><div><p>{_LONG}</p><p>{_LONG}</p></div></main>",
    f"<div><p>{_LONG}</p><table><tr><td>{_LONG} {_LONG} {_LONG}</td></tr></table><p>{_LONG}</p></div>",
])
def test_articles_of_parts(page):
    import re

    whole = " ".join(re.sub("<[^>]*>", " ", page).split())
    assert " ".join(html.main_text(f"<html><body>{page}</body></html>").split()) == whole


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "layout has-sidebar", "post comments-open", "page-with-menu"])
def test_names_of_wrappers(name):
    body = f'<div class="{name}"><p>{_LONG}</p><p>{_LONG}</p><div class="comments"><p>Nice, very nice.</p></div></div>'
    assert html.main_text(f"<body>{body}<div class=menu><p>Home, news.</p></div></body>") == f"{_LONG}\n{_LONG}"


def test_names_of_headings():
    parts = "".join(f'<h2 id="{i}">Head {i}</h2><p>{_LONG}</p>' for i in ("related-work", "search", "comments-on-x"))
    assert html.main_text(f"<article>{parts}</article>").split("\n")[::2] == ["Head related-work", "Head search", "Head comments-on-x"]


@pytest.mark.parametrize("before", ['<script>var s="<!--";</script>', "<style><!-- p{}</style>", "<script>a <!-- b</script><!-- x -->"])
def test_comment_marks_outside_the_markup(before):
    assert html.main_text(f"{before}<article><p>{_LONG}</p></article>") == _LONG
    assert html.main_text(f"<article><p>{_LONG}</p></article><!-- open <p>{_LONG}</p>") == _LONG


def test_comments_and_notices_longer_than_the_article():
    short = "A short post, with one remark."
    comments = "".join(f'<div class="comment"><p>{_LONG} {i}</p></div>' for i in range(20))
    assert html.main_text(f'<body><article><p>{short}</p><section class="comments">{comments}</section></article></body>') == short
    assert html.main_text(f'<body><div><p>{short}</p></div><div id="comments"><ol>{comments}</ol></div></body>') == short
    notice = f'<div class="cookie-notice"><p>{_LONG}</p><p>{_LONG}</p></div>'
    assert html.main_text(f"<body><div><h1>Title</h1><p>{short}</p></div>{notice}</body>").split("\n")[-1] == short
    # An article inside keeps its container.
    assert _LONG in html.main_text(f'<div class="comments"><article><h1>On comments</h1><p>{_LONG}</p></article></div>')


@pytest.mark.parametrize("tag", ["b", "font", "div", "unknown"])
def test_many_open_elements_take_linear_time(tag):
    started = time.perf_counter()
    assert html.main_text(f"<article><p>{_LONG}</p></article>" + f"<{tag}>" * 50_000 + "</i></em>" * 1000).startswith(_LONG)
    assert time.perf_counter() - started < 2


def test_names_never_empty_a_page():
    parts = "".join(f'<div id="{i}"><p>{_LONG}</p></div>' for i in ("related-work", "search-methods"))
    assert html.main_text(f"<body>{parts}</body>") == f"{_LONG}\n{_LONG}"


@pytest.mark.parametrize("page", [None, "", " ", "<", "<html><body></body></html>", "<script>x", "<!-- x"])
def test_pages_without_text(page):
    assert html.main_text(page).strip("<") == ""


def test_deep_page():
    assert html.main_text("<div>" * 20000 + "Deep, deep text." + "</div>" * 20000) == "Deep, deep text."


def test_generated_pages(spark):
    import re
    from html import unescape

    out = queries.op2_html_extraction(spark, SF).collect()
    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    assert len(out) == len(pages)
    for r in out:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S).group(1)
        blocks = re.split(r"</?(?:p|h1|br)[^>]*>", article)
        want = " ".join(unescape(re.sub("<[^>]*>", "", " ".join(blocks))).split())
        assert " ".join(r.text.split()) == want
        assert r.n_chars == len(r.text)


# Tokens


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path(queries.VOCABULARY), "rb") as file:
        return bpe.vocabulary(file.read(), public_tokenizers.PATTERN)


def test_bpe_pairs_are_those_that_merging_leaves():
    """Also in vocabularies whose tokens rank before their parts or cannot be merged at all."""
    draw = random.Random(4)
    for turn in range(60):
        letters = b"ab" if turn % 2 else b"abc"
        found = {bytes([c]) for c in letters}
        while len(found) < 14:
            found.add(bytes(draw.choice(letters) for _ in range(draw.randrange(2, 6))))
        tokens = draw.sample(sorted(found), len(found))
        if turn % 3 == 0:
            tokens.sort(key=len)
        small = bpe.Vocabulary({t: 7 * i for i, t in enumerate(tokens)}, "(?s).+")
        for a in range(len(tokens)):
            for b in range(len(tokens)):
                assert small._compatible(7 * a, 7 * b) == (small.merged(tokens[a] + tokens[b]) == [7 * a, 7 * b])


def test_bpe_merges_single_tokens_only_and_forgets(vocabulary, monkeypatch):
    words = vocabulary
    """An unseen pair costs a few lookups, not a merge of its joined bytes; few answers are held."""
    merge, asked = words.merged, []
    monkeypatch.setattr(words, "merged", lambda raw, *parts: asked.append(raw) or merge(raw, *parts))
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 50)
    words.pairs.clear()
    words.pieces.clear()
    draw = random.Random(6)
    for _ in range(300):
        piece = "".join(draw.choice("etaoinshr\u00e9") for _ in range(12))
        assert words.encode(piece).tolist() == merge(piece.encode())
    assert all(raw in words.ranks for raw in asked) and len(words.pairs) <= 50
    assert words.encode("").tolist() == []



@pytest.fixture(scope="module")
def tiktoken_encoding(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_tokens_of_all_documents(docs, vocabulary, tiktoken_encoding):
    for _, text in docs:
        ids = vocabulary.encode(text or "")
        assert ids.tolist() == tiktoken_encoding.encode_ordinary(text or "")
        assert vocabulary.decode(ids) == (text or "").encode()


def test_tokens_of_noise(vocabulary, tiktoken_encoding):
    random = np.random.default_rng(4)
    for alphabet in ("ab", "aeinrst", " \n\t a", "абвгд ", "日本語のテ", "\U0001f600\u0301é0 x", "=-#*"):
        for size in (1, 2, 3, 7, 50, 3000):
            for _ in range(20):
                text = "".join(random.choice(list(alphabet), size))
                assert vocabulary.encode(text).tolist() == tiktoken_encoding.encode_ordinary(text)


def test_long_single_piece(vocabulary):
    assert vocabulary.decode(vocabulary.encode("ab" * 200_000)) == b"ab" * 200_000


def test_token_query_edges(spark):
    out = {r.doc_id: r for r in queries.token_digests(rows_of(spark, EDGES)).collect()}
    assert out[1].n_tokens == out[2].n_tokens == 0 and out[1].ids_sha256 == brute.sha("")
    assert out[6].decoded_sha256 == brute.sha("a b " * 5000)


# Lines, near copies, passages


def test_lines(spark, docs):
    want = brute.dedup_lines(docs)
    out = queries.op4_line_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in out} == {
        i: (n, d, brute.sha(t)) for i, (n, d, t) in want.items()
    }


def test_line_edges(spark):
    out, name = line_dedup.dedup_lines(rows_of(spark, EDGES).withColumn("lines", F.lit(1)))
    assert [(r.doc_id, r[name].n_lines) for r in out.orderBy("doc_id").collect()] == [
        (1, 1), (2, 1), (3, 2), (4, 1), (5, 1), (6, 1), (6, 1)
    ]


@pytest.mark.parametrize("words", [2, 5])
def test_near_copies(spark, docs, words):
    want = brute.near_duplicates(docs, words)
    out = minhash.near_duplicates(rows_of(spark, docs), words=words).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.id == r.component_id) for r in out)


def test_near_copies_in_a_group(spark):
    """Copies of one text with a few words changed, a chain and texts that only share a half."""
    random = np.random.default_rng(2)
    word = [f"w{i}" for i in range(400)]
    base = list(random.choice(word, 120))
    texts = []
    for _ in range(300):
        t = list(base)
        for at in random.integers(0, 120, random.integers(1, 7)):
            t[at] = str(random.choice(word))
        texts.append(t)
    for i in range(60):  # a chain: each is close to the next only
        texts.append([f"c{j}" for j in range(8 * i, 8 * i + 100)])
    texts += [base[:60] + list(random.choice(word, 60)) for _ in range(100)]
    rows = [(i + 1, " ".join(t)) for i, t in enumerate(texts)]
    out = minhash.near_duplicates(rows_of(spark, rows)).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in out} == brute.near_duplicates(rows)


def test_near_copies_among_strangers_alike(spark):
    """Thousands of texts that are alike at 0.7 without being copies; some have one copy at 0.8."""
    random = np.random.default_rng(4)
    size, words, own, planted = 3000, 300, 247, 60
    has = np.zeros((size, words), np.int64)
    for row in has:
        row[random.permutation(words)[:own]] = 1
    for i in range(planted):
        has[i + planted] = has[i]
        has[i + planted, random.choice(np.flatnonzero(has[i]), 27, replace=False)] = 0
        has[i + planted, random.choice(np.flatnonzero(has[i] == 0), 27, replace=False)] = 1
    shared = has @ has.T
    assert (100 * shared >= 80 * (2 * own - shared)).sum() == size + 2 * planted
    rows = [(i + 1, " ".join(f"w{j}" for j in np.flatnonzero(row))) for i, row in enumerate(has)]
    out = minhash.near_duplicates(rows_of(spark, rows), words=1).collect()
    found = {r.id: r.component_id for r in out}
    assert found == {i + 1: i + 1 - planted if planted <= i < 2 * planted else i + 1 for i in range(size)}


def test_near_copy_edges(spark):
    out = sorted(minhash.near_duplicates(rows_of(spark, EDGES)).collect())
    assert [(r.id, r.n_shingles, r.component_id) for r in out] == [
        (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 2, 6), (6, 2, 6)
    ]


def test_passages(spark, docs):
    want = brute.remove_repeats(docs)
    out = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op8_substring_dedup(spark, SF).collect()}
    assert out == {i: (n, d, brute.sha(t)) for (i, _), (n, d, t) in zip(docs, want)}


def test_passages_inside_one_text(spark):
    run = " ".join(f"x{i}" for i in range(35))
    rows = [(1, f"a {run} b {run} c"), (2, run[:-3]), (3, "z " * 80), (4, None), (4, ""), (5, "q " * 35)]
    out, name = substrings.remove_repeats(rows_of(spark, rows).withColumn("spans", F.lit(0)))
    found = sorted((r.doc_id, r[name].n_words, r[name].n_removed, r.text) for r in out.collect())
    assert found == sorted(
        (i, n, d, t) for (i, _), (n, d, t) in zip(rows, brute.remove_repeats(rows))
    )


# Urls


def test_url_parts(spark):
    rows = [
        ("http://A.Example.com/x/Y?z#u", "a.example.com", "/x/Y"), ("https://h", "h", ""), ("h://x?y://z", "x", ""),
        (None, "", ""), ("no scheme", "", ""), ("://", "", ""), ("a://b#/c", "b", ""), ("x\ny://H/p\nq?", "h", "/p\nq"),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "page_id long, url string")
    out, name = hosts.judge(df, spark.createDataFrame([], "page_id long, good int"), queries.URL_RULES)
    found = {r.page_id: r[name] for r in out.collect()}
    assert [(found[i].host, found[i].path) for i in range(len(rows))] == [r[1:] for r in rows]
    assert all(found[i].verdict == "allow" for i in found)


def test_registered_domains(spark):
    want = {
        "www.a.co.uk": ("co.uk", "a.co.uk"), "b.co.uk:80": ("co.uk", "b.co.uk"), "x.y.gov.br": ("gov.br", "y.gov.br"),
        "x.a.com": ("com", "a.com"), "co.uk": ("co.uk", "co.uk"), "h": ("h", "h"), "": ("", ""),
        "10.0.2.3:8080": ("[ip]", "10.0.2.3"), "11.9.2.3": ("[ip]", "11.9.2.3"), "[::1]:80": ("[ip]", "[::1]"),
    }
    df = spark.createDataFrame([(h,) for h in want], "host string")
    found = df.select("host", *hosts.levels(F.col("host"))).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == want


@pytest.mark.parametrize("url, rule, verdict", [
    ("http://www.example.org/es/x", "example.org/es/", "block"), ("http://example.org/fr/", "org/", "allow"),
    ("http://example.org/en/12", "example.org/en/1", "block"), ("http://x.org", None, "allow"),
    ("http://badexample.org/es/", "org/", "allow"), ("http://a.com/de/1", "com/de/", "block"),
])
def test_url_rules(spark, url, rule, verdict):
    df = spark.createDataFrame([(1, url)], "page_id long, url string")
    out, name = hosts.judge(df, spark.createDataFrame([], "page_id long, good int"), queries.URL_RULES)
    (row,) = out.collect()
    assert (row[name].rule, row[name].verdict) == (rule, verdict)


def test_bad_hosts_are_blocked(spark):
    rows, marks = [], []
    for h in range(20):
        for p in range(30):
            rows.append((100 * h + p, f"http://h{h}.site{h % 4}.net/{p}"))
            if p < 20 and h != 19:
                marks.append((100 * h + p, int(h % 4 != 1 if p else 1)))
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("judged", F.lit(1))
    out, name = hosts.judge(pages, spark.createDataFrame(marks, "page_id long, good int"), [])
    blocked = {r.page_id // 100 for r in out.collect() if r[name].verdict == "block"}
    assert blocked == {h for h in range(20) if h % 4 == 1}


# Licences


def test_license_forms_are_normalised():
    assert all(licenses.normalised(s) == s for forms in licenses.SENTENCES.values() for s in forms)


def test_wrapped_license(spark):
    grant, keep = licenses.SENTENCES["mit-grant"][0], licenses.SENTENCES["mit-keep"][0]
    lines = (grant.replace(" and ", "\nand ") + ":\n\n" + keep + ".").upper()
    rows = [(1, lines), (2, keep + ". " + grant), (3, None), (4, "x\nSPDX-License-Identifier: MIT\ny")]
    out, name = licenses.scan(rows_of(spark, rows))
    assert {r.doc_id: r[name].licenses for r in out.collect()} == {1: ["MIT"], 2: [], 3: [], 4: ["MIT"]}


def test_spdx_tags(spark):
    cases = [(f"{mark}SPDX-License-Identifier: {value}{end}", license)
             for license, values in licenses.SPDX.items() for value in values for mark, end in (("// ", "\nint x;\n"), ("/* ", " */"))]
    cases += [("SPDX-License-Identifier: Unknown-1.0\n", None), ("identifier: MIT", None)]
    out, name = licenses.scan(rows_of(spark, [(i, t) for i, (t, _) in enumerate(cases)]))
    assert {r.doc_id: r[name].licenses for r in out.collect()} == {i: [v] if v else [] for i, (_, v) in enumerate(cases)}


_MIT = """MIT License

Copyright (c) 2020 X

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
_GPL = """Copyright (C) 2020 X

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
_ISC = """Copyright (c) 2020 X
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


_BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
_BSD3 = _BSD2.replace("THIS SOFTWARE", """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE""")
_ZLIB = """Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
_EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/
"""


def test_licenses_apart(spark):
    """Licences with sentences in common, wrapped, as one paragraph each and behind comment marks."""
    # The numbers of the clauses are sentences of their own.
    want = {_BSD2: "BSD-2-Clause", _BSD3: "BSD-3-Clause", _ZLIB: "Zlib", _EPL: "EPL-2.0", "CC0 1.0 Universal\n": "CC0-1.0",
            "This file is released under the GNU General Public License version 2.\n": "GPL-2.0"}
    marked = [("".join(mark + line + "\n" for line in t.splitlines()), v) for t, v in want.items() for mark in ("", " * ", "# ")]
    out, name = licenses.scan(rows_of(spark, [(i, t) for i, (t, _) in enumerate(marked)]).withColumn("license_scan", F.lit(1)))
    assert {r.doc_id: r[name].licenses for r in out.collect()} == {i: [v] for i, (_, v) in enumerate(marked)}


def test_canonical_licenses(spark):
    want = {
        _MIT.split("\n\n", 1)[1]: "MIT", _MIT.replace("X\n\n", "X\n").split("\n\n", 1)[1]: "MIT", _GPL: "GPL-3.0",
        _GPL.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2"): "GPL-2.0",
        _GPL.replace("GNU General", "GNU Lesser General"): "LGPL-3.0", _ISC: "ISC", _MPL: "MPL-2.0",
        "GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007\n": "AGPL-3.0",
        "This project is licensed under the MIT license.": "MIT",
    }
    marked = [("".join(mark + line + "\n" for line in t.splitlines()), v) for t, v in want.items() for mark in ("", " * ", "# ", "// ")]
    out, name = licenses.scan(rows_of(spark, [(i, t) for i, (t, _) in enumerate(marked)]))
    assert {r.doc_id: r[name].licenses for r in out.collect()} == {i: [v] for i, (_, v) in enumerate(marked)}


# Mixing and quality


def test_mix(spark, docs):
    out = queries.op9_mixing(spark, SF).collect()
    source = {r.doc_id: r.source for r in table(spark, SF, "documents").collect()}
    size = {i: len(brute.WORD.findall(t or "")) for i, t in docs}
    total: dict = {}
    for i in size:
        total[source[i]] = total.get(source[i], 0) + size[i]
    want, taken = brute.targets(total), dict.fromkeys(total, 0)
    for r in out:
        assert (r.size, r.source_size) == (size[r.doc_id], total[source[r.doc_id]])
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        assert r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    for s in total:
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], 50)
    assert sorted(out) == sorted(queries.op9_mixing(spark, SF).collect())


def test_mix_edges(spark):
    df = spark.createDataFrame([(1, None, None), (2, "s", "a b c"), (None, "s", "d"), (3, None, "x y")], "doc_id long, source string, text string")
    out, name = mixing.mix(df.withColumn("mix", F.lit(1)))
    assert len(out.collect()) == 4
    assert mixing.copied(df).columns == df.columns


def test_quality_measures(docs):
    for _, text in docs + EDGES:
        assert quality.measures_of(text)[:5] == brute.measures(text)


def test_quality_keeps_the_good(spark):
    judged = queries.op10_quality_rules(spark, SF)
    out = {r.doc_id: r for r in judged.collect()}
    assert all(
        r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
        for r in out.values()
    )
    marks = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [out[m.doc_id].kept for m in marks if m.quality == 1 and not out[m.doc_id].base_failed]
    bad = [out[m.doc_id].kept for m in marks if m.quality == 0]
    assert np.mean(good) > 0.95
    assert np.mean(bad) < 0.05


def _long_texts(spark):
    return spark.range(2000, numPartitions=1).select("id", F.repeat(F.lit("text "), 4000).alias("text"))


def _bytes_of(batch):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["bytes", "rows"])


def test_functions_of_rows_get_bounded_pieces(spark):
    def run(batch):
        yield _bytes_of(batch)

    found = map_arrow(_long_texts(spark), run, "bytes long, rows long").collect()
    assert sum(r.rows for r in found) == 2000
    assert max(r.bytes for r in found) < 6 << 20


def test_stored_steps_get_short_batches(spark):
    def run(batches):
        for batch in batches:
            yield _bytes_of(batch)

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    scratch = Scratch(spark)
    stored = scratch.written(_long_texts(spark).mapInArrow(run, "bytes long, rows long"), "batches")
    found = stored.collect()
    scratch.drop(stored)
    assert sum(r.rows for r in found) == 2000
    assert max(r.bytes for r in found) < 12 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before

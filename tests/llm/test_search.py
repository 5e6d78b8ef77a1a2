import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from layerlens.llm import search
from tests.llm.brute import UPPER

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, top=20):
    counts = [Counter(terms(t)) for _, t in docs]
    lengths = [sum(c.values()) for c in counts]
    n_docs, total = sum(n > 0 for n in lengths), sum(lengths)
    held = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), c, n in zip(docs, counts, lengths):
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1)))
                    score += w * ((10**9 * c[t]) // (1000 * c[t] + 12 * (75 + 25 * n * n_docs // total)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, null, doc) in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, None if null else doc, -score))
    return out


def found(spark, docs, items, **options):
    got = search.search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
        spark.createDataFrame(items, "item_id long, text string"), **options,
    )
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3]))


def by_item(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3]))


def _texts(seed, n, words=30):
    rng = random.Random(seed)
    names = ["a", "B", "éa", "x1", "Ü", "中文", "q", "zz", "k9", "lo", "und", "the"]
    return [" ".join(rng.choice(names) + rng.choice(["", "-", ", ", "\x00"]) for _ in range(rng.randint(1, words))) for _ in range(n)]


@pytest.mark.parametrize("graph_terms", [1, search.GRAPH_TERMS])
def test_same_as_brute_force(spark, graph_terms):
    """With all items in one graph and dealt to many, and more ties than places."""
    docs = list(enumerate(_texts(1, 80))) + [(200 + i, "tie tie") for i in range(40)]
    items = list(enumerate(_texts(2, 12, 8))) + [(50, "tie"), (51, "nothing of this")]
    assert found(spark, docs, items, graph_terms=graph_terms) == by_item(brute(docs, items))


def test_nulls_repeats_and_long_texts(spark):
    docs = [(1, None), (2, ""), (3, "..."), (4, "one two"), (4, "one two"), (None, "one"), (5, "one " * 50_000), (6, "Two")]
    items = [(1, "one"), (1, "one"), (2, None), (3, ""), (None, "two two ONE")]
    assert found(spark, docs, items) == by_item(brute(docs, items))


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == found(spark, [(1, "a")], []) == found(spark, [(1, ".")], [(1, "a")]) == []


def test_graph_adds_up_to_the_queries():
    """Every query's node is the sum of its terms with repeats, with fewer additions than terms."""
    rng = random.Random(3)
    common = [rng.randrange(500) for _ in range(40)]
    queries = [[rng.randrange(500) for _ in range(20)] + common[: rng.randint(0, 40)] for _ in range(60)] + [[], [3, 3, 3]]
    graph = search.share(queries)
    values = np.array([rng.randrange(10**6) for _ in range(500)])
    table = np.zeros(graph.size, np.int64)
    table[: len(graph.symbols)] = values[graph.symbols]
    for made, a, b in graph.levels:
        table[made] = table[a] + table[b]
    assert [0 if e < 0 else int(table[e]) for e in graph.ends] == [int(values[q].sum()) for q in queries]
    assert sum(len(made) for made, _, _ in graph.levels) < 0.7 * sum(map(len, queries))


def test_other_columns_and_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6)], "id long, body string, score long, rank int")
    items = spark.createDataFrame([(7, "b")], "q long, body string")
    out = search.search(docs, items, doc_id="id", text="body", item_id="q", item_text="body").collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in out] == [(7, 1, 1)]

import hashlib

import pytest
from pyspark.sql import functions as F

from layerlens.llm import merkle

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    """Of (doc_id, text, lang, source, n_chars)."""
    doc_id, text, lang, source, n_chars = row
    values = (doc_id, source, lang, n_chars, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([sha("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
    return out


def beside(tree, at):
    out = []
    for level in tree[:-1]:
        first = at // 16 * 16
        out.append((level[first:at], level[at + 1 : first + 16]))
        at //= 16
    return out


def brute(rows, shown=lambda row: None):
    """Per row (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, levels([leaf(r) for r in own])))
    top = levels([t[-1][0] for _, t in trees])
    out = []
    for p, (own, tree) in enumerate(trees):
        for i, r in enumerate(own):
            path = beside(tree, i) + beside(top, p)
            folded = shown(r) or leaf(r)
            for left, right in path:
                folded = sha("".join([*left, folded, *right]))
            proof = sha("".join("".join(left + right) for left, right in path))
            out.append((r[0], leaf(r), tree[-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


def key(row):
    return tuple((v is not None, v or 0) if i == 0 else v for i, v in enumerate(row))


def check(spark, rows, **options):
    manifest = merkle.manifest_of(spark.createDataFrame(rows, COLUMNS).repartition(3))
    got = [tuple(r) for r in merkle.prove(manifest, manifest.leaves, **options).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    return manifest


def _rows(n, source, start=0):
    return [(start + i, f"Text {i}\n", "en", source, i) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 300])
def test_sizes_of_a_tree(spark, n):
    check(spark, _rows(n, "a"))


def test_many_sources_nulls_and_repeats(spark):
    rows = _rows(40, None) + _rows(1, "", 100) + _rows(2, "é", 200) + _rows(33, "z", 300)
    rows += [(None, "no id", None, "z", None), (None, None, None, None, None), (7, "", "en", None, 0), (7, None, "en", None, 0)]
    rows += [rows[3]] * 20 + [(9, "long " * 50_000, "en", "z", 250_000)]
    rows += [(1000 + i, "x", "en", f"s{i}", 1) for i in range(20)]
    assert check(spark, rows).root == check(spark, rows, block=16).root


def test_any_part_can_be_proven(spark):
    """Proofs of few rows equal those made with all of them, and tampering shows."""
    rows = _rows(700, "a") + _rows(30, "b", 1000)
    manifest = merkle.manifest_of(spark.createDataFrame(rows, COLUMNS))
    wanted = manifest.leaves.where(F.col("doc_id").isin(3, 500, 699, 1007))
    got = sorted(tuple(r) for r in merkle.prove(manifest, wanted).collect())
    assert got == sorted(r for r in brute(rows) if r[0] in (3, 500, 699, 1007))
    false = wanted.withColumn("presented", F.when(F.col("doc_id") == 500, F.sha2(F.lit("other"), 256)))
    found = {r.doc_id: r.verified for r in merkle.prove(manifest, false, siblings=True).collect()}
    assert found == {3: True, 500: False, 699: True, 1007: True}


def test_missing_nodes_are_the_least_union():
    """Nothing asked for follows from the leaves, and nothing needed is left out."""
    import numpy as np

    for own, n in (([0], 5000), ([0, 1, 300, 4999], 5000), (list(range(256)), 5000), (list(range(20)), 20)):
        asked = {(level, int(a)) for level, at in merkle.missing(np.array(own), n) for a in at}
        known, level, size, need = set(own), 0, n, set()
        while size > 1:
            runs = {a // 16 for a in known}
            need |= {(level, a) for r in runs for a in range(r * 16, min(r * 16 + 16, size)) if a not in known}
            known, level, size = runs, level + 1, -(-size // 16)
        assert asked == need


def test_empty_table_and_other_columns(spark):
    empty = merkle.manifest_of(spark.createDataFrame([], COLUMNS))
    assert empty.root is None and merkle.prove(empty, empty.leaves).collect() == []
    rows = _rows(20, "a")
    other = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit(1) for c in ("tree", "at", "n", "leaf", "digest", "_part")})
    assert merkle.manifest_of(other).root == brute(rows)[0][3]

import base64
import hashlib
import os
import struct
from collections import Counter

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from layerlens.llm import minhash, mixing, quality, queries
from layerlens.llm.common import table
from layerlens.session import shared_root
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {r.doc_id for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        left = {r.doc_id for r in docs.collect()}
        assert left and left <= seen
        seen = left
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert sorted(out.collect()) == sorted(corpus_pipeline.run(spark, SF).collect())


def test_only_stages_stay(spark):
    """What a stage stored on its way is gone once the stage is written."""
    root = shared_root(spark)
    before = set(os.listdir(root))
    assert corpus_pipeline.run(spark, SF).count() > 0
    left = sorted(f.rsplit("-", 1)[0] for f in set(os.listdir(root)) - before)
    assert left == sorted(f"stage-{name}" for name, _ in corpus_pipeline.STAGES)


def test_stages_leave_only_what_their_rows_are_read_from(spark):
    """A stage alone, its rows not read yet: no second copy of the texts, no runs or line keys."""
    root, docs = shared_root(spark), table(spark, SF, "documents")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = set(os.listdir(root))
        rows = stage(spark, docs, SF)
        left[name] = sorted(f.rsplit("-", 1)[0] for f in set(os.listdir(root)) - before)
        assert rows.count() > 0
    assert left == {"quality_rules": [], "line_dedup": ["lost-lines"], "minhash_near_dedup": ["documents", "gone"]}


def test_near_dedup_moves_no_texts_to_return_them(spark):
    """Where the documents that go are too many to be sent to all tasks, they alone move."""
    docs = table(spark, SF, "documents").unionByName(
        spark.createDataFrame([(None, "one two", "en", "web", 7), (None, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    ).withColumn("ID", F.lit(1))
    want = brute.near_duplicates([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None], words=5, percent=80)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        out = minhash.filter_documents(docs, words=5, percent=80)
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = sorted(out.collect(), key=str)
    finally:
        spark.conf.set(threshold, before)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" in plan
    kept = [r for r in docs.collect() if r.doc_id is None or want[r.doc_id][1] == r.doc_id]
    assert out.columns == docs.columns and rows == sorted(kept, key=str) and len(kept) < docs.count()


def test_every_stage_against_a_plain_version(spark):
    """Each stage on what the one before it kept. The verdicts of the quality model and the
    rates of the mix are the operators' own, which their tests compare with plain versions;
    here it counts that they take effect and that nothing else changes."""
    encoding = tiktoken.Encoding(
        "plain", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks={
            base64.b64decode(a): int(b)
            for a, b in map(bytes.split, open(public_tokenizers.path(queries.VOCABULARY), "rb"))
        },
    )
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, SF, "documents")

    def rows(df):
        return sorted(map(tuple, df.collect()))

    def through(name, docs):
        return corpus_pipeline.written(stages[name](spark, docs, SF), "test-stage")

    judged, verdict = quality.judge(docs, keep=["doc_id"])
    good = {r.doc_id for r in judged.collect() if r[verdict].kept}
    first = through("quality_rules", docs)
    assert rows(first) == sorted(r for r in rows(docs) if r[0] in good) and 0 < len(good) < docs.count()

    lines = brute.dedup_lines([(r.doc_id, r.text) for r in first.collect()])
    second = through("line_dedup", first)
    want = [(i, lines[i][2], lang, source, len(lines[i][2])) for i, _, lang, source, _ in rows(first)]
    assert rows(second) == sorted(want) and rows(second) != rows(first)

    groups = brute.near_duplicates([(r.doc_id, r.text) for r in second.collect()], words=5, percent=80)
    third = through("minhash_near_dedup", second)
    assert rows(third) == [r for r in rows(second) if groups[r[0]][1] == r[0]] and third.count() < second.count()

    mixed, at = mixing.mix(third, keep=["doc_id", "source"])
    copies = {r.doc_id: r[at].copies for r in mixed.collect()}
    fourth = through("mixing", third)
    assert rows(fourth) == sorted(r for r in rows(third) for _ in range(copies[r[0]]))
    sizes = Counter()
    for r in third.collect():
        sizes[r.source] += len(brute.WORD.findall(r.text or ""))
    taken = Counter()
    for r in fourth.collect():
        taken[r.source] += len(brute.WORD.findall(r.text or ""))
    target = brute.targets(sizes)
    longest = max(len(brute.WORD.findall(r.text or "")) for r in third.collect())
    assert all(abs(taken[s] - target[s]) <= longest for s in sizes)

    digests = []
    for doc_id, text, *_ in rows(fourth):
        ids = encoding.encode_ordinary(text)
        raw = struct.pack(f"<{len(ids)}I", *ids)
        digests.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), brute.sha(text)))
    assert rows(through("byte_bpe", fourth).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == sorted(digests)

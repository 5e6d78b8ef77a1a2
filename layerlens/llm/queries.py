"""The registered queries of this package, each with its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from layerlens.llm import bpe, hosts, html, language, lattice, licenses, line_dedup, merkle, minhash, mixing, quality, search, substrings
from layerlens.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
URL_RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def op1_embedding_near_dedup(spark, sf_dir):
    out = lattice.near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.withColumnRenamed("id", "vec_id")


def op2_html_extraction(spark, sf_dir):
    out, name = html.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", F.col(name).alias("text"), F.length(name).cast("long").alias("n_chars"))


def op3_byte_bpe(spark, sf_dir):
    return token_digests(table(spark, sf_dir, "documents"))


def token_digests(docs):
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    encoded, name = bpe.encode(docs.select("doc_id", "text"), path, pattern)
    rows = encoded.select("doc_id", F.col(f"{name}.n_tokens").alias("n_tokens"), F.col(f"{name}.ids").alias("ids"))
    decoded, raw = bpe.decode(rows, path, pattern)
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(raw, 256).alias("decoded_sha256")
    )


def op4_line_dedup(spark, sf_dir):
    out, name = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col(f"{name}.n_lines").alias("n_lines"), F.col(f"{name}.n_dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op5_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_host_reputation(spark, sf_dir):
    # The labels of this crawl go by one running number for pages and documents.
    outcomes = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("doc_id").alias("page_id"), F.col("quality").alias("good")
    )
    out, name = hosts.judge(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes, URL_RULES)
    return out.select("page_id", *[F.col(f"{name}.{c}").alias(c) for c in ("host", "path", "rule", "verdict")])


def op7_license_scan(spark, sf_dir):
    out, name = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.array_join(f"{name}.licenses", ",").alias("licenses"),
        F.size(f"{name}.sentences").cast("long").alias("n_sentences"),
    )


def op8_substring_dedup(spark, sf_dir):
    out, name = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col(f"{name}.n_words").alias("n_words"), F.col(f"{name}.n_removed").alias("n_removed"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op9_mixing(spark, sf_dir):
    out, name = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])
    at = F.col(name)
    return out.select(
        "doc_id", at.size.alias("size"), at.source_size.alias("source_size"), at.target.alias("target"),
        (at.copies * at.size).cast("long").alias("taken"),
    )


def op10_quality_rules(spark, sf_dir):
    out, name = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select("doc_id", *[F.col(f"{name}.{c}").alias(c) for c in columns])


def op11_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fields = [merkle.lowered(F.col(c)) if c == "text" else F.col(c) for c in merkle.FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf(*fields))
    manifest = merkle.manifest_of(docs, presented=tampered)
    return merkle.prove(manifest, manifest.leaves)


def op12_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.learn(docs.where(~held_out))
    out, name = language.identify(docs.select("doc_id", "text"), model, spans=False)
    return out.select(
        "doc_id", held_out.alias("held_out"), F.col(f"{name}.lang").alias("lang_pred"),
        F.col(f"{name}.score").alias("score"), F.col(f"{name}.n_spans").alias("n_spans"),
    )


def op13_ranked_search(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup, op2_html_extraction, op3_byte_bpe, op4_line_dedup, op5_minhash_near_dedup,
        op6_host_reputation, op7_license_scan, op8_substring_dedup, op9_mixing, op10_quality_rules,
        op11_merkle_manifest, op12_language_id, op13_ranked_search,
    )
}

_WHITE = r"\x20\x09-\x0D"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_KEY = f"translate(regexp_replace(line, '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g'), '{hosts.UPPER}', '{hosts.LOWER}')"


def _license_sql() -> str:
    known = ", ".join(f"('{s}', '{name}')" for name, forms in licenses.SENTENCES.items() for s in forms)
    rules = ", ".join(f"('{name}', ',{','.join(run)},')" for name, run in licenses.RULES)
    general = ", ".join(f"('{name}', '{x}')" for name, special in licenses.GENERAL.items() for x in special)
    begins = "|".join(licenses.beginnings(licenses.SENTENCES))
    return rf"""
WITH known(s, name) AS (VALUES {known}), rules(license, run) AS (VALUES {rules}), general(license, special) AS (VALUES {general}),
read AS (
  SELECT doc_id, regexp_replace(translate(coalesce(text, ''), '{hosts.UPPER}', '{hosts.LOWER}'), '{licenses.TAGGED}', '\1 ', 'g') AS t FROM documents),
cut AS (
  SELECT doc_id, 1 AS way, string_split_regex(t, '[.!?;:]+[ \t\r\n]+|\n') AS parts FROM read
  UNION ALL
  SELECT doc_id, 2, string_split_regex(t, '[.!?;:]+[ \t\r\n]+') FROM read
  UNION ALL
  SELECT doc_id, 3, string_split_regex(regexp_replace(replace(t, '_', ' '), '\n([^a-z0-9\n]*(?:{begins})\b)', chr(10) || chr(10) || '\1', 'g'), '[.!?;:]+[ \t\r\n]+|\n(?:[^a-z0-9\n]*\n)+') FROM read),
rows AS (SELECT doc_id, way, generate_subscripts(parts, 1) AS i, unnest(parts) AS part FROM cut),
named AS (
  SELECT doc_id, way, ',' || string_agg(name, ',' ORDER BY i) || ',' AS names, count(*) AS n
  FROM rows JOIN known ON s = trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g'), ' ') GROUP BY doc_id, way),
told AS (SELECT DISTINCT doc_id, license FROM named JOIN rules ON contains(names, run)),
found AS (SELECT * FROM told t WHERE NOT EXISTS (
  SELECT 1 FROM general g JOIN told o ON o.license = g.special WHERE g.license = t.license AND o.doc_id = t.doc_id))
SELECT d.doc_id, coalesce((SELECT string_agg(license, ',' ORDER BY license) FROM found f WHERE f.doc_id = d.doc_id), '') AS licenses,
  coalesce((SELECT n FROM named n WHERE n.doc_id = d.doc_id AND way = 1), 0) AS n_sentences
FROM documents d"""


def _reputation_sql() -> str:
    """Posterior counts level by level, each shrunk towards the one above, and the longest rule."""
    least, most = hosts.LEAST, hosts.MOST

    def shrunk(name, groups, keys, parent, on):
        join = f"JOIN {parent} p USING ({on})" if on else f"CROSS JOIN {parent} p"
        return f"""{name}_m AS (SELECT g.*, p.a / (p.a + p.b) AS m FROM {groups} g {join}),
{name}_c AS (
  SELECT least(greatest(coalesce((sum((y - n * m) ** 2) - sum(n * m * (1 - m))) / nullif(sum(n * m * (1 - m) * (n - 1)), 0), {most}), {least}), {most}) AS c
  FROM {name}_m WHERE n > 0),
{name} AS (SELECT {keys}, (1 / c - 1) * m + y AS a, (1 / c - 1) * (1 - m) + n - y AS b FROM {name}_m, {name}_c)"""

    def last(n):
        return f"array_to_string(parts[greatest(len(parts) - {n - 1}, 1):], '.')"

    cases = {"rule": "", "verdict": ""}
    for verdict, rule in reversed(sorted(reversed(URL_RULES), key=lambda r: len(r[1]))):
        own, _, rest = rule.partition("/")
        fits = f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{rest}')"
        cases["rule"] += f" WHEN {fits} THEN '{rule}'"
        cases["verdict"] += f" WHEN {fits} THEN '{verdict}'"
    suffixes = ", ".join(f"'{x}'" for x in hosts.SUFFIXES)
    bound = f"a / (a + b) + {hosts.BOUND} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))"
    parts = [
        rf"""judged AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{hosts.UPPER}', '{hosts.LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)""",
        """marks AS (SELECT doc_id AS page_id, count(*) AS n, sum(quality) AS y FROM labels WHERE quality IN (0, 1) GROUP BY doc_id)""",
        """counts AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(y), 0)::DOUBLE AS y FROM judged LEFT JOIN marks USING (page_id) GROUP BY host)""",
        r"""named AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS name FROM counts)""",
        f"""cut AS (SELECT *, string_split(name, '.') AS parts, regexp_matches(name, '{hosts.ADDRESS}') AS address FROM named)""",
        f"""hosts AS (
  SELECT host, n, y, CASE WHEN address THEN '[ip]' WHEN {last(2)} IN ({suffixes}) THEN {last(2)} ELSE {last(1)} END AS suffix,
    CASE WHEN address THEN name WHEN {last(2)} IN ({suffixes}) THEN {last(3)} ELSE {last(2)} END AS domain FROM cut)""",
        """domains AS (SELECT suffix, domain, sum(n) AS n, sum(y) AS y FROM hosts GROUP BY suffix, domain)""",
        """suffixes AS (SELECT suffix, sum(n) AS n, sum(y) AS y FROM domains GROUP BY suffix)""",
        """root AS (SELECT coalesce(sum(y), 0) + 1.0 AS a, coalesce(sum(n - y), 0) + 1.0 AS b FROM suffixes)""",
        shrunk("s", "suffixes", "suffix", "root", ""),
        shrunk("d", "domains", "suffix, domain", "s", "suffix"),
        shrunk("h", "hosts", "host", "d", "suffix, domain"),
    ]
    return "WITH " + ",\n".join(parts) + f"""
SELECT page_id, host, path, CASE{cases['rule']} END AS rule,
  CASE{cases['verdict']} WHEN {bound} < {hosts.THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict
FROM judged JOIN h USING (host)"""


def _manifest_sql(levels: int = 6) -> str:
    """The levels of the source trees and of the tree above them written out, up to 16 ** levels rows."""
    def leaf(text):
        parts = ["coalesce(%s, '-')" % f"strlen({v}) || ':' || {v}" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
        return f"sha256({' || '.join(parts)})"

    def tree(name, first):
        out = [f"{name}0 AS ({first})"]
        for k in range(levels):
            out.append(f"""{name}{k + 1} AS (
  SELECT tree, pos // 16 AS pos, (any_value(n) + 15) // 16 AS n, sha256(string_agg(d, '' ORDER BY pos)) AS d
  FROM {name}{k} WHERE n > 1 GROUP BY tree, pos // 16)""")
            # What stands before and after a node among its siblings.
            out.append(f"""{name}b{k} AS (
  SELECT tree, pos, d, coalesce(string_agg(d, '') OVER (PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(d, '') OVER (PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{k} WHERE n > 1)""")
        out.append(f"{name}_root AS (" + " UNION ALL ".join(f"SELECT tree, d FROM {name}{k} WHERE n = 1" for k in range(levels + 1)) + ")")
        return out

    def steps(name, of, pos, nodes):
        """A path folded upwards, one level a step."""
        out = []
        for k in range(levels):
            out.append(f"""{name}{k + 1} AS (
  SELECT x.* REPLACE (coalesce(sha256(b.l || x.shown || b.r), x.shown) AS shown, x.proof || coalesce(b.l || b.r, '') AS proof)
  FROM {name}{k} x LEFT JOIN {nodes}b{k} b ON b.tree = x.{of} AND b.pos = x.{pos} // {16 ** k})""")
        return out

    crc = ("xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), "
           "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)")
    lower = f"translate(text, '{hosts.UPPER}', '{hosts.LOWER}')"
    parts = [f"""leaves AS (
  SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS shown FROM documents)""",
             """placed AS (
  SELECT *, coalesce('s' || source, 'n') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n FROM leaves)"""]
    parts += tree("n", "SELECT tree, pos, n, leaf AS d FROM placed")
    parts.append("""tops AS (SELECT tree AS name, 'r' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, d FROM n_root)""")
    parts += tree("t", "SELECT tree, pos, n, d FROM tops")
    parts.append("""s0 AS (SELECT p.doc_id, p.leaf, p.shown, p.tree, p.pos, tops.pos AS top_at, 'r' AS top, tops.d AS subroot, '' AS proof FROM placed p JOIN tops ON tops.name = p.tree)""")
    parts += steps("s", "tree", "pos", "n")
    parts.append(f"u0 AS (SELECT * FROM s{levels})")
    parts += steps("u", "top", "top_at", "t")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, t_root.d AS root, sha256(proof) AS proof_sha256, shown AS folded_root, shown = t_root.d AS verified
FROM u{levels}, t_root"""


ORACLE_SQL = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id,
  vec_id <= coalesce(least.b, vec_id) AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op4_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (SELECT doc_id, i, line, {_KEY} AS key FROM lines),
hot AS (
  SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, hot.key IS NOT NULL AND hot.owner <> doc_id AS gone FROM keyed k LEFT JOIN hot ON hot.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op6_host_reputation": _reputation_sql(),
    "op7_license_scan": _license_sql(),
    "op11_merkle_manifest": _manifest_sql(),
    "op13_ranked_search": rf"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), '{hosts.UPPER}', '{hosts.LOWER}') AS t, row_number() OVER () AS r FROM documents),
asked AS (
  SELECT row_number() OVER () AS q, item_id, translate(coalesce(text, ''), '{hosts.UPPER}', '{hosts.LOWER}') AS t FROM benchmark),
words AS (SELECT r, unnest(regexp_extract_all(t, '{_TERM}')) AS term FROM lowered),
wanted AS (
  SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(regexp_extract_all(t, '{_TERM}')) AS term FROM asked)
  GROUP BY q, item_id, term),
lengths AS (SELECT r, count(*) AS n FROM words GROUP BY r),
corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS total FROM lengths),
tf AS (SELECT r, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY term, n_docs),
part AS (
  SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // total))) AS v
  FROM tf JOIN w USING (term) JOIN lengths USING (r), corpus),
scored AS (SELECT q, item_id, r, sum(times * v)::BIGINT AS score FROM wanted JOIN part USING (term) GROUP BY q, item_id, r),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM scored JOIN lowered USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20""",
}

"""Profiles and reductions of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerlens.functions.draws import is_validation
from layerlens.operators import profile, reduction
from layerlens.plans.inputs import (
    SQL_DATASETS,
    SQL_INCOMPLETE,
    SQL_STOPS,
    SQL_TEXTS,
    all_texts,
    dataset_texts,
    incomplete_texts,
    sql_words,
    table,
)
from layerlens.plans.registry import query

BY = ["dataset"]
WORDS = sql_words()


@query(
    "p1_missing_counts",
    f"""WITH {SQL_INCOMPLETE}
    SELECT dataset, count(*) FILTER (WHERE text IS NULL) AS missing_text,
           count(*) FILTER (WHERE label IS NULL) AS missing_label
    FROM incomplete GROUP BY dataset""",
)
def missing_counts(spark, sf):
    return profile.missing_counts(incomplete_texts(spark, sf), BY)


@query(
    "p2_complete_rows",
    f"""WITH {SQL_INCOMPLETE}
    SELECT id, dataset, text, label FROM incomplete
    WHERE text IS NOT NULL AND label IS NOT NULL""",
)
def complete_rows(spark, sf):
    return profile.complete_rows(incomplete_texts(spark, sf))


@query(
    "p3_label_as_text",
    f"WITH {SQL_INCOMPLETE} SELECT id, dataset, label::VARCHAR AS label FROM incomplete",
)
def label_as_text(spark, sf):
    return profile.label_as_text(incomplete_texts(spark, sf)).select("id", "dataset", "label")


@query(
    "p4_text_lengths",
    f"""WITH {SQL_DATASETS}
    SELECT id, dataset, len({WORDS})::INTEGER AS n_words, length(text)::INTEGER AS n_chars
    FROM texts""",
)
def text_lengths(spark, sf):
    return profile.with_lengths(dataset_texts(spark, sf)).drop("text", "label")


KEPT_SQL = f"""kept AS (
  SELECT id, dataset, pos, word FROM (
    SELECT id, dataset, unnest({WORDS}) AS word, generate_subscripts({WORDS}, 1) - 1 AS pos
    FROM texts)
  WHERE lower(word) NOT IN (SELECT unnest({SQL_STOPS})))"""


@query(
    "p5_stop_word_filter",
    f"""WITH {SQL_DATASETS}, {KEPT_SQL}
    SELECT dataset, id, pos::INTEGER AS pos, word FROM kept""",
)
def stop_word_filter(spark, sf):
    return profile.without_stop_words(dataset_texts(spark, sf), BY)


@query(
    "j5_vocabulary_exclusion",
    f"""WITH {SQL_DATASETS}, {KEPT_SQL}
    SELECT dataset, word, count(*) AS n FROM kept GROUP BY ALL""",
)
def vocabulary_exclusion(spark, sf):
    kept = profile.without_stop_words(dataset_texts(spark, sf), BY)
    return kept.groupBy("dataset", "word").agg(F.count("*").alias("n"))


LENGTHS_SQL = f"""lengths AS (
  SELECT id, dataset, label, text, len({WORDS}) AS n_words, length(text) AS n_chars FROM texts)"""


@query("a1_sample_count", f"WITH {SQL_INCOMPLETE} SELECT dataset, count(*) AS num_samples "
       "FROM incomplete WHERE text IS NOT NULL AND label IS NOT NULL GROUP BY dataset")
def sample_count(spark, sf):
    return profile.sample_count(profile.complete_rows(incomplete_texts(spark, sf)), BY)


@query(
    "a2_length_summary",
    f"""WITH {SQL_DATASETS}, {LENGTHS_SQL}
    SELECT dataset, avg(n_words) AS avg_length_words, max(n_words)::INTEGER AS max_length_words,
           min(n_words)::INTEGER AS min_length_words, avg(n_chars) AS avg_length_chars,
           max(n_chars)::INTEGER AS max_length_chars, min(n_chars)::INTEGER AS min_length_chars
    FROM lengths GROUP BY dataset""",
    "avg_length_words avg_length_chars",
)
def length_summary(spark, sf):
    return profile.length_summary(dataset_texts(spark, sf), BY)


@query(
    "a3_length_spread",
    f"""WITH {SQL_DATASETS}, {LENGTHS_SQL}
    SELECT dataset, stddev_samp(n_words) AS std_length_words,
           median(n_words) AS median_length_words, quantile_cont(n_words, 0.25) AS q25_words,
           quantile_cont(n_words, 0.5) AS q50_words, quantile_cont(n_words, 0.75) AS q75_words
    FROM lengths GROUP BY dataset""",
    "std_length_words median_length_words q25_words q50_words q75_words",
)
def length_spread(spark, sf):
    return profile.length_spread(dataset_texts(spark, sf), BY)


@query("a4_label_counts",
       f"WITH {SQL_DATASETS} SELECT dataset, label, count(*) AS n FROM texts GROUP BY ALL")
def label_counts(spark, sf):
    return profile.label_counts(dataset_texts(spark, sf), BY)


@query(
    "a5_label_shares",
    f"""WITH {SQL_DATASETS}
    SELECT dataset, label, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY dataset) AS percent
    FROM texts GROUP BY dataset, label""",
    "percent",
)
def label_shares(spark, sf):
    return profile.label_shares(dataset_texts(spark, sf), BY)


@query(
    "a6_distinct_counts",
    f"""WITH {SQL_DATASETS}
    SELECT dataset, count(DISTINCT label) AS num_unique_labels,
           count(DISTINCT text) AS num_unique_sentences
    FROM texts GROUP BY dataset""",
)
def distinct_counts(spark, sf):
    return profile.distinct_counts(dataset_texts(spark, sf), BY)


WORD_SQL = f"""all_words AS (
  SELECT id, dataset, unnest({WORDS}) AS word FROM texts)"""


@query(
    "a7_vocabulary_size",
    f"""WITH {SQL_DATASETS}, {WORD_SQL}
    SELECT dataset, count(DISTINCT word) AS vocab_size, count(*) AS total_words
    FROM all_words GROUP BY dataset""",
)
def vocabulary_size(spark, sf):
    return profile.vocabulary(dataset_texts(spark, sf), BY).drop("stop_words_percent")


@query(
    "a8_stop_word_share",
    f"""WITH {SQL_DATASETS}, {WORD_SQL}
    SELECT dataset, 100.0 * sum(CASE WHEN lower(word) IN (SELECT unnest({SQL_STOPS}))
                                THEN 1 ELSE 0 END) / count(*) AS stop_words_percent
    FROM all_words GROUP BY dataset""",
    "stop_words_percent",
)
def stop_word_share(spark, sf):
    return profile.vocabulary(dataset_texts(spark, sf), BY).select("dataset", "stop_words_percent")


def _histogram_sql(measure: str) -> str:
    return f"""WITH {SQL_DATASETS}, {LENGTHS_SQL},
    ranges AS (
      SELECT dataset, min({measure})::DOUBLE AS low, max({measure})::DOUBLE AS high
      FROM lengths GROUP BY dataset),
    edges AS (
      SELECT dataset, bin::INTEGER AS bin, low + bin * ((high - low) / 50) AS "left",
             low + (bin + 1) * ((high - low) / 50) AS "right"
      FROM ranges, range(50) r(bin))
    SELECT e.dataset, e.bin, e."left", e."right", count(l.id) AS n
    FROM edges e LEFT JOIN lengths l ON l.dataset = e.dataset AND l.{measure} >= e."left"
         AND (l.{measure} < e."right" OR e.bin = 49)
    GROUP BY ALL"""


def _density_sql(measure: str) -> str:
    return f"""WITH {SQL_DATASETS}, {LENGTHS_SQL},
    stats AS (
      SELECT dataset, count(*) AS rows, stddev_samp({measure}) * count(*) ^ (-0.2) AS h,
             min({measure})::DOUBLE AS low, max({measure})::DOUBLE AS high
      FROM lengths GROUP BY dataset),
    points AS (
      SELECT *, point::INTEGER AS p, low + point * ((high - low) / 199) AS x
      FROM stats, range(200) r(point)),
    curve AS (
      SELECT p.dataset, p.p AS point, p.x,
             sum(exp(-0.5 * pow((p.x - l.{measure}) / p.h, 2))) / (p.rows * p.h * sqrt(2 * pi())) AS density,
             any_value(p.rows * ((p.high - p.low) / 50)) AS area
      FROM points p JOIN lengths l USING (dataset)
      GROUP BY p.dataset, p.p, p.x, p.rows, p.h)
    SELECT dataset, point, x, density, density * area AS curve FROM curve"""


for _measure, _unit in (("n_words", "words"), ("n_chars", "chars")):

    @query(f"a9_length_histogram_{_unit}", _histogram_sql(_measure), '"left" "right"')
    def length_histogram(spark, sf, measure=_measure):
        return profile.length_histogram(dataset_texts(spark, sf), BY, measure)

    @query(f"a10_length_density_{_unit}", _density_sql(_measure), "x density curve")
    def length_density(spark, sf, measure=_measure):
        return profile.length_density(dataset_texts(spark, sf), BY, measure)


@query(
    "a11_box_statistics",
    f"""WITH {SQL_DATASETS}, {LENGTHS_SQL},
    boxes AS (
      SELECT dataset, label, quantile_cont(n_words, 0.25) AS q1, median(n_words) AS med,
             quantile_cont(n_words, 0.75) AS q3
      FROM lengths GROUP BY dataset, label),
    fenced AS (
      SELECT *, n_words BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS within
      FROM lengths JOIN boxes USING (dataset, label))
    SELECT dataset, label, q1, med AS median, q3,
           least(min(n_words) FILTER (WHERE within)::DOUBLE, q1) AS whisker_low,
           greatest(max(n_words) FILTER (WHERE within)::DOUBLE, q3) AS whisker_high,
           count(*) FILTER (WHERE NOT within) AS outliers
    FROM fenced GROUP BY dataset, label, q1, med, q3""",
    "q1 median q3 whisker_low whisker_high",
)
def box_statistics(spark, sf):
    return profile.box_statistics(dataset_texts(spark, sf), BY)


FIRST_SQL = f"""placed AS (
  SELECT id, dataset, unnest({WORDS}) AS word, generate_subscripts({WORDS}, 1) AS pos FROM texts),
kept AS (
  SELECT * FROM placed WHERE lower(word) NOT IN (SELECT unnest({SQL_STOPS}))),
word_counts AS (
  SELECT dataset, word, count(*) AS n, min((id, pos)) AS first_seen FROM kept GROUP BY dataset, word),
ranked AS (
  SELECT dataset, word, n,
         row_number() OVER (PARTITION BY dataset ORDER BY n DESC, first_seen)::INTEGER AS rank
  FROM word_counts)"""


@query("w9_top_words",
       f"WITH {SQL_DATASETS}, {FIRST_SQL} SELECT dataset, rank, word, n FROM ranked WHERE rank <= 20")
def top_words(spark, sf):
    return profile.top_words(dataset_texts(spark, sf), BY)


@query(
    "w10_top_bigrams",
    f"""WITH {SQL_DATASETS}, {FIRST_SQL},
    pairs AS (
      SELECT dataset, id, pos, word AS first,
             lead(word) OVER (PARTITION BY dataset ORDER BY id, pos) AS second
      FROM kept),
    counted AS (
      SELECT dataset, concat(first, ' ', second) AS bigram, count(*) AS n,
             min((id, pos)) AS first_seen
      FROM pairs WHERE second IS NOT NULL GROUP BY dataset, first, second)
    SELECT dataset, rank, bigram, n FROM (
      SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, first_seen)::INTEGER AS rank
      FROM counted)
    WHERE rank <= 20""",
)
def top_bigrams(spark, sf):
    return profile.top_bigrams(dataset_texts(spark, sf), BY)


@query(
    "a12_profile_report",
    f"""WITH {SQL_INCOMPLETE},
    texts AS (SELECT id, dataset, text, label::VARCHAR AS label FROM incomplete
              WHERE text IS NOT NULL AND label IS NOT NULL),
    {LENGTHS_SQL}, {FIRST_SQL},
    scalars AS (
      SELECT dataset, unnest([
        {{'key': 'num_samples', 'value': count(*)::DOUBLE}},
        {{'key': 'num_unique_labels', 'value': count(DISTINCT label)::DOUBLE}},
        {{'key': 'num_unique_sentences', 'value': count(DISTINCT text)::DOUBLE}},
        {{'key': 'avg_length_words', 'value': avg(n_words)}},
        {{'key': 'max_length_words', 'value': max(n_words)::DOUBLE}},
        {{'key': 'min_length_words', 'value': min(n_words)::DOUBLE}},
        {{'key': 'avg_length_chars', 'value': avg(n_chars)}},
        {{'key': 'max_length_chars', 'value': max(n_chars)::DOUBLE}},
        {{'key': 'min_length_chars', 'value': min(n_chars)::DOUBLE}},
        {{'key': 'std_length_words', 'value': stddev_samp(n_words)}},
        {{'key': 'q25_words', 'value': quantile_cont(n_words, 0.25)}},
        {{'key': 'median_length_words', 'value': median(n_words)}},
        {{'key': 'q75_words', 'value': quantile_cont(n_words, 0.75)}}]) AS kv
      FROM lengths GROUP BY dataset),
    gaps AS (
      SELECT dataset, unnest([
        {{'key': 'missing_text', 'value': count(*) FILTER (WHERE text IS NULL)::DOUBLE}},
        {{'key': 'missing_label', 'value': count(*) FILTER (WHERE label IS NULL)::DOUBLE}}]) AS kv
      FROM incomplete GROUP BY dataset),
    vocab AS (
      SELECT dataset, unnest([
        {{'key': 'vocab_size', 'value': count(DISTINCT word)::DOUBLE}},
        {{'key': 'stop_words_percent',
          'value': 100.0 * count(*) FILTER (WHERE lower(word) IN (SELECT unnest({SQL_STOPS}))) / count(*)}}
        ]) AS kv
      FROM placed GROUP BY dataset),
    label_counts AS (SELECT dataset, label, count(*) AS n FROM texts GROUP BY ALL),
    report AS (
      SELECT dataset, 'basic' AS section, kv.key AS key, kv.value AS value
      FROM (SELECT * FROM scalars UNION ALL SELECT * FROM gaps UNION ALL SELECT * FROM vocab)
      UNION ALL SELECT dataset, 'label_count', label, n::DOUBLE FROM label_counts
      UNION ALL SELECT dataset, 'label_percent', label,
                       n * 100.0 / sum(n) OVER (PARTITION BY dataset) FROM label_counts
      UNION ALL SELECT dataset, 'top_word', word, n::DOUBLE FROM ranked WHERE rank <= 20)
    SELECT dataset, section, key, value FROM report""",
    "value",
)
def profile_report(spark, sf):
    return profile.profile_report(incomplete_texts(spark, sf), BY)


# Reduction: a quarter of the rows at a mean length of 150 words. --------------------

TOTAL_SHARE, MAX_MEAN, SEED = 4, 150.0, 42


def _total(spark, sf):
    return table(spark, sf, "documents").count() // TOTAL_SHARE


QUOTA_SQL = f"""{SQL_TEXTS}, lengths AS (
  SELECT id, label, text, len({sql_words("coalesce(text, 'nan')")})::INTEGER AS n_words,
         md5(concat(id, '-{SEED}')) AS draw
  FROM texts),
sizes AS (
  SELECT label, count(*) AS n, avg(n_words) AS mean, min(id) AS first_id,
         (SELECT count(*) // {TOTAL_SHARE} FROM texts) AS total
  FROM lengths GROUP BY label),
shares AS (
  SELECT *, floor(total * (n / sum(n) OVER ()))::BIGINT AS base,
         row_number() OVER (ORDER BY first_id) AS turn
  FROM sizes),
quotas AS (
  SELECT label, n, mean, first_id,
         (base + (total - sum(base) OVER ()) // count(*) OVER ()
          + CASE WHEN turn <= (total - sum(base) OVER ()) % count(*) OVER () THEN 1 ELSE 0 END)::BIGINT
         AS quota
  FROM shares),
ranked AS (
  SELECT id, label, n_words, draw, quota, mean,
         avg(n_words) OVER (PARTITION BY label ORDER BY n_words, draw, id
                            ROWS UNBOUNDED PRECEDING) AS running_mean,
         row_number() OVER (PARTITION BY label ORDER BY n_words, draw, id) AS short_rank,
         row_number() OVER (PARTITION BY label ORDER BY draw, id) AS draw_rank
  FROM lengths JOIN quotas USING (label)),
prefix AS (
  SELECT * FROM ranked WHERE running_mean <= {MAX_MEAN} AND short_rank <= quota),
reduced AS (
  SELECT id, label, n_words, draw FROM ranked
  WHERE CASE WHEN mean > {MAX_MEAN} THEN running_mean <= {MAX_MEAN} AND short_rank <= quota
             ELSE draw_rank <= quota END)"""


@query("w1_running_mean_prefix", f"WITH {QUOTA_SQL} SELECT id, label, n_words FROM prefix")
def running_mean_prefix(spark, sf):
    kept = reduction.shortest_prefix(all_texts(spark, sf), _total(spark, sf), MAX_MEAN, SEED)
    return kept.select("id", "label", "n_words")


@query("w2_random_quota",
       f"WITH {QUOTA_SQL} SELECT id, label, n_words FROM ranked WHERE draw_rank <= quota")
def random_quota(spark, sf):
    kept = reduction.random_quota(all_texts(spark, sf), _total(spark, sf), SEED)
    return kept.select("id", "label", "n_words")


@query("w3_label_quotas", f"WITH {QUOTA_SQL} SELECT label, n, first_id, quota FROM quotas")
def label_quotas(spark, sf):
    lengths = reduction.measured(all_texts(spark, sf)).select("id", "label", "n_words")
    return reduction.label_quotas(lengths, _total(spark, sf)).drop("words")


@query("r1_sample_union", f"WITH {QUOTA_SQL} SELECT id, label, n_words FROM reduced")
def sample_union(spark, sf):
    kept = reduction.sample_union(all_texts(spark, sf), _total(spark, sf), MAX_MEAN, SEED)
    return kept.select("id", "label", "n_words")


@query(
    "r2_shuffle",
    f"""WITH {SQL_TEXTS}
    SELECT id, label, row_number() OVER (ORDER BY md5(concat(id, '-{SEED}')), id) AS position
    FROM texts""",
)
def shuffle(spark, sf):
    return reduction.shuffled(all_texts(spark, sf).select("id", "label"), SEED).drop("draw")


@query(
    "r3_bounded_reduction",
    f"""WITH {QUOTA_SQL}
    SELECT id, label, n_words, row_number() OVER (ORDER BY draw, id) AS position FROM reduced""",
)
def bounded_reduction(spark, sf):
    kept = reduction.bounded_reduction(all_texts(spark, sf), _total(spark, sf), MAX_MEAN, SEED)
    return kept.select("id", "label", "n_words", "position")


@query(
    "a25_reduction_summary",
    f"""WITH {QUOTA_SQL},
    after_counts AS (SELECT label, count(*) AS n, sum(n_words) AS words FROM reduced GROUP BY label),
    before_counts AS (SELECT label, count(*) AS n, sum(n_words) AS words FROM lengths GROUP BY label)
    SELECT 'before' AS stage, label, n AS rows, n / sum(n) OVER () AS share,
           sum(words) OVER () / sum(n) OVER () AS mean_words, 0::BIGINT AS shortfall
    FROM before_counts
    UNION ALL
    SELECT 'after', label, a.n, a.n / sum(a.n) OVER (), sum(words) OVER () / sum(a.n) OVER (),
           quota - a.n
    FROM after_counts a JOIN quotas USING (label)""",
    "share mean_words",
)
def reduction_summary(spark, sf):
    return reduction.reduction_summary(all_texts(spark, sf), _total(spark, sf), MAX_MEAN, SEED)


@query(
    "r5_validation_split",
    f"""WITH {SQL_TEXTS}
    SELECT id, label, substr(md5(concat(id, '-42')), 1, 8) < '33333333' AS validation FROM texts""",
)
def validation_split(spark, sf):
    rows = all_texts(spark, sf).select("id", "label")
    return rows.withColumn("validation", is_validation(F.col("id"), 42))

"""Quality rules combined by weak supervision.

Each rule looks at one measure of a text and votes good or bad, or abstains. How far a rule
can be trusted is not set by hand: expectation-maximisation over the vote patterns of all
documents estimates, without labels, how often each rule votes good on good and bad on bad
documents. A document's verdict is its posterior probability of being good. Two rules of thumb
(`base_failed`) reject on their own.

One pass over the texts makes the measures; the estimation sees only how often each vote
pattern occurs, at most 3 ** len(RULES) rows, whatever the number of documents. The measures are
stored for the verdicts, unless the texts would be stored with them: then they are made again.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from layerlens.llm.common import WHITE, fresh, map_arrow, with_field
from layerlens.session import written
from pyspark.sql.types import LongType, StructField, StructType

# The symbols of the contract, and the least number of words.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Frequent short words of the four languages, by which running text shows.
FUNCTION_WORDS = frozenset(
    (
        "the of and to in a is that for it as was with be by on not he his but at are this have "
        "from or had an they which one you were her all she there would their we him been has "
        "de la que el en y los del se las por un para con no una su al lo como "
        "le les et des est du dans une pour qui pas sur au par il avec ce "
        "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch er"
    ).encode().split()
)

MEASURES = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_distinct n_function "
    "n_upper n_lower n_exclaim"
).split()


def measures_of(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one whole text; zeros for a null or blank one."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0,) * len(MEASURES)
    word_chars = len(text) - sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    number: dict[bytes, int] = {}
    ids = np.fromiter(map(number.setdefault, words, itertools.count()), np.int64, n)
    function = sum(map(FUNCTION_WORDS.__contains__, words))
    letters = np.frombuffer(raw, np.uint8)
    upper = np.count_nonzero((letters - np.uint8(65)) < 26)
    lower = np.count_nonzero((letters - np.uint8(97)) < 26)
    return (
        n, word_chars, symbols, len(lines) - len(set(lines)), _repeated(ids), len(lines),
        len(number), function, upper, lower, text.count("!"),
    )


def _repeated(ids: np.ndarray, width: int = 3) -> int:
    """Words inside a window of three words that the text holds twice or more."""
    n = len(ids)
    if n < width + 1:
        return 0
    code = ids[: n - 1] * n + ids[1:]
    if n > 1_000_000:  # else the product below could pass 63 bits
        code = np.unique(code, return_inverse=True)[1]
    code = code[: n - 2] * n + ids[2:]
    order = np.argsort(code)
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(width):
        covered[shift : shift + n - 2] |= twice
    return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    """Votes bad above `bad` and good up to `good` of a ratio; reversed where good > bad."""

    name: str
    top: str
    bottom: str
    good: float
    bad: float

    def vote(self, at: str) -> Column:
        ratio = F.col(f"{at}.{self.top}") / F.greatest(F.col(f"{at}.{self.bottom}"), F.lit(1))
        if self.good < self.bad:
            good, bad = ratio <= self.good, ratio > self.bad
        else:
            good, bad = ratio >= self.good, ratio < self.bad
        return F.when(good, 1).when(bad, -1).otherwise(0)


RULES = (
    Rule("function_words", "n_function", "n_words", 0.08, 0.03),
    Rule("symbols", "n_symbols", "n_words", 0.02, 0.1),
    Rule("upper_case", "n_upper", "n_lower", 0.1, 0.3),
    Rule("exclamations", "n_exclaim", "n_words", 0.01, 0.05),
    Rule("repeats", "n_repeat_words", "n_words", 0.1, 0.25),
    Rule("distinct_words", "n_distinct", "n_words", 0.3, 0.15),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0.05, 0.3),
    Rule("word_length", "word_chars", "n_words", 9.0, 14.0),
)


@dataclass(frozen=True)
class Estimate:
    """What expectation-maximisation found: the share of good documents and, per rule, how
    often its votes are right on good and on bad documents."""

    share_good: float
    right_on_good: tuple[float, ...]
    right_on_bad: tuple[float, ...]


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 500) -> Estimate:
    """Votes (patterns x rules: 1 good, -1 bad, 0 abstains) and how often each pattern occurs.

    An abstention says nothing. The start trusts every rule somewhat more than a coin on good
    documents; weak prior counts keep the estimates off 0 and 1, also on an empty table.
    """
    n_rules = votes.shape[1]
    share, good_right, bad_right = 0.85, np.full(n_rules, 0.95), np.full(n_rules, 0.4)
    up, down = (votes == 1).astype(float), (votes == -1).astype(float)
    for _ in range(rounds):
        good, bad = _log_weights(share, good_right, bad_right, up, down)
        posterior = 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))
        on_good, on_bad = counts * posterior, counts * (1 - posterior)
        before = np.concatenate([[share], good_right, bad_right])
        share = (on_good.sum() + 8.5) / (counts.sum() + 10)
        good_right = (on_good @ up + 9.5) / (on_good @ (up + down) + 10)
        bad_right = (on_bad @ down + 4) / (on_bad @ (up + down) + 10)
        if np.abs(np.concatenate([[share], good_right, bad_right]) - before).max() < 1e-10:
            break
    return Estimate(float(share), tuple(map(float, good_right)), tuple(map(float, bad_right)))


def _log_weights(share, good_right, bad_right, up, down):
    good = np.log(share) + up @ np.log(good_right) + down @ np.log1p(-good_right)
    bad = np.log1p(-share) + up @ np.log1p(-bad_right) + down @ np.log(bad_right)
    return good, bad


def log_odds(found: Estimate, at: str) -> Column:
    """The posterior log-odds of a document from its votes."""
    total = F.lit(float(np.log(found.share_good) - np.log1p(-found.share_good)))
    for rule, good, bad in zip(RULES, found.right_on_good, found.right_on_bad):
        vote = rule.vote(at)
        total = total + F.when(vote == 1, float(np.log(good) - np.log1p(-bad))).when(
            vote == -1, float(np.log1p(-good) - np.log(bad))
        ).otherwise(0.0)
    return total


def measure(docs: DataFrame, name: str, text: str = "text", keep=None) -> DataFrame:
    """The columns named in `keep` (all if None) and a struct column of MEASURES."""
    kept = docs.columns if keep is None else list(keep)
    kinds = StructType([StructField(m, LongType()) for m in MEASURES])
    schema = with_field(StructType([docs.schema[c] for c in kept]), name, kinds)

    def run(batch):
        rows = np.array([measures_of(t) for t in batch.column(text).to_pylist()], np.int64)
        found = pa.StructArray.from_arrays([pa.array(c) for c in rows.T], names=MEASURES)
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in kept], found], names=[*kept, name]
        )

    return map_arrow(docs, run, schema)


def judge(docs: DataFrame, text: str = "text", keep=None) -> tuple[DataFrame, str]:
    """The kept columns and a struct column with MEASURES, base_failed, log_odds and kept.

    Returned with the struct's name, which clashes with no column. Null and blank texts have
    zero words and fail the base rules; repeated rows are judged alike, each counting once in
    the estimation; an empty table gives an empty table. The measured table is stored, so the
    texts are read once; where the text is kept nothing is stored and the texts are read twice.
    """
    (name,) = fresh(docs, "quality")
    if keep is None or text in keep:
        found, seen = measure(docs, name, text, keep), measure(docs.select(f"`{text}`"), name, text, [])
    else:
        found = seen = written(measure(docs, name, text, keep), "quality")
    at = f"`{name}`"
    base = (F.col(f"{at}.n_words") < MIN_WORDS) | (
        100 * F.col(f"{at}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{at}.n_words")
    )
    votes = [rule.vote(at).alias(rule.name) for rule in RULES]
    # Documents that fail the base rules are decided already and would only teach the model
    # what short texts look like.
    patterns = seen.where(~base).select(*votes).groupBy(*[r.name for r in RULES]).count().collect()
    table = np.array([tuple(p) for p in patterns], float).reshape(-1, len(RULES) + 1)
    model = estimate(table[:, :-1], table[:, -1])
    odds = log_odds(model, at)
    verdict = F.struct(
        *[F.col(f"{at}.{m}").alias(m) for m in MEASURES],
        base.alias("base_failed"),
        odds.alias("log_odds"),
        (~base & (odds >= 0)).alias("kept"),
    )
    return found.withColumn(name, verdict), name


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    judged, name = judge(docs)
    return judged.where(F.col(f"`{name}`.kept")).drop(name)

"""Language of texts and of the spans inside mixed ones.

A word's script first narrows the languages that can hold it; letter n-grams, learned from
labelled texts, then score each of them; and the best labelling of all words in a row is found
by the Viterbi recursion, in which going from one language to another costs a penalty. So a
foreign name does not split a sentence, while a passage in another language becomes a span.

Learning counts over all labelled rows; what leaves the tasks is one number per n-gram slot and
language, SLOTS at most of each. The recursion runs over many texts side by side.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

from layerlens.llm.common import fresh, mixed, with_field, word_hashes

#: Slots of hashed n-grams, a parameter of the model's size: SLOTS numbers per language.
SLOTS = 1 << 16
ORDERS = (1, 2, 3, 4)
#: Added to every rate, so that what was never seen speaks for no language.
FLOOR = 1e-6
#: No word speaks against a language by more than this, and what a change of language costs.
MOST, SWITCH = 6.0, 12.0
#: A language has a script if this share of its letters is in it.
SCRIPT_SHARE = 0.01
UNDETERMINED = "und"

#: Words remembered by a worker, and numbers in the table of one step; both are memory bounds.
MEMO_WORDS = 200_000
STEP_NUMBERS = 8_000_000

# The first code points of letter ranges, by script.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x18B0, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "latin"), (0x2C60, "latin"), (0x2C80, "other"), (0x2D00, "georgian"),
    (0x2D30, "other"), (0x2DE0, "cyrillic"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"),
    (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAB30, "latin"),
    (0xAB70, "other"), (0xAC00, "hangul"), (0xD7B0, "hangul"), (0xD800, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF65, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"),
    (0x1B000, "kana"), (0x1B170, "other"), (0x20000, "han"), (0x323B0, "other"),
)
_STARTS = [start for start, _ in SCRIPTS]
NAMES = sorted({name for _, name in SCRIPTS})
_PLACE = {name: i for i, name in enumerate(NAMES)}
_OF_RANGE = [_PLACE[name] for _, name in SCRIPTS]

# A word is a run of letters with their marks. Scripts that write no spaces are cut into pieces.
_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
WORD = regex.compile(rf"(?V1)(?:[\p{{L}}&&[{_UNSPACED}]]\p{{M}}*){{1,4}}|(?:[\p{{L}}--[{_UNSPACED}]]\p{{M}}*)+")

#: Signs that belong to no word and are not Latin-1, and the bytes of Latin-1 that are letters.
_FOREIGN_SIGNS = regex.compile(r"[^\p{L}\p{M}\x00-\xff]+")
_LATIN = bytes(b if chr(b).isalpha() else 32 for b in range(256))


def words_of(text: str) -> list:
    """The words of a text in order: Latin-1 ones as bytes, which takes a tenth of the time, or
    all as text if there are other letters."""
    try:
        return text.encode("latin-1").translate(_LATIN).split()
    except UnicodeEncodeError:
        pass
    try:
        return _FOREIGN_SIGNS.sub(" ", text).encode("latin-1").translate(_LATIN).split()
    except UnicodeEncodeError:
        return WORD.findall(text)


def _spelled(words: list) -> list[str]:
    return [w.decode("latin-1") if isinstance(w, bytes) else w for w in words]


def script_of(word: str) -> int:
    """The number of the script of a word's first letter."""
    return _OF_RANGE[bisect_right(_STARTS, ord(word[0])) - 1]


def slots_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, slot) for every n-gram of every word, edges marked, and for every whole word."""
    text = " " + " ".join(words) + " "
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    gap = c == 32
    owner = np.cumsum(gap) - 1
    whole = word_hashes([w.encode("utf-8", "surrogatepass") for w in words])
    at, keys = [np.arange(len(words))], [mixed(whole + np.uint64(len(ORDERS) + 2))]
    shift = np.uint64(64 - (SLOTS.bit_length() - 1))
    for order in ORDERS:
        m = len(c) - order + 1
        if m <= 0:
            continue
        key, good = np.full(m, order, np.uint64), np.ones(m, bool)
        for j in range(order):
            key = mixed(key + c[j : j + m])
            if 0 < j < order - 1 or order == 1:
                good &= ~gap[j : j + m]
        # A run that ends in the space before the first word or starts in the last one has no word.
        good &= owner[:m] < len(words)
        at.append(owner[:m][good])
        keys.append(key[good])
    return np.concatenate(at), (np.concatenate(keys) >> shift).astype(np.int64)


@dataclass
class Model:
    """scores: per slot and language, the logarithm of the language's share among all rates;
    scripts: per script, the languages that have it (all where none has)."""

    languages: list[str]
    scores: np.ndarray
    scripts: np.ndarray


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts over all rows with a language. Null texts and texts without letters teach nothing."""

    def run(batches):
        slots: dict[str, np.ndarray] = {}
        letters: dict[str, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                words: dict[str, Counter] = {}
                for t, l in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    if t:
                        words.setdefault(l, Counter()).update(words_of(t))
                for l, counts in words.items():
                    if not counts:
                        continue
                    if l not in slots:
                        slots[l], letters[l] = np.zeros(SLOTS), np.zeros(len(NAMES))
                    own, n = _spelled(list(counts)), np.fromiter(counts.values(), np.float64, len(counts))
                    at, keys = slots_of([w.lower() for w in own])
                    slots[l] += np.bincount(keys, n[at], SLOTS)
                    size = n * np.fromiter(map(len, own), np.float64, len(own))
                    letters[l] += np.bincount([script_of(w) for w in own], size, len(NAMES))
        for l, counts in slots.items():
            at = np.flatnonzero(counts)
            seen = np.flatnonzero(letters[l])
            yield pa.RecordBatch.from_arrays(
                [pa.array([l] * (len(at) + len(seen)), pa.string()), pa.array(np.concatenate([at, -1 - seen])),
                 pa.array(np.concatenate([counts[at], letters[l][seen]]).astype(np.int64))],
                names=["lang", "slot", "n"],
            )

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    found = rows.mapInArrow(run, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    langs = found.column("lang").to_pylist()
    languages = sorted(set(langs))
    column = {l: i for i, l in enumerate(languages)}
    counts = np.zeros((SLOTS, len(languages)))
    letters = np.zeros((len(NAMES), len(languages)))
    for l, slot, n in zip(langs, found.column("slot").to_pylist(), found.column("n").to_pylist()):
        if slot >= 0:
            counts[slot, column[l]] = n
        else:
            letters[-1 - slot, column[l]] = n
    rates = counts / np.maximum(counts.sum(axis=0), 1) + FLOOR
    scores = np.log(rates / rates.sum(axis=1, keepdims=True)).astype(np.float32)
    share = letters / np.maximum(letters.sum(axis=0), 1) >= SCRIPT_SHARE
    share[~share.any(axis=1)] = True
    return Model(languages, scores, share)


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """What each word says for each language: 0 for the best one, -MOST at worst or outside
    the languages of its script."""
    at, slots = slots_of([w.lower() for w in words])
    order = np.argsort(at, kind="stable")
    first = np.searchsorted(at[order], np.arange(len(words)))
    total = np.add.reduceat(model.scores[slots[order]], first, axis=0) / (len(ORDERS) + 1)
    total[~model.scripts[[script_of(w) for w in words]]] = -np.inf
    total -= total.max(axis=1, keepdims=True)
    return np.maximum(total, -MOST).astype(np.float32)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best labels of each text's words. Texts lie one after the other in `scores`; all go
    forward and back together, the longest first, so that those at work are always a prefix."""
    out = np.zeros(len(scores), np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    most = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(most), side="left")
    came = np.zeros(scores.shape, np.uint8 if scores.shape[1] < 256 else np.uint16)
    own = np.arange(scores.shape[1])
    best = np.zeros((len(sizes), scores.shape[1]))
    for t in range(most):
        k = active[t]
        rows = starts[:k] + t
        if t:
            last = best[:k]
            from_ = last.argmax(axis=1)
            change = last[np.arange(k), from_] - switch
            moved = change[:, None] > last
            came[rows] = np.where(moved, from_[:, None], own)
            best[:k] = np.where(moved, change[:, None], last) + scores[rows]
        else:
            best[:k] = scores[rows]
    now = best.argmax(axis=1)
    for t in range(most - 1, -1, -1):
        k = active[t]
        rows = starts[:k] + t
        out[rows] = now[:k]
        now[:k] = came[rows, now[:k]]
    return out


class _Scorer:
    """Scores of words, those met before remembered."""

    def __init__(self, model: Model):
        self.model, self.place, self.table = model, {}, np.empty((0, len(model.languages)), np.float32)

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.place) > MEMO_WORDS:
            self.place, self.table = {}, self.table[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.table = np.concatenate([self.table, word_scores(_spelled(new), self.model)])
        return self.table[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]


def _decided(words: list[list[str]], scorer: _Scorer, switch: float):
    """Per text: (language number or -1, its share of the letters, labels of the words)."""
    lengths = np.array([len(w) for w in words], np.int64)
    flat = [w for own in words for w in own]
    labels = viterbi(scorer(flat), lengths, switch) if flat else np.empty(0, np.int64)
    letters = np.fromiter(map(len, flat), np.float64, len(flat))
    n = len(scorer.model.languages)
    text = np.repeat(np.arange(len(words)), lengths)
    totals = np.bincount(text * n + labels, letters, len(words) * n).reshape(-1, n)
    best = totals.argmax(axis=1)
    whole = totals.sum(axis=1)
    share = totals[np.arange(len(words)), best] / np.maximum(whole, 1)
    return np.where(whole > 0, best, -1), share, np.split(labels, np.cumsum(lengths)[:-1])


def _spans(text: str, labels: np.ndarray, languages: list[str]) -> list[dict]:
    """The runs of words of one language, as places of code points, end excluded."""
    out: list[dict] = []
    for m, label in zip(WORD.finditer(text), labels.tolist()):
        if out and out[-1]["lang"] == languages[label]:
            out[-1]["end"] = m.end()
        else:
            out.append({"start": m.start(), "end": m.end(), "lang": languages[label]})
    return out


def identify(docs: DataFrame, model: Model, text: str = "text", switch: float = SWITCH,
             spans: bool = True) -> tuple[DataFrame, str]:
    """All columns and a struct (lang, score, n_spans, spans) under the returned name.

    `lang` is the language with most letters, the first in order of equals; `score` its share of
    the letters. `spans` are the parts of the text in one language, null unless asked for.
    Null texts and those without letters are `und` with score 0 and no span, and so is every
    text if the model knows no language. Texts are read whole.
    """
    (name,) = fresh(docs, "language")
    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("lang", StringType())])
    kind = StructType([
        StructField("lang", StringType()), StructField("score", DoubleType()), StructField("n_spans", LongType()),
        StructField("spans", ArrayType(span)),
    ])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches):
        model = shared.value
        scorer = _Scorer(model)
        known = bool(model.languages)
        most = STEP_NUMBERS // max(len(model.languages), 1)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            found = {"lang": [], "score": [], "n_spans": [], "spans": []}
            words, size, first = [], 0, 0
            for i, t in enumerate(texts):
                words.append(words_of(t) if t and known else [])
                size += len(words[-1])
                if size < most and i + 1 < len(texts):
                    continue
                if known:
                    best, share, labels = _decided(words, scorer, switch)
                else:
                    best, share, labels = [-1] * len(words), [0.0] * len(words), [np.empty(0)] * len(words)
                found["lang"] += [UNDETERMINED if b < 0 else model.languages[b] for b in best]
                found["score"] += [float(s) for s in share]
                found["n_spans"] += [int((np.diff(l) != 0).sum()) + 1 if len(l) else 0 for l in labels]
                found["spans"] += [
                    (_spans(t or "", l, model.languages) if spans else None) for t, l in zip(texts[first : i + 1], labels)
                ]
                words, size, first = [], 0, i + 1
            types = (pa.string(), pa.float64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))
            struct = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(found.values(), types)], names=list(found))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], struct], names=[*columns, name])

    return docs.mapInArrow(run, with_field(docs.schema, name, kind)), name

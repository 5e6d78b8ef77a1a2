"""Byte-level byte-pair encoding by backtracking.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over all tokens finds
every token in a piece in one pass. Encoding takes the longest token at each place that is
compatible with the one before, and steps back where none is. Two adjacent tokens are compatible
if merging their joined bytes gives just these two, which shows by undoing their own merges from
the last one back; the answers are remembered. A sequence
whose neighbours are all compatible is the one that merging by rank gives, so every prefix has
one encoding, a place that failed once never has to be tried again, and the time is linear.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from layerlens.llm.common import fresh, with_field

#: Pieces up to this length are remembered, and at most so many of them per worker.
CACHED_LENGTH = 32
CACHED_PIECES = 400_000
#: Answers on pairs of tokens that are remembered, per worker.
CACHED_PAIRS = 400_000


class Pieces(dict):
    """The ids of pieces as bytes, made when first asked for."""

    def __init__(self, words: Vocabulary):
        self.words = words

    def __missing__(self, piece: str) -> bytes:
        ids = self.words.encode_piece(piece.encode())
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Vocabulary:
    """Tokens by rank; a token's rank is its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.none = max(ranks.values(), default=0) + 1  # beyond every rank
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reached: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pieces = Pieces(self)

    def merged(self, raw: bytes, parts: int = 1) -> list[int]:
        """The encoding by definition: merge the pair of lowest rank, leftmost first.

        With `parts`, as it is when so many parts are left.
        """
        ranks, none = self.ranks, self.none
        split = [raw[i : i + 1] for i in range(len(raw))]
        joined = [ranks.get(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while len(split) > parts:
            rank = min(joined)
            if rank == none:
                break
            at = joined.index(rank)
            split[at : at + 2] = [split[at] + split[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = ranks.get(split[at - 1] + split[at], none)
            if at < len(joined):
                joined[at] = ranks.get(split[at] + split[at + 1], none)
        return [ranks[p] for p in split]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one last: itself twice for a byte. None where its
        bytes do not merge to it, or where it or a part of it ranks before one of its halves."""
        if token not in self.halves:
            raw = self.tokens[token]
            found = (token, token)
            if len(raw) > 1:
                found = tuple(self.merged(raw, 2))
                whole = len(found) == 2 and self.tokens[found[0]] + self.tokens[found[1]] == raw
                if not whole or max(found) >= token or None in map(self._halves, found):
                    found = None
            self.halves[token] = found
        return self.halves[token]

    def _stays_apart(self, left: int, right: int) -> bool:
        """Whether two tokens beside each other are never merged across their border.

        Merges are undone from the last one back; before each, the parts that then touched
        must not have had a merge of a lower rank.
        """
        ranks, tokens, halves = self.ranks, self.tokens, self.halves
        limit = none = self.none
        while True:
            if ranks.get(tokens[left] + tokens[right], none) < limit:
                return False
            # Of equal ranks the left one is merged first.
            for side in (0, 1) if left > right else (1, 0):
                if side == 0:
                    half = halves[left][1]
                    if half != left:
                        left, limit = half, left
                        break
                else:
                    half = halves[right][0]
                    if half != right:
                        right, limit = half, right + 1
                        break
            else:
                return True

    def _compatible(self, before: int | None, token: int) -> bool:
        if before is None:
            found = self.reached.get(token)
            if found is None:
                found = self.reached[token] = self.merged(self.tokens[token]) == [token]
            return found
        found = self.pairs.get((before, token))
        if found is None:
            if self._halves(before) and self._halves(token):
                found = self._stays_apart(before, token)
            else:
                joined = self.tokens[before] + self.tokens[token]
                found = self.merged(joined) == [before, token]
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            self.pairs[before, token] = found
        return found

    def encode_piece(self, raw: bytes) -> list[int]:
        """The ids of one match of the pattern; a piece that is a token is that token."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        size = len(raw)
        lengths, pairs = self.lengths, self.pairs
        starts: list[list[int]] = [[] for _ in range(size + 1)]  # shorter tokens first
        for end, rank in self.automaton.iter(raw.decode("latin-1")):
            starts[end + 1 - lengths[rank]].append(rank)
        dead = bytearray(size + 1)
        ids: list[int] = []
        choices: list[int] = []
        at, choice = 0, len(starts[0])
        while at < size:
            here = starts[at]
            before = ids[-1] if ids else None
            while choice:
                choice -= 1
                token = here[choice]
                after = at + lengths[token]
                if dead[after]:
                    continue
                fits = pairs.get((before, token))
                if self._compatible(before, token) if fits is None else fits:
                    ids.append(token)
                    choices.append(choice)
                    at = after
                    choice = len(starts[at])
                    break
            else:
                if not ids:
                    raise ValueError(f"the vocabulary cannot encode byte {raw[at]}")
                dead[at] = 1
                at -= lengths[ids.pop()]
                choice = choices.pop()
        return ids

    def matches(self, text: str) -> list[str]:
        """The matches of the pattern, whole."""
        if self.pattern.groups:
            return [match.group() for match in self.pattern.finditer(text)]
        return self.pattern.findall(text)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.matches(text))), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return joined(self.tokens, ids)


def joined(tokens: dict[int, bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(tokens.__getitem__, ids.tolist()))


def ranks_of(raw: bytes) -> dict[bytes, int]:
    """The tokens and ranks in a rank file's bytes."""
    pairs = (line.split() for line in raw.splitlines() if line.strip())
    return {base64.b64decode(t): int(r) for t, r in pairs}


def vocabulary(raw: bytes, pattern: str) -> Vocabulary:
    """The vocabulary of a rank file's bytes."""
    return Vocabulary(ranks_of(raw), pattern)


def _sent(df: DataFrame, path: str, **more):
    """The rank file at `path`, read by the driver and sent to the executors."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast({"raw": file.read(), **more})


def _vocabulary_of(sent) -> Vocabulary:
    """Built once per worker process, which keeps the broadcast value between its tasks."""
    held = sent.value
    if "vocabulary" not in held:
        held["vocabulary"] = vocabulary(held["raw"], held["pattern"])
    return held["vocabulary"]


def _tokens_of(sent) -> dict[int, bytes]:
    """The tokens by id, built once per worker process; decoding needs no automaton."""
    held = sent.value
    if "tokens" not in held:
        held["tokens"] = {rank: token for token, rank in ranks_of(held["raw"]).items()}
    return held["tokens"]


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in short slices, so that what a slice adds stays small beside its texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> tuple[DataFrame, str]:
    """All columns and a struct (n_tokens, ids): the ids as little-endian 32-bit integers.

    Returned with the struct's name, which clashes with no column. The rank file at `path` is
    read by the driver and sent to the executors; it is as large as the vocabulary, whatever
    the data. Null and empty texts have no tokens; repeated rows are encoded alike.
    """
    (name,) = fresh(docs, "encoded")
    columns = docs.columns
    sent = _sent(docs, path, pattern=pattern)
    kind = StructType([StructField("n_tokens", LongType()), StructField("ids", BinaryType())])

    def run(batches):
        words = _vocabulary_of(sent)
        for part in parts_of(batches):
            ids = [words.encode(t or "") for t in part.column(text).to_pylist()]
            found = pa.StructArray.from_arrays(
                [pa.array([len(i) for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary())],
                names=["n_tokens", "ids"],
            )
            yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*columns, name])

    return docs.mapInArrow(run, with_field(docs.schema, name, kind)), name


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids") -> tuple[DataFrame, str]:
    """All columns and the bytes that the ids stand for, under the returned name."""
    (name,) = fresh(rows, "decoded")
    columns = rows.columns
    sent = _sent(rows, path)

    def run(batches):
        tokens = _tokens_of(sent)
        for part in parts_of(batches):
            raw = [joined(tokens, np.frombuffer(i or b"", "<u4")) for i in part.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=[*columns, name])

    return rows.mapInArrow(run, with_field(rows.schema, name, BinaryType())), name

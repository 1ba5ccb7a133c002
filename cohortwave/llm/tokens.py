"""Byte-level BPE ids at speed: a batch's distinct pieces between spaces are encoded once and gathered by number.

``byte_bpe_50k.json`` (tokenizers) and ``byte_bpe_50k.tiktoken`` (tiktoken) hold one vocabulary; the second library
encodes the same pieces faster. A piece that starts at a single space behind a character that isn't white space is a
unit of the splitting pattern, so a text's ids are the ids of its pieces in a row. Texts with other runs of white space
go through the encoder by themselves. The special token's string becomes id 50256 wherever it stands, as the library
for the .json file does by default. tests/llm holds both libraries against each other.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cohortwave.llm.base import chunks

SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
#: Pieces and ids remembered by a worker; beyond either the memory starts anew, so it stays under about 50 MB.
REMEMBERED = 200_000
REMEMBERED_IDS = 2_000_000
#: Bytes of text whose pieces are gathered at once.
CHUNK_BYTES = 1 << 21
JSON, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file: the second half of a cache key."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def byte_bpe(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})


class Encoder:
    """Ids of one text (encode) or of a column of texts (rows). Remembers pieces; one object serves a worker process."""

    def __init__(self, path: str | None = None) -> None:
        self.bpe = byte_bpe(path or tokenizer_path())
        at_space = [raw.startswith(b" ") for raw in map(self.bpe.decode_single_token_bytes, range(SPECIAL_ID))]
        self.at_space = np.append(at_space, False)
        self.forget()

    # single texts

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.bpe.encode_ordinary(text), np.uint32)

    def encode(self, text: str) -> np.ndarray:
        none = np.zeros(0, np.uint32)
        between = [self._whole(part) if part else none for part in text.split(SPECIAL)]
        special = np.asarray([SPECIAL_ID], np.uint32)
        return np.concatenate([x for part in between for x in (special, part)][1:])

    # columns

    def forget(self) -> None:
        self.slots: dict[str, int] = {"": 0}
        self.heads: dict[str, int] = {"": 1}
        self.n, self.used = 2, 1
        self.where, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.open = np.zeros(1 << 16, bool)  # ends in white space: not a unit where another piece follows
        self.flat = np.zeros(1 << 18, np.uint32)
        self.flat[0] = self._whole(" ")[0]
        self.length[0], self.open[0] = 1, True  # slot 0: a space that nothing follows; slot 1: nothing

    def _store(self, ids: np.ndarray, lengths: np.ndarray, open_: np.ndarray) -> int:
        """Append encodings; the number of the first."""
        first, n, used = self.n, self.n + len(lengths), self.used + len(ids)
        while n > len(self.length):
            self.where, self.length, self.open = (np.concatenate([x, np.zeros_like(x)]) for x in (self.where, self.length, self.open))
        while used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : used] = ids
        self.length[first:n], self.open[first:n] = lengths, open_
        self.where[first:n] = self.used + np.cumsum(lengths) - lengths
        self.n, self.used = n, used
        return first

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces, each behind a space, in one call: none holds a space, so ids that start with one part them."""
        alone = [p for p in pieces if p[0].isspace() or p[-1].isspace() or SPECIAL in p]
        apart = set(alone)
        plain = [p for p in pieces if p not in apart]
        if plain:
            ids = self.bpe.encode_to_numpy(" " + " ".join(plain), disallowed_special=())
            first = np.flatnonzero(self.at_space[ids])
            at = self._store(ids, np.diff(np.append(first, len(ids))), np.zeros(len(plain), bool))
            self.slots.update(zip(plain, range(at, at + len(plain)), strict=True))
        for p in alone:
            self.slots[p] = self._one(" " + p)

    def _one(self, text: str) -> int:
        ids = self.encode(text)
        return self._store(ids, np.asarray([len(ids)]), np.asarray([text[-1:].isspace()]))

    def _numbered(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(first piece of each row, encoding of each piece)."""
        parted = pc.split_pattern(column, " ")
        at, pieces = parted.offsets.to_numpy() - parted.offsets[0].as_py(), parted.flatten().dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        if self.n + len(distinct) > REMEMBERED or self.used > REMEMBERED_IDS:
            self.forget()
        heads = parted.flatten().take(pa.array(at[:-1])).to_pylist()
        new = [p for p in distinct if p not in self.slots]
        self._learn(new)
        number = np.fromiter(map(self.slots.__getitem__, distinct), np.int64, len(distinct))[pieces.indices.to_numpy()]
        for h in heads:
            if h not in self.heads:
                self.heads[h] = self._one(h)
        number[at[:-1]] = list(map(self.heads.__getitem__, heads))
        followed = np.ones(len(number), bool)
        followed[at[1:] - 1] = False
        row_of = np.repeat(np.arange(len(column)), np.diff(at))
        for r in np.unique(row_of[self.open[number] & followed]).tolist():  # the pattern may take more than one space at once
            number[at[r] : at[r + 1]] = 1
            number[at[r]] = self._one(column[r].as_py())
        return at, number

    def counts(self, column: pa.Array) -> np.ndarray:
        """Ids of each text; nulls aren't allowed."""
        parts = [np.zeros(0, np.int64)]
        for lo, hi, _, _ in chunks(column, CHUNK_BYTES):
            at, number = self._numbered(column.slice(lo, hi - lo))
            parts.append(np.diff(np.concatenate(([0], np.cumsum(self.length[number], dtype=np.int64)))[at]))
        return np.concatenate(parts)

    def rows(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, offset of each row) for runs of rows; nulls aren't allowed."""
        for lo, hi, _, _ in chunks(column, CHUNK_BYTES):
            at, number = self._numbered(column.slice(lo, hi - lo))
            lengths = self.length[number]
            ends = np.cumsum(lengths, dtype=np.int64)
            total = int(ends[-1])
            ids = self.flat[np.repeat(self.where[number] - (ends - lengths), lengths) + np.arange(total)]
            yield lo, hi, ids, np.concatenate(([0], ends))[at]


@functools.cache
def encoder(path: str) -> Encoder:
    """The process's encoder for a vocabulary: tasks of one worker share what it remembers."""
    return Encoder(path)

"""Encoding of whole texts with a public byte-level BPE vocabulary.

A text is cut into the vocabulary's pre-tokens, and each distinct pre-token is
encoded once per task by a backtracking encoder: an Aho-Corasick automaton gives
the longest token at every position, a token is taken if the pair it forms with
its predecessor is one that exact merging can leave side by side, else a shorter
one is tried, else the predecessor is given up. Every position is given up at
most once, so the time is linear in the text. Decoding gathers bytes through an
offset table. Vocabulary files are read from a folder given as a parameter.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalarscape.session import spread

#: Default folder of the vocabularies, Unicode white space, and the vocabulary's pre-token pattern.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)

CACHE_ENTRIES = 400_000  # pre-tokens remembered per Python worker; beyond it the memory starts anew
CACHED_LENGTH = 64  # longer pre-tokens are encoded each time they occur


def _byte_alphabet() -> dict[str, int]:
    """The vocabulary files' printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class BytePairEncoder:
    """The vocabulary's tables and the backtracking encoder."""

    def __init__(self, folder: str = TOKENIZER_DIR, name: str = VOCABULARY):
        with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
            model = json.load(f)["model"]
        stand_in = _byte_alphabet()
        as_bytes = lambda shown: bytes(stand_in[c] for c in shown)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        special = {s for s in vocab if any(c not in stand_in for c in s) or s.startswith("<|")}
        self.token_bytes: dict[int, bytes] = {i: as_bytes(s) for s, i in vocab.items() if s not in special}
        by_bytes = {b: i for i, b in self.token_bytes.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}  # of the merge that makes a token; single bytes have none
        self.halves: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merged.setdefault((left, right), r)
            if whole not in self.rank:
                self.rank[whole], self.halves[whole] = r, (left, right)
        self.automaton = ahocorasick.Automaton()
        for i, b in self.token_bytes.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}  # longest token that is a proper prefix
        for i, b in self.token_bytes.items():
            for n in range(len(b) - 1, 0, -1):
                if (p := by_bytes.get(b[:n])) is not None:
                    self.shorter[i] = p
                    break
        self.length = {i: len(b) for i, b in self.token_bytes.items()}
        self.whole = {b: i for b, i in by_bytes.items()}
        self.fits: dict[tuple[int, int], bool] = {}  # compatibility of pairs met so far
        size = max(self.token_bytes) + 1
        lengths = np.zeros(size, dtype=np.int64)
        for i, b in self.token_bytes.items():
            lengths[i] = len(b)
        self.lengths = lengths
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.pool = np.frombuffer(b"".join(self.token_bytes.get(i, b"") for i in range(size)), dtype=np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """Whether exact merging leaves ``left`` and ``right`` side by side.

        Merging runs by rank. Undo it on both sides of the seam, latest merge first;
        if the two tokens that then touch at the seam could have merged before the
        merge that was undone last, they would have, and the pair is impossible.
        """
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, before = left, right, len(self.merged) + 1
        rank, halves, merged = self.rank, self.halves, self.merged
        good = True
        while True:
            r = merged.get((a, b))
            if r is not None and r < before:
                good = False
                break
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            if ra > rb:  # the left one was made later; its right half touches the seam before that
                before, a = ra, halves[a][1]
            else:  # merges of one rank run from the left: the seam lies before the right one's inner pair
                before, b = rb + 1, halves[b][0]
        if len(self.fits) > 4_000_000:
            self.fits.clear()
        self.fits[(left, right)] = good
        return good

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        one = self.whole.get(data)
        if one is not None:
            return [one]
        n = len(data)
        longest = [0] * n
        for end, (size, token) in self.automaton.iter(data.decode("latin-1")):
            longest[end - size + 1] = token  # matches come by rising end, so the longest comes last
        out: list[int] = []
        dead = bytearray(n + 1)  # positions from which the rest cannot be encoded after what precedes them
        pos, token = 0, longest[0]
        while pos < n:
            last = out[-1] if out else None
            while True:
                end = pos + self.length[token]
                if not dead[end] and (last is None or self.compatible(last, token)):
                    out.append(token)
                    pos = end
                    if pos < n:
                        token = longest[pos]
                    break
                nearer = self.shorter.get(token)
                if nearer is not None:
                    token = nearer
                    continue
                dead[pos] = 1
                token = out.pop()
                pos -= self.length[token]
                break
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids by gathering from the offset table."""
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return b""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        index = np.repeat(self.offsets[ids] - (ends - sizes), sizes) + np.arange(ends[-1])
        return self.pool[index].tobytes()


class PieceCache(dict):
    """Ids by pre-token; a miss is encoded."""

    def __init__(self, encoder: BytePairEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> list[int]:
        ids = self.encoder.encode_piece(piece.encode("utf-8"))
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> tuple[PieceCache, callable]:
    """The worker's cache and pre-token splitter; made once per Python worker."""
    return PieceCache(BytePairEncoder(folder, name)), regex.compile(PATTERN).findall


def encode_text(text: str | None, folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> list[int]:
    """Ids of one text; none for an empty or null text."""
    cache, pieces = encoder(folder, name)
    return list(chain.from_iterable(map(cache.__getitem__, pieces(text)))) if text else []


def _arrow_ids(ids: array, ends: list[int]) -> pa.Array:
    flat = pa.array(np.frombuffer(ids, dtype=np.int32) if len(ids) else np.zeros(0, np.int32), pa.int32())
    return pa.ListArray.from_arrays(pa.array(np.array([0, *ends], dtype=np.int32)), flat)


def encode(
    df: DataFrame, key: str, text: str, folder: str = TOKENIZER_DIR, name: str = VOCABULARY, out: str = "ids"
) -> DataFrame:
    """(``key``, ``out`` array<int>): the ids of each row's whole text, without special tokens; one row for each row of ``df``.

    Null and empty texts have no ids (an empty list, never null); text that spells a
    special token is ordinary text. Repeated rows stay repeated; an empty table stays
    empty; further columns are dropped, so their names cannot clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, pieces = encoder(folder, name)
        get = cache.__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids, ends = array("i"), []
                for value in part.column(1).to_pylist():
                    if value:
                        ids.extend(chain.from_iterable(map(get, pieces(value))))
                    ends.append(len(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), _arrow_ids(ids, ends)], names=[key, out])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, `{out}` array<int>")


def count_tokens(
    df: DataFrame, keys: list[str], text: str, folder: str = TOKENIZER_DIR, name: str = VOCABULARY, out: str = "n_tokens"
) -> DataFrame:
    """``keys`` and the number of tokens of each row's whole text; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, pieces = encoder(folder, name)
        get = cache.__getitem__
        for batch in batches:
            counts = [sum(map(len, map(get, pieces(v)))) if v else 0 for v in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(keys))], pa.array(counts, pa.int64())], names=[*keys, out]
            )

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return spread(df.select(*keys, text)).mapInArrow(run, f"{kinds}, `{out}` bigint")


def decode(df: DataFrame, key: str, ids: str, folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> DataFrame:
    """(``key``, text): the text of each row's ids; an empty or null list gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, _ = encoder(folder, name)
        for batch in batches:
            column = batch.column(1)
            texts = [
                cache.encoder.decode(np.asarray(v.values)).decode("utf-8", "replace") if v.is_valid else ""
                for v in column
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(ids)).mapInArrow(run, f"`{key}` {kind}, text string")

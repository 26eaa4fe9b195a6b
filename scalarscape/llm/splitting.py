"""Texts over a token limit cut at topic boundaries, with overlap between the pieces.

A text is cut into units (pre-tokens; long ones into runs of whole characters), each
with its number of tokens. At every gap after a sentence, line or paragraph the
words of a sliding block before it are compared with those of the block after it; the
depth of the valley that this similarity has there tells a topic boundary. Each
piece ends at the deepest valley within its size window; where the window has none,
at the deepest one before it in the piece, and only without any at a weaker kind of
boundary. The next piece starts the asked number of tokens before that end. Token counts of the pieces are exact: a piece starts and
ends between tokens, and encoding it alone gives these tokens.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scalarscape.llm import tokenizer
from scalarscape.session import spread

BLOCK_WORDS = 24  # words on either side of a gap
NEIGHBOURS = 3  # gaps on either side among which a valley's shoulders are sought
LONG_UNIT = 8  # tokens beyond which a pre-token is cut into runs
FILL = 0.5  # a piece brings at least this part of what it may bring that is new, unless a sentence, line or paragraph ends only earlier
HELD_CHARS = 400_000  # characters of texts whose units a task holds at once
NOTHING = object()
MAX_LIMITS = 1000  # rows of the table of limits, which the driver reads

#: Kinds of boundary, weakest first.
KINDS = ("hard", "word", "clause", "sentence", "line", "paragraph")
HARD, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
SENTENCE_END = frozenset(".!?…。！？")
CLAUSE_END = frozenset(",;:)]—–、，；：）」』")


def _kind(piece: str) -> int:
    """Boundary after a pre-token: white space of two lines, of one line, a sentence's or clause's end, a word."""
    if "\n" in piece:
        return PARAGRAPH if piece.count("\n") > 1 else LINE
    last = piece.rstrip()[-1:] if piece else ""
    return SENTENCE if last in SENTENCE_END and last else CLAUSE if last in CLAUSE_END and last else WORD


class Units(dict):
    """The worker's memory of pre-tokens: per piece, unit after unit, tokens, characters, kind of boundary after, word (0: none)."""

    def __init__(self, cache: tokenizer.PieceCache):
        super().__init__()
        self.cache, self.words = cache, {}

    def word(self, shown: str) -> int:
        if len(self.words) > tokenizer.CACHE_ENTRIES:
            self.words.clear()
        return self.words.setdefault(shown.strip().casefold(), len(self.words) + 1)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.cache[piece]
        if len(ids) <= LONG_UNIT:
            units = (len(ids), len(piece), _kind(piece), self.word(piece) if any(c.isalnum() for c in piece) else 0)
        else:
            units = tuple(chain.from_iterable(self._runs(piece, ids)))
        if len(piece) <= tokenizer.CACHED_LENGTH:
            if len(self) >= tokenizer.CACHE_ENTRIES:
                self.clear()
            self[piece] = units
        return units

    def _runs(self, piece: str, ids: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """Shortest runs of tokens that hold whole characters."""
        data = piece.encode("utf-8")
        sizes, at, start, tokens = self.cache.encoder.length, 0, 0, 0
        for token in ids:
            at += sizes[token]
            tokens += 1
            if at == len(data) or data[at] & 0xC0 != 0x80:
                shown = data[start:at].decode("utf-8")
                end = at == len(data)
                yield tokens, len(shown), _kind(piece) if end else HARD, self.word(shown) if shown.strip() else 0
                start, tokens = at, 0


def gap_depths(words: np.ndarray, gaps: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Valley depth at each gap, a position in ``words`` within a text's ``first`` and ``last`` position.

    The depth tells how far the cosine similarity of the word counts of the blocks
    beside the gap lies below the highest of the neighbouring gaps on either side.
    """
    n, k, m = len(words), BLOCK_WORDS, len(gaps)
    if not m:
        return np.zeros(0)
    lo, hi = np.maximum(gaps - k, first), np.minimum(gaps + k, last)
    cross, left, right = np.zeros(m), (gaps - lo).astype(float), (hi - gaps).astype(float)
    for d in range(1, min(2 * k, n)):
        total = np.zeros(n + 1, dtype=np.int32)
        np.cumsum(words[d:] == words[:-d], out=total[1 : n - d + 1])  # pairs (i, i + d) of one word, by i
        total[n - d + 1 :] = total[n - d]
        seam_l, seam_r = total[np.maximum(lo, gaps - d)], total[np.maximum(np.minimum(gaps, hi - d), 0)]
        cross += np.where(np.minimum(gaps, hi - d) > np.maximum(lo, gaps - d), seam_r - seam_l, 0)
        if d < k:
            left += 2 * np.where(gaps - d > lo, total[np.maximum(gaps - d, 0)] - total[lo], 0)
            right += 2 * np.where(hi - d > gaps, total[np.maximum(hi - d, 0)] - total[gaps], 0)
    like = cross / np.sqrt(np.maximum(left * right, 1e-12))
    before, after = like.copy(), like.copy()
    for s in range(1, NEIGHBOURS + 1):
        own = first[s:] == first[:-s]
        before[s:] = np.where(own, np.maximum(before[s:], like[:-s]), before[s:])
        after[:-s] = np.where(own, np.maximum(after[:-s], like[s:]), after[:-s])
    return before + after - 2 * like


class Text:
    """One text's units as plain lists, with its gaps by kind."""

    def __init__(self, table: np.ndarray, kind: np.ndarray, depth: np.ndarray):
        self.tokens = [0, *np.cumsum(table[:, 0]).tolist()]  # before each unit and, last, of all
        self.chars = [0, *np.cumsum(table[:, 1]).tolist()]
        self.kind = kind.tolist()
        score = depth + 0.1 * kind
        self.gaps = []  # by least kind: the units that end there, and their scores
        for least in (SENTENCE, CLAUSE, WORD):
            at = np.flatnonzero(kind >= least)
            self.gaps.append(((at + 1).tolist(), score[at].tolist()))

    def best_end(self, low: int, top: int, classes: list) -> int:
        """The unit before which a piece ends: the deepest valley of the window's strongest class, the later one of equals; 0 for none."""
        for ends, scores in classes:
            i, j = bisect_left(ends, low), bisect_right(ends, top)
            if i < j:
                window = scores[i:j]
                return ends[j - 1 - window[::-1].index(max(window))]
        return 0

    def natural_ends(self, low: int, top: int) -> list[int]:
        """The ends of sentences, lines and paragraphs from ``low`` to ``top``, the deepest valley first, the later one of equals."""
        ends, scores = self.gaps[0]
        at = range(bisect_left(ends, low), bisect_right(ends, top))
        return [ends[i] for i in sorted(at, key=lambda i: (scores[i], i), reverse=True)]

    def cuts(self, limit: int, overlap: int, inner) -> list[tuple[int, int, int, int, int]]:
        """Per piece: start unit, tokens and characters of it left out, end unit, tokens shared with the piece before.

        ``inner(unit, k)``: the characters that a unit's first k tokens hold if they hold whole ones, else None.
        """
        total, n = self.tokens, len(self.tokens) - 1
        overlap = max(0, min(overlap, limit // 2))

        def resume(begin: int, end: int) -> tuple[int, int, int]:
            """Where the piece after one of ``begin`` (tokens) to ``end`` (units) starts: unit, tokens and characters left out."""
            if not overlap:
                return end, 0, 0
            wish = max(total[end] - overlap, begin + 1)
            unit = bisect_right(total, wish) - 1
            for skip in range(wish - total[unit], -1, -1):
                inside = inner(unit, skip) if skip else 0
                if inside is not None:
                    break
            if total[unit] + skip <= begin or total[end] - total[unit] - skip >= limit:
                return end, 0, 0
            return unit, skip, inside

        def overlaps(begin: int, end: int) -> bool:
            """Whether the next piece can share what is asked."""
            return not overlap or (total[end] - overlap > begin and resume(begin, end)[0] < end)

        out, unit, skip, inside, done = [], 0, 0, 0, 0
        while True:
            begin = total[unit] + skip
            shared = total[done] - begin
            if total[n] - begin <= limit:
                out.append((unit, skip, inside, n, shared))
                return out
            top = max(bisect_right(total, begin + limit) - 1, done + 1)  # a single unit over the limit stands alone
            fresh = begin + limit - total[done]
            low = min(max(bisect_left(total, total[done] + int(FILL * fresh)), done + 1), top)
            end = (
                self.best_end(low, top, self.gaps[:1])
                or next((e for e in self.natural_ends(done + 1, low - 1) if overlaps(begin, e)), 0)
                or self.best_end(low, top, self.gaps[1:])
                or top
            )
            out.append((unit, skip, inside, end, shared))
            unit, skip, inside = resume(begin, end)
            done = end


def split(
    documents: DataFrame,
    limits: DataFrame,
    folder: str = tokenizer.TOKENIZER_DIR,
    vocabulary: str = tokenizer.VOCABULARY,
) -> DataFrame:
    """Pieces (doc_id, limit_name, piece_no, start_char, end_char, n_tokens, overlap_tokens, boundary, text) of the texts over each limit.

    Texts within a limit, null and empty texts give no pieces for it. ``piece_no``
    counts from 0; ``n_tokens``, the piece's tokens when encoded alone, is never above
    max_tokens but for one character that alone exceeds it; ``overlap_tokens`` is what a
    piece shares with the one before, the asked number or the few more that whole
    characters need; ``boundary`` is the kind of its end (``end`` for the last). Limits
    with a null or non-positive max_tokens are passed over, a null overlap is 0 and at
    most half of a limit overlaps. Repeated rows of documents are cut each for itself;
    empty tables give no rows; further columns are ignored.
    """
    rules = limits.select("limit_name", "max_tokens", "overlap_tokens").where("max_tokens > 0").limit(MAX_LIMITS + 1).collect()
    if len(rules) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits")
    rules = [(r.limit_name, r.max_tokens, r.overlap_tokens or 0) for r in rules]
    least = min((r[1] for r in rules), default=0)
    names = ["doc_id", "limit_name", "piece_no", "start_char", "end_char", "n_tokens", "overlap_tokens", "boundary", "text"]
    kinds_of = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def pieces_of(key: int, text: str, t: Text, cache: tokenizer.PieceCache, out: list[list]) -> None:
        tokens, chars = t.tokens, t.chars

        def inner(unit: int, k: int) -> int | None:
            data = text[chars[unit] : chars[unit + 1]]
            head = b"".join(map(cache.encoder.token_bytes.__getitem__, cache[data][:k]))
            try:
                return len(head.decode("utf-8"))
            except UnicodeDecodeError:
                return None

        for name, limit, overlap in rules:
            if tokens[-1] <= limit:
                continue
            cuts = t.cuts(limit, overlap, inner)
            for number, (unit, skip, inside, end, shared) in enumerate(cuts):
                start, stop = chars[unit] + inside, chars[end]
                shown = text[start:stop]
                size = tokens[end] - tokens[unit] - skip
                tail = shown[len(shown.rstrip()) :]
                if len(tail) > 1:  # white space at a text's end is encoded in one
                    first = bisect_left(chars, stop - len(tail))
                    if chars[first] == stop - len(tail):
                        size += len(cache[tail]) - (tokens[end] - tokens[first])
                for column, value in zip(
                    out,
                    (key, name, number, start, stop, size, shared,
                     "end" if number == len(cuts) - 1 else KINDS[t.kind[end - 1]], shown),
                    strict=True,
                ):
                    column.append(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, pieces = tokenizer.encoder(folder, vocabulary)
        units = Units(cache)
        get = units.__getitem__
        for batch in batches:
            todo = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            more = True
            while more:
                flat, ends, texts, held = array("q"), [], [], 0
                while more and held < HELD_CHARS:
                    key, text = next(todo, (None, NOTHING))
                    more = text is not NOTHING
                    if more and text and 4 * len(text) > least:
                        held += len(text)
                        at = len(flat)
                        flat.extend(chain.from_iterable(map(get, pieces(text))))
                        if sum(flat[at::4]) > least:
                            texts.append((key, text))
                            ends.append(len(flat) // 4)
                        else:
                            del flat[at:]
                if not texts:
                    continue
                table = np.frombuffer(flat, dtype=np.int64).reshape(-1, 4)
                kind = table[:, 2].copy()
                line = kind >= LINE
                opened = np.zeros(len(kind), dtype=bool)  # units that begin a text
                opened[[0, *ends[:-1]]] = True
                after = line[1:] & line[:-1] & ~opened[1:]  # a line's end after a line's end makes a paragraph
                kind[1:][after] = PARAGRAPH
                before_break = line[1:] & ~opened[1:]
                kind[:-1][before_break] = np.minimum(kind[:-1][before_break], CLAUSE)  # cut after white space, not before it
                is_word = table[:, 3] > 0
                upto = np.cumsum(is_word)  # words up to and with each unit
                at = np.flatnonzero(kind >= SENTENCE)
                begins = np.array([0, *ends[:-1]])
                text_of = np.searchsorted(np.array(ends), at, side="right")
                word_first = (upto[begins] - is_word[begins])[text_of]
                word_last = upto[np.array(ends) - 1][text_of]
                depth = np.zeros(len(kind))
                depth[at] = gap_depths(table[is_word, 3].astype(np.int32), upto[at], word_first, word_last)
                out: list[list] = [[] for _ in names]
                for (key, text), a, b in zip(texts, begins.tolist(), ends, strict=True):
                    pieces_of(key, text, Text(table[a:b], kind[a:b], depth[a:b]), cache, out)
                del table
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds_of, strict=True)], names=names)

    schema = (
        "doc_id bigint, limit_name string, piece_no int, start_char bigint, end_char bigint, n_tokens int, "
        "overlap_tokens int, boundary string, text string"
    )
    return spread(documents.select("doc_id", "text")).mapInArrow(run, schema)

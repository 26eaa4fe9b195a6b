"""Text decoded with the wrong character encoding: found and, where possible, restored.

A best-first search runs over texts: an edge encodes a text with one codec and
decodes the bytes with another, or undoes an escape. States are visited once.
The cost of a text is its implausibility, character by character, under counts of
character sequences over the whole table, with a prior by kind of character; each
edge adds a little. The search ends when no open state can beat the cheapest text
found, and that text is the restored one. A text is garbled if the way there decodes
anew, or if it holds characters that only a failed decoding leaves behind.

Codecs that read a text's characters as the same bytes are one edge, and a
translation that needs a character which no text of the table holds is dropped
unscored where that character alone costs more than there is to gain.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalarscape.session import cut_lineage, partitions_for

BITS = 20  # the model has 2 ** BITS counters for each length of sequence, whatever the table's size
DECODE_STEP = 1.5  # nats that an edge between codecs costs
RARE_STEP = 5.0  # the same where one of the two is a rare codec
UNESCAPE_STEP = 0.5
BROADCAST_CHARS = 8_000_000  # characters of garbled texts up to which the verdicts are broadcast; beyond it they are joined by salted shuffle
SALTS = 16

#: The public codecs of one byte a character, the usual and the rare ones, those of several, and the bytes that careless tools drop.
USUAL = ["latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-15", "koi8-r", "mac-roman", "cp437", "cp850", "cp866"]
RARE = [
    "cp1254", "cp1255", "cp1256", "cp1257", "cp1258", "iso8859-3", "iso8859-4", "iso8859-6", "iso8859-8", "iso8859-9", "iso8859-10",
    "iso8859-11", "iso8859-13", "iso8859-14", "iso8859-16", "koi8-u", "mac-cyrillic", "mac-greek", "mac-latin2", "mac-turkish",
    "cp737", "cp775", "cp852", "cp855", "cp857", "cp858", "cp860", "cp861", "cp862", "cp863", "cp864", "cp865", "cp869", "cp874",
]
SINGLE = USUAL + RARE
MULTI = ["gbk", "cp932", "big5hkscs", "euc-jp", "cp949"]
LOST = [0x81, 0x8D, 0x8F, 0x90, 0x9D, 0xA0, 0xAD]
AS_BYTES = ["cp1252", "mac-roman", "cp1251", "koi8-r", "gbk", "shift_jis"]  # true codecs tried where UTF-8 was the wrong one

DIGITS = re.compile(r"[0-9]")
HIGH_RUN = re.compile(r"[^\x00-\x7f]+")
ESCAPE_PATTERN = r"&#?\w+;|%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}"
ESCAPES = re.compile(ESCAPE_PATTERN)
LEAD = re.compile("[\xc2-\xf4]")
PAIR = re.compile("[\x80-\xff][@-\xff]")  # bytes that a codec of several can read as one character
UTF8_SEQUENCE = re.compile(
    "[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    "|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)


class _Read(dict):
    """A table for str.translate: the byte, as a character, that ``of`` gives a character, NUL where it gives none; ASCII stays."""

    def __init__(self, of):
        super().__init__({i: i for i in range(128)})
        self.of = of

    def __missing__(self, code: int) -> int:
        byte = self[code] = self.of(chr(code))
        return byte


class _Codec:
    """A codec of one byte a character; bytes that it leaves undefined stand for their control characters."""

    def __init__(self, name: str):
        self.name = name
        self.chars = []
        for b in range(128, 256):
            try:
                self.chars.append(bytes([b]).decode(name))
            except UnicodeDecodeError:
                self.chars.append(chr(b))
        self.byte = {c: b for b, c in enumerate(self.chars, 128) if len(c) == 1}
        self.own = _Read(lambda c: self.byte.get(c, 0))
        self.other_case = _Read(self._other)
        self.follow = _Read(lambda c: b if 0x80 <= (b := self.byte.get(c, 0)) <= 0xBF else self._other(c))

    def _other(self, c: str) -> int:
        swapped = c.swapcase()
        return self.byte.get(swapped, 0) if len(swapped) == 1 else 0

    @lru_cache(maxsize=None)  # noqa: B019 - as many as there are codecs, for a worker's life
    def to(self, true: _Codec) -> dict[int, str]:
        """A table for str.translate from what this codec read to what ``true`` reads."""
        return {ord(c): true.chars[b - 128] for c, b in self.byte.items() if true.chars[b - 128] != c}


@lru_cache(maxsize=1)
def _codecs() -> dict[str, _Codec]:
    return {name: _Codec(name) for name in SINGLE}


def left_by_failure(text: str) -> bool:
    """Whether a text holds what only a failed decoding leaves: replacement and C1 control characters, lone surrogates."""
    return any(c == "�" or "\x80" <= c <= "\x9f" or "\ud800" <= c <= "\udfff" for c in text)


def _unassigned(text: str) -> set[str]:
    """Private-use and unassigned characters: icon fonts have them, but no decoding that brings new ones is right."""
    return {c for c in text if c > "\x7f" and unicodedata.category(c) in ("Co", "Cn")}


def _need(lead: int) -> int:
    return 1 if 0xC2 <= lead <= 0xDF else 2 if 0xE0 <= lead <= 0xEF else 3 if 0xF0 <= lead <= 0xF4 else 0


def _as_utf8(text: str, read: str) -> str:
    """Each UTF-8 sequence among the bytes ``read`` for the characters of a text, decoded; all other characters stay."""
    out, done = [], 0
    for m in UTF8_SEQUENCE.finditer(read):
        out += [text[done : m.start()], m[0].encode("latin-1").decode("utf-8")]
        done = m.end()
    return "".join(out) + text[done:] if out else text


def _as_utf8_recased(text: str, codec: _Codec) -> str:
    """``_as_utf8`` where letters of a sequence may have changed case since."""
    reads, follow = (text.translate(codec.own), text.translate(codec.other_case)), text.translate(codec.follow)
    out, done = [], 0
    for at in sorted({m.start() for read in reads for m in LEAD.finditer(read)}):
        if at < done:
            continue
        for read in reads:
            need = _need(ord(read[at]))
            tail = follow[at + 1 : at + 1 + need]
            if not need or len(tail) < need or not all("\x80" <= b <= "\xbf" for b in tail):
                continue
            try:
                char = (read[at] + tail).encode("latin-1").decode("utf-8")
            except UnicodeDecodeError:
                continue
            out += [text[done:at], char]
            done = at + 1 + need
            break
    return "".join(out) + text[done:] if out else text


def _as_utf8_lost(text: str, read: str, choose) -> str:
    """``_as_utf8`` where bytes of LOST may have been dropped from a sequence or a no-break space made a plain one.

    ``choose(before, options, rest)`` picks among what a sequence can have been, given as
    (character, characters used up); characters that form one by chance may stay as they are.
    """
    out, done = [], 0
    for m in LEAD.finditer(read):
        at, need = m.start(), _need(ord(m[0]))
        if at < done:
            continue
        follow = 0
        while follow < need and at + 1 + follow < len(read) and "\x80" <= read[at + 1 + follow] <= "\xbf":
            follow += 1
        bytes_left = tuple(map(ord, read[at + 1 : at + 1 + follow]))
        if follow == need:
            chars = _lost_chars(ord(m[0]), bytes_left, need)
            options = [(c, 1 + need) for c in chars] + [(text[at : at + 1 + need], 1 + need)] if chars else []
        else:
            spaced = text[at + 1 + follow : at + 2 + follow] == " "
            lefts = (bytes_left, (*bytes_left, 0xA0)) if spaced else (bytes_left,)
            options = [(c, 1 + len(left)) for left in lefts for c in _lost_chars(ord(m[0]), left, need)]
        if options:
            out.append(text[done:at])
            before = "".join(out[-2:])[-2:]
            char, used = choose(before, options, text[at : at + 12])
            out.append(char)
            done = at + used
    return "".join(out) + text[done:] if out else text


def _fillings(follow: list[int], need: int) -> Iterator[list[int]]:
    if len(follow) == need:
        yield follow
        return
    for at in range(len(follow) + 1):
        for b in LOST:
            yield from _fillings([*follow[:at], b, *follow[at:]], need)


@lru_cache(maxsize=100_000)
def _lost_chars(lead: int, follow: tuple[int, ...], need: int) -> list[str]:
    """Characters whose bytes a lead byte and what is left of its sequence can have been."""
    out = {}
    for filled in _fillings(list(follow), need):
        try:
            out[bytes([lead, *filled]).decode("utf-8")] = True
        except UnicodeDecodeError:
            continue
    return list(out)


SPREAD, WIDE = 0x9E3779B97F4A7C15, 0x110000  # multiplier of the hash, number of code points


def _counter(x: int) -> int:
    return ((x * SPREAD) & 0xFFFFFFFFFFFFFFFF) >> (64 - BITS)


def _prior(c: str) -> float:
    if c < "\x80":
        return 1e-2
    kind = unicodedata.category(c)
    return 1e-9 if c == "�" or kind[0] == "C" else 1e-5 if kind[0] == "L" else 3e-6


@lru_cache(maxsize=1)
def _priors() -> np.ndarray:
    return np.array([_prior(chr(i)) for i in range(WIDE)], dtype=np.float64)


class Plausibility(dict):
    """Implausibility of texts in nats, from hashed counts of one, two and three characters; letter case and digits are set aside.

    As a dict it holds the cost of each sequence of three characters met so far.
    """

    def __init__(self, counts: np.ndarray):
        super().__init__()
        self.counts = counts
        self.ways: dict[str, str] = {}  # found so far, by shape
        self.chosen: dict[tuple, tuple[str, int]] = {}  # what lost bytes can have been, by what stands around them
        self.one, self.two, self.three = counts
        self.total = max(1.0, float(self.one.sum(dtype=np.float64)))
        self.floors: dict[str, float] = {}
        self.least = np.array([[self.floor(c) for c in codec.chars] for codec in _codecs().values()])  # by codec and byte

    def floor(self, text: str) -> float:
        """What the characters of a text cost at least, wherever they stand: those that the table lacks their prior, the others nothing."""
        total = 0.0
        for c in text:
            if c > "\x7f":
                least = self.floors.get(c)
                if least is None:
                    low = c.lower()[:1]
                    absent = self.one[_counter(ord(low))] == 0
                    least = self.floors[c] = -float(np.log(50 * _prior(low) / (self.total + 50))) if absent else 0.0
                total += least
        return total

    @staticmethod
    def plain(text: str) -> str:
        return "\x02\x02" + DIGITS.sub("0", text).lower() + "\x03"

    @staticmethod
    def hashes(plain: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = np.frombuffer(plain.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
        mix = lambda x: ((x * np.uint64(SPREAD)) >> np.uint64(64 - BITS)).astype(np.int64)
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        pair = b * np.uint64(WIDE) + c
        return mix(c), mix(pair + np.uint64(1)), mix(pair * np.uint64(WIDE) + a + np.uint64(2))

    def __missing__(self, three: str) -> float:
        """Cost of the last character after the first two."""
        a, b, c = three
        prior = _prior(c)
        texts = float(self.one[_counter(2 + 1)])  # a text's end, character 3, occurs once a text
        single = texts if b == "\x02" else self.one[_counter(ord(b))]
        pair = texts if b == "\x02" else self.two[_counter(ord(a) * WIDE + ord(b) + 1)]
        x, y = _counter(ord(c)), _counter(ord(b) * WIDE + ord(c) + 1)
        z = _counter((ord(b) * WIDE + ord(c)) * WIDE + ord(a) + 2)
        p1 = (self.one[x] + 50 * prior) / (self.total + 50)
        bc = min(float(self.two[y]), float(self.one[x]), float(single))  # no sequence is more frequent than its parts: colliding counters show
        abc = min(float(self.three[z]), bc, float(pair))
        p2 = (bc + 2 * p1) / (single + 2)
        p3 = (abc + 2 * p2) / (pair + 2)
        cost = self[three] = float(-np.log(p3))
        if len(self) > 1_000_000:
            self.clear()
        return cost

    def cost(self, text: str) -> float:
        t = "\x02\x02" + DIGITS.sub("0", text).lower() + "\x03"
        return sum([self[t[i : i + 3]] for i in range(len(t) - 2)])

    def doubtful(self, text: str) -> float:
        """The part of a text's cost that its characters beyond ASCII bring about, all that decoding can save."""
        t = self.plain(text)
        return sum([self[x] for i in range(len(t) - 2) if not (x := t[i : i + 3]).isascii()])

    def translated(self, text: str, letters: list[str], outcomes: list[tuple[str, ...]]) -> np.ndarray:
        """For each of the ``outcomes``, which put other characters for ``letters``, what ``doubtful`` makes of the text, at once."""
        row = np.frombuffer(self.plain(text).encode("utf-32-le", "replace"), dtype=np.uint32)
        if len(row) != len(text) + 3:  # a letter whose lower case is two characters
            return np.array([self.doubtful(text.translate(dict(zip(map(ord, letters), o, strict=True)))) for o in outcomes])
        high = row > 0x7F
        starts = np.flatnonzero(high[:-2] | high[1:-1] | high[2:])
        spots = [2 + np.array([i for i, c in enumerate(text) if c == letter]) for letter in letters]
        texts, total = float(self.one[_counter(2 + 1)]), self.total + 50
        mix = lambda x: ((x * np.uint64(SPREAD)) >> np.uint64(64 - BITS)).astype(np.int64)
        wide, costs = np.uint64(WIDE), []
        step = max(1, 100_000 // max(1, len(starts)))
        for i in range(0, len(outcomes), step):
            part = outcomes[i : i + step]
            codes = np.repeat(row[None, :].astype(np.uint64), len(part), axis=0)
            for at, chars in zip(spots, zip(*part, strict=True), strict=True):
                codes[:, at] = np.array([ord(c.lower()[0]) for c in chars], dtype=np.uint64)[:, None]
            a, b, c = codes[:, starts], codes[:, starts + 1], codes[:, starts + 2]
            seam, one = b == 2, self.one[mix(c)]
            pairs = b * wide + c
            single = np.where(seam, texts, self.one[mix(b)])
            pair = np.where(seam, texts, self.two[mix(a * wide + b + np.uint64(1))])
            bc = np.minimum(np.minimum(self.two[mix(pairs + np.uint64(1))], one), single)
            abc = np.minimum(np.minimum(self.three[mix(pairs * wide + a + np.uint64(2))], bc), pair)
            p2 = (bc + 2 * (one + 50 * _priors()[c.astype(np.int64)]) / total) / (single + 2)
            costs.append(-np.log((abc + 2 * p2) / (pair + 2)).sum(axis=1))
        return np.concatenate(costs) if costs else np.zeros(0)

    def choose(self, before: str, options: list[tuple[str, int]], rest: str) -> tuple[str, int]:
        """The cheapest of what a broken sequence can have been, between ``before`` and what follows it in ``rest``."""
        key = (before, tuple(options), rest)
        known = self.chosen.get(key)
        if known is not None:
            return known

        def cost(option: tuple[str, int]) -> float:
            t = self.plain(before + option[0])[-1 - len(option[0]) - 2 : -1]
            after = rest[option[1] :][:2]
            seam = self.plain(option[0] + after)[2:5] if after.isascii() else ""
            return sum(self[t[i : i + 3]] for i in range(len(t) - 2)) + (self[seam] if len(seam) == 3 else 0.0)

        if len(self.chosen) > 500_000:
            self.chosen.clear()
        options = [o for o in options if not self.floor(o[0])] or options  # characters that the table lacks are the last resort
        best = self.chosen[key] = min(options, key=cost)
        return best


_SHARED: list[Plausibility] = []


def shared(counts: np.ndarray) -> Plausibility:
    """The model of a Python worker: tasks that run in it one after another share what was computed."""
    if not (_SHARED and _SHARED[0].counts is counts):
        _SHARED[:] = [Plausibility(counts)]
    return _SHARED[0]


UNESCAPE = {
    "unescape": html.unescape,
    "unquote": lambda text: unquote(text, errors="replace"),
    "backslash": lambda text: re.sub(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})", lambda m: chr(int(m[1] or m[2], 16)), text),
}


def _readable(data: bytes, codec: str) -> bool:
    try:
        data.decode(codec)
    except UnicodeDecodeError:
        return False
    return True


def _recoded_runs(text: str, codec: str, true: str) -> str:
    """Each run beyond ASCII that ``codec`` can write and ``true`` can read, recoded; the others stay."""

    def run(m: re.Match) -> str:
        try:
            return m[0].encode(codec).decode(true)
        except UnicodeError:
            return m[0]

    return HIGH_RUN.sub(run, text)


def _spans_as_multi(text: str, read: str, true: str) -> str:
    """Spans of the bytes ``read`` for the characters of a text, as ``true`` reads them; what has no bytes or cannot be read stays."""
    if "\x00" not in read:
        return read.encode("latin-1").decode(true)
    out, at = [], 0
    for span in re.split("(\x00+)", read):
        piece = text[at : at + len(span)]
        at += len(span)
        if PAIR.search(span):
            try:
                piece = span.encode("latin-1").decode(true)
            except UnicodeDecodeError:
                pass
        out.append(piece)
    return "".join(out)


def take_edge(text: str, edge: str, model: Plausibility) -> str:
    """The text that an edge leads to; a text that the edge does not apply to stays."""
    if edge in UNESCAPE:
        return UNESCAPE[edge](text)
    pair, _, form = edge.partition("/")
    wrong, _, true = pair.partition(">")
    codecs = _codecs()
    try:
        if wrong == "utf-8":
            return text.encode("utf-8", "replace").decode(true)
        if wrong in MULTI:
            return _recoded_runs(text, wrong, true)
        if true in codecs:
            return text.translate(codecs[wrong].to(codecs[true]))
        if form == "case":
            return _as_utf8_recased(text, codecs[wrong])
        read = text.translate(codecs[wrong].own)
        if true != "utf-8":
            return _spans_as_multi(text, read, true)
        return _as_utf8_lost(text, read, model.choose) if form == "lost" else _as_utf8(text, read)
    except UnicodeError:
        return text


def _images(chars: Iterable[str], recased: bool = False) -> list[tuple[str, tuple[int, ...]]]:
    """(codec, bytes of the characters) of the codecs that hold any of them; of those that read all alike the first. ``recased``: their other case's bytes follow."""
    out = {}
    for name, codec in _codecs().items():
        image = tuple([codec.byte.get(c, 0) for c in chars])
        if recased:
            image = (*image, *[codec.other_case[ord(c)] for c in chars])
        if any(image) and image not in out:
            out[image] = name
    return [(name, image) for image, name in out.items()]


def _edges(text: str, model: Plausibility, room: Callable[[], float]) -> Iterator[tuple[str, float, str]]:
    """(edge, its cost, text there) of the edges that may lead from a text to others, the usual ones first.

    Translations whose result, by the characters that no text of the table holds, must
    cost ``room()`` or more are left out, and so are edges for which the bytes are not
    there, translations between two rare codecs and lost bytes under a rare one.
    """
    take = lambda edge: take_edge(text, edge, model)
    if ESCAPES.search(text):
        yield from ((edge, UNESCAPE_STEP, take(edge)) for edge in UNESCAPE)
    high: dict[str, int] = {}
    for c in text:
        if c > "\x7f":
            high[c] = high.get(c, 0) + 1
    if not high:
        return
    codecs = _codecs()
    images = [(name, image, text.translate(codecs[name].own)) for name, image in _images(high)]
    led = [(name, read) for name, image, read in images if any(map(_need, image))]
    yield from ((f"{name}>utf-8", DECODE_STEP, _as_utf8(text, read)) for name, read in led if UTF8_SEQUENCE.search(read))
    for wrong in MULTI:
        whole, runs = True, []
        for run in HIGH_RUN.findall(text):
            try:
                runs.append(run.encode(wrong))
            except UnicodeEncodeError:
                whole = False
        if runs:
            for true in ("utf-8", *[m for m in MULTI if m != wrong and whole]):
                if any(_readable(run, true) for run in runs):
                    yield f"{wrong}>{true}", DECODE_STEP, take(f"{wrong}>{true}")
    yield from ((f"{name}>utf-8/lost", DECODE_STEP + 1, take(f"{name}>utf-8/lost")) for name, _ in led if name in USUAL)
    yield from ((f"{name}>utf-8/case", DECODE_STEP + 1, take(f"{name}>utf-8/case")) for name, image in _images(high, recased=True) if any(map(_need, image)))
    times = np.array(list(high.values()), dtype=np.float64)
    fixed = model.cost(text) - model.doubtful(text)  # all-ASCII sequences, which translation leaves alone
    letters, outcomes = list(high), {}
    for name, image, read in images:
        usual = name in USUAL
        step = DECODE_STEP if usual else RARE_STEP
        held = np.flatnonzero(image)
        among = len(SINGLE) if usual else len(USUAL)
        steps = np.where(np.arange(among) < len(USUAL), step, RARE_STEP)
        least = model.least[:among, np.array(image)[held] - 128] @ times[held]
        for i in np.flatnonzero(fixed + least + steps < room()):
            if SINGLE[i] != name:
                chars = codecs[SINGLE[i]].chars
                outcome = tuple([chars[b - 128] if b else c for c, b in zip(letters, image, strict=True)])
                if outcome not in outcomes or steps[i] < outcomes[outcome][1]:
                    outcomes[outcome] = (f"{name}>{SINGLE[i]}", float(steps[i]))
        if PAIR.search(read):
            for true in MULTI:
                try:
                    yield f"{name}>{true}", step, _spans_as_multi(text, read, true)
                except UnicodeDecodeError:
                    continue
    costs = fixed + model.translated(text, letters, list(outcomes))
    for (outcome, (edge, step)), cost in zip(outcomes.items(), costs, strict=True):
        if cost + step < room() + 1e-6:
            yield edge, step, text.translate(dict(zip(map(ord, letters), outcome, strict=True)))
    yield from ((f"utf-8>{true}", DECODE_STEP, take(f"utf-8>{true}")) for true in AS_BYTES)


def search(text: str, model: Plausibility) -> tuple[str, str, float, float]:
    """(cheapest reachable text, way there, cost of the text, cost there); the way is empty for a sound text.

    A state's total is its cost and that of the way there. A state is opened if it is the
    cheapest text found when its turn comes. One reached by undoing UTF-8 sequences or
    escapes may be dearer by three quarters of what its characters beyond ASCII cost:
    bytes of other texts are hardly ever valid UTF-8, and doing so again would put one
    character for two to four. So a way only gets cheaper or shorter, each state is visited once,
    and the search ends by itself, when no open state can be hoped to beat the best text.
    States whose characters beyond ASCII cost less than another edge are at their end.
    """
    start = model.cost(text)
    if model.doubtful(text) <= DECODE_STEP and not ESCAPES.search(text):
        return text, "", start, start
    strange = _unassigned(text)
    best = (start, text, "")
    heap = [(start, 0, True, text, 0.0, "")]
    seen = {text}
    count = 0
    while heap:
        total, _, vouched, state, walked, way = heapq.heappop(heap)
        doubtful = model.doubtful(state)
        hoped = total - (0.75 * doubtful if vouched else 0.0)
        if hoped > best[0] or doubtful <= DECODE_STEP and not ESCAPES.search(state):
            continue
        for edge, step, reached in _edges(state, model, lambda: best[0] - walked):  # noqa: B023 - used within the loop
            if reached in seen:
                continue
            seen.add(reached)
            shorter = len(reached) < len(state) and (edge in UNESCAPE or edge.endswith(">utf-8"))
            if not shorter and walked + step + model.floor(reached) >= best[0]:
                continue
            cost = model.cost(reached) + walked + step
            route = f"{way} {edge}".strip()
            if shorter or cost < best[0]:
                count += 1
                heapq.heappush(heap, (cost, count, shorter, reached, walked + step, route))
            if cost < best[0] and not left_by_failure(reached) and _unassigned(reached) <= strange:
                best = (cost, reached, route)
    return best[1], best[2], start, best[0]


def retrace(text: str, way: str, model: Plausibility) -> str:
    """Where a way leads from a text of the same shape (digits aside) as the one it was found for."""
    for edge in way.split():
        text = take_edge(text, edge, model)
    return text


def lines(text: str) -> list[str]:
    """The lines that make up a text, whatever its length, with their ends: each was decoded as it was, and is searched on its own."""
    return re.findall(r"[^\n]*\n|[^\n]+", text) if "\n" in text else [text]


def decodes(way: str) -> bool:
    """Whether a way holds an edge between codecs."""
    return ">" in way


# --- the operator -----------------------------------------------------------------------------------------------------


def count_sequences(texts: DataFrame, text: str, weight: str) -> np.ndarray:
    """Counts of one, two and three characters over all texts, each weighted, as 3 x 2 ** BITS counters.

    Tasks count into arrays of that fixed size and only counters in use are summed and
    sent to the driver, so what it receives has a bound that does not grow with the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((3, 1 << BITS), dtype=np.float64)
        for batch in batches:
            for value, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row, h in zip(counts, Plausibility.hashes(Plausibility.plain(value)), strict=True):
                    np.add.at(row, h, n)
        flat = counts.ravel()
        used = np.flatnonzero(flat)
        for i in range(0, len(used), 65_536):
            part = used[i : i + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(flat[part], pa.float64())], names=["at", "n"])

    sums = texts.select(text, F.col(weight).cast("double")).mapInArrow(run, "at bigint, n double")
    rows = sums.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(3 << BITS, dtype=np.float32)
    counts[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return counts.reshape(3, 1 << BITS)


def garbled_texts(texts: DataFrame, text: str = "text", weight: str = "n", counts: np.ndarray | None = None) -> DataFrame:
    """(text, restored, way, restorable, cost, cost_restored) of the garbled ones among distinct, non-null ``texts``.

    ``restored`` is the cheapest reachable text, the text itself where nothing better is
    reached; ``restorable`` tells whether it was reached by decoding and holds nothing
    that a failed decoding leaves behind. Empty texts and texts in ASCII are sound;
    escape sequences and entities alone are no garble, a misreading behind them is.
    Null weights count as 1. ``counts``: those of ``count_sequences`` over other texts
    to judge by, else over these.
    """
    spark = texts.sparkSession
    weighed = texts.select(F.col(text).alias("text"), F.coalesce(F.col(weight), F.lit(1)).alias("n"))
    model = spark.sparkContext.broadcast(count_sequences(weighed, "text", "n") if counts is None else counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plausibility = shared(model.value)
        ways = plausibility.ways
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for value in batch.column(0).to_pylist():
                if value.isascii() and not ESCAPES.search(value):
                    continue
                taken, read = [], []
                for part in lines(value):
                    shape = part if ESCAPES.search(part) else DIGITS.sub("0", part)
                    way = ways.get(shape)
                    if way is None:
                        way = search(part, plausibility)[1]
                        if len(ways) >= 200_000:
                            ways.clear()
                        ways[shape] = way
                    taken.append(way)
                    read.append(retrace(part, way, plausibility) if decodes(way) else part)
                way, restored = " ".join(dict.fromkeys(w for w in taken if decodes(w))), "".join(read)
                if not (way or left_by_failure(value)):
                    continue
                good = decodes(way) and not left_by_failure(restored)
                row = (value, restored, way, good, plausibility.cost(value), plausibility.cost(restored))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                names=["text", "restored", "way", "restorable", "cost", "cost_restored"],
            )

    shape = F.regexp_replace("text", "[0-9]", "0")  # texts of one shape share a search; tasks are many, as a search is long
    return weighed.select("text").repartition(2 * partitions_for(spark), shape).mapInArrow(
        run, "text string, restored string, way string, restorable boolean, cost double, cost_restored double"
    )


def snapshot_texts(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, item_pos, slot, text) of every non-null title and value; positions count from 0, null items keep their place."""
    items = snapshots.select("snapshot_id", F.posexplode("context.field_items").alias("item_pos", "item"))
    sides = F.array(
        F.struct(F.lit("title").alias("slot"), F.col("item.title").alias("text")),
        F.struct(F.lit("value").alias("slot"), F.col("item.value").alias("text")),
    )
    rows = items.select("snapshot_id", "item_pos", F.inline(sides))
    return rows.where("text is not null")


def garbled_items(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, item_pos, slot, text, restored, way, restorable, cost, cost_restored) of each garbled title or value.

    Every distinct text is judged once and the verdicts are brought back to the rows, by
    broadcast up to ``BROADCAST_CHARS`` characters, else by a salted join, so that a text
    that a third of all rows hold is no bottleneck. A snapshot sent again counts once.
    Null sections, lists, items and texts and an empty table give no rows; further
    columns are ignored.
    """
    rows = snapshot_texts(snapshots)
    distinct = cut_lineage(rows.groupBy("text").agg(F.count(F.lit(1)).alias("n")))
    verdicts = cut_lineage(garbled_texts(distinct))
    suspect = rows.where(F.col("text").rlike(rf"[^\x00-\x7f]|{ESCAPE_PATTERN}"))
    size = verdicts.agg(F.coalesce(F.sum(F.length("text") + F.length("restored") + F.length("way") + 64), F.lit(0))).first()[0]
    if size <= BROADCAST_CHARS:
        found = suspect.join(F.broadcast(verdicts), "text")
    else:
        salted = suspect.withColumn("_salt", F.pmod(F.xxhash64("snapshot_id", "item_pos"), F.lit(SALTS)))
        spread = verdicts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        found = salted.join(spread, ["text", "_salt"]).drop("_salt")
    return found.select(
        "snapshot_id", "item_pos", "slot", "text", "restored", "way", "restorable", "cost", "cost_restored"
    ).dropDuplicates(["snapshot_id", "item_pos", "slot"])


#: Ways in which the recovery test misreads sound texts: (true codec, codec it is read with), one after another.
PLANTS = [
    *[[("utf-8", wrong)] for wrong in ("latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1256", "cp1257", "iso8859-2", "iso8859-7", "koi8-r", "mac-roman", "mac-cyrillic", "cp437", "cp850", "cp852", "cp866", "gbk", "cp932")],
    *[[(true, "cp1252")] for true in ("cp1250", "cp1251", "cp1253", "cp1256", "koi8-r", "cp866", "cp932", "gbk")],
    *[[(true, "cp1251")] for true in ("koi8-r", "cp866", "cp1252")],
    [("utf-8", "cp1252"), ("utf-8", "cp1252")], [("utf-8", "cp1251"), ("utf-8", "latin-1")],
]


def planted(texts: DataFrame) -> DataFrame:
    """(original, plant, text): every distinct text beyond ASCII misread in one way of PLANTS, the first from its hash on that its characters allow and that changes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for original, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k in range(len(PLANTS)):
                    chain, text = PLANTS[(first + k) % len(PLANTS)], original
                    try:
                        for true, wrong in chain:
                            text = text.encode(true).decode(wrong)
                    except UnicodeError:
                        continue
                    if text != original:
                        rows.append((original, ", ".join(f"{true} as {wrong}" for true, wrong in chain), text))
                        break
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["original", "plant", "text"])

    spread_out = texts.select("text", F.pmod(F.xxhash64("text"), F.lit(len(PLANTS))).alias("_first"))
    return spread_out.mapInArrow(run, "original string, plant string, text string")


def recovery(snapshots: DataFrame) -> DataFrame:
    """(plant, n, found, restored): how many sound titles and values are found and restored after they were misread on purpose.

    The texts are all distinct ones beyond ASCII in which no garble is found; each is
    misread in one way, judged under the table's own counts and compared with its original.
    """
    distinct = cut_lineage(snapshot_texts(snapshots).groupBy("text").agg(F.count(F.lit(1)).alias("n")))
    counts = count_sequences(distinct, "text", "n")
    bad = garbled_texts(distinct, counts=counts).select("text")
    sound = distinct.where(F.col("text").rlike(r"[^\x00-\x7f]")).join(bad, "text", "left_anti")
    plants = cut_lineage(planted(sound))
    judged = garbled_texts(plants.select("text", F.lit(1).alias("n")).distinct(), counts=counts).select("text", "restored")
    both = plants.join(judged, "text", "left")
    return both.groupBy("plant").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("restored").isNotNull()).alias("found"), F.count_if(F.col("restored") == F.col("original")).alias("restored")
    )

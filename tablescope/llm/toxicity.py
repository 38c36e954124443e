"""Operator 8: toxicity of texts, after undoing disguises by a noisy channel.

Words may be disguised by look-alike signs (``1d10t``), by drawn-out letters (``idiooot``) and by parted letters
(``i d i o t``, ``i.d.i.o.t``). Such words, and only such, are decoded: every sign opens a lattice of the letters it may
stand for, repeats may be dropped, marks between letters vanish, and the Viterbi path of highest probability under a
character trigram model times the channel's odds is the restored word. Words and runs of parted letters may have any
length; a run is decoded as one word and as several, and all windows of 3 to 24 of its letters count as words. Texts are then scored by the words they hold and
the words restored, and the beginnings of both, with a linear model over these indicators.

The language model counts the trigrams of all words of all documents: each task counts into a table of fixed size, and the
tables are added up by Spark. The classifier is fitted on at most ``SAMPLE`` labelled rows.

Null and empty texts hold no words; their score is that of a margin of 0. Labels follow the rules of ``quality``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.linear import folded, per_text
from tablescope.llm.quality import fitted, scored
from tablescope.llm.scan import Hasher, chunks, mixed, words

# Letters that a sign is often written for, the likeliest first.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li",
    "+": "t", "(": "c", "<": "c", "{": "c", "*": "aeiou", "#": "aeiou", "%": "aeiou", "€": "e", "£": "l", "¡": "i", "¢": "c",
}
MARKS = ".-_~*'’·,/\\"  # signs that part letters
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_SIZE = 28  # letters, the border of a word, anything else
_BORDER, _ELSE = 26, 27
_KEEP, _SWAP, _DROP, _DOUBLE, _RARE = np.log(0.9), np.log(0.09), np.log(0.3), np.log(0.5), np.log(0.001)
_PREFIX = 5
_SALTS = mixed(np.arange(101, 104, dtype=np.uint64))
REMEMBERED = 200_000
SAMPLE = 10_000


def _char_table() -> np.ndarray:
    table = np.full(256, _ELSE, dtype=np.int64)
    for i in range(26):
        table[97 + i] = table[65 + i] = i
    return table


_CODE = _char_table()
_IS_LETTER = (_CODE < 26) | (np.arange(256) >= 128)
_IS_SIGN = np.isin(np.arange(256), [ord(c) for c in LOOKS_LIKE if ord(c) < 128])
_IS_MARK = np.isin(np.arange(256), [ord(c) for c in MARKS if ord(c) < 128])
_IS_DIGIT = (np.arange(256) >= 48) & (np.arange(256) < 58)
_LONG = sorted({c.encode() for c in [*LOOKS_LIKE, *MARKS] if ord(c) >= 128})  # signs and marks of several bytes
_SIGNS, _MARKS = {c.encode() for c in LOOKS_LIKE}, {c.encode() for c in MARKS}
_CHOICES = {c: [(x, _KEEP - np.log(len(likely)) - 0.1 * k) for k, x in enumerate(likely)] for c, likely in LOOKS_LIKE.items()}
# Bytes of a character by its first byte.
_CHAR_BYTES = np.select([np.arange(256) >= 0xF0, np.arange(256) >= 0xE0, np.arange(256) >= 0xC0], [4, 3, 2], 1)
# Second bytes of the punctuation of Latin-1 after C2.
_PUNCTUATION = np.isin(np.arange(256), [i for i in range(0x80, 0xC0) if i not in (0xAA, 0xB5, 0xBA)])
REMEMBERED_SIZE = 64  # longer words are decoded each time
_WINDOWS = range(3, 25)  # letters of the windows over parted letters

def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of (letter, letter, letter) over all words of all documents, with borders."""
    narrow = docs.select(F.col(f"`{text}`").cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE**3, dtype=np.int64)
        for batch in batches:
            for _, _, raw, starts in chunks(batch.column(0)):
                core = np.concatenate([[_BORDER, _BORDER], np.where(_IS_LETTER[raw], _CODE[raw], _BORDER), [_BORDER]])
                border = np.zeros(len(raw) + 1, dtype=bool)
                border[starts] = True
                # Texts meet at a border too: words at their ends rarely touch, and one trigram in a text does not count.
                total += np.bincount(core[:-2] * _SIZE**2 + core[1:-1] * _SIZE + core[2:], minlength=_SIZE**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["gram", "n"])

    added = narrow.mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(_SIZE**3, dtype=np.int64)
    out[added["gram"].to_numpy()] = added["n"].to_numpy()
    return out.reshape(_SIZE, _SIZE, _SIZE)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log odds of a letter after two others: trigrams backed by bigrams, single letters and a floor."""
    tri = counts.astype(np.float64)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1) / (uni.sum() + _SIZE)
    p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
    p3 = (tri + 5 * p2) / (tri.sum(axis=2, keepdims=True) + 5)
    return np.log(p3)


class Restorer:
    """Decodes disguised words; remembers the last ones."""

    def __init__(self, log_odds: np.ndarray):
        self.log_odds = log_odds.tolist()
        self.known: dict[tuple[str, bool], str] = {}

    def __getstate__(self):
        return {"log_odds": self.log_odds, "known": {}}

    def word(self, shown: str) -> str:
        return self._remembered(shown, False)

    def parted(self, shown: str) -> list[str]:
        """The words of a run of letters with blanks between them: borders of words are part of the lattice."""
        return self._remembered(shown, True).split()

    def _remembered(self, shown: str, borders: bool) -> str:
        if len(shown) > REMEMBERED_SIZE:
            return self._decoded(shown.lower(), borders)
        found = self.known.get((shown, borders))
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[shown, borders] = self._decoded(shown.lower(), borders)
        return found

    def _decoded(self, shown: str, borders: bool) -> str:
        """The likeliest letters: states of the lattice are the last two letters taken, each with the way it came."""
        odds = self.log_odds
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(_BORDER, _BORDER): (0.0, None)}
        marks = sum(c in MARKS for c in shown)
        letters = sum(c.isalpha() or c in LOOKS_LIKE for c in shown)
        apart = marks and marks >= (letters - marks) - 1
        for i, c in enumerate(shown):
            if c.isspace():
                if borders:
                    ended: dict[tuple[int, int], tuple[float, tuple | None]] = {}
                    for (a, b), (score, way) in states.items():
                        value = score + odds[a][b][_BORDER]
                        if b != _BORDER and ((b, _BORDER) not in ended or value > ended[b, _BORDER][0]):
                            ended[b, _BORDER] = (value, (way, " "))
                    for state, own in ended.items():
                        if state not in states or own[0] > states[state][0]:
                            states[state] = own
                continue
            if c in MARKS and (apart or c not in LOOKS_LIKE):
                continue
            choices = [(c, _KEEP)] if c.isalpha() else _CHOICES.get(c, [])
            repeat = i > 0 and shown[i - 1] == c
            drawn = repeat and (shown[i - 2 : i - 1] == c or shown[i + 1 : i + 2] == c)
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, way) in states.items():
                for x, channel in choices:
                    code = _CODE[ord(x)] if ord(x) < 128 else _ELSE
                    value = score + odds[a][b][code] + channel + (_DOUBLE if drawn else 0.0)
                    state = (b, int(code))
                    if state not in after or value > after[state][0]:
                        after[state] = (value, (way, x))
                if repeat or not choices:  # a drawn-out letter, or a sign that stands for nothing
                    value = score + (_DROP if drawn or not choices else _RARE)
                    if (a, b) not in after or value > after[a, b][0]:
                        after[a, b] = (value, way)
            states = after
        (_, way) = max(states.items(), key=lambda s: (s[1][0] + odds[s[0][0]][s[0][1]][_BORDER], s[0]))[1]
        out = []
        while way is not None:
            way, x = way
            out.append(x)
        return "".join(reversed(out))


def _kinds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes belong to letters and to signs that look like letters; where such signs and marks begin."""
    letter, sign, mark = _IS_LETTER[raw], _IS_SIGN[raw], _IS_MARK[raw]
    body = sign.copy()
    if len(raw) > 1:
        after = np.append(raw[1:], 0)
        latin = np.flatnonzero((raw == 0xC2) & _PUNCTUATION[after])
        general = np.flatnonzero((raw == 0xE2) & ((after == 0x80) | (after == 0x81)) | (raw == 0xE3) & (after == 0x80))
        for at, size in ((latin, 2), (general, 3)):
            for k in range(size):
                letter[at + k] = False
        for c in _LONG:
            at = np.flatnonzero(raw[: max(len(raw) - len(c) + 1, 0)] == c[0])
            for k in range(1, len(c)):
                at = at[raw[at + k] == c[k]]
            sign[at] |= c in _SIGNS
            mark[at] |= c in _MARKS
            for k in range(len(c)):
                letter[at + k] = False
                body[at + k] |= c in _SIGNS
    return letter, body, sign, mark


def _cores(core: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without signs around them; a word of nothing else stays whole."""
    inside = np.flatnonzero(core)
    if len(inside) == 0:
        return begin, end
    first, last = np.searchsorted(inside, begin), np.searchsorted(inside, end) - 1
    some = first <= last
    return np.where(some, inside[np.minimum(first, len(inside) - 1)], begin), np.where(some, inside[np.maximum(last, 0)] + 1, end)


def _widened(body: np.ndarray, b: np.ndarray, e: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with the signs next to them that may stand for letters."""
    plain = np.flatnonzero(~body)
    before = np.concatenate([[-1], plain])[np.searchsorted(plain, b)] + 1
    after = np.append(plain, len(body))[np.searchsorted(plain, e)]
    return np.minimum(np.maximum(before, begin), b), np.maximum(np.minimum(after, end), e)


def disguised(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, text: np.ndarray) -> list[tuple[int, str]]:
    """(text, shown word) of every word that may be disguised; parted letters come as one word with blanks."""
    if len(begin) == 0:
        return []
    letter, body, sign, mark = _kinds(raw)
    core = letter | _IS_DIGIT[raw]
    b, e = _cores(core, begin, end)
    size = len(raw)

    def sums(marked: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(marked)])

    letter_sums, sign_sums, mark_sums = sums(letter), sums(sign), sums(mark)
    thrice = np.zeros(size, dtype=bool)
    low = np.where((raw >= 65) & (raw < 91), raw + 32, raw)
    if size > 2:
        thrice[2:] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & _IS_LETTER[raw[2:]] & (low[2:] < 128)
    thrice_sums = sums(thrice)

    def odd(b: np.ndarray, e: np.ndarray) -> np.ndarray:
        letters, signs, marks = letter_sums[e] - letter_sums[b], sign_sums[e] - sign_sums[b], mark_sums[e] - mark_sums[b]
        drawn = (thrice_sums[e] - thrice_sums[np.minimum(b + 2, e)]) > 0
        parted = (marks >= 2) & (letters + signs >= 3) & (marks >= letters + signs - 2) & (letters > 0)
        return ((signs > 0) & (letters > 0)) | drawn | parted

    out: list[tuple[int, str]] = []

    def add(which: np.ndarray, b: np.ndarray, e: np.ndarray) -> None:
        out.extend((t, bytes(raw[i:j]).decode("utf-8", "replace")) for t, i, j in zip(text[which].tolist(), b[which].tolist(), e[which].tolist(), strict=True))

    add(odd(b, e), b, e)
    # The signs around a word may hide letters too.
    wide_b, wide_e = _widened(body, b, e, begin, end)
    add(((wide_b < b) | (wide_e > e)) & odd(wide_b, wide_e), wide_b, wide_e)
    # Runs of single letters or look-alikes, whatever stands around each.
    one = (e - b == _CHAR_BYTES[raw[b]]) & (letter[b] | sign[b])
    step = np.diff(np.concatenate([[False], one, [False]]).astype(np.int8))
    for i, j in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
        while j - i >= 3:
            stop = i + int(np.searchsorted(text[i:j], text[i], side="right"))
            if stop - i >= 3:
                out.append((int(text[i]), " ".join(bytes(raw[b[k] : e[k]]).decode("utf-8", "replace") for k in range(i, stop))))
            i = stop
    return out


def toxicity_features(restorer: Restorer):
    """Features of texts: their words and restored words, and the beginnings of longer ones."""

    def features(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, end, text = words(raw, starts)
        if len(begin) == 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        letter, _, _, _ = _kinds(raw)
        b, e = _cores(letter | _IS_DIGIT[raw], begin, end)
        texts, found = _word_features(raw, b, e, text)
        for more in _restored_features(restorer, disguised(raw, begin, end, text)):
            texts, found = texts + more[0], found + more[1]
        return per_text(np.concatenate(texts), folded(mixed(np.concatenate(found))))

    return features


def _restored_features(restorer: Restorer, hidden: list[tuple[int, str]]) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """Features of the words restored, and of all windows of the letters of a run, wherever its words begin and end."""
    words_of: list[tuple[int, bytes]] = []
    runs_of: list[tuple[int, bytes]] = []
    for t, shown in hidden:
        words_of.append((t, restorer.word(shown).encode("utf-8")))
        if " " in shown:
            own = [w.encode("utf-8") for w in restorer.parted(shown)]
            words_of.extend((t, w) for w in own)
            runs_of.append((t, b"".join(own)))
    for held, windows in ((words_of, False), (runs_of, True)):
        held = [(t, w) for t, w in held if w]
        if not held:
            continue
        raw = np.frombuffer(b"".join(w for _, w in held), dtype=np.uint8)
        text, stop = np.array([t for t, _ in held]), np.cumsum([len(w) for _, w in held])
        if not windows:
            yield _word_features(raw, stop - np.diff(stop, prepend=0), stop, text)
            continue
        hasher = Hasher(raw)
        first = np.flatnonzero((raw & 0xC0) != 0x80)  # where characters begin
        owner = np.searchsorted(stop, first, side="right")
        edge = np.append(first, len(raw))
        for n in _WINDOWS:
            at = np.arange(max(len(first) - n + 1, 0))
            at = at[owner[at] == owner[at + n - 1]]
            yield [text[owner[at]]], [hasher.of(edge[at], edge[at + n]) ^ _SALTS[0]]


def _word_features(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, text: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    hasher = Hasher(raw)
    long = end - begin > _PREFIX
    return [text, text[long]], [hasher.of(begin, end) ^ _SALTS[0], hasher.of(begin[long], begin[long] + _PREFIX) ^ _SALTS[1]]


def toxicity_scores(
    docs: DataFrame, train_docs: DataFrame, labels: DataFrame, usable: Column, keep: Sequence[str] = ("doc_id",), label: str = "toxic", text: str = "text"
) -> DataFrame:
    """``keep`` and ``score`` (0 to 1, higher: label 1 likelier) of every row of ``docs``; letters are counted over ``train_docs``."""
    features = toxicity_features(Restorer(language_model(trigram_counts(train_docs, text))))
    return scored(docs, fitted(train_docs, labels, label, usable, features, text=text, sample=SAMPLE), features, keep, text)

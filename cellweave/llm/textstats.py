"""Per-document counts that the quality classifier and the quality rules share."""

from __future__ import annotations

import numpy as np

from . import bytespans as B

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = LETTER[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
MARK = np.zeros(256, bool)  # other ASCII punctuation
MARK[33:48] = MARK[58:65] = MARK[91:97] = MARK[123:127] = True
VOWEL = np.zeros(256, bool)
VOWEL[list(b"aeiouAEIOU")] = True
FIRST = np.ones(256, bool)  # bytes that begin a code point
FIRST[0x80:0xC0] = False

#: Byte classes of the character histogram; classes 0 to 9.
CLASS_NAMES = ("vowel", "consonant", "upper", "beyond_ascii", "digit", "space", "line_break", "mark", "symbol", "control")
CLASS = np.full(256, 9, np.int64)
CLASS[97:123] = 1
CLASS[list(b"aeiou")] = 0
CLASS[UPPER] = 2
CLASS[128:] = 3
CLASS[DIGIT] = 4
CLASS[[9, 11, 12, 13, 32]] = 5
CLASS[10] = 6
CLASS[MARK] = 7
CLASS[SYMBOLS] = 8
N_CLASSES = len(CLASS_NAMES)


def class_counts(texts: B.Texts, data: np.ndarray | None = None) -> np.ndarray:
    """Bytes of each class per text."""
    data = texts.data if data is None else data
    doc = B.owner(texts.offs)
    return np.bincount(doc * N_CLASSES + CLASS[data], minlength=texts.n * N_CLASSES).reshape(-1, N_CLASSES)


class Counts:
    """Word, line and repetition counts of a batch of texts; words are runs of non-blank bytes."""

    def __init__(self, column, window: int = 8) -> None:
        texts = self.texts = B.Texts(column)
        data = texts.data
        spans = B.SpanHash(B.BYTE_CODE[data])
        inside = B.NOT_BLANK[data]
        self.starts, self.ends, self.at = texts.runs(inside)
        self.words = spans.of(self.starts, self.ends)
        self.doc = B.owner(self.at)
        self.n_words = np.diff(self.at)
        self.word_chars = texts.per_text(inside & FIRST[data])
        self.n_symbols = texts.per_text(SYMBOLS[data])

        line_start, line_end, line_doc = texts.lines()
        held = np.searchsorted(self.starts, line_end) > np.searchsorted(self.starts, line_start)
        line_start, line_end, line_doc = line_start[held], line_end[held], line_doc[held]
        _, later = B.repeated(line_doc, spans.of(line_start, line_end))
        self.n_lines = np.bincount(line_doc, minlength=texts.n)
        self.n_dup_lines = np.bincount(line_doc[later], minlength=texts.n)

        n = len(self.words)
        first = np.flatnonzero(self.at[self.doc + 1] - np.arange(n) >= window)
        sums = B.SpanHash(self.words)
        again, _ = B.repeated(self.doc[first], sums.of(first, first + window))
        self.in_repeat = B.covered(n, first[again], window)
        self.n_repeat_words = np.bincount(self.doc[self.in_repeat], minlength=texts.n)

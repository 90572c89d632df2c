"""Counts that quality operators take from whole texts, for many texts at once."""

from __future__ import annotations

import numpy as np

from folia.llm.words import SPACED, Words, mixed, run_hashes

#: Kinds of bytes: other, lower, upper, digit, symbol, exclamation, sentence mark, other mark, beyond ASCII, white space.
OTHER, LOW, UP, DIGIT, SYMBOL, SHOUT, STOP, MARK, WIDE, SPACE = range(10)
SYMBOLS = b"#*$%&|<>"


def _kind(b: int) -> int:
    c = bytes([b])
    if b >= 0x80:
        return WIDE
    if b == 0x20 or 0x09 <= b <= 0x0D:
        return SPACE
    if c in SYMBOLS:
        return SYMBOL
    if c == b"!":
        return SHOUT
    if c in b".,;:?":
        return STOP
    if c.isdigit():
        return DIGIT
    if c.isalpha():
        return LOW if c.islower() else UP
    return MARK if 0x21 <= b <= 0x7E else OTHER


KIND = np.array([_kind(b) for b in range(256)], dtype=np.int64)
KINDS = 10


class Signals:
    """Of each text: words, repeats, kinds of bytes; of each line: the same kinds, words, and whether it is a copy."""

    def __init__(self, texts: list[str | None]) -> None:
        self.words = w = Words(texts, SPACED)
        n = len(texts)
        self.n_words = np.diff(w.first)
        self.kinds = KIND[w.data]
        # a continuation byte belongs to the character before it
        head = (w.data & 0xC0) != 0x80
        self.word_chars = self._per_text(w.inside & head)
        self.n_symbols = self._per_text(self.kinds == SYMBOL)
        self.n_repeat_words = self._repeats()
        # lines: the line feed after a text ends its last line
        self.line_ends = np.flatnonzero(w.data == 10)
        self.line_starts = np.concatenate([[0], self.line_ends[:-1] + 1]) if len(self.line_ends) else self.line_ends
        self.line_text = np.searchsorted(w.offsets, self.line_starts, side="right") - 1
        self.line_first = np.searchsorted(self.line_text, np.arange(n + 1))
        number = np.repeat(np.arange(len(self.line_ends)), self.line_ends - self.line_starts + 1)
        counts = np.bincount(number * KINDS + self.kinds, minlength=len(self.line_ends) * KINDS).reshape(-1, KINDS)
        counts[:, SPACE] -= 1
        self.line_kinds = counts
        self.line_words = np.searchsorted(w.starts, self.line_ends) - np.searchsorted(w.starts, self.line_starts)
        self.line_copy = self._copies(texts)
        self.n_dup_lines = np.bincount(self.line_text[self.line_copy], minlength=n)

    def _per_text(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[self.words.offsets[1:]] - total[self.words.offsets[:-1]]

    def _copies(self, texts: list[str | None]) -> np.ndarray:
        """Lines with a word that equal an earlier line of their text."""
        copy = np.zeros(len(self.line_ends), dtype=bool)
        at = 0
        for text in texts:
            lines = (text or "").split("\n")
            if len(set(lines)) < len(lines):
                seen: set[str] = set()
                for i, line in enumerate(lines, at):
                    copy[i] = line in seen
                    seen.add(line)
            at += len(lines)
        return copy & (self.line_words > 0)

    def _repeats(self) -> np.ndarray:
        """Words of each text inside three-word windows that it has twice or more."""
        w = self.words
        text = w.text_of_words()
        runs = run_hashes(w.hashes, 3)
        if not len(runs):
            return np.zeros(len(self.n_words), dtype=np.int64)
        place = np.flatnonzero(text[:-2] == text[2:])
        keyed = runs[place] ^ mixed(text[place].astype(np.uint64) + np.uint64(1))
        order = np.argsort(keyed)
        same = keyed[order][1:] == keyed[order][:-1]
        again = np.zeros(len(place), dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        covered = np.zeros(len(text), dtype=bool)
        for j in range(3):
            covered[place[again] + j] = True
        return np.bincount(text[covered], minlength=len(self.n_words))

    def text_kinds(self) -> np.ndarray:
        """Bytes of each kind per text, without the line feed that ends it."""
        total = np.zeros((len(self.n_words), KINDS), dtype=np.int64)
        np.add.at(total, self.line_text, self.line_kinds)
        return total

"""Words of many texts as arrays: byte positions and 64-bit hashes, in bounded memory per byte of text.

The texts of a batch are laid out in one buffer, each ended by a line feed, which is no word byte of either
alphabet.  A word's hash depends on its bytes alone, not on its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: Bytes hashed at a time; a longer word is still hashed whole.
PIECE = 1 << 19
#: Bytes of text that one batch of arrays is made from.
BATCH_BYTES = 1 << 21


def byte_table(is_member) -> np.ndarray:
    return np.array([bool(is_member(b)) for b in range(256)])


#: Everything but the six ASCII white-space characters.
SPACED = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: ASCII letters and digits in lower case, and every character beyond ASCII.
PLAIN = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        for name, value in (("up", BASE), ("down", INVERSE)):
            steps = np.full(n, value, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of ``texts``: ``starts`` and ``ends`` in ``data``, ``hashes``, and ``first[i]:first[i + 1]`` per text."""

    def __init__(self, texts: list[str | None], alphabet: np.ndarray, lower: bool = False) -> None:
        encoded = [(t or "").encode("utf-8", "replace") for t in texts]
        self.data = np.frombuffer(b"\n".join([*encoded, b""]), dtype=np.uint8)
        if lower:
            self.data = LOWER[self.data]
        sizes = np.array([len(e) + 1 for e in encoded], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.inside = alphabet[self.data]
        edge = np.diff(self.inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), dtype=np.uint64)
        done = 0
        while done < len(self.starts):
            base = self.starts[done]
            until = max(int(np.searchsorted(self.ends, base + PIECE, side="right")), done + 1)
            piece = self.data[base : self.ends[until - 1]].astype(np.uint64)
            up, down = powers(max(len(piece) + 1, PIECE + 1))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((piece + np.uint64(1)) * up[: len(piece)], dtype=np.uint64)])
            s, e = self.starts[done:until] - base, self.ends[done:until] - base
            out[done:until] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            done = until
        return out

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def text_of_words(self) -> np.ndarray:
        """Number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` neighbouring words, ``len(hashes) - k + 1`` of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total = total * np.uint64(0xD1342543DE82EF95) + hashes[j : j + n]
    return mixed(total)


def parts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The rows of ``batches`` in order, cut so that a part holds about ``BATCH_BYTES`` of ``column`` or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64)) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                rows = batch.slice(int(a), int(b - a))
                yield rows, rows.column(column).to_pylist()


def record(fields: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in fields.values()], list(fields))

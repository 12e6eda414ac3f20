"""Letter words: maximal runs of Unicode letters, lower-cased, as arrays of code points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestar.llm.blocks import _POWERS, mix

_TABLES: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, lower-case code point) of each code point; letters whose lower case is several characters keep themselves."""
    if not _TABLES:
        letter = np.zeros(0x110000, bool)
        lower = np.arange(0x110000, dtype=np.uint32)
        for i in [*range(0xD800), *range(0xE000, 0x110000)]:
            c = chr(i)
            if c.isalpha():
                letter[i] = True
                low = c.lower()
                if len(low) == 1:
                    lower[i] = ord(low)
        _TABLES.extend((letter, lower))
    return _TABLES[0], _TABLES[1]


class LetterWords:
    """Letter words of an Arrow string column: ``first[i]:first[i + 1]`` are those of row i, and
    ``points[start[w]:end[w]]`` the lower-cased code points of word w. Null rows have none.
    ``raw`` are all code points as they stand, rows separated by a line feed."""

    def __init__(self, column: pa.Array) -> None:
        column = pc.fill_null(column.cast(pa.large_string()), "")
        lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        self.raw = np.frombuffer("\n".join([*column.to_pylist(), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.offset = np.concatenate([[0], np.cumsum(lengths + 1)])
        letter, lower = tables()
        self.points = lower[self.raw]
        inside = np.concatenate([[False], letter[self.raw], [False]])
        change = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = change[::2], change[1::2]
        self.first = np.searchsorted(self.start, self.offset)

    def __len__(self) -> int:
        return len(self.offset) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts)

    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "_kept"):
            up, down = _POWERS.upto(len(self.points) + 1)
            total = np.zeros(len(self.points) + 1, np.uint64)
            np.cumsum((self.points.astype(np.uint64) + np.uint64(1)) * up[: len(self.points)], out=total[1:])
            self._kept = (total, down)
        return self._kept

    def hashes(self, most: int | None = None) -> np.ndarray:
        """Hash of each word, or of its first ``most`` letters (0 for words that are not longer)."""
        total, down = self._sums()
        end = self.end if most is None else np.minimum(self.start + most, self.end)
        h = mix((total[end] - total[self.start]) * down[self.start] + np.uint64(0 if most is None else most))
        if most is not None:
            h[self.end - self.start <= most] = 0
        return h

    def text(self, w: int) -> str:
        return self.points[self.start[w] : self.end[w]].tobytes().decode("utf-32-le")


def term_hash(term: str, prefix: bool) -> int:
    """The hash that :meth:`LetterWords.hashes` gives to the word, or to words that start with the prefix."""
    words = LetterWords(pa.array([term + ("a" if prefix else "")]))
    return int(words.hashes(len(term) if prefix else None)[0])

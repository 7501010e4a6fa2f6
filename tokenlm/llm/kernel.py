"""Numpy kernels over Arrow string columns: words, spans and hashes without a Python object per word.

A column's bytes lie in one buffer. Words and lines are byte ranges in it, found by table look-ups and
differences. A range's 64-bit hash is the sum of its eights of bytes, each mixed with its place, mixed again with the
length: no sum of powers, so that words of a regular build don't share a hash. Where a result rests on equality, ranges of
one hash are compared byte by byte (equal). Work goes slice by slice, so memory is bounded by the slice or one long text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

U = np.uint64
#: Text bytes of a slice, except that a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
_STEP = U(0x9E3779B97F4A7C15)
#: Of the last eight bytes of a range, those that are in it.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)

#: Byte classes: white space of the words contract, and letters, digits and bytes of other scripts.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACES
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits of x."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(29)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(32)
    return x


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about limit bytes together."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(text))
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0)).astype(np.int64)
    total, at = np.concatenate([[0], np.cumsum(size)]), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Texts:
    """The bytes of a string column. data: all of them; starts, ends: of each text. Nulls are empty."""

    def __init__(self, col: pa.Array, lower: bool = False):
        col = pa.compute.fill_null(col, "").cast(pa.large_string())
        n = len(col)
        at = np.frombuffer(col.buffers()[1], np.int64, n + 1, 8 * col.offset) if n else np.zeros(1, np.int64)
        raw = col.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.data = LOWER[data] if lower else data
        self.starts, self.ends, self.n = at[:-1] - at[0], at[1:] - at[0], n
        self._eights: np.ndarray | None = None

    def bounds(self) -> np.ndarray:
        return np.append(self.starts, self.ends[-1:] if self.n else 0)

    def count(self, mask: np.ndarray) -> np.ndarray:
        """How often a mask over the bytes holds in each text."""
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return c[self.ends] - c[self.starts]

    def runs(self, members: np.ndarray) -> Spans:
        """Longest runs of bytes of a class within a text."""
        inside = members[self.data]
        before = np.empty_like(inside)
        before[1:], before[:1] = inside[:-1], False
        before[self.starts[self.starts < len(inside)]] = False
        after = np.empty_like(inside)
        after[:-1], after[-1:] = inside[1:], False
        last = self.ends[self.ends > self.starts] - 1
        after[last] = False
        return Spans(self, np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1)

    def lines(self) -> Spans:
        """Pieces between line feeds; a text of k line feeds has k + 1."""
        feeds = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.starts, feeds + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.ends, feeds]), kind="stable")
        out = Spans(self, starts, ends)
        out.doc = np.sort(np.concatenate([np.arange(self.n), np.searchsorted(self.ends, feeds, "right")]), kind="stable")
        return out

    def eights(self) -> np.ndarray:
        """Of each byte, it and the seven after it as one number; zeros follow the last one."""
        if self._eights is None:
            held = np.concatenate([self.data, np.zeros(8, np.uint8)])
            self._eights = np.ndarray(len(self.data) + 1, "<u8", held, strides=(1,))
        return self._eights


class Spans:
    """Byte ranges in order, each within one text."""

    def __init__(self, texts: Texts, starts: np.ndarray, ends: np.ndarray):
        self.texts, self.starts, self.ends = texts, starts, ends
        self.doc = np.searchsorted(texts.ends, starts, "right")

    def __len__(self) -> int:
        return len(self.starts)

    def per_text(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.texts.n)

    def hashes(self) -> np.ndarray:
        size = self.ends - self.starts
        n = (size + 7) >> 3
        stop = np.cumsum(n)
        k = np.arange(stop[-1] if len(n) else 0) - np.repeat(stop - n, n)
        at = np.repeat(self.starts, n) + 8 * k
        x = self.texts.eights()[at] & _MASKS[np.minimum(np.repeat(self.ends, n) - at, 8)]
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(mix(x) + _STEP * (k + 1).astype(U)), dtype=U)])
        return mix(sums[stop] - sums[stop - n] + _STEP * size.astype(U))

    def count(self, mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return c[self.ends] - c[self.starts]

    def contain(self, mask: np.ndarray) -> np.ndarray:
        return self.count(mask) > 0


def ranges(data: np.ndarray, cuts: np.ndarray) -> Spans:
    """Spans of bytes that lie one after the other, cut at these places."""
    texts = Texts(pa.array([], pa.string()))
    texts.data, texts.starts, texts.ends, texts.n = data, cuts[:-1], cuts[1:], len(cuts) - 1
    return Spans(texts, texts.starts, texts.ends)


def windows(doc: np.ndarray, size: int) -> np.ndarray:
    """Places where size entries in a row are of one text."""
    if len(doc) < size:
        return np.zeros(0, np.int64)
    return np.flatnonzero(doc[: len(doc) - size + 1] == doc[size - 1 :])


def ngrams(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of size entries in a row, from each place in at."""
    out = np.full(len(at), U(size))
    for i in range(size):
        out = out * _STEP + h[at + i]
        out ^= out >> U(31)
    return mix(out)


def equal(a: Spans, i: np.ndarray, b: Spans, j: np.ndarray) -> np.ndarray:
    """Whether entries i of a hold the same bytes as entries j of b."""
    start, other, size = a.starts[i], b.starts[j], a.ends[i] - a.starts[i]
    out = size == b.ends[j] - other
    n = np.where(out, (size + 7) >> 3, 0)
    own = np.repeat(np.arange(len(n)), n)
    k = 8 * (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n))
    differ = (a.texts.eights()[start[own] + k] ^ b.texts.eights()[other[own] + k]) & _MASKS[np.minimum(size[own] - k, 8)]
    out[own[differ != 0]] = False
    return out


def repeated(doc: np.ndarray, h: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For entries in order: whether an equal one is in the same text, and whether an earlier one is.

    same says whether entries i equal entries j; only those of one hash are asked about.
    """
    key = mix(h ^ mix(doc.astype(U) + U(1)))
    while True:
        order = np.argsort(key, kind="stable")
        k = key[order]
        alike = np.flatnonzero(k[1:] == k[:-1])
        i, j = order[alike], order[alike + 1]
        wrong = (doc[i] != doc[j]) | ~same(i, j)
        if not wrong.any():
            break
        for one in np.unique(k[alike[wrong]]):  # unequal entries of one hash get hashes of their own
            firsts: list[int] = []
            for m in np.flatnonzero(key == one):
                r = next((r for r, f in enumerate(firsts) if doc[f] == doc[m] and same(np.array([f]), np.array([m]))[0]), len(firsts))
                firsts += [m] * (r == len(firsts))
                key[m] = mix(key[m : m + 1] + _STEP * np.full(1, r, U))[0] if r else one
    again = np.zeros(len(k) + 1, bool)
    again[1:-1] = k[1:] == k[:-1]
    twice, later = np.empty(len(k), bool), np.empty(len(k), bool)
    twice[order], later[order] = again[1:] | again[:-1], again[:-1]
    return twice, later


def text_list(col: pa.Array) -> list[str]:
    return ["" if t is None else t for t in col.to_pylist()]

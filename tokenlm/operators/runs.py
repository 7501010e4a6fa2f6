"""Counts before each position, and entropy by them, where a shuffled row per position would be many times larger than the texts.

Documents in their order are cut into runs of about RUN tokens. What a position meets is what earlier runs hold, the same for
all positions of a run, and what its own run holds before it. So only the distinct trigrams of a run, with their counts,
go to the task of their middle token, as one compressed cell for each bucket of middle tokens. It sums over earlier runs
and sends as compact a cell back. Single tokens follow from the bigrams that are new, by rows of run and token.
Counting within a run needs no shuffle.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenlm.operators.packed import RUN, _packed, _unpacked
from tokenlm.operators.tokens import PATTERN
from tokenlm.sources.shared import bounded, shuffles_end, tidy, written

Batches = Iterator[pa.RecordBatch]
_ONE = "id long, first long, bucket int, cell binary, corpus string, token string, n long, followers long, c long"
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
_NAMES = [c.split()[0] for c in _ONE.split(", ")]
_COUNTS = "corpus string, g long, n int, ngram string, c long, total long, followers long, kn long, kn_total long"
#: Positions whose rows go out at once.
SLICE = 1 << 14


def _small(x: np.ndarray) -> pa.Array:
    """The numbers, not negative, in as few bytes as the largest needs."""
    most = int(x.max(initial=0))
    return pa.array(x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.int64))


def _closed(columns: dict[str, pa.Array]) -> bytes:
    """A cell, with the first bytes of wide numbers before their second ones, and so on: alike bytes beside each other take less room."""
    out = {}
    for name, x in columns.items():
        if pa.types.is_integer(x.type) and x.type.bit_width > 8:
            wide = np.ascontiguousarray(np.asarray(x))
            name, x = f"{name}/{wide.dtype.str}", pa.array(wide.view(np.uint8).reshape(len(wide), -1).T.ravel())
        out[name] = x
    return _packed(out)


def _opened(cell: bytes) -> dict[str, pa.Array]:
    out = {}
    for name, x in _unpacked(cell).items():
        name, _, kind = name.partition("/")
        if kind:
            bytes_ = np.asarray(x).reshape(np.dtype(kind).itemsize, -1)
            x = pa.array(np.ascontiguousarray(bytes_.T).view(kind).ravel())
        out[name] = x
    return out


def _ints(cell: dict[str, pa.Array], *names: str) -> list[np.ndarray]:
    return [np.asarray(cell[n]).astype(np.int64) for n in names]


def _joined(words: pa.Array) -> pa.Array:
    """Tokens, which hold no blank, as one text: their offsets would take as much room again."""
    return pa.array([" ".join(words.to_pylist())])


def _split(text: pa.Array) -> pa.Array:
    return pa.array(text[0].as_py().split(" "), pa.string())


def _steps(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rising numbers in groups of these sizes, each but a group's first less the one before it."""
    out, starts = np.diff(x, prepend=0), np.cumsum(size) - size
    out[starts] = x[starts]
    return out


def _risen(steps: np.ndarray, size: np.ndarray) -> np.ndarray:
    sums, starts = np.cumsum(steps), np.cumsum(size) - size
    return sums - np.repeat(sums[starts] - steps[starts], size)


def _rows(**columns) -> pa.RecordBatch:
    """Rows of _ONE; a column that isn't named is null."""
    n = max(len(c) for c in columns.values())
    return pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(k) if (c := columns.get(name)) is not None else pa.nulls(n, k) for name, k in zip(_NAMES, _KINDS, strict=True)], _NAMES)


def _before(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sums of the values over earlier rows of the same key. Keys are not negative."""
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1) != 0)
    length = np.diff(np.append(first, len(key)))
    out = []
    for v in values:
        v = v.astype(np.int64)[order]
        sums = np.cumsum(v) - v
        one = np.empty(len(key), np.int64)
        one[order] = sums - np.repeat(sums[first], length)
        out.append(one)
    return out


def _sums(key: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(key, value, n).astype(np.int64)


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int32)


def _by_bucket(bucket: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Places of each bucket's entries, in order."""
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.searchsorted(bucket[order], np.arange(1, buckets)))


class _Tokens:
    """A run as it is written. code: each token's place in words, which are in order; q: its corpus' place in names; place: from 0 in its document."""

    def __init__(self, cell: bytes):
        c = _opened(cell)
        self.names, words = c["names"], _split(c["words"])
        order = pc.sort_indices(words)
        self.words, self.v = words.take(order), len(words)
        rank = np.empty(self.v, np.int64)
        rank[np.asarray(order)] = np.arange(self.v)
        corpus, sizes = _ints(c, "corpus", "sizes")
        self.code = rank[np.asarray(c["code"])]
        self.q = np.repeat(corpus, sizes)
        self.place = (np.arange(len(self.code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)


class _Grams(_Tokens):
    """Its trigrams in the order of corpus, middle, first and last token. A second token's first is code v, no token.

    groups: corpus and middle token; contexts: and the first; grams: and the last; pairs: group and last token.
    ctx, gram: of each position of at."""

    def __init__(self, cell: bytes):
        super().__init__(cell)
        v = self.v
        self.at = np.flatnonzero(self.place >= 1)
        self.far = self.place[self.at] >= 2
        first = np.where(self.far, self.code[self.at - 2], v)
        contexts, ctx = np.unique((self.q[self.at] * v + self.code[self.at - 1]) * (v + 1) + first, return_inverse=True)
        del first
        grams, gram, self.count = np.unique(ctx * v + self.code[self.at], return_inverse=True, return_counts=True)
        self.ctx, self.gram = ctx.astype(np.int32), gram.astype(np.int32)
        del ctx, gram
        self.token, self.gram_ctx = grams % max(1, v), grams // max(1, v)
        self.first = contexts % (v + 1)
        self.groups, self.ctx_group = np.unique(contexts // (v + 1), return_inverse=True)
        self.pairs, gram_pair = np.unique(self.ctx_group[self.gram_ctx] * v + self.token, return_inverse=True)
        self.gram_pair = gram_pair.astype(np.int32)

    def parts(self, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each bucket: places of its groups, contexts, grams and pairs."""
        v = max(1, self.v)
        h = np.array([zlib.crc32(w.encode()) for w in self.words.to_pylist()], np.uint64)
        names = np.array([zlib.crc32(c.encode()) for c in self.names.to_pylist()], np.uint64)
        mixed = (h[self.groups % v] * np.uint64(0x9E3779B97F4A7C15) + names[self.groups // v]) * np.uint64(0xFF51AFD7ED558CCD)
        own = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        of = (own, own[self.ctx_group], own[self.ctx_group[self.gram_ctx]], own[self.pairs // v])
        yield from zip(*(_by_bucket(x, buckets) for x in of), strict=True)

    def cells(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        v, spot = max(1, self.v), np.zeros(self.v + 1, np.int64)
        per_group, per_context = np.bincount(self.ctx_group, minlength=len(self.groups)), np.bincount(self.gram_ctx, minlength=len(self.first))
        for b, (groups, contexts, grams, _) in enumerate(self.parts(buckets)):
            if not len(groups):
                continue
            middle, first, last = self.groups[groups] % v, self.first[contexts], self.token[grams]
            used = np.unique(np.concatenate([middle, first[first < self.v], last]))
            spot[used] = np.arange(len(used))
            yield b, _closed({
                "names": self.names, "words": _joined(self.words.take(pa.array(used))), "corpus": _small(self.groups[groups] // v), "middle": _small(spot[middle]), "contexts": _small(per_group[groups]),
                "first": _small(_steps(np.where(first < self.v, spot[first], len(used)), per_group[groups])), "grams": _small(per_context[contexts]),
                "last": _small(_steps(spot[last], per_context[contexts])), "count": _small(self.count[grams]),
            })


def _cut(run: int, batches: Batches) -> Batches:
    """Runs of the documents of a task, which come in order."""
    from pyspark import TaskContext

    corpus, sizes, tokens, held, first = [], [], [], 0, None
    id_ = TaskContext.get().partitionId() << 32

    def flush() -> pa.RecordBatch:
        coded = pa.chunked_array(tokens).combine_chunks().dictionary_encode()
        names = list(dict.fromkeys(corpus))
        of = {c: i for i, c in enumerate(names)}
        code, order = np.asarray(coded.indices), np.argsort(-np.bincount(coded.indices, minlength=len(coded.dictionary)), kind="stable")
        rank = np.empty(len(order), np.int64)  # common tokens get small codes
        rank[order] = np.arange(len(order))
        cell = _closed({"names": pa.array(names, pa.string()), "words": _joined(coded.dictionary.take(pa.array(order))), "corpus": _small(np.array([of[c] for c in corpus], np.int64)), "sizes": _small(np.array(sizes, np.int64)), "code": _small(rank[code])})
        return _rows(id=[id_], first=[first], bucket=[-3], cell=[cell])

    for batch in batches:
        names, docs, lists = batch.columns
        lengths, at = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64), 0
        while at < len(lengths):
            to = at + 1 + min(len(lengths) - at - 1, int(np.searchsorted(np.cumsum(lengths[at:]), run - held)))
            first = docs[at].as_py() if first is None else first
            corpus += names.slice(at, to - at).to_pylist()
            sizes += lengths[at:to].tolist()
            tokens.append(lists.slice(at, to - at).flatten())
            held += int(lengths[at:to].sum())
            at = to
            if held >= run:
                yield flush()
                corpus, sizes, tokens, held, first = [], [], [], 0, None
                id_ += 1
    if held:
        yield flush()


def _each(batches: Batches) -> Iterator[tuple[int, int, int, bytes]]:
    for batch in batches:
        for id_, first, bucket, cell in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
            yield id_, first, bucket, cell.as_py()


def _to_buckets(buckets: int, batches: Batches) -> Batches:
    for id_, first, _, cell in _each(batches):
        for b, part in _Grams(cell).cells(buckets):
            yield _rows(id=[id_], first=[first], bucket=[b], cell=[part])


def _starts(batches: Batches) -> Batches:
    """Of each run, all tokens, how often each occurs (c) and how many documents begin with it (n)."""
    for id_, first, _, cell in _each(batches):
        t = _Tokens(cell)
        key, which, c = np.unique(t.q * t.v + t.code, return_inverse=True, return_counts=True)
        n = np.bincount(which, t.place == 0, len(key)).astype(np.int64)
        yield _rows(id=np.full(len(key), id_), first=np.full(len(key), first), corpus=t.names.take(pa.array(key // t.v)), token=t.words.take(pa.array(key % t.v)), n=n, c=c)


def _earlier_runs(full: bool, kept: list[tuple[int, int, int, bytes]]) -> Batches:
    """Of a bucket's cells: what earlier runs hold, a cell for each, and the tokens of bigrams that are new in a run.

    full: counts of bigrams and of their contexts too, instead of which bigrams are new."""
    kept = sorted(kept, key=lambda x: (x[1], x[0]))
    cells = [_opened(x[3]) for x in kept]
    for c in cells:
        c["words"] = _split(c["words"])
    words = pa.concat_arrays([c["words"] for c in cells]).dictionary_encode()
    names = pa.concat_arrays([c["names"] for c in cells]).dictionary_encode()
    word, name, v = *(np.asarray(x.indices).astype(np.int64) for x in (words, names)), len(words.dictionary)
    most = max(len(c["words"]) for c in cells)
    parts, at, name_at, group_at, ctx_at = [], 0, 0, 0, 0
    for c in cells:
        corpus, middle, contexts, first, grams, last, count = _ints(c, "corpus", "middle", "contexts", "first", "grams", "last", "count")
        own = word[at : at + len(c["words"])]
        group = name[name_at + corpus] * v + own[middle]
        first, last = _risen(first, contexts), _risen(last, grams)
        before = np.append(own, -1)[first] + 1
        one = (group_at + np.repeat(np.arange(len(contexts)), contexts), before, ctx_at + np.repeat(np.arange(len(grams)), grams), own[last], last, count)
        parts.append((group, *(x.astype(np.int32) for x in one)))
        at, name_at, group_at, ctx_at = at + len(c["words"]), name_at + len(c["names"]), group_at + len(group), ctx_at + len(first)
    sizes = np.array([[len(p[0]), len(p[1]), len(p[3])] for p in parts])
    del cells
    columns = list(zip(*parts, strict=True))
    del parts, one, before, first, last, grams, count, own
    group, ctx_group, first, gram_ctx, token, local, count = (np.concatenate(columns.pop(0)) for _ in range(7))
    corpus, group = group // v, _dense(group).astype(np.int64)
    ctx = _dense(group[ctx_group] * (v + 1) + first)
    far = first[gram_ctx] > 0
    del first
    (c3,) = _before(_dense(ctx[gram_ctx].astype(np.int64) * v + token), count)
    new3 = far & (c3 == 0)
    t3, f3 = _before(ctx, _sums(gram_ctx, count, len(ctx)), _sums(gram_ctx, new3, len(ctx)))
    del ctx
    # A cell's pairs, in the order of its own codes.
    pairs, which = np.unique(ctx_group[gram_ctx].astype(np.int64) * most + local, return_inverse=True)
    del local, gram_ctx, ctx_group
    pair_group, pair_token = pairs // most, np.zeros(len(pairs), np.int64)
    pair_token[which] = token
    kd = _sums(which, np.where(far, new3, count), len(pairs))
    kn2, c2 = _before(_dense(group[pair_group] * v + pair_token), kd, _sums(which, count, len(pairs)))
    new2 = c2 == 0
    own2 = _sums(which, count, len(pairs)) if full else kd
    del which, token, count, far, new3
    k2, f2, t2 = _before(group, *(_sums(pair_group, x, len(group)) for x in (kd, new2, own2)))
    ends = np.cumsum(sizes, 0)
    pair_ends = np.searchsorted(pair_group, ends[:, 0])
    g0 = x0 = t0 = p0 = 0
    for (id_, run_first, bucket, _), (g, x, t), p in zip(kept, ends.tolist(), pair_ends.tolist(), strict=True):
        more = {"c2": _small(c2[p0:p]), "t2": _small(t2[g0:g])} if full else {"new2": _small(new2[p0:p])}
        cell = _closed({"c3": _small(c3[t0:t]), "t3": _small(t3[x0:x]), "f3": _small(f3[x0:x]), "kn2": _small(kn2[p0:p]), "k2": _small(k2[g0:g]), "f2": _small(f2[g0:g])} | more)
        yield _rows(id=[id_], first=[run_first], bucket=[bucket], cell=[cell])
        new = p0 + np.flatnonzero(new2[p0:p])
        key, n = np.unique(corpus[pair_group[new]] * v + pair_token[new], return_counts=True)
        if len(key):
            yield _rows(id=np.full(len(key), id_), first=np.full(len(key), run_first), corpus=names.dictionary.take(pa.array(key // v)), token=words.dictionary.take(pa.array(key % v)), n=n)
        g0, x0, t0, p0 = g, x, t, p


def _buckets(full: bool, batches: Batches) -> Batches:
    bucket, kept = None, []
    for row in _each(batches):
        if row[2] != bucket and kept:
            yield from _earlier_runs(full, kept)
            kept = []
        bucket = row[2]
        kept.append(row)
    if kept:
        yield from _earlier_runs(full, kept)


def _returned(r: _Grams, returned: dict[int, bytes], buckets: int, of: dict[str, int]) -> dict[str, np.ndarray]:
    """What earlier runs hold of a run's groups (0), contexts (1), grams (2) or pairs (3)."""
    sizes = (len(r.groups), len(r.first), len(r.count), len(r.pairs))
    base = {k: np.zeros(sizes[i], np.int64) for k, i in of.items()}
    for b, places in enumerate(r.parts(buckets)):
        if len(places[0]):
            c = _opened(returned[b])
            for k, i in of.items():
                base[k][places[i]] = np.asarray(c[k])
    return base


def _held(r: _Tokens, rows: pa.Table, *columns: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each column, what earlier runs hold of each corpus and token, and of each corpus."""
    corpus = np.asarray(pc.index_in(rows["corpus"].combine_chunks(), r.names)).astype(np.int64)
    token = pc.index_in(rows["token"].combine_chunks(), r.words, skip_nulls=True)
    whole = np.asarray(token.is_null())
    token = np.asarray(token.fill_null(0)).astype(np.int64)
    for name in columns:
        x = np.asarray(rows[name].combine_chunks().fill_null(0))
        held, totals = np.zeros(len(r.names) * r.v, np.int64), np.zeros(len(r.names), np.int64)
        held[corpus[~whole] * r.v + token[~whole]] = x[~whole]
        totals[corpus[whole]] = x[whole]
        yield held, totals


def _scores(cell: bytes, returned: dict[int, bytes], rows: pa.Table, buckets: int, discount: float) -> tuple[list, np.ndarray, np.ndarray]:
    """Corpora of a run, their tokens and their sums of -ln p. rows: what earlier runs hold of its tokens and, without a token, of its corpora."""
    r = _Grams(cell)
    base = _returned(r, returned, buckets, {"c3": 2, "t3": 1, "f3": 1, "kn2": 3, "new2": 3, "k2": 0, "f2": 0})

    def level(x, followers, total):
        """p of a level is the first plus the second times p of the level below."""
        none, total = total == 0, np.maximum(total, 1)
        return np.where(none, 0.0, np.maximum(x - discount, 0.0) / total), np.where(none, 1.0, discount * followers / total)

    one = np.ones(len(r.at), np.int8)
    (c3,) = _before(r.gram, one)
    c3 += base["c3"][r.gram]
    new3 = r.far & (c3 == 0)
    t3, f3 = (x + base[k][r.ctx] for k, x in zip(("t3", "f3"), _before(r.ctx, one, new3), strict=True))
    a3, b3 = (np.where(r.far, x, other) for x, other in zip(level(c3, f3, t3), (0.0, 1.0), strict=True))
    del c3, t3, f3
    pair, group, kd2 = r.gram_pair[r.gram], r.ctx_group[r.ctx].astype(np.int32), np.where(r.far, new3, True)
    del r.gram, r.ctx
    kn2, c2 = _before(pair, kd2, one)
    kn2 += base["kn2"][pair]
    new2 = (base["new2"][pair] > 0) & (c2 == 0)
    del c2, pair
    k2, f2 = (x + base[k][group] for k, x in zip(("k2", "f2"), _before(group, kd2, new2), strict=True))
    a2, b2 = level(kn2, f2, k2)
    a3 += b3 * a2
    b3 *= b2
    del kn2, k2, f2, a2, b2, group, base

    (held, kn_total), (_, followers) = _held(r, rows, "n", "followers")
    kd1 = np.ones(len(r.code), bool)
    kd1[r.at] = new2
    key = r.q * r.v + r.code
    (kn1,) = _before(key, kd1)
    kn1 += held[key]
    k1, f1 = _before(r.q, kd1, kn1 == 0)  # a token's first occurrence counts in kn
    k1, f1 = k1 + kn_total[r.q], f1 + followers[r.q]

    a1, b1 = level(kn1, f1, k1)
    p = a1 + b1 / (f1 + 1)
    p[r.at] = a3 + b3 * p[r.at]
    return r.names.to_pylist(), np.bincount(r.q, minlength=len(r.names)), np.bincount(r.q, -np.log(p), len(r.names))


def _kept(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32) if int(x.max(initial=0)) < 1 << 32 else x


def _positions(cell: bytes, returned: dict[int, bytes], rows: pa.Table, buckets: int) -> Batches:
    """Rows of _COUNTS of a run. rows: as in _scores, with c: occurrences of a token, and of all tokens of a corpus."""
    r = _Grams(cell)
    base = _returned(r, returned, buckets, {"c3": 2, "t3": 1, "f3": 1, "kn2": 3, "c2": 3, "k2": 0, "f2": 0, "t2": 0})
    one = np.ones(len(r.at), np.int8)
    (c3,) = _before(r.gram, one)
    c3 += base["c3"][r.gram]
    new3 = r.far & (c3 == 0)
    t3, f3 = (_kept(x + base[k][r.ctx]) for k, x in zip(("t3", "f3"), _before(r.ctx, one, new3), strict=True))
    three = (_kept(c3), t3, f3)
    pair, group, kd2 = r.gram_pair[r.gram], r.ctx_group[r.ctx].astype(np.int32), np.where(r.far, new3, True)
    del c3, t3, f3, new3, r.gram, r.ctx
    kn2, c2 = (_kept(x + base[k][pair]) for k, x in zip(("kn2", "c2"), _before(pair, kd2, one), strict=True))
    del pair
    new2 = c2 == 0
    t2, f2, k2 = (_kept(x + base[k][group]) for k, x in zip(("t2", "f2", "k2"), _before(group, one, new2, kd2), strict=True))
    two = (c2, t2, f2, kn2, k2)
    del c2, t2, f2, kn2, k2, kd2, group, base
    (kn_held, kn_total), (_, followers), (c_held, tokens) = _held(r, rows, "n", "followers", "c")
    kd1 = np.ones(len(r.code), bool)
    kd1[r.at] = new2
    key = r.q * r.v + r.code
    kn1, c1 = _before(key, kd1, np.ones(len(key), np.int8))
    kn1, c1 = _kept(kn1 + kn_held[key]), _kept(c1 + c_held[key])
    del key
    t1, f1, k1 = _before(r.q, np.ones(len(r.q), np.int8), c1 == 0, kd1)
    one = (c1, _kept(t1 + tokens[r.q]), _kept(f1 + followers[r.q]), kn1, _kept(k1 + kn_total[r.q]))
    del c1, t1, f1, kn1, k1, kd1
    ends = np.searchsorted(r.at, np.arange(SLICE, len(r.code) + SLICE, SLICE))
    start = 0
    for i, end in enumerate(ends.tolist()):
        own, later = slice(i * SLICE, (i + 1) * SLICE), np.arange(start, end)
        start, far = end, later[r.far[later]]
        at, places = r.at[later], np.concatenate([np.arange(len(r.code))[own], r.at[later], r.at[far]])
        of = lambda at, k: r.words.take(pa.array(r.code[at - k]))
        grams = [of(places[: len(places) - len(later) - len(far)], 0), pc.binary_join_element_wise(of(at, 1), of(at, 0), " "), pc.binary_join_element_wise(of(r.at[far], 2), of(r.at[far], 1), of(r.at[far], 0), " ")]
        g = one[1][places].astype(np.int64) + 1
        n = np.repeat(np.array([1, 2, 3], np.int32), [len(x) for x in grams])
        numbers = [np.concatenate([a[own], b[later], three[j][far]]).astype(np.int64) for a, b, j in zip(one, two, (0, 1, 2, 0, 1), strict=True)]
        yield pa.RecordBatch.from_arrays([r.names.take(pa.array(r.q[places])), pa.array(g), pa.array(n), pa.concat_arrays(grams), *map(pa.array, numbers)], [c.split()[0] for c in _COUNTS.split(", ")])


def _final(buckets: int, discount: float | None, batches: Batches) -> Batches:
    """Rows come by run: the run, what earlier runs hold of its tokens and corpora, and its buckets' cells. Without a discount, counts go out."""
    now, cell, returned, held = None, None, {}, []

    def flush() -> Batches:
        if discount is None:
            yield from _positions(cell, returned, pa.Table.from_batches(held), buckets)
            return
        names, n, total = _scores(cell, returned, pa.Table.from_batches(held), buckets, discount)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n), pa.array(total)], ["corpus", "n_tokens", "total"])

    for batch in batches:
        ids, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(2))
        cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(kinds) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
            if ids[a] != now and now is not None:
                yield from flush()
                cell, returned, held = None, {}, []
            now = ids[a]
            if kinds[a] == -3:
                cell = batch.column(3)[a].as_py()
            elif kinds[a] < 0:
                held.append(batch.slice(a, b - a).select(["corpus", "token", "n", "followers", "c"]))
            else:
                returned[int(kinds[a])] = batch.column(3)[a].as_py()
    if now is not None:
        yield from flush()


def _by_run(docs: DataFrame, run: int, full: bool) -> tuple[DataFrame, int]:
    """Rows for _final, and the number of buckets. Shuffles end with the table that is written from them."""
    spark = docs.sparkSession
    bounded(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = docs.filter("corpus IS NOT NULL AND doc IS NOT NULL").select("corpus", F.col("doc").cast("long").alias("doc"), "text")
    lexed = known.repartitionByRange(n, "doc").sortWithinPartitions("doc").select("corpus", "doc", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("t"))
    with shuffles_end(spark):
        runs = written(lexed.mapInArrow(tidy(functools.partial(_cut, run)), _ONE), "runs")
        cells = runs.mapInArrow(tidy(functools.partial(_to_buckets, n)), _ONE).repartition(n, "bucket").sortWithinPartitions("bucket")
        past = written(cells.mapInArrow(tidy(functools.partial(_buckets, full)), _ONE), "earlier")
        tokens = past.filter("bucket IS NULL").union(runs.mapInArrow(tidy(_starts), _ONE)).groupBy("corpus", "token", "first", "id").agg(F.sum("n").alias("n"), F.sum("c").alias("own"))
        rows_before = lambda *keys: Window.partitionBy(*keys).orderBy("first", "id").rowsBetween(Window.unboundedPreceding, -1)
        earlier = lambda c, *keys: F.coalesce(F.sum(c).over(rows_before(*keys)), F.lit(0))
        tokens = written(tokens.withColumns({"kn": earlier("n", "corpus", "token"), "c": earlier("own", "corpus", "token")}), "tokens")
    totals = tokens.groupBy("corpus", "first", "id").agg(F.sum("n").alias("n"), F.sum((F.col("kn") == 0).cast("long")).alias("new"), F.sum("own").alias("own"))
    null = F.lit(None)
    one = tokens.select("id", null.cast("long").alias("first"), F.lit(-2).alias("bucket"), null.cast("binary").alias("cell"), "corpus", "token", F.col("kn").alias("n"), null.cast("long").alias("followers"), (F.col("c") if full else null.cast("long")).alias("c"))
    all_ = totals.select("id", null.cast("long").alias("first"), F.lit(-1).alias("bucket"), null.cast("binary").alias("cell"), "corpus", null.cast("string").alias("token"), *[earlier(c, "corpus").alias(d) for c, d in (("n", "n"), ("new", "followers"), ("own", "c"))])
    return runs.union(one).union(all_).union(past.filter("bucket IS NOT NULL")).repartition(2 * n, "id").sortWithinPartitions("id", "bucket"), n


def entropy(docs: DataFrame, discount: float = 0.5, run: int = RUN) -> DataFrame:
    """prequential.entropy of order 3 over prequential.trigrams_before(docs): corpus, n_tokens, entropy. docs: corpus, doc, text."""
    rows, n = _by_run(docs, run, False)
    sums = rows.mapInArrow(tidy(functools.partial(_final, n, discount)), "corpus string, n_tokens long, total double")
    return sums.filter("n_tokens > 0").groupBy("corpus").agg(F.sum("n_tokens").alias("n_tokens"), (F.sum("total") / F.sum("n_tokens")).alias("entropy"))


def counts(docs: DataFrame, run: int = RUN) -> DataFrame:
    """prequential.trigrams_before(docs): corpus, g, n, ngram and the five counts. docs: corpus, doc, text."""
    rows, n = _by_run(docs, run, True)
    return rows.mapInArrow(tidy(functools.partial(_final, n, None)), _COUNTS)

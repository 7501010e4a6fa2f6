"""Packing documents into windows by non-negative least squares on the histogram of lengths.

Documents become token ids with one end id, cut into windows of WINDOW ids and a rest. Lengths are rounded up to
bins of STEP ids. All combinations of at most DEPTH bins that fill a window exactly are enumerated, and a non-negative
least-squares solution says how often to use each, so that together they use up the histogram. Counts are rounded, never
beyond what is there. What remains is packed greedily, longest first: one document after the other, cut where a window ends.
Only the histogram (at most WINDOW numbers) and the plan made from it pass through the driver.

Which document takes which place follows from its number among those of its length. Tasks number their own pieces
and running totals by task make the numbers global, so no length, however common, is numbered in one task. Pieces are
written to the shared folder first.

Nulls count as empty texts: one piece, the end id alone. Repeated rows are packed as often as they occur. A null doc_id passes
through. An empty table gives an empty result. Other columns are not read. Strings that name special tokens are
ordinary text.
"""

from __future__ import annotations

import array
import functools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tokenlm.llm import kernel as K
from tokenlm.llm.frames import Batches, pick
from tokenlm.llm.session import tidy, written

WINDOW, STEP, DEPTH, END_ID = 2048, 8, 3, 1
#: Bytes of the table of known chunks, and known words; either is emptied beyond this. A worker keeps both for its next task.
TABLE_BYTES, CORES = 16 << 20, 50_000
#: Longer chunks are encoded anew each time.
CHUNK_BYTES = 64
_MARKS = ".,;:!?|%$&*#"
#: The steps before merging that Encoder.plain goes without, as the tokenizer library writes them.
_STEPS: list[bytes] = [
    b'{"type":"Sequence","normalizers":[{"type":"NFC"},{"type":"Replace","pattern":{"Regex":"\\\\s+"},"content":" "},{"type":"Lowercase"}]}',
    b'{"type":"Sequence","pretokenizers":[{"type":"Split","pattern":{"Regex":"\'s|\'t|\'re|\'ve|\'m|\'ll|\'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+"},"behavior":"Removed","invert":true},{"type":"ByteLevel","add_prefix_space":false,"trim_offsets":true,"use_regex":false}]}',
]
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(_MARKS.encode())] = _LETTER[0x61:0x7B] = True
#: Bytes of chunks: all but these four kinds of white space, which no token of the tokenizer spans.
_CHUNK = np.ones(256, bool)
_CHUNK[list(b" \n\t\r")] = False


class Encoder:
    """Ids of whole texts. Chunks between spaces have ids of their own, because the tokenizer drops white space.

    Chunks are byte ranges with A-Z lower-cased. Known ones are found by a hash and then compared byte by byte, so
    chunks that share a hash are told apart. A new chunk is lower-cased as the tokenizer does (where that is the same
    in Python), and marks at its end are split off, which the tokenizer does too, so that forms of a known word take
    no new encoding. The table of known chunks is a few arrays, whose bytes are bounded.
    """

    def __init__(self, path: str):
        # One core a task: threads of its own would take cores of other tasks, and the C library keeps memory for each thread.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.steps, self.plain_steps = (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer), (None, Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)]))
        #: Of each id, whether it ends a word; None where the tokenizer isn't of the kind that plain() knows.
        self.last: np.ndarray | None = None
        if [x and x.__getstate__() for x in self.steps] == _STEPS and getattr(self.tokenizer.model, "end_of_word_suffix", None) == "</w>":
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.clear()

    def clear(self) -> None:
        """Forgets all words and chunks: hashes in order, their places, and the bytes and ids of each place."""
        self.cores: dict[str, bytes] = {"": b""}
        self.keys, self.place = np.zeros(0, K.U), np.zeros(0, np.int32)
        self.data, self.data_cuts = np.zeros(0, np.uint8), np.zeros(1, np.int32)  # 32 bits: TABLE_BYTES and a slice are less
        self.flat, self.cuts = np.zeros(0, self.kind), np.zeros(1, np.int32)

    def parts(self, chunk: str) -> tuple[str, str]:
        """A chunk's core and the marks after it; their ids in a row are the chunk's."""
        core = chunk.rstrip(_MARKS)
        tail = chunk[len(core) :]
        if tail and core and not (core[-1] <= "\xff" and core[-1].isalpha()):
            core, tail = chunk, ""
        return (core if core.isascii() or max(core) > "\xff" else core.lower()), tail

    def plain(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of small Latin letters only, many in one text: the tokenizer's other steps leave such words as they are,
        and its last id of a word is one that ends words."""
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.plain_steps
        try:
            found = self.tokenizer.encode_batch_fast([" ".join(words[i : i + 4096]) for i in range(0, len(words), 4096)], add_special_tokens=False)
        finally:
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.steps
        ids = np.concatenate([np.array(e.ids, self.kind) for e in found])
        ends = ((np.flatnonzero(self.last[ids]) + 1) * self.kind.itemsize).tolist()
        flat = ids.tobytes()
        return {w: flat[a:b] for w, a, b in zip(words, [0, *ends[:-1]], ends, strict=True)}

    def ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks in a row, and where each chunk's end."""
        if len(self.cores) > CORES:
            self.cores = {"": b""}
        code = "H" if self.kind.itemsize == 2 else "I"
        split = [(c, "") if c[-1] not in _MARKS and c.isascii() else self.parts(c) for c in chunks]
        cores = self.cores
        new = list(dict.fromkeys([core for core, _ in split if core not in cores] + [tail for _, tail in split if tail and tail not in cores]))
        words = [c for c in new if c.isalpha() and (c.isascii() or max(c) <= "\xff")] if self.last is not None else []
        if words:
            cores.update(self.plain(words))
            new = [c for c in new if c not in cores]
        for c, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False) if new else (), strict=True):
            cores[c] = array.array(code, e.ids).tobytes()
        found = [cores[core] + cores[tail] if tail else cores[core] for core, tail in split]
        return np.frombuffer(b"".join(found), self.kind), np.cumsum(np.array([len(x) for x in found], np.int64)) // self.kind.itemsize

    def known(self, spans: K.Spans, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of chunks (-1: not in the table), and which are new to the table rather than at odds with it."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int64), np.ones(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        place, met = self.place[at].astype(np.int64), self.keys[at] == hashes
        same = np.flatnonzero(met)
        same = same[K.equal(spans, first[same], K.ranges(self.data, self.data_cuts.astype(np.int64)), place[same])]
        out = np.full(len(hashes), -1, np.int64)
        out[same] = place[same]
        return out, ~met

    def keep(self, hashes: np.ndarray, chunks: list[bytes], flat: np.ndarray, cuts: np.ndarray) -> None:
        """Adds chunks to the table. hashes: in order; flat, cuts: their ids and where each chunk's end."""
        where = np.searchsorted(self.keys, hashes)
        self.place = np.insert(self.place, where, np.arange(len(self.cuts) - 1, len(self.cuts) - 1 + len(hashes)))
        self.keys = np.insert(self.keys, where, hashes)
        self.data = np.concatenate([self.data, np.frombuffer(b"".join(chunks), np.uint8)])
        self.data_cuts = np.concatenate([self.data_cuts, (self.data_cuts[-1] + np.cumsum([len(c) for c in chunks])).astype(np.int32)])
        self.flat, self.cuts = np.concatenate([self.flat, flat]), np.concatenate([self.cuts, (self.cuts[-1] + cuts).astype(np.int32)])

    def encode_column(self, col: pa.Array) -> list[np.ndarray]:
        if sum(x.nbytes for x in (self.keys, self.place, self.data, self.data_cuts, self.flat, self.cuts)) > TABLE_BYTES:
            self.clear()
        t = K.Texts(col, lower=True)
        spans = t.runs(_CHUNK)
        long = spans.ends[spans.ends - spans.starts > 1]
        marks = long[_MARK[t.data[long - 1]] & _LETTER[t.data[long - 2]]] - 1  # a mark after a letter is a chunk, as parts() has it
        spans = K.Spans(t, np.sort(np.concatenate([spans.starts, marks]), kind="stable"), np.sort(np.concatenate([spans.ends, marks]), kind="stable"))
        hashes, first, which = np.unique(spans.hashes(), return_index=True, return_inverse=True)
        odd = np.flatnonzero(~K.equal(spans, np.arange(len(spans)), spans, first[which]))  # unequal chunks of one hash
        which[odd] = len(hashes) + np.arange(len(odd))
        place, fresh = self.known(spans, hashes, first)
        first = np.concatenate([first, odd])
        fresh = np.concatenate([fresh & (spans.ends[first[: len(hashes)]] - spans.starts[first[: len(hashes)]] <= CHUNK_BYTES), np.zeros(len(odd), bool)])
        place = np.concatenate([place, np.full(len(odd), -1)])
        flat, cuts = self.flat, self.cuts.astype(np.int64)
        raw = t.data.tobytes()
        for store in (True, False):
            new = np.flatnonzero((place < 0) & (fresh == store))
            if not len(new):
                continue
            chunks = [raw[spans.starts[i] : spans.ends[i]] for i in first[new]]
            ids, ends = self.ids([c.decode() for c in chunks])
            place[new] = len(cuts) - 1 + np.arange(len(new))
            if store:
                self.keep(hashes[new], chunks, ids, ends)
                flat, cuts = self.flat, self.cuts.astype(np.int64)
            else:
                flat, cuts = np.concatenate([flat, ids]), np.concatenate([cuts, cuts[-1] + ends])
        of = place[which]
        size = cuts[of + 1] - cuts[of]
        running = np.arange(int(size.sum()))
        out = np.full(len(running) + t.n, END_ID, self.kind)
        out[running + np.repeat(spans.doc, size)] = flat[running + np.repeat(cuts[of] - (np.cumsum(size) - size), size)]
        stops = np.cumsum(np.bincount(spans.doc, size, t.n).astype(np.int64) + 1)
        return np.split(out, stops[:-1]) if t.n else []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode_column(pa.array(texts, pa.string()))


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cut(docs: DataFrame, path: str) -> DataFrame:
    """Pieces of at most WINDOW ids. number: of this task's pieces of that length; ids: of those shorter than a window."""

    def run(batches: Batches) -> Batches:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(WINDOW + 1, np.int64)
        for batch in batches:
            for part in K.slices(batch):
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder(path).encode_column(part.column(1)), strict=True):
                    for start in range(0, len(ids), WINDOW):
                        piece = ids[start : start + WINDOW]
                        n = len(piece)
                        rows.append((doc_id, start, n, len(ids), crc(piece), None if n == WINDOW else piece.tobytes(), task, int(seen[n])))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids", "task", "number"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
    return pick(docs, "doc_id", "text").mapInArrow(tidy(run), "doc_id long, start long, length int, doc_tokens long, ids_crc32 long, ids binary, task int, number long")


def combinations(bins: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Falling sequences of at most depth positive numbers with the sum bins."""
    out = [(bins,)]
    if depth > 1:
        out += [(a, b) for a in range((bins + 1) // 2, bins) if (b := bins - a)]
    if depth > 2:
        out += [(a, b, bins - a - b) for a in range(-(-bins // 3), bins - 1) for b in range(-(-(bins - a) // 2), min(a, bins - a - 1) + 1)]
    return out


def nnls(used: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of non-negative numbers with the least |ax - b|, by the active-set method of Lawson and Hanson.

    used[j] holds the rows (from 1; 0: none) that column j of a counts, once for each time. The inverse of the active
    columns' products is kept up to date by bordering, so a step takes no matrix decomposition. Every step that counts
    makes the rest smaller, so no set of active columns comes back; a column whose step doesn't waits for one that does.
    """
    n, m = len(used), len(b)
    x, waits = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    active: list[int] = []
    columns, inverse = np.zeros((0, m)), np.zeros((0, 0))
    least = float(b @ b)

    while True:
        rest = np.concatenate([[0.0], b - x[active] @ columns])
        gain = rest[used].sum(1)
        gain[active] = -np.inf
        gain[waits] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= tolerance:
            return x
        c = np.bincount(used[j], minlength=m + 1)[1:].astype(float)
        u = columns @ c
        v = inverse @ u
        s = float(c @ c - u @ v)
        if s < 1e-9:  # depends on the active columns
            waits[j] = True
            continue
        inverse = np.block([[inverse + np.outer(v, v) / s, -v[:, None] / s], [-v[None, :] / s, np.array([[1 / s]])]])
        columns = np.vstack([columns, c])
        active.append(j)
        while active:
            want = inverse @ (columns @ b)
            low = want <= tolerance * 1e-3
            if not low.any():
                x[active] = want
                break
            old = x[active]
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(low, old / (old - want), np.inf)
            moved = old + min(1.0, float(np.nanmin(ratio))) * (want - old)
            i = int(np.flatnonzero(low)[np.argmin(moved[low])])
            x[active] = np.maximum(moved, 0)
            x[active[i]] = 0
            keep = np.arange(len(active)) != i
            inverse = inverse[np.ix_(keep, keep)] - np.outer(inverse[keep, i], inverse[i, keep]) / inverse[i, i]
            columns = columns[keep]
            del active[i]
        off = b - x[active] @ columns
        now = float(off @ off)
        if now < least * (1 - 1e-12):
            least, waits[:] = now, False
        else:
            waits[j] = True


class Plan:
    """Places for pieces by length and number, from the histogram alone. counts: pieces of each length from 0 to WINDOW."""

    def __init__(self, counts: np.ndarray):
        bins = WINDOW // STEP
        self.bin = -(-np.arange(WINDOW + 1) // STEP)
        have = np.bincount(self.bin, counts, bins + 1).astype(np.int64)
        total = np.cumsum(counts) - counts
        #: pieces of the same bin and a smaller length
        self.base = total - total[np.searchsorted(self.bin, self.bin)]
        some = combinations(bins)
        x = nnls(np.array([c + (0,) * (DEPTH - len(c)) for c in some]), have[1:].astype(float))
        self.slots: list[list[tuple[int, int, int]]] = [[] for _ in range(bins + 1)]  # of a bin: first number, first sequence, place
        self.used, self.sequences = np.zeros(bins + 1, np.int64), 0
        for j in np.argsort(-x, kind="stable"):
            wanted = int(round(x[j]))
            if not wanted:
                continue
            times = {b: some[j].count(b) for b in some[j]}
            wanted = min(wanted, *((have[b] - self.used[b]) // k for b, k in times.items()))
            if wanted <= 0:
                continue
            for place, b in enumerate(some[j]):
                self.slots[b].append((int(self.used[b]), self.sequences, place))
                self.used[b] += wanted
            self.sequences += int(wanted)
        #: where each length's remaining pieces begin, among their bin's pieces and in the stream of all that remains
        self.rest = np.maximum(self.base, self.used[self.bin])
        left = np.maximum(0, self.base + counts - self.rest)
        tokens = (left * np.arange(WINDOW + 1))[::-1]
        self.stream = (np.cumsum(tokens) - tokens)[::-1]
        self.first = [np.array([s[0] for s in row], np.int64) for row in self.slots]

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence and place of each piece, and its start in the stream of what remains (-1: in a combination)."""
        b = self.bin[length]
        within = self.base[length] + number
        sequence, place, stream = np.full(len(b), -1, np.int64), np.zeros(len(b), np.int64), np.full(len(b), -1, np.int64)
        for one in np.unique(b):
            at = np.flatnonzero((b == one) & (within < self.used[one]))
            if len(at):
                k = np.searchsorted(self.first[one], within[at], "right") - 1
                slots = np.array(self.slots[one], np.int64)[k]
                sequence[at], place[at] = slots[:, 1] + within[at] - slots[:, 0], slots[:, 2]
        at = np.flatnonzero(sequence < 0)
        stream[at] = self.stream[length[at]] + (within[at] - self.rest[length[at]]) * length[at]
        return sequence, place, stream


def pack(docs: DataFrame, path: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = written(cut(docs, path), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = np.zeros(WINDOW + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        counts[r[0]] = r[1]
    plan = Plan(counts)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    kind = encoder(path).kind
    numbered = pieces.join(offsets, ["length", "task"]).select("doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids", (F.col("before") + F.col("number")).alias("number"))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            doc_id, start, length, doc_tokens, check, ids, number = batch.columns
            sequence, place, stream = plan.place(np.asarray(length).astype(np.int64), np.asarray(number))
            inside = np.flatnonzero(stream < 0)
            take = pa.array(inside)
            yield pa.RecordBatch.from_arrays([doc_id.take(take), start.take(take), length.cast(pa.int64()).take(take), check.take(take), doc_tokens.take(take), pa.array(sequence[inside]), pa.array(place[inside])], names)
            rows = []
            for i in np.flatnonzero(stream >= 0):
                at, n, begin = int(stream[i]), length[i].as_py(), start[i].as_py()
                own = np.frombuffer(ids[i].as_buffer(), kind) if ids[i].is_valid else None
                done = 0
                while done < n:
                    size = min(n - done, WINDOW - (at + done) % WINDOW)
                    value = check[i].as_py() if size == n else crc(own[done : done + size])
                    rows.append((doc_id[i].as_py(), begin + done, size, value, doc_tokens[i].as_py(), plan.sequences + (at + done) // WINDOW, (at + done) % WINDOW))
                    done += size
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(7)], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "place"]
    placed = numbered.mapInArrow(tidy(run), T.StructType([T.StructField(c, T.LongType()) for c in names]))
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("place")

"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct SHINGLE-word shingles. Two sets link when PERCENT * |union| <= 100 * |intersection|;
then they differ in at most k elements, k following from the larger one's size band. The shingle domain is
cut into more parts than k, so any two linked sets agree in some part (or in some subset of a part's pieces): every such
part's content is a signature, and linked sets share one at least. A set with so many empty parts that the shared one could
be empty also signs under a further seed. Signatures are made once and written with the sets' sizes and sketches.

Sets that share a signature are candidates, and candidates are checked exactly, in two steps.
1. Groups of a signature up to SMALL sets give all their pairs, larger ones the pairs of their smallest fingerprint with
   all others. A family of copies mostly becomes one component here, with as many pairs as it has members.
2. Only groups that still hold sets of several components go on. Groups of one smallest fingerprint form a cluster, which is
   compared block against block, where two blocks of one large component never meet. Sketches are compared first; texts
   are joined only for sets that sketches allow to link with one of another component. A task holds two blocks, bounded in
   sets and in shingles, compares them by a matrix product, and returns a forest of the links it found, not all pairs.
So no pair is lost, no group is in one task, rows grow with the number of sets for families of copies, and with the
sets outside the family's component times its blocks beyond them. Equal sets are one vertex from the start.
Before any text is joined, parity sketches rule pairs out: each element flips one bit, so sets whose sketches differ in
more bits than linked sets have different elements can't link. This drops pairs that only share a passage, and splits clusters.

Shingles are 64-bit hashes of their words. Vertices are 64-bit fingerprints of sets; a second fingerprint finds sets
that share the first by chance, and these get another one, so that only equal sets are one vertex. A bounded bit map of
candidates spares the join of most texts that are none; where it fills up, more texts are joined, with the same result.

Nulls, empty texts and texts without words are empty sets, linked with nothing: their component is their own doc_id.
Repeated rows are equal sets. A null doc_id takes part in links but is nobody's component; a component without any other
doc_id has null. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tokenlm.llm import kernel as K
from tokenlm.llm.components import components
from tokenlm.llm.frames import Batches, arrow_map, pick
from tokenlm.llm.session import tidy, written

SHINGLE = 4
#: Two sets link when PERCENT * |union| <= 100 * |intersection|.
PERCENT = 85
GROWTH, SLACK, SEEDS = 1.6, 0.15, 8
SMALL, FILTER_BITS = 8, 1 << 22
#: A block's sets and shingles at most, and sets of a component that has blocks of its own.
BLOCK, OWN = (1024, 1 << 17), 256
#: Fingerprints that a task remembers, to sign equal sets once.
REMEMBERED = 1 << 17
#: Fingerprints that several sets share by chance, at most; n sets have n^2 / 2^65 of them.
CLASHES = 10_000
U = K.U


def sets(t: K.Texts, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and their texts."""
    words = t.runs(K.NOT_SPACE)
    h, n = words.hashes(), words.per_text()
    at = K.windows(words.doc, shingle)
    g, doc = K.ngrams(h, at, shingle), words.doc[at]
    short = np.flatnonzero((n > 0) & (n < shingle))
    if len(short):
        first = np.cumsum(n) - n
        whole = np.array([int(K.ngrams(h, first[i : i + 1], int(n[i]))[0]) for i in short], U)
        g, doc = np.concatenate([g, whole]), np.concatenate([doc, short])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], doc[new]


def fingerprints(g: np.ndarray, doc: np.ndarray, n: int, seed: int = 0xA5A5A5A5DEADBEEF) -> np.ndarray:
    """A 64-bit number for each set, equal for equal sets."""
    x = K.mix(g ^ U(seed))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(x, dtype=U)])
    size = np.bincount(doc, minlength=n)
    end = np.cumsum(size)
    return K.mix(sums[end] - sums[end - size] + size.astype(U))


class Band:
    """Parameters for pairs whose larger set has from low to high elements.

    Such sets differ in at most k elements. The domain falls into parts parts of pieces pieces each; in one part at least
    the sets differ in no more than spare elements, so all pieces but spare of it agree, and the subset of those pieces
    is a signature. slack parts more make sure that some such subset isn't empty.
    """

    def __init__(self, low: int, high: int, percent: int = PERCENT):
        self.low, self.high = low, high
        self.k = 2 * high * (100 - percent) // (100 + percent)
        self.spare, self.pieces = (1, 3) if 0 < self.k <= 12 else (0, 1)
        self.slack = max(2, int(SLACK * self.k)) if self.k else 0
        self.parts = self.k // (self.spare + 1) + 1 + self.slack
        self.least = -(-percent * low // 100)


#: Bands by percentage, as far as they were needed.
_bands: dict[int, list[Band]] = {}


def bands(size: int, percent: int = PERCENT) -> list[tuple[int, Band]]:
    """The bands whose pairs a set of that size can be in, with their numbers."""
    known = _bands.setdefault(percent, [])
    while not known or known[-1].high < 2 * size + 2:
        low = known[-1].high + 1 if known else 1
        known.append(Band(low, max(low, int(low * GROWTH)), percent))
    return [(j, b) for j, b in enumerate(known) if b.least <= size <= b.high]


def signatures(g: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signatures of one set, which every set similar enough shares at least one of."""
    out = []
    for j, b in bands(len(g), percent):
        for seed in range(SEEDS + 1):
            if seed == SEEDS:
                out.append(K.mix(np.full(1, U(j * 1000 + 999))))
                break
            x = K.mix(g + U((0x9E3779B97F4A7C15 * (seed * 131 + j + 1)) % (1 << 64)))
            part = ((x >> U(32)) % U(b.parts)).astype(np.int64)
            y = K.mix(x)
            label = U((j * (SEEDS + 1) + seed) * 8)
            slot = part * b.pieces + (((x & U(0xFFFFFFFF)) % U(b.pieces)).astype(np.int64) if b.pieces > 1 else 0)
            sums, filled = np.zeros(b.parts * b.pieces, U), np.bincount(slot, minlength=b.parts * b.pieces) > 0
            np.add.at(sums, slot, y)
            sums, filled = sums.reshape(b.parts, b.pieces), filled.reshape(b.parts, b.pieces)
            empty = np.zeros(b.parts, bool)
            number = np.arange(b.parts).astype(U)
            for left in range(b.pieces) if b.spare else (None,):
                use = [i for i in range(b.pieces) if i != left]
                some = filled[:, use].any(1)
                empty |= ~some
                value = np.zeros(b.parts, U)
                for i in use:
                    value = K.mix(value + sums[:, i] + U(i + 1))
                out.append(K.mix(value + (number << U(20)) + label + U(0 if left is None else left + 1))[some])
            if b.parts - b.k // (b.spare + 1) > int(empty.sum()):
                break
    return np.concatenate(out)


def sketch(g: np.ndarray, percent: int = PERCENT) -> bytes:
    """Parities of a set's elements by cell, of a power of two of cells that has eight to a difference at least."""
    cells = 1 << max(6, int(16 * len(g) * (100 - percent) // (100 + percent)).bit_length())
    at = (K.mix(g ^ U(0x5851F42D4C957F2D)) & U(cells - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=cells) & 1).astype(np.uint8)).tobytes()


def possible(bits: list[bytes], n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Matrix of pairs that sketches and sizes don't rule out. A longer sketch is folded to the shorter one's cells."""
    cells = np.array([8 * len(b) for b in bits])
    out = np.zeros((len(bits), len(bits)), bool)
    for size in np.unique(cells):
        mine = np.flatnonzero(cells >= size)
        m = np.stack([np.unpackbits(np.frombuffer(bits[i], np.uint8)).reshape(-1, size).sum(0) & 1 for i in mine]).astype(np.float32) * 2 - 1
        differ = (size - m @ m.T) / 2
        a, b = n[mine][:, None], n[mine][None, :]
        ok = (differ <= (a + b) * (100 - percent) // (100 + percent)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
        here = np.minimum(cells[mine][:, None], cells[mine][None, :]) == size
        out[np.ix_(mine, mine)] |= ok & here
    return out


def _sets(col: pa.Array, shingle: int = SHINGLE, clashes: tuple = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elements of all sets in a row, where each set begins (and the last ends), sizes, and two fingerprints.

    clashes: first fingerprints that different sets share; theirs is made from both."""
    t = K.Texts(col, lower=True)
    g, doc = sets(t, shingle)
    size = np.bincount(doc, minlength=t.n)
    fp, check = fingerprints(g, doc, t.n), fingerprints(g, doc, t.n, 0x3C6EF372FE94F82B)
    if clashes:
        fp = np.where(np.isin(fp.view(np.int64), np.array(clashes, np.int64)), K.mix(fp + K.mix(check)), fp)
    return g, np.concatenate([[0], np.cumsum(size)]), size, fp.view(np.int64), check.view(np.int64)


def measured(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, clashes: tuple = ()) -> DataFrame:
    """doc_id, n_shingles, fp and check, the set's fingerprints, its sketch (all null for empty sets), and keys: signatures of each
    set that a task sees for the first time."""

    def run(batches: Batches) -> Batches:
        seen: set[int] = set()
        for batch in batches:
            for part in K.slices(batch):
                g, cut, size, fp, check = _sets(part.column(1), shingle, clashes)
                bits, keys = [None] * len(size), [None] * len(size)
                for i in np.flatnonzero(size):
                    own, f = g[cut[i] : cut[i + 1]], int(fp[i])
                    bits[i] = sketch(own, percent)
                    if f not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(f)
                        keys[i] = np.unique(signatures(own, percent)).view(np.int64)
                empty = size == 0
                columns = [part.column(0), pa.array(size), pa.array(fp, mask=empty), pa.array(check, mask=empty), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "fp", "check", "sketch", "keys"])

    return pick(docs, "doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, fp long, check long, sketch binary, keys array<long>")


def vertices(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, tuple]:
    """All documents as measured; fp, n_shingles and sketch of each distinct set; fingerprints that clashed."""
    clashes: tuple = ()
    while True:
        members = written(measured(docs, shingle, percent, clashes), "members")
        sizes = members.filter("fp IS NOT NULL").groupBy("fp").agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.min("check").alias("low"), F.max("check").alias("high"))
        sizes = written(sizes, "sizes")
        found = tuple(r[0] for r in sizes.filter("low <> high").select("fp").limit(CLASHES + 1).collect())
        if not found:
            return members, sizes.drop("low", "high"), clashes
        clashes += found
        if len(clashes) > CLASHES:
            raise ValueError(f"over {CLASHES} fingerprints stand for several sets")


def _grouped(batches: Batches) -> Batches:
    """From rows sorted by key and fp: kind 0, pairs (a, b) of groups up to SMALL; kind 1, first set (a) and each set (b) of larger
    ones; kind 2, sets (b) of a task's first and last group, which may go on in another task; kind 3, the first set (b) of a last group that is a larger one.

    A group is never held: once it is known to be large, its rows go out as they come."""

    def out(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), kind, np.int32)), pa.array(key), pa.array(a), pa.array(b)], ["kind", "key", "a", "b"])

    none = np.zeros(0, np.int64)
    held_key, held_fp, first, last, large = none, none, None, None, None
    for batch in batches:
        key, fp = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
        new[0] = last != (key[0], fp[0])
        last = (key[-1], fp[-1])
        key, fp = key[new], fp[new]
        first = last[0] if first is None and not len(key) else key[0] if first is None else first
        edge = key == first
        if edge.any():
            yield out(2, key[edge], fp[edge], fp[edge])
            key, fp = key[~edge], fp[~edge]
        if large:
            more = key == large[0]
            if more.any():
                yield out(1, key[more], np.full(more.sum(), large[1]), fp[more])
                key, fp = key[~more], fp[~more]
            if not len(key):
                continue
            large = None
        key, fp = np.concatenate([held_key, key]), np.concatenate([held_fp, fp])
        if not len(key):
            continue
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        held_key, held_fp = none, none
        if size[-1] > SMALL:
            large = (key[-1], fp[start[-1]])
        else:
            held_key, held_fp = key[start[-1] :], fp[start[-1] :]
            key, fp, start, size = key[: start[-1]], fp[: start[-1]], start[:-1], size[:-1]
        place = np.arange(len(key)) - np.repeat(start, size)
        few = np.repeat(size <= SMALL, size)
        for d in range(1, SMALL):
            i = np.flatnonzero(few & (place >= d))
            if len(i):
                yield out(0, key[i], fp[i - d], fp[i])
        many = np.flatnonzero(~few)
        if len(many):
            yield out(1, key[many], np.repeat(fp[start], size)[many], fp[many])
    if large:
        yield out(3, np.array([large[0]]), np.array([large[1]]), np.array([large[1]]))
    elif len(held_key):
        yield out(2, held_key, held_fp, held_fp)


def candidates(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of fingerprints to check; and larger groups: key, lead and fp of each of their sets, the lead included."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.filter("keys IS NOT NULL").select(F.explode("keys").alias("key"), "fp").repartitionByRange(n, "key", "fp").sortWithinPartitions("key", "fp")
    found = written(rows.mapInArrow(tidy(_grouped), "kind int, key long, a long, b long"), "candidates")
    edge = found.filter("kind >= 2").groupBy("key", F.col("b").alias("fp")).agg(F.max("kind").alias("kind"))
    across = edge.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("lead"), (F.max("kind") == 3).alias("big")).filter("n > 1")
    joined = edge.join(F.broadcast(across), "key")  # two keys a task at most
    small = joined.filter(f"n <= {SMALL} AND NOT big").select("key", "fp")
    more = small.join(small.select("key", F.col("fp").alias("other")), "key").filter("fp < other").select(F.col("fp").alias("a"), F.col("other").alias("b"))
    groups = written(found.filter("kind = 1").select("key", F.col("a").alias("lead"), F.col("b").alias("fp")).union(joined.filter(f"n > {SMALL} OR big").select("key", "lead", "fp")), "groups")
    pairs = found.filter("kind = 0").select("a", "b").union(more).union(groups.filter("lead <> fp").select("lead", "fp"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), groups


def _slot(fp: np.ndarray) -> np.ndarray:
    return (K.mix(fp.view(U)) & U(FILTER_BITS - 1)).astype(np.int64)


def bit_map(some: DataFrame) -> np.ndarray:
    """FILTER_BITS bits as bytes; the bit of each fp is set. FILTER_BITS / 64 numbers at most come to the driver."""

    def words(batches: Batches) -> Batches:
        for batch in batches:
            hit = np.zeros(FILTER_BITS, bool)
            hit[_slot(np.asarray(batch.column(0)))] = True
            bits = np.packbits(hit).view(np.int64)
            at = np.flatnonzero(bits)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at])], ["word", "bits"])

    out = np.zeros(FILTER_BITS // 64, np.int64)
    found = some.mapInArrow(tidy(words), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[np.asarray(found["word"])] = np.asarray(found["bits"])
    return out.view(np.uint8)


def texts_of(docs: DataFrame, some: DataFrame, shingle: int = SHINGLE, clashes: tuple = ()) -> DataFrame:
    """fp and one text for each vertex (column fp)."""
    bits = bit_map(some)

    def run(batches: Batches) -> Batches:
        known = np.unpackbits(bits).astype(bool)
        seen: set[int] = set()
        for batch in batches:
            for part in K.slices(batch):
                _, _, size, fp, _ = _sets(part.column(0), shingle, clashes)
                take = []
                for i in np.flatnonzero((size > 0) & known[_slot(fp)]):
                    if (f := int(fp[i])) not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(f)
                        take.append(i)
                if take:
                    yield pa.RecordBatch.from_arrays([pa.array(fp[take]), part.column(0).take(pa.array(take))], ["fp", "text"])

    found = pick(docs, "text").mapInArrow(tidy(run), "fp long, text string")
    return written(found.join(some, "fp", "left_semi").groupBy("fp").agg(F.first("text").alias("text")), "texts")


def linked(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return 100 * shared >= percent * (a + b - shared)


def checked_pairs(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The pairs that link."""
    left = texts.select(F.col("fp").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("fp").alias("b"), F.col("text").alias("tb"))

    def make(part: pa.RecordBatch) -> dict:
        x, cx, nx, _, _ = _sets(part.column(2), shingle)
        y, cy, ny, _, _ = _sets(part.column(3), shingle)
        shared = np.array([len(np.intersect1d(x[a:b], y[c:d], assume_unique=True)) for a, b, c, d in zip(cx, cx[1:], cy, cy[1:])], np.int64)
        keep = pa.array(np.flatnonzero(linked(shared, nx, ny, percent)))
        return {"a": part.column(0).take(keep), "b": part.column(1).take(keep)}

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_pydict(make(part))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a long, b long")


def intersections(g: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Matrix of the sizes of all intersections of sets."""
    n = len(cut) - 1
    doc = np.repeat(np.arange(n), np.diff(cut))
    order = np.argsort(g, kind="stable")
    element = np.cumsum(np.concatenate([[0], (g[order][1:] != g[order][:-1]).astype(np.int64)])) if len(g) else np.zeros(0, np.int64)
    common = np.bincount(element)[element] > 1
    column = np.unique(element[common], return_inverse=True)[1]
    row = doc[order][common]
    shared = np.zeros((n, n), np.float32)
    for low in range(0, int(column.max(initial=-1)) + 1, 4096):
        mine = (column >= low) & (column < low + 4096)
        m = np.zeros((n, 4096), np.float32)
        m[row[mine], column[mine] - low] = 1
        shared += m @ m.T
    return shared.astype(np.int64)


def forest(fp: np.ndarray, links: np.ndarray) -> pa.Table:
    """Links that join what a matrix of links joins."""
    a, b = np.nonzero(np.triu(links, 1))
    root = list(range(len(fp)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        x, y = find(i), find(j)
        if x != y:
            root[x] = y
            out.append((int(fp[i]), int(fp[j])))
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def unsettled(groups: DataFrame, roots: DataFrame, sizes: DataFrame) -> DataFrame:
    """Sets of the groups that hold sets of several components: root (the group's lead), fp, comp and n, once for each lead."""
    placed = written(groups.join(roots, F.col("fp") == F.col("vertex"), "left").select("key", "lead", "fp", F.coalesce("root", "fp").alias("comp")), "grouped")
    several = written(placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key"), "several")
    open_sets = placed.join(several, "key", "left_semi").select(F.col("lead").alias("root"), "fp", "comp").distinct()
    return written(open_sets.join(sizes.select("fp", F.col("n_shingles").alias("n")), "fp"), "unsettled")


PAIR = ["root", "block", "block2"]


def met_blocks(member: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Sets of clusters (root, fp, comp, n), once for each two blocks that are compared: PAIR, fp, comp, side.

    Blocks hold sets of like sizes, BLOCK[0] of them or BLOCK[1] shingles at most, and only blocks with sizes that can link
    meet. A component of OWN sets or more has blocks of its own, which don't meet each other.
    """
    count, budget = BLOCK
    own = written(member.groupBy("root", "comp").agg(F.count("*").alias("c")).filter(F.col("c") >= OWN).select("root", "comp", F.col("comp").alias("own")), "own")
    keyed = member.join(own, ["root", "comp"], "left").withColumns({"own_key": F.coalesce("own", F.lit(0)), "mixed": F.col("own").isNull()})
    by_size = keyed.groupBy("root", "own_key", "mixed", "n").agg(F.sum(F.greatest("n", F.lit(budget // count))).alias("room"))
    smaller = Window.partitionBy("root", "own_key", "mixed").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    cut = by_size.select("root", "own_key", "mixed", "n", F.floor(F.coalesce(F.sum("room").over(smaller), F.lit(0)) / budget).alias("run"), F.ceil(F.col("room") / budget).alias("of"))
    name = F.concat_ws("/", F.coalesce(F.col("own").cast("string"), F.lit("mixed")), "run", F.pmod(F.xxhash64("fp"), F.col("of")))
    placed = written(keyed.join(cut, ["root", "own_key", "mixed", "n"]).select("root", "fp", "comp", "n", "own", name.alias("block")), "placed")
    blocks = written(placed.groupBy("root", "own", "block").agg(F.min("n").alias("low"), F.max("n").alias("high")), "blocks")
    others = blocks.select("root", *[F.col(c).alias(f"{c}2") for c in ("own", "block", "low", "high")])
    large = blocks.filter("own IS NOT NULL").select("root", "own").distinct()
    two = large.join(large.select("root", F.col("own").alias("own2")), "root").filter("own < own2")
    met = (
        blocks.join(others.filter("own2 IS NULL"), "root").filter("own IS NOT NULL OR block <= block2").select("root", "block", "block2", "low", "high", "low2", "high2")
        .union(blocks.join(two, ["root", "own"]).join(others, ["root", "own2"]).select("root", "block", "block2", "low", "high", "low2", "high2"))
    ).filter(f"100 * high >= {percent} * low2 AND 100 * high2 >= {percent} * low").select(*PAIR)
    met = written(met, "met")
    left = placed.join(met, ["root", "block"]).select(*PAIR, "fp", "comp", F.when(F.col("block") == F.col("block2"), 2).otherwise(0).alias("side"))
    right = placed.withColumnRenamed("block", "block2").join(met.filter("block <> block2"), ["root", "block2"]).select(*PAIR, "fp", "comp", F.lit(1).alias("side"))
    return left.union(right)


def across(side: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Pairs between two blocks (side 0 and 1) or within one (2), of different components."""
    return ((side[:, None] != side[None, :]) | (side[:, None] == 2)) & (comp[:, None] != comp[None, :])


ROWS = "root long, block string, block2 string, fp long, comp long, side int"


def possible_sets(rows: DataFrame, sizes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of the sets of two blocks, those that sketches allow to link with one of another component. sizes: fp, n_shingles, sketch."""

    def check(t: pa.Table) -> pa.Table:
        n, side, comp = (np.asarray(t.column(c).combine_chunks()) for c in ("n_shingles", "side", "comp"))
        hit = (possible(t.column("sketch").to_pylist(), n, percent) & across(side, comp)).any(1)
        return t.select([*PAIR, "fp", "comp", "side"]).filter(pa.array(hit))

    held = rows.join(sizes, "fp").select(*PAIR, "fp", "comp", "side", "n_shingles", "sketch")
    return held.groupBy(*PAIR).applyInArrow(check, ROWS)


def checked_blocks(rows: DataFrame, texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Forest of the links between components among the sets of two blocks."""

    def check(t: pa.Table) -> pa.Table:
        g, cut, size, _, _ = _sets(pa.concat_arrays([c.cast(pa.large_string()) for c in t.column("text").chunks]), shingle)
        fp, side, comp = (np.asarray(t.column(c).combine_chunks()) for c in ("fp", "side", "comp"))
        return forest(fp, linked(intersections(g, cut), size[:, None], size[None, :], percent) & across(side, comp))

    return rows.join(texts, "fp").select(*PAIR, "fp", "comp", "side", "text").groupBy(*PAIR).applyInArrow(check, "a long, b long")


def ruled_pairs(pairs: DataFrame, sizes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs that sketches allow."""
    side = lambda k: sizes.select(F.col("fp").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            a, b, na, sa, nb, sb = (c.to_pylist() for c in batch.columns)
            keep = [i for i in range(len(a)) if possible([sa[i], sb[i]], np.array([na[i], nb[i]]), percent)[0, 1]]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(tidy(run), "a long, b long")


def ends(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("fp")).union(links.select("b")).distinct()


def linked_sets(docs: DataFrame, members: DataFrame, sizes: DataFrame, clashes: tuple, shingle: int, percent: int) -> DataFrame:
    """vertex and root of each set that links with another."""
    pairs, groups = candidates(members)
    pairs = written(ruled_pairs(pairs, sizes, percent), "ruled")
    texts = texts_of(docs, written(ends(pairs), "vertices"), shingle, clashes)
    roots = written(components(checked_pairs(pairs, texts, shingle, percent)), "roots")
    member = unsettled(groups, roots, sizes)
    if member.isEmpty():
        return roots
    rows = written(possible_sets(met_blocks(member, percent), sizes, percent), "possible")
    texts = texts_of(docs, written(rows.select("fp").distinct(), "vertices"), shingle, clashes)
    more = written(checked_blocks(rows, texts, shingle, percent), "more")
    if more.isEmpty():
        return roots
    return components(roots.select(F.col("root").alias("a"), F.col("vertex").alias("b")).union(more))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, and fp, the fingerprint of its set."""
    return _near_duplicates(docs, shingle, percent)[0].drop("root", "classes")


def _near_duplicates(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, tuple]:
    members, sizes, clashes = vertices(docs, shingle, percent)
    roots = linked_sets(docs, members, sizes, clashes, shingle, percent)
    classes = members.filter("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least"))
    known = classes.join(roots, F.col("fp") == F.col("vertex"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = known.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("classes"))
    of_class = written(known.join(of_root, "root").select("fp", "component", "root", "classes"), "classes")
    out = members.select("doc_id", "n_shingles", "fp").join(of_class, "fp", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), "fp", "root", "classes"), clashes


def keep_first(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with its columns: of those with the component's doc_id the one whose row hashes least.

    Empty sets stay, all of them. Of a component without any doc_id one row of each set stays. Components are told apart by
    their sets, so that two of them stay apart though rows of both have one doc_id. Rows whose set nothing else
    equals or links with are kept where they are read; only the others are joined.
    """
    columns = docs.columns
    names = [f"c{i}" for i in range(len(columns))]
    plain = docs.toDF(*names)
    at_text, own_id = columns.index("text"), F.col(f"c{columns.index('doc_id')}")
    rows, clashes = _near_duplicates(docs, shingle, percent)
    rows = rows.filter("fp IS NOT NULL")
    classes = rows.groupBy("fp").agg(F.count("*").alias("n"), F.first("component_id").alias("component"), F.first("root").alias("root"), F.first("classes").alias("classes"))
    others = written(classes.filter("n > 1 OR classes > 1").select("fp", "component", "root"), "others")
    bits = bit_map(others.select("fp"))

    def split(want: bool):
        def run(batches: Batches) -> Batches:
            known = np.unpackbits(bits).astype(bool)
            for batch in batches:
                at = 0
                for part in K.slices(pa.RecordBatch.from_arrays([batch.column(at_text)], ["text"])):
                    _, _, size, fp, _ = _sets(part.column(0), shingle, clashes)
                    mine = batch.slice(at, part.num_rows)
                    at += part.num_rows
                    hit = (size > 0) & known[_slot(fp)]
                    out = mine.columns + ([pa.array(fp)] if want else [])
                    yield pa.RecordBatch.from_arrays(out, names + ["fp"] * want).filter(pa.array(hit == want))

        return run

    kept_types = [T.StructField(c, f.dataType, True) for c, f in zip(names, docs.schema.fields, strict=True)]
    apart = plain.mapInArrow(tidy(split(False)), T.StructType(kept_types))
    met = plain.mapInArrow(tidy(split(True)), T.StructType([*kept_types, T.StructField("fp", T.LongType())]))
    joined = met.join(others.withColumn("known", F.lit(True)), "fp", "left")
    same = joined.filter("known IS NULL").select(*names)
    first = joined.filter(F.col("known") & (F.col("component").isNull() | (own_id == F.col("component"))))
    row = F.struct(*names)
    one = first.groupBy("root", F.when(F.col("component").isNull(), F.col("fp")).alias("which")).agg(F.min_by(row, F.xxhash64(*names)).alias("row"))
    return apart.union(same).union(one.select(*[f"row.{c}" for c in names])).toDF(*columns)

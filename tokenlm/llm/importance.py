"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Target text is what labels call good (quality 1), raw text is every document. Each text is a bag of hashed n-grams:
single words and pairs, and runs of one to three word shapes (capitals, bars, symbols, final marks, repeats), in
BUCKETS buckets. Both models are smoothed bucket frequencies; the raw one counts all documents, the target one those
of good label in the parts TARGET of a sample of at most LABEL_ROWS labelled doc_ids. Labelled doc_ids fall into ten parts by
crc32; the parts CALIBRATION, which the target model doesn't see, fit a slope and an offset for the mean log ratio by
n-gram, so that long texts don't drift. The log weight is that line: the log odds that a text is target text. Part 9 is
never used, so that a figure on it is one on held-out labels. If a part lacks a kind of label, all of the sample stands in for it.

Resampling without replacement is Gumbel top-k: key = log weight + standard Gumbel noise, and the k largest keys stay. k is a
parameter; by default it is the number of documents with a log weight over 0, likelier target than not.

Nulls and texts without a word have no n-grams: weight 0, chance 0, never kept. Repeated rows have equal keys and stay
or go together; rows that tie with the k-th key are all kept, so more than k can stay. A null doc_id is hashed as
an empty string and joins no label. Labels that disagree count as 0. An empty table gives an empty result; without both kinds of labels, every
text with a word is kept. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlm.llm import kernel as K
from tokenlm.llm.frames import Batches, arrow_map, arrow_rewrite, pick
from tokenlm.llm.session import local_rows, tidy, written

BUCKETS = 1 << 16
#: At most so many labelled rows are read, those of the smallest hash of doc_id.
LABEL_ROWS = 20_000
#: Parts of the labelled doc_ids, by crc32(doc_id as text) mod 10, for the target model and for slope and offset.
TARGET, CALIBRATION = range(6), range(6, 9)
SEED = 7
SCHEMA = "doc_id long, n_grams long, log_weight double, chance double, gumbel_key double"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UP, _DOWN, _DIGIT, _STOP = (np.zeros(256, bool) for _ in range(4))
_UP[0x41:0x5B] = _DOWN[0x61:0x7B] = _DIGIT[0x30:0x3A] = True
_STOP[list(b".!?")] = True


def features(t: K.Texts, shapes: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams and their texts; without shapes, of words only."""
    words = t.runs(K.NOT_SPACE)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, doc, data = words.hashes(), words.doc, t.data
    last, first = data[words.ends - 1], data[words.starts]
    long = words.ends - words.starts > 1
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    down = words.contain(_DOWN[data])
    traits = (
        (words.count(_UP[data]) >= 2) & ~down, long & (last == data[np.maximum(words.ends - 2, 0)]) & _STOP[last], words.contain(_SYMBOL[data]), ~long & (last == 124), same, _STOP[last], _UP[first] & down, words.contain(_DIGIT[data]),
    )
    shape = K.mix(sum(x.astype(K.U) << K.U(i) for i, x in enumerate(traits)) + K.U(1))
    parts, docs = [], []
    for entries, sizes in ((h, (1, 2)), (shape, (1, 2, 3)))[: 1 + shapes]:
        for size in sizes:
            at = K.windows(doc, size)
            parts.append(K.ngrams(entries, at, size))
            docs.append(doc[at])
    return (np.concatenate(parts) >> K.U(48)).astype(np.int64) % BUCKETS, np.concatenate(docs)


def label_sample(labels: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids in order and their labels, at most LABEL_ROWS."""
    one = pick(labels, "doc_id", column).dropna().groupBy("doc_id").agg(F.min(column).alias("y"))
    rows = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABEL_ROWS).collect()
    found = sorted((r[0], r[1]) for r in rows)
    return np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.int64)


def parts(ids: np.ndarray, some: range) -> np.ndarray:
    """Which doc_ids are in some of the ten parts."""
    return np.array([zlib.crc32(str(int(i)).encode()) % 10 in some for i in ids], bool)


def share(ids: np.ndarray, y: np.ndarray, some: range, kinds: set) -> np.ndarray:
    """Mask of the labels in some parts, or of all where these lack one of the kinds."""
    mine = parts(ids, some)
    return mine if kinds <= set(y[mine].tolist()) else np.ones(len(ids), bool)


class Model:
    """Log ratios by bucket, and the line from a mean log ratio to a log weight."""

    def __init__(self, ratio: np.ndarray, slope: float = 1.0, offset: float = 0.0, shapes: bool = True):
        self.ratio, self.slope, self.offset, self.shapes = ratio.astype(np.float64), slope, offset, shapes

    def means(self, t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Number of n-grams and mean log ratio of each text."""
        bucket, doc = features(t, self.shapes)
        n = np.bincount(doc, minlength=t.n)
        return n, np.bincount(doc, self.ratio[bucket], t.n) / np.maximum(n, 1)

    def score(self, ids: pa.Array, col: pa.Array) -> dict:
        t = K.Texts(col)
        n, mean = self.means(t)
        weight = np.where(n > 0, np.clip(self.slope * mean + self.offset, -700, 700), 0.0)
        chance = np.where(n > 0, 1 / (1 + np.exp(-weight)), 0.0)
        names = K.Texts(ids.cast(pa.string()))
        h = K.mix(K.Spans(names, names.starts, names.ends).hashes() + K.mix(K.Spans(t, t.starts, t.ends).hashes() + K.U(SEED)))
        u = ((h >> K.U(11)).astype(np.float64) + 0.5) / (1 << 53)
        return {"n_grams": n, "log_weight": weight, "chance": chance, "gumbel_key": np.where(n > 0, weight - np.log(-np.log(u)), -2000.0)}


def fit(docs: DataFrame, labels: DataFrame, shapes: bool = True) -> Model:
    """Counts over all documents, and the line fitted to labelled rows that the target model doesn't count."""
    two = pick(docs, "doc_id", "text")
    ids, y = label_sample(labels, "quality")
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS), 0.0, 50.0, shapes)
    good = ids[share(ids, y, TARGET, {1}) & (y == 1)]

    def count(batches: Batches) -> Batches:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in K.slices(batch):
                t = K.Texts(part.column(1))
                bucket, doc = features(t, shapes)
                raw += np.bincount(bucket, minlength=BUCKETS)
                hit = np.isin(np.asarray(part.column(0).fill_null(-1)), good) & np.asarray(part.column(0).is_valid())
                if hit.any():
                    target += np.bincount(bucket[hit[doc]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at.astype(np.int32)), "raw": pa.array(raw[at]), "target": pa.array(target[at])})

    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in two.mapInArrow(tidy(count), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        raw[r[0]], target[r[0]] = r[1], r[2]
    if not target.any():
        return Model(np.zeros(BUCKETS), 0.0, 50.0, shapes)
    model = Model(np.log((target + 1) / (target + 1).sum()) - np.log((raw + 1) / (raw + 1).sum()), shapes=shapes)
    use = share(ids, y, CALIBRATION, {0, 1})
    small = F.broadcast(local_rows(two.sparkSession, doc_id=pa.array(ids[use], pa.int64()), y=pa.array(y[use], pa.int32())))

    def mean(part: pa.RecordBatch) -> dict:
        n, x = model.means(K.Texts(part.column(1)))
        return {"doc_id": part.column(0), "y": part.column(2), "x": np.where(n > 0, x, np.nan)}

    scored = arrow_map(two.join(small, "doc_id").select("doc_id", "text", "y"), "doc_id long, y int, x double", mean)
    one = scored.filter(~F.isnan("x")).groupBy("doc_id").agg(F.min("y").alias("y"), F.min_by("x", F.xxhash64("x")).alias("x"))
    rows = np.array([(r[0], r[1]) for r in one.select("y", "x").orderBy("x", "y").collect()]).reshape(-1, 2)  # one row a label, so LABEL_ROWS at most
    model.slope, model.offset = logistic(rows[:, 1], rows[:, 0])
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the chance that y is 1, by Newton's method with a small ridge."""
    if not len(y) or y.min() == y.max():
        return 0.0, 50.0
    scale = max(float(np.std(x)), 1e-9)
    a = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), a.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a column, by histograms that narrow down to it; never more than bins rows come here."""
    c, above = F.col(column), 0
    lo, hi = df.agg(F.min(c), F.max(c)).first()
    while lo < hi:
        step = (hi - lo) / bins
        held = df.filter((c >= lo) & (c <= hi)).groupBy(F.least(F.floor((c - lo) / step), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"))
        for r in sorted(held.collect(), key=lambda r: -r.lo):
            if above + r.n >= k:
                lo, hi = r.lo, r.hi
                break
            above += r.n
    return lo


def score_documents(docs: DataFrame, labels: DataFrame, k: int | None = None) -> tuple[DataFrame, Model, float]:
    """All documents' scores, written to the shared folder; the model; the smallest key that is kept."""
    model = fit(docs, labels)
    scores = written(arrow_map(pick(docs, "doc_id", "text"), SCHEMA, lambda p: {"doc_id": p.column(0)} | model.score(p.column(0), p.column(1))), "importance")
    some = scores.filter("n_grams > 0")
    k = some.filter("log_weight > 0").count() if k is None else min(k, some.count())
    return scores, model, kth_largest(some, "gumbel_key", k) if k else float("inf")


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_grams, log_weight, chance (of being target text), gumbel_key, kept."""
    scores, _, least = score_documents(docs, labels, k)
    return scores.withColumn("kept", (F.col("gumbel_key") >= F.lit(least)) & (F.col("n_grams") > 0))


def keep_sampled(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The documents that resampling keeps, with their columns."""
    _, model, least = score_documents(docs, labels, k)

    def change(part: pa.RecordBatch) -> tuple:
        s = model.score(part.column(0), part.column(1))
        return (s["gumbel_key"] >= least) & (s["n_grams"] > 0), None

    return arrow_rewrite(docs, change)

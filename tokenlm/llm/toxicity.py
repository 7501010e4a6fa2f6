"""Toxicity by a convolutional text classifier, trained in numpy.

Words (runs of ASCII letters and digits and of other scripts' characters, A-Z lower-cased) are hashed: the sum of a
table's rows for the word, twice, and for its first 4 to 8 bytes, with the fact that more follow, stands for a word,
so inflected and compound forms share rows. Filters of widths 1, 2 and 3 run over a whole text, each keeps its largest
response, and a logistic layer makes a score of them. Only the hashed words are an input; language, source, doc_id
and labels are not. Training uses the whole texts of all labelled doc_ids that aren't held out, those with
crc32(doc_id as text) mod 4 = 2; where rows repeat a doc_id, one of them counts. It starts on the driver with at most SAMPLE_ROWS
doc_ids and SAMPLE_BYTES bytes, half of each kind where there are enough, by the smallest hash of doc_id. If that isn't all,
shards of all labelled rows train on from there, each in one pass, with weights that give both kinds the start's shares, and the
mean over shards is the model. Scores are shifted from those shares to the toxic rows' share of all labelled rows. A tenth of the
labelled rows isn't trained on and sets a threshold for each language.

Nulls and texts without words are scored like a text of one unknown word without response. Repeated rows get equal
scores. A null doc_id is not held out and has no label. Labels that disagree count as toxic. Without both kinds of
labels, every score is the share of toxic rows, or 0 without labels. An empty table gives an empty result. Columns but doc_id, text and lang are not read.
"""

from __future__ import annotations

import copy
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlm.llm import kernel as K
from tokenlm.llm.frames import Batches, arrow_map, pick
from tokenlm.llm.session import local_rows, tidy

ROWS, SIZE, FILTERS, WIDTHS, PREFIXES = 1 << 18, 8, 8, (1, 2, 3), (4, 5, 6, 7, 8)
SAMPLE_ROWS, SAMPLE_BYTES, EPOCHS, BATCH, RATE = 4_000, 64 << 20, 6, 64, 0.1
#: Rows of a shard of the labelled rows, the most shards, labels that are broadcast (else joined), and cells of scores for thresholds.
SHARD_ROWS, SHARDS, BROADCAST_ROWS, CELLS = 4_000, 32, 1_000_000, 4_096
#: Scores at or over this are called toxic by the query; flagged follows the language's own threshold.
THRESHOLD = 0.3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, threshold double, flagged boolean"


def encode(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of each word of all texts, and the number of each text's words. Row 0 stands for no prefix."""
    words = K.Texts(col, lower=True).runs(K.ALNUM)
    h = words.hashes()
    out = np.zeros((len(h), 2 + len(PREFIXES)), np.int32)
    out[:, 0], out[:, 1] = h & K.U(ROWS - 1), h >> K.U(64 - 18)
    size = words.ends - words.starts
    for i, k in enumerate(PREFIXES, 2):
        at = np.flatnonzero(size >= k)
        start = words.starts[at]
        part = K.Spans(words.texts, start, start + k).hashes() + (size[at] > k).astype(K.U)
        out[at, i] = K.mix(part) & K.U(ROWS - 1)
    return out, words.per_text()


class Net:
    """The classifier. Row 0 of the table stands for padding and stays 0."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.p = {"e": r.normal(0, 0.01, (ROWS, SIZE)), "v": r.normal(0, 0.3, len(WIDTHS) * FILTERS), "c": np.zeros(1), "b": np.zeros(len(WIDTHS) * FILTERS)}
        self.p |= {f"w{w}": r.normal(0, 0.5 / w**0.5, (w, SIZE, FILTERS)) for w in WIDTHS}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["e"][0] = 0
        self.g = {k: np.full_like(v, 1e-3) for k, v in self.p.items()}
        self.shift, self.thresholds, self.constant = 0.0, {}, None

    def rows(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Table rows with padding after each text, the texts' first places, and which places are no padding."""
        room = np.maximum(counts, 1) + max(WIDTHS) - 1
        starts = np.concatenate([[0], np.cumsum(room)])
        ids, real = np.zeros((int(starts[-1]), words.shape[1]), np.int32), np.zeros(int(starts[-1]), bool)
        before = np.cumsum(counts) - counts
        at = np.arange(len(words)) + np.repeat(starts[:-1] - before, counts)
        ids[at] = words
        real[at] = real[starts[:-1]] = True
        return ids, starts[:-1], real

    def forward(self, ids: np.ndarray, starts: np.ndarray, real: np.ndarray) -> tuple:
        e = self.p["e"]
        x = e[ids[:, 0]]
        for i in range(1, ids.shape[1]):
            x += e[ids[:, i]]
        n = len(x)
        y = np.zeros((n, len(WIDTHS) * FILTERS), x.dtype)
        for i, w in enumerate(WIDTHS):
            part = y[:, i * FILTERS : (i + 1) * FILTERS]
            for j in range(w):
                part[: n - j] += x[j:] @ self.p[f"w{w}"][j]
        y[~real] = -np.inf
        top = np.maximum.reduceat(y, starts)
        on = np.maximum(top + self.p["b"], 0)
        return x, y, top, on, on @ self.p["v"] + self.p["c"][0]

    def scores(self, col: pa.Array) -> np.ndarray:
        words, counts = encode(col)
        if not len(counts):
            return np.zeros(0)
        if self.constant is not None:
            return np.full(len(counts), self.constant)
        z = self.forward(*self.rows(words, counts))[-1].astype(np.float64) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def gradients(self, words: np.ndarray, counts: np.ndarray, label: np.ndarray, weight: np.ndarray | float = 1.0) -> tuple[dict, np.ndarray, np.ndarray]:
        """Of the mean log loss, by the texts' weights: by the parameters but the table, and the table's rows that it touches with theirs."""
        ids, starts, real = self.rows(words, counts)
        x, y, top, on, z = self.forward(ids, starts, real)
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * weight / len(label)).astype(x.dtype)
        don = dz[:, None] * self.p["v"] * (on > 0)
        doc = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
        at, f = np.nonzero(y == top[doc])
        _, first = np.unique(doc[at] * y.shape[1] + f, return_index=True)
        at, f = at[first], f[first]
        g = don[doc[at], f]
        hit = g != 0
        at, f, g = at[hit], f[hit], g[hit]
        grad = {"v": on.T @ dz, "c": dz.sum(keepdims=True), "b": don.sum(0)}
        touched, back = [], []
        for i, w in enumerate(WIDTHS):
            mine = f // FILTERS == i
            p, k, s = at[mine], f[mine] % FILTERS, g[mine]
            grad[f"w{w}"] = np.zeros_like(self.p[f"w{w}"])
            for j in range(w):
                one = np.zeros((FILTERS, SIZE), x.dtype)
                np.add.at(one, k, x[p + j] * s[:, None])
                grad[f"w{w}"][j] = one.T
                touched.append(p + j)
                back.append(self.p[f"w{w}"][j].T[k] * s[:, None])
        place, dx = np.concatenate(touched), np.concatenate(back)
        rows, inverse = np.unique(ids[place].ravel(), return_inverse=True)
        d = np.zeros((len(rows), SIZE), x.dtype)
        np.add.at(d, inverse, np.repeat(dx, ids.shape[1], 0))
        d[rows == 0] = 0
        return grad, rows, d

    def step(self, words: np.ndarray, counts: np.ndarray, label: np.ndarray, weight: np.ndarray | float = 1.0) -> np.ndarray:
        """One update; the table's rows that it changes."""
        grad, rows, d = self.gradients(words, counts, label, weight)
        self.g["e"][rows] += d * d
        self.p["e"][rows] -= RATE * d / np.sqrt(self.g["e"][rows])
        for k, d in grad.items():
            self.g[k] += d * d
            self.p[k] -= RATE * d / np.sqrt(self.g[k])
        return rows

    def dense(self) -> np.ndarray:
        """All parameters but the table, in rows of its width."""
        flat = np.concatenate([self.p[k].ravel() for k in sorted(self.p) if k != "e"])
        return np.concatenate([flat, np.zeros(-len(flat) % SIZE, flat.dtype)]).reshape(-1, SIZE)

    def put(self, place: np.ndarray, rows: np.ndarray) -> None:
        """Rows of the table, and from ROWS on those of dense."""
        some = place < ROWS
        self.p["e"][place[some]] = rows[some]
        flat, at = self.dense(), 0
        flat[place[~some] - ROWS] = rows[~some]
        for k in sorted(self.p):
            if k != "e":
                self.p[k] = flat.ravel()[at : at + self.p[k].size].reshape(self.p[k].shape).copy()
                at += self.p[k].size

    def train(self, texts: list[np.ndarray], label: np.ndarray, seed: int = 5) -> None:
        order = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            deal = order.permutation(len(texts))
            for i in range(0, len(deal), BATCH):
                some = deal[i : i + BATCH]
                self.step(np.concatenate([texts[k] for k in some]), np.array([len(texts[k]) for k in some]), label[some])


def held_out(ids: pa.Array) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids.to_pylist()], bool)


def chosen(docs: DataFrame, ids: list[tuple[int, int]]) -> pa.Table:
    """doc_id, text, lang and y of the sampled doc_ids, in order: one row of each, and no more than SAMPLE_BYTES of text."""
    return start_rows(docs, ids)[0]


def start_rows(docs: DataFrame, ids: list[tuple[int, int]]) -> tuple[pa.Table, bool]:
    """The rows of chosen, and whether all texts fitted into the bound.

    Sizes come first, a row for each sampled doc_id, and only texts that fit into the bound are fetched."""
    spark, size = docs.sparkSession, F.octet_length(F.coalesce("text", F.lit("")))
    one = lambda some: docs.join(F.broadcast(local_rows(spark, doc_id=pa.array([i for i, _ in some], pa.int64()), y=pa.array([y for _, y in some], pa.int32()))), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "lang", "y", size.alias("size")), F.xxhash64("text", "lang")).alias("r"))
    sizes = {r[0]: r[1] for r in one(ids).select("doc_id", "r.size").collect()}
    room, fits = {0: SAMPLE_BYTES // 2, 1: SAMPLE_BYTES // 2}, []
    for i, y in ids:
        if i in sizes and sizes[i] <= room[y]:
            room[y] -= sizes[i]
            fits.append((i, y))
    if not fits:
        return pa.table({"doc_id": pa.array([], pa.int64())}), not sizes
    return one(fits).select("doc_id", "r.text", "r.lang", "r.y").toArrow().combine_chunks().sort_by("doc_id"), len(fits) == len(sizes)


def fit(docs: DataFrame, labels: DataFrame) -> Net:
    """A classifier trained on the labelled rows that aren't held out."""
    one = pick(labels, "doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").alias("y"))
    free = one.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    total = {r[0]: r[1] for r in free.groupBy("y").count().collect()}
    net = Net()
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad or not good:
        net.constant = float(bad > 0)
        return net
    half = max(SAMPLE_ROWS // 2, SAMPLE_ROWS - min(bad, good))
    ids = [(int(r[0]), int(r[1])) for y in (0, 1) for r in free.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half).collect()]
    three = pick(docs, "doc_id", "text", "lang")
    rows, fitted = start_rows(three, ids)
    if not rows.num_rows:
        net.constant = bad / (bad + good)
        return net
    y = np.asarray(rows["y"]).astype(np.float32)
    texts = []
    for batch in rows.select(["text"]).to_batches():
        for part in K.slices(batch):
            words, counts = encode(part.column(0))
            texts += np.split(words, np.cumsum(counts)[:-1])
    aside = np.array([zlib.crc32(f"aside{i}".encode()) % 10 == 0 for i in rows["doc_id"].to_pylist()], bool)
    use = np.flatnonzero(~aside)
    if not len(use) or y[use].min() == y[use].max():
        net.constant = bad / (bad + good)
        return net
    net.train([texts[i] for i in use], y[use])
    share = float(y[use].mean())
    net.shift = float(np.log(bad / good) - np.log(share / (1 - share)))
    if not fitted or len(ids) < bad + good:
        go_on(net, three, free, bad, good, share)
        return net
    langs, z = rows["lang"].to_pylist(), np.zeros(0)
    held = np.flatnonzero(aside)
    if len(held):
        z = net.forward(*net.rows(np.concatenate([texts[i] for i in held]), np.array([len(texts[i]) for i in held])))[-1] + net.shift
    s = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))
    for lang in {langs[i] for i in held}:
        mine = np.array([langs[i] == lang for i in held])
        net.thresholds[lang] = best_threshold(s[mine], y[held][mine])
    return net


def labelled(docs: DataFrame, free: DataFrame, n: int) -> DataFrame:
    """Rows of docs with a label: y, h (by which one of a doc_id's rows counts, the least) and aside (not trained on). free: n rows."""
    some = free.filter("y IN (0, 1)").select("doc_id", F.col("y").cast("int").alias("y"))
    joined = docs.join(F.broadcast(some) if n <= BROADCAST_ROWS else some, "doc_id")
    aside = F.crc32(F.concat(F.lit("aside"), F.col("doc_id").cast("string"))) % 10 == 0
    return joined.select("doc_id", "text", "lang", "y", F.xxhash64("text", "lang").alias("h"), aside.alias("aside"))


def go_on(net: Net, docs: DataFrame, free: DataFrame, bad: int, good: int, share: float) -> None:
    """Trains the started net on over all labelled rows, in shards, and sets thresholds from all rows aside. share: of toxic rows at the start."""
    n, kind = bad + good, net.p["e"].dtype
    shards = min(SHARDS, -(-n // SHARD_ROWS))
    weights = np.array([(1 - share) * n / good, share * n / bad], kind)
    every = labelled(docs, free, n)
    dealt = every.filter("NOT aside").select("doc_id", "text", "y", "h", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), F.xxhash64(F.lit(7), "doc_id").alias("place"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "place", "doc_id", "h").select("shard", "doc_id", "y", "text")

    def train(batches: Batches) -> Batches:
        own, last, at, texts, label = None, None, None, [], []
        touched = np.zeros(ROWS, bool)

        def step() -> None:
            y = np.array(label)
            touched[own.step(np.concatenate(texts), np.array([len(t) for t in texts]), y.astype(kind), weights[y])] = True
            texts.clear()
            label.clear()

        def done() -> pa.RecordBatch:
            if texts:
                step()
            k = np.flatnonzero(touched)
            dense = own.dense()
            rows = np.concatenate([own.p["e"][k], dense])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([k, ROWS + np.arange(len(dense))]).astype(np.int32)), *[pa.array(rows[:, i].astype(np.float32)) for i in range(SIZE)]], names)

        for batch in batches:
            for part in K.slices(batch):
                words, counts = encode(part.column(3))
                cut = np.split(words, np.cumsum(counts)[:-1])
                for shard, doc_id, y, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), cut, strict=True):
                    if shard != at:
                        if own is not None:
                            yield done()
                        own, at, last = copy.deepcopy(net), shard, None
                        touched[:] = False
                    if doc_id == last:
                        continue
                    last = doc_id
                    texts.append(t)
                    label.append(y)
                    if len(texts) == BATCH:
                        step()
        if own is not None:
            yield done()

    names = ["k", *[f"e{i}" for i in range(SIZE)]]
    mean = dealt.mapInArrow(tidy(train), "k int, " + ", ".join(f"{c} float" for c in names[1:])).groupBy("k").agg(*[F.avg(c).cast("float").alias(c) for c in names[1:]]).toArrow()
    if mean.num_rows:
        net.put(np.asarray(mean["k"]), np.stack([np.asarray(mean[c]) for c in names[1:]], 1).astype(kind))
    net.g = {}
    held = every.filter("aside").select("doc_id", "text", "lang", "y", "h")
    scored = arrow_map(held, "doc_id long, lang string, y int, h long, cell int", lambda p: {"doc_id": p.column(0), "lang": p.column(2), "y": p.column(3), "h": p.column(4), "cell": np.minimum(net.scores(p.column(1)) * CELLS, CELLS - 1).astype(np.int32)})
    one = scored.groupBy("doc_id").agg(F.min_by(F.struct("lang", "y", "cell"), "h").alias("r"))
    found = one.groupBy("r.lang", "r.cell", "r.y").count().toArrow()
    langs = found["lang"].to_pylist()
    cell, y, times = (np.asarray(found[c]) for c in ("cell", "y", "count"))
    for lang in set(langs):
        mine = np.array([x == lang for x in langs])
        net.thresholds[lang] = best_threshold((cell[mine] + 0.5) / CELLS, y[mine] > 0, times[mine])


def best_threshold(score: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> float:
    """The middle of the widest range of thresholds with the best F1; THRESHOLD if either kind is missing. times: how often each row counts."""
    times = np.ones(len(y)) if times is None else times.astype(float)
    if not (0 < (times * y).sum() < times.sum()):
        return THRESHOLD
    edges = np.unique(np.concatenate([[0.0], score, [1.0]]))
    middle = (edges[1:] + edges[:-1]) / 2
    order = np.argsort(score, kind="stable")
    above = lambda w: np.concatenate([np.cumsum(w[order][::-1])[::-1], [0.0]])[np.searchsorted(score[order], middle)]
    f1 = 2 * above(times * y) / (above(times) + (times * y).sum())
    best = np.flatnonzero(f1 == f1.max())
    return float(middle[best[np.argmax((edges[1:] - edges[:-1])[best])]])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted at THRESHOLD, and the language's threshold and verdict."""
    net = fit(docs, labels)
    net.g = {}

    def make(part: pa.RecordBatch) -> dict:
        score = net.scores(part.column(1))
        own = np.array([net.thresholds.get(x, THRESHOLD) for x in part.column(2).to_pylist()])
        return {"doc_id": part.column(0), "held_out": held_out(part.column(0)), "score": score, "predicted": (score >= THRESHOLD).astype(np.int32), "threshold": own, "flagged": score >= own}

    return arrow_map(pick(docs, "doc_id", "text", "lang"), SCHEMA, make)

"""Labels of positions by how often their context occurs, where one shuffled row per position would be larger than the texts.

A task cuts its documents into runs of RUN tokens. Of each run, a bucket of contexts gets one compressed cell: its
contexts, each once with its count in the run, and its positions as steps in the order of the run. Cells of a bucket
meet in one task, which sums the counts and labels the positions. The last bin is open, so a context that exceeds its
edge within a run needs no other count: such a run sends the count to the bucket and labels its own positions, and
no bucket holds more than that edge's number of positions of a context and run.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlm.functions.scalars import BINS
from tokenlm.operators.tokens import PATTERN
from tokenlm.sources.shared import bounded

RUN = 1 << 21
_ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")


def _narrow(x: np.ndarray) -> np.ndarray:
    """The numbers, not negative, in as few bytes as the largest needs."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int64)


def _packed(columns: dict[str, pa.Array]) -> bytes:
    """Arrays of any lengths as one compressed row of lists."""
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in columns.values()], list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_ZSTD) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(cell: bytes) -> dict[str, pa.Array]:
    batch = pa.ipc.open_stream(cell).read_next_batch()
    return {n: c.flatten() for n, c in zip(batch.schema.names, batch.columns, strict=True)}


def _cells(corpus: list, doc: list, sizes: np.ndarray, tokens: pa.Array, buckets: int, salt: int) -> Iterator[tuple[int, bytes]]:
    """Cells of a run: bucket and bytes. Tokens of a document are in a row; sizes: how many each has."""
    coded = tokens.dictionary_encode()
    code, words = np.asarray(coded.indices).astype(np.int64), coded.dictionary
    names = list(dict.fromkeys(corpus))
    of_doc = np.array([names.index(c) for c in corpus], np.int64)
    start = np.cumsum(sizes) - sizes
    at = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(code)) - start[at]
    v = len(words) + 1  # code of no token: v - 1
    p1 = np.where(place >= 1, np.roll(code, 1), v - 1)
    p2 = np.where(place >= 2, np.roll(code, 2), v - 1)
    shorter = ((of_doc[at] * v + v - 1) * v + p1)[place >= 2]  # a token counts as a context wherever one follows it
    key, which, count = np.unique(np.concatenate([(of_doc[at] * v + p2) * v + p1, shorter]), return_inverse=True, return_counts=True)
    which = which[: len(code)]
    k1, k2, kc = key % v, key // v % v, key // v // v
    n = 1 + (k1 < v - 1) + (k2 < v - 1)
    lost = np.array([c is None for c in names])[kc]  # no corpus: no context is its own
    sure = (n == 1) | (count > BINS[-1]) | lost
    h = np.array([zlib.crc32(w.encode()) for w in words.to_pylist()] + [0], np.uint64)
    hc = np.array([zlib.crc32(str(c).encode()) for c in names], np.uint64)[kc]
    mixed = (h[k2] * np.uint64(0x9E3779B97F4A7C15) + h[k1] * np.uint64(0xC2B2AE3D27D4EB4F) + hc) * np.uint64(0xFF51AFD7ED558CCD)
    own = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    padded = pa.concat_arrays([words.cast(pa.string()), pa.array([""], pa.string())])
    text = pc.if_else(pa.array(n == 3), pc.binary_join_element_wise(padded.take(pa.array(k2)), padded.take(pa.array(k1)), " "), padded.take(pa.array(k1)))
    # Positions that are labelled already go where the run says, the others to their context's bucket.
    goes = np.where(sure, salt % buckets, own)[which]
    order = np.argsort(goes, kind="stable")
    cuts = np.searchsorted(goes[order], np.arange(buckets + 1))
    entries = np.argsort(own, kind="stable")
    entry_cuts = np.searchsorted(own[entries], np.arange(buckets + 1))
    ids = pa.array(doc, pa.int64())
    for b in range(buckets):
        places, mine = order[cuts[b] : cuts[b + 1]], entries[entry_cuts[b] : entry_cuts[b + 1]]
        mine = mine[(n[mine] > 1) & ~lost[mine]]
        if not len(places) and not len(mine):
            continue
        met, number = np.unique(which[places], return_inverse=True)
        sums = pa.array(mine)
        of_place = at[places]
        docs, doc_number = np.unique(of_place, return_inverse=True)
        known = sure[met]
        # A position's context: its place among the cell's contexts, or the label's number after them.
        spot = np.where(known, len(mine) + np.where((n[met] == 1) | lost[met], 0, n[met] - 1), np.searchsorted(mine, met))
        yield b, _packed({
            "names": pa.array(names, pa.string()), "corpus": pa.array(_narrow(kc[mine])), "text": text.take(sums), "n": pa.array(n[mine].astype(np.uint8)), "count": pa.array(_narrow(count[mine])),
            "doc": ids.take(pa.array(docs)), "doc_corpus": pa.array(_narrow(of_doc[docs])), "held": pa.array(_narrow(np.bincount(doc_number, minlength=len(docs)))),
            "step": pa.array(_narrow(np.where(np.diff(of_place, prepend=-1) != 0, place[places], np.diff(place[places], prepend=0)))), "spot": pa.array(_narrow(spot[number])),
        })


def _labels(n: np.ndarray, total: np.ndarray) -> pa.Array:
    names = [",empty"] + [f",total{k}{b}" for k in (1, 2) for b in [*(f"<={x}" for x in BINS), f">{BINS[-1]}"]]
    bins = np.searchsorted(np.array(BINS), total)
    return pa.DictionaryArray.from_arrays(pa.array(np.where(n < 2, 0, 1 + (n - 2) * (len(BINS) + 1) + bins).astype(np.int32)), pa.array(names))


def _labelled(cells: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The positions of a bucket's cells, with their labels."""
    kept = [_unpacked(c) for c in cells]
    parts = [pa.table({"corpus": c["names"].take(c["corpus"].cast(pa.int64())), "text": c["text"], "count": c["count"].cast(pa.int64()), "n": c["n"].cast(pa.int64())}) for c in kept]
    every = pa.concat_tables(parts).combine_chunks()
    corpus, text = (pc.dictionary_encode(every[c].combine_chunks()) for c in ("corpus", "text"))
    pair = np.asarray(corpus.indices).astype(np.int64) * max(1, len(text.dictionary)) + np.asarray(text.indices)
    _, which = np.unique(pair, return_inverse=True)
    total = np.bincount(which, np.asarray(every["count"])).astype(np.int64)[which] if len(pair) else np.zeros(0, np.int64)
    n, at = np.asarray(every["n"]), 0
    for c in kept:
        size = len(c["text"])
        label = _labels(np.concatenate([n[at : at + size], [1, 2, 3]]), np.concatenate([total[at : at + size], [0, BINS[-1] + 1, BINS[-1] + 1]]))
        at += size
        if not len(c["step"]):
            continue
        held = np.asarray(c["held"]).astype(np.int64)
        step = np.cumsum(np.asarray(c["step"]).astype(np.int64))
        first = np.cumsum(held) - held
        base = np.where(first > 0, step[first - 1], 0)
        pos = step - np.repeat(base, held) + 1
        doc = pa.array(np.repeat(np.arange(len(held)), held))
        names = c["names"].take(c["doc_corpus"].cast(pa.int64()))
        note = label.take(c["spot"].cast(pa.int64())).dictionary_decode()
        ids = c["doc"].take(doc)
        note = pc.if_else(ids.is_valid(), note, ",empty")
        whole = pa.RecordBatch.from_arrays([names.take(doc), ids, pa.array(pos), note], ["corpus", "doc", "pos", "annotation"])
        for i in range(0, whole.num_rows, 1 << 16):
            yield whole.slice(i, 1 << 16)


def context_bins(docs: DataFrame, run: int = RUN) -> DataFrame:
    """corpus, doc, pos and annotation of each token: ,total<k><=bin of its longest context of up to two tokens, ,empty without
    one. docs: corpus, doc, text. A position whose corpus or doc is null has no context."""
    bounded(docs.sparkSession)
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        corpus, doc, sizes, tokens, seen, salt = [], [], [], [], 0, TaskContext.get().partitionId()

        def flush() -> Iterator[pa.RecordBatch]:
            for b, cell in _cells(corpus, doc, np.concatenate(sizes), pa.concat_arrays(tokens), buckets, salt):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([cell], pa.binary())], ["bucket", "cell"])

        for batch in batches:
            t = batch.column(2)
            corpus += batch.column(0).to_pylist()
            doc += batch.column(1).to_pylist()
            sizes.append(np.asarray(pc.fill_null(pc.list_value_length(t), 0)).astype(np.int64))
            tokens.append(t.flatten())
            seen += len(tokens[-1])
            if seen >= run:
                yield from flush()
                corpus, doc, sizes, tokens, seen, salt = [], [], [], [], 0, salt + 1
        if seen:
            yield from flush()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, cells = None, []
        for batch in batches:
            for b, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != bucket and cells:
                    yield from _labelled(cells)
                    cells = []
                bucket = b
                cells.append(cell.as_py())
        if cells:
            yield from _labelled(cells)

    lexed = docs.select("corpus", F.col("doc").cast("long").alias("doc"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("t"))
    cells = lexed.mapInArrow(cut, "bucket int, cell binary").repartition(buckets // 2, "bucket").sortWithinPartitions("bucket")
    return cells.mapInArrow(label, "corpus string, doc long, pos long, annotation string")

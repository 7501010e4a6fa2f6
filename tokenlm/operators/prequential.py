"""Counts as they stood before each position when all positions are counted in one order.

Sums over earlier rows go in two levels, blocks of positions and places within a block, for the whole corpus as for a
single n-gram or context, so that no task orders all occurrences of a common token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenlm.operators.tokens import PATTERN, lex
from tokenlm.sources.shared import bounded, written

BLOCK = 4096


def numbered(tokens: DataFrame) -> DataFrame:
    """Adds g, the position's number in the corpus: documents in the order of doc."""
    sizes = tokens.groupBy("corpus", "doc").agg(F.count("*").alias("n"))
    starts = running_total(sizes, "doc", "n", "start").drop("n")
    return tokens.join(starts, ["corpus", "doc"]).withColumn("g", F.col("start") + F.col("pos")).drop("start")


def running_total(rows: DataFrame, order: str, value: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """Adds out: the sum of value over earlier rows of the same keys, by blocks of order."""
    return running_totals(rows, order, {out: F.col(value)}, keys or ["corpus"])


def running_totals(rows: DataFrame, order: str, values: dict[str, Column], keys: list[str]) -> DataFrame:
    """Adds for each name the sum of its value over earlier rows of the same keys, all in one pass."""
    rows = rows.withColumn("block", F.floor(F.col(order) / BLOCK))
    blocks = rows.groupBy(*keys, "block").agg(*[F.sum(v).alias(f"{out}_sum") for out, v in values.items()])
    over = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(*keys, "block", *[F.coalesce(F.sum(f"{out}_sum").over(over), F.lit(0)).alias(f"{out}_before") for out in values])
    inside = Window.partitionBy(*keys, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(before, [*keys, "block"])
    return joined.withColumns({out: F.col(f"{out}_before") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for out, v in values.items()}).drop("block", *[f"{out}_before" for out in values])


def counts_before(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """c, total, followers, kn and kn_total of each gram before its position. rows: grams; numbers: corpus, doc, pos, g."""
    r = rows.join(numbers.select("corpus", "doc", "pos", "g"), ["corpus", "doc", "pos"])
    gram, context, one = ["corpus", "n", "ngram"], ["corpus", "n", "ctx"], F.lit(1).cast("long")
    r = written(running_totals(r, "g", {"c": one}, gram).withColumn("new", (F.col("c") == 0).cast("long")), "counted_before")
    above = r.filter("n > 1").select("corpus", "g", (F.col("n") - 1).alias("n"), F.col("new").alias("up"))
    r = r.join(above, ["corpus", "g", "n"], "left").withColumn("kd", F.when(F.col("whole"), 1).otherwise(F.coalesce("up", F.lit(0))).cast("long"))
    r = running_totals(r, "g", {"kn": F.col("kd")}, gram)
    r = running_totals(r, "g", {"total": one, "followers": F.col("new"), "kn_total": F.col("kd")}, context)
    return r.select("corpus", "doc", "pos", "g", "n", "ngram", "c", "total", "followers", "kn", "kn_total")


def _earlier(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """How many earlier rows have the same key, and the sums of the values over them."""
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1) != 0)
    length = np.diff(np.append(first, len(key)))
    out = []
    for v in (np.ones(len(key), np.int64), *values):
        sums = np.cumsum(v[order]) - v[order]
        one = np.empty(len(key), np.int64)
        one[order] = sums - np.repeat(sums[first], length)
        out.append(one)
    return out


_PAIRS = ["corpus", "g", "pos", "p2", "p1", "token"]
_LEVELS = ["c2", "total2", "followers2", "kn2", "kn_total2", "c3", "total3", "followers3", "kd1"]


def _pairs(rows: pa.Table) -> pa.RecordBatch:
    """_LEVELS of whole groups of one corpus and p1, each in the order of g: what a bigram and a trigram count sits in its group."""
    code = {n: np.asarray(rows[n].combine_chunks().dictionary_encode().indices.fill_null(-1)).astype(np.int64) + 1 for n in ("corpus", "p2", "p1", "token")}
    far = np.asarray(rows["pos"]) >= 3
    dense = lambda a, b: np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int64)
    group = dense(code["corpus"], code["p1"])
    pair, context = dense(group, code["token"]), dense(group, code["p2"])
    three = dense(context, code["token"])[far]
    wide = [np.full(len(far), -1, np.int64) for _ in range(3)]
    new3 = np.zeros(len(far), np.int64)
    (c3,) = _earlier(three)
    new3[far] = c3 == 0
    total3, followers3 = _earlier(context[far], new3[far])
    for out, x in zip(wide, (c3, total3, followers3), strict=True):
        out[far] = x
    kd2 = np.where(far, new3, 1)
    c2, kn2 = _earlier(pair, kd2)
    new2 = (c2 == 0).astype(np.int64)
    total2, followers2, kn_total2 = _earlier(group, new2, kd2)
    levels = [c2, total2, followers2, kn2, kn_total2, *wide, new2]
    return pa.RecordBatch.from_arrays([*[rows[n].combine_chunks() for n in _PAIRS], *map(pa.array, levels)], [*_PAIRS, *_LEVELS])


def _by_groups(batches: Iterator[pa.RecordBatch], least: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """_pairs of sorted rows, of some whole groups at a time. A group is held at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        rows = pa.Table.from_batches(held)
        last = [rows[n][-1] for n in ("corpus", "p1")]
        corpus, p1 = (np.asarray(pc.equal(rows[n], x)) for n, x in zip(("corpus", "p1"), last, strict=True))
        end = int(np.argmax(corpus & p1))  # the last group may go on
        if end:
            out = _pairs(rows.slice(0, end))
            yield from (out.slice(i, 1 << 15) for i in range(0, end, 1 << 15))
            held = rows.slice(end).combine_chunks().to_batches()
        elif len(held) > 64:
            held = rows.combine_chunks().to_batches()
    if held:
        out = _pairs(pa.Table.from_batches(held))
        yield from (out.slice(i, 1 << 15) for i in range(0, out.num_rows, 1 << 15))


def trigrams_before(docs: DataFrame) -> DataFrame:
    """counts_before of all grams of up to three tokens: corpus, g, n, ngram and the five counts. docs: corpus, doc, text.

    Documents are numbered before their tokens are listed. A bigram and a trigram meet all that they count where the middle
    token does, in one shuffle; only single tokens take another, and running sums by blocks for the empty context."""
    bounded(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.filter("corpus IS NOT NULL AND doc IS NOT NULL")  # such rows have no place in the order
    sizes = docs.groupBy("corpus", "doc").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))).alias("n")).filter("n > 0")
    starts = running_total(written(sizes, "sizes"), "doc", "n", "start").drop("n")
    tokens = lex(docs.join(starts, ["corpus", "doc"]).select("corpus", "start", "text"), before=2).withColumn("g", F.col("start") + F.col("pos"))
    tokens = tokens.select(*_PAIRS)
    dealt = tokens.filter("pos > 1").repartition(n, "corpus", "p1").sortWithinPartitions("corpus", "p1", "g")
    schema = "corpus string, g long, pos long, p2 string, p1 string, token string, " + ", ".join(f"{c} long" for c in _LEVELS)
    pairs = written(dealt.mapInArrow(_by_groups, schema), "pairs")
    ones = pairs.select("corpus", "g", "token", "kd1").union(tokens.filter("pos = 1").select("corpus", "g", "token", F.lit(1).cast("long")))
    same = Window.partitionBy("corpus", "token").orderBy("g")
    ones = ones.withColumn("c", (F.row_number().over(same) - 1).cast("long")).withColumn("kn", F.coalesce(F.sum("kd1").over(same.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ones = running_totals(written(ones, "ones"), "g", {"followers": (F.col("c") == 0).cast("long"), "kn_total": F.col("kd1")}, ["corpus"])
    out = ones.select("corpus", "g", F.lit(1).alias("n"), F.col("token").alias("ngram"), "c", (F.col("g") - 1).alias("total"), "followers", "kn", "kn_total")
    two = F.struct(F.lit(2).alias("n"), F.concat_ws(" ", "p1", "token").alias("ngram"), *[F.col(f"{c}2").alias(c) for c in ("c", "total", "followers", "kn", "kn_total")])
    three = F.struct(F.lit(3).alias("n"), F.concat_ws(" ", "p2", "p1", "token").alias("ngram"), *[F.col(f"{c}3").alias(d) for c, d in (("c", "c"), ("total", "total"), ("followers", "followers"), ("c", "kn"), ("total", "kn_total"))])
    return out.union(pairs.select("corpus", "g", F.explode(F.array(two, three)).alias("x")).select("corpus", "g", "x.*").filter("c >= 0"))


def entropy(before: DataFrame, order: int, discount: float = 0.5) -> DataFrame:
    """Mean -ln p of each position under the counts before it, with one discount; the vocabulary before it counts one token more."""
    wide = before.groupBy("corpus", "g").agg(F.max("n").alias("top"), *[F.max(F.when(F.col("n") == n, F.struct("c", "total", "followers", "kn", "kn_total"))).alias(f"l{n}") for n in range(1, order + 1)])
    p = 1 / (F.col("l1.followers") + 1)
    for n in range(1, order + 1):
        s = F.col(f"l{n}")
        x = s["c"] if n == order else s["kn"]
        t = s["total"] if n == order else s["kn_total"]
        level = (F.greatest(x - discount, F.lit(0.0)) + discount * s["followers"] * p) / t
        p = F.when(s.isNotNull() & (t > 0), level).otherwise(p)
    return wide.groupBy("corpus").agg(F.count("*").alias("n_tokens"), F.avg(-F.log(p)).alias("entropy"))


def sampled(tokens: DataFrame, period: int, most: int | None = None) -> DataFrame:
    """Every period-th position of the corpus in order, up to most of them."""
    rows = numbered(tokens).filter((F.col("g") - 1) % period == 0)
    return rows if most is None else rows.filter(F.col("g") <= period * most)

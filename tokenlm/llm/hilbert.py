"""Sharding along a Hilbert curve over metadata, for files that can be pruned by several columns.

Columns are quantised to BITS bits: numbers by the logarithm of their size, strings by their rank among the column's distinct
values, however many there are: a range sort numbers the values, and the first value of each cell (2^BITS - 2 at most) comes
to the driver. Either keeps the column's order. The cell's index on the curve orders the documents, ties by
doc_id and the text's checksum, and runs of that order are cut so that shards' counts differ by one at most (law
rows). Neighbours on the curve are neighbours in every column, so a shard covers few cells and its ranges prune well.

The order is a distributed range sort, written to the shared folder; a row's rank is its place in its sorted
partition plus the counts of earlier ones. Nulls in a column have the lowest cell; a null text has 16 bytes like an
empty one. Repeated rows get places of their own, in any order among themselves. An empty table gives an empty
result. Columns but those named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenlm.llm.frames import Batches, pick
from tokenlm.llm.session import tidy, written

SHARDS, BITS, ROW_BYTES = 40, 6, 16
NUMBERS, STRINGS = ("n_chars",), ("lang", "source")


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of points with coordinates of so many bits, one point per row; Skilling's transform, vectorised."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = x[i] & q > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[n - 1] & q > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> bit & 1)
    return out


def number_cell(c: Column, bits: int = BITS) -> Column:
    """Two cells to a doubling, from 1 up; 0 for nulls."""
    size = F.log2(F.greatest(c.cast("double"), F.lit(0.0)) + 1)
    return F.when(c.isNull(), 0).otherwise(F.least(F.floor(size * 2) + 1, F.lit((1 << bits) - 1))).cast("long")


def numbered(rows: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame, int]:
    """Rows with their rank in the order of keys, as written; the ranks' starts by part of the sort, and how many rows there are."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    kept = written(placed, name)
    total, starts = 0, []
    for r in sorted(kept.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n")).collect()):  # a row for each part of the sort
        starts.append((r.part, total))
        total += r.n
    small = F.broadcast(rows.sparkSession.createDataFrame(starts, "part int, before long"))
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)
    return kept.join(small, F.shiftright("place", 33) == F.col("part")).withColumn("rank", rank).drop("part", "before"), kept, total


def first_values(df: DataFrame, column: str, bits: int = BITS) -> list[tuple[int, str]]:
    """The first value of each cell, in order, if the column's distinct values fall into 2^bits - 1 cells by rank."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    ranked, _, total = numbered(values, [column], "values")
    room = (1 << bits) - 1
    cell = lambda rank: F.floor(rank * room / F.lit(max(total, 1)))
    starts = ranked.filter((F.col("rank") == 0) | (cell(F.col("rank")) > cell(F.col("rank") - 1))).select(cell(F.col("rank")).alias("cell"), column)
    return [(int(r[0]), r[1]) for r in starts.orderBy("cell").collect()]


def string_cell(c: Column, starts: list[tuple[int, str]]) -> Column:
    """One more than the cell of the last first value that isn't larger; 0 for nulls."""
    if not starts:
        return F.lit(0).cast("long")
    known = F.array(*[F.lit(v) for _, v in starts])
    cells = F.array(*[F.lit(k + 1).cast("long") for k, _ in starts])
    return F.when(c.isNull(), F.lit(0).cast("long")).otherwise(F.element_at(cells, F.greatest(F.size(F.filter(known, lambda v: v <= c)), F.lit(1))))


def curved(docs: DataFrame, numbers: tuple = NUMBERS, strings: tuple = STRINGS, bits: int = BITS, whole: bool = False) -> DataFrame:
    """Documents with size, text_crc32, the named columns and curve; whole: with all columns, as a struct."""
    rows = pick(docs, "doc_id", "text", *numbers, *strings)
    if whole:
        plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
        at = [plain[f"c{docs.columns.index(n)}"].alias(n) for n in ("doc_id", "text", *numbers, *strings)]
        rows = plain.select(*at, F.struct(*plain.columns).alias("row"))
    text = F.coalesce("text", F.lit(""))
    cells = [number_cell(F.col(c), bits) for c in numbers] + [string_cell(F.col(c), first_values(rows, c, bits)) for c in strings]
    narrow = rows.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *numbers, *strings, *["row"] * whole, *[c.alias(f"cell{i}") for i, c in enumerate(cells)])
    kept = narrow.schema[: len(narrow.columns) - len(cells)]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                n = len(kept)
                index = curve_index(np.stack([np.asarray(c) for c in batch.columns[n:]], 1), bits)
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(index)], [*kept.names, "curve"])

    return narrow.mapInArrow(tidy(run), T.StructType([*kept.fields, T.StructField("curve", T.LongType())]))


KEYS = ["curve", "doc_id", "text_crc32", "size"]


def cut(ranked: DataFrame, total: int, shards: int) -> DataFrame:
    """Adds shard and slot: runs of ranks, the first ones longer by one."""
    least, more = divmod(total, shards)
    wide = F.lit(more * (least + 1))
    in_wide, rest = F.col("rank") < wide, F.col("rank") - wide
    number = F.when(in_wide, F.floor(F.col("rank") / F.lit(least + 1))).otherwise(more + F.floor(rest / F.lit(max(least, 1))))
    slot = F.when(in_wide, F.col("rank") % F.lit(least + 1)).otherwise(rest % F.lit(max(least, 1)))
    return ranked.withColumns({"shard": number.cast("int"), "slot": slot.cast("long")})


def shard_ranges(sharded: DataFrame, columns: tuple = NUMBERS + STRINGS) -> DataFrame:
    """Each shard's number of rows, and least and largest value of each column."""
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *[f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))])


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null), curve, and the shard's range of
    each column (min_ and max_)."""
    ranked, _, total = numbered(curved(docs), KEYS, "curve")
    placed = cut(ranked, total, shards)
    ranges = F.broadcast(shard_ranges(placed).drop("rows"))  # a row for each shard
    out = placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
    return out.join(ranges, "shard").select(*out.columns, *[c for c in ranges.columns if c != "shard"])


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Writes documents to one folder per shard, in the curve's order, and returns the shards' ranges of each column.

    A shard's rows are written by as many tasks as the sort has for them, each a run of slots. The folders are named
    shard=0 and so on, or hilbert_shard=0 where the documents have a column shard of their own."""
    ranked, _, total = numbered(curved(docs, whole=True), KEYS, "rows")
    placed = cut(ranked, total, shards)
    folder = "shard" if "shard" not in {c.lower() for c in docs.columns} else "hilbert_shard"
    placed.sortWithinPartitions("shard", "slot").select("row.*", F.col("shard").alias("sort_shard")).toDF(*docs.columns, folder).write.partitionBy(folder).parquet(path)
    back = docs.sparkSession.read.parquet(path)
    return shard_ranges(back.select(F.col(folder).alias("shard"), *NUMBERS, *STRINGS))


def prune(ranges: DataFrame, column: str, low, high) -> list[int]:
    """Shards whose range of a column meets [low, high]."""
    hit = ranges.filter((F.col(f"max_{column}") >= F.lit(low)) & (F.col(f"min_{column}") <= F.lit(high)))
    return sorted(r[0] for r in hit.select("shard").collect())

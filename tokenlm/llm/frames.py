"""Helpers on DataFrames that hold whatever the other columns are called."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlm.llm.session import bounded, tidy

Batches = Iterator[pa.RecordBatch]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The first columns of exactly these names. Others may repeat them or differ in case only."""
    bounded(df.sparkSession)
    columns = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(columns))])
    return plain.select(*[F.col(f"c{columns.index(n)}").alias(n) for n in names])


def arrow_map(df: DataFrame, schema: str, make: Callable[[pa.RecordBatch], dict | None], limit: int | None = None) -> DataFrame:
    """Rows that make returns for each slice of a batch, as a dict of columns in the schema's order."""
    from tokenlm.llm import kernel

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in kernel.slices(batch, limit=limit or kernel.SLICE_BYTES):
                out = make(part)
                if out is not None:
                    yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in out.items()})

    return df.mapInArrow(tidy(run), schema)


def arrow_rewrite(df: DataFrame, change: Callable[[pa.RecordBatch], tuple]) -> DataFrame:
    """df with some rows only and, if change says so, other texts and lengths; its columns stay as they are.

    change gets rows with the columns doc_id and text and returns a mask of rows that stay and None or new texts.
    """
    from tokenlm.llm import kernel

    bounded(df.sparkSession)
    columns = df.columns
    at_id, at_text = columns.index("doc_id"), columns.index("text")
    at_n = columns.index("n_chars") if "n_chars" in columns else None
    kind = df.schema

    def run(batches: Batches) -> Batches:
        for batch in batches:
            two = pa.RecordBatch.from_arrays([batch.column(at_id), batch.column(at_text)], ["doc_id", "text"])
            row = 0
            for part in kernel.slices(two):
                whole = batch.slice(row, part.num_rows)
                row += part.num_rows
                keep, texts = change(part)
                arrays = list(whole.columns)
                if texts is not None:
                    new = pa.array(texts, pa.string())
                    arrays[at_text] = new.cast(arrays[at_text].type)
                    if at_n is not None:
                        arrays[at_n] = pa.compute.utf8_length(new).cast(arrays[at_n].type)
                out = pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(len(arrays))])
                yield out.filter(pa.array(keep))

    plain = df.toDF(*[f"c{i}" for i in range(len(columns))])
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(kind.fields)])
    return plain.mapInArrow(tidy(run), schema).toDF(*columns)

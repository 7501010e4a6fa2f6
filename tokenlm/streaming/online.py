"""Online counting: document versions arrive in order, and each new version of a path takes the old one's counts back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlm.operators.lexer import tokenize

#: Editor event names, by their codes from 0.
EVENTS = ("SCANNED_FILE", "ANALYZE", "ACCEPTED", "BUF_LEAVE", "BUF_READ", "FILE_READ", "BUF_WRITE", "BUF_UNLOAD", "FILE_CHANGED", "INSERT_ENTER", "INSERT_LEAVE")

DELTAS = "path string, version long, n int, ngram string, delta long, whole long"


def deltas(tokens: list[str], order: int, sign: int) -> list[tuple[int, str, int, int]]:
    """Signed grams of one version of a document: n, ngram, delta, and delta again for whole grams."""
    out = []
    for i in range(len(tokens)):
        top = min(order, i + 1)
        out += [(n, " ".join(tokens[i - n + 1 : i + 1]), sign, sign if n == top else 0) for n in range(1, top + 1)]
    return out


def versions(events: DataFrame, order: int, only_new: bool = False) -> DataFrame:
    """Signed gram rows for a stream (or table) of events (path, version, text). State: the last text of each path.

    Within a batch, versions of a path are applied in order. With only_new, a path that is known keeps its counts.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (path,) = key
        old = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("version")
        out = []
        for version, text in zip(rows.version, rows.text, strict=True):
            if text == old or (only_new and old is not None):
                continue
            words = lambda t: [x.token for x in tokenize(t, path, begins=0)]
            if old is not None:
                out += [(path, version, *d) for d in deltas(words(old), order, -1)]
            out += [(path, version, *d) for d in deltas(words(text or ""), order, 1)]
            old = text
        if old is not None:
            state.update((old,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DELTAS.split(", ")])

    return events.select("path", "version", "text").groupBy("path").applyInPandasWithState(update, DELTAS, "text string", "append", "NoTimeout")


def merged(rows: DataFrame) -> DataFrame:
    """Counts after all deltas."""
    return rows.groupBy("n", "ngram").agg(F.sum("delta").alias("c"), F.sum("whole").alias("w")).filter("c <> 0")


def eligible(requests: DataFrame, directories: list[str], languages: list[str], exclude: list[str], max_bytes: int = 100_000) -> DataFrame:
    """Adds eligible: small enough, not excluded, inside a training directory, language supported."""
    from tokenlm.functions import scalars as S

    any_of = lambda paths: sum((S.path_within(F.col("path"), p).cast("int") for p in paths), F.lit(0)) > 0
    ok = (F.octet_length("text") < max_bytes) & any_of(directories) & ~any_of(exclude)
    if languages:
        ok &= S.extension(F.col("path")).isin(*languages)
    return requests.withColumn("eligible", ok)

"""What changed between two versions of a text, and a log of the changes of files.

A difference is the middle that is left when the common start and the common end are taken off: place, removed, inserted.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tokenlm.streaming.online import EVENTS

#: Events that are logged even if nothing has changed.
ALWAYS = frozenset(("BUF_WRITE", "INSERT_ENTER", "INSERT_LEAVE", "ANALYZE", "ACCEPTED"))
LOG = "path string, version long, event string, at int, removed string, inserted string"


def difference(old: str, new: str) -> tuple[int, str, str]:
    start = len(os.path.commonprefix([old, new]))
    a, b = old[start:], new[start:]
    end = len(os.path.commonprefix([a[::-1], b[::-1]]))
    return start, a[: len(a) - end], b[: len(b) - end]


def patched(old: str, change: tuple[int, str, str]) -> str:
    """The new text; a ValueError if what is removed isn't there."""
    at, removed, inserted = change
    if old[at : at + len(removed)] != removed:
        raise ValueError("the change is of another text")
    return old[:at] + inserted + old[at + len(removed) :]


def differences(pairs: DataFrame) -> DataFrame:
    """key, at, removed and inserted of pairs (key, old, new) of texts. Nulls are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [difference(a or "", b or "") for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "at", "removed", "inserted"])

    kind = pairs.schema["key"].dataType.simpleString()
    return pairs.select("key", "old", "new").mapInArrow(run, f"key {kind}, at int, removed string, inserted string")


def tracked(events: DataFrame) -> DataFrame:
    """A log row per event (path, version, event, text) of a stream or table that changes its file, or is always logged.

    State: the last text of each path; unloading a buffer forgets it. Within a batch, a path's events go by version."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (path,) = key
        old = state.get[0] if state.exists else ""
        rows, out = pd.concat(list(batches)).sort_values("version"), []
        for version, event, text in zip(rows.version, rows.event, rows.text, strict=True):
            at, removed, inserted = difference(old, text or "")
            if removed or inserted or event in ALWAYS:
                out.append((path, version, event, at, removed, inserted))
            old = "" if event == "BUF_UNLOAD" else text or ""
        state.update((old,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LOG.split(", ")])

    return events.select("path", "version", "event", "text").groupBy("path").applyInPandasWithState(update, LOG, "text string", "append", "NoTimeout")


assert ALWAYS <= set(EVENTS)

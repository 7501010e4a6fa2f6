"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A long text is cut before it is encoded, at most SPLIT_CHARS or a little more to a piece, only between a character
that isn't white space and white space after it. No match of the splitting pattern spans such a place, nor does any
look beyond it, so the pieces' ids in a row are the whole text's. Decoding joins the ids' raw bytes and never goes
through text, so tokens that end within a character do no harm.

Nulls count as empty texts: no ids, and the digests of nothing. Repeated rows get repeated results, a null doc_id passes
through, an empty table gives an empty result, and other columns are not read. Strings that name special tokens are
ordinary text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tokenlm.llm import kernel as K
from tokenlm.llm.frames import arrow_map, pick

SPLIT_CHARS = 20_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_SAFE = re.compile(r"(?<=\S)(?=\s)")


@functools.lru_cache(2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(2)
def decimals(n: int) -> list[str]:
    return [str(i) for i in range(n)]


def pieces(text: str, size: int = SPLIT_CHARS) -> Iterator[str]:
    """The text in runs of about size characters, cut at safe places only; a run without one stays whole."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str, path: str, pattern: str) -> list[int]:
    enc = encoding(path, pattern)
    if len(text) <= SPLIT_CHARS:
        return enc.encode_ordinary(text)
    return [i for piece in pieces(text) for i in enc.encode_ordinary(piece)]


def decode(ids: list[int], path: str, pattern: str) -> bytes:
    """The bytes that ids stand for, whether they form characters or not."""
    return encoding(path, pattern).decode_bytes(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids of every whole text."""

    def make(part: pa.RecordBatch) -> dict:
        return {"doc_id": part.column(0), "ids": pa.array([encode(t, path, pattern) for t in K.text_list(part.column(1))], pa.list_(pa.int32()))}

    return arrow_map(pick(docs, "doc_id", "text"), "doc_id long, ids array<int>", make)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the raw bytes of ids."""

    def run(batches):
        for batch in batches:
            ids = [x or [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "bytes": pa.array([decode(x, path, pattern) for x in ids], pa.binary())})

    return pick(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: the number of ids, and digests of the ids and of the bytes decoded from them."""

    def make(part: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": part.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        names = decimals(encoding(path, pattern).n_vocab)
        for text in K.text_list(part.column(1)):
            ids = encode(text, path, pattern)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decode(ids, path, pattern)).hexdigest())
        return out

    return arrow_map(pick(docs, "doc_id", "text"), SCHEMA, make)

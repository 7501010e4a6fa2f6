"""Fuzzy search for short license notices: exact seeds find candidates, bounded-error matching verifies them.

Texts are lower-cased (A-Z) and reduced to words joined by one space. A notice with n characters before a name
or version number at its end may differ by n // CHARS_PER_EDIT edits there (a letter more, less or another). Cut into one piece more than it has edits, it has at least
one piece without any: the pieces are exact seeds, and around each place of a seed the regex library matches
the notice with every range of whole words of a fitting length, which gives the span and the edits it took. Names and
numbers at the end take no edit, and notices too short for an edit must be exact. Where notices overlap, those that took
the fewest edits count. Time grows with the text's length and the number of seeds in it.

Base places are those where a base phrase's words stand consecutively; their labels always stay. score is the largest
share of a found notice's characters that took no edit: 1 with a base place or an exact notice, 0 without any.

Nulls count as empty texts: no words, no labels, score 0. Repeated rows get repeated results, a null doc_id passes
through, an empty table gives an empty result, and other columns are not read.
"""

from __future__ import annotations

import bisect
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tokenlm.llm import kernel as K
from tokenlm.llm.frames import arrow_map, pick

CHARS_PER_EDIT = 10
#: Phrases of the base search and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Further short notices of the fuzzy search; what follows a bar takes no edit.
NOTICES = (
    *BASE,
    ("|the mit license", "mit"),
    ("spdx license identifier |mit", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("under the apache license", "apache-2"),
    ("spdx license identifier |apache 2", "apache-2"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("under the |gpl", "gpl"),
    ("under the |lgpl", "lgpl"),
    ("under the |agpl", "agpl"),
    ("mozilla public license", "mpl"),
    ("under the |mpl", "mpl"),
    ("eclipse public license", "epl"),
    ("under the bsd license", "bsd"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("creative commons attribution", "cc-by"),
    ("cc by sa", "cc-by-sa"),
    ("public domain dedication", "public-domain"),
)
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"

#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F] of lower-cased text; all others become spaces.
_WORDS = bytes(K.LOWER[i] if K.ALNUM[i] else 0x20 for i in range(256))


def normal(text: str) -> tuple[bytes, int]:
    """Words of a text with a space before, between and after them, and their number."""
    words = text.encode().translate(_WORDS).split()
    return b" ".join([b"", *words, b""]) if words else b" ", len(words)


class Notice:
    def __init__(self, phrase: str, label: str):
        import regex

        head, _, exact = phrase.partition("|")
        if not exact:
            head = phrase.rstrip("0123456789")
            exact = phrase[len(head) :]
        self.phrase, self.label = (head + exact).encode(), label
        self.edits = len(head) // CHARS_PER_EDIT
        n = self.edits + 1
        cuts = [len(self.phrase) * i // n for i in range(n + 1)]
        self.seeds = [(self.phrase[a:b], a) for a, b in zip(cuts, cuts[1:])]
        #: One pattern by bound: the least that matches is the number of edits.
        self.patterns = [regex.compile((rb"(?:%s){e<=%d}" % (regex.escape(head.encode(), special_only=True), k) if head else b"") + exact.encode()) for k in range(n)]

    def windows(self, text: bytes) -> set[tuple[int, int]]:
        """Ranges around the places of seeds; each holds every match with that seed."""
        found = set()
        for seed, offset in self.seeds:
            at = text.find(seed)
            while at >= 0:
                found.add((max(0, at - offset - self.edits), min(len(text), at - offset + len(self.phrase) + self.edits)))
                at = text.find(seed, at + 1)
        return found

    def distance(self, text: bytes, start: int, end: int) -> int | None:
        """Edits between the notice and a range of the text, if within the bound."""
        if not self.patterns[-1].fullmatch(text, start, end):
            return None
        return next(k for k, p in enumerate(self.patterns) if p.fullmatch(text, start, end))

    def search(self, text: bytes) -> list[tuple[int, int, int]]:
        """Start, end and edits of matches from a word's start to a word's end; of those that overlap, the one of fewest edits."""
        n, ranges = len(self.phrase), set()
        for a, b in self.windows(text):
            spaces = [i for i in range(max(a - 1, 0), min(b + 1, len(text))) if text[i] == 32]
            ranges |= {(i + 1, j) for i in spaces for j in spaces if abs(j - i - 1 - n) <= self.edits}
        found = [(e, start, end) for start, end in ranges if (e := self.distance(text, start, end)) is not None]
        out: list[tuple[int, int, int]] = []
        for e, start, end in sorted(found):
            k = bisect.bisect(out, (start,))
            if (k == len(out) or end < out[k][0]) and (k == 0 or out[k - 1][1] < start):
                out.insert(k, (start, end, e))
        return out


@functools.lru_cache(1)
def notices() -> list[Notice]:
    return [Notice(*x) for x in NOTICES]


def base_places(text: bytes) -> list[tuple[int, str]]:
    """Places of base phrases in a normal text, and their labels."""
    out = []
    for phrase, label in BASE:
        p = b" " + phrase.encode() + b" "
        at = text.find(p)
        while at >= 0:
            out.append((at + 1, label))
            at = text.find(p, at + 1)
    return out


Found = tuple[int, int, str, int]


def fewest_edits(spans: set[Found]) -> list[Found]:
    """The spans that meet no span with fewer edits."""
    out: list[Found] = []
    starts: list[int] = []  # of what spans with fewer edits cover, merged
    ends: list[int] = []
    for e in sorted({s[3] for s in spans}):
        mine = sorted(s for s in spans if s[3] == e)
        for a, b, label, _ in mine:
            k = bisect.bisect(starts, b) - 1
            if k < 0 or ends[k] < a:
                out.append((a, b, label, e))
        covered = sorted([*zip(starts, ends), *((a, b) for a, b, _, _ in mine)])
        starts, ends = [], []
        for a, b in covered:
            if ends and a <= ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
    return sorted(out)


def scan(text: str) -> dict:
    norm, n_words = normal(text)
    base = base_places(norm)
    found = {(start, end, notice.label, edits): 1 - edits / len(notice.phrase) for notice in notices() for start, end, edits in notice.search(norm)}
    spaces = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32) if base or found else np.zeros(0, np.int64)
    word = lambda at: int(np.searchsorted(spaces, at)) - 1  # noqa: E731  number of the word that starts at a place
    spans = fewest_edits({(word(a), word(b + 1) - 1, label, e) for a, b, label, e in found})
    score = max([1.0] * bool(base) + list(found.values()), default=0.0)
    labels = {label for _, label in base}
    starts = [word(at) for at, _ in base]
    return {
        "n_words": n_words, "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(labels)),
        "labels": ",".join(sorted(labels | {s[2] for s in spans})), "score": score, "spans": ",".join(f"{label}:{a}:{b}:{e}" for a, b, label, e in spans),
    }


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document. spans: label:first word:last word:edits of every notice found, comma-joined."""
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "score": pa.float64()}

    def make(part: pa.RecordBatch) -> dict:
        rows = [scan(t) for t in K.text_list(part.column(1))]
        return {"doc_id": part.column(0)} | {k: pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in rows[0]}

    return arrow_map(pick(docs, "doc_id", "text"), SCHEMA, make)

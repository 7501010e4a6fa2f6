"""Line-first cleaning: rules per line, failing lines go, and texts that lose too much of themselves are rejected.

A line without a word neither passes nor fails. A line with words fails if it
- repeats an earlier line of its text,
- has a vertical bar as one word in five or more (navigation),
- has over one symbol of [#*$%&|<>] to five characters of words,
- has over half of its words ending in !! or ??,
- has five words or more, over 70 % of them in capitals,
- has five words or more, over a third of them equal to the word before,
- has fewer than three words and doesn't end like a sentence (a fragment of a menu), or
- holds a phrase of web boilerplate.
A text is rejected if it fails the base rules (under 20 words, or over 30 % of its words in 8-word windows that
occur twice or more), or if over half of its words' characters are in failing lines.

Nulls and texts without words count as empty: zero counts, rejected. Repeated rows get repeated results. A null
doc_id passes through. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tokenlm.llm import kernel as K
from tokenlm.llm.frames import arrow_map, arrow_rewrite, pick

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW, MAX_LOST_PERCENT = 20, 30, 8, 50
#: Phrases in lower case that mark a line as boilerplate of a web page.
BOILERPLATE = ("cookie policy", "privacy policy", "terms of use", "all rights reserved", "subscribe to our newsletter", "javascript is disabled", "skip to content", "click here to")

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_chars long"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CHAR = np.ones(256, bool)
_CHAR[0x80:0xC0] = False
_UP, _DOWN = np.zeros(256, bool), np.zeros(256, bool)
_UP[0x41:0x5B] = _DOWN[0x61:0x7B] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;\"')")] = True


def measure(col: pa.Array) -> tuple[dict, K.Spans, np.ndarray]:
    """Counts and verdicts by text, the lines, and which of them fail."""
    t = K.Texts(col)
    words, lines, data = t.runs(K.NOT_SPACE), t.lines(), t.data
    h = words.hashes()
    n_lines = len(lines)
    line = np.searchsorted(lines.starts, words.starts, "right") - 1
    per = lambda mask=None: np.bincount(line if mask is None else line[mask], minlength=n_lines)
    chars = words.count(_CHAR[data])
    n, c = per(), np.bincount(line, chars, n_lines).astype(np.int64)
    some = n > 0

    later = np.zeros(n_lines, bool)
    at = np.flatnonzero(some)
    later[at] = K.repeated(lines.doc[at], lines.hashes()[at], lambda i, j: K.equal(lines, at[i], lines, at[j]))[1]

    last = data[words.ends - 1] if len(words) else np.zeros(0, np.uint8)
    long = words.ends - words.starts > 1
    before = data[np.maximum(words.ends - 2, 0)] if len(words) else last
    bang = long & (last == before) & ((last == 33) | (last == 63))
    up = (words.count(_UP[data]) >= 2) & ~words.contain(_DOWN[data])
    same = np.zeros(len(words), bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    one = np.flatnonzero(same)
    same[one] = K.equal(words, one, words, one - 1)
    bar = ~long & (last == 124)
    final = np.zeros(n_lines, bool)
    final[line] = _STOP[last]  # of a line's words the last one's stays
    boiler = np.zeros(n_lines, bool)
    raw = K.LOWER[data].tobytes()
    for phrase in BOILERPLATE:
        p = phrase.encode()
        i = raw.find(p)
        while i >= 0:
            k = int(np.searchsorted(lines.starts, i, "right")) - 1
            boiler[k] |= i + len(p) <= lines.ends[k]
            i = raw.find(p, i + 1)
    fails = some & (
        later | (5 * per(bar) >= n) & (per(bar) > 0) | (5 * lines.count(_SYMBOL[data]) > c) | (2 * per(bang) > n) | (n >= 5) & (10 * per(up) > 7 * n) | (n >= 5) & (3 * per(same) > n) | (n < 3) & ~final | boiler
    )

    places = K.windows(words.doc, WINDOW)
    same_words = lambda i, j: np.logical_and.reduce([K.equal(words, places[i] + d, words, places[j] + d) for d in range(WINDOW)])
    twice = places[K.repeated(words.doc[places], K.ngrams(h, places, WINDOW), same_words)[0]]
    cover = np.zeros(len(words) + WINDOW + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    covered = np.cumsum(cover)[: len(words)] > 0

    total = lambda doc, weights=None: np.bincount(doc, weights, t.n).astype(np.int64)
    out = {
        "n_words": words.per_text(), "word_chars": total(words.doc, chars), "n_symbols": t.count(_SYMBOL[data]), "n_dup_lines": total(lines.doc[later]), "n_repeat_words": total(words.doc[covered]),
    }
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    lost = total(lines.doc[fails], c[fails])
    out["kept"] = ~out["base_failed"] & (100 * lost <= MAX_LOST_PERCENT * out["word_chars"])
    out["lost_chars"] = lost
    return out, lines, fails


def line_quality(docs: DataFrame) -> DataFrame:
    """One row per document: counts, base_failed, kept, and lost_chars, the word characters of failing lines."""

    def make(part: pa.RecordBatch) -> dict:
        return {"doc_id": part.column(0)} | measure(part.column(1))[0]

    return arrow_map(pick(docs, "doc_id", "text"), SCHEMA, make)


def clean_lines(docs: DataFrame) -> DataFrame:
    """The documents kept, without their failing lines; n_chars, if there, counts the new text. Columns stay."""

    def change(part: pa.RecordBatch) -> tuple:
        out, lines, fails = measure(part.column(1))
        texts = K.text_list(part.column(1))
        bad = np.bincount(lines.doc[fails], minlength=len(texts))
        first = np.searchsorted(lines.doc, np.arange(len(texts)))
        for i in np.flatnonzero(out["kept"] & (bad > 0)):
            texts[i] = "\n".join(s for k, s in enumerate(texts[i].split("\n"), first[i]) if not fails[k])
        return out["kept"], texts

    return arrow_rewrite(docs, change)


#: The same for DuckDB, with the constants above.
SQL = r"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM base),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM base),
cut AS (SELECT r, k, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w,
  row_number() OVER (PARTITION BY r, line ORDER BY k) AS copy FROM lines),
facts AS (SELECT r, copy, line, w, len(w) AS n, length(array_to_string(w, '')) AS c,
  length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS sym,
  len(list_filter(w, lambda x: x = '|')) AS bars,
  len(list_filter(w, lambda x: x LIKE '%!!' OR x LIKE '%??')) AS bangs,
  len(list_filter(w, lambda x: regexp_matches(x, '[A-Z].*[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS ups,
  len(list_filter(generate_series(2, len(w)), lambda i: w[i] = w[i - 1])) AS same,
  regexp_matches(w[len(w)], '[.!?:;"'')]$') AS final,
  regexp_matches(lower(line), 'cookie policy|privacy policy|terms of use|all rights reserved|subscribe to our newsletter|javascript is disabled|skip to content|click here to') AS boiler
  FROM cut WHERE len(w) > 0),
failing AS (SELECT r, sum(CASE WHEN copy > 1 THEN 1 ELSE 0 END) AS dups,
  sum(CASE WHEN copy > 1 OR (5 * bars >= n AND bars > 0) OR 5 * sym > c OR 2 * bangs > n OR (n >= 5 AND 10 * ups > 7 * n)
    OR (n >= 5 AND 3 * same > n) OR (n < 3 AND NOT final) OR boiler THEN c ELSE 0 END) AS lost
  FROM facts GROUP BY r),
grams AS (SELECT r, unnest(generate_series(1, len(w) - 7)) AS i, w FROM words WHERE len(w) >= 8),
keys AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM grams),
again AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS m FROM keys),
places AS (SELECT DISTINCT r, unnest(generate_series(i, i + 7)) AS p FROM again WHERE m > 1),
repeats AS (SELECT r, count(*) AS k FROM places GROUP BY r),
counts AS (SELECT a.doc_id, len(a.w) AS n_words, length(array_to_string(a.w, '')) AS word_chars,
  length(regexp_replace(a.t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(f.dups, 0) AS n_dup_lines,
  coalesce(p.k, 0) AS n_repeat_words, coalesce(f.lost, 0) AS lost_chars
  FROM words a LEFT JOIN failing f ON f.r = a.r LEFT JOIN repeats p ON p.r = a.r),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost_chars <= 50 * word_chars AS kept, CAST(lost_chars AS BIGINT) AS lost_chars
FROM judged
"""

"""Personal data by a semi-Markov conditional random field over candidate segments.

Base spans come from four patterns with checks (octets, Luhn's sum, digit counts) and always stay. The model adds
spans that the patterns miss, such as written-out mail addresses and phone numbers without a plus sign. It looks at the
tokens around every trigger (digits in groups, an at sign, at and dot written out) in the text between base spans. A
segment of at most MAX_TOKENS tokens gets whole-span features (digits, groups, separators, checks, the word before),
and a dynamic program over segments, whose length is bounded, chooses boundaries and kinds jointly. Weights come
from the exact gradient of the segmentations' likelihood (forward and backward over segments) on generated sentences,
seeded, so every run has the same model.

Nulls count as empty texts: no spans, the digest of nothing. Repeated rows get repeated results, a null doc_id passes
through, an empty table gives an empty result, and other columns are not read.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tokenlm.llm import kernel as K
from tokenlm.llm.frames import arrow_map, arrow_rewrite, pick

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, CONTEXT_TOKENS = 7, 3
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_MAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_MAIL_TAIL = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_HEAD_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Starts at a run of digits and keeps whole runs, which finds the same and takes linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9][0-9().\x20-]{5,}[0-9]|@|[(\[]at[)\]]|[0-9][(\[]\.[)\]][0-9]|\bdot\b", re.I)
_TOKEN = re.compile(r"\S+")
#: Signs in brackets, which written-out addresses use.
_SIGN = re.compile(r"[(\[]\s?(at|dot|@|\.)\s?[)\]]")
#: Common last parts of mail addresses, as a fact for the model.
_ENDS = frozenset(("com", "org", "net", "edu", "gov", "info", "io", "eu", "uk", "de", "at", "ch", "fr", "es", "it", "us", "example"))
_LOCAL, _DOMAIN = re.compile(r"[\w.%+-]+"), re.compile(r"[\w-]+(\.[\w-]+)*")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[::2]) % 10 == -sum(2 * v - 9 * (v > 4) for v in values[1::2]) % 10


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, by kind and start."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _HEAD_CHARS:
            start -= 1
        tail = _MAIL_TAIL.match(text, at + 1) if start < at else None
        if tail:
            end = tail.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if any(c in text for c in "0123456789"):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := only_digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(only_digits(m.group())) <= 15]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


# --- the model ---


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A range without the punctuation around it."""
    while a < b and text[a] in "\"'<[{,;:!?":
        a += 1
    while a < b and text[b - 1] in "\"'>]},;:.!?":
        b -= 1
    return a, b


def plain(token: str) -> bool:
    """No part of a span starts or ends with such a token, except the words around a written-out sign."""
    return not any(c.isdigit() or c == "@" for c in token)


def mail_written(low: str) -> bool:
    """Whether a segment in lower case is a mail address with its signs written out: name, at, names with dots between."""
    words = _SIGN.sub(r" \1 ", low).replace("@", " @ ").split()
    if len(words) < 3 or words[1] not in ("at", "@") or not _LOCAL.fullmatch(words[0]):
        return False
    names, dots = words[2::2], words[3::2]
    return len(names) == len(dots) + 1 and all(d in ("dot", ".") for d in dots) and all(_DOMAIN.fullmatch(n) for n in names) and (bool(dots) or "." in names[0])


def features(segment: str, before: str) -> list[str]:
    """Facts about a whole segment and the word before it."""
    digits = only_digits(segment)
    n = len(digits)
    low = segment.lower()
    groups = re.findall(r"[0-9]+", segment)
    letters = sum(c.isalpha() for c in segment)
    out = ["bias", f"digits={min(n, 20) if n < 7 or n > 15 else '7-9' if n < 10 else '10-11' if n < 12 else '12-15'}", f"tokens={len(segment.split())}", f"groups={min(len(groups), 6)}"]
    if mail_written(low):
        out += ["mail-written", "known-end" if re.split(r"[\W_]+", low.rstrip(")] "))[-1] in _ENDS else "other-end"]
    if 1 < len(groups) < 6 and not letters:
        out.append("shape=" + "-".join(str(min(len(g), 9)) for g in groups))
    out += ["zero"] * (n > 6 and digits[0] == "0")
    if re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", segment):
        out.append("phone-national")
    if re.fullmatch(r"[0-9]{2,3}([ .-][0-9]{2,4}){2,5}", segment):
        out.append("number-groups")
    if len(groups) == 4 and re.fullmatch(r"[0-9]{1,3}(([. \[\]()]{1,3}| dot )[0-9]{1,3}){3}", low):
        out.append("ip-like" if all(int(g) <= 255 for g in groups) else "ip-wrong")
        out += ["ip-brackets"] * ("[" in segment or "(" in segment)
    if 13 <= n <= 19 and not letters:
        out.append("luhn" if luhn(digits) else "luhn-wrong")
        out += ["fours"] * all(len(g) == 4 for g in groups)
    out += ["letters"] * (letters > 0) + ["@"] * ("@" in segment) + ["unbalanced"] * (segment.count("(") != segment.count(")"))
    word = before.strip(".,:;()\"'").lower()
    out += [f"after={word}"] if word in ("call", "phone", "tel", "mobile", "card", "visa", "pay", "ip", "host", "address", "mail", "email", "contact", "order", "number", "version") else []
    return out


class Lattice:
    """Segments of a window: for each end, (start, kind or None, features); tokens outside spans are segments of one."""

    def __init__(self, text: str, tokens: list[tuple[int, int]]):
        self.text, self.tokens = text, tokens

    @functools.cached_property
    def by_end(self) -> list[list[tuple[int, list[str] | None]]]:
        return list(self.ends())

    def ends(self) -> Iterator[list[tuple[int, list[str] | None]]]:
        """Segments by end, one end at a time, so that long windows needn't hold all features."""
        text, tokens = self.text, self.tokens
        bare = [plain(text[a:b]) for a, b in tokens]
        for end in range(1, len(tokens) + 1):
            some: list[tuple[int, list[str] | None]] = [(end - 1, None)]
            for start in range(end - 1, max(-1, end - 1 - MAX_TOKENS), -1):
                written = any(text[a:b].lower().strip("()[]") in ("at", "dot") for a, b in tokens[start + 1 : end - 1])
                if (bare[start] or bare[end - 1]) and not written and not re.search(r"[(\[](at|dot)[)\]]", text[tokens[start][0] : tokens[end - 1][1]]):
                    continue
                a, b = trimmed(text, tokens[start][0], tokens[end - 1][1])
                if a < b:
                    left = tokens[start - 1] if start else (0, 0)
                    some.append((start, features(text[a:b], text[left[0] : left[1]])))
            yield some

    def span(self, start: int, end: int) -> tuple[int, int]:
        return trimmed(self.text, self.tokens[start][0], self.tokens[end - 1][1])


Weights = dict[tuple[str, str], float]


def score(w: Weights, kind: str, facts: list[str]) -> float:
    return sum(w.get((kind, f), 0.0) for f in facts)


def best(lattice: Lattice, w: Weights) -> list[Span]:
    """The likeliest segmentation's spans."""
    top: list[float] = [0.0]
    back: list[tuple[int, str | None]] = [(0, None)]
    for end, some in enumerate(lattice.ends(), 1):
        options = [(top[start], start, None) if facts is None else (top[start] + score(w, kind, facts), start, kind) for start, facts in some for kind in ((None,) if facts is None else KINDS)]
        value, start, kind = max(options, key=lambda o: o[0])
        top.append(value)
        back.append((start, kind))
    out, end = [], len(lattice.tokens)
    while end:
        start, kind = back[end]
        if kind:
            out.append((kind, *lattice.span(start, end)))
        end = start
    return out[::-1]


def add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b))) if a != -math.inf and b != -math.inf else max(a, b)


def gradient(lattice: Lattice, truth: set[Span], w: Weights, into: dict) -> None:
    """Adds features of the true segments less those expected under the model."""
    n = len(lattice.by_end)
    forward = [0.0] + [-math.inf] * n
    scores = []
    for end, some in enumerate(lattice.by_end, 1):
        row = [(start, None, None, 0.0) if facts is None else (start, kind, facts, score(w, kind, facts)) for start, facts in some for kind in ((None,) if facts is None else KINDS)]
        scores.append(row)
        for start, _, _, s in row:
            forward[end] = add(forward[end], forward[start] + s)
    backward = [-math.inf] * n + [0.0]
    for end in range(n, 0, -1):
        for start, _, _, s in scores[end - 1]:
            backward[start] = add(backward[start], backward[end] + s)
    for end, row in enumerate(scores, 1):
        for start, kind, facts, s in row:
            if kind:
                p = math.exp(forward[start] + s + backward[end] - forward[n])
                step = ((kind, *lattice.span(start, end)) in truth) - p
                for f in facts:
                    into[kind, f] += step


def sentences(n: int, seed: int) -> list[tuple[str, set[Span]]]:
    """Generated sentences with spans of forms that the base patterns miss, and numbers that are no personal data.

    Forms: written-out addresses, addresses with signs in brackets, cards in other groupings, and national phone
    numbers of English, German, French and Spanish texts (a leading 0 with an area code, pairs, threes)."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 8)))
    end = lambda: r.choice(["com", "org", "net", "de", "fr", "es", "example"])
    digit = lambda: r.choice("123456789")

    def card() -> str:
        body = "4" + d(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def wrong() -> str:
        body = d(15)
        return next(body + c for c in r.sample("0123456789", 10) if not luhn(body + c))

    fours = lambda s, sep: sep.join(s[i : i + 4] for i in range(0, 16, 4))
    octets = lambda: [str(r.randint(0, 255)) for _ in range(4)]
    made = {
        "email": [lambda: f"{word()} at {word()} dot {end()}", lambda: f"{word()} (at) {word()} (dot) {end()}", lambda: f"{word()}[at]{word()}[dot]{end()}", lambda: f"{word()}.{word()} at {word()} dot co dot uk", lambda: f"{word()} (at) {word()}.{end()}", lambda: f"{word()}.{word()} [at] {word()}.{end()}"],
        "ip": [lambda: "[.]".join(octets()), lambda: "(.)".join(octets()), lambda: " dot ".join(octets())],
        "card": [lambda: fours(card(), "."), lambda: fours(card(), " - ")],
        "phone": [lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"0{d(2)} {d(4)} {d(4)}", lambda: f"0{digit()}{d(3)} {d(6)}", lambda: f"0{d(3)} {d(r.randint(7, 8))}", lambda: f"0{d(2)}/{d(7)}", lambda: f"0{d(3)}-{d(7)}", lambda: f"0{digit()} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"(0{d(2)}) {d(4)} {d(4)}", lambda: f"9{d(2)} {d(3)} {d(3)}"],
        None: [wrong, lambda: fours(wrong(), "."), lambda: fours(wrong(), " "), lambda: d(r.randint(1, 12)), lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(2)}.{d(2)}.{d(4)}", lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"{d(1)}.{d(2)}.{d(1)}", lambda: f"the dot {word()}", lambda: f"{word()} at {word()}", lambda: f"@{word()}", lambda: f"{digit()},{d(3)},{d(3)}", lambda: f"{digit()}{d(1)} {d(3)} {d(5)} {d(2)}", lambda: f"{300 + int(d(2))}.{d(3)}.{d(2)}.{d(1)}", lambda: f"{d(7)}.{d(7)}", lambda: f"{digit()}.{d(3)}.{d(3)}", lambda: f"{digit()} {d(3)} {d(3)}", lambda: f"{digit()}{d(3)} {digit()}{d(3)}", lambda: f"{digit()}{d(3)}-{digit()}{d(3)}", lambda: f"{digit()}:{d(2)} {digit()}{d(1)}:{d(2)}", lambda: f"{word()} dot {word()}", lambda: f"{digit()} dot {digit()}", lambda: f"{word()} at {word()} dot {r.choice(['and', 'then', 'but', 'we'])} {word()}"],
    }
    kinds = list(made)
    weight = [6, 4, 3, 11, 23]
    out = []
    for _ in range(n):
        kind = r.choices(kinds, weight)[0]
        lead = " ".join(word() for _ in range(r.randint(1, 4)))
        lead += " " + r.choice(["call", "card", "host", "mail", "order", "version"]) if r.random() < 0.3 else ""
        body = r.choice(made[kind])()
        text = f"{lead} {body}{r.choice(['', '.', ','])} {word()} {word()}"
        out.append((text, {(kind, len(lead) + 1, len(lead) + 1 + len(body))} if kind else set()))
    return out


@functools.lru_cache(1)
def weights() -> Weights:
    """Trained weights: gradient ascent with a ridge, on generated sentences."""
    data = [(Lattice(t, [m.span() for m in _TOKEN.finditer(t)]), truth) for t, truth in sentences(900, 3)]
    w: Weights = {}
    squares: dict = defaultdict(lambda: 1.0)
    for _ in range(20):
        for i in range(0, len(data), 30):
            g: dict = defaultdict(float)
            for lattice, truth in data[i : i + 30]:
                gradient(lattice, truth, w, g)
            for k, v in g.items():
                v -= 0.02 * w.get(k, 0.0)
                squares[k] += v * v
                w[k] = w.get(k, 0.0) + 0.5 * v / math.sqrt(squares[k])
    return w


def model_spans(text: str, base: list[Span], w: Weights) -> list[Span]:
    """Spans that the model finds around triggers in the text between base spans."""
    out: list[Span] = []
    for a, b in gaps(text, base):
        for tokens in windows(text, a, b):
            out += best(Lattice(text, tokens), w)
    return out


def gaps(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """Ranges of the text that no span covers."""
    out, at = [], 0
    for a, b in sorted((a, b) for _, a, b in spans):
        if a > at:
            out.append((at, a))
        at = max(at, b)
    return out + [(at, len(text))] * (at < len(text))


def windows(text: str, a: int, b: int) -> list[list[tuple[int, int]]]:
    """Tokens of a range that lie at most a longest segment and its context from a trigger; windows that meet are one."""
    triggers = [m.span() for m in _TRIGGER.finditer(text, a, b)]
    if not triggers:
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text, a, b)]
    starts = [t[0] for t in tokens]
    out: list[tuple[int, int]] = []
    for x, y in triggers:
        first = max(0, bisect.bisect_right(starts, x) - 1 - MAX_TOKENS - CONTEXT_TOKENS)
        last = min(len(tokens), bisect.bisect_left(starts, y) + MAX_TOKENS + CONTEXT_TOKENS)
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return [tokens[first:last] for first, last in out]


def find(text: str, w: Weights) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    if not any(c in text for c in "0123456789@"):
        low = text.lower()
        if not any(sign in low for sign in ("dot", "(at", "[at")):
            return [], []
    base = base_spans(text)
    return base, base + model_spans(text, base, w)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of base spans, and all spans as kind:start:end."""
    w = weights()

    def make(part: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": part.column(0)} | {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": []}
        for text in K.text_list(part.column(1)):
            base, spans = find(text, w)
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
        return out

    return arrow_map(pick(docs, "doc_id", "text"), SCHEMA, make)


def mask(text: str, spans: list[Span]) -> str:
    """The text with a mark such as [EMAIL] in place of each span; overlapping spans become one mark."""
    out, at = [], 0
    for a, b, kind in sorted((a, -b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked; n_chars, if there, counts the new text. Columns and rows stay."""
    w = weights()

    def change(part: pa.RecordBatch) -> tuple:
        texts = part.column(1).to_pylist()
        for i, t in enumerate(texts):
            if t and (spans := find(t, w)[1]):
                texts[i] = mask(t, spans)
        return [True] * len(texts), texts

    return arrow_rewrite(docs, change)

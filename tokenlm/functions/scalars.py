"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Edges of count bins, and the least probability of an unseen event.
BINS = (0, 1, 2, 3, 4, 5, 10, 20, 30, 50, 100, 500, 1000)
UNSEEN = 5e-5


def extension(path: Column) -> Column:
    """Text after the last dot of the file name; empty if there is none or the dot starts the name."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def base_name(path: Column) -> Column:
    """The file name up to its first dot; a name that starts with a dot stays whole."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.startswith("."), name).otherwise(F.regexp_extract(name, r"^([^.]*)", 1))


def directory_depth(path: Column) -> Column:
    return (F.size(F.split(path, "/")) - 1).cast("long")


def word_shape(word: Column) -> Column:
    """Runs of capitals, small letters and digits become A, a and 0."""
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "[A-Z]+", "A"), "[a-z]+", "a"), "[0-9]+", "0")
    return marked


def is_identifier(token: Column) -> Column:
    return token.rlike(r"^\w+$")


def starts_as_identifier(token: Column) -> Column:
    """The looser test: a word character first."""
    return token.rlike(r"^\w")


def has_base(token: Column, base: Column, smart_case: bool = False) -> Column:
    """Whether a token starts with what was typed; smart case minds capitals only if the base has some."""
    loose = F.lower(token).startswith(F.lower(base))
    return F.when(base == F.lower(base), loose).otherwise(token.startswith(base)) if smart_case else loose


def log10_bucket(count: Column) -> Column:
    return F.when(count > 0, F.floor(F.log10(count)).cast("long")).otherwise(F.lit(-1).cast("long"))


def bin_label(count: Column) -> Column:
    """<= the first bin edge that holds the count, or > the last one."""
    out = F.lit(f">{BINS[-1]}")
    for edge in reversed(BINS):
        out = F.when(count <= edge, f"<={edge}").otherwise(out)
    return out


def soft_threshold(x: Column, cutoff: float) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - cutoff, F.lit(0.0))


def max_likelihood(count: Column, total: Column) -> Column:
    return F.when(count > 0, count / total).otherwise(UNSEEN)


def indicator(name: str, count: Column, top: int = 2) -> Column:
    """struct(fname, fval): an indicator for counts up to top, else the count's logarithm."""
    label = F.concat(F.lit(f"{name}="), count.cast("long").cast("string"))
    return F.when(count <= top, F.struct(label.alias("fname"), F.lit(1.0).alias("fval"))).otherwise(F.struct(F.lit(f"{name}.log").alias("fname"), F.log(count.cast("double")).alias("fval")))


def upper_by_character(text: Column) -> Column:
    """Capitals one by one, so that a sharp s becomes one capital and not two."""
    return F.upper(F.translate(text, "ß", "ẞ"))


def html_escape(text: Column) -> Column:
    """Markup characters, then line breaks."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "<br/>")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """{{name}} becomes the value of that name."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), value)
    return template


def path_within(path: Column, directory: Column | str) -> Column:
    """Whether a directory is the path itself or above it."""
    d = F.lit(directory) if isinstance(directory, str) else directory
    return (path == d) | path.startswith(F.concat(d, F.lit("/")))


def typed_base(line: Column) -> Column:
    """The number or word at the end of what is left of the cursor."""
    return F.regexp_extract(line, r"([0-9]+(\.[0-9]+)?|\w+)$", 1)


def looks_binary(content: Column, loose: bool = False) -> Column:
    """By the first 512 bytes: a NUL, or a share of 0.3 of bytes outside 32 to 126. Loose: white space and backspace are
    text, and the share must be exceeded. Empty content is text."""
    head = F.hex(F.substring(content, 1, 512))
    n = F.length(head) / 2
    pairs = F.regexp_replace(head, "(..)", "$1 ")
    text = r"[2-6][0-9A-F] |7[0-9A-E] " + (r"|0[8-9AD] " if loose else "")
    odd = F.length(F.regexp_replace(pairs, text, "")) / 3
    share = odd > 0.3 * n if loose else odd >= 0.3 * n
    return F.when(n == 0, F.lit(False)).otherwise(pairs.rlike(r"(^| )00 ") | share)


def number_text(x: Column) -> Column:
    """A number as short text: whole ones without a point, tiny ones with an exponent, others with three places."""
    whole = F.abs(x - x.cast("long")) < 1e-40
    return F.when(whole, x.cast("long").cast("string")).when(F.abs(x) < 1e-3, F.format_string("%.2e", x)).otherwise(F.format_string("%.3f", x))


def query_parameter(query: Column, name: str) -> Column:
    """A field of a query string, decoded; null if it isn't there."""
    raw = F.regexp_extract(F.concat(F.lit("&"), query), f"&{name}=([^&]*)", 1)
    there = F.concat(F.lit("&"), query).contains(f"&{name}=")
    return F.when(there, F.url_decode(raw))


def matches(name: Column, *parts: str, exact: bool = False) -> Column:
    """Whether a feature's name is one of the parts (exact), or holds all of them; without parts, every name matches."""
    if exact:
        return name.isin(*parts)
    out = F.lit(True)
    for p in parts:
        out = out & name.contains(p)
    return out


def decorated(name: Column, cluster: Column | None = None) -> Column:
    """A feature's name, with the suffix of its cluster if it has one."""
    return name if cluster is None else F.concat(name, F.lit(",cluster="), cluster.cast("string"))


def tests_position(token: Column, line_prefix: Column, known: Column | None = None, least: int = 1, identifiers: bool = False) -> Column:
    """Whether a benchmark tests a position: not after a comment mark in its line, long enough, if asked for an identifier, and seen."""
    ok = ~line_prefix.contains("#") & ~line_prefix.contains("//") & (F.length(token) >= least)
    if identifiers:
        ok &= starts_as_identifier(token)
    return ok if known is None else ok & known


def is_identifier_position(token: Column, ttype: Column, tctx: Column) -> Column:
    """An identifier that is real text, outside of comments and strings."""
    return (ttype == "ACTUAL") & (tctx == "NONE") & is_identifier(token)

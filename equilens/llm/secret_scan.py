"""Secret scan in DataFrame expressions only (operator 10).

Fixed formats (assignments, access keys, long hex runs) are regular
expressions; their spans always count.  On top, every other token of 20 or more
characters that has letters and digits, or small and capital letters in like
parts, is a candidate: a window slides over it, the counts of the characters in
the window are updated by the one that enters and the one that leaves, and with
them the sum of c*log2(c), so that each step costs the same whatever the window.
A candidate is reported when some window's Shannon entropy reaches the threshold
of its character class, the first of :data:`CLASSES` that holds all of it, unless
an allow-list pattern matches it or it overlaps a fixed-format span.  Letters of
one case alone are never a candidate: entropy does not tell them from words.

Everything happens inside the row: no shuffle, no Python on the executors.
A null text counts as empty and has no spans.  Positions are code points, end
exclusive.  Repeated rows give repeated results.  Only the id and text columns
are read by :func:`scan`; :func:`redact` keeps every other column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
# pattern, capture group that is measured, least length
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),  # shorter maximal runs fail whole
}
_TOKEN = "[A-Za-z0-9+/=_-]"
# A maximal run of token characters, 20 or more, with a letter.
CANDIDATE = rf"(?<!{_TOKEN})(?=[0-9+/=_-]*+[A-Za-z]){_TOKEN}{{20,}}+"
WINDOW = 20
# Without a digit, each case must make up this part of the token (one in CASES):
# identifiers and titles have fewer capitals, random letters seldom have.
CASES = 4
# Character class, its tokens, bits of entropy that a window must reach.  The
# thresholds lie below what 98 % of random strings of WINDOW characters of the
# alphabet reach (16, 32, 36, 52, 62 and 64 symbols; 4,000 draws each), and between
# two values that a window can have.  Longer tokens have more windows and miss less.
CLASSES = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 2.94),
    ("upper", r"^[0-9A-Z]+$", 3.40),
    ("lower", r"^[0-9a-z]+$", 3.44),
    ("letters", r"^[A-Za-z]+$", 3.64),
    ("base62", r"^[0-9A-Za-z]+$", 3.68),
    ("wide", r"^.+$", 3.68),
)
_PART = "[0-9]*(?:[A-Z]?[a-z]+|[A-Z]+)?[0-9]*"
# Shapes that look random or long but are no secrets: UUIDs, words and numbers
# joined by marks (words of one case or with a capital first, digits at their
# ends only), times and dates, digits with one unit letter.
ALLOW = (
    r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    rf"^[=/_+-]*{_PART}(?:[=/_+-]+{_PART})*$",
    r"^[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-][0-9Z+=-]*$",
    r"^[0-9+/=_-]+[A-Za-z]$",
)
MARK = "[REDACTED]"

_SPANS = "array<struct<start:int,end:int,text:string>>"


def _matches(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches whose group is long enough.
    A match starts where the texts between matches and the earlier matches end."""
    p = F.lit(pattern)
    parts = F.arrays_zip(F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.regexp_extract_all(text, p, F.lit(group)).alias("g"), F.split(text, pattern, -1).alias("gap"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("text"))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(_SPANS)
    return F.when(text.rlike(pattern), F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])).otherwise(none)


def window_entropy(token: Column, window: int = WINDOW) -> Column:
    """Greatest Shannon entropy (bits) of any ``window`` characters in a row of
    an ASCII string at least that long; of the whole string if it is shorter.
    The state holds a count for each of the 128 characters and the sum of
    c*log2(c); one character enters and one leaves per step."""
    chars = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    size = F.least(F.length(token), F.lit(window)).cast("double")
    weight = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(0.0)

    def step(acc: Column, x: Column) -> Column:
        came, went = x["came"], x["went"]
        same = came == F.coalesce(went, F.lit(-1))
        old_in, old_out = F.get(acc["counts"], came), F.get(acc["counts"], F.coalesce(went, F.lit(0)))
        counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == came, 1.0).otherwise(0.0) - F.when(k == went, 1.0).otherwise(0.0))
        total = acc["total"] + F.when(same, 0.0).otherwise(
            weight(old_in + 1) - weight(old_in) + F.when(went.isNull(), 0.0).otherwise(weight(old_out - 1) - weight(old_out)))
        seen = acc["seen"] + 1
        h = F.log2(size) - total / size
        return F.struct(F.when(same, acc["counts"]).otherwise(counts).alias("counts"), total.alias("total"), seen.alias("seen"),
                        F.when(seen >= size, F.greatest(acc["best"], h)).otherwise(acc["best"]).alias("best"))

    lag = F.concat(F.array_repeat(F.lit(None).cast("int"), window), chars)
    pairs = F.filter(F.arrays_zip(chars.alias("came"), lag.alias("went")), lambda x: x["came"].isNotNull())
    start = F.struct(F.array_repeat(F.lit(0.0), 128).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("seen"), F.lit(0.0).alias("best"))
    return F.aggregate(pairs, start, step, lambda acc: acc["best"])


def _random_looking(text: Column) -> Column:
    share = lambda letters: F.length(F.regexp_replace(text, f"[^{letters}]", "")) * CASES >= F.length(text)
    mixed = text.rlike("[0-9]") | (share("a-z") & share("A-Z"))
    threshold = F.coalesce(*[F.when(text.rlike(tokens), F.lit(bits)) for _, tokens, bits in CLASSES])
    return mixed & ~text.rlike("|".join(f"(?:{p})" for p in ALLOW)) & (window_entropy(text) >= threshold)


def _spans(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``_base`` and ``_spans``: arrays of (start, rank of kind, end, kind) in order."""
    named = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    base = F.array_sort(F.concat(*(named(_matches(text, *BASE[k]), k) for k in BASE)))
    df = df.withColumn("_base", base).withColumn("_candidates", _matches(text, CANDIDATE))
    free = lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    extra = F.filter("_candidates", lambda s: free(s) & _random_looking(s["text"]))
    return df.withColumn("_spans", F.array_sort(F.concat("_base", named(extra, "entropy")))).drop("_candidates")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of struct(start, rank, end, kind) by start,
    then kind as in :data:`KINDS`; ``base`` has the fixed formats alone."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return _spans(rows, F.col("_text")).select(F.col("_id").alias(id_col), F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = MARK, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans by one);
    rows without a span, null texts among them, stay as they are."""
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mark))).alias("out"))

    clean = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    out = _spans(docs, F.coalesce(text.cast("string"), F.lit("")))
    return out.withColumn(text_col, F.when(F.size("_spans") > 0, clean).otherwise(text)).drop("_base", "_spans")

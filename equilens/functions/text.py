"""Scalar text operators as Column expressions (JVM-side, no Python UDFs).

Character classes are spelled out so that Spark (java.util.regex) and the
SQL oracle (RE2) agree with each other and with Python's Unicode ``\\w`` /
``\\s``:  ``\\w`` -> ``[\\p{L}\\p{N}_]``, ``\\s`` -> the ``str.isspace`` set,
``.`` -> ``[^\\n]``.  ``\\b`` is written as a non-word neighbour or an end.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .fixed import EMAIL_RE, NON_ASCII_RE, STRIP_RE, TAG_RE, URL_RE, WORD, WS


def portable_regex(p: str) -> str:
    """Rewrite a simple Python pattern (no classes) into the shared dialect:
    ``\\s`` -> whitespace class, unescaped ``.`` -> ``[^\\n]``."""
    out, i = [], 0
    while i < len(p):
        c = p[i]
        if c == "\\" and i + 1 < len(p):
            nxt = p[i + 1]
            out.append(f"[{WS}]" if nxt == "s" else c + nxt)
            i += 2
            continue
        out.append(r"[^\n]" if c == "." else c)
        i += 1
    return "".join(out)


def words_regex(words: list[str]) -> str:
    """Whole-word alternation (Python ``\\bw\\b`` on word-character words)."""
    alt = "|".join(words)
    return rf"(^|[^{WORD}])({alt})([^{WORD}]|$)"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Python ``str.strip()``."""
    return F.regexp_replace(c, STRIP_RE, "")


def lines(c: Column) -> Column:
    """Python ``text.split('\\n')`` (keeps empty lines)."""
    return F.split(text_or_empty(c), "\n", -1)


# --- T1 --------------------------------------------------------------------
def extract_email(c: Column) -> Column:
    """First e-mail-looking match, else ''."""
    return F.regexp_extract(text_or_empty(c), EMAIL_RE, 0)


# --- T2 --------------------------------------------------------------------
FIRST_LINE_RE = rf"[^{WS}][^\n]*"


def extract_name(c: Column) -> Column:
    """First non-blank line, stripped; else 'Unknown'.  The leftmost match of
    "a non-space character and the rest of its line" starts at the first
    character of the first non-blank line: one linear scan that stops there,
    instead of splitting and stripping every line."""
    first = strip(F.regexp_extract(text_or_empty(c), FIRST_LINE_RE, 0))
    return F.when(first == F.lit(""), F.lit(fixed.UNKNOWN_NAME)).otherwise(first)


# --- T3 --------------------------------------------------------------------
def skill_display(keyword: str) -> str:
    """Display form of a keyword (Python title-casing)."""
    return keyword.title()


def lowered(c: Column, tl: Column | None = None) -> Column:
    """The lower-cased text; pass a pre-computed column (see
    :func:`with_lowered`) when several rules read the same text."""
    return tl if tl is not None else F.lower(text_or_empty(c))


def with_lowered(df, text_col: str, out: str = "_tl"):
    """Lower-case a text once, in its own projection: a non-trivial column
    read by many rules is then computed once per row."""
    return df.withColumn(out, F.lower(text_or_empty(F.col(text_col))))


def extract_skills(c: Column, keywords: list[str] = fixed.PARSER_SKILLS, tl: Column | None = None) -> Column:
    """array<string> of display names of keywords occurring (substring,
    case-insensitive) in the text, in keyword order."""
    tl = lowered(c, tl)
    z = F.arrays_zip(F.array(*[F.lit(k) for k in keywords]).alias("k"),
                     F.array(*[F.lit(skill_display(k)) for k in keywords]).alias("d"),
                     F.array_repeat(tl, len(keywords)).alias("s"))
    hits = F.transform(z, lambda e: F.when(e["s"].contains(e["k"]), e["d"]))
    return F.filter(hits, lambda x: x.isNotNull())


def skills_string(arr: Column) -> Column:
    return F.array_join(arr, ", ")


# --- T4 --------------------------------------------------------------------
def first_matching_line(c: Column, keywords: list[str] = fixed.EDUCATION_KEYWORDS) -> Column:
    """First line containing any keyword (case-insensitive), stripped; else ''."""
    kws = [k.lower() for k in keywords]

    def hit(line: Column) -> Column:
        ll = F.lower(line)
        cond = ll.contains(kws[0])
        for k in kws[1:]:
            cond = cond | ll.contains(k)
        return cond

    first = F.get(F.filter(lines(c), hit), 0)
    return F.coalesce(strip(first), F.lit(""))


# --- T5 --------------------------------------------------------------------
def keyword_test(tl: Column, keywords: list[str], match: str = "substring") -> Column:
    """Keyword presence in lower-cased text.  ``match='substring'`` (the
    reference's behaviour: 'mit' hits 'mitchell') or ``'word'`` (whole words
    only, keyword edges must not touch word characters)."""
    if match == "substring":
        return any_substring(tl, keywords)
    if match == "word":
        alt = "|".join(re.escape(k) for k in keywords)
        return tl.rlike(rf"(^|[^{WORD}])({alt})([^{WORD}]|$)")
    raise ValueError(f"match must be 'substring' or 'word', not {match!r}")


def any_substring(tl: Column, keywords: list[str]) -> Column:
    """Does any keyword occur in ``tl``?  One short-circuiting ``exists`` over
    a literal keyword array (the text enters once, through ``array_repeat``):
    a long OR chain would fuse into one generated method too large for the
    JIT to compile."""
    z = F.arrays_zip(F.array(*[F.lit(k) for k in keywords]).alias("k"),
                     F.array_repeat(tl, len(keywords)).alias("s"))
    return F.exists(z, lambda e: e["s"].contains(e["k"]))


def institution_tier(c: Column, keywords: list[str] = fixed.PARSER_TIER1, tl: Column | None = None,
                     match: str = "substring") -> Column:
    tl = lowered(c, tl)
    return F.when(keyword_test(tl, keywords, match), F.lit(fixed.TIER1_LABEL)).otherwise(F.lit(fixed.TIER23_LABEL))


# --- T6 --------------------------------------------------------------------
def gap_regex(patterns: list[str]) -> str:
    return "|".join(portable_regex(p) for p in patterns)


def career_gap(c: Column, patterns: list[str] = fixed.PARSER_GAP_PATTERNS, tl: Column | None = None) -> Column:
    tl = lowered(c, tl)
    return F.when(tl.rlike(gap_regex(patterns)), F.lit(fixed.GAP_YES)).otherwise(F.lit(fixed.GAP_NO))


# --- T7 --------------------------------------------------------------------
def gender_proxy(c: Column, female: str = fixed.PARSER_FEMALE_PATTERN,
                 male: str = fixed.PARSER_MALE_PATTERN, tl: Column | None = None) -> Column:
    """Female pattern first, then male, else 'Unspecified'.  Patterns are in
    the shared dialect (see :func:`words_regex` for whole-word lists)."""
    tl = lowered(c, tl)
    return (F.when(tl.rlike(female), F.lit(fixed.FEMALE))
            .when(tl.rlike(male), F.lit(fixed.MALE))
            .otherwise(F.lit(fixed.UNSPECIFIED)))


def gender_proxy_words(c: Column, tl: Column | None = None) -> Column:
    """Whole-word variant used by the preparation job."""
    return gender_proxy(c, words_regex(fixed.PREP_FEMALE_WORDS), words_regex(fixed.PREP_MALE_WORDS), tl)


# --- T8 / T9 ---------------------------------------------------------------
def hash_bucket(c: Column, n: int, prefix_chars: int = fixed.ORIGIN_PREFIX_CHARS) -> Column:
    """Stable bucket in [0, n) from the md5 of the first characters."""
    h = F.conv(F.substring(F.md5(F.substring(text_or_empty(c), 1, prefix_chars)), 1, 8), 16, 10)
    return F.pmod(h.cast("bigint"), F.lit(n))


def name_origin(name: Column, match: str = "substring") -> Column:
    """Parser rule, on the extracted name: South Asian, Western, else Other."""
    nl = F.lower(text_or_empty(name))
    return (F.when(keyword_test(nl, fixed.PARSER_SOUTH_ASIAN, match), F.lit(fixed.SOUTH_ASIAN))
            .when(keyword_test(nl, fixed.PARSER_WESTERN, match), F.lit(fixed.WESTERN))
            .otherwise(F.lit(fixed.OTHER)))


def name_origin_text(c: Column, tl: Column | None = None) -> Column:
    """Preparation rule, on the whole text: South Asian, East Asian, Western,
    else a stable hash bucket."""
    tl = lowered(c, tl)
    b = hash_bucket(c, len(fixed.ORIGIN_BUCKETS))
    fallback = F.element_at(F.array(*[F.lit(x) for x in fixed.ORIGIN_BUCKETS]), (b + 1).cast("int"))
    return (F.when(any_substring(tl, fixed.PREP_SOUTH_ASIAN), F.lit(fixed.SOUTH_ASIAN))
            .when(any_substring(tl, fixed.PREP_EAST_ASIAN), F.lit(fixed.EAST_ASIAN))
            .when(any_substring(tl, fixed.PREP_WESTERN), F.lit(fixed.WESTERN))
            .otherwise(fallback))


# --- T10 / T11 -------------------------------------------------------------
# Runs of white space other than one space; a printable ASCII character is ruled out by one test.
_WS_RUN_SCAN = rf"(?![!-~])(?: [{WS}]+|(?! )[{WS}]+)"


def _where(c: Column, may, pattern: str) -> Column:
    """The matches of ``pattern`` as one space, in texts for which ``may`` holds.
    The text enters through an array, so it is computed once."""
    return F.transform(F.array(c), lambda x: F.when(may(x), F.regexp_replace(x, pattern, " ")).otherwise(x))[0]


def clean_text(c: Column) -> Column:
    """Tags -> space, URLs -> space, whitespace runs -> one space, non-ASCII
    runs -> space, strip.  In that order, so double spaces can remain."""
    # A scan that cannot find anything is left out.
    t = _where(text_or_empty(c), lambda x: x.contains("<"), TAG_RE)
    t = _where(t, lambda x: x.contains("http") | x.contains("www."), URL_RE)
    # Single spaces stay as they are, so they are no match.
    t = F.regexp_replace(t, _WS_RUN_SCAN, " ")
    t = _where(t, lambda x: (F.octet_length(x) != F.length(x)) | ~F.is_valid_utf8(x), NON_ASCII_RE)
    return F.trim(t)  # no other white space is left


# --- T12 -------------------------------------------------------------------
def synthetic_name(pos: Column) -> Column:
    return F.format_string(fixed.NAME_FORMAT, pos)


def synthetic_email(pos: Column) -> Column:
    return F.format_string(fixed.EMAIL_FORMAT, pos)


def synthetic_filename(pos: Column) -> Column:
    return F.format_string(fixed.FILE_FORMAT, pos)


# --- T13 -------------------------------------------------------------------
def direction(v: Column) -> Column:
    return F.when(v > 0, F.lit(fixed.HELPED)).otherwise(F.lit(fixed.HURT))


def recommended_text(rec: Column) -> Column:
    return F.when(rec == 1, F.lit(fixed.RECOMMENDED_TEXT)).otherwise(F.lit(fixed.NOT_RECOMMENDED_TEXT))


def parse_columns(text: Column, name: Column | None = None, tl: Column | None = None) -> dict[str, Column]:
    """The parsed row of one document (parser rules).  ``name`` defaults to the
    first non-blank line; ``tl`` is the pre-lowered text if available."""
    nm = name if name is not None else extract_name(text)
    return {
        "Name": nm,
        "Email": extract_email(text),
        "Skills": skills_string(extract_skills(text, tl=tl)),
        "Education": first_matching_line(text),
        "Full_Text": strip(text_or_empty(text)),
        "gender_proxy": gender_proxy(text, tl=tl),
        "institution_tier": institution_tier(text, tl=tl),
        "career_gap": career_gap(text, tl=tl),
        "name_origin_proxy": name_origin(nm),
    }


def parse_frame(df, text_col: str = "text", keep: list[str] | None = None, name: Column | None = None):
    """``df`` with the parsed columns; the text is lower-cased once."""
    d = with_lowered(df, text_col)
    cols = parse_columns(F.col(text_col), name, F.col("_tl"))
    return d.select(*(keep or []), *[c.alias(k) for k, c in cols.items()])

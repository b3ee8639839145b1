"""Keyword rules over whole texts in Arrow batches.

A rule of ``functions.text`` looks for a list's words one after the other, each
time through the whole text.  Here a list is one pattern without captures, which
Arrow's regular expressions (RE2) match in one pass whatever the number of words.
Patterns are in the dialect shared with the SQL oracle (see ``functions.text``)."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from ..session import ship_package
from . import text as tx

# Rows whose texts are scanned together in a task.
SCAN_ROWS = 512


def any_of(words) -> str:
    """One pattern for a list of plain words."""
    return "|".join(re.escape(w) for w in words)


def first_label(low: pa.Array, cases, otherwise) -> pa.Array:
    """The label of the first case (pattern, label) that a text holds, else ``otherwise``."""
    out = otherwise
    for pattern, label in reversed(cases):
        out = pc.if_else(pc.match_substring_regex(low, pattern), label, out)
    return out


def skills_found(low: pa.Array, keywords) -> pa.Array:
    """Display names of the keywords in a text, in keyword order, joined by ", "."""
    hit, none = pc.match_substring_regex(low, any_of(keywords)), pa.scalar(None, pa.string())
    few, out = low.filter(hit), pa.repeat(pa.scalar("", pa.string()), len(low))
    if not len(few):
        return out
    found = [pc.if_else(pc.match_substring(few, k), tx.skill_display(k), none) for k in keywords]
    return pc.replace_with_mask(out, hit, pc.binary_join_element_wise(*found, ", ", null_handling="skip"))


def with_scans(df: DataFrame, low_col: str, rules: dict, drop=()) -> DataFrame:
    """``df`` with a string column for each of ``rules``: a list of keywords
    (:func:`skills_found`) or a pair of cases and what holds otherwise, a label
    or ``("column", name)``.  ``low_col`` is the lower-cased text; it and the
    columns ``drop`` are left out."""
    keep = [c for c in df.columns if c != low_col and c not in drop]

    def run(batches):
        for batch in (b.slice(k, SCAN_ROWS) for b in batches for k in range(0, b.num_rows, SCAN_ROWS)):
            low, found = pc.fill_null(batch.column(low_col), ""), []
            for rule in rules.values():
                if isinstance(rule, list):
                    found.append(skills_found(low, rule))
                else:
                    cases, other = rule
                    found.append(first_label(low, cases, batch.column(other[1]) if isinstance(other, tuple) else other))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *found], [*keep, *rules])

    ship_package(df.sparkSession)
    schema = StructType([*[df.schema[c] for c in keep], *[StructField(c, StringType()) for c in rules]])
    return df.mapInArrow(run, schema)

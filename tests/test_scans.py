"""Faster scans say the same as the plain rules."""

import re

from pyspark.sql import functions as F

from equilens.functions import fixed
from equilens.functions import text as tx
from equilens.functions import tokens as tk

TEXTS = ["", None, "She", "the  she\n", "ashe she's", "her\U00010400 xhis", "\U00010400he", "été_she é-she", "a\t b\x1c c  d  e", "  x ü y ", "  ", "ab a1 _x é ÉÉ x́y İstanbul",
         "<b>hi</b>  http://x.y/z　 www.q end \n", "caregiving", "maternity,he", "\n his \r\n"]


def test_scans_equal_the_plain_patterns(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    t = F.coalesce("t", F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(t, fixed.TAG_RE, " "), fixed.URL_RE, " ")
    plain = tx.strip(F.regexp_replace(F.regexp_replace(plain, fixed.WS_RUN_RE, " "), fixed.NON_ASCII_RE, " "))
    pairs = [(tx.clean_text(F.col("t")), plain), (tk.tokenize(F.col("t")), F.regexp_extract_all(F.lower(t), F.lit(tk.TOKEN_RE), 0)), (tk.word_runs(F.col("t")), F.regexp_extract_all(t, F.lit(tk.RUN_RE), 0))]
    for r in d.select("t", *[F.struct(a.alias("a"), b.alias("b")).alias(f"p{k}") for k, (a, b) in enumerate(pairs)]).collect():
        assert all(r[f"p{k}"].a == r[f"p{k}"].b for k in range(len(pairs))), r
        assert r.p0.a == r.p0.a.strip() and not re.search(r"[\t\n\r]", r.p0.a)


def test_frequent_characters_are_tested_first():
    assert tk._TOKEN_SCAN.startswith("[a-z0-9_") and tx._WS_RUN_SCAN.startswith("(?![!-~])")

"""Decomposition against the interpreter's own, over all assigned code points and over mixed texts."""

import random
import unicodedata

from pyspark.sql import functions as F

from brandloom.functions import fonts, unicode as N

R = random.Random(1)


def _check(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    got = {r.i: r.n for r in frame.select("i", N.nfkd(F.col("t")).alias("n")).collect()}
    wrong = [(t, got[i]) for i, t in enumerate(texts) if got[i] != unicodedata.normalize("NFKD", t)]
    assert not wrong, wrong[:3]


def test_every_code_point(spark):
    points = [c for p in range(0x110000) if not 0xD800 <= p < 0xE000 and unicodedata.category(c := chr(p)) != "Cn"]
    _check(spark, ["x".join(points[k : k + 40]) for k in range(0, len(points), 40)])


def test_mixed_texts(spark):
    special = [chr(p) for p in (*range(0xC0, 0x250), *range(0x300, 0x370), *range(0x1E00, 0x1F00), *range(0x591, 0x5C0), 0xAC01, 0xD55C, 0xFB01, 0xFDFA, 0x2460, 0x1D15E, 0x1F100, 0x3243, 0xBD)]
    _check(spark, ["".join(R.choices([*special, "a", " ", "日"], k=R.randrange(30))) for _ in range(3000)] + ["", "plain ASCII\n", "ẹ̣́", "̣́"])


def test_slugs_and_keys(spark):
    rows = [("Café Noir", "cafe-noir", "cafenoir"), ("Élan  Vital", "e-lan-vital", "elanvital"), ("ﬁne ①②", "fine-12", "fine12"), ("東京", "brand", ""), ("", "brand", ""), ("x" * 58 + " yz", "x" * 58 + "-y", "x" * 58 + "yz"), ("--A&B--", "a-b", "ab"), ("Söhne Breit", "so-hne-breit", "sohnebreit")]
    got = {r.t: (r.s, r.k) for r in spark.createDataFrame([(t,) for t, *_ in rows], "t string").select("t", N.file_slug(F.col("t")).alias("s"), fonts.eval_key("t").alias("k")).collect()}
    assert got == {t: (s, k) for t, s, k in rows}
    assert spark.range(1).select(N.file_slug(F.lit("Åre AB"), lower=False).alias("s"), N.nfkd(F.lit(None).cast("string")).alias("n")).first()[:] == ("A-re-AB", None)

"""Text functions against plain-Python versions of the reference's string helpers (hypothesis)."""

import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskloom.functions import text as TX

ALPHABET = st.sampled_from(list(string.ascii_letters[:8] + string.punctuation + " \t\n\x0b\x1c\x85\xa0 　"
                                + "éß'@#[]M"))
TEXTS = st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=1, max_size=60)


def py_strip_punct(s, keep=""):
    return "".join(c for c in s if c not in string.punctuation or c in keep)


def py_space_punct(s):
    return "".join(" " + c if c in string.punctuation.replace("'", "") else c for c in s)


def py_squeeze(s):
    return " ".join(s.split())


@settings(max_examples=5, deadline=None)
@given(TEXTS)
def test_text_functions_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    rows = df.select("i", TX.strip_punct("t").alias("a"), TX.strip_punct("t", "@#").alias("b"),
                     TX.space_punct("t").alias("c"), TX.squeeze_space("t").alias("d"),
                     TX.token_count(TX.squeeze_space("t")).alias("n")).collect()
    for r in rows:
        s = texts[r["i"]]
        assert r["a"] == py_strip_punct(s)
        assert r["b"] == py_strip_punct(s, "@#")
        assert r["c"] == py_space_punct(s)
        assert r["d"] == py_squeeze(s)
        assert r["n"] == len([w for w in s.split() if w not in ("@", "#")])


def test_prefix_is_single(spark):
    df = spark.createDataFrame([("Classify: Classify: x",), ("Mask: y",), ("z",)], "t string")
    got = [r[0] for r in df.select(TX.task_prefix("t")).collect()]
    assert got == ["Classify: x", "Classify: y", "Classify: z"]

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidence.functions.chunking import split_text
from evidence.functions.stemmer import stem
from evidence.functions.text import english_tokens, fold_text, normalise, strip

TEXTS = st.text(alphabet=st.sampled_from("ab .;!?\n\té"), max_size=400)


@given(TEXTS, st.integers(1, 80), st.integers(0, 60))
@settings(max_examples=300, deadline=None)
def test_chunks_hold_all_words_in_order_and_are_bounded(text, size, overlap):
    got = split_text(text, size, overlap)
    assert all(c == c.strip() and c for c in got)
    assert all(len(c) <= size + min(overlap, size // 2) + 1 for c in got)
    if overlap == 0:
        assert "".join("".join(got).split()) == "".join(text.split())
    assert (not got) == (not text.strip())


def test_an_overlap_may_exceed_the_size():
    text = "\n".join(["a" * 30, "b" * 30, "c" * 95])
    assert [len(c) for c in split_text(text, 100, 40)] == [61, 126]


def test_small_cases():
    assert split_text("", 10) == split_text(None, 10) == split_text(" \n", 10) == []
    assert split_text("short", 10) == ["short"]
    with pytest.raises(ValueError):
        split_text("x", 0)


def test_strip_is_python_strip(spark):
    edges = [" ", "\t", "\n", "\x0b", "\x1c", "\x1f", "\x85", " ", " ", " ", "　", "​"]
    rows = [(f"{e}a {e}b{e}",) for e in edges] + [("",), (" ",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(strip(F.col("t"))).collect()]
    assert got == [r[0].strip() if r[0] is not None else None for r in rows]


def test_normalise(spark):
    got = spark.createDataFrame([(" a\x00b \t c\n",), (None,)], "t string").select(normalise(F.col("t"))).collect()
    assert [r[0] for r in got] == ["ab c", ""]


def test_fold():
    assert fold_text("TỔNG số Đơn ß Ø") == "tong so don ß ø"


# Published examples of the stemming steps.
@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("digitizer", "digit"), ("triplicate", "triplic"), ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"), ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"), ("controll", "control"), ("roll", "roll")])
def test_stems(word, want):
    assert stem(word) == want


def test_english_tokens():
    assert english_tokens("The recalls of Élan, recalled!") == ["recal", "élan", "recal"]
    assert english_tokens(None) == []

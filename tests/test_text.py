import re

import pytest
from pyspark.sql import functions as F

from tablewright.functions import text as tx

TEXTS = ["Café del Mar, 2nd floor!", "", "  a__b  c-d ", "naïve «quote» 3½", "x" * 5, "nan NaN"]


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "s string").select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text", TEXTS)
def test_tokens_follow_unicode_words(spark, text):
    want = [w.lower() for w in re.split(r"\W+", text) if w]
    assert one(spark, text, tx.tokens("s")) == want
    assert one(spark, text, tx.words("s")) == want


@pytest.mark.parametrize("text", ["ab c", "Hi!", ""])
@pytest.mark.parametrize("q", [1, 2, 3])
def test_qgrams_are_padded(spark, text, q):
    plain = " ".join(w for w in re.split(r"\W", text.lower()) if w.strip())
    padded = "^" * (q - 1) + plain + "$" * (q - 1)
    want = [padded[i:i + q] for i in range(len(plain) + q - 1)]
    assert one(spark, text, tx.qgrams("s", q)) == want


def test_qgram_size_is_checked():
    for bad in (0, -1, 2.0):
        with pytest.raises(ValueError):
            tx.qgrams("s", bad)


@pytest.mark.parametrize("text", ["o'brien smith-jones 3rd", "ASSISTANT PROFESSOR", "ßein a1b"])
def test_title_case_after_any_non_letter(spark, text):
    assert one(spark, text, tx.title_case("s")) == text.title()


def test_similarities(spark):
    row = spark.createDataFrame([("kitten", "sitting", "", "")], "a string, b string, e string, f string").select(
        tx.edit_similarity("a", "b"), tx.edit_similarity("e", "f"), tx.word_jaccard("e", "f"),
        tx.list_jaccard(F.array(F.lit("a"), F.lit("a"), F.lit("b")), F.array(F.lit("a"))),
        tx.set_jaccard(F.array(F.lit("a"), F.lit("a"), F.lit("b")), F.array(F.lit("a"))),
    ).first()
    assert row[0] == pytest.approx(1 - 3 / 7)
    assert row[1] is None and row[2] == 0.0
    assert row[3] == pytest.approx(1 / 3) and row[4] == pytest.approx(1 / 2)


def test_links_and_literals(spark):
    base = "http://www.example.org"
    assert one(spark, "/a/b.html", tx.absolute_link("s", base)) == base + "/a/b.html"
    assert one(spark, base + "/x", tx.absolute_link("s", base)) == base + "/x"
    assert one(spark, base + "/x/y.html?q=1#top", tx.page_file("s")) == "y.html"
    assert one(spark, "  Home \n page ", tx.link_label("s")) == "HOME_PAGE"
    assert one(spark, "['http', 'udt', 4]", tx.list_literal("s")) == ["http", "udt", "4"]
    assert one(spark, "[http, udt, 4]", tx.list_literal("s")) == ["http", "udt", "4"]

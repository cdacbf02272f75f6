"""The bounded draw of training texts: copies count once, and a language of any size is drawn from."""

from beltline.llm import language as L


def test_copies_are_drawn_once(spark):
    rows = [("en", f"some text number {i}") for i in range(3000)] + [("en", "the same words again")] * 20_000 + [("de", "ein Satz")] * 500
    docs = spark.createDataFrame(rows, "lang string, text string")
    pieces = L.training_pieces(docs, 600, (10, 20), 7).groupBy("lang").count().collect()
    got = {r["lang"]: r["count"] for r in pieces}
    assert 2 * 500 < got["en"] < 2 * 700 and got["de"] == 2


def test_a_tiny_share_is_drawn(spark):
    """A share far below a millionth still has a limit above 0 on 62 bits."""
    assert (1500 << 62) // 10**13 > 1 << 28
    docs = spark.range(200_000).selectExpr("'en' AS lang", "concat('text ', id) AS text")
    assert 0 < L.training_pieces(docs, 20, (10,), 7).count() < 60
    assert L.training_pieces(docs.limit(0), 20, (10,), 7) is None


def test_null_and_empty_texts_are_not_drawn(spark):
    docs = spark.createDataFrame([("en", None), ("en", ""), (None, "x"), ("fr", "bonjour à tous")], "lang string, text string")
    assert [(r["lang"], bytes(r["piece"])) for r in L.training_pieces(docs, 5, (100,), 7).collect()] == [("fr", "bonjour à tous".encode())]

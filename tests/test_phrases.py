import pytest

from siftwarden.operators import detect, phrases

SALT = "s"
TEXTS = [
    "The quick, brown fox", "the  QUICK\tbrown fox, the quick brown fox", "quickbrown", "quick-brown", "Éclair au café", "eclair au   cafe!",
    "state_of the art", "", None, "a", "a a a b", "it's a c++ b", "fox",
]
LIST = ["quick brown", "the quick", "brown fox", "éclair au café", "fox", "a a", "a a b", "the art", "of the", "quick-brown", "it's a", " quick   brown "]


def rows(found):
    return sorted(tuple(r) for r in found.select("txn_id", "turn", "category", "pattern_id", "start", "end", "score", "confidence", "excerpt_hash").collect())


@pytest.fixture(scope="module")
def said(spark):
    return spark.createDataFrame([(i, 0, "input", t) for i, t in enumerate(TEXTS)], "txn_id long, turn int, plane string, text string")


def listed(spark, names):
    return spark.createDataFrame([("BLOCKED_TOPIC", p) for p in names], "category string, phrase string")


@pytest.mark.parametrize("bound", [phrases.BROADCAST_BYTES, -1])
def test_as_the_patterns_find(spark, said, bound, monkeypatch):
    monkeypatch.setattr(phrases, "BROADCAST_BYTES", bound)
    names = LIST[:-1]
    got = rows(phrases.find_phrases(said, listed(spark, names), SALT))
    assert got == rows(detect.scan(said, [detect.topics(names, [])], SALT)) and len(got) == 15


def test_odd_lists(spark, said):
    # Blanks around and within do not matter; what does not end in a word, and null, is never found.
    got = rows(phrases.find_phrases(said, listed(spark, [LIST[-1], LIST[-1], "c++", "", "--", None]), SALT))
    assert [r[:2] for r in got] == [(1, 0)]
    assert rows(phrases.find_phrases(said, listed(spark, []), SALT)) == []
    assert rows(phrases.find_phrases(said.limit(0), listed(spark, LIST), SALT)) == []
    twice = said.unionByName(said)
    assert rows(phrases.find_phrases(twice, listed(spark, LIST), SALT)) == rows(phrases.find_phrases(said, listed(spark, LIST), SALT))
    other = said.selectExpr("txn_id", "turn", "'response' AS plane", "text")
    assert rows(phrases.find_phrases(other, listed(spark, LIST), SALT)) == []


def test_time_is_not_that_of_a_pattern_each(spark, said):
    """A list far too long for a pattern each: 100,000 phrases, all but a few of them absent."""
    many = spark.range(100_000).selectExpr("'BLOCKED_TOPIC' AS category", "concat('phrase number x', id) AS phrase")
    got = rows(phrases.find_phrases(said, many.unionByName(listed(spark, LIST)), SALT))
    assert got == rows(phrases.find_phrases(said, listed(spark, LIST), SALT))

"""Responses against system prompts: the exact ratio, and how often a text is normalised for it."""

import difflib

from siftwarden.functions import text as tx
from siftwarden.operators import leak

TEXTS = [
    None, "", " ", "x", "you are a helpful bot", "You  are\na helpful bot", "I was told: you are a helpful bot", "bot helpful a are you",
    "été à la forêt 한글 \U0001f600", "été a la foret 한글 \U0001f600\U0001f600", "ﬁne ①②③", "fine 123", "o" * 300, "o" * 210 + "p" * 90,
    "the cat sat on the mat. " * 12, "the cat sat on the mat. " * 15, "the dog sat on the mat. " * 12,
]


def _pairs(spark):
    n = len(TEXTS)
    rows = [(i * n + j, 0, a, b) for i, a in enumerate(TEXTS) for j, b in enumerate(TEXTS)]
    table = spark.createDataFrame(rows, "txn_id bigint, turn bigint, text string, system_prompt string")
    return table.select("txn_id", "turn", "text"), table.select("txn_id", "system_prompt")


def test_every_similar_pair_is_found(spark):
    n, normal = len(TEXTS), {}
    table = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    for i, t in table.select("i", tx.normalize(table["text"])).collect():
        normal[i] = t
    want = {}
    for i, a in normal.items():
        for j, b in normal.items():
            ratio = difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0
            if ratio >= 0.6:
                want[i * n + j] = (ratio, len(a), a)
    got = {r.txn_id: (r.ratio, r.n_chars, r.norm) for r in leak.prompt_similarity(*_pairs(spark)).collect()}
    assert got == want and len(want) > len(TEXTS)


def test_texts_are_not_normalised_for_each_character(spark):
    plan = leak.prompt_similarity(*_pairs(spark))._jdf.queryExecution().optimizedPlan().toString()
    normalising = "translate("
    # What is done for each character that is counted is the part from its lambda to the bound.
    for line in plan.splitlines():
        for per_character in line.split("lambdafunction(")[1:]:
            body = per_character.split("namedlambdavariable")[0]
            assert normalising not in body, line[:300]
    filters = [line for line in plan.splitlines() if "aggregate(" in line]
    assert filters and all(line.count(normalising) <= 2 for line in filters), [line.count(normalising) for line in filters]

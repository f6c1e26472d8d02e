import json

from corpus_cases import all_cases

from siftwarden.operators import corpus
from siftwarden.operators.policy import Policy
from siftwarden.sources.readers import read_corpus


def load(spark, tmp_path, extra=""):
    path = tmp_path / "corpus.jsonl"
    path.write_text("\n".join(json.dumps(c) for c in all_cases()) + "\n" + extra)
    return read_corpus(spark, str(path))


def test_every_case_decides_as_labelled(spark, tmp_path):
    cases = load(spark, tmp_path).drop("_corrupt_record")
    decisions = corpus.run_cases(cases, Policy.default(), "salt")
    compared = corpus.compare(cases, decisions).collect()
    assert len(compared) == 54
    wrong = [r.asDict() for r in compared if not r["ok"]]
    assert wrong == []


def test_distribution_ids_and_rules(spark, tmp_path):
    cases = load(spark, tmp_path).drop("_corrupt_record")
    assert all(r["n"] == r["expected"] and r["repeated_ids"] == 0 for r in corpus.distribution(cases).collect())
    assert corpus.unknown_rules(cases, Policy.default()).count() == 0


def test_broken_lines_are_kept_apart(spark, tmp_path):
    cases = load(spark, tmp_path, '{"case_id": broken\n').cache()
    assert cases.where("_corrupt_record IS NOT NULL").count() == 1
    assert cases.where("_corrupt_record IS NULL").count() == 54

import pyarrow as pa

from siftwarden.operators import phrases


def test_a_run_is_offered_once_at_its_first_place():
    batch = pa.RecordBatch.from_pydict({"txn_id": [7, 8, 9], "folded": ["a b a b", "x\t y", ""]})
    got = [tuple(r.values()) for out in phrases._word_runs([1, 2], ["txn_id"], iter([batch])) for r in out.to_pylist()]
    assert sorted(got) == sorted([
        (7, "a", None, 0, 1), (7, "b", None, 2, 3), (7, "a b", None, 0, 3), (7, "b a", None, 2, 5),
        (8, "x", "x", 0, 1), (8, "y", "y", 3, 4), (8, "x y", "x\t y", 0, 4),
    ])

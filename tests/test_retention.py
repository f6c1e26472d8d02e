import datetime
from pathlib import Path

import pytest

from siftwarden.operators import audit

DAY = datetime.datetime(2024, 3, 10)


@pytest.fixture
def home(spark, tmp_path):
    name = f"kept_{tmp_path.name.replace('-', '_')}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/db'")
    return name, tmp_path / "db"


def files(folder):
    return {p.parent.name: {q.name for q in p.parent.glob("*.parquet")} for p in Path(folder).rglob("*.parquet")}


def times(spark, name):
    return sorted(r.id for r in spark.table(name).select("id").collect())


def test_days_are_dropped_whole(spark, home):
    db, folder = home
    # Six rows a day, four hours apart; one row without a time.
    at = [(i, DAY + datetime.timedelta(hours=4 * i)) for i in range(30)] + [(99, None)]
    audit.dated_table(spark.createDataFrame(at, "id long, created_at timestamp"), f"{db}.t")
    before = files(folder)
    assert len(before) == 6
    oldest = DAY + datetime.timedelta(days=2, hours=8)
    for _ in range(2):  # again: nothing more goes
        dropped = audit.purge_dated(spark, f"{db}.t", oldest)
        assert times(spark, f"{db}.t") == [*range(14, 30), 99]
        after = files(folder)
        assert set(before) - set(after) == {"day=2024-03-10", "day=2024-03-11"}
        assert {k for k in after if after[k] != before[k]} == {"day=2024-03-12"}
    assert dropped == 0
    # At midnight there is no border day: no file is written.
    assert audit.purge_dated(spark, f"{db}.t", DAY + datetime.timedelta(days=3)) == 1
    assert files(folder) == {k: v for k, v in after.items() if k != "day=2024-03-12"}


def test_border_days_without_rows_to_keep_or_to_drop(spark, home):
    db, folder = home
    rows = [(1, DAY), (2, DAY + datetime.timedelta(days=1, hours=20))]
    audit.dated_table(spark.createDataFrame(rows, "id long, created_at timestamp"), f"{db}.t")
    before = files(folder)
    audit.purge_dated(spark, f"{db}.t", DAY + datetime.timedelta(hours=12))
    assert times(spark, f"{db}.t") == [2]
    audit.purge_dated(spark, f"{db}.t", DAY + datetime.timedelta(days=1, hours=12))
    assert times(spark, f"{db}.t") == [2] and files(folder).items() <= before.items()
    audit.purge_dated(spark, f"{db}.t", DAY + datetime.timedelta(days=400))
    assert times(spark, f"{db}.t") == [] and files(folder) == {}
    audit.purge_dated(spark, f"{db}.t", DAY + datetime.timedelta(days=400, hours=1))
    audit.dated_table(spark.createDataFrame([], "id long, created_at timestamp"), f"{db}.none")
    assert audit.purge_dated(spark, f"{db}.none", DAY) == 0


def test_by_month(spark, home):
    db, folder = home
    at = [(i, datetime.datetime(2024, 1, 10) + datetime.timedelta(days=10 * i)) for i in range(12)]
    audit.dated_table(spark.createDataFrame(at, "id long, created_at timestamp"), f"{db}.t", unit="month")
    before = files(folder)
    assert audit.purge_dated(spark, f"{db}.t", datetime.datetime(2024, 3, 15), unit="month") == 2
    assert times(spark, f"{db}.t") == [i for i, t in at if t >= datetime.datetime(2024, 3, 15)]
    after = files(folder)
    assert {k for k in after if after[k] != before[k]} == {"day=2024-03-01"} and len(before) - len(after) == 2

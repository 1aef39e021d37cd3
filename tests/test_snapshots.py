import datetime as dt

from binweave.operators.snapshots import snapshot_changes

T = dt.datetime(2014, 1, 1)
SCHEMA = "row_id long, snapshot_no int, file_id long, ordinal long, name string, forwarder string, delivered_at timestamp, k0 string, at string"


def run(spark, rows, **kw):
    rows = [(i, *r[:5], T + dt.timedelta(days=r[5]) if r[5] is not None else None, "x", "y") for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = snapshot_changes(df, "snapshot_no", ["file_id", "ordinal"], ["name", "forwarder"], "delivered_at", "row_id", **kw)
    return sorted([(r[0], r[1], r[2], r[3], tuple(r[4])) for r in out.collect()], key=repr)


def test_kinds_and_fields(spark):
    rows = [(1, 1, 1, "a", None, 0), (1, 1, 2, "b", None, 0), (1, 1, 3, None, "f", 0), (2, 1, 1, "A", None, 0), (2, 1, 3, "n", None, 0), (2, 1, 4, "new", None, 0)]
    assert run(spark, rows) == sorted([(2, 1, 1, "changed", ("name",)), (2, 1, 2, "removed", ()), (2, 1, 3, "changed", ("forwarder", "name")), (2, 1, 4, "added", ())], key=repr)


def test_latest_delivery_holds_and_null_keys_are_keys(spark):
    rows = [(1, 1, None, "a", None, 5), (2, 1, None, "b", None, 9), (2, 1, None, "a", None, 1), (2, 1, None, "zz", None, None), (None, 1, 1, "x", None, 1)]
    assert run(spark, rows) == [(2, 1, None, "changed", ("name",))]
    rows = [(1, 1, 1, "a", None, 1), (2, 1, 1, "b", None, 3), (2, 1, 1, "a", None, 3)]
    assert run(spark, rows) == []


def test_missing_snapshot_and_range(spark):
    rows = [(1, 1, 1, "a", None, 1), (3, 1, 1, "a", None, 1)]
    assert run(spark, rows) == [(2, 1, 1, "removed", ()), (3, 1, 1, "added", ())]
    assert run(spark, rows, last=2) == [(2, 1, 1, "removed", ())]


def test_empty_and_repeated_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 1, 1, "a", None, 1)] * 5 + [(2, 1, 1, "a", None, 1)] * 3) == []

"""Queries over tables that are larger than one image can hold, or made to be slow, compared with their SQL."""

import duckdb
import pandas as pd
import pytest

from binweave.plans import binaries


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query and its SQL give the same rows over the table that a DuckDB query makes."""

    def run(name: str, table: str, made: str) -> int:
        db, path = duckdb.connect(), f"{tmp_path}/{table}.parquet"
        db.execute(f"COPY ({made}) TO '{path}' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {table} AS FROM '{path}'")
        got = [tuple(r) for r in binaries.QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(got, key=repr) == sorted(db.execute(binaries.SQL[name]).fetchall(), key=repr)
        return len(got)

    return run


def test_resources_of_more_than_one_image(same):
    # More than the tables of an image hold, and more than its data.
    assert same("ne_resources", "part", "SELECT i AS p_partkey, CAST(7 AS INT) AS p_size, 'part ' || i AS p_name FROM range(6000) t(i)") == 6000
    assert same("ne_resources", "part", "SELECT i * 100000 AS p_partkey, CAST(7 AS INT) AS p_size, repeat('x', 300000 + 17 * CAST(i AS INT)) AS p_name FROM range(8) t(i)") == 8


def test_encoded_batches_are_bounded():
    run = binaries.encode(lambda n: bytes(n)).func
    got = [list(map(len, b)) for b in run(iter([(pd.Series([3 << 20] * 20 + [0]),), pd.Series([5])]))]
    assert [n for b in got for n in b] == [3 << 20] * 20 + [0, 5]
    assert max(map(sum, got)) <= binaries._BATCH + (3 << 20)


def test_nested_containers_are_built_once(spark, same, tmp_path):
    assert same("nested_containers", "documents", "SELECT i AS doc_id, repeat('text ' || i, 1 + CAST(i * 37 % 900 AS INT)) AS text FROM range(300) t(i)") == 300
    # The discs are not built again for the rows of level 0, none of which is wanted.
    plan = binaries.nested_containers(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan


#: Every address lies in all sections of the only file, and every file offset in half of them.
_OVERLAPPING = "SELECT i AS p_partkey, 'b' AS p_brand, CAST(1000000 + i AS INT) AS p_size, 'n' AS p_name FROM range(2000) t(i)"


def joined(df) -> int:
    """The most rows that a join of the plan gives."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
    return most


def test_look_up_compares_no_pairs(spark, same, tmp_path):
    assert same("section_lookup", "part", _OVERLAPPING) == 2000
    # At most one row for each address and level of sizes, not one for each of the 4,000,000 pairs.
    assert 2000 <= joined(binaries.section_lookup(spark, str(tmp_path))) <= 2000 * 22


def test_inverse_look_up_compares_no_pairs(spark, same, tmp_path):
    assert same("section_lookup_inverse", "part", _OVERLAPPING) == 2000
    assert 2000 <= joined(binaries.section_lookup_inverse(spark, str(tmp_path))) <= 2000 * 22

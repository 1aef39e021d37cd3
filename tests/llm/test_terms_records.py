import json
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from binweave.llm.records import digest, export_records, formatting_duplicates
from binweave.llm.terms import term_frequencies


def test_terms_against_brute_force(spark):
    random.seed(4)
    rows = [(random.choice(["a", "A", "", "é", None, "x y", "hot"]), random.choice([None, *range(30)])) for _ in range(900)] + [("hot", i % 40) for i in range(600)] + [("once", 3)]
    df = spark.createDataFrame([(t, r, "extra") for t, r in rows], "term string, record long, n string")
    occurrences, records = Counter(), defaultdict(set)
    for t, r in rows:
        if t is not None:
            occurrences[t] += 1
            records[t] |= {r} - {None}
    total = len(set().union(*records.values()))
    want = {}
    for t in occurrences:
        k = len(records[t])
        want[t] = (occurrences[t], k, "rare" if k <= 1 else "common" if k * 1000 >= total * 50 else None)
    assert {r.term: (r.occurrences, r.records, r.mark) for r in term_frequencies(df, "term", "record").collect()} == want


def test_terms_bound_is_exact(spark):
    # 7 of 140 records are exactly 5 %, which floating point would miss.
    rows = [(f"t{i}", i) for i in range(140)] + [("edge", i) for i in range(7)] + [("below", i) for i in range(6)]
    got = {r.term: r.mark for r in term_frequencies(spark.createDataFrame(rows, "t string, r long"), "t", "r").collect()}
    assert got["edge"] == "common" and got["below"] is None and got["t1"] == "rare"
    assert term_frequencies(spark.createDataFrame([], "t string, r long"), "t", "r").collect() == []


LINES = [
    '["A/B.DLL"]\t1\tName', '{"name": "NAME ", "ordinal": "@1", "file": "a\\\\b.dll"}', "Ordinal = (1) ; Name= na-me | File=A B DLL", '["A","B.DLL"]\t#1\tname',
    '["A/B.DLL"]\t1\t', '{"file":"a/b.dll","ordinal":"1","name":""}', '["A/B.DLL"]\t01\tName', "file\tordinal\tname", "\t\t", "# noise", "", None, '{"broken": ', '["A/B.DLL"]\t1\tName',
    '["Ä.DLL"]\t2\tx', 'FILE=ä dll,ORDINAL=2,NAME=X', '["A/B.DLL"]\t1', "name=only", '["C"]\t3\t' + "y" * 200_000, '{"file":"c","name":"' + "Y" * 200_000 + '","ordinal":3}',
]
GROUPS = [[0, 1, 2, 3, 13], [4, 5], [6], [14, 15], [18, 19]]


NAMES = ("file", "ordinal", "name")


def run(spark, rows):
    df = spark.createDataFrame(rows, "line_id long, line string, root string")
    groups, members = formatting_duplicates(export_records(df, "line_id", "line"), "line_id", {c: F.col(c) for c in NAMES})
    return sorted(tuple(r) for r in groups.collect()), sorted(tuple(r) for r in members.collect())


def test_records(spark):
    groups, members = run(spark, [(i, x, "r") for i, x in enumerate(LINES)])
    assert groups == sorted((g[0], len(g)) for g in GROUPS)
    assert members == sorted((g[0], i) for g in GROUPS for i in g[1:])


def test_records_hot_group_ties_and_empty(spark):
    rows = [(i, '["A"]\t1\tx' if i % 3 else f'["A"]\t{i}\tx', "r") for i in range(6000)]
    groups, members = run(spark, rows)
    assert groups[1] == (1, 4000) and len(members) == 3999 and {m[0] for m in members} == {1}
    groups, members = run(spark, [(7, '["A"]\t1\tx', "r")] * 3 + [(None, '["A"]\t1\tX', "r")])
    assert groups == [(7, 4)] and members == []
    assert run(spark, []) == ([], [])


def test_json_layout_keys_in_any_case_and_order(spark):
    groups, _ = run(spark, [(1, json.dumps({"Name": "a", "FILE": "b", "ordinal": "3"}), "r"), (2, json.dumps({"ordinal": 3, "file": "B", "name": "A"}), "r")])
    assert groups == [(1, 2)]


def test_equal_keys_of_an_object_do_not_end_the_query(spark):
    lines = ['{"File":"a","file":"b","ordinal":"1","name":"x","NAME":"y"}', '{"file":"a","ordinal":"1","name":"x"}', '{"file":"a","file":"c","ordinal":"1","name":"x"}', "file=a;FILE=b;ordinal=1;name=x"]
    groups, members = run(spark, [(i, x, "r") for i, x in enumerate(lines)])
    assert groups == [(0, 4)] and members == [(0, 1), (0, 2), (0, 3)]


def test_different_records_with_equal_roots_are_told_apart(spark):
    rows = [(i, f'["F{i % 3}"]\t1\tx') for i in range(30)] + [(100, '["G"]\t1\tx')]
    df = spark.createDataFrame(rows, "line_id long, line string")
    for root in (lambda c, t: F.lit(1), lambda c, t: F.pmod(digest(c, t), F.lit(2))):
        groups, members = formatting_duplicates(export_records(df, "line_id", "line"), "line_id", {c: F.col(c) for c in NAMES}, root)
        assert sorted(map(tuple, groups.collect())) == [(0, 10), (1, 10), (2, 10), (100, 1)]
        assert sorted(map(tuple, members.collect())) == sorted((i % 3, i) for i in range(3, 30))


def test_nested_records(spark):
    rows = [
        (1, ["A", "b"], {"x": "1", "Y": "Z"}, (1, "T")), (2, ["a", "B!"], {"y": "z", "X": "1 "}, (1, "t")), (3, ["b", "a"], {"x": "1", "y": "z"}, (1, "t")),
        (4, ["ab"], {"x": "1", "y": "z"}, (1, "t")), (5, ["a", "b"], {"x": "1"}, (1, "t")), (6, ["a", None], {"x": "1"}, (1, "t")), (7, ["a", ""], {"x": "1"}, (1, "t")), (8, None, None, None), (9, ["a"], None, None), (10, ["A"], None, None),
    ]
    df = spark.createDataFrame(rows, "line_id long, p array<string>, m map<string,string>, s struct<k:int,v:string>")
    groups, members = formatting_duplicates(df, "line_id", {c: F.col(c) for c in "pms"})
    assert sorted(map(tuple, members.collect())) == [(1, 2), (9, 10)] and groups.count() == 7

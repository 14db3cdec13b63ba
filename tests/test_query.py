"""The query and update algebra over nested documents with missing, empty and repeated values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docsieve.operators import query as q, update as up
from docsieve.operators.query import all_of, any_of
from docsieve.operators.update import Update

INNER = "nested_string_field string, nested_string_list array<string>, nested_object struct<nested_nested_string_field string>"
SCHEMA = f"id int, string_field string, string_fields array<string>, bool_field boolean, long_field bigint, nested_list array<struct<{INNER}>>, nested_object struct<{INNER}>, map map<string,string>"


@pytest.fixture(scope="module")
def docs(spark):
    item = lambda text, deep=None: (text, [text] if text else None, (deep,) if deep else None)
    rows = [
        (1, "a", ["x", "y"], True, 10, [item("n1", "d1"), item("n2")], item("n1", "d1"), {"k": "v"}),
        (2, "b", ["y", "y", "z"], False, 20, [item("n2")], item("n2"), {"k": "w"}),
        (3, "", [], None, None, [], None, {}),
        (4, None, None, True, 10, None, item(None, "d1"), None),
        (5, "a", ["x"], False, 30, [item("n3", "d3")], item("n3", "d3"), {"other": "v"}),
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


def ids(df):
    return sorted(row["id"] for row in df.collect())


CASES = [
    (all_of(), [1, 2, 3, 4, 5]),
    (all_of().when("string_field", "a"), [1, 5]),
    (all_of().when("string_fields", "y"), [1, 2]),
    (all_of().when_not("string_field", "a"), [2, 3, 4]),
    (all_of().when_not("string_fields", "x"), [2, 3, 4]),
    (all_of().with_any("string_field", ["b", ""]), [2, 3]),
    (all_of().with_any("string_field", []), []),
    (all_of().with_any("string_fields", ["x", "z"]), [1, 2, 5]),
    (all_of().with_all("string_fields", ["x", "y"]), [1]),
    (all_of().with_all("string_field", ["a"]), [1, 5]),
    (all_of().range_above("long_field", 10, True), [2, 5]),
    (all_of().range_above("long_field", 10), [1, 2, 4, 5]),
    (all_of().range_below("long_field", 20), [1, 2, 4]),
    (all_of().range_below("long_field", 20, True), [1, 4]),
    (all_of().range_in("long_field", 10, True, 30, True), [2]),
    (all_of().range_in("long_field", 10, False, 30, True), [1, 2, 4]),
    (all_of().range_in("long_field", 10, True, 30, False), [2, 5]),
    (all_of().range_in("long_field", None, True, 20, False), [1, 2, 4]),
    (all_of().range_above("string_fields", "y", True), [2]),
    (all_of().with_present("string_field"), [1, 2, 3, 5]),
    (all_of().with_not_present("string_field"), [4]),
    (all_of().with_not_present("no_such_field"), [1, 2, 3, 4, 5]),
    (all_of().when("no_such_field", 1), []),
    (all_of().when_not("no_such_field", 1), [1, 2, 3, 4, 5]),
    (all_of().when("nested_object.nested_string_field", "n2"), [2]),
    (all_of().when("nested_list.nested_string_field", "n2"), [1, 2]),
    (all_of().when("nested_list.nested_object.nested_nested_string_field", "d3"), [5]),
    (all_of().when("nested_list.nested_string_list", "n1"), [1]),
    (all_of().when("map.k", "v"), [1]),
    (all_of().nested("nested_object", any_of().when("nested_string_field", "n1").when("nested_object.nested_nested_string_field", "d1")), [1]),
    (all_of().nested("nested_object", all_of(any_of().when("nested_string_field", "n1").when("nested_string_field", "n3"))), [1, 5]),
    (any_of().when("string_field", "b").when("long_field", 30), [2, 5]),
    (any_of(all_of().when("string_field", "a").when("bool_field", True), all_of().with_not_present("long_field")), [1, 3]),
    (all_of(any_of().when("long_field", 10).when("long_field", 20)).when("bool_field", True), [1, 4]),
    (q.by_example({"string_field": "a", "nested_object": {"nested_string_field": "n3", "nested_string_list": None}}), [5]),
]


@pytest.mark.parametrize("index", range(len(CASES)))
def test_predicates(docs, index):
    query, expected = CASES[index]
    assert ids(query.filter(docs)) == expected


def test_document_precedence(docs):
    document = {"and": [{"when": {"string_field": "a"}}], "or": [{"when": {"id": 2}}], "when": {"id": 3}}
    assert ids(q.from_document(document).apply(docs)) == [1, 5]
    ranged = {"rangeBelow": {"long_field": [20, True]}, "rangeAbove": {"long_field": [5, False]}, "withPresent": ["string_field"], "withNotPresent": ["none"]}
    assert ids(q.from_document(ranged).apply(docs)) == [1]
    both = {"or": [{"withAll": {"string_fields": ["y", "z"]}}, {"whenNot": {"bool_field": True}, "rangeIn": {"long_field": [[30, False], [None, False]]}}]}
    assert ids(q.from_document(both, limit=10).apply(docs)) == [2, 5]


def test_order_limit_projection(docs):
    found = all_of().order_by(("long_field", 1)).order_by(("id", -1)).limit(3).only("id", "nested_object.nested_string_field").apply(docs)
    rows = found.collect()
    assert [row["id"] for row in rows] == [3, 4, 1]
    assert rows[2]["nested_object"].asDict() == {"nested_string_field": "n1"}
    assert all_of().without("map", "nested_object.nested_string_list").apply(docs).schema["nested_object"].dataType.fieldNames() == ["nested_string_field", "nested_object"]
    assert all_of().without().apply(docs).columns == docs.columns
    inner_limit_is_ignored = all_of(all_of().with_present("id").limit(1))
    assert inner_limit_is_ignored.apply(docs).count() == 5


def test_scoped_view_applies_everywhere(docs):
    mine = q.scoped(docs, all_of().when("bool_field", True))
    assert ids(all_of().when("long_field", 10).filter(mine)) == [1, 4]
    assert q.count_by(mine).first()["n"] == 2
    assert q.exists_by(mine, all_of().when("id", 2)).first()["found"] is False


def one(df, row_id, column):
    return df.filter(F.col("id") == row_id).first()[column]


def test_updates(docs):
    where = all_of().with_any("id", [1, 3, 4]).column(docs.schema)
    changed = Update().set("string_field", "new").increment("long_field", 5).add("string_fields", ["x", "q"], dedup=True).apply(docs, where)
    assert [one(changed, i, "string_field") for i in (1, 2, 3)] == ["new", "b", "new"]
    assert [one(changed, i, "long_field") for i in (1, 2, 3)] == [15, 20, 5]
    assert [one(changed, i, "string_fields") for i in (1, 2, 3, 4)] == [["x", "y", "q"], ["y", "y", "z"], ["x", "q"], ["x", "q"]]
    pushed = Update().add("string_fields", "y").remove("string_fields", ["x"]).unset("bool_field").apply(docs)
    assert [one(pushed, i, "string_fields") for i in (1, 2, 4)] == [["y", "y"], ["y", "y", "z", "y"], ["y"]]
    assert pushed.filter(F.col("bool_field").isNotNull()).count() == 0


def test_nested_updates(docs):
    update = Update().nested("nested_object", Update().set("nested_string_field", "s").unset("nested_string_list"))
    update = update.set("map.k", "changed").remove("nested_list", all_of().when("nested_string_field", "n2"))
    changed = update.apply(docs)
    assert one(changed, 2, "nested_object")["nested_string_field"] == "s"
    assert one(changed, 2, "nested_object")["nested_string_list"] is None
    assert one(changed, 1, "map") == {"k": "changed"} and one(changed, 5, "map") == {"other": "v", "k": "changed"}
    assert [item["nested_string_field"] for item in one(changed, 1, "nested_list")] == ["n1"]
    assert one(changed, 2, "nested_list") == []


def test_one_row_variants_and_documents(docs):
    where = all_of().when("string_field", "a")
    assert ids(up.delete_one(docs, where, "id")) == [2, 3, 4, 5]
    assert ids(up.delete_many(docs, where)) == [2, 3, 4]
    updated = up.update_one(docs, where, Update().set("long_field", 0), "id")
    assert [one(updated, i, "long_field") for i in (1, 5)] == [0, 30]
    query, update = up.from_update_document({"query": {"when": {"id": 2}}, "set": {"string_field": "z"}, "increment": {"long_field": 2}, "unset": ["bool_field"], "add": {"string_fields": ["n", False]}, "remove": {"string_fields": "y"}})
    after = up.update_and_return(docs, query, update).first()
    assert (after["string_field"], after["long_field"], after["bool_field"], after["string_fields"]) == ("z", 22, None, ["z", "n"])
    assert up.update_and_return(docs, query, update, before=True).first()["string_field"] == "b"
    assert up.updated_count(docs, where).first()["n"] == 2


def test_upsert_and_insert(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 2)], "_id string, v int")
    changes = spark.createDataFrame([("b", 3), ("c", 4)], "_id string, v int")
    assert {tuple(row) for row in up.upsert(stored, changes).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    rows = spark.createDataFrame([("b", 9), (None, 5)], "_id string, v int")
    result, refused = up.insert_new(stored, rows)
    assert result.count() == 3 and [row["v"] for row in refused.collect()] == [9]
    assert result.filter("_id is null").count() == 0

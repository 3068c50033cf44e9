"""Wells chosen for documents, and their records moved."""

from wellframe.operators import assignment


def test_assignment(spark):
    wells = spark.createDataFrame([("w1",), ("w2",), ("w3",)], "well_id string")
    bores = spark.createDataFrame([("w1", "b1", "A", True), ("w1", "b0", "B", True), ("w1", "bx", "0", False), ("w2", "b2", "A", True)], "well_id string, wellbore_id string, name string, is_primary boolean")
    rows = [
        (1, "f1", "d1", "approve", '{"raw": "x", "value": "w1"}', None),
        (2, "f2", "d2", "edit", '{"value": null}', '"w2"'),
        (3, "f3", "d3", "edit", None, None),
        (4, "f4", "d4", "approve", '{"value": null}', None),
        (5, "f5", "d5", "edit", None, '{"value": "nope"}'),
        (6, "f6", "d6", "reject", '{"value": "w1"}', None),
        (7, "f7", "d7", "edit", None, "w3"),
        (8, "f8", "d8", "edit", None, '{"value": "w1"}'),
        (9, "f9", "d9", "drop", None, None),
    ]
    got = assignment.decided(spark.createDataFrame(rows, "seq int, field_id string, doc_id string, action string, old_value string, new_value string"), wells, bores)
    assert {r.seq: (r.result, r.new_status, r.well_id, r.wellbore_id) for r in got.collect()} == {
        1: ("ok", "approved", "w1", "b1"), 2: ("ok", "edited", "w2", "b2"), 3: ("value_required", None, None, None), 4: ("empty_value", None, None, None), 5: ("no_such_well", None, None, None),
        6: ("ok", "rejected", None, None), 7: ("ok", "edited", "w3", None), 8: ("ok", "edited", "w1", "b1"), 9: ("bad_action", None, None, None),
    }
    to = assignment.moves(got)
    records = spark.createDataFrame([(1, "d1", None), (2, "d1", "old"), (3, "d6", "old"), (4, None, "old"), (5, "d2", "old")], "id int, doc_id string, wellbore_id string")
    assert {r.id: r.wellbore_id for r in assignment.moved(records, to).collect()} == {1: "b1", 2: "b1", 3: "old", 4: "old", 5: "b2"}
    tops = [(1, "d1", "old", "T", "actual"), (2, "d1", "old", "U", "actual"), (3, "other", "b1", "T", "actual"), (4, "d8", "old", "U", "actual"), (5, "d8", "b1", "V", "actual"), (6, "d2", "old", "T", "actual"), (7, None, "old", "T", "actual"), (8, "d1", "old", "T", "predicted")]
    out = assignment.moved_tops(spark.createDataFrame(tops, "id int, doc_id string, wellbore_id string, formation string, source string"), to)
    assert {r.id: r.wellbore_id for r in out.collect()} == {2: "b1", 3: "b1", 5: "b1", 6: "b2", 7: "old", 8: "b1"}

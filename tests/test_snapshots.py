"""Constraints, transactions and changes of snapshot tables."""

import pytest

from sparkloom.sources import store
from sparkloom.sources.snapshots import ConstraintError, Constraints, Signal, SnapshotTable, signal_if


@pytest.fixture
def users(spark, tmp_path):
    rules = Constraints(primary_key=["id"], not_null=["name"], checks={"age": "age >= 0"}, defaults={"age": "18"}, generated={"twice": "age * 2"})
    table = SnapshotTable(spark, str(tmp_path), "users", "id int, name string, age int, twice int", rules)
    table.insert(spark.createDataFrame([(1, "Ann"), (2, "Bob")], "id int, name string"))
    return table


def rows(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_defaults_and_generated(users):
    assert rows(users) == [(1, "Ann", 18, 36), (2, "Bob", 18, 36)]


@pytest.mark.parametrize("bad", [(1, "twin", 5), (3, None, 5), (3, "x", -1)])
def test_constraints_keep_the_old_rows(spark, users, bad):
    with pytest.raises(ConstraintError):
        users.insert(spark.createDataFrame([bad], "id int, name string, age int"))
    assert len(rows(users)) == 2


def test_update_where_null_is_not_true(spark, users):
    users.insert(spark.createDataFrame([(3, "Cy", None)], "id int, name string, age int"))
    users.update("age > 10", {"name": "upper(name)"})
    assert [r[1] for r in rows(users)] == ["ANN", "BOB", "Cy"]
    users.delete("age > 10")
    assert [r[0] for r in rows(users)] == [3]


def test_savepoints_and_changes(users):
    users.savepoint("here")
    users.update("id = 1", {"name": "'Zoe'"})
    users.delete("id = 2")
    assert sorted(r.op for r in users.changes(-3, ["id"]).collect()) == ["D", "U"]
    users.rollback("here")
    assert [r[1] for r in rows(users)] == ["Ann", "Bob"]


def test_foreign_keys(spark, users, tmp_path):
    orders = SnapshotTable(spark, str(tmp_path), "orders", "o int, user int", Constraints(foreign_keys=[("user", users, "id")]))
    orders.insert(spark.createDataFrame([(1, 1), (2, 2), (3, None)], "o int, user int"))
    with pytest.raises(ConstraintError):
        orders.insert(spark.createDataFrame([(4, 9)], "o int, user int"))
    users.delete("id = 2")
    orders.cascade_from(users, "user", "id", set_null=True)
    assert sorted(tuple(r) for r in orders.read().fillna(-1).collect()) == [(1, 1), (2, -1), (3, -1)]


def test_a_refused_insert_leaves_nothing(spark, users):
    before = store.names(spark, users.folder)
    with pytest.raises(ConstraintError):
        users.insert(spark.createDataFrame([(1, "twin")], "id int, name string"))
    assert store.names(spark, users.folder) == before


def test_another_process_opens_the_table(spark, users, tmp_path):
    users.savepoint("two")
    users.insert(spark.createDataFrame([(3, "Cy")], "id int, name string"))
    again = SnapshotTable(spark, str(tmp_path), "users", "ignored int", users.constraints)
    assert rows(again) == rows(users) and len(rows(again)) == 3
    again.rollback("two")
    assert len(rows(again)) == 2
    with pytest.raises(FileExistsError):  # the first one does not know of the new version
        users.truncate()


def test_returning(spark, users):
    assert [tuple(r) for r in users.update("id = 2", {"age": "age + 2"}).collect()] == [(2, "Bob", 20, 40)]
    assert [r.id for r in users.delete("age > 19").collect()] == [2]
    made = users.insert(spark.range(9, 10).selectExpr("cast(id as int) id", "uuid() as name"))
    assert made.first().name == [r[1] for r in rows(users) if r[0] == 9][0]


def test_triggers(spark, users, tmp_path):
    audit, calls = SnapshotTable(spark, str(tmp_path), "audit", "id int, what string"), []
    users.on("after delete", lambda gone: audit.insert(gone.selectExpr("id", "'gone' as what")))
    users.on("after insert", lambda new: audit.insert(new.selectExpr("id", "'new' as what")))
    users.on("after update statement", lambda nothing: calls.append(nothing))
    users.on("before delete", lambda gone: gone.filter("id <> 1"))
    users.on("before insert", signal_if("age > 150", "too old"))
    users.insert(spark.createDataFrame([(3, "Cy")], "id int, name string"))
    with pytest.raises(Signal, match="too old"):
        users.insert(spark.createDataFrame([(4, "Di", 151)], "id int, name string, age int"))
    users.update("id = 3", {"age": "40"})
    users.delete("true")
    assert [r[0] for r in rows(users)] == [1] and calls == [None]
    assert sorted(tuple(r) for r in audit.read().collect()) == [(2, "gone"), (3, "gone"), (3, "new")]


def test_transaction(spark, users):
    with pytest.raises(ZeroDivisionError), users.transaction():
        users.delete("true")
        1 / 0
    with users.transaction() as t:
        t.delete("id = 1")
    assert [r[0] for r in rows(users)] == [2]


def test_change_log(spark, users):
    users.enable_cdc()
    users.update("id = 1", {"age": "30"})
    first = users.change_log().agg({"seq": "max"}).first()[0]
    users.insert(spark.createDataFrame([(5, "Ed")], "id int, name string"))
    users.delete("id = 2")
    assert sorted(r.op for r in users.change_log().collect()) == ["D", "I", "U"]
    late = users.change_log(after=first).orderBy("seq").collect()
    assert [(r.op, r.table) for r in late] == [("I", "users"), ("D", "users")] and late[1].new_data is None


def test_alter_carries_constraints(spark, users):
    users.alter(rename={"age": "years", "id": "key"}, drop=["twice"])
    with pytest.raises(ConstraintError, match="CHECK"):
        users.insert(spark.createDataFrame([(7, "Flo", -1)], "key int, name string, years int"))
    with pytest.raises(ConstraintError, match="UNIQUE"):
        users.insert(spark.createDataFrame([(1, "Gus", 1)], "key int, name string, years int"))


def test_upsert(spark, users):
    with pytest.raises(ConstraintError, match="two new rows"):
        users.upsert(spark.createDataFrame([(8, "a"), (8, "b")], "id int, name string"), ["id"])
    users.upsert(spark.createDataFrame([(2, "Bea"), (3, "Cy")], "id int, name string"), ["id"])
    assert [r[1] for r in rows(users)] == ["Ann", "Bea", "Cy"]


def test_vacuum(spark, users):
    users.update("true", {"age": "20"})
    assert users.vacuum() == len(["empty", "insert"])
    assert len(rows(users)) == 2 and len([n for n in store.names(spark, users.folder) if n.startswith("part-")]) == 2

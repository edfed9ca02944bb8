"""Typed tables: constraints, writes, foreign keys, triggers, transactions, migration, storage."""

import pytest

from brindle import Agg, ConditionGroup, ConstraintError, Engine, QueryError, SchemaError, StorageError, TransactionError, TypeCastError, migration


def users(t):
    t.id()
    t.varchar("name", 8).not_null().unique()
    t.tinyint("age").unsigned().default(18)
    t.enum("kind", ["a", "b"])
    t.check("adult", ConditionGroup().where("age", ">=", 18))


def posts(action):
    def define(t):
        t.id()
        t.bigint("user_id")
        t.foreign_key("user_id").references("users", "id").on_delete(action).on_update("CASCADE")

    return define


@pytest.fixture()
def db(spark):
    e = Engine(spark)
    e.create_table("users", users)
    return e


def rows(e, t, *columns):
    return [tuple(r[c] for c in columns) for r in e.table(t).order_by(columns[0]).get()]


def test_insert_and_rules(db):
    t = db.table("users")
    r = t.insert_many([{"name": "al"}, {"name": "bo", "age": "30", "kind": "b"}])
    assert (r.row_count, r.last_insert_id) == (2, 2)
    assert t.insert({"id": 7, "name": "cy"}).last_insert_id == 7
    assert t.insert({"name": "di"}).last_insert_id == 8
    assert rows(db, "users", "id", "name", "age") == [(1, "al", 18), (2, "bo", 30), (7, "cy", 18), (8, "di", 18)]
    for row, error in (
        ({"name": "al"}, ConstraintError), ({"name": "x", "age": 17}, ConstraintError), ({"name": None}, ConstraintError), ({"name": "x", "nope": 1}, QueryError),
        ({"name": "x" * 9}, TypeCastError), ({"name": "x", "age": 256}, TypeCastError), ({"name": "x", "kind": "c"}, TypeCastError), ({"id": 7, "name": "x"}, ConstraintError),
    ):
        with pytest.raises(error):
            t.insert(row)
    with pytest.raises(ConstraintError):
        t.insert_many([{"name": "p"}, {"name": "p"}])
    assert db.table("users").count() == 4  # a failed batch leaves nothing
    assert db.table("users").find(7)["name"] == "cy"


def test_upsert_ignore_replace(db):
    t = db.table("users")
    assert (t.upsert({"name": "al", "age": 20}), t.upsert({"name": "al", "age": 21}), t.insert_ignore({"name": "al"}), t.insert_ignore({"name": "bo"})) == (1, 2, 0, 1)
    assert t.replace({"id": 2, "name": "al"}) == 3  # two rows go, one comes
    assert rows(db, "users", "id", "name", "age") == [(2, "al", 18)]


def test_update_delete_with_order_and_limit(db):
    t = db.table("users")
    t.insert_many([{"name": n} for n in "abcd"])
    assert t.order_by_desc("name").limit(2).update({"age": 40}) == 2
    assert rows(db, "users", "name", "age") == [("a", 18), ("b", 18), ("c", 40), ("d", 40)]
    assert t.where("age", 40).order_by("name").limit(1).delete() == 1
    assert t.where("name", "zz").update({"age": 50}) == 0
    with pytest.raises(ConstraintError):
        t.update({"name": "same"})
    with pytest.raises(ConstraintError):
        t.where("name", "a").update({"age": 1})
    with pytest.raises(QueryError):
        t.select("id").update({"age": 50})
    assert rows(db, "users", "name", "age") == [("a", 18), ("b", 18), ("d", 40)]


@pytest.mark.parametrize("action,left", [("CASCADE", [2]), ("SET_NULL", [1, 2, 3])])
def test_foreign_keys(db, action, left):
    db.create_table("posts", posts(action))
    db.table("users").insert_many([{"name": "a"}, {"name": "b"}])
    db.table("posts").insert_many([{"user_id": 1}, {"user_id": 2}, {"user_id": 1}])
    with pytest.raises(ConstraintError):
        db.table("posts").insert({"user_id": 9})
    db.table("users").where("id", 2).update({"id": 20})
    assert db.table("posts").where("user_id", 20).count() == 1
    assert db.table("users").where("id", 1).delete() == 1
    assert [r[0] for r in rows(db, "posts", "id")] == left
    with pytest.raises(SchemaError):
        db.drop_table("users")


def test_restrict_and_self_reference(db):
    db.create_table("posts", posts("RESTRICT"))
    db.table("users").insert({"name": "a"})
    db.table("posts").insert({"user_id": 1})
    with pytest.raises(ConstraintError):
        db.table("users").delete()
    assert db.table("users").count() == 1

    def nodes(t):
        t.int("id").primary_key()
        t.int("up")
        t.foreign_key("up").references("nodes", "id").on_delete("CASCADE")

    db.create_table("nodes", nodes)
    db.table("nodes").insert({"id": 1})
    db.table("nodes").insert({"id": 2, "up": 1})
    db.table("nodes").insert({"id": 3, "up": 2})
    db.table("nodes").where("id", 1).update({"up": 3})  # a cycle
    assert db.table("nodes").where("id", 2).delete() == 1
    assert db.table("nodes").count() == 0


def test_joined_writes(db):
    db.create_table("posts", posts("CASCADE"))
    db.table("users").insert_many([{"name": "a"}, {"name": "b"}])
    db.table("posts").insert_many([{"user_id": 1}, {"user_id": 1}, {"user_id": 2}])
    q = db.table("users u").join("posts p", "u.id", "=", "p.user_id").where("u.name", "a")
    assert q.update({"u.age": 33}) == 1
    assert db.table("posts p").join("users u", "u.id", "=", "p.user_id").where("u.age", 33).delete() == 2
    assert rows(db, "users", "name", "age") == [("a", 33), ("b", 18)]


def test_insert_select_numbers_rows(db, spark):
    db.register("source", spark.range(5000).selectExpr("concat('n', id) as name", "cast(20 as int) as age"))
    db.table("users").insert({"name": "first"})
    assert db.table("users").insert_select(db.table("source").select("name", "age")) == 5000
    assert db.table("users").select(Agg.min("id").as_("lo"), Agg.max("id").as_("hi"), Agg.count().as_("n")).first() == {"lo": 1, "hi": 5001, "n": 5001}
    with pytest.raises(ConstraintError):
        db.table("users").insert_select(db.table("source").select("name"))
    with pytest.raises(QueryError):
        db.table("users").insert_select(db.table("users").select("name"))


def test_case_folding_is_for_predicates_only(spark):
    e = Engine(spark)

    def define(t):
        t.varchar("name", 8).ci().unique()

    e.create_table("w", define)
    e.table("w").insert_many([{"name": "Al"}, {"name": "al"}, {"name": "Bo"}])
    assert e.table("w").where("name", "AL").count() == 2
    assert e.table("w").where_like("name", "b%").count() == 1
    assert len(e.table("w").select(Agg.count().as_("n")).group_by("name").get()) == 3


def test_triggers(db):
    log = []
    before = db.create_trigger("users", "before", "insert", lambda row: {**row, "name": row["name"].upper()})
    db.create_trigger("users", "AFTER", "update", lambda old, new: log.append((old["age"], new["age"])))
    db.create_trigger("users", "before", "delete", lambda row: log.append(row["name"]))
    db.table("users").insert({"name": "al"})
    db.drop_trigger(before)
    db.table("users").update({"age": 50})
    db.table("users").delete()
    assert log == [(18, 50), "AL"]
    with pytest.raises(QueryError):
        db.drop_trigger(before)


def test_transactions(db):
    t = db.table("users")
    db.begin()
    t.insert({"name": "a"})
    db.savepoint("s")
    t.insert({"name": "b"})
    db.create_table("extra", users)
    db.roll_back_to("s")
    assert t.count() == 1 and not db.has_table("extra")
    db.release_savepoint("s")
    with pytest.raises(TransactionError):
        db.roll_back_to("s")
    db.commit()
    db.begin()
    t.delete()
    db.roll_back()
    assert t.count() == 1
    for wrong in (db.commit, db.roll_back, lambda: db.savepoint("x")):
        with pytest.raises(TransactionError):
            wrong()
    assert t.insert({"name": "c"}).last_insert_id == 2


def test_alter_index_view(db):
    db.table("users").insert_many([{"name": "a"}, {"name": "b"}])
    db.alter_table("users", lambda t: (t.rename_column("age", "years"), t.drop_column("kind"), t.int("score").not_null().default(5)))
    assert rows(db, "users", "name", "years", "score") == [("a", 18, 5), ("b", 18, 5)]
    with pytest.raises(ConstraintError):
        db.table("users").insert({"name": "c", "years": 3})  # the check follows the rename
    with pytest.raises(SchemaError):
        db.alter_table("users", lambda t: t.drop_column("name"))
    db.create_index("users", "by_years", "years")
    assert db.table("users").where("years", 18).explain()[0]["via"].startswith("INDEX by_years")
    db.drop_index("users", "by_years")
    db.create_view("old", db.table("users").select("name").where("years", ">", 10))
    assert db.view("old").where("name", "b").get().pluck("name") == ["b"]
    with pytest.raises(SchemaError):
        db.drop_table("users")
    db.drop_view("old")
    db.rename_table("users", "people")
    assert db.table("people").count() == 2
    db.table("people").truncate()
    assert db.table("people").count() == 0


def test_store_lasts(spark, tmp_path):
    root = str(tmp_path / "db")
    e = Engine(spark, root)
    e.create_table("users", users)
    e.table("users").insert({"name": "a"})
    e.create_database("other")
    again = Engine(spark, root)
    assert again.table("users").get().pluck("name") == ["a"] and again.databases() == ["main", "other"]
    again.table("users").insert({"name": "b"})
    assert e.table("users").insert({"name": "c"}).last_insert_id == 3  # sees the other's commit
    e.begin()
    again.table("users").insert({"name": "d"})
    e.table("users").insert({"name": "e"})
    with pytest.raises(TransactionError):
        e.commit()
    e.roll_back()
    again.backup(str(tmp_path / "copy"))
    assert Engine(spark, str(tmp_path / "copy")).table("users").count() == 4
    assert again.vacuum() == 0  # young files may be another writer's
    assert again.vacuum(grace=0) >= 1 and again.table("users").count() == 4
    with pytest.raises(StorageError):
        again.use("nope")


def test_migration(db, spark):
    target = Engine(spark)
    target.create_table("users", lambda t: (users(t), t.int("score").default(1), t.index("age")))
    target.create_table("tags", lambda t: t.id())
    db.create_table("old", lambda t: t.id())
    plan = migration.diff(target, db)
    assert [s["op"] for s in plan] == ["createTable", "addColumn", "createIndex", "dropTable"]
    assert migration.apply(db, plan) == []
    assert migration.diff(target, db) == []


def folders(e, *path):
    return e.store.files.names("/".join([e.store.root, *path]))


def test_small_parts_are_merged_and_nothing_held_stays(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.create_table("users", users)
    t = e.table("users")
    for i in range(40):
        t.insert({"name": f"n{i}"})
        assert len(e.entry("users")["parts"]) <= 16
    assert folders(e, "_aside") == [] and t.count() == 40
    for i in range(8):
        t.where("id", i + 1).update({"age": 40 + i})
        t.where("name", f"n{20 + i}").delete()
        t.upsert({"name": f"n{i}", "age": 60})
    assert folders(e, "_aside") == [] and rows(e, "users", "id", "age")[:9] == [(i + 1, 60) for i in range(8)] + [(9, 18)]
    named = len(e.entry("users")["parts"])
    assert e.vacuum(grace=0) > 0 and len(folders(e, "main", "users")) == named
    e.compact("users")
    assert len(e.entry("users")["parts"]) == 1 and t.count() == 32 and e.vacuum(grace=0) == named
    assert [r["name"] for r in t.order_by("age").get()][-8:] == [f"n{i}" for i in range(8)]  # ties keep the order of insertion


def test_a_failed_write_leaves_nothing_held(db):
    db.table("users").insert_many([{"name": "a"}, {"name": "b"}])
    with pytest.raises(ConstraintError):
        db.table("users").update({"name": "same"})
    assert folders(db, "_aside") == [] and db.table("users").count() == 2


def test_two_writers(spark, tmp_path):
    root = str(tmp_path / "db")
    one = Engine(spark, root)
    one.create_table("users", users)
    two = Engine(spark, root)
    one.table("users").insert({"name": "a"})
    assert two.table("users").insert_ignore({"name": "a"}) == 0  # sees the other's row
    one.store.files.create(f"{root}/_catalog/x.json", "{}")
    with pytest.raises(Exception, match="x.json"):
        one.store.files.create(f"{root}/_catalog/x.json", "{}")
    one.store.files.remove(f"{root}/_catalog/x.json")
    assert all(not n.startswith(".") for n in folders(one, "_catalog"))
    # A part that the other has staged and not committed survives a vacuum.
    two.begin()
    two.table("users").insert({"name": "b"})
    assert one.vacuum() == 0
    two.commit()
    assert Engine(spark, root).table("users").count() == 2


def test_stores_that_cannot_keep_writers_apart_are_refused(spark, tmp_path, monkeypatch):
    from brindle.sources import store

    monkeypatch.setattr(store.Files, "scheme", "s3a")
    with pytest.raises(StorageError):
        store.Store(spark, str(tmp_path / "x"))
    assert store.Store(spark, str(tmp_path / "x"), single_writer=True).durable


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace as Fake

    from brindle.sources.shared import shared_folder

    undefined = Fake(isDefined=lambda: False)
    session = Fake(conf=Fake(get=lambda *_: None), sparkContext=Fake(master="spark://host:7077", _jsc=Fake(sc=lambda: Fake(getCheckpointDir=lambda: undefined))))
    with pytest.raises(StorageError):
        shared_folder(session)


def test_triggers_see_many_rows_in_batches(db, monkeypatch):
    from brindle import dml

    monkeypatch.setattr(dml, "TRIGGER_ROWS", 3)
    db.table("users").insert_many([{"name": f"n{i}"} for i in range(10)])
    db.create_trigger("users", "before", "update", lambda old, new: {**new, "age": new["age"] + old["id"]})
    seen = []
    db.create_trigger("users", "after", "update", lambda old, new: seen.append((old["age"], new["age"])))
    assert db.table("users").where("id", ">", 2).update({"age": 30}) == 8
    assert seen == [(18, 30 + i) for i in range(3, 11)]
    assert rows(db, "users", "id", "age") == [(1, 18), (2, 18)] + [(i, 30 + i) for i in range(3, 11)]


def test_encrypted_store(spark, tmp_path):
    root, key = str(tmp_path / "db"), b"0123456789abcdef"
    e = Engine(spark, root, key=key)

    def define(t):
        t.int("id").primary_key()
        t.varchar("name", 20)
        t.decimal("price", 12, 2)
        t.double("x")
        t.date("day")

    e.create_table("t", define)
    e.table("t").insert_many([{"id": 1, "name": "very secret", "price": "12.50", "x": 0.1, "day": "2024-02-29"}, {"id": 2}])
    e.table("t").where("id", 2).update({"name": "secret too"})
    again = Engine(spark, root, key=key)
    assert [tuple(r.values()) for r in again.table("t").order_by("id").get()] == [tuple(r.values()) for r in e.table("t").order_by("id").get()]
    assert again.table("t").where("name", "very secret").first()["x"] == 0.1 and str(again.table("t").find(1)["price"]) == "12.50"
    assert not any(b"secret" in p.read_bytes() for p in (tmp_path / "db").rglob("*.parquet"))
    with pytest.raises(Exception, match="AES|decrypt"):
        Engine(spark, root, key=b"fedcba9876543210").table("t").get().rows()


def test_lookups_skip_row_groups(spark, tmp_path):
    """Rows lie sorted by the primary key within a file, whatever order they came in."""
    e = Engine(spark)

    def define(t):
        t.bigint("id").primary_key()

    e.create_table("t", define)
    e.register("source", spark.range(5000).selectExpr("id * 7919 % 5003 as id").coalesce(1))
    e.table("t").insert_select(e.table("source").select("id"))
    stored = [r["id"] for r in e.frame("t").collect()]
    assert stored == sorted(stored) and len(set(stored)) == 5000

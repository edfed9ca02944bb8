import pytest

from brindle import Engine, StorageError
from brindle.sources import exchange
from brindle.sources.store import Store


def define(t):
    t.int("id").primary_key()
    t.varchar("name", 10)


def test_table_documents(spark, tmp_path):
    e = Engine(spark)
    e.create_table("t", define)
    e.table("t").insert_many([{"id": 1, "name": "a"}, {"id": 2}])
    exchange.write_table_json(e.table("t").df(), str(tmp_path / "doc"), e.table_schema("t").to_dict(), 2)
    back = exchange.read_table_json(spark, str(tmp_path / "doc"), e.table_schema("t").struct())
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, None)]
    assert sorted(exchange.read_table_json(spark, str(tmp_path / "doc")).columns) == ["id", "name"]


def test_lines_csv_and_encryption(spark, tmp_path):
    df = spark.createDataFrame([(1, "é, \"x\""), (2, None)], "id int, name string")
    exchange.write_json_lines(df, str(tmp_path / "lines"))
    assert sorted(map(tuple, exchange.read_json_lines(spark, str(tmp_path / "lines"), df.schema).collect())) == [(1, "é, \"x\""), (2, None)]
    exchange.write_csv(df.na.drop(), str(tmp_path / "csv"))
    assert exchange.read_csv(spark, str(tmp_path / "csv"), df.schema).count() == 1
    key = b"0123456789abcdef"
    hidden = exchange.encrypted(df, ["name"], key)
    assert hidden.first()["name"] != "é, \"x\""
    assert sorted(map(tuple, exchange.decrypted(hidden, ["name"], key).collect())) == [(1, "é, \"x\""), (2, None)]


class Counted(Store):
    """A store of one's own."""

    writes = 0

    def write(self, df, database, table):
        Counted.writes += 1
        return super().write(df, database, table)


def test_own_store(spark, tmp_path):
    e = Engine(spark, store=Counted(spark, str(tmp_path / "own"), "gzip"))
    e.create_table("t", define)
    e.table("t").insert({"id": 1})
    assert Counted.writes == 1 and Engine(spark, str(tmp_path / "own")).table("t").count() == 1


def test_large_tables_do_not_go_into_one_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exchange, "ONE_DOCUMENT_BYTES", 100)
    with pytest.raises(StorageError):
        exchange.write_table_json(spark.range(1000).toDF("id"), str(tmp_path / "doc"), {})


def test_old_catalogs_go(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    for i in range(15):
        e.create_database(f"d{i}")
    e.vacuum()
    assert len(e.store.files.names(f"{e.store.root}/_catalog")) == 15  # young
    e.vacuum(grace=0)
    assert len(e.store.files.names(f"{e.store.root}/_catalog")) == 11 and len(Engine(spark, str(tmp_path / "db")).databases()) == 16

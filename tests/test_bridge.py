import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle import Engine, QueryError
from brindle.bridge import Mapper
from brindle.functions import Expression


def people(t):
    t.id()
    t.varchar("name", 20).not_null()
    t.int("age")


def test_mapper(spark):
    m = Mapper(Engine(spark))
    m.engine.create_table("people", people)
    assert m.insert("people", {"name": "a", "age": 5}, get_id=True) == 1
    assert m.insert_all_by_keys("people", ["name", "age"], [["b", 6], ["c", 7], ["d", None]]) == 3
    on = {"table": "people"}
    assert m.find({**on, "where": {"name": "b"}})["age"] == 6
    assert m.column({**on, "where": [("age", ">", 5), ("or", [("name", "like", "d%")])], "order": {"id": "desc"}}, "name") == ["d", "c", "b"]
    assert m.column({**on, "where": [("age", "not null", None)]}, "age", "name") == {"a": 5, "b": 6, "c": 7}
    assert (m.value({**on, "where": {"id": 3}}, "name"), m.value({**on, "where": {"id": 9}}, "name", "none")) == ("c", "none")
    assert (m.aggregate(on, "sum", "age"), m.aggregate(on, "count")) == (18, 4)
    assert [r["id"] for r in m.select({**on, "order": ["id"], "page": (2, 3)})] == [4]
    assert m.update({**on, "where": [("age", "between", (5, 6))]}, {"age": 1}) == 2

    def outer(mapper):
        mapper.delete({**on, "where": {"id": 1}})
        with pytest.raises(ValueError):
            mapper.transaction(lambda x: (x.delete(on), int("x")))

    m.transaction(outer)
    assert m.aggregate(on, "count") == 3 and m.fields("people") == {"id": "BIGINT", "name": "VARCHAR", "age": "INT"}
    for bad in (lambda: m.select({**on, "having": 1}), lambda: m.select({**on, "where": [("name", "not like", "x")]}), lambda: m.sql("SELECT 1"), m.select_insert):
        with pytest.raises(QueryError):
            bad()


class Shout(Expression):
    """A user's own expression, by a Pandas UDF."""

    alias = "shout"

    def column(self, resolve):
        return F.pandas_udf(lambda s: s.str.upper() + "!", "string", F.PandasUDFType.SCALAR)(resolve("name"))


def test_own_expression(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame(pd.DataFrame({"name": ["a", "b"]})))
    assert sorted(e.table("t").select(Shout()).get().pluck("shout")) == ["A!", "B!"]

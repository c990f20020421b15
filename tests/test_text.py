"""The index as a bucketed table."""

from lexloom.operators.extract import function_defs
from lexloom.operators.index import lookup
from lexloom.schemas import FILES
from lexloom.sources.sinks import write_index


def test_bucketed_index_is_not_dealt_again(spark):
    defs = function_defs(spark.createDataFrame([("a", "component { function one() {} function two() {} }")], FILES))
    write_index(defs, "index_for_test", 4)
    try:
        asked = spark.createDataFrame([("ONE",), ("none",)], "word string")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = lookup(asked, spark.table("index_for_test"))
        assert [r.name for r in found.collect()] == ["one"]
        assert found._jdf.queryExecution().executedPlan().toString().split("== Final Plan ==")[-1].split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table index_for_test")

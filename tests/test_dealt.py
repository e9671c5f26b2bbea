"""Work on small files is dealt to tasks, and what a JSON value holds is opened once."""

from brightweir import state_queries
from brightweir.functions import schema
from pyspark.sql import functions as F


def test_objects_are_checked_in_many_tasks(spark):
    out = state_queries.schema_faults(spark, "/root/testdata/sf0.001")
    assert out.rdd.getNumPartitions() > 1  # one before, as the file is one split


def test_fields_are_read_once(spark, capsys):
    found = schema.faults(F.parse_json(F.col("t")), {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "string"}, "b": {"minimum": 3}}})
    out = spark.createDataFrame([('{"a":1,"b":2}',), ('{"b":4}',), (None,)], "t string").select(found.alias("f"))
    assert [r.f if r.f is None else [tuple(x) for x in r.f] for r in out.collect()] == [[("$.a", "type"), ("$.b", "minimum")], [("$.a", "required")], None]

"""Strict JSON: what is reported at which depth."""

from pyspark.sql.types import StructType

from strandwork.sources import packages as P

SHAPE = "a struct<b:struct<c:string,d:array<struct<e:bigint,f:boolean>>>>, g double"


def test_faults_at_any_depth(spark):
    shape = StructType.fromDDL(SHAPE)
    assert P.faults('{"a":{"b":{"c":"x","d":[{"e":1,"f":true},null]}},"g":2}', shape) == P.faults('{"a":null}', shape) == P.faults("{}", shape) == []
    assert P.faults('{"a":{"b":{"c":1,"c":"x","z":{"c":1,"c":2}}},"q":1}', shape) == [
        ("a.b.c", "duplicate"), ("a.b.c", "type"), ("a.b.z", "unknown"), ("q", "unknown")]
    assert P.faults('{"a":{"b":{"d":[{"e":true},{"e":1,"x":2},{"x":3},7]}}}', shape) == [
        ("a.b.d[]", "type"), ("a.b.d[].e", "type"), ("a.b.d[].x", "unknown"), ("a.b.d[].x", "unknown")]
    assert P.faults('{"a":{"b":{"d":{}}}}', shape) == [("a.b.d", "type")] and P.faults("[1]", shape) == [("", "type")]
    for text in (None, "", '{"a"', "{" * 100_000):
        assert P.faults(text, shape) == [("", "not_json")]
    df = spark.createDataFrame([(1, '{"g":1,"g":2}'), (None, '{"x":1}'), (3, '{"g":1.5}'), (4, None)], "key long, text string")
    assert {tuple(r) for r in P.fault_report(df, SHAPE).collect()} == {(1, "g", "duplicate", 1), (None, "x", "unknown", 1), (4, "", "not_json", 1)}
    assert [(r.key, r.value.g) for r in P.read_strict(df, SHAPE).collect()] == [(3, 1.5)]
    assert P.fault_report(df.limit(0), SHAPE).count() == 0

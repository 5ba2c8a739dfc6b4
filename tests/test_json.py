import json

from pyspark.sql import functions as F

from quillstone.functions import json as js
from quillstone.sources import files


def test_embedded_objects(spark):
    df = spark.createDataFrame([('so:\n```json\n{"a": {"b": 1}}\n```',), ("none",), ("{broken",), ("x {broken} y",), (None,)], "t string")
    assert [r.j for r in df.select(js.embedded(F.col("t")).alias("j")).collect()] == ['{"a": {"b": 1}}', None, None, None, None]


def test_redaction(spark, tmp_path):
    deep = {"x": {"x": {"x": {"x": {"x": {"x": {"x": {"x": 1}}}}}}}}
    payloads = [json.dumps({"Api_Key": "s", "list": list(range(300)), "text": "a" * 9000, "ok": None}), json.dumps(deep), "no json", None]
    path = str(tmp_path / "audit")
    files.append_audit(spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "id int, payload string"), path, "payload")
    files.append_audit(spark.createDataFrame([(9, "{}")], "id int, payload string"), path, "payload")
    got = {r.id: r.payload for r in spark.read.parquet(path).collect()}
    first = json.loads(got[0])
    assert first["Api_Key"] == "[redacted]" and first["list"] == [*range(200), "[100 more]"] and first["ok"] is None
    assert first["text"] == "a" * 8000 + "[1000 more characters]"
    assert "[deep]" in got[1] and got[2] is None and got[3] is None and got[9] == "{}"


def test_bounds_are_parameters(spark):
    payload = json.dumps({"a": [[1, 2, 3]], "pin": 1, "t": "abcdef"})
    df = spark.createDataFrame([(payload,), ('[1,[2,[3]]]',), ('"x"',)], "t string")
    got = [r.j for r in df.select(js.redacted(F.col("t"), secret="pin", depth=1, items=2, characters=3).alias("j")).collect()]
    assert got == ['{"a":["[deep]"],"pin":"[redacted]","t":"abc[3 more characters]"}', '[1,[2,"[deep]"]]', '"x"']


def test_merge(spark):
    df = spark.createDataFrame([('{"a": {"b": 1, "c": 2}, "l": [1]}', '{"a": {"b": 3}, "l": [2]}'), (None, "{}"), ("{}", None), (None, None)], "a string, b string")
    assert [r.m for r in df.select(js.merged(F.col("a"), F.col("b")).alias("m")).collect()] == ['{"a":{"b":3,"c":2},"l":[2]}', "{}", "{}", None]

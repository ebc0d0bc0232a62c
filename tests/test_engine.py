import json

import pytest
from pyspark.sql import functions as F

from sparkmill.functions import validation
from sparkmill.functions.template import TemplateError, compile_template
from sparkmill.functions.validation import SchemaError, compile_schema
from sparkmill.plans import runs, spec
from sparkmill.sources import readers

RESPONSE = '{"q": {{ ("On " ~ record.topic ~ ".") | tojson }}, "n": {{ record.n | tojson }}}'


def made(tmp_path, **more):
    return {
        "version": 1, "dataset": {"name": "d"}, "source": {"type": "jsonl", "path": str(tmp_path / "in.jsonl")},
        "providers": {"m": {"type": "mock", "response": RESPONSE}}, "output": {"format": "jsonl", "path": str(tmp_path / "out")},
        "generate": {"provider": "m", "prompt": "Ask about {{ topic }}", "output_schema": {"type": "object", "properties": {"n": {"type": "integer", "maximum": 5}}, "required": ["n"]}},
    } | more


def rendered(spark, template, record):
    df = spark.createDataFrame([(json.dumps(record),)], "r string").select(F.parse_json("r").alias("v"))
    return df.select(compile_template(template, F.col("v")).alias("t")).first()["t"]


def test_templates(spark):
    r = {"a": {"b": 'x"y'}, "n": 2, "z": None, "l": [1, 2]}
    assert rendered(spark, "{{ a.b }}-{{ n }}-{{ z }}-{{ record.l.1 }}", r) == 'x"y-2-none-2'
    assert rendered(spark, "{{ ('<' ~ a.b) | tojson }} {{ l | tojson }}", r) == '"<x\\"y" [1,2]'
    assert rendered(spark, "{% if n == 2 %}two{% else %}other{% endif %}{% if q is defined %}q{% endif %}", r) == "two"
    assert rendered(spark, "{% for i in range(3) %}{{ i }},{% endfor %}", r) == "0,1,2,"
    assert rendered(spark, "{{ missing }}", r) is None
    for bad in ("{% for i in range(100001) %}{% endfor %}", "{% if n == 2 %}", "{{ a | upper }}", "{{ 'x' 'y' }}"):
        with pytest.raises(TemplateError):
            rendered(spark, bad, r)


@pytest.mark.parametrize(
    ("schema", "value", "broken"),
    [
        ({"type": "integer"}, 1, None), ({"type": "integer"}, 1.5, ("", "/type")), ({"type": ["string", "null"]}, None, None),
        ({"properties": {"a": {"enum": ["x", 1]}}}, {"a": "y"}, ("/a", "/properties/a/enum")), ({"required": ["a"]}, {}, ("", "/required")),
        ({"items": {"minimum": 2}}, [3, 1], ("/1", "/items/minimum")), ({"additionalProperties": False, "properties": {"a": True}}, {"b": 1}, ("", "/additionalProperties")),
        ({"anyOf": [{"type": "string"}, {"type": "null"}]}, 3, ("", "/anyOf")), ({"pattern": "^a"}, "ba", ("", "/pattern")), ({"not": {"const": 3}}, 3, ("", "/not")),
    ],
)
def test_schemas(spark, schema, value, broken):
    df = spark.createDataFrame([(json.dumps(value),)], "r string").select(F.parse_json("r").alias("v"))
    got = df.select(compile_schema(schema, F.col("v")).alias("b")).first()["b"]
    assert (tuple(got) if got else None) == broken


def test_schema_refuses_unknown_rules():
    with pytest.raises(SchemaError):
        compile_schema({"$ref": "#/x"}, None)


def test_jsonl_positions_and_fatal_rows(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_bytes(b'{"b":1,"a":2}\r\n{"c":"x"}')
    assert [tuple(r) for r in readers.jsonl(spark, str(path)).orderBy("position").collect()] == [(1, '{"a":2,"b":1}'), (2, '{"c":"x"}')]
    for text, why in (('{"a":1}\n\n{"a":2}\n', "row 2: blank"), ('{"a":1}\n[1]\n', "row 2: not an object"), ('{"judge":1}\n', "reserved"), ("{", "not valid JSON")):
        path.write_text(text)
        with pytest.raises(readers.SourceError, match=why):
            readers.jsonl(spark, str(path))


def test_csv_quotes_lines_and_headers(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes('﻿name,text\na,"x ""y""\nz"\nb,\n'.encode())
    assert [json.loads(r.record) for r in readers.csv(spark, str(path)).orderBy("position").collect()] == [{"name": "a", "text": 'x "y"\nz'}, {"name": "b", "text": ""}]
    for header in ("a,a\n", "a,\n", "judge,a\n"):
        path.write_text(header + "1,2\n")
        with pytest.raises(readers.SourceError):
            readers.csv(spark, str(path))


def categories(spark, path):
    out = {}
    for r in spark.read.text(path).collect():
        d = json.loads(r.value)
        out[d["source_position"]] = d["diagnostic"]
    return out


def rows_of(spark, path):
    return sorted((json.loads(r.value) for r in spark.read.text(path).collect()), key=lambda g: g["_meta"]["source_position"])


def test_run_publishes_and_refuses_to_replace(spark, tmp_path):
    rows = [{"topic": "a", "n": 1}, {"topic": "b", "n": 9}, {"n": 1}, {"topic": "a", "n": 1}, {"topic": "c", "n": 2}]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, rows)))
    s = spec.check(made(tmp_path, dedup={"fields": ["q"]}))
    report = runs.run(spark, s)
    bad = categories(spark, s.dead_letter)
    assert (report["status"], report["accepted"], {k: v["category"] for k, v in bad.items()}) == ("completed", 2, {2: "validation", 3: "template", 4: "duplicate"})
    assert [(g["_meta"]["source_position"], g["generated"]["q"], g["topic"]) for g in rows_of(spark, s.output["path"])] == [(1, "On a.", "a"), (5, "On c.", "c")]
    assert bad[2]["schema_path"] == "/properties/n/maximum" and bad[2]["stage"] == "validate" and bad[2]["message"]
    counts = report["statistics"]
    assert (counts["processed_records_total"], counts["generation_requests_total"], counts["template_failed_total"], counts["validation_failed_total"], counts["duplicate_records_total"]) == (5, 4, 1, 1, 1)
    with pytest.raises(runs.RunFailed, match="exists"):
        runs.run(spark, s)


def test_policies_stop_publication(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"topic":"a","n":9}\n{"topic":"b","n":1}\n')
    with pytest.raises(runs.RunFailed, match="strict"):
        runs.run(spark, spec.check(made(tmp_path, errors={"strict": True})))
    assert not (tmp_path / "out").exists()


def test_judge_rejects_low_and_missing_scores(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"topic":"a","n":1,"s":0.9}\n{"topic":"b","n":1,"s":0.1}\n{"topic":"c","n":1,"s":"x"}\n')
    s = made(tmp_path, judge={"provider": "j", "prompt": "Rate {{ generated.q }}", "min_score": 0.5})
    s["providers"]["j"] = {"type": "mock", "response": '{"score": {{ record.s | tojson }}}'}
    s = spec.check(s)
    report = runs.run(spark, s)
    assert {k: v["category"] for k, v in categories(spark, s.dead_letter).items()} == {2: "judge_score", 3: "judge_output"}
    assert (report["statistics"]["judge_requests_total"], report["statistics"]["judge_rejected_total"], report["statistics"]["judge_failed_total"]) == (3, 1, 1)
    assert rows_of(spark, s.output["path"])[0]["judge"]["score"] == 0.9


def test_specifications_are_strict(tmp_path):
    for more in ({"version": 2}, {"odd": 1}, {"source": {"type": "xml"}}, {"dedup": {"num_perm": 10}}, {"output": {"format": "csv", "path": "x"}}, {"errors": {"max_failed_ratio": 2}}):
        with pytest.raises(spec.SpecError):
            spec.check(made(tmp_path, **more))
    assert spec.load(json.dumps(made(tmp_path))).digest() == spec.check(made(tmp_path)).digest()


TREE = {"$defs": {"node": {"type": "object", "required": ["v"], "properties": {"v": {"type": "integer"}, "kids": {"type": "array", "items": {"$ref": "#/$defs/node"}}}}}, "$ref": "#/$defs/node"}


@pytest.mark.parametrize(
    ("schema", "value", "broken"),
    [
        (TREE, {"v": 1, "kids": [{"v": 2, "kids": []}, {"v": 3}]}, None),
        (TREE, {"v": 1, "kids": [{"v": 2, "kids": [{"v": "x"}]}]}, ("/kids/0/kids/0/v", "/$ref/properties/kids/items/$ref/properties/kids/items/$ref/properties/v/type")),
        ({"properties": {"n": {"$ref": "#"}}, "additionalProperties": False}, {"n": {"n": {"m": 1}}}, ("/n/n", "/properties/n/$ref/properties/n/$ref/additionalProperties")),
        ({"$ref": "#"}, {"a": 1}, None),
        ({"patternProperties": {"^s_": {"type": "string"}}, "additionalProperties": {"type": "integer"}}, {"s_a": "x", "b": 1}, None),
        ({"patternProperties": {"^s_": {"type": "string"}}}, {"s_a": 1}, ("/s_a", "/patternProperties/^s_/type")),
        ({"properties": {"a": True}, "additionalProperties": {"type": "integer"}}, {"a": "x", "b": "y"}, ("/b", "/additionalProperties/type")),
        ({"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"required": ["c"]}}, {"a": 1}, ("", "/if/then/required")),
        ({"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"required": ["c"]}}, {"x": 1}, ("", "/if/else/required")),
        ({"if": {"required": ["a"]}, "then": {"required": ["b"]}}, {"x": 1}, None),
        ({"prefixItems": [{"type": "integer"}], "items": {"type": "string"}}, [1, "a", 2], ("/2", "/items/type")),
        ({"contains": {"const": 3}}, [1, 2], ("", "/contains")), ({"contains": {"minimum": 3}, "maxContains": 1}, [3, 4], ("", "/maxContains")),
        ({"propertyNames": {"maxLength": 2}}, {"abc": 1}, ("", "/propertyNames/maxLength")),
        ({"dependentRequired": {"a": ["b"]}}, {"a": 1}, ("", "/dependentRequired")),
        ({"properties": {"a/b~": {"$ref": "#/$defs/x~1y"}}, "$defs": {"x/y": {"const": True}}}, {"a/b~": 1}, ("/a~1b~0", "/properties/a~1b~0/$ref/const")),
    ],
)
def test_schemas_with_references_and_branches(spark, schema, value, broken):
    df = spark.createDataFrame([(json.dumps(value),), ("{}",)], "r string").select(F.parse_json("r").alias("v"))
    got = df.select(compile_schema(schema, F.col("v")).alias("b")).first()["b"]
    assert (tuple(got) if got else None) == broken == validation.broken(schema, value)


def test_both_ways_of_checking_find_the_same_rule(spark):
    schema = {
        "type": "object", "required": ["a"], "minProperties": 2,
        "properties": {"a": {"type": ["integer", "null"], "minimum": 2, "multipleOf": 2}, "l": {"type": "array", "minItems": 1, "maxItems": 2, "uniqueItems": True, "items": {"type": "string", "maxLength": 2}}, "o": {"oneOf": [{"const": 1}, {"type": "integer"}]}, "n": {"not": {"enum": ["x"]}}},
        "anyOf": [{"required": ["l"]}, {"required": ["o"]}],
    }
    values = [{}, {"a": 1}, {"a": 4, "l": []}, {"a": None, "l": ["a", "a"]}, {"a": 3, "l": ["b"]}, {"a": 4, "l": ["abc"]}, {"a": 4, "o": 1}, {"a": 4, "o": 2}, {"a": 4, "o": 2, "n": "x"}, {"a": 4, "z": 1}, {"a": True, "l": ["b"]}, [1], {"a": 4.0, "l": ["b", "c", "d"]}]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "k int, r string").select("k", F.parse_json("r").alias("v"))
    got = {r.k: r.b for r in df.select("k", compile_schema(schema, F.col("v")).alias("b")).collect()}
    assert [tuple(got[k]) if got[k] else None for k in range(len(values))] == [validation.broken(schema, v) for v in values]


@pytest.mark.parametrize("schema", [{"properties": {"x": {"$ref": "file:///secret"}}}, {"allOf": [{"$ref": "https://x.invalid"}]}, {"$ref": "#/$defs/none"}, {"if": {"odd": 1}}])
def test_references_stay_within_the_schema(schema):
    with pytest.raises(SchemaError):
        validation.check_schema(schema)


def test_names_and_values_are_no_references():
    for schema in ({"properties": {"$ref": {"type": "string"}}}, {"enum": [{"$ref": "data"}]}, {"default": {"$ref": "data"}}):
        validation.check_schema(schema)


def test_templates_over_data(spark):
    r = {"l": [{"n": "a", "t": ["x", "y"]}, {"n": "b", "t": []}], "o": {"k2": 1, "k1": [True]}, "e": [], "s": "text", "z": None, "big": list(range(400)), "f": [0, "", "0", None, False, True, {}, 0.5]}
    assert rendered(spark, "{% for x in l %}{{ loop.index }}:{{ x.n }}{% for y in x.t %}<{{ y }}{{ x.n }}>{% endfor %}{% if not loop.last %}, {% endif %}{% endfor %}", r) == "1:a<xa><ya>, 2:b"
    assert rendered(spark, "{% for k in o %}{{ k }}={{ k | tojson }};{% endfor %}{% for x in e %}never{% endfor %}", r) == 'k1="k1";k2="k2";'
    assert rendered(spark, "{% for x in f %}{% if x %}+{% else %}-{% endif %}{% endfor %}", r) == "--+--+-+"
    assert rendered(spark, "{% for i in range(2) %}{% for x in l %}{{ i }}{{ x.n }}{% if loop.first %}!{% endif %}{% endfor %}{% endfor %}", r) == "0a!0b1a!1b"
    assert rendered(spark, "{% for x in big %}{% for y in big %}{% endfor %}{% endfor %}", r) is None  # 160,000 steps
    assert rendered(spark, "{% for x in big %}{% for i in range(200) %}{% endfor %}{% endfor %}.", r) == "."
    assert rendered(spark, "{% for x in big %}{% for i in range(300) %}{% endfor %}{% endfor %}.", r) is None
    for bad in ("s", "z", "missing", "l.0.n"):
        assert rendered(spark, "{% for x in " + bad + " %}{% endfor %}", r) is None
    assert rendered(spark, "{% if missing %}{% endif %}", r) is None and rendered(spark, "{% for x in l %}{{ x.none }}{% endfor %}", r) is None
    assert rendered(spark, "{% for x in l %}{{ x.n }}{% endfor %}{% if x is defined %}left{% endif %}", r) == "ab"

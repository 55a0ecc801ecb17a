import json
import random

from reviewlake.llm import chat_format as CF

TOOLS = {"f": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}}}}
SCHEMA = "conv_id long, turn long, role string, text string, calls string, call_id string"


def call(i, name="f", **args):
    return {"id": i, "name": name, "arguments": args}


def rows():
    j = json.dumps
    return [
        (1, 0, "user", "hi", None, None), (1, 1, "tool", "early", None, "x"),
        (1, 2, "assistant", "c", j([call("x", b=1, a=2)]), None),
        (1, 3, "assistant", "d", j([call("y", a={"$ref": "z"})]), None),
        (1, 4, "assistant", "e", j([{"id": "z", "name": "f", "arguments": "{\"a\": 3}"}]), None),
        (1, 5, "tool", "ry", None, "y"), (1, 6, "tool", "rz", None, "z"), (1, 7, "tool", "orphan", None, "q"), (1, 8, "tool", "no id", None, None),
        (2, 0, "assistant", "p", j([call("m", a=1, r={"$ref": "n"})]), None), (2, 1, "tool", "pm", None, "m"),
        (2, 2, "assistant", "q", j([call("n", "g", a=1, r={"$ref": "m"})]), None), (2, 1, "tool", "pn", None, "n"),
        (3, 0, None, None, "not json", None), (None, None, "user", "é\"\n", None, None), (None, None, "user", "é\"\n", None, None)]


def test_links_orders_validates_and_serialises(spark):
    out = CF.chat_format(spark.createDataFrame(rows(), SCHEMA), TOOLS).collect()
    assert len(out) == len(rows())
    one = sorted((r for r in out if r.conv_id == 1), key=lambda r: (r.order_turn, r.order_depth, r.turn))
    assert [r.turn for r in one] == [0, 2, 1, 4, 6, 3, 5, 7, 8]  # calls before results, results before what refers to them
    assert [r.linked for r in one if r.role == "tool"] == [True, True, True, False, False]
    assert {r.turn: r.n_valid for r in one if r.n_calls} == {2: 1, 3: 0, 4: 1}
    line = next(r.line for r in one if r.turn == 2)
    assert line == '{"content":"c","role":"assistant","tool_calls":[{"arguments":{"a":2,"b":1},"id":"x","name":"f","valid":true}]}'
    assert any(r.cyclic for r in out if r.conv_id == 2) and not any(r.cyclic for r in one)
    odd = [r for r in out if r.conv_id == 3][0]
    assert not odd.readable and json.loads(odd.line) == {"content": "", "role": "user"}
    assert [r.line for r in out if r.conv_id is None] == ['{"content":"é\\"\\n","role":"user"}'] * 2


def test_empty_and_missing_columns(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert CF.chat_format(df.where("false"), TOOLS).count() == 0
    plain = CF.chat_format(df.select("conv_id", "turn", "role", "text"), TOOLS).collect()
    assert len(plain) == len(rows()) and not any(r.linked or r.n_calls for r in plain)


def test_order_respects_every_need(spark):
    random.seed(7)
    made, needs = [], []
    for c in range(25):
        turns = list(range(12))
        random.shuffle(turns)
        for k in range(6):  # call k at a random turn refers to results of smaller k
            refs = [r for r in range(k) if random.random() < 0.4]
            made.append((c, turns[2 * k], "assistant", "", json.dumps([call(f"{k}", a=1, refs=[{"$ref": f"{r}"} for r in refs])]), None))
            made.append((c, turns[2 * k + 1], "tool", "", None, f"{k}"))
            needs += [((c, turns[2 * k]), (c, turns[2 * r + 1])) for r in refs] + [((c, turns[2 * k + 1]), (c, turns[2 * k]))]
    at = {(r.conv_id, r.turn): (r.order_turn, r.order_depth) for r in CF.chat_format(spark.createDataFrame(made, SCHEMA), TOOLS).collect()}
    assert all(at[a] > at[b] for a, b in needs)


def test_schema_faults():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False,
              "properties": {"a": {"type": "array", "items": {"type": "integer", "maximum": 3}}, "b": {"enum": ["x"]}}}
    assert CF.problem({"a": [1, 2]}, schema) is None
    assert CF.problem({"a": [1, 4]}, schema) == "$.a[1]: out of bounds"
    assert CF.problem({"a": [True]}, schema) == "$.a[0]: not of type integer"
    assert CF.problem({"a": [], "b": "y"}, schema) == "$.b: not among the values"
    assert CF.problem({"b": "x"}, schema) == "$.a: missing" and CF.problem({"a": [], "c": 1}, schema) == "$.c: not allowed"


def test_every_schema_keyword_is_judged_or_refused():
    for schema, good, bad in [({"const": "x"}, "x", "y"), ({"exclusiveMinimum": 1, "exclusiveMaximum": 3}, 2, 3), ({"pattern": "^a+$"}, "aa", "b"),
                              ({"minItems": 1, "maxItems": 2}, [1], []), ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, 4, 1),
                              ({"oneOf": [{"minimum": 1}, {"minimum": 5}]}, 2, 6), ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, 2, 3),
                              ({"not": {"type": "null"}}, 1, None), ({"additionalProperties": {"type": "integer"}}, {"a": 1}, {"a": "x"}),
                              ({"minProperties": 1, "maxProperties": 1}, {"a": 1}, {})]:
        CF.check_schema(schema)
        assert CF.problem(good, schema) is None and CF.problem(bad, schema) is not None, schema
    for schema in ({"$ref": "#/x"}, {"properties": {"a": {"uniqueItems": True}}}, {"items": {"multipleOf": 2}}):
        try:
            CF.check_schema(schema)
        except ValueError:
            continue
        raise AssertionError(schema)


def test_valid_json_of_any_kind_does_not_end_the_job(spark):
    deep = "[" * 3000 + "]" * 3000
    nested = lambda n: '[{"id":"k","name":"f","arguments":{"a":1,"b":' + "[" * n + "]" * n + "}}]"
    made = [
        (1, 0, "assistant", "", '[{"id":"\\ud800","name":"f","arguments":{"a":1,"b":"\\udfff x"}}]', None),
        (1, 1, "assistant", "", '[{"id":"r","name":"f","arguments":{"a":1,"\\ud801":{"$ref":"\\ud802"}}}]', None),
        (1, 2, "assistant", "", nested(3000), None), (1, 3, "assistant", "", nested(CF.MAX_DEPTH + 1), None), (1, 4, "assistant", "", nested(50), None),
        (1, 5, "assistant", "", deep, None), (1, 6, "assistant", "", '[{"id":"n","name":"f","arguments":{"a":NaN}}]', None),
        (1, 7, "assistant", "", '[{"id":"n","name":"f","arguments":{"a":1e999}}]', None), (1, 8, "assistant", "", '[{"id":{"x":1},"name":["f"]}]', None),
        (1, 9, "assistant", "", '[{"id":"t","name":"f","arguments":"{\\"a\\": Infinity}"}]', None),
        (1, 10, "assistant", "", '[{"id":"big","name":"f","arguments":{"a":' + "9" * 5000 + "}}]", None)]
    out = {r.turn: r for r in CF.chat_format(spark.createDataFrame(made, SCHEMA), TOOLS).collect()}
    assert {t: r.readable for t, r in out.items()} == {0: True, 1: True, 2: False, 3: False, 4: True, 5: False, 6: False, 7: False, 8: True, 9: True, 10: False}
    for r in out.values():
        json.loads(r.line, parse_constant=lambda x: 1 / 0)
    assert json.loads(out[0].line)["tool_calls"][0]["arguments"]["b"] == "\udfff x" and out[0].n_valid == 1
    assert out[9].n_calls == 1 and out[9].n_valid == 0


def test_true_is_not_one_and_one_is_one_point_zero():
    assert CF.problem(True, {"enum": [1]}) and CF.problem(1, {"enum": [True]}) and CF.problem(False, {"const": 0})
    assert CF.problem(1.0, {"enum": [1]}) is None and CF.problem({"a": [1, {"b": None}]}, {"const": {"a": [1.0, {"b": None}]}}) is None
    assert CF.problem([True], {"enum": [[1]]}) and CF.problem({"a": 1}, {"const": {"a": 1, "b": 2}})


def test_null_texts_very_long_texts_and_clashing_columns(spark):
    long = "word " * 1_200_000
    df = spark.createDataFrame([(1, 0, "user", long, None, None, 5, "z"), (1, 1, "assistant", None, json.dumps([call("x", a=1)]), None, 6, "y"),
                                (1, 2, "tool", None, None, "x", 7, "w")], SCHEMA + ", node int, raw string")
    out = sorted(CF.chat_format(df, TOOLS).collect(), key=lambda r: r.turn)
    assert json.loads(out[0].line)["content"] == long and [r.linked for r in out] == [False, False, True]

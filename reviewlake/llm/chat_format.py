"""Chat formatting: link tool calls with their results, order, validate, serialise.

Messages are rows (conv_id, turn, role, text) with two optional columns: ``calls``, a JSON list of
``{"id", "name", "arguments"}`` on messages that call tools, and ``call_id`` on
messages of role ``tool`` that answer one.

1. Calls are parsed, their arguments validated against the tool's JSON schema and written
   canonically (sorted keys, no spaces, no escapes beyond JSON's own), one map over the messages.
2. Results meet their calls in a hash join on (conv_id, identifier). An identifier that
   occurs again in a conversation means its first call and its first result (least turn).
3. Order: a result follows its call; a call follows the results that its arguments refer to
   (``{"$ref": "<identifier>"}``); beyond that messages keep their turns. Every message
   gets a key (order_turn, order_depth), raised round by round until no message lies before what
   it needs, so a conversation is never gathered: sorting by the key, then turn, is a
   topological order. Messages on a cycle of references keep their own turn and are marked.
4. Each message becomes one line of canonical JSON.

Conversations of any length stay spread over rows; identifiers are aggregated before they are joined,
so an identifier repeated without end is one row per task.

Defined results: a null conv_id is one conversation, a null turn counts as 0, a null role as
"user", a null text as empty; malformed ``calls`` give no call and mark the message, as do NaN, Infinity,
numbers beyond doubles and nesting below ``MAX_DEPTH`` levels; lone surrogates are written as their escapes
(in identifiers too); arguments that
are no JSON object, or of an unknown tool, are invalid; results without a call
(null identifiers too) are kept and not linked; repeated rows stay, each with its line; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, in_batches, written

CALL = "struct<id:string,name:string,arguments:string,valid:boolean,error:string,refs:array<string>>"
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


#: Objects and arrays inside each other that a message's calls may have.
MAX_DEPTH = 200
_LONE = re.compile("[\ud800-\udfff]")


def storable(text: str) -> str:
    """The text with lone surrogates, which UTF-8 cannot hold, as their escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """Canonical JSON: sorted keys, no spaces, only the escapes that JSON needs."""
    return storable(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _finite(number: str) -> float:
    got = float(number)
    if not math.isfinite(got):
        raise ValueError("number out of range")
    return got


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def read_json(text: str):
    """The value of a JSON text; a ValueError for NaN, Infinity, numbers beyond doubles and nesting below
    ``MAX_DEPTH`` levels, as for any text that is no JSON."""
    try:
        value = json.loads(text, parse_float=_finite, parse_constant=_no_constant)
    except RecursionError:
        raise ValueError("nested too deep") from None
    level = [value]
    for _ in range(MAX_DEPTH + 1):
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
        if not level:
            return value
    raise ValueError("nested too deep")


def same(a, b) -> bool:
    """Equality of JSON values: numbers by value, true and 1 differ."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b
    if type(a) is not type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items()) if isinstance(a, dict) else a == b


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return kind in _TYPES and isinstance(value, _TYPES[kind])


_SUPPORTED = {"type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern",
              "items", "minItems", "maxItems", "required", "properties", "additionalProperties", "minProperties", "maxProperties",
              "allOf", "anyOf", "oneOf", "not"}
_NOTES = {"title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly", "$schema", "$id", "$comment"}


def check_schema(schema, at: str = "$") -> None:
    """Raise a ValueError if a schema holds a keyword that ``problem`` would not judge."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: not a schema")
    unknown = sorted(set(schema) - _SUPPORTED - _NOTES)
    if unknown:
        raise ValueError(f"{at}: unsupported schema keywords {unknown}")
    for k in ("items", "additionalProperties", "not"):
        if k in schema:
            check_schema(schema[k], f"{at}.{k}")
    for k in ("allOf", "anyOf", "oneOf"):
        for n, s in enumerate(schema.get(k, [])):
            check_schema(s, f"{at}.{k}[{n}]")
    for name, s in schema.get("properties", {}).items():
        check_schema(s, f"{at}.properties.{name}")


def problem(value, schema, at: str = "$") -> str | None:
    """The first fault of a value under a JSON schema (the keywords of ``_SUPPORTED``), or None."""
    if isinstance(schema, bool):
        return None if schema else f"{at}: not allowed"
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{at}: not of type {kinds}"
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]):
        return f"{at}: not among the values"
    if "const" in schema and not same(value, schema["const"]):
        return f"{at}: not the constant"
    for s in schema.get("allOf", []):
        if (bad := problem(value, s, at)) is not None:
            return bad
    if "anyOf" in schema and all(problem(value, s, at) is not None for s in schema["anyOf"]):
        return f"{at}: none of anyOf"
    if "oneOf" in schema and sum(problem(value, s, at) is None for s in schema["oneOf"]) != 1:
        return f"{at}: not exactly one of oneOf"
    if "not" in schema and problem(value, schema["not"], at) is None:
        return f"{at}: not allowed"
    if _is(value, "number"):
        if "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"] or (
                "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]):
            return f"{at}: out of bounds"
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            return f"{at}: out of bounds"
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            return f"{at}: length out of bounds"
        if "pattern" in schema and re.search(schema["pattern"], value) is None:
            return f"{at}: not of the pattern"
    if isinstance(value, list) and not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
        return f"{at}: number of items out of bounds"
    if isinstance(value, list) and "items" in schema:
        for k, v in enumerate(value):
            if (bad := problem(v, schema["items"], f"{at}[{k}]")) is not None:
                return bad
    if isinstance(value, dict):
        if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", len(value)):
            return f"{at}: number of properties out of bounds"
        known = schema.get("properties", {})
        for name in schema.get("required", []):
            if name not in value:
                return f"{at}.{name}: missing"
        for name in sorted(value):
            if name in known:
                if (bad := problem(value[name], known[name], f"{at}.{name}")) is not None:
                    return bad
            elif (bad := problem(value[name], schema.get("additionalProperties", True), f"{at}.{name}")) is not None:
                return bad
    return None


def references(value) -> list[str]:
    """Identifiers under ``$ref`` anywhere in a value."""
    if isinstance(value, dict):
        own = [value["$ref"]] if isinstance(value.get("$ref"), str) else []
        return own + [r for k in sorted(value) for r in references(value[k])]
    return [r for v in value for r in references(v)] if isinstance(value, list) else []


def parse_calls(text: str | None, tools: dict[str, dict]) -> tuple[list[dict], bool]:
    """The calls of a message, and whether the column could be read."""
    if text is None or not text.strip():
        return [], True
    try:
        found = read_json(text)
    except ValueError:
        return [], False
    if not isinstance(found, list) or not all(isinstance(c, dict) for c in found):
        return [], False
    out = []
    for c in found:
        name, args = c.get("name"), c.get("arguments", {})
        if isinstance(args, str):  # arguments that are themselves JSON text
            try:
                args = read_json(args)
            except ValueError:
                pass
        if not isinstance(name, str) or name not in tools:
            error = "unknown tool"
        elif not isinstance(args, dict):
            error = "$: not an object"
        else:
            error = problem(args, tools[name])
        out.append({"id": None if c.get("id") is None else storable(str(c["id"])), "name": None if name is None else storable(str(name)),
                    "arguments": canonical(args), "valid": error is None, "error": error and storable(error),
                    "refs": [storable(r) for r in references(args)]})
    return out, True


def _parsed(messages: DataFrame, tools: dict[str, dict]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("valid", pa.bool_()),
                                   ("error", pa.string()), ("refs", pa.list_(pa.string()))]))
        for b in batches:
            read = [parse_calls(t, tools) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([r[0] for r in read], kind), pa.array([r[1] for r in read])],
                                             [*b.schema.names[:-1], "calls", "readable"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in messages.schema.fields[:-1])
    return in_batches(messages).mapInArrow(run, f"{kinds}, calls array<{CALL}>, readable boolean")


def _ordered(nodes: DataFrame, results: DataFrame, calls: DataFrame) -> DataFrame:
    """(node, t, depth, cyclic): keys such that no message lies before what it needs."""
    # needs: node waits for node "on"; a result for its call, a call for the results it refers to
    answer = results.join(calls.select("c", "id", F.col("node").alias("on")), ["c", "id"]).select("c", "node", "on")
    refs = calls.select("c", "node", F.explode("refs").alias("id")).distinct()
    asked = refs.join(results.select("c", "id", F.col("node").alias("on")), ["c", "id"]).select("c", "node", "on")
    needs = written(answer.unionByName(asked).where("node <> on").distinct(), "chat-needs")
    keys = nodes.select("node", F.struct(F.col("turn").alias("t"), F.lit(0).cast("long").alias("d")).alias("k"),
                        F.lit(False).alias("cyclic"))
    # only messages that need or are needed take part in the rounds
    part = needs.select("node").unionByName(needs.select(F.col("on").alias("node"))).distinct()
    live = written(keys.join(part, "node"), "chat-keys")
    size = needs.groupBy("c").count().withColumnRenamed("count", "n")
    bound = written(needs.join(size, "c").groupBy("node").agg(F.max("n").alias("n")), "chat-bounds")
    while True:
        # a message on a cycle rises without end: past the number of its conversation's needs it is cut loose
        ready = needs.join(live.where("not cyclic").select(F.col("node").alias("on"), F.col("k").alias("at")), "on")
        least = ready.groupBy("node").agg(F.max(F.struct(F.col("at.t").alias("t"), (F.col("at.d") + 1).alias("d"))).alias("least"))
        step = live.join(least, "node", "left").join(bound, "node", "left")
        # a later turn than what it needs is late enough
        up = ~F.col("cyclic") & F.col("least").isNotNull() & (F.col("least.t") >= F.col("k.t")) & (F.col("least") > F.col("k"))
        lost = up & (F.col("least.d") > F.col("n") + 1)
        new = step.select("node", F.when(up & ~lost, F.col("least")).otherwise(F.col("k")).alias("k"),
                          (F.col("cyclic") | lost).alias("cyclic"), up.alias("moved"))
        new = written(new, "chat-keys")
        live = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    found = live.select("node", "k", "cyclic")
    own = F.struct(F.col("turn").alias("t"), F.lit(0).cast("long").alias("d"))
    done = nodes.select("node", "turn").join(found, "node", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
    k = F.when(F.col("cyclic"), own).otherwise(F.coalesce("k", own))
    return done.select("node", k["t"].alias("order_turn"), k["d"].alias("order_depth"), "cyclic")


def chat_format(messages: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """Per message: conv_id, turn, role, order_turn, order_depth, linked, n_calls, n_valid, n_answered,
    readable, cyclic, and its line of canonical JSON."""
    for name, schema in tools.items():
        check_schema(schema, name)
    has = {c.lower() for c in messages.columns}
    col = lambda n, kind: (F.col(n) if n in has else F.lit(None)).cast(kind).alias(n)
    src = messages.select(
        F.coalesce(col("conv_id", "long"), F.lit(NULL_ID)).alias("c"), F.coalesce(col("turn", "long"), F.lit(0)).alias("turn"),
        F.coalesce(col("role", "string"), F.lit("user")).alias("role"), F.coalesce(col("text", "string"), F.lit("")).alias("text"),
        col("call_id", "string"), col("calls", "string").alias("raw"))
    names = ["c", "turn", "role", "text", "call_id", "raw"]
    # Equal rows are one node with a count; every copy gets its line in the end.
    equal = src.groupBy(*names).agg(F.count("*").alias("copies"))
    node = F.md5(F.to_json(F.struct(*names)).cast("binary"))
    rows = written(_parsed(equal.select(node.alias("node"), "copies", *names), tools), "chat")
    first = F.struct("turn", "node")
    calls = rows.select("c", "turn", "node", F.explode("calls").alias("x")).where("x.id is not null")
    calls = calls.groupBy("c", F.col("x.id").alias("id")).agg(
        F.min(F.struct("turn", "node", F.col("x.name").alias("name"), F.col("x.refs").alias("refs"))).alias("m"))
    calls = written(calls.select("c", "id", "m.node", "m.name", "m.refs"), "chat-calls")
    results = rows.where("role = 'tool' and call_id is not null").groupBy("c", F.col("call_id").alias("id")).agg(F.min(first).alias("m"))
    results = written(results.select("c", "id", "m.node"), "chat-results")
    order = _ordered(rows.select("node", "turn"), results, calls)
    link = results.join(calls.select("c", "id", F.col("name").alias("tool"), F.col("node").alias("caller")), ["c", "id"])
    link = written(link, "chat-links")
    answered = link.groupBy(F.col("caller").alias("node")).agg(F.count("*").alias("n_answered"))
    full = rows.join(order.drop("turn"), "node").join(link.select("node", "tool"), "node", "left").join(answered, "node", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = []
            for r in b.to_pylist():
                m = {"content": r["text"], "role": r["role"]}
                if r["calls"]:
                    m["tool_calls"] = [{"arguments": json.loads(c["arguments"]), "id": c["id"], "name": c["name"], "valid": c["valid"]}
                                       for c in r["calls"]]
                if r["role"] == "tool":
                    m["tool_call_id"] = r["call_id"]
                    if r["tool"] is not None:
                        m["name"] = r["tool"]
                lines.append(canonical(m))
            keep = [n for n in b.schema.names if n not in ("text", "calls")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(lines, pa.string())], [*keep, "line"])

    full = full.withColumns({"n_calls": F.size("calls").cast("long"), "n_valid": F.size(F.filter("calls", lambda x: x["valid"])).cast("long"),
                             "n_answered": F.coalesce("n_answered", F.lit(0)), "linked": F.col("tool").isNotNull()})
    full = full.select("c", "turn", "role", "text", "call_id", "calls", "tool", "copies", "order_turn", "order_depth", "linked",
                       "n_calls", "n_valid", "n_answered", "readable", "cyclic")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in full.schema.fields if f.name not in ("text", "calls"))
    out = full.mapInArrow(run, f"{kinds}, line string")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(F.when(F.col("c") != NULL_ID, F.col("c")).alias("conv_id"), "turn", "role", "order_turn", "order_depth", "linked",
                      "n_calls", "n_valid", "n_answered", "readable", "cyclic", "line")

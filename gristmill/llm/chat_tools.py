"""Chat formatting with tool calls: calls and results linked by a hash join on their identifier, put in
topological order, arguments checked against schemas, and each written as canonical JSON.

A message may make calls (an identifier, a tool, JSON arguments, and the identifiers of calls whose results
they need) or answer one. Links and checks are joins and maps over calls, so a conversation of any length is
dealt over tasks; only the levels of a conversation's calls are found in one place, and those of conversations
with very many calls by joins as well. The result has a row for each message."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.storage import materialize

#: Calls of a conversation whose levels are found in one task, from identifiers alone.
MOST_CALLS = 1 << 20
#: JSON Schema keywords that ``violations`` knows.
KEYWORDS = ("type", "enum", "const", "required", "properties", "additionalProperties", "items", "minLength", "maxLength", "minimum", "maximum", "minItems", "maxItems")


def _is_type(value: object, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, int | float) and not isinstance(value, bool)
    return isinstance(value, {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}[kind])


def _same(a: object, b: object) -> bool:
    return type(a) is type(b) and a == b or _is_type(a, "number") and _is_type(b, "number") and a == b


def violations(value: object, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks a JSON Schema of KEYWORDS, as ``place: keyword``, in order of the schema."""
    out = []
    kinds = schema.get("type")
    if kinds is not None and not any(_is_type(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: type"]
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        out.append(f"{at}: enum")
    if "const" in schema and not _same(value, schema["const"]):
        out.append(f"{at}: const")
    if isinstance(value, str):
        out += [f"{at}: {k}" for k, bad in (("minLength", len(value) < schema.get("minLength", 0)), ("maxLength", len(value) > schema.get("maxLength", math.inf))) if bad]
    if _is_type(value, "number"):
        out += [f"{at}: {k}" for k, bad in (("minimum", value < schema.get("minimum", -math.inf)), ("maximum", value > schema.get("maximum", math.inf))) if bad]
    if isinstance(value, list):
        out += [f"{at}: {k}" for k, bad in (("minItems", len(value) < schema.get("minItems", 0)), ("maxItems", len(value) > schema.get("maxItems", math.inf))) if bad]
        if "items" in schema:
            out += [v for i, x in enumerate(value) for v in violations(x, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: required" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif (more := schema.get("additionalProperties", True)) is False:
                out.append(f"{at}.{k}: additionalProperties")
            elif isinstance(more, dict):
                out += violations(value[k], more, f"{at}.{k}")
    return out


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces, and characters as they are; whole floats as integers."""

    def plain(x: object) -> object:
        if isinstance(x, float) and x.is_integer() and abs(x) < 2**53:
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _checked(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls with ``arguments_json`` (canonical, null if they are no JSON), ``errors`` by the tool's schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for tool, arguments in zip(batch.column("tool").to_pylist(), batch.column("arguments").to_pylist(), strict=True):
                text, bad = None, []
                try:
                    value = json.loads(arguments if arguments is not None else "null", parse_constant=lambda x: (_ for _ in ()).throw(ValueError(x)))
                    text = canonical(value)
                except (ValueError, RecursionError):
                    bad.append("$: json")
                else:
                    bad += violations(value, schemas[tool]) if tool in schemas else ["$: tool"]
                texts.append(text), errors.append(bad)
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string()), pa.array(errors, pa.list_(pa.string()))], names=[*batch.schema.names, "arguments_json", "errors"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema)
    return calls.mapInArrow(run, f"{schema}, arguments_json string, errors array<string>")


def levels_of(calls: dict[str, list[str]]) -> dict[str, int | None]:
    """Levels of calls by the calls they need: 0 for none, else one more than the highest needed; None on a cycle
    or behind one. Needs of calls that aren't there don't count. Takes time in proportion to calls and needs,
    whatever the depth."""
    number = {c: i for i, c in enumerate(calls)}
    behind: list[list[int] | None] = [None] * len(calls)
    left, level = [0] * len(calls), [0] * len(calls)
    for i, needs in enumerate(calls.values()):
        for n in {number[x] for x in needs if x in number}:
            left[i] += 1
            if behind[n] is None:
                behind[n] = []
            behind[n].append(i)
    ready = [i for i, n in enumerate(left) if not n]
    for i in ready:  # grows as calls get ready
        for b in behind[i] or ():
            left[b] -= 1
            level[b] = max(level[b], level[i] + 1)
            if not left[b]:
                ready.append(b)
    return {c: None if left[i] else level[i] for c, i in number.items()}


def _levels_by_joins(nodes: DataFrame) -> DataFrame:
    """``levels_of`` for conversations of any size: each round settles one level by a join and a group-by over a
    written table, and the rounds end with the deepest chain."""
    keys = ["conv", "call"]
    there = nodes.select("conv", F.col("call").alias("on"))
    needs = materialize(nodes.select(*keys, F.explode("needs").alias("on")).distinct().join(there, ["conv", "on"], "left_semi"), "needs")
    waits = needs.groupBy(keys).count().withColumnRenamed("count", "waits")
    settled = materialize(nodes.join(waits, keys, "left").select(*keys, F.coalesce("waits", F.lit(0)).alias("waits"), F.when(F.col("waits").isNull(), 0).alias("level")), "levels")
    level = 0
    while settled.where(F.col("level") == level).limit(1).count():
        ready = settled.where(F.col("level") == level).select("conv", F.col("call").alias("on"))
        freed = needs.join(ready, ["conv", "on"]).groupBy(keys).agg(F.count("*").alias("freed"))
        settled = settled.join(freed, keys, "left").withColumn("waits", F.col("waits") - F.coalesce("freed", F.lit(0)))
        settled = materialize(settled.select(*keys, "waits", F.when(F.col("level").isNull() & (F.col("waits") <= 0), level + 1).otherwise(F.col("level")).alias("level")), "levels")
        level += 1
    return settled.select(*keys, "level")


def topological_levels(nodes: DataFrame, most: int = MOST_CALLS) -> DataFrame:
    """(conv, call, level) of distinct calls (conv: long, call: string, needs: array of strings)."""

    def run(table: pa.Table) -> pa.Table:
        found = levels_of(dict(zip(table["call"].to_pylist(), table["needs"].to_pylist(), strict=True)))
        return pa.table({"conv": table["conv"], "call": table["call"], "level": pa.array([found[c] for c in table["call"].to_pylist()], pa.int32())})

    # few bytes, but much work for each: as many tasks as the session has partitions
    nodes = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv")
    sizes = nodes.groupBy("conv").count()
    large = materialize(sizes.where(F.col("count") > most).select("conv"), "large")
    schema = "conv long, call string, level int"
    if not large.limit(1).count():
        return nodes.groupBy("conv").applyInArrow(run, schema)
    small = nodes.join(large, "conv", "left_anti").groupBy("conv").applyInArrow(run, schema)
    return small.union(_levels_by_joins(materialize(nodes.join(large, "conv", "left_semi"), "nodes")))


def _written(df: DataFrame) -> DataFrame:
    """Messages with ``json``: keys sorted, calls in the order they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content, role, answers, calls in zip(*(batch.column(c).to_pylist() for c in ("content", "role", "answers", "made")), strict=True):
                parts = [f'"content":{canonical(content)}', f'"role":{canonical(role)}']
                if answers is not None:
                    parts.append(f'"tool_call_id":{canonical(answers)}')
                if calls:
                    made = (f'{{"answered_by":{canonical(c["answered_by"])},"arguments":{c["arguments_json"] or "null"},"id":{canonical(c["call"])},"name":{canonical(c["name"])}}}' for c in calls)
                    parts.append(f'"tool_calls":[{",".join(made)}]')
                out.append("{" + ",".join(parts) + "}")
            keep = [i for i, n in enumerate(batch.schema.names) if n not in ("content", "answers", "made", "row")]
            yield pa.record_batch([*(batch.column(i) for i in keep), pa.array(out, pa.string())], names=[*(batch.schema.names[i] for i in keep), "json"])

    return df.mapInArrow(run, "conv long, turn long, role string, level int, status array<string>, errors array<string>, json string")


def format_chats(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each message: (conv, turn, role, level, status, errors, json). Sort a conversation by level and
    turn to have every call after the results that it needs.

    messages: (conv, turn, role, content, calls, answers), calls being an array of (id, name, arguments, needs)
    or null, answers the identifier of the call that the message answers, or null. ``level``: the highest of the
    message's calls, or that of the call it answers; null for other messages. ``status`` has an entry for each call,
    in order of level and identifier: linked, unanswered, invalid (its arguments are no JSON, its tool has no
    schema, or they break it: see ``errors``), cyclic, duplicate (a call with that identifier came before, by turn,
    name and arguments), or unnamed (no identifier, so nothing can answer it). Of an answer it is answer, late (an
    earlier turn, or an equal turn and lesser content, has answered) or orphan (no such call).

    ``json`` is canonical: keys sorted, no spaces, characters as they are, arguments in the same way, and the turn
    that answered each call. Null contents and roles are written as null; a null conversation is one of its own;
    repeated rows stay; very long contents are whole. An empty table gives an empty result; other columns are not
    read."""
    keys = ["conv", "call"]
    own = messages.select(F.col("conv").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "content", "calls", "answers")
    own = materialize(own.withColumn("row", F.monotonically_increasing_id()), "messages")
    known = own.withColumn("conv", F.coalesce("conv", F.lit(-(2**63))))
    made = known.select("row", "conv", "turn", F.posexplode("calls").alias("pos", "c"))
    unnamed = F.concat(F.lit("\0"), F.col("row"), F.lit("-"), F.col("pos"))
    made = made.select("row", "conv", "turn", F.coalesce("c.id", unnamed).alias("call"), F.col("c.id").isNull().alias("unnamed"), F.col("c.name").alias("tool"), "c.arguments", F.filter(F.coalesce("c.needs", F.array().cast("array<string>")), lambda x: x.isNotNull()).alias("needs"))
    nth = Window.partitionBy(keys).orderBy(F.col("turn").asc_nulls_last(), "tool", "arguments", "row")
    seen = materialize(_checked(made.withColumn("nth", F.row_number().over(nth)), schemas), "calls")
    first = seen.where("nth = 1")
    levels = topological_levels(first.select(*keys, "needs"))

    given = known.where("answers is not null").select("row", "conv", F.col("answers").alias("call"), F.struct(F.coalesce("turn", F.lit(2**62)).alias("turn"), F.coalesce("content", F.lit("")).alias("content"), "row").alias("answer"))
    linked = first.select(*keys).join(levels, keys)
    best = given.groupBy(keys).agg(F.min("answer").alias("best"))
    answers = given.join(best, keys).join(linked.withColumn("there", F.lit(True)), keys, "left")
    answers = answers.select("row", F.col("level").alias("answer_level"), F.when(F.col("there").isNull(), "orphan").when(F.col("best.row") == F.col("row"), "answer").otherwise("late").alias("answer_status"))

    status = F.when(F.col("unnamed"), "unnamed").when(F.col("nth") > 1, "duplicate").when(F.size("errors") > 0, "invalid").when(F.col("level").isNull(), "cyclic").when(F.col("best").isNotNull(), "linked").otherwise("unanswered")
    calls = seen.join(levels, keys, "left").join(best, keys, "left").withColumn("status", status)
    turn = F.when(F.col("status").isin("linked", "invalid", "cyclic"), F.when(F.col("best.turn") < 2**62, F.col("best.turn")))
    shown = F.when(~F.col("unnamed"), F.col("call"))
    one = F.struct(F.coalesce("level", F.lit(2**31 - 1)).alias("order"), "call", "nth", "level", "status", "errors", F.struct(shown.alias("call"), F.col("tool").alias("name"), "arguments_json", turn.alias("answered_by")).alias("made"))
    grouped = calls.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("x"))
    grouped = grouped.select("row", F.array_max("x.level").alias("call_level"), F.col("x.status").alias("call_status"), F.flatten("x.errors").alias("errors"), F.col("x.made").alias("made"))
    none = F.array().cast("array<string>")
    out = own.drop("calls").join(grouped, "row", "left").join(answers, "row", "left").select(
        "conv",
        "turn",
        "role",
        F.coalesce("call_level", "answer_level").alias("level"),
        F.array_compact(F.concat(F.coalesce("call_status", none), F.array("answer_status"))).alias("status"),
        F.coalesce("errors", none).alias("errors"),
        "content",
        "answers",
        "made",
    )
    return _written(out)


#: Schemas of the query's two tools.
TURN_SCHEMAS = {
    "open": {"type": "object", "required": ["query", "turn"], "properties": {"query": {"type": "string", "minLength": 1, "maxLength": 300}, "turn": {"type": "integer", "minimum": 0}}, "additionalProperties": False},
    "follow": {"type": "object", "required": ["query", "turn"], "properties": {"query": {"type": "string", "minLength": 1, "maxLength": 400}, "turn": {"type": "integer", "minimum": 2}}, "additionalProperties": False},
}


def turns_as_calls(conversations: DataFrame) -> DataFrame:
    """The tables have no tool calls, so plain turns stand for them: a user's turn makes a call that needs the
    one two turns before, and the assistant's turn after it answers."""
    name = lambda t: F.concat(F.lit("c"), t)
    call = F.struct(
        name(F.col("turn")).alias("id"),
        F.when(F.col("turn") < 2, "open").otherwise("follow").alias("name"),
        F.to_json(F.struct("turn", F.col("text").alias("query"))).alias("arguments"),
        F.array(name(F.col("turn") - 2)).alias("needs"),
    )
    return conversations.select(F.col("conv_id").alias("conv"), "turn", "role", F.col("text").alias("content"), F.when(F.col("role") == "user", F.array(call)).alias("calls"), F.when(F.col("role") == "assistant", name(F.col("turn") - 1)).alias("answers"))


ORACLE = """
WITH RECURSIVE u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
l(conv_id, turn, level) AS (
  SELECT conv_id, turn, 0 FROM u WHERE NOT EXISTS (SELECT 1 FROM u p WHERE p.conv_id = u.conv_id AND p.turn = u.turn - 2)
  UNION ALL SELECT u.conv_id, u.turn, l.level + 1 FROM l JOIN u ON u.conv_id = l.conv_id AND u.turn = l.turn + 2),
c AS (
  SELECT u.conv_id, u.turn, l.level, a.turn AS answered_by, CASE WHEN length(u.text) = 0 THEN ['$.query: minLength'] WHEN length(u.text) > CASE WHEN u.turn < 2 THEN 300 ELSE 400 END THEN ['$.query: maxLength'] ELSE [] END AS errors
  FROM u JOIN l USING (conv_id, turn) LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant')
SELECT m.conv_id AS conv, m.turn, m.role, CAST(coalesce(c.level, p.level) AS INTEGER) AS level,
  CASE WHEN m.role = 'user' THEN [CASE WHEN len(c.errors) > 0 THEN 'invalid' WHEN c.answered_by IS NOT NULL THEN 'linked' ELSE 'unanswered' END]
    WHEN m.role = 'assistant' THEN [CASE WHEN p.turn IS NULL THEN 'orphan' ELSE 'answer' END] ELSE [] END AS status,
  coalesce(c.errors, []) AS errors,
  concat('{"content":', to_json(m.text), ',"role":', to_json(m.role),
    CASE WHEN m.role = 'assistant' THEN concat(',"tool_call_id":"c', m.turn - 1, '"') ELSE '' END,
    CASE WHEN m.role = 'user' THEN concat(',"tool_calls":[{"answered_by":', coalesce(CAST(c.answered_by AS VARCHAR), 'null'), ',"arguments":{"query":', to_json(m.text), ',"turn":', m.turn, '},"id":"c', m.turn,
      '","name":"', CASE WHEN m.turn < 2 THEN 'open' ELSE 'follow' END, '"}]') ELSE '' END, '}') AS json
FROM conversations m LEFT JOIN c ON m.role = 'user' AND c.conv_id = m.conv_id AND c.turn = m.turn
LEFT JOIN c p ON m.role = 'assistant' AND p.conv_id = m.conv_id AND p.turn = m.turn - 1
"""

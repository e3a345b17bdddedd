"""Chat formatting with tool-call linking.

Messages are split into items: the message itself, each call in it (``<tool_call>{"id", "name",
"arguments"}</tool_call>``), and the result in a message of role ``tool`` (``{"tool_call_id", "content"}``).
Results are hash-joined with calls by conversation and identifier. An argument ``{"$result": id}`` makes a call
depend on another; items get an order in which every result follows its call and every call the
results it needs. Arguments are validated against the tools' schemas, and every item is serialised as canonical JSON.
"""

from __future__ import annotations

import json
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import NO_ID, by_batch, cut, table

CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}
#: Tools of the query's own call; a caller gives its own.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}
SURROGATE = re.compile("[\ud800-\udfff]")
SCHEMA = "conv_id long, turn long, n_messages long, seq int, kind string, role string, call_id string, name string, arguments string, content string, needs array<string>, errors array<string>"


def _writable(text: str) -> str:
    """A lone half of a surrogate pair, which no UTF-8 has, as its escape."""
    return text if text.isascii() else SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


#: Made once, not for each message.
ENCODER = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical(value) -> str:
    """JSON with sorted keys, no blanks, and text as it is, but for lone surrogates, which stay escaped."""
    return _writable(ENCODER.encode(value))


def identifier(value) -> str | None:
    """Texts and numbers name things; nothing else does."""
    if isinstance(value, bool) or not isinstance(value, (str, int, float)):
        return None
    try:
        return _writable(value) if isinstance(value, str) else canonical(value)
    except ValueError:  # an infinite number
        return None


def _no(x):
    raise ValueError(f"{x} is no JSON")


DECODER = json.JSONDecoder(parse_constant=_no)


def _strict(text: str):
    return DECODER.decode(text)


def validate(value, schema: dict, at: str = "$") -> list[str]:
    """What breaks ``schema`` (type, enum, required, properties, additionalProperties, items, minimum, maximum, minLength, maxLength)."""
    if isinstance(value, dict) and set(value) == {"$result"}:
        return []  # known only when the call it refers to has run
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    fits = {"number": number, "integer": number and value == int(value)}
    if kinds and not any(fits.get(k, isinstance(value, TYPES.get(k, ()))) for k in kinds):
        return [f"{at}: no {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and not any(canonical(value) == canonical(x) for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if number:
        out += [f"{at}: under minimum"] * (value < schema.get("minimum", value)) + [f"{at}: over maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, str):
        out += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{at}: too long"] * (len(value) > schema.get("maxLength", len(value)))
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            out += validate(x, schema["items"], f"{at}[{k}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}: no {k}" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += validate(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}: unexpected {k}")
    return out


def references(value) -> list:
    """What the ``{"$result": ...}`` in a call's arguments hold."""
    out, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict) and set(x) == {"$result"}:
            out.append(x["$result"])
        elif isinstance(x, (dict, list)):
            todo.extend(x.values() if isinstance(x, dict) else x)
    return out


def _result(text: str) -> dict:
    item = {"kind": "result", "role": "tool", "call_id": None, "content": canonical(text), "errors": ["no identifier"]}
    try:
        x = _strict(text)
    except (ValueError, RecursionError):
        return item
    if not isinstance(x, dict) or identifier(x.get("tool_call_id")) is None:
        return item
    item |= {"call_id": identifier(x["tool_call_id"]), "errors": []}
    try:
        item["content"] = canonical(x.get("content"))
    except (ValueError, RecursionError):  # the text stands for it
        item["errors"] = ["content is no JSON"]
    return item


def _call(role: str, body: str, tools: dict) -> dict:
    item: dict = {"kind": "call", "role": role, "call_id": None, "name": None, "arguments": canonical(body), "needs": [], "errors": ["no JSON"]}
    try:
        x = _strict(body)
    except (ValueError, RecursionError):
        return item
    if not isinstance(x, dict):
        return item
    item |= {"call_id": identifier(x.get("id")), "name": identifier(x.get("name")) if isinstance(x.get("name"), str) else None}
    errors = ["no identifier"] * (item["call_id"] is None)
    try:
        args = x.get("arguments", {})
        if isinstance(args, str):  # some writers put JSON into a string
            args = _strict(args)
        item["arguments"] = canonical(args)
        named = [identifier(r) for r in references(args)]
        item["needs"] = sorted({n for n in named if n is not None})
        errors += ["bad reference"] * (None in named)
        errors += map(_writable, validate(args, tools[x["name"]])) if item["name"] is not None and x["name"] in tools else ["unknown tool"]
    except (ValueError, RecursionError):
        errors.append("arguments are no JSON")
    return item | {"errors": errors}


def split_message(role: str | None, text: str | None, tools: dict) -> list[dict]:
    """The items of one message, in their order."""
    role, text = role or "", text or ""
    if role == "tool":
        return [_result(text)]
    out = [_call(role, body, tools) for body in CALL.findall(text)]
    rest = CALL.sub("", text).strip() if out else text
    return [{"kind": "message", "role": role, "content": canonical(rest), "errors": []}, *out] if rest or not out else out


def items(messages: DataFrame, tools: dict) -> DataFrame:
    def make():
        schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("n_messages", pa.int64()), ("seq", pa.int32()), *[(c, pa.string()) for c in ("kind", "role", "call_id", "name", "arguments", "content")], ("needs", pa.list_(pa.string())), ("errors", pa.list_(pa.string()))])

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for conv, turn, role, text, n in zip(*(c.to_pylist() for c in batch.columns)):
                for k, item in enumerate(split_message(role, text, tools)):
                    rows.append({"conv_id": conv, "turn": turn, "n_messages": n, "seq": k, "needs": []} | item)
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        return f

    rows = messages.groupBy(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(NO_ID)).alias("turn"), "role", "text").agg(F.count("*").alias("n"))
    return by_batch(rows, make, SCHEMA)


ONE = ["conv_id", "call_id"]


def _place(first: Column, level: Column, steps: Column, value: Column) -> Column:
    """Where a call stands that comes after one at ``value`` (at_turn, level): see ``levels``."""
    later = value["at_turn"] < first
    return F.struct(F.when(later, first).otherwise(value["at_turn"]).alias("at_turn"), F.when(later, level).otherwise(value["level"] + steps).alias("level"))


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """``conv_id, call_id, at_turn, level`` of the ``calls`` (conv_id, call_id, turn) that no cycle holds back. ``needs``: conv_id, call_id, need.

    A call stands at its turn, at level 1, if what it needs stands at earlier turns, else two levels over the last of these
    (results stand between). So each need is a function of the place of what is needed: up to ``first`` it gives (``first``, ``level``),
    from there on the same turn ``steps`` levels higher; one after another, and the later of two, are functions of the same kind. A round
    settles the calls whose needs are settled, and where a needed call waits for one other only, puts that one in its place. So chains take
    a number of rounds that grows with the logarithm of their length. A call that settles in the round isn't put in another's place, so what is
    needed after it is unsettled or settled by it: a round reads and writes only calls that wait and those of the round before, not all of them.
    """
    c = F.col
    turns = calls.groupBy(*ONE).agg(F.min("turn").alias("turn"))
    edges = needs.join(turns, ONE).select(*ONE, "need", c("turn").alias("first"), F.lit(1).cast("long").alias("level"), F.lit(2).cast("long").alias("steps"))
    edges = cut(edges.distinct())
    place = "struct<at_turn:long,level:long>"
    held = cut(turns.join(edges.select(*ONE).distinct(), ONE, "left_semi").select(*ONE, F.lit(None).cast(place).alias("so_far")))
    done = cut(turns.join(held, ONE, "left_anti").select(*ONE, F.struct("turn", F.lit(1).cast("long")).cast(place).alias("place")))
    parts, last = [done], done
    while not held.isEmpty():
        there = last.select("conv_id", c("call_id").alias("need"), "place")
        e = edges.join(there, ["conv_id", "need"], "left")
        single = e.groupBy(*ONE).agg(F.count("*").alias("n"), F.count("place").alias("known"), F.first(F.struct("need", "first", "level", "steps")).alias("to")).filter("n = 1 AND known = 0").join(held, ONE)
        single = single.select("conv_id", c("call_id").alias("need"), "to", c("so_far").alias("to_so_far"))
        e = e.join(single, ["conv_id", "need"], "left")
        f = (c("first"), c("level"), c("steps"))
        settled, jumps = c("place").isNotNull(), c("to").isNotNull()
        found = F.when(settled, _place(*f, c("place"))).when(c("to_so_far").isNotNull(), _place(*f, c("to_so_far")))
        over = c("first") > c("to.first")
        e = cut(
            e.select(
                *ONE,
                F.when(settled, None).when(jumps, c("to.need")).otherwise(c("need")).alias("need"),
                F.when(jumps & ~over, c("to.first")).otherwise(c("first")).alias("first"),
                F.when(jumps & ~over, c("to.level") + c("steps")).otherwise(c("level")).alias("level"),
                F.when(jumps, c("to.steps") + c("steps")).otherwise(c("steps")).alias("steps"),
                found.alias("found"),
            )
        )
        later = F.max(F.struct("first", "level")).alias("m")
        edges = cut(e.filter("need IS NOT NULL").groupBy(*ONE, "need").agg(later, F.max("steps").alias("steps")).select(*ONE, "need", "m.first", "m.level", "steps"))
        best = e.groupBy(*ONE).agg(F.max("found").alias("found"), F.count("need").alias("waits"))
        now = cut(held.join(best, ONE).select(*ONE, F.greatest("so_far", "found").alias("so_far"), "waits"))
        new = now.filter("waits = 0")
        if new.isEmpty():
            break  # what is left waits for a cycle
        last = new.select(*ONE, c("so_far").alias("place"))
        parts.append(last)
        held = cut(now.filter("waits > 0").drop("waits"))
    return reduce(DataFrame.unionByName, parts).select(*ONE, "place.at_turn", "place.level")


def link(messages: DataFrame, tools: dict = TOOLS) -> DataFrame:
    """One row for each item of ``messages`` (conv_id, turn, role, text).

    conv_id, turn, n_messages (equal messages that it stands for), seq (place in the message), kind, call_id, status, valid, at_turn, level, json.
    Sorted by (at_turn, level, turn, role, seq, json), a conversation's items are in topological order: ``at_turn`` is
    the latest turn of what a call needs and its own, ``level`` its depth among such items; a result
    stands right behind its call, whatever turn it came in.
    ``status`` of calls: linked, unanswered, repeated (an identifier that an earlier call has) or cyclic; of results: linked, orphan or
    repeated. A call that needs an identifier nobody has is valid=false, as is one that breaks its schema.

    Equal rows are one message, with their number. Null role or text is ''. Identifiers are texts or numbers; other values are none. A lone
    surrogate in a text stays as its escape. A null conv_id is a conversation of its own;
    a null turn comes first. Empty text is an item with empty content. Items without an identifier
    are linked with nothing. An empty table gives an empty result. Other columns are not read.
    """
    every = cut(items(messages, tools))
    order = F.struct("turn", "role", "seq", "content", "arguments")
    keyed = every.filter("call_id IS NOT NULL")
    first = lambda kind: keyed.filter(F.col("kind") == kind).groupBy("conv_id", "call_id").agg(F.min(order).alias(f"first_{kind}"))
    linked = cut(first("call").join(first("result"), ["conv_id", "call_id"], "full"))
    # the calls that stand for their identifier
    calls = keyed.filter("kind = 'call'").join(linked.select("conv_id", "call_id", "first_call"), ["conv_id", "call_id"]).filter(order == F.col("first_call"))
    needs = cut(calls.select(*ONE, F.explode("needs").alias("need")).distinct())
    known = linked.filter("first_call IS NOT NULL").select("conv_id", F.col("call_id").alias("need"))
    missing = needs.join(known, ["conv_id", "need"], "left_anti").select(*ONE).distinct()
    done = levels(calls.select(*ONE, "turn"), needs.join(known, ["conv_id", "need"]))
    info = linked.join(done, ONE, "left").join(missing.withColumn("missing", F.lit(True)), ONE, "left")
    # items without an identifier, plain messages above all, take no part in the join: they would all meet in one task
    out = keyed.join(info, ONE, "left").unionByName(every.filter("call_id IS NULL"), allowMissingColumns=True)
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    mine = F.when(is_call, order == F.col("first_call")).when(is_result, order == F.col("first_result"))
    status = (
        F.when(F.col("kind") == "message", "message")
        .when(F.col("call_id").isNull(), F.when(is_call, "unanswered").otherwise("orphan"))
        .when(is_result & F.col("first_call").isNull(), "orphan")
        .when(~mine, "repeated")
        .when(is_call & F.col("level").isNull(), "cyclic")
        .when(is_call & F.col("first_result").isNull(), "unanswered")
        .otherwise("linked")
    )
    out = out.withColumns({"status": status, "valid": (F.size("errors") == 0) & ~(is_call & F.coalesce("missing", F.lit(False)))})
    placed = F.col("status").isin("linked", "unanswered") & F.col("level").isNotNull()
    level = F.when(placed & is_result, F.col("level") + 1).when(placed & is_call, F.col("level")).otherwise(F.when(F.col("kind") == "message", 0).otherwise(1))
    at_turn = F.when(placed, F.col("at_turn")).otherwise(F.col("turn"))
    quote = lambda c: F.coalesce(F.to_json(F.struct(F.col(c).alias("x"))), F.lit("{}"))
    text = lambda c: F.regexp_replace(quote(c), r'^\{"x":|\}$', "")
    fields = [
        ("arguments", F.col("arguments"), F.col("arguments").isNotNull()),
        ("content", F.col("content"), F.col("content").isNotNull()),
        ("id", text("call_id"), F.col("call_id").isNotNull()),
        ("name", text("name"), F.col("name").isNotNull()),
        ("role", text("role"), F.lit(True)),
        ("type", F.concat(F.lit('"'), "kind", F.lit('"')), F.lit(True)),
    ]
    # keys in sorted order; arguments and content are canonical JSON already
    body = F.concat_ws(",", *[F.when(there, F.concat(F.lit(f'"{k}":'), v)) for k, v, there in fields])
    real = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return out.select(real("conv_id").alias("conv_id"), real("turn").alias("turn"), "n_messages", "seq", "kind", "role", "call_id", "status", "valid", F.nullif(at_turn, F.lit(NO_ID)).alias("at_turn"), level.cast("long").alias("level"), F.concat(F.lit("{"), body, F.lit("}")).alias("json"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


#: The tool of the calls that ``tool_links`` makes.
STEP = {"step": {"type": "object", "properties": {"limit": {"type": "integer", "minimum": 1}, "after": {"type": "array"}}, "required": ["limit"], "additionalProperties": False}}


def tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of tool calls made of ``events``, as the test conversations have none: each event is a call that may need the one or two
    before it in its conversation, or one that nobody has; most have a result, and some results have no call."""
    c = F.col
    e = table(spark, sf_dir, "events").select((c("user_id") % 50).alias("conv_id"), c("event_id").cast("long").alias("id"))
    w = Window.partitionBy("conv_id").orderBy("id")
    e = e.withColumns({f"before{k}": F.lag("id", k).over(w).cast("string") for k in (1, 2)})
    before = lambda k, every: F.when(c("id") % every == 0, F.concat(F.lit('{"$result":"c'), c(f"before{k}"), F.lit('"}')))
    needs = F.concat_ws(",", before(1, 3), before(2, 5), F.when(c("id") % 13 == 0, '{"$result":"nobody"}'))
    arguments = F.concat(F.lit('{"limit":'), (c("id") % 4).cast("string"), F.lit(',"after":['), needs, F.lit("]}"))
    call = F.concat(F.lit('<tool_call>{"id":"c'), c("id").cast("string"), F.lit('","name":"step","arguments":'), arguments, F.lit("}</tool_call>"))
    answer = lambda letter: F.concat(F.lit(f'{{"tool_call_id":"{letter}'), c("id").cast("string"), F.lit('","content":"ok"}'))
    part = lambda there, turn, role, text: F.when(there, F.struct(turn.alias("turn"), F.lit(role).alias("role"), text.alias("text")))
    every = F.array_compact(F.array(part(c("id").isNotNull(), c("id") % 17, "assistant", call), part(c("id") % 4 < 3, c("id") * 7 % 17, "tool", answer("c")), part(c("id") % 9 == 0, c("id") % 5, "tool", answer("o"))))
    messages = e.select("conv_id", F.explode(every).alias("m")).select("conv_id", "m.*")
    return link(messages, STEP).select("conv_id", "turn", "kind", "call_id", "status", "valid", "at_turn", "level")


LINKS_SQL = """
WITH RECURSIVE e AS (
  SELECT user_id % 50 AS conv_id, event_id AS id, event_id % 17 AS turn, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS rn FROM events
), r AS (
  SELECT conv_id, rn, turn AS a, CAST(1 AS BIGINT) AS l, CAST(NULL AS BIGINT) AS a0, CAST(NULL AS BIGINT) AS l0 FROM e WHERE rn = 1
  UNION ALL
  SELECT conv_id, rn, place // 1000000, place % 1000000, a, l FROM (
    SELECT e.conv_id, e.rn, r.a, r.l, greatest(
      turn * 1000000 + 1,
      CASE WHEN id % 3 = 0 AND r.a >= turn THEN r.a * 1000000 + r.l + 2 ELSE 0 END,
      CASE WHEN id % 5 = 0 AND coalesce(r.a0 >= turn, false) THEN r.a0 * 1000000 + r.l0 + 2 ELSE 0 END) AS place
    FROM r JOIN e ON e.conv_id = r.conv_id AND e.rn = r.rn + 1)
), p AS (SELECT e.*, r.a, r.l FROM e JOIN r USING (conv_id, rn))
SELECT conv_id, turn, 'call' AS kind, 'c' || id AS call_id, CASE WHEN id % 4 < 3 THEN 'linked' ELSE 'unanswered' END AS status, id % 4 >= 1 AND id % 13 <> 0 AS valid, a AS at_turn, l AS level FROM p
UNION ALL SELECT conv_id, id * 7 % 17, 'result', 'c' || id, 'linked', true, a, l + 1 FROM p WHERE id % 4 < 3
UNION ALL SELECT conv_id, id % 5, 'result', 'o' || id, 'orphan', true, id % 5, 1 FROM p WHERE id % 9 = 0
"""

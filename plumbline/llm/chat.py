"""Chat formatting with tool-call linking.

A message may carry, in its text,

* ``<tools>[{"name": ..., "parameters": JSON schema}, ...]</tools>``: tools of the conversation;
* ``<tool_call>{"id": ..., "name": ..., "arguments": {...}}</tool_call>``;
* ``<tool_result id="...">...</tool_result>``; a message of role ``tool`` may instead
  be a JSON object with ``tool_call_id`` and ``content``.

Calls and results are joined by conversation and identifier; every result comes
after its call (topological order, the turns' order otherwise); arguments are
checked against the tool's schema; each message becomes one line of canonical
JSON (sorted keys, no spaces, no escapes that JSON doesn't ask for; a lone
surrogate, which UTF-8 can't hold, stays the escape that it was).

A row stands for one message, so that no conversation is gathered in one task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from math import isfinite

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut, ready

_PART = re.compile(r"<tool_call>(.*?)</tool_call>|<tool_result\s+id=\"([^\"]*)\"\s*>(.*?)</tool_result>|<tools>(.*?)</tools>", re.S)

_CALL = "struct<slot:int,id:string,raw_id:string,name:string,arguments:string>"
_RESULT = "struct<slot:int,id:string,raw_id:string,content:string>"
_TOOL = "struct<slot:int,name:string,schema:string>"
_CALL_T = pa.list_(pa.struct([("slot", pa.int32()), ("id", pa.string()), ("raw_id", pa.string()), ("name", pa.string()), ("arguments", pa.string())]))
_RESULT_T = pa.list_(pa.struct([("slot", pa.int32()), ("id", pa.string()), ("raw_id", pa.string()), ("content", pa.string())]))
_TOOL_T = pa.list_(pa.struct([("slot", pa.int32()), ("name", pa.string()), ("schema", pa.string())]))
_LONE = re.compile("[\ud800-\udfff]")


def storable(text: str) -> str:
    """The text with lone surrogates written as escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: object) -> str:
    """JSON with sorted keys and no spaces; whole floats stay floats, as read."""
    return storable(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _loads(text: str) -> object:
    def refuse(word: str) -> None:
        raise ValueError(word)

    return json.loads(text, parse_constant=refuse)


def link_id(value: object) -> str | None:
    """What an identifier is linked by: a string itself, a number or truth value as its JSON; null for anything else."""
    if isinstance(value, str):
        return storable(value)
    return canonical(value) if isinstance(value, (int, float)) else None


def _name(value: object) -> str | None:
    return storable(value) if isinstance(value, str) else None


def parse_message(role: str | None, text: str | None) -> dict:
    """Content without markup, calls, results, declared tools, and the number of parts that aren't valid JSON."""
    calls, results, tools, broken = [], [], [], 0
    text = text or ""
    if role == "tool" and text.lstrip().startswith("{"):
        try:
            body = _loads(text)
            if isinstance(body, dict) and (of := link_id(body.get("tool_call_id"))) is not None:
                content = body.get("content")
                results.append({"slot": 0, "id": of, "raw_id": canonical(body["tool_call_id"]), "content": storable(content) if isinstance(content, str) else canonical(content)})
                return {"content": "", "calls": calls, "results": results, "tools": tools, "broken": 0}
        except (ValueError, RecursionError):
            results.clear()
    kept, at = [], 0
    for slot, match in enumerate(_PART.finditer(text)):
        kept.append(text[at : match.start()])
        at = match.end()
        if match[2] is not None:
            results.append({"slot": slot, "id": match[2], "raw_id": canonical(match[2]), "content": match[3]})
            continue
        try:
            body = _loads(match[1] if match[1] is not None else match[4])
            if match[1] is not None:
                if not isinstance(body, dict):
                    raise ValueError("a call is an object")
                calls.append({"slot": slot, "id": link_id(body.get("id")), "raw_id": canonical(body.get("id")), "name": _name(body.get("name")), "arguments": canonical(body.get("arguments"))})
            else:
                found = [{"slot": slot, "name": _name(t["name"]), "schema": canonical(t.get("parameters", {}))} for t in (body if isinstance(body, list) else [body]) if isinstance(t, dict) and _name(t.get("name"))]
                tools += found
        except (ValueError, RecursionError):
            broken += 1
            kept.append(match[0])  # stays in the content as it is
    kept.append(text[at:])
    return {"content": "".join(kept).strip(), "calls": calls, "results": results, "tools": tools, "broken": broken}


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
#: Keywords of a schema that say nothing about what is valid (fixed values).
_NOTES = frozenset("title description default examples example $schema $id $comment $defs definitions $anchor format deprecated readOnly writeOnly contentMediaType contentEncoding nullable".split())
_KNOWN = frozenset(
    "type enum const required properties additionalProperties patternProperties propertyNames minProperties maxProperties items prefixItems minItems maxItems uniqueItems minLength maxLength pattern minimum maximum exclusiveMinimum exclusiveMaximum multipleOf allOf anyOf oneOf not $ref".split()
)


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _whole(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and isfinite(x) and x.is_integer()


def _alike(x: object) -> str:
    """A text that two JSON values share if they are equal (1 and 1.0 are, 1 and true aren't)."""

    def plain(v: object) -> object:
        if isinstance(v, float) and _whole(v):
            return int(v)
        if isinstance(v, list):
            return [plain(y) for y in v]
        return {k: plain(y) for k, y in v.items()} if isinstance(v, dict) else v

    return canonical(plain(x))


class Check:
    """A value held against a JSON schema; ``skipped`` gathers what could not be judged.

    Keywords whose own value is malformed are skipped like unknown ones. Patterns run
    in linear time whatever they are. A ``$ref`` may point into the same schema.
    """

    def __init__(self, schema: object) -> None:
        self.root = schema
        self.skipped: set[str] = set()

    def conforms(self, value: object) -> bool:
        try:
            return self._meets(value, self.root, frozenset())
        except RecursionError:
            self.skipped.add("nested too deeply")
            return True

    def _matches(self, pattern: object, text: str) -> bool | None:
        if isinstance(pattern, str):
            try:
                return bool(pc.match_substring_regex(pa.array([storable(text)]), storable(pattern))[0].as_py())
            except pa.ArrowInvalid:
                pass
        self.skipped.add("pattern")
        return None

    def _target(self, ref: object) -> object:
        if not isinstance(ref, str) or ref != "#" and not ref.startswith("#/"):
            return None
        at = self.root
        for part in ref.split("/")[1:]:
            part = part.replace("~1", "/").replace("~0", "~")
            at = at.get(part) if isinstance(at, dict) else at[int(part)] if isinstance(at, list) and part.isdecimal() and len(part) < 7 and int(part) < len(at) else None
        return at

    def _meets(self, value: object, schema: object, seen: frozenset) -> bool:
        """``seen``: the references followed for this value, so that one that leads to itself ends."""
        if not isinstance(schema, dict):
            if not isinstance(schema, bool):
                self.skipped.add("schema")
            return schema is not False
        self.skipped.update(k for k in schema if k not in _KNOWN and k not in _NOTES)
        get = schema.get
        if "$ref" in schema:
            to = self._target(get("$ref"))
            if to is None or get("$ref") in seen:
                self.skipped.add("$ref")
            elif not self._meets(value, to, seen | {get("$ref")}):
                return False
        kinds = get("type")
        if kinds is not None:
            named = [k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str) and (k in _TYPES or k in ("integer", "number"))]
            if not named:
                self.skipped.add("type")
            elif not any(_whole(value) if k == "integer" else _number(value) if k == "number" else isinstance(value, _TYPES[k]) for k in named):
                return False
        if isinstance(get("enum"), list) and _alike(value) not in {_alike(x) for x in schema["enum"]}:
            return False
        if "const" in schema and _alike(value) != _alike(schema["const"]):
            return False
        for several, least, most in (("allOf", None, None), ("anyOf", 1, None), ("oneOf", 1, 1)):
            if isinstance(get(several), list):
                n = [self._meets(value, s, seen) for s in schema[several]].count(True)
                if n < (len(schema[several]) if least is None else least) or most is not None and n > most:
                    return False
        if "not" in schema and self._meets(value, schema["not"], seen):
            return False
        if isinstance(value, dict):
            return self._object(value, schema)
        if isinstance(value, list):
            return self._array(value, schema)
        if isinstance(value, str):
            return self._sized(len(value), schema, "minLength", "maxLength") and ("pattern" not in schema or self._matches(schema["pattern"], value) is not False)
        return self._bounded(value, schema) if _number(value) else True

    def _sized(self, n: int, schema: dict, low: str, high: str) -> bool:
        return self._bound(schema, low, lambda b: n >= b) and self._bound(schema, high, lambda b: n <= b)

    def _bound(self, schema: dict, key: str, ok) -> bool:
        if key not in schema:
            return True
        if _number(schema[key]):
            return ok(schema[key])
        self.skipped.add(key)
        return True

    def _bounded(self, x: float, schema: dict) -> bool:
        tests = {"minimum": lambda b: x >= b, "maximum": lambda b: x <= b, "exclusiveMinimum": lambda b: x > b, "exclusiveMaximum": lambda b: x < b}
        if not all(self._bound(schema, k, ok) for k, ok in tests.items()):
            return False
        step = schema.get("multipleOf")
        if _whole(x) and _whole(step) and step > 0:
            return int(x) % int(step) == 0
        if "multipleOf" in schema:  # shares of binary fractions are not exact
            self.skipped.add("multipleOf")
        return True

    def _object(self, value: dict, schema: dict) -> bool:
        get = schema.get
        known = get("properties") if isinstance(get("properties"), dict) else {}
        patterns = get("patternProperties") if isinstance(get("patternProperties"), dict) else {}
        required = get("required") if isinstance(get("required"), list) else []
        if any(isinstance(k, str) and k not in value for k in required) or not self._sized(len(value), schema, "minProperties", "maxProperties"):
            return False
        for k, v in value.items():
            if "propertyNames" in schema and not self._meets(k, schema["propertyNames"], frozenset()):
                return False
            own = [s for p, s in patterns.items() if self._matches(p, k)]
            if k in known:
                own.append(known[k])
            if not all(self._meets(v, s, frozenset()) for s in own or [get("additionalProperties", True)]):
                return False
        return True

    def _array(self, value: list, schema: dict) -> bool:
        first = schema.get("prefixItems", schema.get("items") if isinstance(schema.get("items"), list) else [])
        first = first if isinstance(first, list) else []
        rest = True if isinstance(schema.get("items"), list) else schema.get("items", True)
        if not self._sized(len(value), schema, "minItems", "maxItems") or schema.get("uniqueItems") is True and len({_alike(v) for v in value}) < len(value):
            return False
        return all(self._meets(v, first[i] if i < len(first) else rest, frozenset()) for i, v in enumerate(value))


def conforms(value: object, schema: object) -> bool:
    """Whether a value meets a JSON schema as far as it can be checked (see Check)."""
    return Check(schema).conforms(value)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [parse_message(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        get = lambda k, rows=rows: [r[k] for r in rows]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(get("content"), pa.string()), pa.array(get("calls"), _CALL_T), pa.array(get("results"), _RESULT_T), pa.array(get("tools"), _TOOL_T), pa.array(get("broken"), pa.int32()), batch.column(4)],
            ["conv_id", "turn", "role", "content", "calls", "results", "tools", "broken", "hash"],
        )


def judge(call: dict, schema: str | None, any_tool: bool) -> tuple[str | None, str | None]:
    """(why a call isn't valid or null, the keywords that could not be checked or null)."""
    if call["id"] is None or call["name"] is None:
        return "no id or name", None
    if not call["arguments"].startswith("{"):
        return "arguments are no object", None
    if schema is None:
        return ("unknown tool" if any_tool else None), None
    try:
        check = Check(json.loads(schema))
        good = check.conforms(json.loads(call["arguments"]))
    except RecursionError:
        return None, "nested too deeply"
    return (None if good else "arguments don't meet the schema"), (storable(",".join(sorted(check.skipped))) or None) if good else None


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds problem and unchecked: null, or why a call is not valid and what of its schema was not checked."""
    for batch in batches:
        got = [judge(*x) for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(4), pa.array([p for p, _ in got], pa.string()), pa.array([u for _, u in got], pa.string())], ["msg", "call", "answered", "problem", "unchecked"])


def _object_text(fields: dict[str, str | None]) -> str:
    """An object from the JSON texts of its fields (sorted); null fields are left out."""
    return "{" + ",".join(f'"{k}":{v}' for k, v in sorted(fields.items()) if v is not None) + "}"


def _line(role: str | None, content: str | None, calls: list | None, results: list | None) -> str:
    """A message as canonical JSON; parts that are canonical already are copied, however deep they are."""
    truth = lambda x: "true" if x else "false"
    either = lambda x: None if x is None else canonical(x)
    made = [
        _object_text({"id": c["call"]["raw_id"], "name": canonical(c["call"]["name"]), "arguments": c["call"]["arguments"], "answered": truth(c["answered"]), "problem": either(c["problem"]), "unchecked": either(c["unchecked"])})
        for c in sorted(calls or (), key=lambda c: c["call"]["slot"])
    ]
    back = [_object_text({"id": r["raw_id"], "content": canonical(r["content"]), "linked": truth(r["linked"])}) for r in sorted(results or (), key=lambda r: r["slot"])]
    return _object_text({"role": canonical(role), "content": canonical(content), "tool_calls": f"[{','.join(made)}]" if made else None, "tool_results": f"[{','.join(back)}]" if back else None})


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        lines = [_line(*x) for x in zip(col["role"], col["content"], col["calls"], col["results"], strict=True)]
        n_calls, n_results = [len(c or ()) for c in col["calls"]], [len(r or ()) for r in col["results"]]
        linked = [sum(x["answered"] for x in c or ()) + sum(x["linked"] for x in r or ()) for c, r in zip(col["calls"], col["results"], strict=True)]
        invalid = [b + sum(x["problem"] is not None for x in c or ()) for b, c in zip(col["broken"], col["calls"], strict=True)]
        kept = [batch.column(n) for n in ("conv_id", "turn", "place", "depth", "role")]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, pa.int32()) for x in (n_calls, n_results, linked, invalid)), pa.array(lines, pa.string())], [*("conv_id", "turn", "place", "depth", "role"), "n_calls", "n_results", "n_linked", "n_invalid", "message"])


#: Links of an out-of-order conversation that one call settles; a conversation with more is settled in rounds.
SETTLE = 200_000


def _settled(pdf: pd.DataFrame) -> pd.DataFrame:
    """Places and depths of one conversation's messages by Kahn's order, of its links (msg, place, tie, before, p, before_tie)."""
    turn: dict[int, int] = {}
    tie: dict[int, tuple] = {}
    needs: dict[int, list[int]] = {}
    wanted: dict[int, list[int]] = {}
    for m, place, t, b, p, bt in zip(pdf.msg.tolist(), pdf.place.tolist(), pdf.tie, pdf.before.tolist(), pdf.p.tolist(), pdf.before_tie, strict=True):
        turn[m], turn[b], tie[m], tie[b] = place, p, _order(t), _order(bt)
        needs.setdefault(m, []).append(b)
        wanted.setdefault(b, []).append(m)
    knots = set(turn)  # on a cycle or between two: what is left once ends are taken off both ways
    for links, back in ((needs, wanted), (wanted, needs)):
        left = {m: sum(b in knots for b in links.get(m, ())) for m in knots}
        free = [m for m in knots if not left[m]]
        while free:
            m = free.pop()
            knots.discard(m)
            for n in back.get(m, ()):
                if n in knots:
                    left[n] -= 1
                    if not left[n]:
                        free.append(n)
    out: dict[int, tuple[int, int]] = {}
    waits = {m: 0 if m in knots else len(needs.get(m, ())) for m in turn}
    ready_ = [m for m, n in waits.items() if not n]
    while ready_:
        m = ready_.pop()
        late = [(out[b][0], out[b][1] + 1) for b in needs.get(m, ()) if m not in knots and (*out[b], tie[b]) > (turn[m], 0, tie[m])]
        out[m] = max(late, default=(turn[m], 0))
        for n in wanted.get(m, ()):
            if n not in knots:
                waits[n] -= 1
                if not waits[n]:
                    ready_.append(n)
    return pd.DataFrame({"msg": list(out), "place": [p for p, _ in out.values()], "depth": [d for _, d in out.values()]})


def _order(tie: dict) -> tuple:
    return (tie["role"] is not None, tie["role"] or "", tie["hash"], tie["msg"])


def topological_places(messages: DataFrame, needs: DataFrame) -> DataFrame:
    """(msg, place, depth) of the messages that ``needs(msg, before)`` moves, of ``messages(msg, conv_id, turn, tie)``.

    Unmoved, a message's place is its turn and its depth 0. A message that comes no
    later than one it needs (of one turn, the ``tie`` decides) takes that one's place with
    a greater depth. Messages on a cycle (or between two) stay at their
    turns with depth 0, and their needs are left out; only conversations in which some link is
    out of order are looked at. The links of such a conversation, a few numbers each, are
    settled in one call where they are at most SETTLE by count; a larger one is settled in rounds of joins,
    as many as its longest chain of needs that moves.
    """
    order = F.coalesce("turn", F.lit(0))
    start = messages.select("msg", "conv_id", "tie", order.alias("place"), F.lit(0).alias("depth"))
    behind = start.select(F.col("msg").alias("before"), F.col("place").alias("p"), F.col("tie").alias("before_tie"))
    of = needs.join(start, "msg").join(behind, "before").select("conv_id", "msg", "place", "tie", "before", "p", "before_tie")
    of = cut(of)
    late = F.struct("p", "before_tie") > F.struct("place", "tie")
    upset = cut(of.groupBy("conv_id").agg(F.count("*").alias("n"), F.bool_or(late).alias("late")).filter("late").select("conv_id", "n"))
    links = of.join(upset, "conv_id")
    one_call = links.filter(F.col("n") <= SETTLE).groupBy("conv_id").applyInPandas(_settled, "msg long, place long, depth int")
    if upset.filter(F.col("n") > SETTLE).isEmpty():
        return one_call
    return one_call.union(_settled_in_rounds(cut(links.filter(F.col("n") > SETTLE).drop("n"))))


def _settled_in_rounds(links: DataFrame) -> DataFrame:
    """As ``_settled``, for conversations too large for one call."""
    side = lambda c, p, t: links.select(F.col(c).alias("msg"), F.col(p).alias("place"), F.col(t).alias("tie"))
    now = cut(side("msg", "place", "tie").union(side("before", "p", "before_tie")).distinct().withColumn("depth", F.lit(0)))
    pairs = links.select("msg", "before")
    pairs = cut(pairs.join(cycles(pairs), "msg", "left_anti"))
    while True:
        late = (
            pairs.join(now, "msg")
            .join(now.select(F.col("msg").alias("before"), F.col("place").alias("p"), F.col("depth").alias("d"), F.col("tie").alias("t")), "before")
            .filter("(p, d) > (place, depth) OR (p = place AND d = depth AND (d > 0 OR t > tie))")
            .groupBy("msg")
            .agg(F.max(F.struct(F.col("p"), (F.col("d") + 1).alias("d"))).alias("to"))
        )
        late = cut(late)
        if late.isEmpty():
            return now.select("msg", "place", "depth")
        now = cut(now.join(late, "msg", "left").select("msg", F.coalesce("to.p", "place").alias("place"), "tie", F.coalesce("to.d", "depth").alias("depth")))


def cycles(needs: DataFrame) -> DataFrame:
    """(msg) of the messages on a cycle or between two: links whose ends don't go on both ways are left until none is."""
    count, left = -1, needs
    while (size := left.count()) != count:
        count = size
        goes_on = left.join(left.select(F.col("msg").alias("before")).distinct(), "before", "left_semi")
        left = cut(goes_on.join(left.select(F.col("before").alias("msg")).distinct(), "msg", "left_semi").select("msg", "before"))
    return left.select("msg").distinct()


def format_chats(messages: DataFrame) -> DataFrame:
    """Canonical messages of ``messages(conv_id, turn, role, text)``, one row for each row.

    Returns (conv_id, turn, place, depth, role, n_calls, n_results, n_linked,
    n_invalid, message). A conversation's order is (place, depth, turn): place is the
    turn, or the later turn of the call that a result had to wait for. A repeated
    call id belongs to the first call (by turn, of one turn by role and a hash of the text, then by place in
    the text, whatever the order of the rows); every
    result with that id is linked to it. A result without a call, a call without an
    answer, and a call that isn't valid are kept and marked; a valid call whose schema
    holds keywords that aren't checked (unknown, malformed, or nested too deeply) names
    them as ``unchecked``. An identifier that is no string is kept as it is; numbers and
    truth values link by their JSON, so that 7 meets id="7". Null and empty texts give
    empty content; a null role is null in the JSON. Rows with a null conv_id or call
    id link with nothing. Repeated rows are messages of their own. Other columns are ignored.
    """
    ready(messages.sparkSession)
    base = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("hash", F.xxhash64("role", "text"))
    parsed = base.mapInArrow(_parsed, f"conv_id long, turn long, role string, content string, calls array<{_CALL}>, results array<{_RESULT}>, tools array<{_TOOL}>, broken int, hash long")
    parsed = parsed.withColumn("msg", F.monotonically_increasing_id())
    parsed = cut(parsed.withColumn("tie", F.struct("role", "hash", "msg")))
    plain = parsed.filter("size(calls) = 0 AND size(results) = 0")
    wired = parsed.filter("size(calls) > 0 OR size(results) > 0")

    calls = wired.select("conv_id", "msg", "turn", "tie", F.explode("calls").alias("call"))
    results = wired.select("conv_id", "msg", F.explode("results").alias("result"))
    tools = parsed.select("conv_id", "turn", "tie", F.explode("tools").alias("tool"))
    schemas = tools.groupBy("conv_id", F.col("tool.name").alias("name")).agg(F.min(F.struct("turn", "tie", "tool.slot", "tool.schema")).alias("s")).select("conv_id", "name", F.col("s.schema").alias("schema"))
    with_tools = tools.select("conv_id").distinct().withColumn("any_tool", F.lit(True))

    owner = calls.filter("call.id IS NOT NULL").groupBy("conv_id", F.col("call.id").alias("id")).agg(F.min(F.struct("turn", "tie", "call.slot")).alias("first")).select("conv_id", "id", F.col("first.tie.msg").alias("before"), F.col("first.slot").alias("slot"))
    linked = results.select("conv_id", "msg", F.col("result.id").alias("id"), "result").join(owner.withColumnRenamed("slot", "call_slot"), ["conv_id", "id"], "left")
    answered = linked.filter("before IS NOT NULL").select(F.col("before").alias("msg"), F.col("call_slot").alias("slot")).distinct().withColumn("answered", F.lit(True))

    checked = (
        calls.withColumn("name", F.col("call.name"))
        .withColumn("slot", F.col("call.slot"))
        .join(schemas, ["conv_id", "name"], "left")
        .join(with_tools, "conv_id", "left")
        .join(answered, ["msg", "slot"], "left")
        .select("msg", "call", "schema", F.coalesce("any_tool", F.lit(False)).alias("any_tool"), F.coalesce("answered", F.lit(False)).alias("answered"))
        .mapInArrow(_checked, f"msg long, call {_CALL}, answered boolean, problem string, unchecked string")
    )
    own_calls = checked.groupBy("msg").agg(F.collect_list(F.struct("call", "answered", "problem", "unchecked")).alias("calls"))
    own_results = linked.groupBy("msg").agg(F.collect_list(F.struct("result.slot", "result.raw_id", "result.content", F.col("before").isNotNull().alias("linked"))).alias("results"))
    needs = cut(linked.filter("before IS NOT NULL AND before <> msg").select("msg", "before").distinct())
    columns = ["conv_id", "turn", F.coalesce("place", "turn").alias("place"), F.coalesce("depth", F.lit(0)).alias("depth"), "role", "content", "broken", "calls", "results"]
    joined = wired.drop("calls", "results", "tie", "hash")
    moved = topological_places(wired, needs) if not needs.isEmpty() else None
    joined = joined.join(moved, "msg", "left") if moved is not None else joined.withColumns({"place": F.col("turn"), "depth": F.lit(0)})
    joined = joined.join(own_calls, "msg", "left").join(own_results, "msg", "left").select(*columns)
    kinds = {f.name: f.dataType for f in joined.schema.fields}
    simple = plain.select("conv_id", "turn", F.col("turn").alias("place"), F.lit(0).alias("depth"), "role", "content", "broken", F.lit(None).cast(kinds["calls"]).alias("calls"), F.lit(None).cast(kinds["results"]).alias("results"))
    return simple.union(joined).mapInArrow(_written, "conv_id long, turn long, place long, depth int, role string, n_calls int, n_results int, n_linked int, n_invalid int, message string")

"""Chat formatting: tool calls are linked with their results, ordered, validated and written as canonical JSON.

Calls and results are joined by (conversation, identifier, occurrence): if an identifier is used again, its k-th result
belongs to its k-th call. A call may name others whose results it uses; it comes after them. The order within a conversation
is the topological one that takes the earliest turn first, for any length. Conversations are ordered in tasks, several to a
task. One that is longer than LARGE calls is ranked by a range sort instead, so that no task holds it; where a call names a
later one, or one that is missing, the pairs of ranks of that conversation (no texts) go through one task.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsift.session import write_and_read

#: Calls of a conversation that one task orders.
LARGE = 10_000
KINDS = {"string": str, "boolean": bool, "object": dict, "array": list}
#: Tools that the registered query derives from turns, with the schemas of their arguments.
SCHEMAS = {
    "search": {"type": "object", "required": ["query", "turn"], "additionalProperties": False, "properties": {"query": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}},
    "summarise": {"type": "object", "required": ["turn", "max_chars"], "properties": {"turn": {"type": "integer", "minimum": 0}, "max_chars": {"type": "integer", "minimum": 40, "maximum": 400}, "text": {"type": "string"}}},
    "translate": {"type": "object", "required": ["text", "to"], "properties": {"text": {"type": "string", "maxLength": 600}, "to": {"type": "string", "enum": ["de", "en", "es", "fr"]}}},
}


#: Half a surrogate pair is no character, and no table can hold it.
LONE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """JSON with sorted keys, no blanks, characters as they are (U+FFFD for half a surrogate pair), and whole numbers without a point."""

    def plain(x):
        if isinstance(x, float):
            if not math.isfinite(x):
                return None
            return int(x) if x == int(x) and abs(x) < 1 << 53 else x
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    text = json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return LONE.sub("\ufffd", text)


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What of a JSON schema the value breaks: types, required and further properties, enums, bounds and items."""
    kind, out = schema.get("type"), []
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    fits = number and (kind == "number" or math.isfinite(value) and value == int(value)) if kind in ("number", "integer") else value is None if kind == "null" else isinstance(value, KINDS.get(kind, object))
    if not fits:
        return [f"{at}: not of type {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: not allowed" for k in sorted(value) if k not in known]
        for k in sorted(known.keys() & value.keys()):
            out += violations(value[k], known[k], f"{at}.{k}")
    elif isinstance(value, list):
        for k, item in enumerate(value if "items" in schema else []):
            out += violations(item, schema["items"], f"{at}[{k}]")
    elif isinstance(value, str):
        out += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{at}: too long"] * (len(value) > schema.get("maxLength", math.inf))
    elif number:
        out += [f"{at}: too small"] * (value < schema.get("minimum", -math.inf)) + [f"{at}: too large"] * (value > schema.get("maximum", math.inf))
    return out


def ordered(turns: list[int], after: list[list[int]]) -> list[int | None]:
    """The place of each call in the topological order with the earliest turn first; None on and behind cycles."""
    waiting = [len(x) for x in after]
    users: list[list[int]] = [[] for _ in turns]
    for k, needs in enumerate(after):
        for n in needs:
            users[n].append(k)
    ready = [(turns[k], k) for k in range(len(turns)) if not waiting[k]]
    heapq.heapify(ready)
    place: list[int | None] = [None] * len(turns)
    n = 0
    while ready:
        _, k = heapq.heappop(ready)
        place[k] = n
        n += 1
        for user in users[k]:
            waiting[user] -= 1
            if not waiting[user]:
                heapq.heappush(ready, (turns[user], user))
    return place


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls (conv_id, turn, call_id, name, arguments, after) with their results (conv_id, turn, call_id, content), outer-joined.

    Null conversations or identifiers link with nothing. Adds status: linked, no_result or no_call, and early where the
    result's turn is not after the call's. Other columns of both are not read.
    """
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "after")
    results = results.select("conv_id", "turn", "call_id", "content")
    once = lambda df: df.withColumn("use", F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy("turn")))
    has_key = "conv_id IS NOT NULL AND call_id IS NOT NULL"
    call = once(calls.where(has_key)).unionByName(calls.where(f"NOT ({has_key})").withColumn("use", F.lit(1)))
    result = once(results.where(has_key)).unionByName(results.where(f"NOT ({has_key})").withColumn("use", F.lit(1)))
    result = result.select("conv_id", "call_id", "use", F.col("turn").alias("result_turn"), "content", F.lit(True).alias("has_result"))
    both = call.withColumn("has_call", F.lit(True)).join(result, ["conv_id", "call_id", "use"], "full")
    status = F.when(F.col("has_call").isNull(), "no_call").when(F.col("has_result").isNull(), "no_result").when(F.col("result_turn") <= F.col("turn"), "early").otherwise("linked")
    return both.withColumn("status", status).drop("has_call", "has_result")


def places(rows: DataFrame, large: int = LARGE) -> DataFrame:
    """(conv_id, call_id, use, place) of the calls in `rows`; place is null on and behind cycles and for missing needs.

    A named identifier stands for its first use. Naming itself, or one that the conversation has no call for, leaves the
    call without a place.
    """
    calls = rows.where("status <> 'no_call' AND conv_id IS NOT NULL AND call_id IS NOT NULL").select("conv_id", "call_id", "use", "turn", "after")
    sizes = calls.groupBy("conv_id").agg(F.count("*").alias("n"))
    calls = write_and_read(calls.join(sizes, "conv_id"), "chat-calls")

    def in_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for row, group in enumerate(batch.column("calls").to_pylist()):
                first = {call["call_id"]: k for k, call in enumerate(group) if call["use"] == 1}
                after = [[first.get(x, k) for x in call["after"] or []] for k, call in enumerate(group)]
                place = ordered(list(range(len(group))), after)
                rows += [row] * len(group)
                out += [{"call_id": c["call_id"], "use": c["use"], "place": p} for c, p in zip(group, place, strict=True)]
            found = pa.Table.from_pylist(out, schema=pa.schema([("call_id", pa.string()), ("use", pa.int32()), ("place", pa.int64())]))
            yield from found.add_column(0, "conv_id", batch.column("conv_id").take(pa.array(rows, pa.int64()))).to_batches()

    schema = f"conv_id {calls.schema['conv_id'].dataType.simpleString()}, call_id string, use int, place long"
    # a number of partitions, as adaptive execution would merge these few bytes into one task; a list has `large` calls at most
    tasks = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = calls.where(F.col("n") <= large).repartition(tasks, "conv_id").groupBy("conv_id")
    small = grouped.agg(F.sort_array(F.collect_list(F.struct("turn", "call_id", "use", "after"))).alias("calls")).mapInArrow(in_tasks, schema)
    if calls.where(F.col("n") > large).isEmpty():
        return small
    return small.unionByName(by_ranks(calls.where(F.col("n") > large), tasks))


def ordered_ranks(n: int, users: np.ndarray, needs: np.ndarray) -> np.ndarray:
    """The same as `ordered` for calls 0 to n - 1 in order of turns and pairs of a call and one it needs; -1 without a place."""
    waiting = np.bincount(users, minlength=n).tolist()
    order = np.argsort(needs, kind="stable")
    users, starts = users[order], np.searchsorted(needs[order], np.arange(n + 1))
    ready = [k for k in range(n) if not waiting[k]]  # sorted, so a heap
    place = np.full(n, -1, np.int64)
    done = 0
    while ready:
        k = heapq.heappop(ready)
        place[k] = done
        done += 1
        for user in users[starts[k] : starts[k + 1]].tolist():
            waiting[user] -= 1
            if not waiting[user]:
                heapq.heappush(ready, user)
    return place


def by_ranks(calls: DataFrame, tasks: int) -> DataFrame:
    """The same places for large conversations, in a fixed number of joins however long the chains of calls are.

    Where each call needs earlier calls only, the order is that of the turns, and the place is the rank in it.
    """
    keys, by = ["conv_id", "call_id", "use"], ["conv_id", "turn", "call_id", "use"]
    rows = calls.select(*by, "after").repartitionByRange(tasks, *by).sortWithinPartitions(*by)
    rows = write_and_read(rows.withColumn("at", F.monotonically_increasing_id()), "chat-ranges").withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("k"), F.min("at").alias("low"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("conv_id", "part", (before - F.col("low")).alias("shift"))
    rows = write_and_read(rows.join(F.broadcast(parts), ["conv_id", "part"]).select(*keys, "after", (F.col("at") + F.col("shift")).alias("rank")), "chat-ranks")

    edges = rows.select("conv_id", F.col("rank").alias("user"), F.explode("after").alias("call_id"))
    first = rows.where("use = 1").select("conv_id", "call_id", F.col("rank").alias("need"))
    edges = edges.join(first, ["conv_id", "call_id"], "left").select("conv_id", "user", F.coalesce("need", "user").alias("need"))
    edges = write_and_read(edges, "chat-edges")
    mixed = F.broadcast(edges.where("need >= user").select("conv_id").distinct())
    plain = rows.join(mixed, "conv_id", "left_anti").select(*keys, F.col("rank").alias("place"))
    rows = rows.join(mixed, "conv_id", "left_semi")
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))

    def order(key: tuple, pairs: pa.Table) -> pa.Table:
        place = ordered_ranks(pairs["n"][0].as_py(), pairs["user"].to_numpy(), pairs["need"].to_numpy())
        rank = np.flatnonzero(place >= 0)
        return pa.table({"conv_id": pa.repeat(key[0], len(rank)), "rank": rank, "place": place[rank]})

    kind = calls.schema["conv_id"].dataType.simpleString()
    placed = edges.join(F.broadcast(sizes), "conv_id").groupBy("conv_id").applyInArrow(order, f"conv_id {kind}, rank long, place long")
    return plain.unionByName(rows.join(placed, ["conv_id", "rank"], "left").select(*keys, "place"))


def formatted(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], large: int = LARGE) -> DataFrame:
    """A row for each call and each result without one: conv_id, call_id, place, status, valid, problems, json.

    Arguments are JSON texts. valid is false for arguments that are no JSON or break the schema of the tool, and for tools
    without a schema; it is null where there is no call. Repeated rows count as further uses of their identifier.
    """
    rows = write_and_read(linked(calls, results), "chat-linked")
    rows = rows.join(places(rows, large), ["conv_id", "call_id", "use"], "left")

    def serialise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                problems, arguments = [], None
                if r.status != "no_call":
                    try:
                        arguments = json.loads(r.arguments or "")
                        problems = violations(arguments, schemas[r.name]) if r.name in schemas else ["unknown tool"]
                    except (ValueError, RecursionError):
                        problems = ["arguments are not JSON"]
                call = None if r.status == "no_call" else {"id": r.call_id, "name": r.name, "arguments": arguments}
                result = {"id": r.call_id, "content": r.content} if r.status not in ("no_result",) else None
                body = {"call": call, "result": result}
                out.append((None if call is None else not problems, "; ".join(problems), canonical({k: v for k, v in body.items() if v is not None})))
            rows["valid"], rows["problems"], rows["json"] = (pd.Series(x, index=rows.index, dtype="object") for x in zip(*out, strict=True)) if out else ([], [], [])
            yield rows[["conv_id", "call_id", "place", "status", "valid", "problems", "json"]].astype({"place": "Int64"})

    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.select("conv_id", "call_id", "place", "status", "name", "arguments", "content").mapInPandas(serialise, f"conv_id {kind}, call_id string, place long, status string, valid boolean, problems string, json string")


#: Turns that are calls, and turns that are results.
CALL, RESULT = "role = 'assistant'", "role = 'user' AND turn > 0"


def derived(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from a table of turns (conv_id, turn, role, text).

    Every assistant turn calls a tool that its number chooses, with its whole text in the arguments; a call from turn 3 on
    uses the result of the call two turns before. Every user turn after the first is the result of the turn before it, so
    there are calls without result, results without call, and arguments that break their schema. `messages` has the others.
    """
    text = F.coalesce("text", F.lit(""))
    identifier = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    name = F.element_at(F.array(*map(F.lit, SCHEMAS)), F.pmod(F.coalesce("turn", F.lit(0)), F.lit(3)).cast("int") + 1)
    arguments = F.when(name == "search", F.to_json(F.struct(text.alias("query"), F.col("turn"))))
    arguments = arguments.when(name == "summarise", F.to_json(F.struct(F.col("turn"), F.length(text).alias("max_chars"), text.alias("text"))))
    arguments = arguments.otherwise(F.to_json(F.struct(text.alias("text"), F.lit("en").alias("to"))))
    needs = F.when(F.col("turn") >= 3, F.array(identifier(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    calls = turns.where(CALL).select("conv_id", "turn", identifier(F.col("turn")).alias("call_id"), name.alias("name"), arguments.alias("arguments"), needs.alias("after"))
    results = turns.where(RESULT).select("conv_id", "turn", identifier(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def messages(turns: DataFrame) -> DataFrame:
    """The turns that are neither calls nor results (system, opening, and without a role or number), as rows like those of
    `formatted`: status message, the canonical JSON of role, turn and content, and no call, place or verdict."""

    def serialise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            content = [canonical({"message": {"role": r, "turn": None if pd.isna(n) else int(n), "content": t}}) for r, n, t in zip(rows["role"], rows["turn"], rows["text"], strict=True)]
            rows["json"] = pd.Series(content, index=rows.index, dtype="object")
            yield rows[["conv_id", "json"]]

    kind = turns.schema["conv_id"].dataType.simpleString()
    # the id as a text on the way, as pandas would make numbers with nulls floating
    other = turns.where(f"NOT coalesce({CALL}, false) AND NOT coalesce({RESULT}, false)").select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text")
    rows = other.mapInPandas(serialise, "conv_id string, json string")
    none = lambda t: F.lit(None).cast(t)
    return rows.select(F.col("conv_id").cast(kind), none("string").alias("call_id"), none("long").alias("place"), F.lit("message").alias("status"), none("boolean").alias("valid"), F.lit("").alias("problems"), "json")

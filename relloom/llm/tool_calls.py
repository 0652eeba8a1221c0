"""Tool-call linking: calls meet their results by identifier, in an order that respects
what they depend on, with arguments checked against schemas and canonical JSON.

Joins are on conversation and call, never on the conversation alone, so one conversation
with very many calls is spread like any other. Chains of dependencies are contracted by
doubling, so the rounds grow with the logarithm of their length.
"""

from __future__ import annotations

import json
import math
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relloom.llm.common import Batches, map_batches, settle, steps

TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None),
    "integer": int, "number": (int, float),
}


def canonical(value: Any) -> str:
    """JSON with sorted keys, no blanks, plain code points, and whole floats as integers."""

    def plain(x: Any) -> Any:
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, float) and math.isfinite(x) and x == int(x) and abs(x) < 2**53:
            return int(x)
        return x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def violations(value: Any, schema: dict[str, Any], at: str = "$") -> list[str]:
    """What breaks the schema, as ``place: rule``, in the order of the schema's rules.

    Of JSON Schema: type, enum, const, required, properties, additionalProperties, items,
    minItems, maxItems, minLength, maxLength, pattern, minimum and maximum.
    """
    out: list[str] = []
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(isinstance(value, TYPES[k]) and (k == "boolean" or not isinstance(value, bool)) for k in kinds):
            return [f"{at}: type"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: enum")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: const")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: required" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: additionalProperties")
    elif isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf):
            out.append(f"{at}: items")
        for k, item in enumerate(value if "items" in schema else []):
            out += violations(item, schema["items"], f"{at}[{k}]")
    elif isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
            out.append(f"{at}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
            out.append(f"{at}: range")
    return out


def _refuse(name: str) -> None:
    raise ValueError(name)


def _check(batches: Batches, schemas: dict[str, dict]) -> Batches:
    names = ["conv_id", "call_id", "name", "position", "arguments", "errors"]
    for batch in batches:
        for part in steps(batch, "arguments"):
            made, errors = [], []
            for name, raw in zip(part["name"].to_pylist(), part["arguments"].to_pylist(), strict=True):
                try:
                    value = json.loads(raw, parse_constant=_refuse) if raw is not None else None
                    text = canonical(value)
                except (ValueError, RecursionError):
                    made.append(raw)
                    errors.append(["$: json"])
                    continue
                made.append(text)
                errors.append(violations(value, schemas[name]) if name in schemas else ["$: unknown tool"])
            yield pa.RecordBatch.from_arrays(
                [*(part[c] for c in names[:4]), pa.array(made, pa.string()), pa.array(errors, pa.list_(pa.string()))],
                names=names,
            )


def _shortened(ways: DataFrame) -> DataFrame:
    """Ways (conv_id, call_id, after, more, least) of calls with one dependency, led as far as such ways go.

    A way says that the call's layer is the greater of ``least`` and the layer of ``after``
    plus ``more``; two ways in a row are one such way. Every round doubles how far ways
    lead. Ways that run into a cycle lead nowhere and are dropped: only these move in
    every round, so they are what is left once a round moves no fewer than the last.
    """
    before = None
    while True:
        ahead = ways.select(
            "conv_id", F.col("call_id").alias("after"), F.col("after").alias("to"),
            F.col("more").alias("further"), F.col("least").alias("at_least"),
        )
        ways = settle(ways.join(ahead, ["conv_id", "after"], "left").select(
            "conv_id", "call_id", F.coalesce("to", "after").alias("after"),
            (F.col("more") + F.coalesce("further", F.lit(0))).alias("more"),
            F.greatest("least", F.col("at_least") + F.col("more")).alias("least"), F.col("to").isNotNull().alias("moved"),
        ), "ways")
        moved = ways.where("moved").count()
        if moved in (0, before):
            return ways.where("not moved").drop("moved")
        before = moved


def layers(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, layer): one more than the highest layer a call depends on, from 0.

    Calls on a cycle, or behind one, get no row. Edges (conv_id, call_id, after) whose
    ``after`` is not a call do not count, nor do null identifiers. Each turn contracts
    the chains of calls with a single dependency, so that a chain of any length takes the
    logarithm of its length in rounds and one turn; further turns are only needed where
    calls with several dependencies depend on one another.
    """
    key = ["conv_id", "call_id"]
    ids = settle(calls.select(*key).dropna().distinct(), "calls")
    known = ids.withColumnRenamed("call_id", "after")
    links = settle(
        edges.select(*key, "after").distinct().join(known, ["conv_id", "after"], "left_semi").withColumn("more", F.lit(1)), "edges"
    )
    waiting = links.select(*key).distinct().withColumn("waits", F.lit(True))
    nodes = settle(ids.join(waiting, key, "left").select(
        *key, F.lit(0).alias("least"), F.coalesce("waits", F.lit(False)).alias("waits")
    ), "layer")
    left = links.count()
    while left:
        alone = links.groupBy(*key).agg(F.count("*").alias("n"), F.min("after").alias("after"), F.min("more").alias("more"))
        ways = _shortened(alone.where("n = 1").drop("n").join(nodes.select(*key, "least"), key))
        ahead = ways.select(
            "conv_id", F.col("call_id").alias("after"), F.col("after").alias("to"),
            F.col("more").alias("further"), F.col("least").alias("at_least"),
        )
        led = links.join(ahead, ["conv_id", "after"], "left").select(
            *key, F.coalesce("to", "after").alias("after"), (F.col("more") + F.coalesce("further", F.lit(0))).alias("more"),
            (F.col("at_least") + F.col("more")).alias("least"),
        )
        placed = nodes.where("not waits").select("conv_id", F.col("call_id").alias("after"), F.col("least").alias("placed"))
        met = settle(led.join(placed, ["conv_id", "after"], "left").select(
            *key, F.when(F.col("placed").isNull(), F.col("after")).alias("after"), "more",
            F.greatest("least", F.col("placed") + F.col("more")).alias("least"),
        ), "met")
        raised = met.groupBy(*key).agg(F.max("least").alias("to"), (F.count("after") > 0).alias("still"))
        nodes = settle(nodes.join(raised, key, "left").select(
            *key, F.greatest("least", "to").alias("least"), F.coalesce("still", F.lit(False)).alias("waits")
        ), "layer")
        links = settle(met.where("after is not null").groupBy(*key, "after").agg(F.max("more").alias("more")), "edges")
        # every turn places the lowest calls that can be placed; what is left then waits for itself
        before, left = left, links.count()
        if left == before:
            break
    return nodes.where("not waits").select(*key, F.col("least").alias("layer"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call, and one per identifier that has results but no call.

    ``calls``: conv_id, call_id, name, arguments (JSON), position, after (array of the
    calls whose results it uses). ``results``: conv_id, call_id, content, position.

    Of several calls with one identifier the earliest takes the result (ties: the lesser
    name, then arguments) and the others are ``duplicate``; of several results the
    earliest counts (ties: the lesser content) and ``n_results`` tells how many there
    were. Status is ``answered``, ``pending``, ``duplicate``, ``cyclic`` (it waits for
    itself) or ``orphan`` (no call). Sorting by conv_id, layer, position and call_id is a
    topological order. ``message`` is the canonical JSON of the linked call. Null
    identifiers of calls or conversations link with nothing: such calls are ``pending``
    and such results ``orphan``. Conversations are identified by numbers. Arguments of any length are read whole. Further
    columns are ignored. Empty tables give no rows.
    """
    conv = F.col("conv_id").cast("long").alias("conv_id")
    calls, results = calls.withColumn("conv_id", conv), results.withColumn("conv_id", conv)
    named = "call_id is not null and conv_id is not null"
    read = calls.select(
        "conv_id", "call_id", F.col("name").cast("string"), F.col("position").cast("long"), F.col("arguments").cast("string")
    )
    checked = settle(map_batches(
        read, lambda b: _check(b, schemas),
        "conv_id long, call_id string, name string, position long, arguments string, errors array<string>",
    ), "checked")
    place = F.struct("position", "name", "arguments")
    key = ["conv_id", "call_id"]
    first = checked.where(named).groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("n"))
    answers = results.select("conv_id", "call_id", F.col("content").cast("string"), F.col("position").cast("long").alias("at"))
    answers = answers.groupBy(*key).agg(F.min(F.struct("at", "content")).alias("r"), F.count("*").alias("n_results"))
    edges = calls.select("conv_id", "call_id", F.explode("after").alias("after"))
    layer = layers(checked, edges)
    # repeated calls are numbered only where an identifier repeats
    single = checked.join(first.where("n = 1").select(*key), key, "left_semi").withColumn("turn", F.lit(1))
    several = checked.join(first.where("n > 1").select(*key, "first"), key).withColumn(
        "turn", F.when(place.eqNullSafe(F.col("first")), F.lit(1)).otherwise(F.lit(2))
    )
    same = several.where("turn = 1").groupBy(*checked.columns).agg(F.count("*").alias("c"))
    leading = same.drop("c").withColumn("turn", F.lit(1))
    copies = same.where("c > 1").select(*checked.columns, F.explode(F.sequence(F.lit(2), F.col("c").cast("int"))).alias("turn"))
    nameless = checked.where(f"not ({named})").withColumn("turn", F.lit(1))
    numbered = single.unionByName(leading).unionByName(several.where("turn > 1").drop("first")).unionByName(copies).unionByName(nameless)
    linked = numbered.join(answers, key, "left").join(layer, key, "left")
    status = F.when(F.col("turn") > 1, "duplicate").when(
        F.expr(named) & F.col("layer").isNull(), "cyclic"
    ).when(F.col("r").isNotNull(), "answered").otherwise("pending")
    taken = F.col("turn") == 1
    rows = linked.select(
        *key, "name", "arguments", "position", "layer", status.alias("status"), F.size("errors").alias("n_errors"), "errors",
        F.when(taken, F.col("r.content")).alias("result"),
        F.when(taken, F.coalesce("n_results", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_results"),
    )
    empty = F.lit(None)
    orphans = answers.join(checked.select(*key).distinct(), key, "left_anti").select(
        *key, empty.cast("string").alias("name"), empty.cast("string").alias("arguments"), F.col("r.at").alias("position"),
        empty.cast("int").alias("layer"), F.lit("orphan").alias("status"), F.lit(0).alias("n_errors"),
        F.array().cast("array<string>").alias("errors"), F.col("r.content").alias("result"), F.col("n_results").cast("long"),
    )
    return map_batches(rows.unionByName(orphans), _messages, (
        "conv_id long, call_id string, name string, position long, layer int, status string, n_errors int, "
        "errors array<string>, n_results long, message string"
    ))


def _messages(batches: Batches) -> Batches:
    carried = ["conv_id", "call_id", "name", "position", "layer", "status", "n_errors", "errors", "n_results"]
    for batch in batches:
        for part in steps(batch, "arguments"):
            made = []
            for call, name, raw, errors, result in zip(
                *(part[c].to_pylist() for c in ("call_id", "name", "arguments", "errors", "result")), strict=True
            ):
                broken = raw is not None and "$: json" in (errors or [])
                value = raw if broken or raw is None else json.loads(raw)
                made.append(canonical({"id": call, "name": name, "arguments": value, "result": result}))
            yield pa.RecordBatch.from_arrays([*(part[c] for c in carried), pa.array(made, pa.string())], names=[*carried, "message"])


#: Tools that turns of conversations are taken to call, see :func:`calls_of_turns`.
SCHEMAS = {
    "lookup": {
        "type": "object", "required": ["query", "turn"], "additionalProperties": False,
        "properties": {
            "query": {"type": "string", "minLength": 1, "maxLength": 200},
            "turn": {"type": "integer", "minimum": 0}, "uses": {"type": "array", "items": {"type": "string"}},
        },
    },
    "answer": {
        "type": "object", "required": ["query", "turn"], "additionalProperties": False,
        "properties": {
            "query": {"type": "string", "minLength": 1, "maxLength": 2000},
            "turn": {"type": "integer", "minimum": 0}, "uses": {"type": "array", "items": {"type": "string"}},
        },
    },
}


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that plain conversations stand for.

    A user's turn calls ``lookup`` if it has one line and ``answer`` otherwise, uses the
    result of the user's turn two before, and is answered by the assistant's next turn.
    A null text is called with no query, a null turn has no call identifier, rows of other
    roles (or none) stand for nothing, repeated rows repeat their call or result, and no
    turns give no calls.
    """
    said = turns.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text"))
    name = lambda t: F.concat(F.lit("call-"), t.cast("string"))
    before = F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    calls = said.where("role = 'user'").select(
        "conv_id", name(F.col("turn")).alias("call_id"),
        F.when(F.col("text").contains("\n"), "answer").otherwise("lookup").alias("name"),
        F.to_json(F.struct(F.col("text").alias("query"), "turn", before.alias("uses"))).alias("arguments"),
        F.col("turn").alias("position"), before.alias("after"),
    )
    results = said.where("role = 'assistant'").select(
        "conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"), F.col("turn").alias("position")
    )
    return calls, results

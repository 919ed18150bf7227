"""Chat formatting with tool-call linking, in DataFrame functions only.

A turn may hold tool calls, ``<tool_call>{"id": ..., "name": ..., "arguments": {...}}</tool_call>``, in its text; a
turn of role ``tool`` holds one result, ``{"tool_call_id": ..., "content": ...}``. Calls and results are linked by a
hash join on (conversation, identifier). Arguments may refer to other calls of the conversation as ``"$call:ID"``:
calls are ordered topologically by these references. Arguments are checked against the tools' schemas. Every turn
becomes one line of canonical JSON: keys sorted, no spaces, nulls left out.

Turns aren't gathered by conversation: each carries its place, a text that sorts the turns of a conversation (results
directly after their call, calls by level), so one conversation may hold any share of the rows.

Edge cases: a null or empty text is empty content; a null role is ``unknown``; a null conversation or turn is kept
and links nothing; of calls with one identifier in a conversation the first by turn counts, the others are in error
(``duplicate_id``); a result without a call (``orphan``), a call without a result (``unanswered``), references to
unknown calls (``unknown_reference``) or in a circle (``cycle``), calls that aren't JSON (``invalid_json``) or have no end (``unclosed_call``) and
arguments against the schema are reported, never dropped; repeated rows are repeated in the result; an empty table
gives an empty result; other columns are ignored, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import staging

CALL = r"(?s)<tool_call>(.*?)</tool_call>"
REFERENCE = r'"\$call:([^"]+)"'
#: schema type -> pattern of the type that Spark gives a value inside JSON
_TYPES = {
    "string": "^STRING$",
    "integer": "^(BIGINT|DECIMAL\\(\\d+,0\\))$",
    "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY.*$",
    "object": "^OBJECT.*$",
    "null": "^VOID$",
}


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


#: Keywords of a schema that are checked, and those that say nothing about validity; others are refused.
CHECKED = frozenset(("type", "enum", "const", "minimum", "maximum", "pattern", "properties", "required", "additionalProperties", "items"))
SILENT = frozenset(("description", "title", "default", "examples"))


def _fits(inner: Column, kinds: str | list[str]) -> Column:
    fits = F.lit(False)
    for k in [kinds] if isinstance(kinds, str) else kinds:
        fits |= F.coalesce(F.schema_of_variant(inner), F.lit("VOID")).rlike(_TYPES[k])
    return fits


def _rule_errors(value: Column, path: str, name: str, rule: dict, there: Column) -> list[Column]:
    """Arrays of what of the value at this path is against its rule, where it is there."""
    if unknown := set(rule) - CHECKED - SILENT:
        raise ValueError(f"schema of {name or 'the arguments'}: can't check {sorted(unknown)}")
    none = F.array().cast("array<string>")
    inner = F.try_variant_get(value, path, "variant") if path != "$" else value
    error = lambda bad, what: F.when(there & F.coalesce(bad, F.lit(False)), F.array(F.lit(f"{what}:{name}"))).otherwise(none)
    found = []
    if "type" in rule and path != "$":
        found.append(error(~_fits(inner, rule["type"]), "type"))
    text, number = F.try_variant_get(value, path, "string"), F.try_variant_get(value, path, "double")
    for key in ("enum", "const"):
        if key in rule:
            allowed = [rule[key]] if key == "const" else rule[key]
            found.append(error(~F.coalesce(text.isin([str(x).lower() if isinstance(x, bool) else str(x) for x in allowed]), F.lit(False)), key))
    if "minimum" in rule:
        found.append(error(number < rule["minimum"], "minimum"))
    if "maximum" in rule:
        found.append(error(number > rule["maximum"], "maximum"))
    if "pattern" in rule:
        found.append(error(_fits(inner, "string") & ~text.rlike(rule["pattern"]), "pattern"))
    if "items" in rule:
        if set(rule["items"]) - {"type"} - SILENT:
            raise ValueError(f"schema of {name}: of items, only their type can be checked")
        items = F.try_variant_get(value, path, "array<variant>")
        found.append(error(~F.forall(items, lambda x: _fits(x, rule["items"].get("type", list(_TYPES)))), "items"))
    properties, required = rule.get("properties", {}), set(rule.get("required", []))
    if properties or required or rule.get("additionalProperties") is False:
        keys = F.coalesce(F.json_object_keys(F.to_json(inner)), none)
        is_object = there & F.coalesce(F.schema_of_variant(inner).startswith("OBJECT"), F.lit(False))
        full = lambda p: f"{name}.{p}" if name else p
        for p in sorted(set(properties) | required):
            has = F.array_contains(keys, p)
            if p in required:
                found.append(F.when(is_object & ~has, F.array(F.lit(f"missing:{full(p)}"))).otherwise(none))
            found += _rule_errors(value, f"{path}['{p}']", full(p), properties.get(p, {}), is_object & has)
        if rule.get("additionalProperties") is False:
            extra = F.array_except(keys, F.array(*map(F.lit, sorted(properties))).cast("array<string>"))
            found.append(F.when(is_object, F.transform(F.array_sort(extra), lambda k: F.concat(F.lit(f"unknown:{full('')}"), k))).otherwise(none))
    return found


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """What of a call's arguments (JSON text) is against its tool's schema; see CHECKED for what a schema may ask."""
    value = F.try_parse_json(arguments)
    kind = F.schema_of_variant(value)
    none = F.array().cast("array<string>")
    out = F.when(~F.coalesce(name.isin(list(schemas)), F.lit(False)), F.array(F.lit("unknown_tool"))) if schemas else F.when(F.lit(False), none)
    for tool, schema in schemas.items():
        out = out.when(name == tool, F.concat(none, *_rule_errors(value, "$", "", schema, F.lit(True))))
    checked = out.otherwise(none)
    return F.when(value.isNull() | ~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), F.array(F.lit("invalid_arguments"))).otherwise(checked)


def _place(*parts: Column) -> Column:
    """Numbers as a text that sorts like them; 20 digits each, negative ones first, null before all."""
    shown = [F.coalesce(F.when(p < 0, F.concat(F.lit("-"), F.lpad((p + (1 << 62)).cast("string"), 19, "0"))).otherwise(F.lpad(p.cast("string"), 20, "0")), F.lit("")) for p in parts]
    return F.concat_ws(".", *shown)


def call_levels(calls: DataFrame) -> DataFrame:
    """(conv, call, level, problem) of each call (conv, call, refs): one more than the highest level it refers to."""
    spark = calls.sparkSession
    edges = calls.select("conv", "call", F.explode("refs").alias("ref"))
    known = calls.select("conv", F.col("call").alias("ref")).distinct()
    edges = edges.join(known.withColumn("known", F.lit(True)), ["conv", "ref"], "left")
    unknown = edges.where("known is null").select("conv", "call").distinct().withColumn("unknown", F.lit(True))
    edges = staging.stage(edges.where("known").select("conv", "call", "ref").distinct(), "call-edges")
    levels = calls.select("conv", "call").distinct().withColumn("level", F.lit(0).cast("long"))
    if edges.limit(1).count():
        # peel: a call is placed once all that it refers to are
        placed, path = staging.written(levels.join(edges, ["conv", "call"], "left_anti"), "call-levels")
        n, rounds = placed.count(), 0
        while True:
            rounds += 1
            ready = edges.join(placed.select("conv", F.col("call").alias("ref"), "level"), ["conv", "ref"], "left")
            ready = ready.groupBy("conv", "call").agg(F.max("level").alias("high"), F.count_if(F.col("level").isNull()).alias("waiting"))
            new = ready.where("waiting = 0").select("conv", "call", (F.col("high") + 1).alias("level")).join(placed, ["conv", "call"], "left_anti")
            after, new_path = staging.written(placed.union(new), "call-levels")
            staging.discard(spark, path)
            placed, path, before, n = after, new_path, n, after.count()
            if n == before:
                break
        levels = levels.drop("level").join(placed, ["conv", "call"], "left")
    problem = F.when(F.col("level").isNull(), F.lit("cycle")).when(F.col("unknown"), F.lit("unknown_reference"))
    return levels.join(unknown, ["conv", "call"], "left").select("conv", "call", F.coalesce("level", F.lit(1 << 40)).alias("level"), problem.alias("problem"))


def format_chats(turns: DataFrame, schemas: dict[str, dict] | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, place, json, n_calls, call_id, linked, errors) of every turn."""
    staging.ship(turns.sparkSession)
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit("unknown")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    is_call, is_result = F.col("text").contains("<tool_call>") & (F.col("role") != "tool"), F.col("role") == "tool"
    zero = F.lit(0).cast("long")
    no_errors = F.array().cast("array<string>")
    plain = rows.where(~is_call & ~is_result).select(
        "conv", "turn", "role", _place(F.col("turn"), zero, zero, zero).alias("place"),
        F.concat(F.lit('{"content":'), quoted(F.col("text")), F.lit(',"role":'), quoted(F.col("role")), F.lit("}")).alias("json"),
        zero.alias("n_calls"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("boolean").alias("linked"), no_errors.alias("errors"),
    )
    # calls
    key = F.sha2(F.col("text"), 256).alias("key")
    said = rows.where(is_call).select("conv", "turn", "role", key, "text")
    bodies = said.select("conv", "turn", "role", "key", F.posexplode(F.regexp_extract_all("text", F.lit(CALL), 1)).alias("k", "body")).distinct()
    part = lambda p: F.get_json_object("body", p)
    calls = bodies.select("conv", "turn", "role", "key", "k", F.try_parse_json("body").isNotNull().alias("valid"), part("$.id").alias("call"), part("$.name").alias("name"), F.coalesce(part("$.arguments"), F.lit("{}")).alias("arguments"))
    calls = calls.withColumn("refs", F.array_distinct(F.regexp_extract_all("arguments", F.lit(REFERENCE), 1)))
    calls = staging.stage(calls, "calls")
    identified = calls.where("conv is not null and call is not null")
    first = identified.groupBy("conv", "call").agg(F.min(F.struct("turn", "key", "k", "refs")).alias("first"))
    levels = call_levels(first.select("conv", "call", F.col("first.refs").alias("refs")))
    results = rows.where(is_result).select("conv", "turn", "text", F.get_json_object("text", "$.tool_call_id").alias("call"))
    answered = results.where("conv is not null and call is not null").groupBy("conv", "call").agg(F.count("*").alias("answers"))
    facts = first.join(levels, ["conv", "call"]).hint("shuffle_hash").join(answered, ["conv", "call"], "left")
    facts = staging.stage(facts.select("conv", "call", F.col("first.turn").alias("call_turn"), F.col("first.key").alias("call_key"), F.col("first.k").alias("call_k"), "level", "problem", F.coalesce("answers", zero).alias("answers")), "call-facts")
    known = calls.join(facts, ["conv", "call"], "left")
    repeated = ~(F.col("turn").eqNullSafe(F.col("call_turn")) & (F.col("key") == F.col("call_key")) & (F.col("k") == F.col("call_k")))
    problems = F.concat(
        F.when(~F.col("valid"), F.array(F.lit("invalid_json"))).otherwise(argument_errors(F.col("name"), F.col("arguments"), schemas or {})),
        F.when(F.col("call").isNull(), F.array(F.lit("missing_id"))).when(repeated, F.array(F.lit("duplicate_id"))).otherwise(no_errors),
        F.when(F.col("problem").isNotNull(), F.array("problem")).otherwise(no_errors),
        F.when(F.coalesce("answers", zero) == 0, F.array(F.lit("unanswered"))).otherwise(no_errors),
    )
    canonical = F.coalesce(F.to_json(F.try_parse_json("arguments")), quoted(F.col("arguments")))
    call_json = F.concat(F.lit('{"arguments":'), canonical, F.coalesce(F.concat(F.lit(',"id":'), quoted(F.col("call"))), F.lit("")), F.coalesce(F.concat(F.lit(',"name":'), quoted(F.col("name"))), F.lit("")), F.lit("}"))
    known = known.select("conv", "turn", "role", "key", F.struct(F.coalesce("level", zero).alias("level"), "k", call_json.alias("json"), problems.alias("errors"), (F.coalesce("answers", zero) > 0).alias("linked")).alias("c"))
    by_turn = known.groupBy("conv", "turn", "role", "key").agg(F.array_sort(F.collect_list("c")).alias("calls"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("conv", "turn", "role", "key")]
    content = F.trim(F.regexp_replace("text", CALL, ""))
    listed = F.array_join(F.transform("calls", lambda c: c["json"]), ",")
    spoken = said.alias("s").join(by_turn.alias("b"), same, "left").select("s.conv", "s.turn", "s.role", "s.text", F.coalesce("calls", F.array().cast(by_turn.schema["calls"].dataType)).alias("calls")).select(
        "conv", "turn", "role", _place(F.col("turn"), zero, zero, zero).alias("place"),
        F.concat(F.lit('{"content":'), quoted(content), F.lit(',"role":'), quoted(F.col("role")), F.lit(',"tool_calls":['), listed, F.lit("]}")).alias("json"),
        F.size("calls").cast("long").alias("n_calls"), F.lit(None).cast("string").alias("call_id"),
        F.forall("calls", lambda c: c["linked"]).alias("linked"), F.concat(F.flatten(F.transform("calls", lambda c: c["errors"])), F.when(F.regexp_count("text", F.lit("<tool_call>")) > F.size("calls"), F.array(F.lit("unclosed_call"))).otherwise(no_errors)).alias("errors"),
    )
    # results, put directly after their call
    tied = results.hint("shuffle_hash").join(facts, ["conv", "call"], "left")
    body = F.get_json_object("text", "$.content")
    answers = tied.select(
        "conv", "turn", F.lit("tool").alias("role"),
        F.when(F.col("answers").isNull(), _place(F.col("turn"), zero, zero, zero)).otherwise(_place(F.col("call_turn"), F.col("level") + 1, F.col("call_k").cast("long"), F.col("turn"))).alias("place"),
        F.concat(F.lit('{"content":'), quoted(F.coalesce(body, F.col("text"))), F.lit(',"role":"tool"'), F.coalesce(F.concat(F.lit(',"tool_call_id":'), quoted(F.col("call"))), F.lit("")), F.lit("}")).alias("json"),
        zero.alias("n_calls"), F.col("call").alias("call_id"), F.col("answers").isNotNull().alias("linked"),
        F.when(F.col("answers").isNull(), F.array(F.lit("orphan"))).otherwise(no_errors).alias("errors"),
    )
    return plain.union(spoken).union(answers).withColumnRenamed("conv", conv_col).withColumnRenamed("turn", turn_col)

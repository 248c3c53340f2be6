"""Raw records to the master schema, its rule sets, and chat-training rows (PRJ-*, PRD-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.functions.jsonx import as_schema_udf, object_keys, parameter_errors_udf, parameter_shapes_udf, parsed, schema_errors_udf

SOURCES = ("glaive", "xlam", "custom_vi")


def name_key(c: Column) -> Column:
    """Names are compared in lower case without surrounding white space."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def names(items: Column) -> Column:
    """The name keys of an array of tools or calls, null for a null array."""
    return F.transform(items, lambda x: name_key(x["name"]))


def tool_shape(tools: Column) -> Column:
    """Name key and schema shape of each tool, sorted, null for a null array (PRJ-09)."""
    shapes = parameter_shapes_udf(F.transform(tools, lambda t: t["parameters"]))
    return F.array_sort(F.zip_with(names(tools), shapes, lambda n, s: F.struct(n.alias("name"), s.alias("parameters"))))


# ---- raw forms (PRJ-01..04) -------------------------------------------------------------------------------------------


def first_exchange(turns: Column) -> Column:
    """The turns from the first user turn to the one before the second user turn."""
    users = F.array_compact(F.transform(turns, lambda t, i: F.when(t["role"] == "user", i)))
    first, second = F.get(users, F.lit(0)), F.coalesce(F.get(users, F.lit(1)), F.size(turns))
    return F.when(first.isNotNull(), F.slice(turns, first + 1, second - first))


def before_function(exchange: Column) -> Column:
    """The turns before the first function turn."""
    at = F.array_position(F.transform(exchange, lambda t: t["role"]), "function")
    return F.when(at > 0, F.slice(exchange, F.lit(1), (at - 1).cast("int"))).otherwise(exchange)


def with_first_calls(turns: DataFrame, column: str = "turns") -> DataFrame:
    """turns with function_calls: the calls of the assistant turns of the first exchange, up to a function turn."""
    t = turns.withColumn("ex", first_exchange(F.col(column)))
    t = t.withColumn("ex", before_function(F.col("ex")))
    t = t.withColumn("blocks", F.flatten(F.transform(F.filter("ex", lambda x: x["role"] == "assistant"), lambda x: X.call_blocks(x["content"]))))
    return t.withColumn("function_calls", X.parse_calls(F.col("blocks"))).drop("ex", "blocks")


def _system_tools(system: Column | None) -> Column:
    """The tool that a system text describes as its first object, with a normalised schema; [] for none (PRJ-01)."""
    none = F.expr("cast(array() as array<struct<name: string, description: string, parameters: string>>)")
    if system is None:
        return none
    v = F.try_parse_json(X.first_object_udf(system))
    name = F.try_variant_get(v, "$.name", "string")
    schema = as_schema_udf(F.coalesce(F.to_json(F.try_variant_get(v, "$.parameters", "variant")), F.lit("{}")))
    tool = F.struct(name.alias("name"), F.coalesce(F.try_variant_get(v, "$.description", "string"), F.lit("")).alias("description"), schema.alias("parameters"))
    return F.when(F.coalesce(F.trim(name), F.lit("")) != "", F.array(tool)).otherwise(none)


def from_chat(raw: DataFrame, key: str = "doc_id", chat: str = "text", system: str | None = None, source: str = "glaive") -> DataFrame:
    """(key, source, query, function_calls, tools, has_tool_call, n_turns) of each dialogue with a first user turn and a
    call in answer to it; tools are that of the system text and stubs for other called names."""
    t = raw.select(key, X.turns(F.col(chat)).alias("turns"), _system_tools(F.col(system) if system else None).alias("own")).where(F.exists("turns", lambda x: x["role"] == "user"))
    r = with_first_calls(t).select(key, F.filter("turns", lambda x: x["role"] == "user")[0]["content"].alias("query"), "function_calls", "own", F.size("turns").alias("n_turns"))
    r = r.where("query <> '' and size(function_calls) > 0")
    return r.select(key, F.lit(source).alias("source"), "query", "function_calls", complete_tools(F.col("own"), F.col("function_calls")).alias("tools"), F.lit(True).alias("has_tool_call"), "n_turns")


def negatives_from_chat(raw: DataFrame, key: str = "doc_id", chat: str = "text", system: str | None = None) -> DataFrame:
    """(key, query) of each dialogue with a user turn in which no assistant turn holds a call; with a system text also
    (tools), and dialogues that offer no tool are left out."""
    t = raw.select(key, X.turns(F.col(chat)).alias("turns"), _system_tools(F.col(system) if system else None).alias("tools")).where(F.exists("turns", lambda x: x["role"] == "user"))
    free = ~F.exists("turns", lambda x: (x["role"] == "assistant") & F.contains(x["content"], F.lit("<functioncall>")))
    r = t.where(free).select(key, F.filter("turns", lambda x: x["role"] == "user")[0]["content"].alias("query"), "tools").where("query <> ''")
    return r.where("size(tools) > 0") if system else r.drop("tools")


def from_flat(raw: DataFrame) -> DataFrame:
    """Flat rows {id, query, answers, tools} (JSON text) as records; calls without a snake_case name are dropped, rows
    without a call left out."""
    calls = F.from_json("answers", "array<struct<name string, arguments string>>")
    calls = F.transform(F.filter(calls, lambda c: X.is_snake_case(c["name"])), lambda c: F.struct(c["name"].alias("name"), F.when(F.ltrim(c["arguments"]).startswith("{"), c["arguments"]).otherwise("{}").alias("arguments")))
    tools = F.from_json("tools", "array<struct<name string, description string, parameters string>>")
    r = raw.select(X.record_id(F.lit("xlam"), F.col("id")).alias("id"), F.trim("query").alias("query"), calls.alias("function_calls"), tools.alias("tools"))
    return r.where("query <> '' and size(function_calls) > 0")


def complete_tools(tools: Column, calls: Column) -> Column:
    """tools and a bare stub for each called name that they lack, by name (PRJ-04)."""
    missing = F.array_sort(F.array_except(F.transform(calls, lambda c: c["name"]), F.transform(tools, lambda t: t["name"])))
    stub = F.transform(missing, lambda n: F.struct(n.alias("name"), F.lit("").alias("description"), F.lit('{"type":"object","properties":{}}').alias("parameters")))
    return F.concat(F.transform(tools, lambda t: F.struct(t["name"].alias("name"), t["description"].alias("description"), t["parameters"].alias("parameters"))), stub)


def canonical_tools(tools: Column) -> Column:
    """tools without those that repeat the first definition of their name (PRJ-05); other definitions stay."""
    first = lambda t: F.get(F.filter(tools, lambda u: name_key(u["name"]) == name_key(t["name"])), F.lit(0))
    same = lambda t: first(t)["parameters"].eqNullSafe(t["parameters"]) & first(t)["description"].eqNullSafe(t["description"])
    keyed = F.transform(tools, lambda t, i: F.struct(t.alias("t"), same(t).alias("same"), (F.array_position(names(tools), name_key(t["name"])) - 1 == i).alias("first")))
    return F.transform(F.filter(keyed, lambda k: k["first"] | ~k["same"]), lambda k: k["t"])


# ---- rule sets (PRD-02..08) -------------------------------------------------------------------------------------------


def _first_of(rules: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(msg)) for bad, msg in rules]))


def _some_name(items: Column, bad) -> Column:
    return F.exists(items, lambda x: bad(x["name"]))


def is_object(c: Column) -> Column:
    """Whether JSON text, decoded once more if it was encoded twice, is an object."""
    return F.coalesce(F.to_json(parsed(c)).startswith("{"), F.lit(False))


def rule_errors(deep: bool = False, legacy: bool = False) -> Column:
    """ARRAY<STRING> of the broken rules of a master record; [] for a good one.

    A record that lacks a part (id, source, query, calls, tools) is told only that. deep adds what is inside JSON: the
    normalised schemas of tools at every depth, arguments that a schema does not declare or requires, keys that are not
    snake_case. legacy is the older set: it knows no sources, asks for a call in each record and for a feature group of
    each tool, and lets names repeat."""
    tool_names, call_names = names(F.col("tools")), names(F.col("function_calls"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    odd = lambda n: ~X.is_snake_case(n)
    unknown_call = (F.size(F.array_except(call_names, tool_names)) > 0, "calls: not in tools")
    no_object = (F.exists("function_calls", lambda c: ~is_object(c["arguments"])), "calls: arguments are no object")
    tool_name = (_some_name(F.col("tools"), odd), "tools: name not snake_case")
    if legacy:
        parts = [
            (blank(F.col("id")), "id: empty"),
            (blank(F.col("query")), "query: empty"),
            (F.coalesce(F.size("function_calls"), F.lit(0)) <= 0, "calls: empty"),
            (F.col("tools").isNull(), "tools: null"),
        ]
        rules = [unknown_call, no_object, tool_name, (F.exists("tools", lambda t: blank(t["feature_group"])), "tools: no feature group")]
    else:
        parts = [
            (blank(F.col("id")), "id: empty"),
            (~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)), "source: unknown"),
            (~F.coalesce(F.col("id").startswith(F.concat(F.col("source"), F.lit("_"))), F.lit(False)), "id: prefix is not the source"),
            (blank(F.col("query")), "query: empty"),
            (F.col("function_calls").isNull(), "calls: null"),
            (F.coalesce(F.size("tools"), F.lit(0)) <= 0, "tools: empty"),
        ]
        rules = [tool_name, (F.size(F.array_distinct(tool_names)) < F.size(tool_names), "tools: repeated name"), (_some_name(F.col("function_calls"), odd), "calls: name not snake_case"), unknown_call, no_object]
    lacking, broken = _first_of(parts), _first_of(rules)
    if deep:
        keys = lambda c: object_keys(c["arguments"])
        known = lambda c: F.array_contains(tool_names, name_key(c["name"])) & is_object(c["arguments"])
        none = F.array().cast("array<string>")
        undeclared = F.transform("function_calls", lambda c: F.when(known(c), F.array_except(keys(c), declared(F.col("tools"), c["name"]))).otherwise(none))
        missing = F.transform("function_calls", lambda c: F.when(known(c), F.array_except(required(F.col("tools"), c["name"]), keys(c))).otherwise(none))
        odd_keys = F.transform("function_calls", lambda c: F.filter(keys(c), odd))
        tell = lambda sets, what: F.coalesce(F.transform(F.array_sort(F.array_distinct(F.flatten(sets))), lambda k: F.concat(F.lit(what), k)), none)
        schemas = F.transform(parameter_errors_udf(F.transform("tools", lambda t: t["parameters"])), lambda e: F.concat(F.lit("schema: "), e))
        broken = F.concat(broken, F.coalesce(schemas, none), tell(undeclared, "arguments: undeclared "), tell(missing, "arguments: missing "), tell(odd_keys, "arguments: key not snake_case "))
    return F.when(F.size(lacking) > 0, lacking).otherwise(broken)


def _schema_of(tools: Column, name: Column) -> Column:
    return parsed(F.get(F.filter(tools, lambda t: name_key(t["name"]) == name_key(name)), F.lit(0))["parameters"])


def declared(tools: Column, name: Column) -> Column:
    """Parameter names of the tool of that name, in either form."""
    v = _schema_of(tools, name)
    keys = lambda x: F.json_object_keys(F.to_json(x))
    is_schema = F.try_variant_get(v, "$.type", "string") == "object"
    return F.coalesce(F.when(is_schema, keys(F.try_variant_get(v, "$.properties", "variant"))).otherwise(keys(v)), F.array().cast("array<string>"))


def required(tools: Column, name: Column) -> Column:
    """Names that a JSON Schema requires; in the flat form those whose type is not optional and that have no default."""
    v = _schema_of(tools, name)
    is_schema = F.try_variant_get(v, "$.type", "string") == "object"
    flat = F.try_variant_get(v, "$", "map<string, variant>")
    need = lambda p: F.try_variant_get(p, "$.default", "variant").isNull() & ~F.coalesce(F.try_variant_get(p, "$.type", "string").rlike(r"(?i),\s*optional\s*$"), F.lit(False))
    listed = F.try_variant_get(v, "$.required", "array<string>")
    return F.coalesce(F.when(is_schema, listed).otherwise(F.array_sort(F.map_keys(F.map_filter(flat, lambda k, p: need(p))))), F.array().cast("array<string>"))


def validated(records: DataFrame, deep: bool = False, legacy: bool = False) -> DataFrame:
    """records with errors and ok."""
    e = records.withColumn("errors", rule_errors(deep, legacy))
    return e.withColumn("ok", F.size("errors") == 0)


def schema_report(pool: DataFrame) -> DataFrame:
    """(tool_id, schema, errors): the parameters of each tool as JSON Schema and what is wrong with it."""
    return pool.select("tool_id", as_schema_udf("parameters").alias("schema")).withColumn("errors", schema_errors_udf("schema"))


def identifier_integrity(en: Column, vi: Column) -> Column:
    """Whether two call lists have the same names and, call by call, the same argument keys (PRD-07)."""
    keys = lambda c: F.transform(c, lambda x: F.array_sort(object_keys(x["arguments"])))
    return names(en).eqNullSafe(names(vi)) & keys(en).eqNullSafe(keys(vi))


# ---- chat-training rows (PRJ-06..08, PRD-09) -------------------------------------------------------------------------

# System prompts by language.
PROMPTS = {"en": "You are an assistant that answers by calling the tools given.", "vi": "Bạn là trợ lý trả lời bằng cách gọi các công cụ được cung cấp."}
NO_CALL = {"en": "None of the tools fits this request.", "vi": "Không có công cụ nào phù hợp với yêu cầu này."}


def chat_rows(records: DataFrame, language: Column) -> DataFrame:
    """(rid, language, messages, tools) of each record with a query, named tools and calls to its own tools."""
    r = records.withColumn("lang", language).where(F.col("lang").isin(*PROMPTS))
    good = (F.coalesce(F.trim("query"), F.lit("")) != "") & (F.size("tools") > 0) & ~F.exists("tools", lambda t: F.coalesce(name_key(t["name"]), F.lit("")) == "") & (F.size(F.array_except(F.coalesce(names(F.col("function_calls")), F.array().cast("array<string>")), names(F.col("tools")))) == 0)
    pick = lambda d: F.when(F.col("lang") == "vi", d["vi"]).otherwise(d["en"])
    calls = F.transform(F.coalesce("function_calls", F.expr("array()")), lambda c: F.struct(F.lit("function").alias("type"), F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")).alias("function")))
    none = F.expr("cast(null as array<struct<type: string, function: struct<name: string, arguments: string>>>)")
    msg = lambda role, content, tc: F.struct(F.lit(role).alias("role"), content.alias("content"), tc.alias("tool_calls"))
    has = F.size(F.coalesce("function_calls", F.expr("array()"))) > 0
    messages = F.array(msg("system", pick(PROMPTS), none), msg("user", F.col("query"), none), msg("assistant", F.when(~has, pick(NO_CALL)), F.when(has, calls)))
    tools = F.transform("tools", lambda t: F.struct(F.lit("function").alias("type"), F.struct(t["name"].alias("name"), t["description"].alias("description"), t["parameters"].alias("parameters")).alias("function")))
    return r.where(good).select("rid", F.col("lang").alias("language"), messages.alias("messages"), tools.alias("tools"))


def chat_errors(messages: Column) -> Column:
    """What is wrong with a chat row: order of roles, number of messages, shape of calls."""
    roles = F.transform(messages, lambda m: m["role"])
    return F.array_compact(
        F.array(
            F.when(F.size(messages) < 3, F.lit("fewer than three messages")),
            F.when(F.slice(roles, 1, 2) != F.array(F.lit("system"), F.lit("user")), F.lit("does not begin with system, user")),
            F.when(F.element_at(roles, -1) != "assistant", F.lit("does not end with assistant")),
            F.when(F.exists(messages, lambda m: F.exists(m["tool_calls"], lambda c: F.coalesce(F.trim(c["function"]["name"]), F.lit("")) == "")), F.lit("call without a name")),
        )
    )

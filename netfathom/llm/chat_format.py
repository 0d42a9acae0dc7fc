"""Chat formatting with linked tool calls.

A message is one row (conv_id, turn, role, text). Tool calls are assistant texts of the form
``{"tool_calls": [{"id": ..., "name": ..., "arguments": {...}}]}`` and results are texts of role ``tool`` of the form
``{"tool_call_id": ..., "content": ...}``. Calls and results are hash-joined by (conversation, identifier). A call may
name earlier calls in its arguments as ``"$<id>"``; calls and results get a depth in the order of these dependencies.
Arguments are checked against the tools' parameters, and each message is serialised as canonical JSON: keys in order, no
white space, numbers normalised.

The result is in long form, one row per message, with a sort key (``order_turn``, ``order_depth``, ``order_step``) that
puts each result behind the message of its call, those of deeper calls later: a conversation of any size is never
gathered.

Null roles count as ``user`` and null texts as empty; a null conversation is one like others. Texts that are no such JSON
are plain messages. All calls are counted and checked, and null arguments are none. Of several calls with one identifier
results go to the first (turn, message, place), and the others are errors, as are calls without an identifier and results
without a call. A repeated row is the same message told again: it stays repeated, with the errors of that message and no
more. Calls of dependency cycles, and those between two cycles, share a depth and are errors. Texts of any length are taken
whole. Other columns are ignored. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

_CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>>"
_RESULT = "struct<tool_call_id:string,content:string>"
_KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}


def parameter_table(spark, tools: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """(name, parameter, kind, required) of tools given as {tool: {parameter: (kind, required)}}; kinds: string, integer,
    number, boolean, object, array."""
    rows = [f"('{t}', '{p}', '{k}', {str(r).lower()})" for t, ps in tools.items() for p, (k, r) in ps.items()]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(name, parameter, kind, required)") if rows else spark.sql("SELECT '' name, '' parameter, '' kind, false required WHERE false")


def _calls(messages: DataFrame) -> DataFrame:
    """All calls, those without an identifier and repeated ones too; those of a repeated message once."""
    told = messages.where("role = 'assistant' and startswith(ltrim(text), '{')").select("_c", "_m", "turn", F.from_json("text", _CALLS)["tool_calls"].alias("calls"))
    found = told.select("_c", "_m", "turn", F.posexplode("calls").alias("place", "c"))
    return found.select("_c", "_m", "turn", "place", F.col("c.id").alias("call_id"), F.coalesce("c.name", F.lit("")).alias("name"), F.coalesce("c.arguments", F.lit("{}")).alias("arguments")).dropDuplicates(["_c", "_m", "place"])


def _checked(calls: DataFrame, parameters: DataFrame) -> DataFrame:
    """Adds ``errors`` to calls (name, arguments): no object, unknown tool, or parameters that are missing, of another kind or
    unknown. A tool's parameters come as one row; the table of tools is part of the set-up and small, so it is broadcast, and
    a tool that most calls name gathers in no task."""
    tools = parameters.groupBy(F.col("name").alias("_tool")).agg(F.collect_list(F.struct("parameter", "kind", "required")).alias("_params"))
    rows = calls.join(F.broadcast(tools), F.col("name") == F.col("_tool"), "left")
    rows = rows.withColumn("_v", F.expr("try_parse_json(arguments)")).withColumn("_keys", F.expr("coalesce(json_object_keys(arguments), array())"))
    kinds = " ".join(f"when {k!r} then {v!r}" for k, v in _KINDS.items())
    found = r"regexp_extract(schema_of_variant(try_variant_get(_v, concat('$.', p.parameter), 'variant')), '^\\w+', 0)"
    fits = f"case p.kind when 'number' then {found} in ('BIGINT', 'DECIMAL', 'DOUBLE', 'FLOAT') else {found} = case p.kind {kinds} end end"
    wrong = f"aggregate(_params, 0, (n, p) -> n + case when not array_contains(_keys, p.parameter) then cast(p.required as int) when coalesce({fits}, false) then 0 else 1 end)"
    known = "size(filter(_params, p -> array_contains(_keys, p.parameter)))"
    errors = F.when(F.col("_v").isNull() | ~F.col("arguments").rlike(r"^\s*\{"), 1).when(F.col("_tool").isNull(), 1).otherwise(F.expr(f"{wrong} + size(_keys) - {known}"))
    return rows.withColumn("errors", errors.cast("long")).drop("_tool", "_params", "_v", "_keys")


def _core(needs: DataFrame) -> DataFrame:
    """Of calls that all need a cycle, those that are needed by one themselves, with their needs: the cycles, and what lies
    between them."""
    core, n = needs, needs.count()
    while True:
        core = cut(core.join(core.select("_c", F.col("needed").alias("call_id")).distinct(), ["_c", "call_id"], "left_semi"))
        n, before = core.count(), n
        if n == before:
            return core


def _depths(calls: DataFrame) -> DataFrame:
    """(_c, call_id, depth, cyclic) of calls: 0, or one more than the deepest call that their arguments name. Calls are placed
    by peeling: each round places those whose needs are all placed. Where none can be, the calls of cycles get one depth
    behind the placed ones of their conversation, and peeling goes on."""
    needs = calls.select("_c", "call_id", F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(r'"\$([^"]+)"'), F.lit(1)))).alias("needed")).where("needed <> call_id")
    waiting = cut(needs.join(calls.select("_c", F.col("call_id").alias("needed")), ["_c", "needed"], "left_semi").select("_c", "call_id", "needed"))
    last = calls.select("_c", "call_id").join(waiting, ["_c", "call_id"], "left_anti").select("_c", "call_id", F.lit(0).alias("depth"), F.lit(False).alias("cyclic"))
    done, parts = last, 0
    while not waiting.isEmpty():
        met = waiting.join(last.withColumnRenamed("call_id", "needed"), ["_c", "needed"]).groupBy("_c", "call_id").agg((F.max("depth") + 1).alias("depth"))
        left = cut(waiting.join(last.select("_c", F.col("call_id").alias("needed")), ["_c", "needed"], "left_anti").select("_c", "call_id", "needed"))
        last = cut(met.join(left, ["_c", "call_id"], "left_anti").withColumn("cyclic", F.lit(False)))
        waiting = left
        if last.isEmpty() and not waiting.isEmpty():
            cycles = _core(waiting).select("_c", "call_id").distinct()
            behind = done.groupBy("_c").agg((F.max("depth") + 1).alias("depth"))
            last = cut(cycles.join(behind, "_c", "left").select("_c", "call_id", F.coalesce("depth", F.lit(0)).alias("depth"), F.lit(True).alias("cyclic")))
            waiting = cut(waiting.join(last, ["_c", "call_id"], "left_anti"))
        done, parts = done.union(last), parts + 1
        if parts % 16 == 0:
            done = cut(done)
    return done


def format_chats(messages: DataFrame, parameters: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, message (canonical JSON), n_calls, n_errors, depth (of its deepest call, or of the
    call of a result), call_id (of a result), linked, order_turn, order_depth, order_step."""
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # _c: the conversation, null or not; _m: the message
    rows = rows.withColumn("_c", F.coalesce(F.col("conv_id").cast("string"), F.lit("\u0000"))).withColumn("_m", F.xxhash64(F.to_json(F.struct("turn", "role")), "text"))
    found = cut(_calls(rows))
    first = found.where("call_id is not null").groupBy("_c", "call_id").agg(F.min(F.struct("turn", "_m", "place", "name", "arguments")).alias("f")).select("_c", "call_id", "f.*")
    placed = cut(first.join(_depths(first), ["_c", "call_id"]).select("_c", "call_id", "_m", "turn", "place", "depth", "cyclic"))
    errors = _checked(found, parameters).select("_c", "_m", "place", "errors")
    wrong = F.col("errors") + F.when(F.col("cyclic").isNull() | F.col("cyclic"), 1).otherwise(0)  # cyclic is null for a call that is not the first of its identifier
    own = errors.join(placed.select("_c", "_m", "place", "depth", "cyclic"), ["_c", "_m", "place"], "left")
    by_message = own.groupBy("_c", "_m").agg(F.sum(wrong).alias("n_errors"), F.coalesce(F.max("depth"), F.lit(0)).alias("deepest"))
    links = placed.select("_c", "call_id", F.col("turn").alias("call_turn"), F.col("place").alias("call_place"), F.col("depth").alias("call_depth"))

    result = F.when(F.col("role") == "tool", F.from_json("text", _RESULT))
    called = F.when((F.col("role") == "assistant") & F.expr("startswith(ltrim(text), '{')"), F.expr("to_json(try_variant_get(try_parse_json(text), '$.tool_calls', 'variant'))"))
    listed = F.when((F.col("role") == "assistant") & F.expr("startswith(ltrim(text), '{')"), F.size(F.from_json("text", _CALLS)["tool_calls"]))
    rows = rows.withColumn("call_id", result["tool_call_id"]).withColumn("_calls", called).withColumn("n_calls", listed.cast("long"))
    # messages without an identifier get one that meets nothing, so that those of one conversation are not dealt to one task
    rows = rows.withColumn("_id", F.coalesce("call_id", F.concat(F.lit("\u0000"), F.col("_m"))))
    joined = rows.join(links.withColumnRenamed("call_id", "_id"), ["_c", "_id"], "left").join(by_message, ["_c", "_m"], "left")
    is_call, is_result = F.coalesce(F.col("n_calls") > 0, F.lit(False)) & F.col("_calls").isNotNull(), F.col("call_id").isNotNull()
    text_of = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    content = F.coalesce(F.expr("to_json(try_variant_get(try_parse_json(text), '$.content', 'variant'))"), F.lit("null"))
    message = (
        F.when(is_call, F.concat(F.lit('{"role":'), text_of(F.col("role")), F.lit(',"tool_calls":'), F.col("_calls"), F.lit("}")))
        .when(is_result, F.concat(F.lit('{"content":'), content, F.lit(',"role":"tool","tool_call_id":'), text_of(F.col("call_id")), F.lit("}")))
        .otherwise(F.concat(F.lit('{"content":'), text_of(F.col("text")), F.lit(',"role":'), text_of(F.col("role")), F.lit("}")))
    )
    linked = F.col("call_place").isNotNull()
    return joined.select(
        "conv_id", "turn", "role", message.alias("message"),
        F.when(is_call, F.col("n_calls")).otherwise(0).alias("n_calls"),
        (F.when(is_call, F.col("n_errors")).otherwise(0) + (is_result & ~linked).cast("long")).alias("n_errors"),
        F.when(is_result & linked, F.col("call_depth")).when(is_call, F.col("deepest")).otherwise(0).alias("depth"),
        "call_id", F.when(is_result, linked).alias("linked"),
        F.when(is_result & linked, F.col("call_turn")).otherwise(F.col("turn")).alias("order_turn"),
        F.when(is_result & linked, F.col("call_depth")).otherwise(0).alias("order_depth"),
        F.when(is_result & linked, 1 + F.col("call_place")).otherwise(0).alias("order_step"),
    )

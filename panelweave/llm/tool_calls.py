"""Tool calls of chat messages: linked to results, ordered by dependency, validated, and written as canonical JSON.

DataFrame functions only. A message of role ``assistant`` may hold ``{"tool_calls": [{"id", "name", "arguments"}]}``, one of
role ``tool`` holds ``{"tool_call_id", "content"}``. An argument ``{"$result": "<id>"}`` refers to the result of another call
of the conversation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import discard, keep

CALLS = "tool_calls array<struct<id:string,name:string,arguments:string>>"
RESULT = "tool_call_id string, content string"
REFERENCE = r'\{"\$result":"((?:[^"\\]|\\.)*)"\}'
KEY = ["no_conv", "conv_id", "call_key"]  # a null conv_id is 0 with the flag set: no number stands for it


@dataclass(frozen=True)
class Field:
    """One argument of a tool: the variant types it may have, whether it must be there, and bounds of numbers."""

    types: tuple[str, ...]
    required: bool = True
    least: float | None = None
    most: float | None = None


def parsed_calls(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``slot``, ``call_id``, ``name``, ``arguments``: the calls that assistant messages hold."""
    made = messages.filter(F.col("role") == "assistant").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.posexplode(F.from_json("text", CALLS)["tool_calls"]).alias("slot", "call")
    )
    return made.select("conv_id", "turn", "slot", F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments"))


def parsed_results(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``call_id``, ``content`` of tool messages."""
    made = messages.filter(F.col("role") == "tool").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.from_json("text", RESULT).alias("r")
    )
    return made.select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content"))


# --- canonical JSON -------------------------------------------------------------------------------------------------------

_STRING = r'"(?:[^"\\]|\\.)*"'
_TOKEN = _STRING + r'|-?[0-9][0-9.]*(?:E-?[0-9]+)?|[^"0-9-]+'
_HIGH, _BEYOND, _MARK = "[\ue000-\uffff]", r"[\x{10000}-\x{10FFFF}]", "\ud7ff"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: lambdas know no common subexpressions."""
    return F.transform(F.array(value), use)[0]


def _number(token: Column) -> Column:
    """A number as the variant writes it, in its shortest form: plain between 1e-7 and 1e21, else with an exponent.

    The digits are those of the shortest text that reads back as the same double (two at least below 1e-322, as Java writes
    them), or all of a decimal without trailing zeros.
    """
    sign, size = F.when(token.startswith("-"), F.lit("-")).otherwise(""), F.ltrim(token, F.lit("-"))
    parts = F.split(size, "E")
    plain = lambda x: F.regexp_replace(x, r"(?<=[0-9])\.0*$|(\.[0-9]*[1-9])0+$", "$1")

    def shifted(digits: Column, e: Column) -> Column:
        n = F.length(digits)
        whole = F.when(n <= e + 1, F.rpad(digits, e + 1, F.lit("0"))).otherwise(F.concat(F.substr(digits, F.lit(1), e + 1), F.lit("."), F.substr(digits, e + 2)))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        mantissa = F.when(n == 1, digits).otherwise(F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.lit("."), F.substr(digits, F.lit(2))))
        power = F.concat(mantissa, F.lit("e"), F.when(e > 0, "+").otherwise("-"), F.abs(e).cast("string"))
        return F.when(e.between(0, 20), whole).when(e.between(-7, -1), small).otherwise(power)

    scientific = _let(F.replace(plain(parts[0]), F.lit("."), F.lit("")), lambda digits: _let(F.get(parts, F.lit(1)).cast("int"), lambda e: shifted(digits, e)))
    made = F.when(F.size(parts) == 2, scientific).otherwise(plain(size))
    return F.when(made == "0", made).otherwise(F.concat(sign, made))


def canonical_json(text: Column) -> Column:
    """``text`` as canonical JSON, or null if it is no JSON or an object in it has a key twice.

    Keys are sorted by code point, no white space, numbers in their shortest form, strings with as few escapes as there can be.
    Built-in functions only: a variant sorts keys by their UTF-16 units, so letters from U+E000 on get a mark before them that
    puts them below the surrogates while it sorts.
    """
    sorted_once = F.to_json(F.try_parse_json(text))

    def by_code_point(json: Column) -> Column:
        marked = F.regexp_replace(json, f"({_MARK}|{_HIGH})", f"{_MARK}$1")
        return F.regexp_replace(F.to_json(F.try_parse_json(marked)), f"{_MARK}(.)", "$1")

    ordered = _let(sorted_once, lambda json: F.when(json.rlike(_HIGH) & json.rlike(_BEYOND), by_code_point(json)).otherwise(json))
    shorter = lambda json: F.array_join(
        F.transform(F.regexp_extract_all(json, F.lit(_TOKEN), F.lit(0)), lambda t: F.when(t.rlike("^-?[0-9]"), _number(t)).otherwise(t)), ""
    )
    return _let(ordered, lambda json: F.when(json.rlike(r"[0-9]E|\.[0-9]*0(?![0-9])|-0"), shorter(json)).otherwise(json))


def _quoted(text: Column) -> Column:
    """A JSON string literal, or null."""
    whole = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(whole, F.lit(2), F.length(whole) - 2))


def violations(name: Column, value: Column, keys: Column, schemas: dict[str, dict[str, Field]]) -> Column:
    """Sorted messages about arguments that do not meet the schema of their tool; empty if all do."""
    found = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        checks = [F.transform(F.array_except(keys, F.array(*[F.lit(f) for f in fields])), lambda k: F.concat(F.lit("unexpected "), k))]
        for field, rule in fields.items():
            there = F.array_contains(keys, field)
            kind = F.regexp_extract(F.schema_of_variant(F.variant_get(value, f"$.{field}", "variant")), "^[A-Z]+", 0)
            number = F.try_variant_get(value, f"$.{field}", "double")
            one = [F.when(there & ~kind.isin(*rule.types), F.lit(f"type {field}"))]
            one += [F.when(~there, F.lit(f"missing {field}"))] if rule.required else []
            one += [F.when(number < rule.least, F.lit(f"below {field}"))] if rule.least is not None else []
            one += [F.when(number > rule.most, F.lit(f"above {field}"))] if rule.most is not None else []
            checks.append(F.array_compact(F.array(*one)))
        found = F.when(name == tool, F.array_sort(F.concat(*checks))).otherwise(found)
    return F.when(keys.isNull(), F.array(F.lit("arguments are not a JSON object"))).otherwise(found)


def _levels(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``KEY``, ``order_level``) of calls whose order is not that of their turns, and (``KEY``, ``missing``) of dangling references.

    Where every reference points to an earlier call the turns are a topological order: level 0. Only conversations with a
    reference to the same or a later call are peeled, level by level, with one written table a round; a round settles the
    calls all of whose references are settled. What is never settled lies on a cycle or behind one: level null.
    """
    place = F.struct("turn", "slot")
    edges = calls.select(*KEY, place.alias("child_at"), F.explode(F.array_distinct("refers")).alias("parent"))
    known = calls.select("no_conv", "conv_id", F.col("call_key").alias("parent"), place.alias("parent_at"))
    edges = keep(edges.join(known, ["no_conv", "conv_id", "parent"], "left"), "references")
    missing = edges.filter("parent_at IS NULL").groupBy(*KEY).agg(F.count(F.lit(1)).alias("missing"))
    edges = edges.filter("parent_at IS NOT NULL")
    crossed = edges.filter("parent_at >= child_at").select("no_conv", "conv_id").distinct()
    open_edges = edges.join(crossed, ["no_conv", "conv_id"]).select(*KEY, "parent")
    levels = open_edges.select(*KEY).distinct().withColumn("order_level", F.lit(None).cast("int"))
    levels, settled = keep(levels, "levels"), 0
    while True:
        parents = levels.select("no_conv", "conv_id", F.col("call_key").alias("parent"), F.col("order_level").alias("above"), F.lit(True).alias("bound"))
        # a parent without references of its own is not in the table: level 0
        seen = open_edges.join(parents, ["no_conv", "conv_id", "parent"], "left").withColumn("above", F.when(F.col("bound"), F.col("above")).otherwise(F.lit(0)))
        reached = seen.groupBy(*KEY).agg(F.when(F.count_if(F.col("above").isNull()) == 0, F.max("above") + 1).alias("order_level"))
        following = keep(reached, "levels")
        now = following.filter("order_level IS NOT NULL").count()
        discard(levels)
        levels = following
        if now == settled:
            return levels, missing
        settled = now


def _keyed(rows: DataFrame, unnamed: Column) -> DataFrame:
    """``rows`` with ``KEY``; one without call_id has a key of its own, made of ``unnamed``."""
    rows = rows.withColumn("no_conv", F.col("conv_id").isNull()).withColumn("conv_id", F.coalesce("conv_id", F.lit(0)))
    return rows.withColumn("call_key", F.coalesce("call_id", unnamed))


def _numbered(rows: DataFrame, order: list[str], total: str, name: str) -> DataFrame:
    """``rows``, each with ``total``, how many have its ``KEY``, and ``first``, whether it is the earliest of them by ``order``."""
    rows = keep(rows.withColumn("uid", F.monotonically_increasing_id()), name)  # written: the numbers stay
    firsts = rows.groupBy(*KEY).agg(F.min(F.struct(*order, "uid"))["uid"].alias("first_uid"), F.count(F.lit(1)).alias(total))
    return rows.join(firsts, KEY).withColumn("first", F.col("uid") == F.col("first_uid")).drop("first_uid")


def linked_calls(messages: DataFrame, schemas: dict[str, dict[str, Field]]) -> DataFrame:
    """One row per call as it occurs, per result whose call is absent, and per further result of a call.

    ``conv_id``, ``call_id``, ``turn``, ``slot``, ``name``, ``result_turn``, ``n_calls``, ``n_results``, ``order_level``
    (order by it, then turn and slot: every call follows what it refers to), ``missing`` (references to no call), ``status``
    (``ok``, ``cycle``, ``unanswered``, ``orphan result`` or ``further result``), ``problems`` (against the schema) and
    ``message``, canonical JSON: keys sorted by code point, no white space, numbers in shortest form (``canonical_json``). A whole
    number is one in any spelling (``1e2`` is 100). Arguments in which a key stands twice are kept as text and are a problem.

    Calls and results meet in a hash join on conversation and identifier. Of a repeated identifier every call is a row, linked
    to the earliest result; a reference means the earliest call. Every later result is a row ``further result`` that repeats
    the earliest call (nothing, if the call is absent). ``n_calls`` and ``n_results`` count those of the identifier. A call
    without id is never linked. Texts that are not JSON of that form hold no calls. Null conversations form one. Empty tables
    give no rows; other columns are ignored. Texts are used whole.
    """
    calls = _keyed(parsed_calls(messages), F.concat_ws(" ", F.lit("\u0000"), "turn", "slot"))
    calls = _numbered(calls, ["turn", "slot", "call_id", "name", "arguments"], "n_calls", "called")
    # the id belongs to the earliest call; a later one refers to others, and nothing to it
    calls = calls.withColumn("link_key", F.col("call_key")).withColumn("call_key", F.when(F.col("first"), F.col("call_key")).otherwise(F.concat(F.lit("\u0002 "), F.col("uid").cast("string"))))
    calls = calls.withColumn("canonical", canonical_json(F.col("arguments")))
    named = F.transform(F.regexp_extract_all("canonical", F.lit(REFERENCE), 1), lambda x: F.from_json(F.concat(F.lit('["'), x, F.lit('"]')), "array<string>")[0])
    calls = calls.withColumn("refers", F.coalesce(named, F.array().cast("array<string>")))
    calls = keep(calls.drop("uid"), "calls")
    levels, missing = _levels(calls)
    calls = calls.join(levels.withColumn("peeled", F.lit(True)), KEY, "left").join(missing, KEY, "left")
    calls = calls.drop("call_key").withColumnRenamed("link_key", "call_key").withColumn("called", F.lit(True))
    results = _keyed(parsed_results(messages), F.concat_ws(" ", F.lit("\u0001"), "turn")).withColumnRenamed("call_id", "asked")
    results = keep(_numbered(results, ["turn", "content"], "n_results", "answers").withColumn("r", F.struct("turn", "content")).select(*KEY, "first", "asked", "n_results", "r"), "results")
    joined = calls.drop("first").join(results.filter("first").drop("first"), KEY, "full").withColumn("further", F.lit(False))
    more = results.filter("NOT first").drop("first").join(calls.filter("first").drop("first"), KEY, "left").withColumn("further", F.lit(True))
    joined = joined.unionByName(more)
    keys = F.json_object_keys("canonical")
    called, level = F.col("called").isNotNull(), F.when(F.col("peeled"), F.col("order_level")).otherwise(F.lit(0))
    status = F.when(F.col("further"), "further result").when(~called, "orphan result").when(level.isNull(), "cycle").when(F.col("r").isNull(), "unanswered").otherwise("ok")
    parts = [("arguments", F.coalesce("canonical", _quoted(F.col("arguments")))), ("id", _quoted(F.col("call_id"))), ("name", _quoted(F.col("name"))), ("result", _quoted(F.col("r.content")))]
    body = [piece for k, (label, text) in enumerate(parts) for piece in (F.lit(("{" if k == 0 else ",") + f'"{label}":'), text)]
    doubled = F.col("canonical").isNull() & F.json_object_keys("arguments").isNotNull()
    problems = F.when(doubled, F.array(F.lit("a key stands twice"))).otherwise(violations(F.col("name"), F.parse_json("canonical"), keys, schemas))
    return joined.select(
        F.when(~F.col("no_conv"), F.col("conv_id")).alias("conv_id"),
        F.coalesce("call_id", "asked").alias("call_id"),
        "turn",
        "slot",
        "name",
        F.col("r.turn").alias("result_turn"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.when(called, level).alias("order_level"),
        F.coalesce("missing", F.lit(0)).alias("missing"),
        status.alias("status"),
        F.when(called, problems).alias("problems"),
        F.concat(*body, F.lit("}")).alias("message"),
    )


TOOLS = {
    "search": {"query": Field(("STRING",)), "limit": Field(("BIGINT",), least=1, most=8), "after": Field(("OBJECT",), required=False)},
    "summarise": {"query": Field(("STRING",)), "limit": Field(("BIGINT",), required=False, least=2), "after": Field(("OBJECT",), required=False)},
    "translate": {"text": Field(("STRING",)), "limit": Field(("BIGINT",), required=False), "after": Field(("OBJECT",), required=False)},
}


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """Tool messages derived from plain conversations, whose turns hold no calls of their own.

    A user turn becomes a call named ``<conversation>-<turn>`` whose query is its text; some refer to the call two turns on or
    back. An assistant turn becomes the result of the call of the turn before it, a system turn that of its own turn.
    """
    turn = F.col("turn").cast("bigint")
    named = lambda t: F.concat_ws("-", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), t.cast("string"))
    ahead, back = F.pmod(turn, F.lit(8)) < 2, (F.pmod(turn, F.lit(8)).between(4, 5)) | F.pmod(turn, F.lit(32)).between(2, 3)
    after = F.when(ahead, F.struct(named(turn + 2).alias("$result"))).when(back, F.struct(named(turn - 2).alias("$result")))
    name = F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (F.pmod(turn, F.lit(3)) + 1).cast("int"))
    arguments = F.struct(F.col("text").alias("query"), turn.alias("limit"), after.alias("after"))
    call = F.to_json(F.struct(F.array(F.struct(named(turn).alias("id"), name.alias("name"), arguments.alias("arguments"))).alias("tool_calls")))
    asked = F.when(F.col("role") == "assistant", named(turn - 1)).otherwise(named(turn))
    result = F.to_json(F.struct(asked.alias("tool_call_id"), F.col("text").alias("content")))
    user = F.col("role") == "user"
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("turn"), F.when(user, "assistant").otherwise("tool").alias("role"), F.when(user, call).otherwise(result).alias("text")
    )


SQL = r"""
WITH RECURSIVE call AS (
  SELECT conv_id, turn, conv_id || '-' || turn AS call_id, ['search', 'summarise', 'translate'][(turn % 3 + 1)::INTEGER] AS name, text,
         CASE WHEN turn % 8 < 2 THEN turn + 2 WHEN turn % 8 BETWEEN 4 AND 5 OR turn % 32 BETWEEN 2 AND 3 THEN turn - 2 END AS refers
  FROM conversations WHERE role = 'user'),
result AS (
  SELECT conv_id, asked, min(turn) AS result_turn, arg_min(text, turn) AS content, count(*) AS n_results
  FROM (SELECT conv_id, turn, text, CASE WHEN role = 'assistant' THEN turn - 1 ELSE turn END AS asked FROM conversations WHERE role <> 'user')
  GROUP BY conv_id, asked),
edge AS (SELECT c.conv_id, c.turn, c.refers, p.turn AS found FROM call c LEFT JOIN call p ON p.conv_id = c.conv_id AND p.turn = c.refers WHERE c.refers IS NOT NULL),
crossed AS (SELECT DISTINCT conv_id FROM edge WHERE found >= turn),
walk AS (
  SELECT c.conv_id, c.turn, 0 AS level FROM call c WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.conv_id = c.conv_id AND e.turn = c.turn AND e.found IS NOT NULL)
  UNION ALL
  SELECT e.conv_id, e.turn, w.level + 1 FROM walk w JOIN edge e ON e.conv_id = w.conv_id AND e.found = w.turn),
placed AS (
  SELECT c.*, r.result_turn, r.content, coalesce(r.n_results, 0) AS n_results, r.conv_id IS NOT NULL AS answered,
         CASE WHEN x.conv_id IS NULL THEN 0 ELSE w.level END AS order_level, e.turn IS NOT NULL AND e.found IS NULL AS dangling
  FROM call c LEFT JOIN result r ON r.conv_id = c.conv_id AND r.asked = c.turn LEFT JOIN crossed x ON x.conv_id = c.conv_id
  LEFT JOIN walk w ON w.conv_id = c.conv_id AND w.turn = c.turn LEFT JOIN edge e ON e.conv_id = c.conv_id AND e.turn = c.turn)
SELECT conv_id, call_id, turn, 0 AS slot, name, result_turn, 1 AS n_calls, n_results, order_level, dangling::INTEGER AS missing,
       CASE WHEN order_level IS NULL THEN 'cycle' WHEN NOT answered THEN 'unanswered' ELSE 'ok' END AS status,
       list_sort(list_filter(CASE name
         WHEN 'search' THEN [CASE WHEN text IS NULL THEN 'missing query' END, CASE WHEN turn < 1 THEN 'below limit' END, CASE WHEN turn > 8 THEN 'above limit' END]
         WHEN 'summarise' THEN [CASE WHEN text IS NULL THEN 'missing query' END, CASE WHEN turn < 2 THEN 'below limit' END]
         ELSE ['missing text', CASE WHEN text IS NOT NULL THEN 'unexpected query' END] END, lambda m: m IS NOT NULL)) AS problems,
       '{{"arguments":{{' || CASE WHEN refers IS NOT NULL THEN '"after":{{"$result":"' || conv_id || '-' || refers || '"}},' ELSE '' END || '"limit":' || turn
         || CASE WHEN text IS NOT NULL THEN ',"query":' || to_json(text)::VARCHAR ELSE '' END || '}},"id":"' || call_id || '","name":"' || name || '","result":'
         || coalesce(to_json(content)::VARCHAR, 'null') || '}}' AS message
FROM placed
UNION ALL
SELECT r.conv_id, r.conv_id || '-' || r.asked, NULL, NULL, NULL, r.result_turn, 0, r.n_results, NULL, 0, 'orphan result', NULL,
       '{{"arguments":null,"id":null,"name":null,"result":' || coalesce(to_json(r.content)::VARCHAR, 'null') || '}}'
FROM result r LEFT JOIN call c ON c.conv_id = r.conv_id AND c.turn = r.asked WHERE c.conv_id IS NULL""".replace("{{", "{").replace("}}", "}")

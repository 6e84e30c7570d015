"""Chat formatting of tool calls: link calls with results, order them, check arguments, serialise canonical JSON.

DataFrame operations only:

1. Calls are hash-joined with results by conversation and identifier; of several results the earliest turn counts, and of
   several in that turn the smallest text.
2. Calls name the calls they depend on. A call's level is the longest chain of calls below it, 0 where it depends on
   nothing. Chains of calls that need one call each are followed by doubling: every call points to what it needs, and each
   round replaces the pointer by that of the call pointed to, so a chain of a thousand calls takes ten rounds. What is
   left are calls that need several; they are freed in rounds, one for each level of such calls above each other. Calls
   in or behind a cycle get no level. Ordering by (level, turn, id) is topological.
3. Arguments are parsed once, as a variant, and checked against the tool's schema: known tool, object, required
   parameters, types, no unknown parameter. A number counts as an integer if its value is whole, however it is written
   (5, 5.0, 1e2) and however large it is.
4. The canonical JSON has sorted keys, no spaces, and arguments as parsed; where they don't parse, as the string. Numbers
   lose trailing zeros after the point, and the point with them; those written with an exponent are doubles, in the
   shortest form that reads back as the same double.

Nothing is gathered by conversation, so a very long one makes no task longer. Both sides of the joins on calls are written
down before, so that AQE can split a call that very many others need.

Defined cases: a call without result has a null result; a result without call is dropped. Dependencies on calls that don't
exist are an error of the call and no edge. Null identifiers never link; a call without one has level null and the error
"no order". Null arguments don't parse. Repeated calls are each formatted; they share results and level. Texts of any
length are kept whole. Empty calls give an empty result, whatever the results are. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import durable

#: For each tool, for each parameter: (type, required). Types: string, integer, number, boolean, array, object.
Schemas = dict[str, dict[str, tuple[str, bool]]]

VARIANT_KINDS = {
    "string": r"^STRING$",
    "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": r"^BOOLEAN$",
    "array": r"^ARRAY",
    "object": r"^OBJECT",
}
KEY = ["conv_id", "call_id"]
#: A JSON string, or a number with zeros at the end of its fraction. Possessive, so that long strings take no stack.
POINT_ZERO = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|(?<=[\[{,:])(-?\d++)\.0++(?=[,}\]])'
TRAILING_ZEROS = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|(?<=[\[{,:])(-?\d++\.\d*?[1-9])0++(?=[,}\]])'


def _jumps(single: DataFrame) -> DataFrame:
    """(conv_id, call_id, base, steps): where the chain of calls that need one call each ends for each of them, and how far
    that is. Calls whose chain runs into a cycle have none. `single`: (conv_id, call_id, base, steps = 1)."""
    now, open_ = single, -1
    while True:
        ahead = now.select("conv_id", F.col("call_id").alias("base"), F.col("base").alias("beyond"), F.col("steps").alias("more"))
        joined = now.join(ahead, ["conv_id", "base"], "left")
        waiting = F.col("beyond").isNotNull()
        moved = joined.select(*KEY, F.coalesce("beyond", "base").alias("base"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), waiting.alias("waiting"))
        moved = durable(moved)
        left = moved.where("waiting").count()
        if left in (0, open_):  # none, or only those that go round for ever
            return moved.where("not waiting").select(*KEY, "base", "steps")
        now, open_ = moved.drop("waiting"), left


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the distinct calls that have one. Edges (conv_id, call_id, needs) join existing calls."""
    edges = durable(edges.distinct())
    needing = edges.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("needs").alias("base"))
    needing = durable(needing)
    found = durable(calls.select(*KEY).distinct().join(needing.select(*KEY), KEY, "left_anti").withColumn("level", F.lit(0).cast("long")))
    chained = needing.where("n = 1").select(*KEY, "base", F.lit(1).cast("long").alias("steps"))
    ends = _jumps(durable(chained))

    # Calls that need several: each need is replaced by the end of its chain. A need on a chain without end never comes.
    several = edges.join(needing.where("n > 1").select(*KEY), KEY, "left_semi").withColumnRenamed("needs", "need")
    of_need = ends.select("conv_id", F.col("call_id").alias("need"), "base", "steps")
    endless = chained.join(ends.select(*KEY), KEY, "left_anti").select("conv_id", F.col("call_id").alias("need"), F.lit(True).alias("endless"))
    left = several.join(of_need, ["conv_id", "need"], "left").join(endless, ["conv_id", "need"], "left")
    left = left.select(*KEY, F.when(F.col("endless"), F.col("call_id")).otherwise(F.coalesce("base", "need")).alias("base"), F.coalesce("steps", F.lit(0).cast("long")).alias("steps"))
    left, reached, free = durable(left), None, found
    while not left.isEmpty():
        met = left.join(free.select("conv_id", F.col("call_id").alias("base"), "level"), ["conv_id", "base"]).select(*KEY, (F.col("level") + F.col("steps") + 1).alias("level"))
        reached = durable((met if reached is None else reached.unionByName(met)).groupBy(*KEY).agg(F.max("level").alias("level")))
        left = durable(left.join(free.select("conv_id", F.col("call_id").alias("base")), ["conv_id", "base"], "left_anti").select(*KEY, "base", "steps"))
        free = durable(reached.join(left.select(*KEY).distinct(), KEY, "left_anti"))
        if free.isEmpty():
            break  # what waits is in or behind a cycle
        found = durable(found.unionByName(free))
        reached = reached.join(free.select(*KEY), KEY, "left_anti")
    below = found.select("conv_id", F.col("call_id").alias("base"), "level")
    return found.unionByName(ends.join(below, ["conv_id", "base"]).select(*KEY, (F.col("level") + F.col("steps")).alias("level")))


def _fits(value: Column, wanted: str) -> Column:
    """Whether a variant has the type that a schema wants."""
    kind = F.schema_of_variant(value)
    if wanted != "integer":
        return kind.rlike(VARIANT_KINDS[wanted])
    number = F.try_variant_get(value, "$", "double")
    return kind.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$") | (kind.rlike(VARIANT_KINDS["number"]) & F.coalesce(number == F.floor(number), F.lit(False)))


def canonical(variant: Column) -> Column:
    """JSON text of a variant: keys are sorted and there are no spaces, as to_json has it; numbers without useless zeros."""
    text = F.concat(F.lit("["), F.to_json(variant), F.lit("]"))
    text = F.regexp_replace(F.regexp_replace(text, POINT_ZERO, "$1$2"), TRAILING_ZEROS, "$1$2")
    return F.substring(text, 2, F.length(text) - 2)


def problems(name: Column, parsed: Column, schemas: Schemas) -> Column:
    """Array of what is wrong with the arguments, in a fixed order."""
    kind = F.schema_of_variant(parsed)
    out = F.when(name.isNull() | ~name.isin(*schemas), F.array(F.lit("unknown tool")))
    for tool, parameters in schemas.items():
        faults = []
        for parameter, (wanted, required) in sorted(parameters.items()):
            value = F.try_variant_get(parsed, f"$['{parameter}']", "variant")
            if required:
                faults.append(F.when(value.isNull(), F.lit(f"missing {parameter}")))
            faults.append(F.when(value.isNotNull() & ~_fits(value, wanted), F.lit(f"{parameter} is not {wanted}")))
        given = F.map_keys(F.try_variant_get(parsed, "$", "map<string,variant>"))
        extra = F.array_sort(F.array_except(given, F.array(*map(F.lit, parameters))))
        wrong = F.concat(F.filter(F.array(*faults), lambda x: x.isNotNull()), F.transform(extra, lambda x: F.concat(F.lit("unknown "), x)))
        out = out.when(name == tool, F.when(parsed.isNull() | ~kind.rlike("^OBJECT"), F.array(F.lit("arguments are not an object"))).otherwise(wrong))
    return out


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """(conv_id, call_id, turn, level, name, valid, errors, result_turn, json).

    calls: conv_id, call_id, turn, name, arguments (JSON text), needs (array of call ids, may be null).
    results: conv_id, call_id, turn, content."""
    key = KEY
    calls = calls.select(*key, "turn", "name", "arguments", "needs")
    answers = results.where(F.col("call_id").isNotNull()).groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("answer"))
    known = calls.where(F.col("call_id").isNotNull()).select(*key).distinct()
    wanted = calls.where(F.col("call_id").isNotNull()).select(*key, F.explode("needs").alias("needs"))
    edges = wanted.join(known.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_semi").select(*key, "needs")
    dangling = wanted.join(known.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_anti").select(*key).distinct().withColumn("dangling", F.lit(True))

    parsed = calls.withColumn("parsed", F.try_parse_json("arguments"))
    joined = parsed.join(answers, key, "left").join(levels(calls, edges), key, "left").join(dangling, key, "left")
    errors = F.concat(problems(F.col("name"), F.col("parsed"), schemas), F.when(F.col("dangling"), F.array(F.lit("unknown dependency"))).otherwise(F.array().cast("array<string>")))
    errors = F.concat(errors, F.when(F.col("level").isNull(), F.array(F.lit("no order"))).otherwise(F.array().cast("array<string>")))
    out = joined.withColumn("errors", errors)
    text = lambda c: F.coalesce(F.to_json(F.to_variant_object(F.array(c))), F.lit("[null]"))
    quoted = lambda c: F.substring(text(c), 2, F.length(text(c)) - 2)
    arguments = F.coalesce(canonical(F.col("parsed")), quoted(F.col("arguments")))
    result = F.when(F.col("answer").isNull(), "null").otherwise(F.concat(F.lit('{"content":'), quoted(F.col("answer.content")), F.lit(',"turn":'), F.coalesce(F.col("answer.turn").cast("string"), F.lit("null")), F.lit("}")))
    json = F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("name")), F.lit(',"result":'), result, F.lit("}"))
    return out.select(
        *key,
        "turn",
        "level",
        "name",
        (F.size("errors") == 0).alias("valid"),
        F.array_join("errors", "; ").alias("errors"),
        F.col("answer.turn").alias("result_turn"),
        json.alias("json"),
    )


# --- the registered query: tool traffic laid over conversations ------------------------------------------------------

SCHEMAS: Schemas = {
    "lookup": {"limit": ("integer", True), "query": ("string", True)},
    "search": {"limit": ("integer", False), "query": ("string", True)},
    "summarize": {"query": ("string", True), "style": ("string", True)},
}


def overlay(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from plain conversations: a user's turn asks one of three tools, the next turn of the assistant
    answers it. What calls need, and what their arguments hold, depends on the conversation's number: chains, a chain
    through the whole conversation, calls that don't exist, a cycle, several needs at once, arguments that are cut off,
    numbers of all kinds, wrong types and unknown names."""
    turn, conv = F.col("turn"), F.pmod(F.col("conv_id"), F.lit(8))
    nth = F.pmod(F.floor(turn / 2), F.lit(4))
    call_id = lambda t: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    name = F.element_at(F.array(F.lit("lookup"), F.lit("search"), F.lit("summarize")), (F.pmod(turn, F.lit(3)) + 1).cast("int"))
    query = F.to_json(F.to_variant_object(F.array("text")))
    query = F.substring(query, 2, F.length(query) - 2)
    number = F.when(conv == 6, F.element_at(F.array(*map(F.lit, ("2.50", "1e2", "99999999999999999999", "5.0"))), (nth + 1).cast("int"))).otherwise(F.length("text").cast("string"))
    limit = F.when(F.pmod(turn, F.lit(5)) == 3, F.lit('"ten"')).otherwise(number)
    asked = F.concat(F.lit('{"query": '), query, F.lit(', "limit": '), limit, F.lit("}"))
    asked = F.when((conv == 5) & (nth == 1), F.substring(asked, 1, 20)).otherwise(asked)
    rows = conversations.select("conv_id", turn.cast("long").alias("turn"), "role", "text")
    needs = (
        F.when(conv == 1, F.when(turn >= 2, F.array(call_id(turn - 2))))
        .when((conv == 2) & (nth == 1), F.array(F.lit("nowhere")))
        .when((conv == 3) & nth.isin(1, 2), F.array(F.when(nth == 1, call_id(turn + 2)).otherwise(call_id(turn - 2))))
        .when(conv == 4, F.when(nth == 3, F.array(call_id(turn - 4), call_id(turn - 2))))
        .when(nth != 0, F.array(call_id(turn - 2)))
    )
    calls = rows.where("role = 'user'").select("conv_id", call_id(turn).alias("call_id"), "turn", name.alias("name"), asked.alias("arguments"), needs.alias("needs"))
    results = rows.where("role = 'assistant'").select("conv_id", call_id(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def format_conversations(conversations: DataFrame) -> DataFrame:
    calls, results = overlay(conversations)
    return link(calls, results, SCHEMAS)


ORACLE = """
with recursive asked as (
    select conv_id, turn, text, conv_id % 8 as kind, (turn // 2) % 4 as nth, 'c' || conv_id || '-' || turn as call_id,
           case turn % 3 when 0 then 'lookup' when 1 then 'search' else 'summarize' end as name,
           case when turn % 5 = 3 then '"ten"' when conv_id % 8 <> 6 then cast(length(text) as varchar)
                else ['2.50', '1e2', '99999999999999999999', '5.0'][1 + (turn // 2) % 4] end as lim
    from conversations where role = 'user'
), wanted as (
    select conv_id, turn, unnest(case
        when kind = 1 then case when turn >= 2 then [turn - 2] end
        when kind = 2 and nth = 1 then [-1]
        when kind = 3 and nth in (1, 2) then case nth when 1 then [turn + 2] else [turn - 2] end
        when kind = 4 then case when nth = 3 then [turn - 4, turn - 2] end
        when nth <> 0 then [turn - 2] end) as needs
    from asked
), edges as (
    select w.* from wanted w join asked d on d.conv_id = w.conv_id and d.turn = w.needs
), dangling as (
    select distinct conv_id, turn from wanted w where not exists (select 1 from edges e where e.conv_id = w.conv_id and e.turn = w.turn and e.needs = w.needs)
), stuck as (
    select a.conv_id, a.turn from edges a join edges b on b.conv_id = a.conv_id and b.turn = a.needs and b.needs = a.turn
    union
    select e.conv_id, e.turn from stuck s join edges e on e.conv_id = s.conv_id and e.needs = s.turn
), steps as (
    select conv_id, turn, 0::bigint as level from asked
    union
    select e.conv_id, e.turn, s.level + 1 from steps s join edges e on e.conv_id = s.conv_id and e.needs = s.turn
    where not exists (select 1 from stuck x where x.conv_id = e.conv_id and x.turn = e.turn)
), lv as (
    select conv_id, turn, max(level) as level from steps s
    where not exists (select 1 from stuck x where x.conv_id = s.conv_id and x.turn = s.turn) group by all
), answers as (
    select conv_id, turn as result_turn, turn - 1 as turn, text as content from conversations where role = 'assistant'
), checked as (
    select c.*, lv.level, a.result_turn, a.content, kind = 5 and nth = 1 as cut,
           concat_ws('; ',
             case when cut then 'arguments are not an object' end,
             case when not cut and c.name <> 'summarize' and (c.lim = '"ten"' or c.lim = '2.50') then 'limit is not integer' end,
             case when not cut and c.name = 'summarize' then 'missing style' end,
             case when not cut and c.name = 'summarize' then 'unknown limit' end,
             case when d.turn is not null then 'unknown dependency' end,
             case when lv.level is null then 'no order' end) as errors
    from asked c left join lv using (conv_id, turn) left join answers a using (conv_id, turn) left join dangling d using (conv_id, turn)
)
select conv_id, call_id, turn, level, name, errors = '' as valid, errors, result_turn,
       '{"arguments":'
         || case when cut then cast(to_json(substr('{"query": ' || cast(to_json(text) as varchar) || ', "limit": ' || lim || '}', 1, 20)) as varchar)
            else '{"limit":' || case lim when '2.50' then '2.5' when '1e2' then '100' when '5.0' then '5' else lim end || ',"query":' || cast(to_json(text) as varchar) || '}' end
         || ',"id":"' || call_id || '","name":"' || name || '","result":'
         || case when result_turn is null then 'null' else '{"content":' || cast(to_json(content) as varchar) || ',"turn":' || result_turn || '}' end || '}' as json
from checked
"""

"""What of a conversation is audited: the last answer and the tool text of the current turn. Rows are ``(conv_id, turn, role, text)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.functions.normalise import let

#: Characters of tool text; lines with a URL stay beyond it.
TOOL_BUDGET = 48 * 1024


def last_assistant(turns: DataFrame) -> DataFrame:
    """A row per conversation with an answer that isn't blank: the last answer."""
    own = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    return own.select("conv_id", F.trim("text").alias("text")).where("text <> ''")


def current_turn(turns: DataFrame) -> DataFrame:
    """Rows after the last row of the user; all rows if there is none."""
    anchor = turns.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("anchor"))
    return turns.join(anchor, "conv_id", "left").where("anchor is null or turn > anchor").select(*turns.columns)


def clamp_tool_text(text: Column, budget: int = TOOL_BUDGET) -> Column:
    """Within the budget as it is; else all lines with a URL and then, in order, the others that still fit."""
    lines = F.split(text, "\n")
    has_url = lambda x: x.rlike("(?i)https?://")
    urls = F.filter(lines, has_url)
    used = F.aggregate(urls, F.lit(0), lambda a, x: a + F.length(x) + 1)
    start = F.struct(urls.alias("kept"), used.alias("used"))

    def step(state: Column, line: Column) -> Column:
        fits = state["used"] + F.length(line) + 1 <= budget
        return F.struct(F.when(fits, F.array_append(state["kept"], line)).otherwise(state["kept"]).alias("kept"), (state["used"] + F.when(fits, F.length(line) + 1).otherwise(0)).alias("used"))

    folded = F.aggregate(F.filter(lines, lambda x: ~has_url(x)), start, step, lambda s: F.array_join(s["kept"], "\n"))
    return F.when(F.length(text) <= budget, text).otherwise(folded)


def audit_input(turns: DataFrame) -> DataFrame:
    """A row per conversation with an answer: the answer, and the other texts of the current turn after a blank line."""
    tools = current_turn(turns).where("role not in ('assistant', 'user')").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("rows"))
    tools = tools.select("conv_id", clamp_tool_text(F.trim(F.array_join(F.transform("rows", lambda r: r["text"]), "\n"))).alias("tools"))
    joined = last_assistant(turns).join(tools, "conv_id", "left")
    return joined.select("conv_id", F.when(F.coalesce("tools", F.lit("")) == "", F.col("text")).otherwise(F.concat("text", F.lit("\n\n"), "tools")).alias("text"))


def pick_session(sessions: DataFrame) -> DataFrame:
    """One session per list: the scope's own, else the current one, else the first that another source holds, else the first. Rows are ``(list_id, pos, session_id, is_scope, is_current, held_by_other)``."""
    rank = F.when(F.col("is_scope"), 0).when(F.col("is_current"), 1).when(F.col("held_by_other"), 2).otherwise(3)
    return sessions.groupBy("list_id").agg(F.min_by("session_id", F.struct(rank, "pos")).alias("session_id"))


def triggers(texts: DataFrame, wait_ms: int = 800) -> DataFrame:
    """Texts of a session that are audited: no other follows within the wait, and it isn't the one audited before. Rows are ``(session_id, ts, text)``."""
    order = Window.partitionBy("session_id").orderBy("ts", "text")
    rested = texts.withColumn("next", F.lead("ts").over(order)).where(F.col("next").isNull() | (F.unix_micros(F.col("next").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) >= wait_ms * 1000)).drop("next")
    return rested.withColumn("before", F.lag("text").over(order)).where("before is null or before <> text").drop("before")


def first_filled(*arrays: Column) -> Column:
    """The first of the arrays that has elements: blocks, or nodes, of a record that may keep them in several places; null if all are empty."""
    return F.coalesce(*(F.when(F.size(a) > 0, a) for a in arrays))


def interrupted(status: Column, final: Column, own: Column) -> Column:
    """Whether a node is no settled answer: interrupted or running by its status, or marked so in its final record or itself."""
    return F.coalesce(status.isin("interrupted", "running"), F.lit(False)) | F.coalesce(final, F.lit(False)) | F.coalesce(own, F.lit(False))


def settled(running: Column, part: Column) -> Column:
    """Whether nothing is being written: not running, and no part of an answer is held."""
    return ~F.coalesce(running, F.lit(False)) & part.isNull()


def visits(texts: DataFrame) -> DataFrame:
    """Rows ``(viewer, ts, session_id, text)`` with ``visit``, the number of times the viewer has changed the session so far; what was audited before counts within a visit only."""
    order = Window.partitionBy("viewer").orderBy("ts", "session_id")
    changed = (~F.col("session_id").eqNullSafe(F.lag("session_id").over(order))).cast("int")
    return texts.withColumn("changed", changed).withColumn("visit", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("changed")


#: How deep the text of a content block, and calls within calls, are followed.
BLOCK_DEPTH, CALL_DEPTH = 4, 8
#: Fields of a block that may hold further blocks, in order.
INNER = ["content", "blocks", "result", "results", "data"]


def _part(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _string(v: Column) -> Column:
    """A variant that is a string; null for all others."""
    return F.when(F.schema_of_variant(v) == "STRING", _part(v, "$", "string"))


def _block_text(block: Column, depth: int, most: int) -> Column:
    """The text of a content block; the texts of a list by lines, else of the first field of those that hold blocks; empty if there is none."""
    if depth > most:
        return F.lit("")
    items = _part(block, "$", "array<variant>")
    children = F.when(items.isNotNull(), items).otherwise(F.array(*(_part(block, f"$.{k}") for k in INNER)))
    inner = F.filter(F.transform(children, lambda c: _block_text(c, depth + 1, most)), lambda t: t != "")
    found = let(inner, lambda ts: F.when(items.isNotNull(), F.array_join(ts, "\n")).otherwise(F.coalesce(F.get(ts, F.lit(0)), F.lit(""))))
    return F.when(block.isNull(), "").otherwise(F.coalesce(F.nullif(_string(_part(block, "$.text")), F.lit("")), found))


def _all_calls(root: Column, most: int) -> Column:
    """A call and those it made, and so on, as an array of ``path`` and ``v``; a call's path begins with that of the one it was made by."""
    kind = "array<struct<path:string,v:variant>>"

    def below(calls: Column) -> Column:
        subs = lambda x: F.coalesce(_part(x["v"], "$.subCalls", "array<variant>"), F.array().cast("array<variant>"))
        made = lambda x: F.transform(subs(x), lambda v, k: F.struct(F.concat(x["path"], F.lpad(k.cast("string"), 10, "0")).alias("path"), v.alias("v")))
        return F.flatten(F.transform(calls, made)).cast(kind)

    def grown(calls: Column, depth: int) -> Column:
        return calls if depth > most else let(below(calls), lambda more: F.concat(calls, grown(more, depth + 1)))

    return grown(F.array(F.struct(F.lit("").alias("path"), root.alias("v"))).cast(kind), 1)


def _call_lines(call: Column, blocks: int) -> Column:
    """Arguments of a web tool and the text of its result, as an array of lines."""

    def field(name: str) -> Column:
        head = _part(call, f"$.call.{name}")
        return _string(F.when(head.isNotNull() & ~F.is_variant_null(head), head).otherwise(_part(call, f"$.{name}")))

    head = let(F.struct(field("name").alias("name"), field("argsRaw").alias("args")), lambda h: F.when(F.lower(h["name"]).contains("web") & (h["args"] != ""), F.concat(h["name"], F.lit(" "), h["args"])))
    return F.array_compact(F.array(head, F.nullif(_block_text(_part(call, "$.content"), 0, blocks), F.lit(""))))


def tool_text(node: Column, call_depth: int = CALL_DEPTH, block_depth: int = BLOCK_DEPTH) -> Column:
    """Text of a tool's node, given as JSON; empty for a null or for what is no JSON object (a key that is repeated in an object is no JSON here).

    A walk over variants in the JVM: all calls by level, put in the order of their paths, and the text of each.
    """
    by_path = lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0)
    calls = let(F.try_parse_json(node), lambda v: F.array_sort(_all_calls(v, call_depth), by_path))
    return F.coalesce(F.array_join(F.flatten(F.transform(calls, lambda x: _call_lines(x["v"], block_depth))), "\n"), F.lit(""))

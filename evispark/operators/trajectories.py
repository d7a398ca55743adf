"""Runs of an agent: its calls and what they returned, against what a case expects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.functions.encoding import json_array, json_object, json_text
from evispark.functions.text import content_words
from evispark.operators.evaluation import rate

#: Identities as an agent must write them; the tool whose calls ask for a type; the share of words that reports a result.
LOWER_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
SYNTHESIS_TOOL, REPORTED = "generate_new_syntheses", 0.6
#: Kinds of messages that a key is made of, with what each shows.
KINDS = {"prompt": ("content",), "text": ("content",), "call": ("tool_name", "args"), "return": ("tool_name", "content")}


def canonical_messages(messages: DataFrame) -> DataFrame:
    """(case_id, messages): the messages of a run as one JSON text: only known kinds with what belongs to them, in order."""
    part = F.lit(None).cast("string")
    for kind, names in KINDS.items():
        part = F.when(F.col("kind") == kind, json_object({"kind": json_text(F.lit(kind)), **{c: json_text(F.coalesce(c, F.lit(""))) for c in names}})).otherwise(part)
    rows = messages.withColumn("part", part).filter("part is not null").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("position", "part"))).alias("parts"))
    return rows.select("case_id", json_array(F.col("parts.part")).alias("messages"))


def tool_results(messages: DataFrame) -> DataFrame:
    """(case_id, position, ids, titles, texts) of each returned message: the identities in its content, and titles and texts of its items (title, text)."""
    ids = F.array_sort(F.array_distinct(F.regexp_extract_all("content", F.lit(f"({LOWER_UUID})"), F.lit(1))))
    some = lambda c: F.filter(F.transform(F.coalesce("items", F.array().cast("array<struct<title:string,text:string>>")), lambda x: x[c]), lambda x: x.isNotNull() & (x != ""))
    return messages.filter("kind = 'return'").select("case_id", "position", F.coalesce(ids, F.array().cast("array<string>")).alias("ids"), F.array_distinct(some("title")).alias("titles"), some("text").alias("texts"))


def tool_calls(messages: DataFrame) -> DataFrame:
    """(case_id, position, name, ids, synthesis_type) of each call, in order; ids are those it was given."""
    none = F.array().cast("array<string>")
    return messages.filter("kind = 'call'").select("case_id", "position", F.col("tool_name").alias("name"), F.concat(F.coalesce("claim_ids", none), F.coalesce("synthesis_ids", none)).alias("ids"), "synthesis_type")


def invented_ids(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(case_id, position, id): identities given to a call that no earlier result of its case holds."""
    given = calls.select("case_id", "position", F.explode("ids").alias("id"))
    first = results.select("case_id", F.explode("ids").alias("id"), "position").groupBy("case_id", "id").agg(F.min("position").alias("seen"))
    rows = given.join(first, ["case_id", "id"], "left")
    return rows.filter("seen is null or seen >= position").select("case_id", "position", "id")


def reports_results(results: DataFrame, outputs: DataFrame) -> DataFrame:
    """(case_id, reports): whether an output (case_id, output) tells a result: an identity or a title of it, or most content words of a text. True where nothing was returned."""
    words = content_words("output")
    rows = outputs.select("case_id", F.coalesce("output", F.lit("")).alias("output")).withColumn("words", words).withColumn("low", F.lower("output")).withColumn("named", F.regexp_extract_all("output", F.lit(f"({LOWER_UUID})"), F.lit(1)))
    r = results.join(rows, "case_id")
    told = lambda t: (F.size(content_words(t)) > 0) & (F.size(F.array_intersect(content_words(t), F.col("words"))) >= REPORTED * F.size(content_words(t)))
    hit = F.arrays_overlap("ids", "named") | F.exists("titles", lambda t: F.col("low").contains(F.lower(t))) | F.exists("texts", told)
    per = r.groupBy("case_id").agg(F.max(F.coalesce(hit, F.lit(False))).alias("hit"), F.max(F.size("ids") > 0).alias("any"))
    return rows.join(per, "case_id", "left").select("case_id", F.coalesce(F.col("hit") | ~F.col("any"), F.lit(True)).alias("reports"))


def trajectory_cases(cases: DataFrame, messages: DataFrame, outputs: DataFrame) -> DataFrame:
    """(case_id, n_tool_calls, checks, failed, passed, invented, reports) of each case, against its own expectations.

    ``cases`` is (case_id, must_call, must_not_call, order, synthesis_type, max_tool_calls). ``checks`` is a map of the check's name; an order (a, b) holds if
    the first a comes before the first b or b never comes.
    """
    calls, results = tool_calls(messages), tool_results(messages)
    per = calls.groupBy("case_id").agg(F.count("*").alias("n_tool_calls"), F.array_sort(F.collect_list(F.struct("position", "name"))).alias("seq"), F.collect_list(F.when(F.col("name") == SYNTHESIS_TOOL, F.struct(F.coalesce("synthesis_type", F.lit("")).alias("t")))).alias("types"))
    made_up = invented_ids(calls, results).groupBy("case_id").agg(F.count("*").alias("invented"))
    rows = cases.join(per, "case_id", "left").join(made_up, "case_id", "left").join(reports_results(results, outputs), "case_id", "left").na.fill(0, ["n_tool_calls", "invented"])
    none = F.array().cast("array<string>")
    names = F.coalesce(F.col("seq.name"), none)
    at = lambda name: F.array_position(names, name)
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    must = F.transform(F.coalesce("must_call", none), lambda x: entry(F.concat(F.lit("calls "), x), at(x) > 0))
    never = F.transform(F.coalesce("must_not_call", none), lambda x: entry(F.concat(F.lit("does not call "), x), at(x) == 0))
    order = F.transform(F.coalesce("order", F.array().cast("array<array<string>>")), lambda x: entry(F.concat(x[0], F.lit(" before "), x[1]), (at(x[1]) == 0) | ((at(x[0]) > 0) & (at(x[0]) < at(x[1])))))
    typed = F.when(F.col("synthesis_type").isNotNull(), F.array(entry(F.concat(F.lit("synthesis_type "), F.col("synthesis_type")), F.coalesce(F.forall("types", lambda x: x["t"] == F.col("synthesis_type")), F.lit(True))))).otherwise(F.array().cast("array<struct<key:string,value:boolean>>"))
    every = F.array(entry(F.concat(F.lit("at most "), F.col("max_tool_calls").cast("string"), F.lit(" tool calls")), F.col("n_tool_calls") <= F.col("max_tool_calls")), entry(F.lit("no invented ids"), F.col("invented") == 0))
    rows = rows.withColumn("checks", F.concat(must, never, order, typed, every))
    failed = F.array_sort(F.transform(F.filter("checks", lambda x: ~x["value"]), lambda x: x["key"]))
    return rows.select("case_id", "n_tool_calls", "invented", F.coalesce("reports", F.lit(True)).alias("reports"), F.size("checks").alias("n_checks"), failed.alias("failed"), (F.size(failed) == 0).alias("passed"))


def agent_summary(cases: DataFrame) -> DataFrame:
    """One row: cases, the rates of passed cases and checks, of cases with invented ids and of answers that report results, mean calls."""
    rows, n = F.count("*"), lambda c: F.sum(c.cast("bigint"))
    checks = F.sum("n_checks")
    return cases.agg(rows.alias("cases"), rate(n(F.col("passed")), rows).alias("pass_rate"), rate(checks - F.sum(F.size("failed")), checks).alias("check_pass_rate"), rate(n(F.col("invented") > 0), rows).alias("invented_id_rate"), rate(n(F.col("reports")), rows).alias("reports_rate"), F.round(F.avg("n_tool_calls"), 3).alias("tool_calls_mean"))


def failed_checks(cases: DataFrame) -> DataFrame:
    """(check, n): how many cases fail each check."""
    return cases.select(F.explode("failed").alias("check")).groupBy("check").agg(F.count("*").alias("n"))


def called(column: Column) -> Column:
    """(tool, args) of calls as ``tool(args)``."""
    return F.transform(column, lambda x: F.concat(x["name"], F.lit("("), F.coalesce(x["args"], F.lit("")), F.lit(")")))

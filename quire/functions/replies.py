"""Requests and replies of a chat completion service as Column expressions over JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as X


def error_summary(body: Column) -> Column:
    """error.message, else message, else the first 300 characters."""
    return F.coalesce(F.get_json_object(body, "$.error.message"), F.get_json_object(body, "$.message"), F.left(body, F.lit(300)))


def completion_text(body: Column) -> Column:
    """The first choice's text: a string, or an array of parts joined; null where the reply is an error or empty."""
    content = F.get_json_object(body, "$.choices[0].message.content")
    parts = F.from_json(content, "array<struct<text:string>>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    text = F.coalesce(F.when(content.startswith("[{"), joined).otherwise(content), F.get_json_object(body, "$.choices[0].text"))
    return F.when(F.get_json_object(body, "$.error.message").isNull() & (F.length(X.strip(text)) > 0), text)


def total_tokens(body: Column) -> Column:
    return F.get_json_object(body, "$.usage.total_tokens").cast("long")


def segments(body: Column) -> Column:
    """Map of position to text of a reply's segments: an array, or an object that holds one; last of equal positions wins."""
    bare = X.strip_code_fence(body)
    array = F.when(bare.startswith("["), bare).otherwise(F.get_json_object(bare, "$.segments"))
    rows = F.from_json(array, "array<struct<i:int,index:int,t:string,text:string>>")
    pairs = F.filter(F.transform(rows, lambda r: F.struct(F.coalesce(r["i"], r["index"]).alias("i"), F.coalesce(r["t"], r["text"]).alias("t"))), lambda r: r["i"].isNotNull() & r["t"].isNotNull())
    last = F.aggregate(pairs, F.array().cast("array<struct<i:int,t:string>>"), lambda a, p: F.concat(F.filter(a, lambda q: q["i"] != p["i"]), F.array(p)))
    return F.map_from_entries(last)


def user_prompt(units: Column) -> Column:
    """units: array of struct(i, t) -> the request's JSON."""
    return F.to_json(F.struct(units.alias("segments")))


def system_prompt(base: Column, terms: Column) -> Column:
    return F.when(F.length(F.coalesce(terms, F.lit(""))) == 0, base).otherwise(F.concat(base, F.lit("\n\n"), terms))

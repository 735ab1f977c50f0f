"""Requests and responses as JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fathomline.schemas import REQUEST


def request(text: Column) -> Column:
    """A request's struct; null for what isn't one: a query needs k, query and filters, an edit a filepath."""
    r = F.from_json(text, REQUEST)
    p = r["payload"]
    query = (r["message_type"] == "query") & p["query"].isNotNull() & (p["k"] >= 0) & p["filters"].isNotNull()
    return F.when(query | ((r["message_type"] == "edit") & p["filepath"].isNotNull()), r)


def parse_request(spark: SparkSession, text: str) -> Row:
    r = spark.createDataFrame([(text,)], "t string").select(request(F.col("t")).alias("r")).head()["r"]
    if r is None:
        raise ValueError("not a request")
    return r


def item(filepath: Column, subset: Column) -> Column:
    """One result as JSON: the path, and the subset as a pair of numbers."""
    return F.to_json(F.struct(filepath.alias("filepath"), F.array(subset["start"], subset["end"]).alias("subset")))


def response(found: DataFrame) -> str:
    """The answer of a search: its k rows in order."""
    rows = found.select(item(F.col("filepath"), F.col("subset")).alias("r")).collect()  # k rows
    return json.dumps({"results": [json.loads(r["r"]) for r in rows]}, ensure_ascii=False)

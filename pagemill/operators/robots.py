"""robots.txt as relations: a row per rule, the longest matching pattern decides."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions import expressions as E
from pagemill.functions import robots


RULE = T.StructType([T.StructField("allow", T.BooleanType()), T.StructField("length", T.IntegerType()), T.StructField("parts", T.ArrayType(T.StringType())), T.StructField("anchored", T.BooleanType())])


@F.arrow_udf(T.StructType([T.StructField("rules", T.ArrayType(RULE)), T.StructField("delay", T.DoubleType()), T.StructField("sitemaps", T.ArrayType(T.StringType()))]))
def parse_robots(body: pa.Array) -> pa.Array:
    out = []
    for text in body.to_pylist():
        r = robots.parse(text)
        rules = [(a, len(p), *robots.pieces(p)) for a, p in r.rules]
        out.append({"rules": [dict(zip(("allow", "length", "parts", "anchored"), rule)) for rule in rules], "delay": r.delay, "sitemaps": r.sitemaps})
    rule = pa.struct([("allow", pa.bool_()), ("length", pa.int32()), ("parts", pa.list_(pa.string())), ("anchored", pa.bool_())])
    return pa.array(out, pa.struct([("rules", pa.list_(rule)), ("delay", pa.float64()), ("sitemaps", pa.list_(pa.string()))]))


def _fits(path: Column, rule: Column) -> Column:
    """functions.robots.matches as an expression: a fold over the pieces, whose state is the place after the last one (1
    is the start), or 0 once a piece is missing. Linear in the path, whatever the pattern."""
    parts, last = rule["parts"], F.element_at(rule["parts"], -1)
    many = F.size(parts) > 1

    def step(at: Column, part: Column) -> Column:
        found = F.position(part, path, at)
        return F.when(part == "", at).when((at > 0) & (found > 0), found + F.length(part)).otherwise(F.lit(0))

    inner = F.slice(parts, F.lit(2), F.size(parts) - 1 - (rule["anchored"] & many).cast("int"))
    start = F.when(F.startswith(path, parts[0]), F.length(parts[0]) + 1).otherwise(F.lit(0))
    at = F.aggregate(inner, start, step)
    tail = F.when(many, F.endswith(path, last) & (F.length(path) - at + 1 >= F.length(last))).otherwise(at == F.length(path) + 1)
    return (at > 0) & (~rule["anchored"] | tail)


def parsed(bodies: DataFrame) -> DataFrame:
    """(origin, body) -> (origin, rules, delay, sitemaps), a row per origin; a null body restricts nothing."""
    return bodies.withColumn("_r", parse_robots("body")).select("origin", "_r.rules", "_r.delay", "_r.sitemaps")


def path_of(url: Column) -> Column:
    """What rules are matched against: path and query."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))


def allowed(urls: DataFrame, robots_table: DataFrame, url: str = "url") -> DataFrame:
    """Adds allowed. An origin's rules arrive as one array through an equi-join on the origin, so a row never meets
    other origins' rules; an origin without a row allows everything."""
    keyed = urls.withColumn("_origin", E.url_origin(F.col(url)))
    met = keyed.join(robots_table.select(F.col("origin").alias("_origin"), "rules"), "_origin", "left")
    path = path_of(F.col(url))
    none = F.array().cast("array<struct<allow:boolean,length:int,parts:array<string>,anchored:boolean>>")
    hits = F.filter(F.coalesce("rules", none), lambda r: _fits(path, r))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["length"].alias("n"), r["allow"].alias("allow"))))
    return met.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("_origin", "rules")


def schedule(requests: DataFrame, origin: str, at: str, order: list[str], delay_us: int | Column) -> DataFrame:
    """Adds start_us: when each request goes out if an origin's requests are delay_us apart at least.

    at holds arrival in microseconds. start = max(arrival, previous start + delay), by a running maximum.
    """
    w = Window.partitionBy(origin).orderBy(at, *order)
    delay = F.lit(delay_us) if isinstance(delay_us, int) else delay_us
    numbered = requests.withColumn("_n", F.row_number().over(w).cast("long"))
    run = F.max(F.col(at) - delay * F.col("_n")).over(Window.partitionBy(origin).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("start_us", run + delay * F.col("_n")).drop("_n")

"""Record checks: errors and warnings as arrays, uniqueness over the whole table.

Records carry what an answer held, with types told by ``context_is_string``-like flags left to
VARIANT: ``data`` is a VARIANT object, ``chunk_id`` the chunk's own id, ``pos`` the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..values import CYRILLIC, GRANULARITIES, MAX_CONTEXT, MAX_METRICS, MESSAGES


def _type(v: Column) -> Column:
    return F.schema_of_variant(v)


def _get(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _says(key: str, *args: Column) -> Column:
    """The message with its places filled."""
    pieces = MESSAGES[key].split("{}")
    out = [F.lit(pieces[0])]
    for a, p in zip(args, pieces[1:]):
        out += [a.cast("string"), F.lit(p)]
    return F.concat(*out)


def validate(records: DataFrame, check_uniqueness: bool = True) -> DataFrame:
    """chunk_id, pos, is_valid, errors, warnings. The first of several records with one id is the valid one."""
    d, cid = F.col("data"), F.col("chunk_id")
    nth = F.row_number().over(Window.partitionBy("chunk_id").orderBy("pos")) if check_uniqueness else F.lit(1)
    present = lambda n: _get(d, n).isNotNull() & (_type(_get(d, n)) != "VOID")
    is_list = lambda n: _type(_get(d, n)).startswith("ARRAY")
    is_string = lambda v: _type(v) == "STRING"
    metrics = F.coalesce(_get(d, "metrics", "array<variant>"), F.array().cast("array<variant>"))
    years = F.coalesce(_get(d, "years", "array<variant>"), F.array().cast("array<variant>"))
    text = lambda v: F.try_variant_get(v, "$", "string")
    numbered = lambda arr, f: F.filter(F.transform(arr, f), lambda x: x.isNotNull())
    context = _get(d, "context", "string")
    granularity = _get(d, "time_granularity", "string")
    one = lambda c, m: F.when(c, F.array(m)).otherwise(F.array().cast("array<string>"))
    whole = lambda v: text(v).rlike(r"^\s*[+-]?\d+\s*$") | _type(v).isin("BIGINT", "BOOLEAN") | _type(v).startswith("DECIMAL") | (_type(v) == "DOUBLE")
    errors = F.concat(
        one(F.coalesce(cid, F.lit("")) == "", _says("no_id")),
        one((F.coalesce(cid, F.lit("")) != "") & (F.col("nth") > 1), _says("same_id", cid)),
        one(present("context") & ~is_string(_get(d, "context")), _says("context_type")),
        one(present("metrics") & ~is_list("metrics"), _says("metrics_type")),
        numbered(metrics, lambda v, i: F.when(v.isNull() | ~is_string(v), _says("metric_type", i))),
        one(present("years") & ~is_list("years"), _says("years_type")),
        numbered(years, lambda v, i: F.when(~F.coalesce(whole(v), F.lit(False)), _says("year_type", i))),
    )
    warnings = F.concat(
        one(is_string(_get(d, "context")) & (F.length(context) > MAX_CONTEXT), _says("context_long")),
        one(F.size(metrics) > MAX_METRICS, _says("metrics_many")),
        numbered(metrics, lambda v, i: F.when(is_string(v) & ~text(v).rlike(CYRILLIC), _says("metric_latin", i, text(v)))),
        one(present("geo") & ~is_string(_get(d, "geo")), _says("geo_type")),
        one(present("time_granularity") & ~F.coalesce(granularity.isin(*GRANULARITIES), F.lit(False)), _says("granularity", granularity)),
    )
    none = F.array().cast("array<string>")
    checked = records.withColumn("nth", nth).select("chunk_id", "pos", F.coalesce(errors, none).alias("errors"), F.coalesce(warnings, none).alias("warnings"))
    return checked.select("chunk_id", "pos", (F.size("errors") == 0).alias("is_valid"), "errors", "warnings")


def all_valid(checked: DataFrame) -> DataFrame:
    """One row; an empty batch is valid."""
    return checked.agg(F.coalesce(F.bool_and("is_valid"), F.lit(True)).alias("all_valid"), F.count("*").alias("records"))

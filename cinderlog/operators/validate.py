"""Entry validation on VARIANT values: every entry of every request gets its normal form or the first reason against it.

Of several bad attributes the first key in byte order names the reason (objects are stored in that order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.functions.buckets import at
from cinderlog.functions.numbers import js_texts
from cinderlog.model import FUTURE_MINUTES, LEVELS, MAX_BODY_BYTES, MINUTE

_ISO = r"^\d{4}-\d\d-\d\d([Tt ]\d\d:\d\d(:\d\d([.,]\d{1,9})?)?\s?([Zz]|[+-]\d\d:?\d\d)?)?$"
_NUL = "\x00"
_NUMBERS = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"


def requests(bodies: DataFrame, body: str = "body") -> DataFrame:
    """bodies with the parsed request and the reason why a whole request is refused (null if it isn't).

    Keys that come twice in an object need spark.sql.variant.allowDuplicateKeys, by which the last one counts.
    """
    small = F.octet_length(F.col(body)) <= MAX_BODY_BYTES
    # a body beyond the limit is refused unread
    parsed = bodies.withColumn("request", F.try_parse_json(F.when(small, F.col(body))))
    kind, logs = F.schema_of_variant(F.col("request")), F.try_variant_get(F.col("request"), "$.logs", "variant")
    reason = F.coalesce(
        F.when(~small, F.lit("request body is too large")),
        F.when(F.col("request").isNull(), F.lit("request body is not valid JSON")),
        F.when(~F.startswith(kind, F.lit("OBJECT<")), F.lit("request body must be an object")),
        F.when(logs.isNull(), F.lit("missing required field: logs")),
        F.when(~F.startswith(F.schema_of_variant(logs), F.lit("ARRAY<")), F.lit("logs must be an array")),
        F.when(F.size(F.try_variant_get(F.col("request"), "$.logs", "array<variant>")) == 0, F.lit("logs must not be empty")),
    )
    return parsed.withColumn("refused", reason)


def entries(checked: DataFrame) -> DataFrame:
    """One row for each entry of the requests that aren't refused, with its place (index) and value (entry)."""
    keep = [c for c in checked.columns if c not in ("request", "refused", "body")]
    whole = F.try_variant_get(F.col("request"), "$.logs", "array<variant>")
    return checked.where("refused is null").select(*keep, F.posexplode(whole).alias("index", "entry"))


def _field(name: str) -> Column:
    return F.try_variant_get(F.col("entry"), f"$.{name}", "variant")


def _text(name: str) -> Column:
    return F.try_variant_get(F.col("entry"), f"$.{name}", "string")


def _kind(value: Column) -> Column:
    """The type's name; VOID for null and for what isn't there."""
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _plain_text(name: str) -> Column:
    """Rules of service and message."""
    kind, text = _kind(_field(name)), _text(name)
    return F.coalesce(
        F.when(kind == "VOID", F.lit(f"missing required field: {name}")),
        F.when(kind != "STRING", F.lit(f"{name} must be a string")),
        F.when(F.length(text) == 0, F.lit(f"{name} must be a non-empty string")),
        F.when(F.instr(text, _NUL) > 0, F.lit(f"{name} must not contain null bytes")),
    )


def timestamp_of(text: Column) -> Column:
    """Times in ISO 8601 (UTC where there is no zone), else null; to the millisecond."""
    iso = F.regexp_replace(F.regexp_replace(F.upper(text), ",", "."), r"\s([Z+-])", "$1")
    parsed = F.when(text.rlike(_ISO), F.try_to_timestamp(iso))
    micros = F.unix_micros(parsed)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(1000)))


def validated(found: DataFrame, now: int) -> DataFrame:
    """found (entry, ...) with reason (null: valid) and the normal form in timestamp, level, service, message, attributes."""
    raw_time, level = _text("timestamp"), _text("level")
    time_kind, level_kind = _kind(_field("timestamp")), _kind(_field("level"))
    attrs_kind = _kind(_field("attributes"))
    given = F.map_entries(F.try_variant_get(F.col("entry"), "$.attributes", "map<string,variant>"))

    def described(e: Column) -> Column:
        value = e["value"]
        kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
        number = F.when(kind.rlike(_NUMBERS), F.try_variant_get(value, "$", "double"))
        return F.struct(e["key"].alias("key"), kind.alias("kind"), F.when(kind.isin("STRING", "BOOLEAN"), F.try_variant_get(value, "$", "string")).alias("text"), number.alias("number"))

    listed = F.array_sort(F.transform(F.coalesce(given, F.array()), described), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    known = found.withColumn("attrs", F.when(F.startswith(attrs_kind, F.lit("OBJECT<")), listed))

    def fault(a: Column) -> Column:
        endless = a["number"].isNull() | F.isnan(a["number"]) | (F.abs(a["number"]) == float("inf"))
        return F.coalesce(
            F.when(F.instr(a["key"], _NUL) > 0, F.lit("attribute keys must not contain null bytes")),
            F.when((a["kind"] == "STRING") & (F.instr(a["text"], _NUL) > 0), F.concat(F.lit("attribute '"), a["key"], F.lit("' must not contain null bytes"))),
            F.when(a["kind"].rlike(_NUMBERS) & endless, F.concat(F.lit("attribute '"), a["key"], F.lit("' must be a finite number"))),
            F.when(~a["kind"].isin("STRING", "BOOLEAN") & ~a["kind"].rlike(_NUMBERS), F.concat(F.lit("attribute '"), a["key"], F.lit("' must be a string, number, or boolean"))),
        )

    shown = F.coalesce(level, F.to_json(_field("level")))
    stamp = F.col("stamp")
    reason = F.coalesce(
        F.when(~F.startswith(_kind(F.col("entry")), F.lit("OBJECT<")), F.lit("entry must be an object")),
        F.when(time_kind == "VOID", F.lit("missing required field: timestamp")),
        F.when(time_kind != "STRING", F.lit("timestamp must be an ISO 8601 string")),
        F.when(stamp.isNull(), F.concat(F.lit("invalid timestamp: '"), raw_time, F.lit("'"))),
        F.when(stamp > at(now + FUTURE_MINUTES * MINUTE), F.lit(f"timestamp is more than {FUTURE_MINUTES} minutes in the future")),
        F.when(level_kind == "VOID", F.lit("missing required field: level")),
        F.when((level_kind != "STRING") | ~level.isin(*LEVELS), F.concat(F.lit("invalid level: '"), shown, F.lit(f"', expected one of {', '.join(LEVELS)}"))),
        _plain_text("service"),
        _plain_text("message"),
        F.when((attrs_kind != "VOID") & ~F.startswith(attrs_kind, F.lit("OBJECT<")), F.lit("attributes must be an object")),
        F.get(F.filter(F.transform(F.col("attrs"), fault), lambda x: x.isNotNull()), 0),
    )
    numbers = js_texts(F.transform(F.col("attrs"), lambda a: a["number"]))
    checked = known.withColumn("stamp", F.when(time_kind == "STRING", timestamp_of(raw_time))).withColumn("reason", reason).withColumn("numbers", F.when(F.col("reason").isNull(), numbers))
    pairs = F.transform(F.col("attrs"), lambda a, i: F.struct(a["key"].alias("key"), F.coalesce(a["text"], F.get(F.col("numbers"), i), F.lit("")).alias("value")))
    attributes = F.map_from_entries(F.coalesce(F.when(F.col("reason").isNull(), pairs), F.array().cast("array<struct<key:string,value:string>>")))
    return checked.select(
        *(c for c in found.columns if c != "entry"),
        "reason",
        F.when(F.col("reason").isNull(), stamp).alias("timestamp"),
        level.alias("level"),
        _text("service").alias("service"),
        _text("message").alias("message"),
        attributes.alias("attributes"),
    )


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where("reason is null").drop("reason")


def rejected(checked: DataFrame) -> DataFrame:
    """(..., index, reason) of the entries that aren't stored."""
    return checked.where("reason is not null").drop("timestamp", "level", "service", "message", "attributes")


def answers(checked: DataFrame, by: list[str]) -> DataFrame:
    """For each request: the number accepted, the rejected entries in order, and the status of the answer."""
    out = checked.groupBy(*by).agg(
        F.count_if(F.col("reason").isNull()).alias("accepted"),
        F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("index", "reason")))).alias("rejected"),
    )
    return out.withColumn("status", F.when(F.col("accepted") > 0, F.lit(200)).otherwise(F.lit(400)))



"""Project snapshots from JSON exports, read without stopping at bad ones.

A text that isn't whole JSON, lacks its id, or holds a value of the wrong type becomes an unsupported snapshot with a fault that
says why, beside the fields that could be read. `quarantine` counts the faults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of an export, and the one that it can't do without.
FIELDS = {
    "ProjectId": "bigint",
    "Title": "string",
    "ReadOnly": "boolean",
    "SiteLatitude": "double",
    "SiteLongitude": "double",
    "TimeZoneHours": "double",
    "EastWestFeet": "double",
    "NorthSouthFeet": "double",
    "ElevationFeet": "double",
    "AngleRadians": "double",
}
REQUIRED = "ProjectId"


def _read(whole: Column, kinds: dict[str, str]) -> dict[str, Column]:
    return {n: F.try_variant_get(whole, f"$.{n}", k) for n, k in kinds.items()}


def _judged(whole: Column, raw: dict[str, Column], value: dict[str, Column], kind: dict[str, Column]) -> list[Column]:
    """FIELDS, `supported`, and `fault` from a parsed export, its fields as they stand, as their types, and the types that they have."""
    fits = {n: kind[n].isin("STRING", "VOID") if k == "string" else kind[n].isin("BOOLEAN", "VOID") if k == "boolean" else kind[n].isin("BIGINT", "VOID") if k == "bigint" else ~kind[n].isin("STRING", "BOOLEAN") & value[n].isNotNull() | (kind[n] == "VOID") for n, k in FIELDS.items()}
    wrong = F.array_compact(F.array(*(F.when(raw[n].isNotNull() & ~fits[n], n) for n in FIELDS)))
    fault = (
        F.when(whole.isNull() | ~F.schema_of_variant(whole).startswith("OBJECT"), "not a whole JSON object")
        .when(F.size(wrong) > 0, F.concat(F.lit("wrong type: "), F.array_join(wrong, ", ")))
        .when(value[REQUIRED].isNull(), f"missing: {REQUIRED}")
    )
    return [*(F.when(fits[n], value[n]).alias(n) for n in FIELDS), fault.isNull().alias("supported"), fault.alias("fault")]


def snapshot(json: Column) -> Column:
    """struct of FIELDS, `supported`, and `fault` (null if supported) of one export. For a table, `snapshots` is many times faster."""
    whole = F.try_parse_json(json)
    # a value that is there but doesn't fit, or is text where a number or flag belongs
    raw = _read(whole, dict.fromkeys(FIELDS, "variant"))
    return F.struct(*_judged(whole, raw, _read(whole, FIELDS), {n: F.schema_of_variant(v) for n, v in raw.items()}))


def snapshots(texts: DataFrame, json: str = "value") -> DataFrame:
    """`texts` with the fields of each export, `supported` and `fault`.

    Step by step, so that a text is parsed once and a field taken out once: as one expression, both happen wherever they are named.
    """
    whole = F.col("__whole")
    raw, value, kind = ({n: F.col(f"__{of}_{n}") for n in FIELDS} for of in ("raw", "value", "kind"))
    fields = {f"__raw_{n}": v for n, v in _read(whole, dict.fromkeys(FIELDS, "variant")).items()} | {f"__value_{n}": v for n, v in _read(whole, FIELDS).items()}
    read = texts.withColumn("__whole", F.try_parse_json(F.col(json))).withColumns(fields).withColumns({f"__kind_{n}": F.schema_of_variant(v) for n, v in raw.items()})
    return read.select(*texts.columns, *_judged(whole, raw, value, kind))


def quarantine(read: DataFrame) -> DataFrame:
    """fault, exports: how many exports have each fault."""
    # counted, not filtered: a filter would be pushed below the steps of `snapshots` and repeat them
    return read.groupBy("fault").agg(F.count_if(~F.col("supported")).alias("exports")).filter("exports > 0")

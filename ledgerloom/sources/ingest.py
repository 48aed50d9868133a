"""Feed scans and per-record validation with quarantine.

A raw feed is ``(src_pos BIGINT, raw)``: the record's position in its source and its payload, either
a VARIANT (JSON scans, which must tell a JSON float from a string) or a struct of strings (tables).
Validation is one projection per feed; a bad record becomes a reject row and never stops the batch.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import config as C
from ledgerloom.functions.money import AMOUNT
from ledgerloom.session import stage
from ledgerloom.sources import array_state as A
from ledgerloom.sources.schemas import FEED_FILES, FEEDS, Field

# Accepted text shapes.
_ISO_TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
_HAS_OFFSET = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"
_ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_PERIOD = r"^[0-9]{4}-[0-9]{2}$"


@dataclass(frozen=True)
class Ingested:
    """One validated feed: typed rows and quarantined rows."""

    source: str
    valid: DataFrame
    rejects: DataFrame


def _array_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The text between commas, in file order within each byte range. A comma ends no escape."""
    return spark.read.option("lineSep", ",").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def scan_json_array(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON-array file, typed as in the file. Anything but an array is a hard failure.

    One array is read in many tasks, twice. Each byte range first yields how it changes the scanner's state (in a string,
    nesting) from either state it can begin in; these changes, one row for each range, are combined in file order. Then
    every range is read from its true state on: commas at nesting 1 end an element, and their counts give its place.
    Only what crosses the ends of ranges is shuffled. ``src_pos`` is the place in the file; of several files, each an
    array, those of later names follow.
    """
    chunks = _array_chunks(spark, path)
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def sum_before(column) -> Column:
        return F.coalesce(F.sum(column).over(earlier), F.lit(0))

    # one row for each byte range of a file
    ranges = stage(chunks.select("value", "path", "block").mapInArrow(A.ranges, A.RANGES), "array-ranges")
    ranges = ranges.withColumn("inside", sum_before("quotes") % 2 == 1).withColumn(
        "depth", F.when(F.col("inside"), F.col("depth1")).otherwise(F.col("depth0"))
    )
    begins = ranges.select(
        "path", "block", F.col("inside").cast("int").alias("begin"), sum_before("depth").cast("bigint").alias("base")
    )
    # a range may be joined with others in the second read, but has to begin where one began; the join moves no row
    known = chunks.join(F.broadcast(begins), ["path", "block"], "left").select(
        "value",
        "path",
        "block",
        F.coalesce("begin", F.raise_error(F.lit("the byte ranges changed between two reads")).cast("int")).alias("begin"),
        "base",
    )
    pieces = stage(known.mapInArrow(A.elements, A.PIECES), "array-pieces")
    counts = pieces.filter(~F.col("ends"))
    firsts = counts.select("path", "block", sum_before("k").alias("first"))
    by_name = Window.orderBy("path")
    files = counts.groupBy("path").agg(
        F.sum("k").alias("last_place"), F.max_by(F.struct("string", "depth"), "block").alias("last")
    ).select(
        "path",
        "last_place",
        (~F.col("last.string") & (F.col("last.depth") == 0)).alias("closed"),
        (F.row_number().over(by_name) - 1).cast("bigint").alias("nth"),
    )
    if files.isEmpty():
        raise ValueError("feed root is not a JSON array: the file is empty")
    placed = pieces.filter("value is not null").join(F.broadcast(firsts), ["path", "block"]).select(
        "path", "block", (F.col("first") + F.col("k")).alias("place"), "value", (F.col("ends") & (F.col("k") > 0)).alias("whole")
    )
    crossing = (
        placed.filter(~F.col("whole"))
        .groupBy("path", "place")
        .agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("parts"))
        .select("path", "place", F.array_join(F.transform("parts", lambda x: x.value), ",").alias("text"))
    )
    elements = (
        placed.filter("whole").select("path", "place", F.col("value").alias("text")).unionByName(crossing).join(F.broadcast(files), "path")
    )
    begun = F.when(F.col("place") > 0, F.col("text")).otherwise(F.regexp_replace("text", r"^\s*\[", ""))
    inner = F.when(F.col("place") < F.col("last_place"), begun).otherwise(F.regexp_replace(begun, r"\]\s*$", ""))
    not_array = (F.col("place") == 0) & ~F.col("text").rlike(r"^\s*\[")
    not_closed = ~F.col("closed") | ((F.col("place") == F.col("last_place")) & ~F.col("text").rlike(r"\]\s*$"))
    checked_text = (
        F.when(not_array, F.raise_error(F.lit("feed root is not a JSON array")))
        .when(not_closed, F.raise_error(F.lit("[MALFORMED_ARRAY] the feed's array does not end where the file does")))
        .otherwise(inner)
    )
    held = elements.select("nth", "place", "last_place", checked_text.alias("json"))
    empty = (F.col("last_place") == 0) & (F.trim(F.regexp_replace("json", r"\s", "")) == "")
    return held.filter(~empty).select(
        (F.shiftleft("nth", 40) + F.col("place")).alias("src_pos"),
        F.when(F.col("json").rlike(r"^\s*$"), F.raise_error(F.lit("[MALFORMED_ARRAY] an element is missing")))
        .otherwise(F.parse_json("json"))
        .alias("raw"),
    )


def scan_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON Lines feed, the splittable form for large batches.

    ``src_pos`` follows file name, place in the file and line, however the scan packs its splits. A line that isn't
    JSON becomes a record that is its text, which validation quarantines.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # one row for each split of a file, not for each line
    splits = (
        lines.groupBy("_path", "_block")
        .agg(F.min("_row").alias("_first"))
        .withColumn("_rank", F.row_number().over(Window.orderBy("_path", "_block")).cast("bigint") - 1)
    )
    return lines.join(splits, ["_path", "_block"]).select(
        (F.shiftleft("_rank", 33) + F.col("_row") - F.col("_first")).alias("src_pos"),
        F.coalesce(F.try_parse_json("value"), F.expr("cast(value as variant)")).alias("raw"),
    )


def from_table(rows: DataFrame, source: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """A raw feed from a table of string columns; a null column is an absent field."""
    have = set(rows.columns)
    named = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast("string").alias(f.name) for f in FEEDS[source]
    ]
    return rows.select(*scope, F.col("src_pos").cast("bigint").alias("src_pos"), F.struct(*named).alias("raw"))


def _read(raw_type: T.DataType, field: Field) -> tuple[Column | None, Column]:
    """JSON type (None when every present value is text) and text of one field."""
    if isinstance(raw_type, T.VariantType):
        path = f"$.{field.name}"
        kind = F.schema_of_variant(F.try_variant_get("raw", path, "variant"))
        return kind, F.try_variant_get("raw", path, "string")
    return None, F.col(f"raw.{field.name}")


def _check(field: Field, kind: Column | None, text: Column) -> tuple[Column, list[tuple[Column, str]]]:
    """Parsed value and the (violated, code) conditions of one field, first violated one wins."""
    absent = text.isNull() if kind is None else kind.isNull()
    faults: list[tuple[Column, str]] = []
    if field.required:
        faults.append((absent, "MISSING"))

    if field.kind in ("money", "value"):
        value = text.try_cast(AMOUNT)
        if kind is not None:
            faults.append((kind == "VOID", "NULL_MONEY"))
            faults.append((~kind.isin("STRING", "BIGINT"), "NOT_EXACT_MONEY"))
        faults.append((~absent & value.isNull(), "NOT_A_NUMBER"))
        # more than four decimals would be rounded by the cast; feeds carry two
        rounded = F.length(F.regexp_extract(text, "[.]([0-9]*)", 1)) > 4
        faults.append((rounded & (text.try_cast("decimal(38,10)") != value), "OUT_OF_RANGE"))
        if field.kind == "value":
            faults.append((value < 0, C.UNSUPPORTED_TRANSACTION_TYPE))
        if field.zero:
            value = F.when(absent, F.lit(0).cast(AMOUNT)).otherwise(value)
        return value, faults

    if kind is not None:
        if field.required:
            faults.append((kind == "VOID", "NULL_VALUE"))
        faults.append((~kind.isin("STRING", "VOID"), "NOT_TEXT"))
    if field.kind == "text":
        return text, faults
    if field.kind == "timestamp":
        offset = (
            F.when(F.length(text) == 10, F.lit("T00:00:00Z"))
            .when(text.rlike(_HAS_OFFSET), F.lit(""))
            .otherwise(F.lit("Z"))
        )
        value = F.when(text.rlike(_ISO_TIMESTAMP), F.concat(text, offset).try_cast("timestamp"))
        return value, [*faults, (value.isNull(), "BAD_TIMESTAMP")]
    if field.kind == "date":
        value = F.when(text.rlike(_ISO_DATE), text.try_cast("date"))
        return value, [*faults, (value.isNull(), "BAD_DATE")]
    first = F.when(text.rlike(_PERIOD), F.concat(text, F.lit("-01")).try_cast("date"))
    return text, [*faults, (first.isNull(), "BAD_PERIOD")]


def checked(raw: DataFrame, source: str) -> DataFrame:
    """Every record with its parsed fields, ``valid``, the list of violations and the reject code.

    ``valid`` is a plain boolean, so the valid branch never builds the error texts.
    """
    fields = FEEDS[source]
    raw_type = raw.schema["raw"].dataType
    extra = [c for c in raw.columns if c not in ("src_pos", "raw")]
    read, kinds = [], []
    for i, field in enumerate(fields):
        kind, text = _read(raw_type, field)
        read.append(text.alias(f"t{i}"))
        if kind is not None:
            read.append(kind.alias(f"k{i}"))
        kinds.append(None if kind is None else F.col(f"k{i}"))
    staged = raw.select(*extra, "src_pos", "raw", *read)

    values, errors, any_fault, unsupported = [], [], F.lit(False), F.lit(False)
    for i, field in enumerate(fields):
        value, faults = _check(field, kinds[i], F.col(f"t{i}"))
        values.append(value.alias(field.name))
        error = F.lit(None).cast("string")
        for condition, code in reversed(faults):
            error = F.when(condition, F.lit(f"{field.name}:{code}")).otherwise(error)
            any_fault = any_fault | F.coalesce(condition, F.lit(False))
            if code == C.UNSUPPORTED_TRANSACTION_TYPE:
                unsupported = unsupported | F.coalesce(condition, F.lit(False))
        errors.append(error)
    return staged.select(
        *extra,
        "src_pos",
        "raw",
        *values,
        (~any_fault).alias("valid"),
        F.array_compact(F.array(*errors)).alias("errors"),
        F.when(unsupported, C.UNSUPPORTED_TRANSACTION_TYPE)
        .when(any_fault, C.SCHEMA_VALIDATION_FAILED)
        .alias("error_code"),
    )


def ingest(raw: DataFrame, source: str) -> Ingested:
    rows = checked(raw, source)
    extra = [c for c in raw.columns if c not in ("src_pos", "raw")]
    valid = rows.filter("valid").select(*extra, "src_pos", *[f.name for f in FEEDS[source]])
    rejects = rows.filter(~F.col("valid")).select(
        *extra,
        F.lit(source).alias("source"),
        "src_pos",
        F.to_json("raw").alias("raw"),
        "errors",
        F.array_join("errors", "; ").alias("message"),
        "error_code",
    )
    return Ingested(source, valid, rejects)


def all_rejects(batch: dict[str, Ingested]) -> DataFrame:
    return reduce(DataFrame.unionByName, [part.rejects for part in batch.values()])


def ingest_summary(raw_feeds: dict[str, DataFrame]) -> DataFrame:
    """Valid and rejected rows per source, one pass over each feed."""
    parts = []
    for source, raw in raw_feeds.items():
        bad = ~F.col("valid")
        parts.append(
            checked(raw, source).agg(
                F.lit(source).alias("source"),
                F.count_if(~bad).alias("valid"),
                F.count_if(bad).alias("rejected"),
                F.count_if(F.col("error_code") == C.UNSUPPORTED_TRANSACTION_TYPE).alias("unsupported"),
                F.count(F.lit(1)).alias("total"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def scan_labels(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation labels keyed by transaction. Evaluation jobs only."""
    schema = (
        "txn_id string, expected_status string, expected_exception_code string, category string, notes string"
    )
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.withColumn("expected_exception_code", F.coalesce("expected_exception_code", F.lit("NONE")))

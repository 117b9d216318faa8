"""Long JSON documents read by many tasks: cut at closing braces by Spark's own text reader, put together by running sums.

A document `{header..., "frames": [{...}, {...}], ...}` of any size is split at byte ranges like any text file, with `}` as the line
separator.  Whether a brace is structure or part of a string is the parity of the quotes before it, and how deep it lies is a sum of
braces: both are running sums over the pieces, so no task reads a document from its start.  Pieces between two returns to the top
level form one unit, a field of the header or an element of one of its arrays; elements are parsed one by one with the
schema's columns that are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackweave.operators.series import running, with_position
from trackweave.session import materialize

SPLIT_BYTES = 64 << 20
FILE = "_file"
# text without a structural brace: other characters and whole strings
FLAT = r'(?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+'
FIRST, LATER = rf"(?s)^(\s*+\{{{FLAT})(\{{.*)$", rf"(?s)^({FLAT})(\{{.*)$"


def longest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file under the glob; files are listed, not read."""
    return spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _units(spark: SparkSession, path: str) -> DataFrame:
    """_file, unit, prefix, body: the units of every document in order; the text behind the last one has no body."""
    text = spark.read.option("lineSep", "}").text(path)
    pieces = materialize(text.select(F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value"))
    order = ("_block", "_id")
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    quoted = running(pieces.withColumn("_quotes", _count(bare, '"')), keys=(FILE,), order=order, sums={"_upto": F.col("_quotes")}, chunk=1)
    odd = lambda c: c % 2 == 1
    inside, ends_inside = odd(F.col("_upto") - F.col("_quotes")), odd(F.col("_upto"))
    outside = F.regexp_replace(F.regexp_replace(F.when(inside, F.concat(F.lit('"'), bare)).otherwise(bare), '"[^"]*"', ""), r'"[^"]*\z', "")
    closes = F.when(ends_inside, 0).otherwise(1)
    deep = quoted.select(*pieces.columns, closes.alias("_closes"), (_count(outside, "{") - closes).alias("_step"))
    deep = running(materialize(deep), keys=(FILE,), order=order, sums={"_depth": F.col("_step")}, chunk=1)
    returns = (F.col("_closes") == 1) & (F.col("_depth") == 1)
    units = running(materialize(deep.withColumn("_ends", returns.cast("long"))), keys=(FILE,), order=order, sums={"_done": F.col("_ends")}, chunk=1)
    units = units.withColumn("unit", F.col("_done") - F.col("_ends"))
    # behind the document's own brace there is none to put back
    part = F.struct(*order, F.concat("value", F.when(F.col("_depth") < 0, "").otherwise("}")).alias("text"))
    joined = units.groupBy(FILE, "unit").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["text"]), "").alias("text"), F.max("_ends").alias("_whole"))
    pattern = lambda i: F.when(F.col("unit") == 0, F.regexp_extract("text", FIRST, i)).otherwise(F.regexp_extract("text", LATER, i))
    whole = F.col("_whole") == 1
    return materialize(joined.select(FILE, "unit", F.when(whole, pattern(1)).otherwise(F.col("text")).alias("prefix"), F.when(whole, pattern(2)).alias("body")))


def read_elements(spark: SparkSession, path: str, schema: str, array: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """_file, the header fields `keep`, pos and f: the elements of one array of every document under the glob."""
    fields = StructType.fromDDL(schema)
    units = _units(spark, path)
    prefix = F.trim(F.regexp_replace("prefix", r"[\r\n\t]+", " "))
    # an array's first element stands behind its name and bracket, the others behind a comma
    opened = F.regexp_extract(prefix, r'"((?:[^"\\]|\\.)*+)"\s*+:\s*+\[$', 1)
    told = units.withColumns({"_field": F.col("body").isNotNull() & prefix.endswith(":"), "_comma": prefix == ",", "_opened": F.when(opened != "", opened)})
    element = F.col("body").isNotNull() & ~F.col("_field")
    named = running(told.where(element), keys=(FILE,), order="unit", lasts={"_array": F.col("_opened")}, chunk=1 << 15)
    own = with_position(named.where(F.col("_array") == array), "pos", keys=(FILE,), order="unit")
    parsed = F.from_json("body", fields[array].dataType.elementType)
    out = own.select(FILE, F.col("pos").cast("int").alias("pos"), parsed.alias("f"))
    if not keep:
        return out
    # what stands outside the elements is the header with empty arrays
    outside = told.where(~(element & F.col("_comma"))).select(FILE, "unit", F.when(F.col("_field"), F.concat("prefix", "body")).otherwise(F.col("prefix")).alias("text"))
    header = outside.groupBy(FILE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("unit", "text"))), lambda p: p["text"]), "").alias("text"))
    top = F.from_json("text", StructType([fields[k] for k in keep]))
    return out.join(header.select(FILE, top.alias("_h")), FILE, "left").select(FILE, *[F.col(f"_h.{k}").alias(k) for k in keep], "pos", "f")

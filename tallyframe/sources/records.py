"""Sources beside bars: settlements, ledgers, label files, reports and file inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_settlements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(symbol, time, rate) from CSV files with funding_time_ms, funding_rate and realized_rate, named by symbol; the
    realised rate counts where it is there, and rows without a time or rate are dropped."""
    raw = spark.read.option("header", True).csv(paths)
    number = lambda c: F.col(c).try_cast("double") if c in raw.columns else F.lit(None).cast("double")
    rows = raw.select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.+?)(?:_funding)?\.csv$", 1).alias("symbol"), F.timestamp_millis(F.col("funding_time_ms").try_cast("long")).alias("time"), F.coalesce(number("realized_rate"), number("funding_rate")).alias("rate")
    )
    return rows.where("time is not null and rate is not null")


def read_ledger(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Rows of a JSON-lines ledger; lines that can't be read are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def consecutive_losses(ledger: DataFrame, keys: list[str], order: str, ret: str) -> DataFrame:
    """How many closed trades in a row, counted from the last, were losses; a missing result ends the run."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    broken = F.sum(F.coalesce((F.col(ret) >= 0).cast("int"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ledger.withColumn("_b", broken).groupBy(*keys).agg(F.count_if(F.col("_b") == 0).alias("losses"))


def read_boxes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(image, id, class, cx, cy, w, h, confidence) of label files with five or six numbers a line."""
    lines = spark.read.text(paths).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.+)\.txt$", 1).alias("image"), F.split(F.trim("value"), r"\s+").alias("x")).where("size(x) in (5, 6)")
    n = lambda k: F.get("x", F.lit(k)).try_cast("double")
    rows = lines.select("image", n(0).cast("int").alias("class"), n(1).alias("cx"), n(2).alias("cy"), n(3).alias("w"), n(4).alias("h"), n(5).alias("confidence")).where("cx is not null and cy is not null and w is not null and h is not null")
    order = Window.partitionBy("image").orderBy("cx", "cy", "w", "h")
    return rows.withColumn("id", F.row_number().over(order) - 1)


def box_lines(boxes: DataFrame) -> DataFrame:
    """Boxes as the lines of label files, one row an image."""
    six = lambda c: F.format_string("%.6f", F.col(c))
    line = F.concat_ws(" ", F.lit("0"), six("cx"), six("cy"), six("w"), six("h"))
    return boxes.groupBy("image").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda s: s["line"]), "\n").alias("text"))


def log_counters(lines: DataFrame, pattern: str, since: str | None = None, time: str = r"^(\d{4}-\d\d-\d\d[ T]\d\d:\d\d(?::\d\d)?)") -> DataFrame:
    """(name, total) of the ``name=number`` pairs in a text log's lines (column value) since a time; ``pattern`` has a
    group for the name and one for the number."""
    rows = lines if since is None else lines.where(F.try_to_timestamp(F.regexp_extract("value", time, 1)) >= F.lit(since).cast("timestamp"))
    both = F.arrays_zip(F.regexp_extract_all("value", F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all("value", F.lit(pattern), F.lit(2)).alias("number"))
    return rows.select(F.explode(both).alias("x")).groupBy("x.name").agg(F.sum(F.col("x.number").try_cast("long")).alias("total"))


def coverage(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row a bar width: series, files, rows by the files' names, leftovers of unfinished downloads, the last change."""
    files = spark.read.format("binaryFile").load(paths).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "modificationTime", "length")
    part = lambda k: F.regexp_extract("name", r"^(?:([a-z]+)_)?(.+?)_([0-9]+[mH])(?:_([0-9]+))?(\.part)?\.csv$", k)
    rows = files.select(part(1).alias("source"), part(2).alias("symbol"), part(3).alias("bar"), part(4).try_cast("long").alias("n"), (part(5) != "").alias("part"), "modificationTime").where("bar != ''")
    return rows.groupBy("bar").agg(F.countDistinct("source", "symbol").alias("n_series"), F.count("*").alias("n_files"), F.sum("n").alias("n_rows"), F.count_if("part").alias("n_parts"), F.max("modificationTime").alias("changed"))


def fingerprint(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, sha256) of each file."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"))


#: Keys under which a result file may keep its rows, in the order in which they are looked for.
ROW_KEYS = ("results", "runs", "items", "configs")
#: Tasks that files are dealt to: one may hold more rows than Spark can tell by its bytes.
FILE_PARTS = 32


def flattened(files: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, row_index, name, value): the rows of JSON files of no common shape, one line a row and field, values as text.

    A list has a row for each item. An object with a list that isn't empty under one of ``ROW_KEYS`` has a row for each of
    that list's items, with the object's own scalars beside the item's fields, which count where names are equal; any
    other object is one row without an index. Items and files that aren't objects have one field, ``value``; an empty
    list has ``_empty``. Objects and lists as values are JSON texts, nulls are NULL; texts that aren't JSON give no rows.

    Files are dealt to ``FILE_PARTS`` tasks. Of a file with a list only the object's scalars go beside each item, never
    the file itself, so work grows with the rows that come out. Spark parses texts of less than 128 MB; a larger one is an
    error, not a file without rows.
    """
    spark = files.sparkSession
    parsed = F.when(F.octet_length(text) < 1 << 27, F.try_parse_json(F.col(text))).otherwise(F.parse_json(F.col(text)))
    v = files.select(*keys, parsed.alias("v")).repartition(FILE_PARTS).where("v is not null")
    kind = lambda c: F.schema_of_variant(c)
    at = lambda path: F.try_variant_get("v", path, "variant")
    listed = None
    for k in reversed(ROW_KEYS):
        one = F.when(kind(at(f"$.{k}")).startswith("ARRAY") & at(f"$.{k}[0]").isNotNull(), F.lit(k))
        listed = one if listed is None else F.coalesce(one, listed)
    shaped = v.withColumn("kind", kind("v")).withColumn("under", F.when(F.col("kind").startswith("OBJECT"), listed))
    rows = F.when(F.col("kind").startswith("ARRAY"), F.col("v"))
    for k in ROW_KEYS:
        rows = rows.when(F.col("under") == k, at(f"$.{k}"))
    shaped = shaped.withColumn("rows", rows)
    lone = shaped.where("rows is null").select(*keys, F.lit(None).cast("int").alias("row_index"), F.col("v").alias("item"))
    many = shaped.where("rows is not null").select(*keys, "rows")
    split = many.lateralJoin(spark.tvf.variant_explode_outer(F.col("rows").outer())).select(*keys, F.col("pos").cast("int").alias("row_index"), F.col("value").alias("item"))
    each = split.unionByName(lone)

    is_object = F.coalesce(kind("item").startswith("OBJECT"), F.lit(False))
    own = each.where(is_object).select(*keys, "row_index", "item").lateralJoin(spark.tvf.variant_explode(F.col("item").outer())).select(*keys, "row_index", F.col("key").alias("name"), "value", F.lit(0).alias("from"))
    plain = each.where(~is_object).select(*keys, "row_index", F.when(F.col("item").isNull(), "_empty").otherwise("value").alias("name"), F.coalesce("item", F.parse_json(F.lit("true"))).alias("value"), F.lit(0).alias("from"))
    last = F.size(F.try_variant_get("rows", "$", "array<variant>")) - 1
    base = shaped.where("under is not null").select(*keys, "v", last.alias("last")).lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(*keys, "last", F.col("key").alias("name"), "value")
    base = base.where(~(kind("value").startswith("ARRAY") | kind("value").startswith("OBJECT"))).select(*keys, F.explode(F.sequence(F.lit(0), F.col("last"))).alias("row_index"), "name", "value", F.lit(1).alias("from"))
    nested = kind("value").startswith("ARRAY") | kind("value").startswith("OBJECT")
    shown = own.unionByName(plain).unionByName(base).withColumn("value", F.when(nested, F.to_json("value")).otherwise(F.try_variant_get("value", "$", "string")))
    return shown.groupBy(*keys, "row_index", "name").agg(F.min_by("value", "from").alias("value"))

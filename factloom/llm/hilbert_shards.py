"""Shards along a Hilbert curve: documents that are near each other in several dimensions of their metadata share files.

Each dimension is quantised to cells that hold about as many rows each: a
value becomes a number that keeps its order, numbers are counted in BINS bins
of equal width between the least and the largest, and bins are dealt to cells
by the share of rows before them. The cells of a row are the coordinates of a
point, and the point's place on a Hilbert curve orders the rows. The order is
cut into files, and files into shards of nearly equal sizes (`bytes`) or of
row counts that differ by one at most (`rows`). A file covers a small box in
all dimensions at once, so filters on any of them skip most files by their
statistics.

Only DataFrame functions are used. Whole rows are shuffled once, by range.

Defined results: a null value is its dimension's least, NaN too, infinite ones
lie at its ends; strings are compared by the six bytes after what the least
and the largest begin with alike; rows at one place of the curve are ordered by
id (null first), by the text's checksum and then by their place in the input; a
null text has no bytes; repeated rows are kept; with fewer rows than shards some
shards stay empty, and an empty table gives no files. All columns are kept, in
the struct row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, LongType, NumericType, StringType, StructType, TimestampType

from . import shared

#: Bins in which the values of a dimension are counted, and bits of its cells.
BINS, BITS = 4_096, 5
#: Bytes of text in a file, on average.
FILE_BYTES = 64 << 20
#: Shards have an entry each in an expression.
MOST_SHARDS = 1_000
#: Rows of a task are numbered from its number times 2 to this power.
TASK_BITS = 33


def number(df: DataFrame, name: str, ends: dict) -> Column:
    """A finite number, or null, that does not descend where the column name ascends. ends holds its least and largest value."""
    kind, column = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, StringType):
        low, high = (str(x or "").encode() for x in ends[name])
        same = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
        after = F.substring(column.cast("binary"), same + 1, 6)
        return F.conv(F.rpad(F.hex(after), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, TimestampType):
        return F.unix_micros(column).cast("double")
    if not isinstance(kind, NumericType):
        raise TypeError(f"{name}: a dimension must be a number, a string, a date or a time")
    value = column.cast("double")
    return F.when(F.isnan(value), None).otherwise(F.least(F.greatest(value, F.lit(-1e300)), F.lit(1e300)))


def quantised(docs: DataFrame, dimensions: list[str], text: str, bits: int) -> tuple[Column, Callable[[Column], list[Column]], int]:
    """A column with the bins of a row in all dimensions, what makes its cells of that column, and the bytes of all texts."""
    strings = [d for d in dimensions if isinstance(docs.schema[d].dataType, StringType)]
    found = docs.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.col(f"`{text}`"))).alias("bytes"),
        *[f(F.col(f"`{d}`")).alias(f"{n}{i}") for i, d in enumerate(strings) for n, f in (("low", F.min), ("high", F.max))],
    ).first()
    ends = {d: (found[f"low{i}"], found[f"high{i}"]) for i, d in enumerate(strings)}
    codes = [number(docs, d, ends) for d in dimensions]
    spans = docs.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(codes) for n, f in (("low", F.min), ("high", F.max))]).first()
    bins = []
    for i, code in enumerate(codes):
        low, high = spans[f"low{i}"], spans[f"high{i}"]
        at = F.floor((code - F.lit(low)) / F.lit(high - low) * BINS) if low is not None and high > low else F.when(code.isNotNull(), 0)
        bins.append(F.coalesce(F.least(at.cast("long"), F.lit(BINS - 1)) + 1, F.lit(0)))
    # Counts by dimension and bin: no more rows than there are bins.
    pairs = docs.select(F.explode(F.array(*[F.struct(F.lit(i).alias("dimension"), b.alias("bin")) for i, b in enumerate(bins)])).alias("p"))
    counts = pairs.groupBy("p.dimension", "p.bin").agg(F.count("*").alias("n")).withColumn("part", F.shiftright("bin", 8))
    before = shared.running_total(counts, ["dimension"], "part", [F.col("bin")], "n", "before")
    cell = F.floor((F.col("before") + F.col("n") / 2) * (1 << bits) / max(1, found["rows"]))
    # And of these what each cell begins with.
    begins = before.groupBy("dimension", cell.alias("cell")).agg(F.min("bin").alias("bin")).orderBy("dimension", "cell").collect()

    def cells(of: Column) -> list[Column]:
        out = []
        for i in range(len(bins)):
            own = [(of[i] >= r["bin"], r["cell"]) for r in reversed(begins) if r.dimension == i]
            out.append(F.coalesce(*[F.when(there, F.lit(cell)) for there, cell in own], F.lit(0)).cast("long"))
        return out

    return F.array(*bins), cells, found["bytes"] or 0


def hilbert(cells: list[Column], bits: int) -> Column:
    """The place of a point on the Hilbert curve, by Skilling's transform: reflections from the highest bit down, then a Gray code."""
    n = len(cells)
    if n * bits > 62:
        raise ValueError(f"{n} dimensions of {bits} bits do not fit a long")

    def step(x: Column, k: Column) -> Column:
        q = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(bits - 1) - F.floor(k / n).cast("int"))
        i = k % n
        own, first = F.get(x, i), F.get(x, F.lit(0))
        flip, t = own.bitwiseAND(q) != 0, first.bitwiseXOR(own).bitwiseAND(q - 1)
        return F.transform(x, lambda v, j: F.when(j == 0, first.bitwiseXOR(F.when(flip, q - 1).otherwise(t))).when((j == i) & ~flip, v.bitwiseXOR(t)).otherwise(v))

    turned = F.aggregate(F.sequence(F.lit(0), F.lit((bits - 1) * n - 1)), F.array(*cells), step) if bits > 1 else F.array(*cells)

    def place(x: Column) -> Column:
        gray = [reduce(Column.bitwiseXOR, [F.get(x, F.lit(j)) for j in range(i + 1)]) for i in range(n)]
        t = reduce(Column.bitwiseXOR, [F.when(gray[-1].bitwiseAND(F.lit(1 << b).cast("long")) != 0, F.lit((1 << b) - 1).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(bits)])
        out = [F.shiftleft(F.shiftright(gray[i].bitwiseXOR(t), b).bitwiseAND(F.lit(1).cast("long")), b * n + n - 1 - i) for b in range(bits) for i in range(n)]
        return reduce(Column.bitwiseOR, out)

    # One evaluation of what was turned, however often place() names it.
    return F.get(F.transform(F.array(turned), place), F.lit(0))


def arranged(docs: DataFrame, dimensions: list[str], doc_id: str, text: str, bits: int, file_bytes: int) -> DataFrame:
    """(row, size, at), staged: at numbers the rows in the order of the curve, file by file."""
    bins, cells, size = quantised(docs, dimensions, text, bits)
    body = F.col(f"`{text}`")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), bins.alias("_bins"), F.col(f"`{doc_id}`").alias("_id"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("_crc"), (F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 1).alias("size"), F.monotonically_increasing_id().alias("_row"),
    )
    rows = rows.withColumn("_cells", F.array(*cells(F.col("_bins")))).withColumn("_curve", hilbert([F.col("_cells")[i] for i in range(len(dimensions))], bits))
    order = [F.col("_curve"), F.col("_id").asc_nulls_first(), F.col("_crc"), F.col("_row")]
    placed = rows.repartitionByRange(max(1, math.ceil(size / file_bytes)), *order).sortWithinPartitions(*order).select("row", "size", F.monotonically_increasing_id().alias("at"))
    path = shared.new_path(docs.sparkSession, "curve")
    placed.write.option("compression", "zstd").parquet(path)
    return _read(docs.sparkSession, path, placed.schema)


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    wanted = StructType.fromJson(schema.jsonValue())
    for field in wanted:
        field.nullable = True
    return spark.read.schema(wanted).parquet(path)


def first_places(rows: DataFrame, shards: int, law: str) -> list[tuple[int, int]]:
    """(at, shard): where each shard that has rows begins."""
    value = {"bytes": F.col("size"), "rows": F.lit(1).cast("long")}[law]
    narrow = rows.select("at", F.shiftright("at", TASK_BITS).alias("task"), value.alias("value"))
    total = narrow.agg(F.sum("value")).first()[0] or 1
    before = shared.running_total(narrow, [], "task", [F.col("at")], "value", "before")
    # A row belongs where its middle lies; of rows, which weigh the same, where it begins.
    shard = F.expr(f"(2 * before + {1 if law == 'bytes' else 0} * value) * {shards} div (2 * {total})")
    return sorted((r["first"], r["shard"]) for r in before.groupBy(shard.alias("shard")).agg(F.min("at").alias("first")).collect())


def write(docs: DataFrame, path: str, dimensions: list[str], shards: int, law: str = "bytes", doc_id: str = "doc_id", text: str = "text", bits: int = BITS, file_bytes: int = FILE_BYTES) -> None:
    """Writes docs to path as Parquet files below shard=.../run=..., each a run of the curve. law is `bytes` or `rows`."""
    if not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"shards must be from 1 to {MOST_SHARDS}")
    staged: list[str] = []
    with shared.noted(staged):
        rows = arranged(docs, dimensions, doc_id, text, bits, file_bytes)
        first = first_places(rows, shards, law)
        of = F.greatest(F.lit(first[0][1] if first else 0), F.lit(0), *[F.when(F.col("at") >= at, F.lit(shard)) for at, shard in first[1:]])
        rows.select("*", of.cast("int").alias("shard"), F.shiftright("at", TASK_BITS).alias("run")).write.option("compression", "zstd").partitionBy("shard", "run").parquet(path)
    shared.delete(staged)


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(row, size, at, shard, run) of the shards at path; schema is that of what was written. Filters on fields of row, on shard or run skip files."""
    fields = StructType().add("row", schema).add("size", LongType()).add("at", LongType()).add("shard", IntegerType()).add("run", LongType())
    return _read(spark, path, fields)


def boxes(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """For each file of read(): shard, run, number of rows and bytes, and the ends of each dimension, low_ and high_ with its name."""
    ends = [f(F.col(f"row.`{d}`")).alias(f"{n}_{d}") for d in dimensions for n, f in (("low", F.min), ("high", F.max))]
    return rows.groupBy(F.input_file_name().alias("file"), "shard", "run").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ends)


def slots(rows: DataFrame) -> DataFrame:
    """read(), with slot: the number of a row in its shard, from 0."""
    runs = rows.groupBy("shard", "run").agg(F.min("at").alias("_from"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("shard", "run", "_from", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(runs, ["shard", "run"]).withColumn("slot", F.col("_before") + F.col("at") - F.col("_from")).drop("_before", "_from")


def digest(rows: DataFrame, law: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Where each document lies, from the files."""
    body = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    found = rows.select(F.col(f"row.`{doc_id}`").alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), "at", "shard", "run")
    return slots(found).select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

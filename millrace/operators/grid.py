"""Irregular readings onto a regular grid.

Readings are averaged per source and slot. The source-by-time matrices of the days, one below
the other (a row for each source, field and UTC day, a column for each slot of the day), are
factorised with alternating least squares on log values, centred per row; the product of the
factors fills empty cells. So levels may differ from day to day, the number of columns stays the
same however long the table, and sources and days teach each other the course of a day. Observed
cells keep their exact average. A cell whose row or column has too few observed cells is not
supported by the factors: it stays null and is marked ``unsupported``.

Defined cases: readings with a null source or time are left out; a null or non-finite reading
makes its slot observed but adds nothing to the average; days without a reading have no cells;
an empty table gives an empty grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.common import cut, shared_dir

#: Observed cells of one block of the factorisation.
CELLS = 250_000
OBSERVED, FILLED, UNSUPPORTED = "observed", "filled", "unsupported"


def slot_averages(df: DataFrame, source: str, ts: str, values: Sequence[str], slot_seconds: int = 600) -> DataFrame:
    """``(source, slot, n_readings, values...)``; one partial aggregate per task before the shuffle."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    slot = (F.floor(micros / F.lit(slot_seconds * 1_000_000)) * slot_seconds).cast("long")
    ok = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double"))
    return (
        df.where(F.col(source).isNotNull() & F.col(ts).isNotNull())
        .groupBy(F.col(source).alias("source"), slot.alias("slot_epoch"))
        .agg(F.count("*").alias("n_readings"), *[F.avg(ok(c)).alias(c) for c in values])
    )


def day_grid(slots: DataFrame, slot_seconds: int = 600) -> DataFrame:
    """Every slot between the first and last observed one of each source and UTC day."""
    day = F.floor(F.col("slot_epoch") / 86_400)
    ends = slots.groupBy("source", day.alias("_day")).agg(F.min("slot_epoch").alias("_a"), F.max("slot_epoch").alias("_b"))
    return ends.select("source", F.explode(F.sequence("_a", "_b", F.lit(slot_seconds).cast("long"))).alias("slot_epoch"))


def als_fill(
    cells: DataFrame,
    rank: int = 4,
    reg: float = 0.05,
    iterations: int = 6,
    min_source: int = 3,
    min_slot: int = 2,
    slot_seconds: int = 600,
) -> DataFrame:
    """Estimates for the cells without a value: ``(_row, slot_epoch, estimate)``.

    ``cells`` has ``_row`` (a number for each source, day and field), ``_f`` (the field), ``slot_epoch`` and ``_v``.
    All fields are rows of one matrix, so one factorisation serves them all.
    """
    slot_no = (F.pmod("slot_epoch", F.lit(86_400)) / slot_seconds).cast("int").alias("_slot")
    known = cells.where("_v IS NOT NULL").select("_row", "_f", slot_no, (F.signum("_v") * F.log1p(F.abs("_v"))).alias("_y"))
    centre = cut(known.groupBy("_row").agg(F.avg("_y").alias("_mean"), F.count("*").alias("_n")))
    train = cut(known.join(centre, "_row").select("_row", "_f", "_slot", (F.col("_y") - F.col("_mean")).cast("float").alias("_r")))
    want = cells.where("_v IS NULL").select("_row", "_f", "slot_epoch", slot_no)
    n = train.count()
    if not n:
        return want.select("_row", "slot_epoch", F.lit(None).cast("double").alias("estimate"))
    blocks = max(2, -(-n // CELLS))
    als = ALS(rank=rank, maxIter=iterations, regParam=reg, userCol="_row", itemCol="_slot", ratingCol="_r",
              coldStartStrategy="nan", checkpointInterval=5, numUserBlocks=blocks, numItemBlocks=blocks, seed=7)
    guess = als.fit(train).transform(want)
    support = train.groupBy("_f", "_slot").agg(F.count("*").alias("_m"))
    back = F.col("_mean") + F.col("prediction")
    est = F.signum(back) * F.expm1(F.abs(back))
    fine = (F.col("_n") >= min_source) & (F.col("_m") >= min_slot) & ~F.isnan("prediction")
    return guess.join(centre, "_row", "left").join(support, ["_f", "_slot"], "left").select("_row", "slot_epoch", F.when(fine, est).alias("estimate"))


def _grid(df: DataFrame, source: str, ts: str, values: Sequence[str], slot_seconds: int) -> DataFrame:
    """Every cell of the days' grids with the number ``_sid`` of its source and day and, where observed, its averages."""
    spark = df.sparkSession
    shared_dir(spark)
    slots = cut(slot_averages(df, source, ts, values, slot_seconds))
    day = F.floor(F.col("slot_epoch") / 86_400).alias("_day")
    names = slots.select("source", day).distinct().rdd.map(lambda r: (r[0], r[1])).zipWithIndex().map(lambda x: (*x[0], x[1]))
    kind = slots.schema["source"].dataType.simpleString()
    ids = cut(spark.createDataFrame(names, f"source {kind}, _day long, _sid int"))
    cells = day_grid(slots, slot_seconds).join(slots, ["source", "slot_epoch"], "left").withColumn("_day", day)
    return cut(cells.join(ids, ["source", "_day"]).drop("_day"))


def _long(grid: DataFrame, values: Sequence[str]) -> DataFrame:
    fields = F.array(*[F.struct(F.lit(i).alias("_f"), F.col(v).alias("_v")) for i, v in enumerate(values)])
    return grid.select("_sid", "slot_epoch", F.inline(fields)).withColumn("_row", (F.col("_sid") * len(values) + F.col("_f")).cast("int"))


def regular_series(
    df: DataFrame, source: str, ts: str, values: Sequence[str], slot_seconds: int = 600, **als: float
) -> DataFrame:
    """``(source, slot_epoch, n_readings, values..., status)``: the filled grid of every source and day."""
    grid = _grid(df, source, ts, values, slot_seconds)
    est = als_fill(_long(grid, values), slot_seconds=slot_seconds, **als)
    est = est.groupBy(F.floor(F.col("_row") / len(values)).cast("int").alias("_sid"), "slot_epoch").agg(
        *[F.max(F.when(F.col("_row") % len(values) == i, F.col("estimate"))).alias(f"_e_{v}") for i, v in enumerate(values)]
    )
    out = grid.join(est, ["_sid", "slot_epoch"], "left")
    seen = F.col("n_readings").isNotNull()
    held = F.lit(True)
    for v in values:
        held = held & F.coalesce(F.col(v), F.col(f"_e_{v}")).isNotNull()
    status = F.when(seen, OBSERVED).when(held, FILLED).otherwise(UNSUPPORTED)
    return out.select(
        "source", "slot_epoch", F.coalesce("n_readings", F.lit(0)).alias("n_readings"),
        *[F.coalesce(F.col(v), F.col(f"_e_{v}")).alias(v) for v in values], status.alias("status"),
    )


def fill_error(df: DataFrame, source: str, ts: str, values: Sequence[str], hide: int = 10, slot_seconds: int = 600, **als: float) -> DataFrame:
    """``(field, n_hidden, n_filled, error, error_of_mean)``: one in ``hide`` observed cells of each field is hidden and filled.

    Errors are root mean squares on the log scale, of the factors and of the mean of the source's other cells.
    """
    long = _long(_grid(df, source, ts, values, slot_seconds), values).where("_v IS NOT NULL").withColumn("_hide", F.pmod(F.xxhash64("_row", "slot_epoch"), F.lit(hide)) == 0)
    est = als_fill(long.withColumn("_v", F.when(~F.col("_hide"), F.col("_v"))), slot_seconds=slot_seconds, **als)
    log = lambda c: F.signum(c) * F.log1p(F.abs(c))
    mean = long.where("NOT _hide").groupBy("_row").agg(F.avg(log(F.col("_v"))).alias("_mean"))
    both = long.where("_hide").join(est, ["_row", "slot_epoch"]).join(mean, "_row", "left")
    off = lambda a: F.sqrt(F.avg(F.when(F.col("estimate").isNotNull(), F.pow(a - log(F.col("_v")), 2))))
    names = F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_f") + 1)
    return both.groupBy(names.alias("field")).agg(
        F.count("*").alias("n_hidden"), F.count("estimate").alias("n_filled"), off(log(F.col("estimate"))).alias("error"), off(F.col("_mean")).alias("error_of_mean")
    )

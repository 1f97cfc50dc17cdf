"""Implausible readings, flagged per source against that source's normal behaviour.

The quantile sketch of a source and hour context is a mergeable KLL sketch (JVM aggregate,
combined map-side and across partitions). Its size is bounded by ``k``; below that many
readings it is exact, above it has a rank error. Spikes are readings at least ``factor`` times
the source's median magnitude: the sketch decides all readings that lie clear of its error
band, and only sources with a reading inside the band are settled by exact value counts.

Stuck values are runs in time order. A source is cut into blocks of time; runs are measured
inside a block and joined across blocks from the blocks' first and last runs, so that no
source, however large, is ordered in one task.

Defined cases: null readings are never flagged and do not break a run; repeated records (same
partition and offset) count once, those with a null in either each on their own; a source with no finite non-zero reading has no median and
no spike; an empty table gives no flags; a reading with a null in a source column belongs to no
known source, has nothing to be compared with and is never flagged.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.common import cut
from millrace.operators.cumulative import cumulate, pick_ranks, value_counts

#: Sketch size: groups up to about this many readings are held exactly.
K = 4096
#: Rank error allowed for when a sketch has been compacted; far beyond its 99 % bound at K.
BAND = 0.02


@dataclass(frozen=True)
class Field:
    """A measured column: negative values allowed or not, least magnitude of a spike."""

    name: str
    signed: bool = False
    floor: float = 0.0


def readings(df: DataFrame, source: Sequence[str], ts: str, fields: Sequence[Field], block_seconds: int) -> DataFrame:
    """One row for each (partition, offset) of a known source: ``_src`` struct, ``_block``, ts, partition, offset, fields as double."""
    # a plain key, never null, so that joins on it find the rows where the windows left them
    block = F.coalesce(F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(block_seconds * 1_000_000)), F.lit(-(2**40)))
    rows = df.dropna(subset=list(source)).select(
        F.struct(*[F.col(c).alias(f"s{i}") for i, c in enumerate(source)]).alias("_src"), block.alias("_block"),
        F.col(ts).alias("_ts"), "partition", "offset", *[F.col(f.name).cast("double").alias(f.name) for f in fields],
    )
    order = Window.partitionBy("_src", "_block").orderBy("_ts", "partition", "offset")
    again = F.coalesce((F.lag("offset").over(order) == F.col("offset")) & (F.lag("partition").over(order) == F.col("partition")), F.lit(False))
    return rows.withColumn("_again", again).where(~F.col("_again")).drop("_again")


def finite(c: str) -> Column:
    """Neither null, not-a-number nor infinite."""
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def magnitude(c: str) -> Column:
    """Magnitude of finite non-zero readings, else null."""
    return F.when(finite(c) & (F.col(c) != 0), F.abs(F.col(c)))


def sketches(rows: DataFrame, fields: Sequence[Field], by: Sequence[Column] = (), k: int = K) -> DataFrame:
    """A KLL sketch of the magnitudes of each source (and context) and field."""
    return rows.groupBy("_src", *by).agg(
        *[F.kll_sketch_agg_double(magnitude(f.name), F.lit(k)).alias(f"_k_{f.name}") for f in fields]
    )


def _quantile(sketch: str, q: Column) -> Column:
    n = F.kll_sketch_get_n_double(sketch)
    return F.when(n > 0, F.kll_sketch_get_quantile_double(sketch, q))


def median_bounds(sk: DataFrame, fields: Sequence[Field], k: int = K) -> DataFrame:
    """``_lo_f`` and ``_hi_f``: bounds of each source's median magnitude; equal where the sketch is exact."""
    out = [F.col("_src").alias("_sk_src")]
    for f in fields:
        s = f"_k_{f.name}"
        n = F.kll_sketch_get_n_double(s)
        # for up to k/2 readings this rank lies between the two middle ones
        low, high = _quantile(s, F.lit(0.5)), _quantile(s, F.lit(0.5 + 0.5 / k))
        exact = n <= k // 2
        mid = (low + high) / 2
        out += [
            F.when(exact, mid).otherwise(_quantile(s, F.lit(0.5 - BAND))).alias(f"_lo_{f.name}"),
            F.when(exact, mid).otherwise(_quantile(s, F.lit(0.5 + BAND))).alias(f"_hi_{f.name}"),
        ]
    return sk.select(*out)


def exact_medians(rows: DataFrame, pairs: DataFrame, f: Field) -> DataFrame:
    """Exact median magnitude (mean of the two middle ones) of the sources in ``pairs``."""
    m = rows.select("_src", magnitude(f.name).alias("_m")).join(pairs.select(F.col("_sk_src").alias("_src")).distinct(), "_src", "left_semi")
    cum = cumulate(value_counts(m, ["_src"], "_m"), ["_src"], "_m")
    mid = pick_ranks(cum, {"a": F.floor((F.col("total") + 1) / 2), "b": F.floor(F.col("total") / 2) + 1})
    return mid.groupBy(F.col("_src").alias("_ex_src")).agg(F.avg("_m").alias("_med"))


def _changes(rows: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """For each field the number of the reading in its block, and whether it begins a run; null
    readings have no number of their own and begin nothing."""
    fwd = Window.partitionBy("_src", "_block").orderBy("_ts", "partition", "offset")
    new = {}
    for f in fields:
        before = F.last(f.name, ignorenulls=True).over(fwd.rowsBetween(Window.unboundedPreceding, -1))
        new[f"_p_{f.name}"] = F.count(f.name).over(fwd.rowsBetween(Window.unboundedPreceding, 0))
        new[f"_c_{f.name}"] = F.col(f.name).isNotNull() & ~F.col(f.name).eqNullSafe(before)
    return rows.withColumns(new)


def _runs(d: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Numbers of the first and last reading of the run around each reading, inside its block."""
    fwd = Window.partitionBy("_src", "_block").orderBy("_ts", "partition", "offset")
    back = Window.partitionBy("_src", "_block").orderBy(F.desc("_ts"), F.desc("partition"), F.desc("offset"))
    sofar = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = [f.name for f in fields]
    d = d.withColumns({f"_a_{x}": F.max(F.when(F.col(f"_c_{x}"), F.col(f"_p_{x}"))).over(sofar(fwd)) for x in names})
    # a reading ends its run where the next one begins another
    ends = {}
    for x in names:
        after = F.last(F.when(F.col(x).isNotNull(), F.col(f"_c_{x}")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
        ends[f"_e_{x}"] = F.when(F.col(x).isNotNull() & F.coalesce(after, F.lit(True)), F.col(f"_p_{x}"))
    d = d.withColumns(ends)
    return d.withColumns({f"_z_{x}": F.min(f"_e_{x}").over(sofar(back)) for x in names})


def _block_edges(d: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """What each block's first and last run gain from its neighbours, and whether the source varies.

    One row for each source and block, with a map from field to ``(rows, pre, post, vary)``.
    """
    parts = []
    for f in fields:
        v, c, p, n = F.col(f.name), F.col(f"_c_{f.name}"), F.col(f"_p_{f.name}"), F.count(f.name)
        own = F.when(v.isNotNull(), p)
        parts.append(F.struct(
            F.lit(f.name).alias("f"), n.alias("rows"), F.min_by(v, own).alias("fv"), F.max_by(v, own).alias("lv"),
            (F.coalesce(F.min(F.when(c & (p > 1), p)), n + 1) - 1).alias("fn"), (n + 1 - F.max(F.when(c, p))).alias("ln"),
            F.min(v).alias("mn"), F.max(v).alias("mx"),
        ))
    e = d.groupBy("_src", "_block").agg(F.array(*parts).alias("_parts"))
    e = e.select("_src", "_block", F.inline("_parts")).where("rows > 0")
    src = Window.partitionBy("_src", "f")
    up, down = src.orderBy("_block"), src.orderBy(F.desc("_block"))
    for w, here, there, size, name in ((up, "fv", "lv", "ln", "pre"), (down, "lv", "fv", "fn", "post")):
        sofar = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # a block passes the run of its neighbour on when it is one single run linked to it
        e = e.withColumns({"_near": F.lag(there).over(w), "_i": F.row_number().over(w), "_sum": F.sum(size).over(sofar)})
        e = e.withColumn("_link", F.col("_near").eqNullSafe(F.col(here)) & (F.col("_i") > 1))
        start = F.when(~(F.col("_link") & (F.col(size) == F.col("rows"))), F.struct("_i", (F.col("_sum") - F.col(size)).alias("s")))
        e = e.withColumn("_base", F.max(start).over(sofar))
        e = e.withColumn(name, F.when(F.col("_link"), F.lag(F.col("_sum") - F.col("_base.s")).over(w)).otherwise(F.lit(0)))
    e = e.withColumn("vary", F.coalesce(F.min("mn").over(src) < F.max("mx").over(src), F.lit(False)))
    return e.groupBy(F.col("_src").alias("_es"), F.col("_block").alias("_eb")).agg(
        F.map_from_entries(F.collect_list(F.struct("f", F.struct("rows", "pre", "post", "vary")))).alias("_edge")
    )


def flag_readings(
    df: DataFrame,
    source: Sequence[str],
    ts: str,
    fields: Sequence[Field],
    factor: float = 8.0,
    run: int = 8,
    block_seconds: int = 21_600,
) -> DataFrame:
    """``(field, partition, offset, impossible, spike, stuck)``: every reading with at least one flag."""
    rows = readings(df, source, ts, fields, block_seconds)
    # one row for each source; written once, as the open cases are looked for before the flags are made
    bounds = cut(median_bounds(sketches(rows, fields), fields))
    compacted = bounds.agg(*[F.max(F.col(f"_lo_{f.name}") < F.col(f"_hi_{f.name}")).alias(f.name) for f in fields]).first()
    changes = _changes(rows, fields)
    edges = _block_edges(changes, fields)
    # bounds go to the blocks, not to the readings: readings stay where they are, and a large source stays spread
    edges = edges.join(bounds, edges["_es"] == bounds["_sk_src"], "left")
    d = _runs(changes, fields)
    d = d.join(edges, (d["_src"] == edges["_es"]) & (d["_block"] == edges["_eb"]), "left")
    parts = []
    for f in fields:
        x, edge = f.name, F.col("_edge")[f.name]
        length = (
            F.col(f"_z_{x}") - F.col(f"_a_{x}") + 1
            + F.when(F.col(f"_a_{x}") == 1, edge["pre"]).otherwise(0)
            + F.when(F.col(f"_z_{x}") == edge["rows"], edge["post"]).otherwise(0)
        )
        parts.append(F.struct(
            F.lit(x).alias("field"), F.col(x).alias("v"), length.alias("length"), edge["vary"].alias("vary"), F.col(f"_lo_{x}").alias("lo"),
            F.col(f"_hi_{x}").alias("hi"), F.lit(f.floor).alias("floor"), F.lit(f.signed).alias("signed"),
        ))
    long = d.select("_src", "partition", "offset", F.inline(F.array(*parts)))
    wild = F.isnan("v") | (F.abs("v") == float("inf"))
    m = F.when(~wild & (F.col("v") != 0), F.abs("v"))
    hits = long.select(
        "_src", "partition", "offset", "field", m.alias("m"), "lo", "hi", "floor",
        F.coalesce(wild | ((F.col("v") < 0) & ~F.col("signed")), F.lit(False)).alias("impossible"),
        F.coalesce((F.col("length") >= run) & F.col("vary") & (F.col("v") != 0), F.lit(False)).alias("stuck"),
    )
    big = F.coalesce((F.col("m") >= F.col("floor")) & (F.col("m") >= factor * F.col("lo")), F.lit(False))
    hits = hits.withColumn("maybe", big).where("impossible OR stuck OR maybe")
    hits = hits.withColumn("spike", F.col("maybe") & (F.col("m") >= factor * F.col("hi")))
    settled = None
    for f in fields:
        if compacted[f.name]:
            med = exact_medians(rows, rows_in_band(rows, bounds, f, factor), f).withColumn("_f", F.lit(f.name))
            settled = med if settled is None else settled.unionByName(med)
    if settled is None:
        return hits.select("field", "partition", "offset", "impossible", "spike", "stuck").where("impossible OR spike OR stuck")
    hits = hits.join(settled, (hits["_src"] == settled["_ex_src"]) & (hits["field"] == settled["_f"]), "left")
    spike = F.col("spike") | (F.col("maybe") & F.coalesce(F.col("m") >= factor * F.col("_med"), F.lit(False)))
    return hits.select("field", "partition", "offset", "impossible", spike.alias("spike"), "stuck").where("impossible OR spike OR stuck")


def rows_in_band(rows: DataFrame, bounds: DataFrame, f: Field, factor: float) -> DataFrame:
    """Sources with a reading that a compacted sketch leaves open."""
    wide = bounds.where(F.col(f"_lo_{f.name}") < F.col(f"_hi_{f.name}"))
    m = magnitude(f.name)
    return (
        rows.join(wide, rows["_src"] == wide["_sk_src"])
        .where((m >= F.lit(f.floor)) & (m >= factor * F.col(f"_lo_{f.name}")) & (m < factor * F.col(f"_hi_{f.name}")))
        .select("_sk_src")
    )


def context_fences(
    df: DataFrame, source: Sequence[str], ts: str, f: Field | Sequence[Field], widen: float = 3.0, block_seconds: int = 21_600
) -> DataFrame:
    """Interquartile fences of each field, source and hour of day, from merged sketches of signed values.

    ``(field, source..., hour, n, q1, q2, q3, low, high, zero_variance)``; all fields in one pass.
    """
    fields = [f] if isinstance(f, Field) else list(f)
    rows = readings(df, source, ts, fields, block_seconds)
    hour = F.hour(F.col("_ts").cast("timestamp"))
    ks = [F.kll_sketch_agg_double(F.when(finite(x.name), F.col(x.name)), F.lit(K)).alias(f"_k_{x.name}") for x in fields]
    per_block = rows.groupBy("_src", "_block", hour.alias("hour")).agg(*ks)
    sk = per_block.groupBy("_src", "hour").agg(*[F.kll_merge_agg_double(f"_k_{x.name}", F.lit(K)).alias(f"_k_{x.name}") for x in fields])
    sk = sk.select("_src", "hour", F.inline(F.array(*[F.struct(F.lit(x.name).alias("field"), F.col(f"_k_{x.name}").alias("k")) for x in fields])))
    n = F.kll_sketch_get_n_double("k")
    q = sk.where(n > 0).select("_src", "hour", "field", n.alias("n"), *[F.kll_sketch_get_quantile_double("k", F.lit(p)).alias(c) for c, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75), ("_b", 0.0), ("_t", 1.0))])
    iqr = F.col("q3") - F.col("q1")
    return q.select(
        "field", *[F.col(f"_src.s{i}").alias(c) for i, c in enumerate(source)], "hour", "n", "q1", "q2", "q3",
        (F.col("q1") - widen * iqr).alias("low"), (F.col("q3") + widen * iqr).alias("high"), (F.col("_b") == F.col("_t")).alias("zero_variance"),
    )


#: Sketch size of a context: its rank error is far below the quarter that the fences ask for.
CONTEXT_K = 200
#: Hours of readings that are ordered together; contexts lie inside.
BLOCK_HOURS = 6


def context_flags(
    df: DataFrame, source: Sequence[str], ts: str, fields: Sequence[Field], widen: float = 3.0, least: int = 8, slack: float = 0.1,
    context_hours: int = 1,
) -> DataFrame:
    """``(field, partition, offset, outside, jump, flat)``: readings that are unlike their source.

    ``outside``: beyond the interquartile fences of the source at that time of day (in contexts of
    ``context_hours`` hours, which divide the day), widened by ``widen`` interquartile ranges (at least ``slack`` of the median). ``jump``: a change per second
    beyond the widened fence of the source's own changes. ``flat``: a non-zero value of a source
    and context whose ``least`` or more readings are all the same. Readings are ordered in blocks of
    several contexts; the fences of a block's contexts are joined to it as one map, so readings stay
    where they are, written once for all uses. Readings without a time are a context of their own.
    Fewer than ``least`` readings give no fence.
    """
    block_hours = math.lcm(BLOCK_HOURS, context_hours)
    rows = readings(df, source, ts, fields, block_hours * 3600)
    w = Window.partitionBy("_src", "_block").orderBy("_ts", "partition", "offset")
    names = [f.name for f in fields]
    seconds = lambda a, b: (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1e6
    d = rows.withColumns({"_bts": F.lag("_ts").over(w), **{f"_b_{x}": F.lag(x).over(w) for x in names}})
    context = F.floor(F.unix_micros(F.col("_ts").cast("timestamp")) / F.lit(context_hours * 3_600_000_000))
    part = F.pmod("_block", F.lit(24 // block_hours))
    here = {"_part": part, "_hour": F.coalesce(F.pmod(context, F.lit(24 // context_hours)), F.lit(-1)).cast("int")}

    def change(x: str) -> Column:
        gap = seconds(F.col("_ts"), F.col("_bts"))
        return F.when(finite(x) & finite(f"_b_{x}") & (gap > 0), F.abs(F.col(x) - F.col(f"_b_{x}")) / gap)

    d = d.withColumns({f"_r_{x}": change(x) for x in names})

    def fence(sketch: str, q: float) -> Column:
        return F.when(F.kll_sketch_get_n_double(sketch) >= least, F.kll_sketch_get_quantile_double(sketch, F.lit(q)))

    # only limits travel to the blocks
    hours = rows.withColumns(here).groupBy("_src", "_part", "_hour").agg(*[F.kll_sketch_agg_double(F.when(finite(x), F.col(x)), F.lit(CONTEXT_K)).alias(f"_k_{x}") for x in names])
    hours = hours.select("_src", "_part", "_hour", *[fence(f"_k_{x}", q).alias(f"_{n}_{x}") for x in names for n, q in (("q0", 0.0), ("q1", 0.25), ("q2", 0.5), ("q3", 0.75), ("q4", 1.0))])
    limits = []
    for x in names:
        q0, q1, q2, q3, q4 = (F.col(f"_q{i}_{x}") for i in range(5))
        room = widen * F.greatest(q3 - q1, slack * F.abs(q2))
        limits.append(F.when(q2.isNotNull(), F.struct((q1 - room).alias("low"), (q3 + room).alias("high"), (q0 == q4).alias("same"))).alias(x))
    hours = hours.where(F.coalesce(*[f"_q2_{x}" for x in names]).isNotNull()).groupBy(F.col("_src").alias("_hs"), F.col("_part").alias("_hp"))
    hours = hours.agg(F.map_from_entries(F.collect_list(F.struct("_hour", F.struct(*limits)))).alias("_fences"))
    whole = d.groupBy("_src").agg(*[F.kll_sketch_agg_double(F.col(f"_r_{x}"), F.lit(CONTEXT_K)).alias(f"_q_{x}") for x in names])
    c1, c3 = ({x: fence(f"_q_{x}", q) for x in names} for q in (0.25, 0.75))
    whole = whole.select(F.col("_src").alias("_ws"), *[(c3[x] + widen * F.greatest(c3[x] - c1[x], slack * c3[x])).alias(f"_c_{x}") for x in names])
    last = rows.groupBy("_src", "_block").agg(F.max("_ts").alias("_lts"), *[F.max_by(x, F.struct("_ts", "partition", "offset")).alias(f"_l_{x}") for x in names])
    before = Window.partitionBy("_src").orderBy("_block")
    edges = last.select("_src", "_block", part.alias("_part"), F.lag("_lts").over(before).alias("_pts"), *[F.lag(f"_l_{x}").over(before).alias(f"_p_{x}") for x in names])
    edges = edges.join(whole, edges["_src"] == whole["_ws"], "left").join(hours, (edges["_src"] == hours["_hs"]) & (edges["_part"] == hours["_hp"]), "left")
    edges = edges.select(F.col("_src").alias("_es"), F.col("_block").alias("_eb"), "_pts", "_fences", *[f"_{n}_{x}" for x in names for n in ("p", "c")])
    d = d.join(edges, (d["_src"] == edges["_es"]) & (d["_block"] == edges["_eb"])).withColumns(here).withColumn("_fence", F.col("_fences")[F.col("_hour")])
    parts = [
        F.struct(F.lit(x).alias("field"), F.col(x).alias("v"), F.col(f"_r_{x}").alias("r"), F.when(F.col("_bts").isNull(), F.col(f"_p_{x}")).alias("p"),
                 F.col(f"_c_{x}").alias("most"), *[F.col("_fence")[x][n].alias(n) for n in ("low", "high", "same")])
        for x in names
    ]
    long = d.select("partition", "offset", "_ts", "_pts", F.inline(F.array(*parts)))
    # the first reading of a block changes against the last one of the block before
    gap = seconds(F.col("_ts"), F.col("_pts"))
    first = F.when(finite("v") & finite("p") & (gap > 0), F.abs(F.col("v") - F.col("p")) / gap)
    wild = F.isnan("v") | (F.abs("v") == float("inf"))
    flags = long.withColumn("r", F.coalesce("r", first)).select(
        "field", "partition", "offset",
        F.coalesce(wild | (F.col("v") < F.col("low")) | (F.col("v") > F.col("high")), F.lit(False)).alias("outside"),
        F.coalesce(F.col("r") > F.col("most"), F.lit(False)).alias("jump"),
        F.coalesce(F.col("same") & (F.col("v") != 0), F.lit(False)).alias("flat"),
    )
    return flags.where("outside OR jump OR flat")

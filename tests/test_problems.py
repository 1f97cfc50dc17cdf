"""General data problems on small tables with their odd cases, against plain Python."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from millrace.operators import grid, late, ledger, skew, spikes
from millrace.operators.cumulative import cumulate, merge_counts, pick_ranks, value_counts
from millrace.streaming.dedupe import deliver_once

T0 = dt.datetime(2020, 1, 1)


def minutes(x):
    return T0 + dt.timedelta(minutes=x)


def test_cumulative_ranks_with_ties_and_null_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", None]), rng.randint(0, 9)) for _ in range(300)] + [("a", None)]
    st = value_counts(spark.createDataFrame(rows, "g string, v int"), ["g"], "v")
    got = {r.g: r.v for r in pick_ranks(cumulate(st, ["g"], "v"), {"m": F.floor((F.col("total") + 1) / 2)}).collect()}
    for g in ("a", None):
        v = [x for k, x in rows if k == g and x is not None]
        assert got[g] == statistics.median_low(v)
    assert merge_counts(st, st.withColumn("cnt", -F.col("cnt")), ["g"], "v").count() == 0


LATE = "partition int, offset long, ts timestamp_ntz, src string, value decimal(18,3), extra string"


def test_late_marks_and_corrected_totals(spark):
    rng = random.Random(7)
    rows = []
    for p in range(2):
        at = 0
        for o in range(120):
            at += rng.randint(0, 3)
            rows.append((p, o * 3, None if o == 50 else minutes(at - (rng.choice([31, 60, 10, 30]) if rng.random() < 0.2 else 0)), rng.choice(["a", None]), None if o % 40 == 0 else decimal.Decimal(o % 7), "x"))
    rows += rng.sample(rows, 20)
    df = spark.createDataFrame(rows, LATE)
    got = {(r.partition, r.offset): r.is_late for r in late.mark_late(df, block=16).collect()}
    one = {(r[0], r[1]): r for r in rows}
    for (p, o), r in one.items():
        before = [x[2] for x in one.values() if x[0] == p and x[1] < o and x[2]]
        assert got[p, o] == bool(before and r[2] and r[2] < max(before) - dt.timedelta(minutes=30))
    assert len(got) == len(one)
    marked = late.mark_late(df, block=16).where("NOT is_late")
    state = late.period_state(marked, ["src"], "value")
    half = late.period_state(marked.where("offset % 2 = 0"), ["src"], "value")
    rest = late.period_state(marked.where("offset % 2 = 1"), ["src"], "value")
    a = {(r.src, r.period): r for r in late.period_totals(state, ["src"], "value").collect()}
    b = {(r.src, r.period): r for r in late.period_totals(late.correct(half, rest, ["src"], "value"), ["src"], "value").collect()}
    assert a == b
    crowded = late.crowded_periods(df, ["src"], crowd=20)
    assert crowded.count() > 0 and late.crowded_periods(df, ["src"]) is None
    half, rest = (late.period_state(marked.where(f"offset % 2 = {k}"), ["src"], "value", crowded=crowded) for k in (0, 1))
    c = {(r.src, r.period): r for r in late.period_totals(late.correct(half, rest, ["src"], "value"), ["src"], "value", crowded).collect()}
    assert c == a and len(crowded.collect()) < len(a)
    for (s, h), r in a.items():
        whole = [x[4] for k, x in one.items() if x[2] and not got[k] and x[3] == s and x[2].replace(minute=0, second=0) == h]
        v = [x for x in whole if x is not None]
        assert (r.n_records, r.n_distinct, r.total, r.median) == (len(whole), len(set(v)), sum(v) if v else None, statistics.median_low(v) if v else None)


def test_late_on_an_empty_table(spark):
    df = spark.createDataFrame([], LATE)
    assert late.mark_late(df).count() == 0
    assert late.period_totals(late.period_state(df, ["src"], "value"), ["src"], "value").count() == 0


def matrix(spark, hide=()):
    rows = []
    for s in range(8):
        for t in range(60):
            if (s, t) not in hide:
                level = math.exp(8 + s / 3 + math.sin(t / 9) * (1 + s / 8) + math.cos(t / 5) * (1 - s / 8))
                rows.append((f"n{s}", T0 + dt.timedelta(seconds=600 * t + 5), level))
    return spark.createDataFrame(rows, "node string, ts timestamp_ntz, memory double")


def test_grid_fills_held_out_cells_better_than_the_mean(spark):
    rng = random.Random(3)
    hide = {(rng.randrange(8), rng.randrange(2, 58)) for _ in range(40)} | {(s, 30) for s in range(8)}
    full = {(r.node, r.ts): r.memory for r in matrix(spark).collect()}
    out = grid.regular_series(matrix(spark, hide), "node", "ts", ["memory"]).collect()
    cells = {(r.source, r.slot_epoch): r for r in out}
    assert len(cells) == 8 * 60
    err, base = [], []
    for s, t in hide:
        r = cells[f"n{s}", int(T0.replace(tzinfo=dt.UTC).timestamp()) + 600 * t]
        truth = math.log(full[f"n{s}", T0 + dt.timedelta(seconds=600 * t + 5)])
        if t == 30:
            assert r.status == "unsupported" and r.memory is None
            continue
        assert r.status == "filled"
        mean = statistics.mean(math.log(v) for (n, _), v in full.items() if n == f"n{s}")
        err.append((math.log(r.memory) - truth) ** 2)
        base.append((mean - truth) ** 2)
    assert sum(err) < 0.25 * sum(base)
    for r in out:
        if r.status == "observed":
            assert r.memory == pytest.approx(full[r.source, dt.datetime.fromtimestamp(r.slot_epoch + 5, dt.UTC).replace(tzinfo=None)])


def test_fill_error_on_hidden_cells(spark):
    df = matrix(spark).withColumn("reductions", F.col("memory") * 3)
    got = {r.field: r for r in grid.fill_error(df, "node", "ts", ["memory", "reductions"], hide=8).collect()}
    assert set(got) == {"memory", "reductions"}
    assert all(r.n_filled == r.n_hidden > 20 and r.error < 0.5 * r.error_of_mean for r in got.values())


def test_grid_odd_rows(spark):
    rows = [(None, T0, 1.0), ("a", None, 1.0), ("a", T0, float("nan")), ("a", minutes(40), None), ("a", minutes(60 * 50), 2.0)]
    out = grid.regular_series(spark.createDataFrame(rows, "node string, ts timestamp_ntz, memory double"), "node", "ts", ["memory"]).collect()
    assert sorted(r.status for r in out) == ["observed"] * 3 + ["unsupported"] * 3
    assert grid.regular_series(spark.createDataFrame([], "node string, ts timestamp_ntz, memory double"), "node", "ts", ["memory"]).count() == 0


READ = "partition int, offset long, src string, ts timestamp_ntz, v double"


def brute_flags(rows, signed, floor, factor=8, run=8):
    one = {(r[0], r[1]): r for r in rows}
    out = {}
    for s in {r[2] for r in one.values()} - {None}:
        mine = sorted((r for r in one.values() if r[2] == s and r[4] is not None), key=lambda r: (r[3], r[0], r[1]))
        mags = [abs(r[4]) for r in mine if math.isfinite(r[4]) and r[4]]
        med = statistics.median(mags) if mags else None
        same = lambda a, b: a == b or (a != a and b != b)
        vary = any(not same(r[4], mine[0][4]) for r in mine)
        i = 0
        while i < len(mine):
            j = i
            while j < len(mine) and same(mine[j][4], mine[i][4]):
                j += 1
            for r in mine[i:j]:
                v = r[4]
                bad = not math.isfinite(v) or (v < 0 and not signed)
                spike = math.isfinite(v) and v != 0 and med is not None and abs(v) >= factor * med and abs(v) >= floor
                stuck = j - i >= run and v != 0 and vary
                if bad or spike or stuck:
                    out[r[0], r[1]] = (bad, spike, stuck)
            i = j
    return out


@pytest.mark.parametrize(("signed", "floor", "seed"), [(True, 0.0, 1), (False, 100.0, 2), (False, 0.0, 3)])
def test_flags_match_brute_force_across_blocks(spark, signed, floor, seed):
    rng = random.Random(seed)
    rows, o = [], 0
    for s in ("a", "b", None, "flat"):
        v, hold = 1.0, 0
        for t in range(220):
            o += 1
            if hold:
                hold -= 1
            elif rng.random() < 0.08:
                hold = rng.randint(5, 30)
            else:
                v = rng.choice([0.0, rng.uniform(1, 20), -rng.uniform(1, 20), rng.uniform(50, 500), float("nan"), float("inf")] + [rng.uniform(1, 20)] * 8)
            rows.append((0, o, s, minutes(t * 7), 5.0 if s == "flat" else v))
    rows += rng.sample(rows, 30)
    df = spark.createDataFrame(rows, READ)
    got = spikes.flag_readings(df, ["src"], "ts", [spikes.Field("v", signed, floor)], block_seconds=3600)
    assert {(r.partition, r.offset): (r.impossible, r.spike, r.stuck) for r in got.collect()} == brute_flags(rows, signed, floor)


def test_flags_settled_exactly_when_sketches_are_compacted(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(0, i, "a", minutes(i), rng.choice([rng.uniform(9, 11), rng.uniform(70, 90)] if i % 5 == 0 else [rng.uniform(9, 11)])) for i in range(3000)]
    small = spikes.sketches.__defaults__
    monkeypatch.setattr(spikes.sketches, "__defaults__", ((), 64))
    monkeypatch.setattr(spikes.median_bounds, "__defaults__", (64,))
    monkeypatch.setattr(spikes, "BAND", 0.2)
    got = spikes.flag_readings(spark.createDataFrame(rows, READ), ["src"], "ts", [spikes.Field("v")])
    assert {(r.partition, r.offset) for r in got.where("spike").collect()} == set(brute_flags(rows, False, 0.0))
    assert small


def test_flags_on_null_readings_and_empty(spark):
    rows = [(0, i, "a", minutes(i), None if i % 3 == 0 else 7.0) for i in range(20)] + [(0, 99, "a", minutes(99), 3.0)]
    got = spikes.flag_readings(spark.createDataFrame(rows, READ), ["src"], "ts", [spikes.Field("v")], block_seconds=300)
    assert {r.offset for r in got.collect()} == {i for i in range(20) if i % 3}
    assert spikes.flag_readings(spark.createDataFrame([], READ), ["src"], "ts", [spikes.Field("v")]).count() == 0


def test_fences_mark_constant_sources(spark):
    rows = [(0, i, "a", minutes(i), 5.0) for i in range(30)] + [(0, 100 + i, "b", minutes(i), float(i)) for i in range(30)]
    got = {r.src: r for r in spikes.context_fences(spark.createDataFrame(rows, READ), ["src"], "ts", spikes.Field("v")).collect()}
    assert got["a"].zero_variance and not got["b"].zero_variance
    assert got["b"].low < 0 < 29 < got["b"].high


def test_heavy_keys_and_salted_results(spark):
    rows = [("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(400)] + [(None, 1)] * 60 + [("", 1)] * 60
    df = spark.createDataFrame(rows, "key string, v long").withColumn("extra", F.lit(1))
    counts = skew.key_counts(df, F.col("key"), [F.col("v")])
    heavy = skew.heavy_keys(counts)
    assert [r.key for r in heavy.collect()] == ["hot"]
    out = skew.salted_aggregate(df, F.col("key"), heavy, [F.col("v")], {"n": F.count("*"), "s": F.sum("v")}, {"n": F.sum("n"), "s": F.sum("s")})
    got = {r.key: (r.n, r.s) for r in out.collect()}
    assert got["hot"] == (500, sum(range(500))) and got[None] == (60, 60) and len(got) == 403
    assert skew.heavy_keys(skew.key_counts(df.limit(0), F.col("key"), [F.col("v")])).count() == 0


MSG = "topic string, partition int, offset long, batch_id long, at timestamp_ntz, value binary, headers array<struct<key:string,value:binary>>"


def test_deliver_once_over_batches_with_expiry_and_lookup(spark, tmp_path):
    rng = random.Random(6)
    sent, want = [], {}
    for b in range(4):
        rows = []
        for i in range(60):
            o = rng.choice([None, *range(b * 20, b * 20 + 40)])
            rows.append(("t", 0, o, b, minutes(b * 600 + i), str(i).encode(), [("h", b"x")]))
        if b == 3:  # copies of what the store has forgotten by now, and a late message nobody saw
            rows += [(*r[:3], 3, r[4], r[5], r[6]) for r in sent[:20]] + [("t", 0, 5000, 3, minutes(1), b"late", None)]
        sent += rows
        for r in rows:
            # a record without an offset is a copy of none
            want.setdefault(r[:3] if r[2] is not None else (*r[:3], len(want)), []).append(r)
        spark.createDataFrame(rows, MSG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        once, again = deliver_once(spark, str(tmp_path / "in"), ["topic", "partition", "offset"], "at", "batch_id", str(tmp_path / "root"), delay="1 minute", keep_ms=60_000, block=8, files_per_batch=1)
        assert {(r.topic, r.partition, r.offset) for r in once.collect()} == {k[:3] for k in want} and once.count() == len(want)
        assert again.count() == len(sent) - len(want)
    assert once.columns == [f.split()[0] for f in MSG.split(", ")]
    first = {(r.topic, r.partition, r.offset): r.at for r in once.where("offset IS NOT NULL").collect()}
    assert all(first[k] == min(r[4] for r in v if r[3] == v[0][3]) for k, v in want.items() if k in first)
    assert sum(r.headers is not None and r.headers[0].value == b"x" for r in once.collect()) == len(want) - 1


def test_deliver_once_from_an_empty_table_and_one_without_offsets(spark, tmp_path):
    ident = ["topic", "partition", "offset"]
    spark.createDataFrame([], MSG).write.parquet(str(tmp_path / "in"))
    once, again = deliver_once(spark, str(tmp_path / "in"), ident, "at", "batch_id", str(tmp_path / "root"))
    assert once.count() == again.count() == 0
    spark.createDataFrame([("t", None, None, 1, None, b"a", None)] * 3, MSG).write.mode("append").parquet(str(tmp_path / "in"))
    once, again = deliver_once(spark, str(tmp_path / "in"), ident, "at", "batch_id", str(tmp_path / "root"))
    assert (once.count(), again.count()) == (3, 0)


LOG = "topic string, partition int, status string, from_offset long, to_offset long"


def rows_of(df):
    return sorted(((r.topic, r.partition, r.offset) for r in df.collect()), key=repr)


def test_ledger_covers_what_is_left_exactly_once(spark, tmp_path):
    data = spark.createDataFrame([(t, p, o, "x") for t in "ab" for p in range(2) for o in range(0, 90, 2)], "topic string, partition int, offset long, item string")
    log = [("a", 0, "succeeded", 0, 40), ("a", 0, "succeeded", 0, 40), ("a", 0, "succeeded", 0, 20), ("a", 0, "failed", 41, 88), ("a", 1, "started", 0, None), ("b", 0, "succeeded", 0, 200)]
    got = ledger.process_new(spark, data, spark.createDataFrame(log, LOG), str(tmp_path / "l"), item_offsets=16)
    want = [(t, p, o) for t in "ab" for p in range(2) for o in range(0, 90, 2) if not (t, p) == ("b", 0) and not ((t, p) == ("a", 0) and o <= 40)]
    assert rows_of(got) == sorted(want, key=repr) and got.columns == data.columns and {r.item for r in got.collect()} == {"x"}
    again = ledger.process_new(spark, data, spark.createDataFrame(log, LOG), str(tmp_path / "l"), item_offsets=16)
    assert again.count() == 0 and again.columns == data.columns
    assert ledger.process_new(spark, data.limit(0), spark.createDataFrame([], LOG), str(tmp_path / "e")).count() == 0


def test_growing_data_crashes_and_late_writers(spark, tmp_path, monkeypatch):
    """Every record comes out once over all runs, each run returns its own, whatever happens between write and commit."""
    root, now, seen = str(tmp_path / "l"), [0.0], []
    log = spark.createDataFrame([("t", 0, "succeeded", 0, 3)], LOG)
    data = lambda n: spark.createDataFrame([(t, p, o) for t, p in (("t", 0), ("t", None), (None, 1)) for o in range(n)] + [("t", 0, None)], "topic string, partition int, offset long")
    whole = lambda n: sorted([(t, p, o) for t, p in (("t", 0), ("t", None), (None, 1)) for o in range(n) if (t, p) != ("t", 0) or o > 3], key=repr)
    run = lambda n: rows_of(ledger.process_new(spark, data(n), log, root, 8, lambda: now[0], 5.0))
    seen += run(10)
    assert seen == whole(10)
    assert run(10) == []
    # a run that dies after it has written and before it commits
    plain = ledger.Ledger.commit
    monkeypatch.setattr(ledger.Ledger, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        run(20)
    monkeypatch.setattr(ledger.Ledger, "commit", plain)
    led = ledger.Ledger(spark, root, lambda: now[0])
    held = {i.name: i for lane in led.lanes() for i in led.chain(lane) if led.state(i) == "leased"}
    assert held and run(20) == []  # its leases still hold
    now[0] = 6.0
    second = run(25)
    seen += second
    assert sorted(seen, key=repr) == whole(25) and len(second) == len(whole(25)) - len(whole(10))
    # the first writer comes back: it may write, but not commit, and nobody reads what it wrote
    for i in held.values():
        stale = ledger.Lease(i, 1, 5.0)
        ledger.write_items(led, data(25), [stale], 8)
        with pytest.raises(ledger.StaleWriter):
            led.commit(stale)
    assert run(25) == []
    assert rows_of(led.read(led.done(), data(1).schema)) == whole(25)
    # a log that caught up with the ledger changes nothing, one that is ahead is followed
    log = spark.createDataFrame([("t", 0, "succeeded", 0, 27), ("t", None, "succeeded", 0, 24)], LOG)
    assert run(30) == sorted([("t", 0, 28), ("t", 0, 29)] + [(t, p, o) for t, p in (("t", None), (None, 1)) for o in range(25, 30)], key=repr)


def test_two_planners_never_overlap(spark, tmp_path):
    led = ledger.Ledger(spark, str(tmp_path / "l"))
    led.add("t", 0, 5, 9, 100)
    led.add("t", 0, 7, 14, 100)  # planned at the same time, with other ends
    led.add("t", 0, 0, 14, 100)
    assert [(i.from_offset, i.to_offset) for i in led.chain(led.lane("t", 0))] == [(5, 9), (10, 14)]
    assert led.lane("t/1", 0) != led.lane("t_1", 0) != led.lane("t", None)
    # a planner that died before it filled the file
    lane = led.lane("u", 0)
    led.fs.create(led._path(f"{led._folder(lane, 1)}/item"), False).close()
    led.add("u", 0, 0, 3, 100)
    assert [(i.from_offset, i.to_offset) for i in led.chain(lane)] == [(0, 3)]


def test_leases_expire_and_old_tokens_are_rejected(spark, tmp_path):
    now = [100.0]
    led = ledger.Ledger(spark, str(tmp_path / "led"), lambda: now[0])
    led.add("i", 0, 1, 9)
    led.add("i", 0, 2, 9)
    (i,) = led.chain(led.lane("i", 0))
    assert i.from_offset == 1 and led.state(i) == "pending"
    old = led.lease(i, 10)
    assert led.state(i) == "leased" and led.lease(i, 10) is None
    now[0] += 11
    assert led.state(i) == "pending"
    new = led.lease(i, 10)
    assert new.token > old.token
    with pytest.raises(ledger.StaleWriter):
        led.commit(old)
    led.commit(new)
    assert led.state(i) == "done" and led.lease(i, 10) is None
    with pytest.raises(ledger.StaleWriter):
        led.commit(new)
    led.advance(i.lane)
    assert led._base(i.lane) == 1 and led.chain(i.lane) == [i]


def test_context_flags(spark):
    rng = random.Random(11)
    rows, o = [], 0
    for day in range(6):
        for t in range(0, 1440, 6):
            o += 1
            hour = t // 60
            rows.append((0, o, "a", minutes(day * 1440 + t), 100.0 * (1 + hour) + rng.uniform(-5, 5)))
            rows.append((1, o, "flat", minutes(day * 1440 + t), 7.0))
    spike = {900: 50_000.0, 905: float("nan"), 1010: float("inf"), 30: -9_000.0}
    rows = [(p, k, s, t, spike.get(k, v) if s == "a" else v) for p, k, s, t, v in rows]
    df = spark.createDataFrame(rows + rows[:50] + [(2, 1, None, minutes(0), None)], READ)
    got = {(r.partition, r.offset): r for r in spikes.context_flags(df, ["src"], "ts", [spikes.Field("v")], context_hours=1).collect()}
    assert {k[1] for k, r in got.items() if k[0] == 0 and r.outside} == set(spike)
    assert got[0, 900].jump and got[0, 901].jump and not got[0, 900].flat
    assert all(r.flat and not r.outside and not r.jump for k, r in got.items() if k[0] == 1)
    assert sum(k[0] == 1 for k in got) == 6 * 240
    assert spikes.context_flags(spark.createDataFrame([], READ), ["src"], "ts", [spikes.Field("v")]).count() == 0


def test_context_flags_keep_every_hour_apart_by_default(spark):
    # stuck in one hour of each day, moving in the other hours of its six; and a reading that only its own hour finds strange
    rows = [(0, 100 * d + 10 * h + m, "a", minutes(1440 * d + 60 * h + 5 * m), 7.0 if h == 2 else 50.0 * (h + 1) + m) for d in range(3) for h in range(6) for m in range(10)]
    rows = [(*r[:4], 203.0 if r[1] == 105 else r[4]) for r in rows] + [(1, 1, "a", None, 7.0)]
    got = spikes.context_flags(spark.createDataFrame(rows, READ), ["src"], "ts", [spikes.Field("v")]).collect()
    assert {(r.partition, r.offset) for r in got if r.flat} == {(0, 100 * d + 20 + m) for d in range(3) for m in range(10)}
    assert {(r.partition, r.offset) for r in got if r.outside} == {(0, 105)}


def test_fences_of_all_fields_and_tables(spark, sf):
    from millrace.queries import problems

    got = problems.p4_fences(spark, sf)
    seen = {(r.tbl, r.field): r.n for r in got.groupBy("tbl", "field").agg(F.sum("n").alias("n")).collect()}
    prc = spark.read.parquet(f"{sf}/prc.parquet").dropDuplicates(["partition", "offset"])
    for f in ("dmemory", "dreductions", "message_queue_len"):
        v = F.col(f).cast("double")
        assert seen["prc", f] == prc.where(~F.isnan(v) & (F.abs(v) < float("inf"))).count()
    assert set(seen) == {("prc", "dmemory"), ("prc", "dreductions"), ("prc", "message_queue_len"), ("app_top", "value")}
    assert got.where("tbl = 'prc' AND node IS NULL").count() == 0 or prc.where("node IS NULL").count() > 0


def test_late_records_go_through_a_correction(spark, tmp_path, monkeypatch):
    from millrace.queries import problems

    # in order, out of order within the cut-off, past it, without a time, delivered again
    rows = [(0, 0, minutes(0), 1), (0, 1, minutes(50), 5), (0, 2, minutes(40), 2), (0, 3, minutes(10), 9), (0, 4, None, 7), (0, 2, minutes(40), 2), (0, 5, minutes(50), 5)]
    df = spark.createDataFrame([("n", "a", "u", *r) for r in rows], "node string, application string, unit string, partition int, offset long, ts timestamp_ntz, value long")
    df.write.parquet(str(tmp_path / "app_top.parquet"))
    marked = {r.offset: (r.is_late, r.behind) for r in late.mark_late(df, behind="behind").collect()}
    assert marked == {0: (False, False), 1: (False, False), 2: (False, True), 3: (True, True), 4: (False, False), 5: (False, False)}
    given, plain = [], late.correct
    monkeypatch.setattr(late, "correct", lambda st, more, *a: (given.append((st, more)), plain(st, more, *a))[1])
    out = problems.p2_method(spark, str(tmp_path)).collect()
    assert [(r.n_records, r.n_distinct, r.total, r.min_value, r.max_value, r.median) for r in out] == [(4, 3, 13, 1, 5, 2)]
    (state, more), = given
    assert [(r.value, r.cnt) for r in state.orderBy("value").collect()] == [(1, 1), (5, 2)]
    assert [(r.value, r.cnt) for r in more.collect()] == [(2, 1)]


def test_readings_without_an_identifier_are_no_copies(spark):
    rows = [(None, None, "a", minutes(i), 5.0) for i in range(9)] + [(0, None, "a", minutes(20), 3.0), (0, None, "a", minutes(20), 3.0), (1, 1, "a", minutes(21), 3.0), (1, 1, "a", minutes(21), 3.0)]
    df = spark.createDataFrame(rows, READ)
    assert spikes.readings(df, ["src"], "ts", [spikes.Field("v")], 3600).count() == 12
    assert spikes.flag_readings(df, ["src"], "ts", [spikes.Field("v")]).where("stuck").count() == 9

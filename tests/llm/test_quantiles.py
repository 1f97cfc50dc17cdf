from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from millrace.llm import quantiles

SCHEMA = "partition int, offset long, node string, day string, memory long, q long, value string"


def test_percentiles_within_the_stated_error_and_combinable(spark):
    rng = random.Random(1)
    rows = [(0, i, rng.choice(["a", "b", None]), rng.choice("xy"), rng.choice([0, 5, None, int(10 ** rng.uniform(0, 18)), -int(10 ** rng.uniform(0, 9))]), 3, "v") for i in range(1500)]
    rows += [(0, 9000, "c", "x", 2**63 - 1, 1, ""), (0, 9001, "c", "x", -(2**63), 1, "")]
    df = spark.createDataFrame(rows + rows[:200], SCHEMA)
    days = quantiles.state(df, [F.col("node"), F.col("day")], ["memory", "q"], ident=["partition", "offset"])
    parts = [quantiles.state(df.where(F.col("day") == d), [F.col("node")], ["memory", "q"], ident=["partition", "offset"]) for d in "xy"]
    whole = quantiles.state(df, [F.col("node")], ["memory", "q"], ident=["partition", "offset"])
    qs = [0.5, 0.9, 0.999]
    both = {tuple(r) for r in quantiles.percentiles(quantiles.combine(*parts), qs).collect()}
    assert both == {tuple(r) for r in quantiles.percentiles(whole, qs).collect()}
    got = {(r.g0, r.g1, r.field, r.q): r for r in quantiles.percentiles(days, qs).collect()}
    for (g, d, f, q), r in got.items():
        v = sorted(x[4 if f == "memory" else 5] for x in rows if x[2] == g and x[3] == d and x[4 if f == "memory" else 5] is not None)
        exact = v[max(math.ceil(q * len(v)), 1) - 1]
        assert r.n_rows == len(v) and abs(r.value - exact) <= 0.0005 * abs(exact) + 0.5 * (abs(exact) >= 10**4)
    assert {k[0] for k in got} == {"a", "b", "c", None}


def test_cells_are_monotone(spark):
    v = sorted({s * x for x in [*range(0, 30000, 7), *(10**k + d for k in range(3, 18) for d in (-1, 0, 1))] for s in (-1, 1)})
    df = spark.createDataFrame([(x,) for x in v], "v long")
    cells = [r.c for r in quantiles.with_cell(df, "v", "c").orderBy("v").collect()]
    assert cells == sorted(cells)
    assert all(c == x for c, x in zip(cells, v, strict=True) if abs(x) < 10**4)


def test_empty(spark):
    st = quantiles.state(spark.createDataFrame([], SCHEMA), [F.col("node")], ["memory"], ident=["partition", "offset"])
    assert quantiles.percentiles(st, [0.5]).count() == 0


def test_rows_without_an_identifier_count_each(spark):
    rows = [(None, None, "a", "x", m, 3, "") for m in (1, 1, 2)] + [(0, None, "a", "x", 4, 3, "")] * 2 + [(0, 7, "a", "x", 5, 3, "")] * 3
    st = quantiles.state(spark.createDataFrame(rows, SCHEMA), [F.col("node")], ["memory"], ident=["partition", "offset"])
    assert {r.value: r.cnt for r in st.collect()} == {1: 2, 2: 1, 4: 2, 5: 1}

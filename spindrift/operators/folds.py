"""Folds over ordered groups of any size: recursive filters, clamped walks, state machines.

Rows are dealt by ranges of group and order, so that a large group lies in many blocks. A block's rows together
are one function of the state that enters it, and the functions of these folds have a short form (a line, a
shifted clamp, a table of states). A group's blocks hand on their states by these forms, a row for each
block; then all blocks run side by side. No group has to fit in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spindrift.operators import storage

#: Rows that a block has about.
BLOCK = 250_000


@dataclass(frozen=True)
class Fold:
    """start: the state before the first row, as numbers. short(columns): a block's function as numbers.
    after(state, short): the state behind the block. run(state, columns): the outputs, in their order."""

    start: tuple[float, ...]
    short: Callable[[dict[str, np.ndarray]], Sequence[float]]
    after: Callable[[Sequence[float], Sequence[float]], Sequence[float]]
    run: Callable[[Sequence[float], dict[str, np.ndarray]], dict[str, Sequence]]


def folded(df: DataFrame, by: list[str], order: list[str], inputs: dict[str, Column], fold: Fold, outputs: str, block: int = BLOCK) -> DataFrame:
    """(by, position, outputs) for each row of df: position in the group from 0, ascending by order, then by the inputs."""
    rows = df.select(*by, *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], *[c.alias(f"in_{n}") for n, c in inputs.items()])
    ranks, names = [c for c in rows.columns if c not in by], list(inputs)
    ranges = max(1, -(-rows.count() // block))
    ranged = storage.materialize(rows.repartitionByRange(ranges, *by, *ranks).withColumn("part", F.spark_partition_id()), "ranges")
    keys = T.StructType([T.StructField("part", T.IntegerType()), *[rows.schema[c] for c in by]])
    key_names = ["part", *by]

    def columns(table: pa.Table) -> dict[str, np.ndarray]:
        table = table.sort_by([(c, "ascending") for c in ranks])
        return {n: table.column(f"in_{n}").to_numpy() for n in names}

    def keyed(key, schema: pa.Schema, n: int, made: dict) -> pa.Table:
        return pa.table([*(pa.array([k.as_py()] * n, schema.field(c).type) for k, c in zip(key, key_names, strict=True)), *(pa.array(x, schema.field(c).type) for c, x in made.items())], schema=schema)

    short_type = T.StructType([*keys, T.StructField("n", T.LongType()), T.StructField("short", T.ArrayType(T.DoubleType()))])
    short_arrow = to_arrow_schema(short_type)

    def shorten(key, table):
        return keyed(key, short_arrow, 1, {"n": [table.num_rows], "short": [[float(x) for x in fold.short(columns(table))]]})

    enter_type = T.StructType([*keys, T.StructField("offset", T.LongType()), T.StructField("state", T.ArrayType(T.DoubleType()))])
    enter_arrow = to_arrow_schema(enter_type)

    def hand_on(key, table):
        table = table.sort_by("part")
        states, offsets, state, n = [], [], fold.start, 0
        for size, short in zip(table.column("n").to_pylist(), table.column("short").to_pylist(), strict=True):
            states.append([float(x) for x in state])
            offsets.append(n)
            state, n = fold.after(state, short), n + size
        return pa.table([*(table.column(c) for c in key_names), pa.array(offsets, pa.int64()), pa.array(states, pa.list_(pa.float64()))], schema=enter_arrow)

    out_type = T.StructType([*keys, T.StructField("position", T.LongType()), *T._parse_datatype_string(outputs)])
    out_arrow = to_arrow_schema(out_type)

    def run(key, table, entry):
        n = table.num_rows
        if not n:
            return out_arrow.empty_table()
        first = entry.column("offset")[0].as_py()
        return keyed(key, out_arrow, n, {"position": np.arange(first, first + n), **fold.run(entry.column("state")[0].as_py(), columns(table))})

    shorts = ranged.groupBy(*key_names).applyInArrow(shorten, short_type)
    entries = shorts.groupBy(*by).applyInArrow(hand_on, enter_type) if by else shorts.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(lambda key, table: hand_on(key, table.drop_columns("all")), enter_type)
    return ranged.groupBy(*key_names).cogroup(entries.groupBy(*key_names)).applyInArrow(run, out_type).drop("part")


def low_pass(gain: float, start: float) -> Fold:
    """y = y + gain (x - y): a block's function is a line."""

    def walk(y, xs):
        out = np.empty(len(xs))
        for i, x in enumerate(xs.tolist()):
            y = y + gain * (x - y)
            out[i] = y
        return out

    def short(c):
        return [(1 - gain) ** len(c["x"]), walk(0.0, c["x"])[-1]]

    return Fold((start,), short, lambda s, f: [f[0] * s[0] + f[1]], lambda s, c: {"filtered": walk(s[0], c["x"])})


def clamped_walk(low: float, high: float, start: Sequence[float], names: Sequence[str]) -> Fold:
    """Each name's coordinate moved by its column and kept in low..high: a block's function is a shift between two bounds."""

    def short(c):
        out = []
        for name in names:
            shift, least, most = 0.0, -np.inf, np.inf
            for d in c[name].tolist():
                shift, least, most = shift + d, min(high, max(low, least + d)), min(high, max(low, most + d))
            out += [shift, least, most]
        return out

    def after(s, f):
        return [min(f[3 * i + 2], max(f[3 * i + 1], x + f[3 * i])) for i, x in enumerate(s)]

    def run(s, c):
        made = {}
        for x, name in zip(s, names, strict=True):
            path = []
            for d in c[name].tolist():
                x = min(high, max(low, x + d))
                path.append(x)
            made[name] = path
        return made

    return Fold(tuple(start), short, after, run)


def machine(states: Sequence, first, step: Callable, inputs: Sequence[str], outputs: Callable) -> Fold:
    """step(state, *inputs) -> state over finitely many states: a block's function is a table.

    outputs(before, after, *inputs) -> dict of what a row gives.
    """
    place = {s: i for i, s in enumerate(states)}

    def short(c):
        rows = list(zip(*(c[n].tolist() for n in inputs), strict=True))
        out = []
        for s in states:
            for row in rows:
                s = step(s, *row)
            out.append(place[s])
        return out

    def run(s, c):
        state, made = states[int(s[0])], []
        for row in zip(*(c[n].tolist() for n in inputs), strict=True):
            before, state = state, step(state, *row)
            made.append(outputs(before, state, *row))
        return {name: [m[name] for m in made] for name in made[0]}

    return Fold((place[first],), short, lambda s, f: [f[int(s[0])]], run)

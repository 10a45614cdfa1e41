"""Stateful simulation streams: a session's neural state, delay ring and clock survive between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from spindrift.operators.events import Adjacency, Lif, Simulator, State

STEPS = "session string, chunk long, step long, spikes long, total long"


def dump(s: State) -> bytes:
    """A state as the bytes of its arrays; spikes on their way as (step, neuron) pairs."""
    pending = np.array([(k, i) for k, v in sorted(s.pending.items()) for i in v], np.int64).reshape(-1, 2)
    head = np.array([s.step, len(s.v), len(pending)], np.int64)
    return b"".join(x.tobytes() for x in (head, s.v, s.g, s.refractory, pending))


def load(data: bytes) -> State:
    step, n, m = np.frombuffer(data, np.int64, 3).tolist()
    parts = [np.frombuffer(data, t, n, 24 + 8 * n * k).copy() for k, t in enumerate((np.float64, np.float64, np.int64))]
    pending: dict[int, list[int]] = {}
    for k, i in np.frombuffer(data, np.int64, 2 * m, 24 + 24 * n).reshape(-1, 2).tolist():
        pending.setdefault(k, []).append(i)
    return State(step, *parts, pending)


def simulate(commands: DataFrame, graph: Adjacency, config: Lif = Lif(), amplitude: float = 8.0) -> DataFrame:
    """STEPS rows for each command (session, chunk, duration_s, pulses: array of neuron and step in the chunk) of a stream.

    A chunk advances its session's state; results are those of one uninterrupted run. Chunks that arrive
    again are ignored. One session's micro-batch is worked in one task, different sessions in parallel.
    """
    shared = commands.sparkSession.sparkContext.broadcast(graph)  # size chosen by the caller, see collect_graph

    def work(key: tuple, frames: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        sim = Simulator(shared.value, config)
        state, last, total = sim.fresh(), -1, 0
        if kept.exists:
            data, last, total = kept.get
            state = load(bytes(data))
        rows = []
        for row in pd.concat(list(frames)).sort_values("chunk").itertuples(index=False):
            if row.chunk <= last:
                continue
            pulses: dict[int, list[int]] = {}
            for p in row.pulses:
                pulses.setdefault(int(p["step"]), []).append(int(p["neuron"]))
            out = sim.advance(state, row.duration_s, {k: np.array(v, np.int64) for k, v in pulses.items()}, amplitude, max_events=0)
            last, total = row.chunk, total + out["spikes"]
            rows.append((key[0], row.chunk, state.step, out["spikes"], total))
        kept.update((dump(state), int(last), int(total)))
        yield pd.DataFrame(rows, columns=["session", "chunk", "step", "spikes", "total"])

    return commands.groupBy("session").applyInPandasWithState(work, STEPS, "state binary, chunk long, total long", "append", "NoTimeout")

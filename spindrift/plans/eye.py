"""From what is on a screen to the network's answer: one visual position to features, a pixel sequence to motor ticks.

Frames become column samples as DataFrame operators do it; what follows a condition through time (filters, delayed
drives, spiking) is one task per condition. Graph and eye go to executors as broadcasts of checked size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators import events, signals, storage, vision

KINDS = ("l1", "l2", "l3")


@dataclass(frozen=True)
class Eye:
    """Columns of an eye with their directions and the source neuron of each kind (-1: none).

    directions: (key, forward, right, up); sources: key -> {kind: neuron}. most: columns that may be broadcast.
    """

    keys: tuple[int, ...]
    directions: tuple[tuple[float, float, float], ...]
    sources: tuple[dict[str, int], ...]
    field_deg: tuple[float, float] = (120.0, 90.0)
    most: int = 100_000

    def __post_init__(self):
        if not len(self.keys) == len(self.directions) == len(self.sources) or len(set(self.keys)) != len(self.keys):
            raise ValueError("an eye has a direction and a cartridge for each of its different columns")
        if len(self.keys) > self.most:
            raise ValueError(f"{len(self.keys)} columns; at most {self.most} fit a broadcast")

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(k, *map(float, d)) for k, d in zip(self.keys, self.directions, strict=True)], "key long, forward double, right double, up double")


@dataclass(frozen=True)
class Protocol:
    """Frames before, during and after a stimulus, and how signals become drives."""

    before: int = 2
    during: int = 4
    after: int = 2
    vision: signals.EarlyVision = signals.EarlyVision(frame_rate_hz=100.0)
    gain: float = 2.0
    epsilon: float = 0.01
    factor: float = 0.05
    delay_ms: float = 1.8

    @property
    def frames(self) -> int:
        return self.before + self.during + self.after

    def seconds(self, frames: int) -> float:
        return frames / self.vision.frame_rate_hz


def column_samples(frames: DataFrame, eye: Eye, screen: vision.Screen, per_sequence: int) -> DataFrame:
    """(condition, key, frame, intensity) of frames (condition, frame, y, x, intensity) at the eye's visible columns.

    condition is a whole number; sequences have per_sequence frames at most.
    """
    numbered = frames.withColumn("frame", F.col("condition") * per_sequence + F.col("frame")).drop("condition")
    seen = vision.encode(numbered, eye.table(frames.sparkSession), screen.width, screen.height, eye.field_deg, 1.0)
    at = F.col("frame")
    return seen.select(F.floor(at / per_sequence).alias("condition"), "key", F.pmod(at, F.lit(per_sequence)).cast("long").alias("frame"), "intensity")


def luminance(table: pa.Table, eye: Eye, frames: int, background: float) -> np.ndarray:
    """frames x columns from rows (key, frame, intensity); columns off the screen stay at the background."""
    place = {k: i for i, k in enumerate(eye.keys)}
    out = np.full((frames, len(eye.keys)), background)
    for key, frame, x in zip(table.column("key").to_pylist(), table.column("frame").to_pylist(), table.column("intensity").to_pylist(), strict=True):
        if key is not None:
            out[frame, place[key]] = x
    return out


def lamina_drives(shown: np.ndarray, eye: Eye, protocol: Protocol, graph: events.Adjacency) -> list[events.Drive]:
    """Delayed drives of the lamina's sources on their targets; channels that stay silent are left out."""
    traces = signals.graded_traces(shown, protocol.vision)
    delay = round(protocol.delay_ms / protocol.vision.dt_ms)
    out = []
    for kind in KINDS:
        signal = np.clip(traces[kind] / protocol.gain, -1, 1)
        amplitude = np.where(np.abs(signal) <= protocol.epsilon, 0.0, signal) * protocol.factor
        late = np.zeros_like(amplitude)
        late[delay:] = amplitude[: len(amplitude) - delay]
        for column, sources in enumerate(eye.sources):
            source = sources.get(kind, -1)
            if source >= 0 and graph.sign[source] and late[:, column].any():
                own = slice(graph.start[source], graph.start[source + 1])
                out.append(events.Drive(graph.target[own], graph.count[own] * float(graph.sign[source]), late[:, column]))
    return out


def signed_peak(trace: np.ndarray) -> np.ndarray:
    """The largest excursion of each column of a trace; of equal sizes the positive one."""
    high, low = trace.max(0), trace.min(0)
    return np.where(np.abs(high) >= np.abs(low), high, low)


def _watched(out: dict, watch: tuple[int, ...], config: events.Lif) -> tuple[np.ndarray, np.ndarray]:
    """(voltage over rest, drive), steps x watch, of a run's trace."""
    both = np.array([(v - config.resting, g) for _, _, v, g in out["trace"]]).reshape(-1, len(watch), 2)
    return both[:, :, 0], both[:, :, 1]


FEATURES = "condition long, neuron_index int, voltage double, drive double, spikes long, temporal_voltage array<double>, temporal_drive array<double>, total_spikes long"


def position_features(conditions: DataFrame, eye: Eye, screen: vision.Screen, protocol: Protocol, graph: events.Adjacency, watch: tuple[int, ...], bins: int = 0, config: events.Lif = events.Lif(), clamped: tuple[int, ...] = ()) -> DataFrame:
    """FEATURES of each watched neuron in each condition (condition, kind, axis, position): signed peaks from the stimulus on, spikes over
    the whole run, and the peaks in bins parts of that time. A condition that drives nothing raises."""
    spark = conditions.sparkSession
    shared = spark.sparkContext.broadcast((eye, graph))
    samples = column_samples(vision.condition_frames(conditions, screen, protocol.before, protocol.during, protocol.after), eye, screen, protocol.frames)

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        eye, graph = shared.value
        drives = lamina_drives(luminance(table, eye, protocol.frames, screen.background), eye, protocol, graph)
        if not drives:
            raise ValueError("the stimulus makes no drive")
        sim = events.Simulator(graph, config, clamped=clamped)
        out = sim.advance(sim.fresh(), protocol.seconds(protocol.frames), drives=drives, watch=watch, max_events=0)
        v, g = _watched(out, watch, config)
        first = round(protocol.seconds(protocol.before) * 1000 / config.dt)
        v, g = v[first:], g[first:]
        parts = np.array_split(np.arange(len(v)), bins) if bins else []
        temporal = [[signed_peak(x[p]) for p in parts] for x in (v, g)]
        n = len(watch)
        by_neuron = lambda rows: pa.array([[float(r[i]) for r in rows] for i in range(n)], pa.list_(pa.float64()))
        return pa.table({"condition": pa.array([key[0].as_py()] * n, pa.int64()), "neuron_index": pa.array(watch, pa.int32()), "voltage": signed_peak(v), "drive": signed_peak(g), "spikes": pa.array(out["counts"][list(watch)], pa.int64()), "temporal_voltage": by_neuron(temporal[0]), "temporal_drive": by_neuron(temporal[1]), "total_spikes": pa.array([out["spikes"]] * n, pa.int64())})

    return storage.dealt(samples, "condition", conditions.count()).groupBy("condition").applyInArrow(work, FEATURES)


def receptor_drives(shown: np.ndarray, groups: tuple[tuple[int, ...], ...], protocol: Protocol, graph: events.Adjacency) -> list[events.Drive]:
    """Delayed drives of each column's photoreceptors on their targets, by how far release departs from that at the background."""
    vision_ = protocol.vision
    release = signals.graded_traces(shown, vision_)["release"] - (vision_.tonic + (1 - vision_.tonic) * vision_.background)
    delay = round(protocol.delay_ms / vision_.dt_ms)
    signal = np.clip(release / protocol.gain, -1, 1)
    amplitude = np.zeros_like(signal)
    amplitude[delay:] = (np.where(np.abs(signal) <= protocol.epsilon, 0.0, signal) * protocol.factor)[: len(signal) - delay]
    out = []
    for column, group in enumerate(groups):
        for source in group if amplitude[:, column].any() else ():
            own = slice(graph.start[source], graph.start[source + 1])
            if graph.sign[source]:
                out.append(events.Drive(graph.target[own], graph.count[own] * float(graph.sign[source]), amplitude[:, column]))
    return out


TRACES = "condition long, step long, time_s double, neuron_index int, v double, g double, spikes long"


def position_traces(conditions: DataFrame, eye: Eye, screen: vision.Screen, protocol: Protocol, graph: events.Adjacency, watch: tuple[int, ...], receptors: tuple[tuple[int, ...], ...] | None = None, config: events.Lif = events.Lif(), clamped: tuple[int, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(TRACES of the watched neurons, samples (condition, key, frame, intensity)) of each condition; spikes: a neuron's over the whole run.

    The network is driven by the eye's lamina sources, or by receptors: a group of neurons for each column.
    """
    shared = conditions.sparkSession.sparkContext.broadcast((eye, graph))
    samples = column_samples(vision.condition_frames(conditions, screen, protocol.before, protocol.during, protocol.after), eye, screen, protocol.frames)

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        eye, graph = shared.value
        shown = luminance(table, eye, protocol.frames, screen.background)
        drives = lamina_drives(shown, eye, protocol, graph) if receptors is None else receptor_drives(shown, receptors, protocol, graph)
        sim = events.Simulator(graph, config, clamped=clamped)
        sim.check(drives)
        out = sim.advance(sim.fresh(), protocol.seconds(protocol.frames), drives=drives, watch=watch, max_events=0)
        step, neuron, v, g = (np.array(x) for x in zip(*out["trace"], strict=True))
        return pa.table({"condition": pa.array([key[0].as_py()] * len(step), pa.int64()), "step": pa.array(step, pa.int64()), "time_s": step * config.dt / 1000, "neuron_index": pa.array(neuron, pa.int32()), "v": v, "g": g, "spikes": pa.array(out["counts"][neuron], pa.int64())})

    return storage.dealt(samples, "condition", conditions.count()).groupBy("condition").applyInArrow(work, TRACES), samples


def position_samples(features: DataFrame, conditions: DataFrame) -> DataFrame:
    """(condition, axis, position, voltage, drive, spike, temporal_voltage, temporal_drive): a condition's features as arrays in the order of neurons."""
    packed = features.groupBy("condition").agg(F.sort_array(F.collect_list(F.struct("neuron_index", "voltage", "drive", F.col("spikes").cast("double").alias("spike"), "temporal_voltage", "temporal_drive"))).alias("n"))
    return packed.join(conditions.select("condition", "axis", "position"), "condition").select("condition", "axis", "position", *[F.col(f"n.{c}").alias(c) for c in ("voltage", "drive", "spike", "temporal_voltage", "temporal_drive")])


TICKS = "condition long, tick int, start_s double, end_s double, spikes long, rates map<string,double>, voltages map<string,double>, dx double, dy double, click boolean, peak_mv double"


def motor_sequence(samples: DataFrame, frames: int, eye: Eye, background: float, protocol: Protocol, graph: events.Adjacency, populations: dict[str, tuple[int, ...]], chunk_ms: float, gain: float = 0.01, most: float = 0.5, click_hz: float = 20.0, config: events.Lif = events.Lif(), clamped: tuple[int, ...] = (), connected: bool = True) -> DataFrame:
    """TICKS of each condition of samples (condition, key, frame, intensity): chunks of a run whose state carries over, each decoded to a motor command.

    populations: left, right, up, down and click, as far as there are any. connected=False runs without the eye's drives. A
    non-finite state raises. The chunks of a condition give what one uninterrupted run gives.
    """
    shared = samples.sparkSession.sparkContext.broadcast((eye, graph))
    watch = tuple(sorted({i for members in populations.values() for i in members}))
    place = {i: k for k, i in enumerate(watch)}

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        eye, graph = shared.value
        drives = lamina_drives(luminance(table, eye, frames, background), eye, protocol, graph) if connected else []
        sim = events.Simulator(graph, config, clamped=clamped)
        state, per, end = sim.fresh(), config.steps(chunk_ms), config.steps(protocol.seconds(frames) * 1000)
        if per < 1:
            raise ValueError("a chunk has a step or more")
        rows, tick = [], 0
        while state.step < end:
            at, n = state.step, min(per, end - state.step)
            seconds = n * config.dt / 1000
            out = sim.advance(state, seconds, drives=[events.Drive(d.targets, d.weights, d.amplitude[at : at + n]) for d in drives], watch=watch, max_events=0)
            if not (np.isfinite(state.v).all() and np.isfinite(state.g).all()):
                raise ValueError("non-finite state")
            v, _ = _watched(out, watch, config)
            rates = {name: float(out["counts"][list(members)].sum() / len(members) / seconds) for name, members in populations.items()}
            volts = {name: float(np.mean([v[-1, place[i]] for i in members])) for name, members in populations.items()}
            moved = lambda plus, minus: max(-most, min(most, (rates.get(plus, 0.0) - rates.get(minus, 0.0)) * gain))  # noqa: B023, E731
            rows.append((key[0].as_py(), tick, at * config.dt / 1000, (at + n) * config.dt / 1000, out["spikes"], list(rates.items()), list(volts.items()), moved("right", "left"), moved("down", "up"), rates.get("click", 0.0) >= click_hz, float(np.abs(v).max())))
            tick += 1
        types = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.map_(pa.string(), pa.float64()), pa.map_(pa.string(), pa.float64()), pa.float64(), pa.float64(), pa.bool_(), pa.float64())
        return pa.table({f.split()[0]: pa.array([r[i] for r in rows], t) for i, (f, t) in enumerate(zip(("condition", "tick", "start_s", "end_s", "spikes", "rates", "voltages", "dx", "dy", "click", "peak_mv"), types, strict=True))})

    return storage.dealt(samples.select("condition", "key", "frame", "intensity"), "condition").groupBy("condition").applyInArrow(work, TICKS)


def sequence_summary(ticks: DataFrame) -> DataFrame:
    """(condition, ticks, duration_s, spikes, peak_mv, motor_nonzero) of each sequence."""
    return ticks.groupBy("condition").agg(F.count("*").alias("ticks"), F.max("end_s").alias("duration_s"), F.sum("spikes").alias("spikes"), F.max("peak_mv").alias("peak_mv"), F.bool_or((F.col("dx") != 0) | (F.col("dy") != 0)).alias("motor_nonzero"))

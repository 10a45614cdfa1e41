"""Experiments: populations, conditions, parallel simulation, metrics, gates. Each is one composition of operators."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators import decode, events, graph, metrics, populations, signals, storage
from spindrift.plans.dataset import Dataset


@dataclass(frozen=True)
class Characterization:
    """Inputs x amplitudes x durations x repeats, with controls. Times in seconds."""

    amplitudes: tuple[float, ...] = (8.0,)
    durations_ms: tuple[float, ...] = (50.0,)
    repeats: int = 1
    start_s: float = 0.01
    end_s: float = 0.1
    interval_s: float = 0.01
    gates: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)


def characterize(data: Dataset, inputs: DataFrame, outputs: DataFrame, plan: Characterization, config: events.Lif = events.Lif()) -> dict[str, DataFrame]:
    """responses, repeats and similarity of output populations to input populations (key, neuron_index).

    Conditions are simulated in parallel, one task each; amplitudes go by run as they are one per run.
    """
    spark = inputs.sparkSession
    graph_arrays = events.collect_graph(data.neurons, data.edges)
    conditions = populations.cross_conditions(inputs.select("key").distinct(), list(plan.amplitudes), list(plan.durations_ms), plan.repeats)
    runs = None
    for amplitude in (*plan.amplitudes, 0.0):
        some = conditions.where(F.col("amplitude") == amplitude)
        per = plan.interval_s
        n = F.floor(F.col("duration_ms") / 1000 / per + 1e-9).cast("int")
        pulses = some.join(inputs, F.col("input_key") == F.col("key"), "left").withColumn("k", F.explode_outer(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
        stimuli = pulses.select(F.col("condition_id").alias("condition"), F.when(F.col("k").isNotNull(), F.col("neuron_index")).cast("int").alias("neuron_index"), (F.lit(plan.start_s) + F.col("k") * per).alias("time_s"))
        out = events.run_conditions(graph_arrays, stimuli, plan.end_s, config, amplitude)
        runs = out if runs is None else runs.unionByName(out)
    spikes = storage.materialize(runs.where("step is not null"), "spikes").withColumn("time_s", F.col("step") * config.dt / 1000)
    members = outputs.groupBy("key").agg(F.count("*").alias("members"))
    seen = spikes.join(outputs.select(F.col("key").alias("output"), "neuron_index"), "neuron_index")
    named = seen.select(F.concat_ws("|", "condition", "output").alias("population"), F.col("neuron_index").alias("neuron"), "time_s")
    grid = conditions.crossJoin(members).select(F.concat_ws("|", "condition_id", "key").alias("population"), "members")
    stop = plan.start_s + max(plan.durations_ms) / 1000
    responses = metrics.response(named, grid, plan.start_s, min(stop, plan.end_s), plan.end_s)
    signature = spikes.groupBy("condition").agg(F.sum(F.xxhash64("step", "neuron_index").cast("decimal(38,0)")).alias("signature"))
    repeats = conditions.join(signature, F.col("condition_id") == F.col("condition"), "left").select(F.coalesce("input_key", F.lit("control")).alias("input"), "amplitude", "duration_ms", "repeat", F.coalesce(F.col("signature").cast("string"), F.lit("none")).alias("signature"))
    patterns = seen.groupBy(F.col("condition").alias("run"), F.col("neuron_index").alias("item")).agg(F.count("*").alias("count"))
    return {"conditions": conditions, "responses": responses, "repeats": metrics.repeats_agree(repeats, ["input", "amplitude", "duration_ms"], ("repeat",)), "similarity": metrics.similarity(patterns), "spikes": spikes, "session": spark.createDataFrame([(config.dt,)], "dt_ms double")}


def localize(data: Dataset, sources: DataFrame, targets: DataFrame, hops: int, paths: int = 12) -> dict[str, DataFrame]:
    """layers, edges, paths and a summary of shortest effective pathways from sources to targets (neuron_index)."""
    layers = storage.materialize(graph.path_layers(data.neurons, data.edges, sources, targets, hops), "layers")
    between = storage.materialize(graph.layer_edges(data.neurons, data.edges, layers), "layer_edges")
    ranked = graph.ranked_paths(layers, between, paths, hops)
    summary = layers.groupBy("target", "length").agg(F.count_if(F.col("layer").between(1, F.col("length") - 1)).alias("relays"), F.count("*").alias("nodes"))
    watch = layers.where("layer >= 1").select(F.col("node").alias("neuron_index")).distinct().join(sources, "neuron_index", "left_anti")
    return {"layers": layers, "edges": between, "paths": ranked, "summary": summary, "watch": watch}


def decode_axis(samples: DataFrame, modalities: dict[str, str], alphas: tuple[float, ...], components: tuple[int, ...], train: str = "train") -> DataFrame:
    """(modality, components, alpha, score): leave-one-out error per modality (a features column) and setting, best first."""
    spark, out = samples.sparkSession, None
    grid = spark.createDataFrame([(c, a, None) for c in components for a in alphas], "components int, alpha double, gamma double")
    for name, column in sorted(modalities.items()):
        rows = samples.where(train).select("row", F.col(column).alias("features"), "target")
        scored = decode.loocv(rows, grid).withColumn("modality", F.lit(name))
        out = scored if out is None else out.unionByName(scored)
    return out.orderBy("score", "components", "alpha", "modality")


def early_vision(luminance: DataFrame, config: signals.EarlyVision, gain: float, epsilon: float, factor: float, delay_ms: float) -> DataFrame:
    """(label, step, amplitude) drives of the three lamina channels from frames (channel, frame, luminance)."""
    traces = signals.graded_channels(luminance, config)
    long = traces.select(F.explode(F.array(*[F.struct(F.concat_ws("-", F.lit(c), "channel").alias("label"), "step", F.col(c).alias("signal")) for c in ("l1", "l2", "l3")])).alias("x")).select("x.*")
    return signals.drive_channels(long, gain, epsilon, factor, round(delay_ms / config.dt_ms))


def closed_loop(starts: DataFrame, classify, target: tuple[float, float], step: float = 0.05, tolerance: float = 0.07, most: int = 50, margin: float = 0.0) -> DataFrame:
    """(episode, step, x, y, distance): cursors of starts (episode, x, y) moved by classify(dx, dy) -> (score_x, score_y) until near the target.

    Episodes run in parallel, a task each. Moves follow the scores' signs; a reversal needs |score| of at
    least margin.
    """

    def run(pdf):
        import pandas as pd

        rows = []
        for e in pdf.itertuples(index=False):
            x, y, last = float(e.x), float(e.y), [0.0, 0.0]
            for k in range(most + 1):
                distance = float(np.hypot(target[0] - x, target[1] - y))
                rows.append((e.episode, k, x, y, distance))
                if distance <= tolerance:
                    break
                scores = classify(target[0] - x, target[1] - y)
                for i, s in enumerate(scores):
                    sign = float(np.sign(s))
                    last[i] = last[i] if last[i] and sign and sign != last[i] and abs(s) < margin else sign
                x, y = min(1.0, max(0.0, x + step * last[0])), min(1.0, max(0.0, y + step * last[1]))
        return pd.DataFrame(rows, columns=["episode", "step", "x", "y", "distance"])

    return storage.dealt(starts, "episode").groupBy("episode").applyInPandas(run, "episode long, step long, x double, y double, distance double")

"""Whole studies: mapping, screen geometry, readouts of positions, interventions, sensitivities, audits. Each is one composition."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import scalars as sc
from spindrift.operators import decode, events, features, graph, metrics, pathways, responses, signals, storage, vision
from spindrift.plans import eye as eyes
from spindrift.plans.dataset import Dataset


def retinotopic_mapping(data: Dataset, sources: DataFrame, official: DataFrame, typed: DataFrame, least: int, high: float, low: float, expected: int = 6) -> dict[str, DataFrame]:
    """assignments, counts, histograms and contact quantiles of sources (neuron_index) in official columns (column, body_id).

    A source's column is that of most contacts; how sure that is follows from least contacts and the fractions high and low.
    Sources without any candidate get the reason: no typed target at all, or none that is official.
    """
    columns = pathways.official_by_index(official, data.neurons)
    contacts, reach = pathways.column_contacts(data.edges, sources, columns, typed)
    inferred = metrics.infer_columns(contacts, least, high, low)
    reason = F.when(F.col("status").isNull(), F.when(F.col("any_typed"), "no official target").otherwise("no typed target"))
    out = reach.join(inferred, "source", "left").select("source", F.coalesce("status", F.lit("unmapped")).alias("status"), "column", F.coalesce("candidates", F.lit(0)).alias("candidates"), "contacts", reason.alias("reason"))
    out = storage.materialize(out, "assignments")
    quantiles = out.where("contacts is not null").agg(*[F.percentile("contacts", q).alias(f"p{round(q * 100):02d}") for q in (0.05, 0.5, 0.95)])
    return {"assignments": out, "counts": pathways.mapping_counts(out, expected), "status": out.groupBy("status").agg(F.count("*").alias("n")), "reasons": out.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")), "histograms": pathways.mapping_histograms(out), "contacts": quantiles}


def screen_geometry(spark, directions: DataFrame, screen: vision.Screen, positions: list[float], field_deg: tuple[float, float] = (120.0, 90.0)) -> dict[str, DataFrame]:
    """sweep and summary of a dark bar over the screen, per axis: contrast-weighted centroid of the columns' samples at each position,
    and its correlation with the position."""
    seen = directions.select("key", *sc.screen(F.col("forward"), F.col("right"), F.col("up"), *field_deg)).where("visible")
    out = None
    for axis, coordinate in (("horizontal", "u"), ("vertical", "v")):
        samples = vision.encode(vision.bar_frames(spark, axis, positions, screen), directions, screen.width, screen.height, field_deg, 1.0)
        weight = F.greatest(F.lit(0.0), screen.background - F.col("intensity"))
        per = samples.join(seen.select("key", F.col(coordinate).alias("c")), "key").groupBy("frame").agg(F.count_if(weight > 1e-9).alias("active"), F.try_divide(F.sum(F.col("c") * weight), F.sum(weight)).alias("centroid"))
        at = spark.createDataFrame([(i, float(p)) for i, p in enumerate(positions)], "frame int, position double")
        one = at.join(per, "frame", "left").select(F.lit(axis).alias("axis"), "position", "active", "centroid")
        out = one if out is None else out.unionByName(one)
    out = storage.materialize(out, "sweep")
    seen_n = seen.agg(F.count("*").alias("visible"))
    summary = out.groupBy("axis").agg(F.min("active").alias("least_active"), metrics.correlation(F.col("position"), F.col("centroid")).alias("correlation"))
    return {"sweep": out, "summary": summary.crossJoin(seen_n)}  # a row


def spatial_neural_vision(conditions: DataFrame, eye: eyes.Eye, screen: vision.Screen, protocol: eyes.Protocol, graph_arrays: events.Adjacency, receptors: tuple[tuple[int, ...], ...], targets: tuple[int, ...], config: events.Lif = events.Lif()) -> DataFrame:
    """metrics.condition_summary() of conditions (condition, kind, axis, position): what each column's target neuron does while photoreceptors see a bar."""
    spark = conditions.sparkSession
    traces, samples = eyes.position_traces(conditions, eye, screen, protocol, graph_arrays, tuple(sorted(set(targets))), receptors, config)
    start, stop = protocol.seconds(protocol.before), protocol.seconds(protocol.before + protocol.during)
    delta = F.col("v") - config.resting
    seen = traces.where((F.col("time_s") >= start) & (F.col("time_s") < stop)).groupBy("condition", "neuron_index").agg(F.max("g").alias("peak"), F.min("g").alias("low"), F.max(delta).alias("v_peak"), F.min(delta).alias("v_low"))
    rows = [(k, int(n), len(group)) for k, n, group in zip(eye.keys, targets, receptors, strict=True)]
    columns = spark.createDataFrame(rows, "key long, neuron_index int, sources int")  # the eye's columns
    places = eye.table(spark).select("key", *sc.screen(F.col("forward"), F.col("right"), F.col("up"), *eye.field_deg)).where("visible")
    means = vision.window_mean(samples, ["condition", "key"], protocol.before, protocol.during)
    joined = seen.join(F.broadcast(columns), "neuron_index").join(F.broadcast(places), "key").join(means, ["condition", "key"]).join(conditions, "condition")
    joined = joined.withColumns({"coordinate": F.when(F.col("axis") == "horizontal", F.col("u")).otherwise(F.col("v")), "background": F.lit(screen.background)})
    return metrics.condition_summary(joined)


def graded_lamina(conditions: DataFrame, eye: eyes.Eye, screen: vision.Screen, protocol: eyes.Protocol, graph_arrays: events.Adjacency, watch: tuple[int, ...], threshold: float, n: int = 10, config: events.Lif = events.Lif()) -> dict[str, DataFrame]:
    """summary and top of the watched neurons' peaks below threshold, over all conditions of a lamina-driven network."""
    traces = storage.materialize(eyes.position_traces(conditions, eye, screen, protocol, graph_arrays, watch, None, config)[0], "traces")
    return {"summary": responses.subthreshold(traces, "neuron_index", "v", "g", config.resting, threshold), "top": responses.subthreshold_top(traces, "neuron_index", "v", "g", config.resting, n), "traces": traces}


def early_vision_comparison(luminance: DataFrame, lif_trace: DataFrame, protocol: eyes.Protocol, rest: float) -> DataFrame:
    """(model, signal, windowed metrics): the graded model's lamina signals (median over channels) beside a spiking population's median voltage.

    luminance: channel, frame, luminance. lif_trace: time_s, neuron, v.
    """
    graded = signals.graded_channels(luminance, protocol.vision)
    long = graded.select((F.col("step") * protocol.vision.dt_ms / 1000).alias("time_s"), F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), F.col(k).alias("value")) for k in eyes.KINDS])).alias("x")).select("time_s", F.lit("graded").alias("model"), "x.signal", "x.value")
    spiking = lif_trace.select("time_s", F.lit("spiking").alias("model"), F.lit("voltage").alias("signal"), (F.col("v") - rest).alias("value"))
    both = metrics.median_trace(long.unionByName(spiking), ["model", "signal"], "time_s", "value")
    return metrics.windowed_signal(both, ["model", "signal"], "value", "time_s", protocol.seconds(protocol.before), protocol.seconds(protocol.before + protocol.during))


def motor_characterization(traces: DataFrame, populations: DataFrame, rest: float, plus: str, minus: str, limits: DataFrame) -> dict[str, DataFrame]:
    """members, populations, difference and gates of motor populations (population, neuron_index) in TRACES of conditions.

    limits: name, low, high of the gates; their names are population|condition, of the mean signed voltage peak.
    """
    members = features.window_features(traces, ["condition", "neuron_index"], "v", "g", rest).join(traces.select("condition", "neuron_index", "spikes").distinct(), ["condition", "neuron_index"]).join(populations, "neuron_index")
    peaks = responses.population_peaks(members, ["condition", "population"], "voltage", "drive", "spikes")
    named = peaks.select(F.concat_ws("|", "population", "condition").alias("name"), F.col("mean_voltage").alias("value"))
    return {"members": members, "populations": peaks, "difference": responses.channel_difference(peaks, ["condition"], "population", "mean_voltage", plus, minus), "gates": metrics.gates(named, limits)}


def position_readout(samples: DataFrame, train: list[float], test: list[float], alpha: float, modalities: tuple[str, ...] = ("voltage", "drive", "spike")) -> DataFrame:
    """(axis, modality, active, position, train, actual, predicted): a ridge per axis and modality, fitted on the train positions.

    samples: axis, position and array columns, as position_samples() gives them. Missing positions and positions in both lists raise.
    """
    if set(train) & set(test):
        raise ValueError("train and test positions must be disjoint")
    spark = samples.sparkSession
    wanted = spark.createDataFrame([(float(p), True) for p in train] + [(float(p), False) for p in test], "position double, train boolean")
    axes = samples.select("axis").distinct()
    rows = axes.crossJoin(F.broadcast(wanted)).join(samples, ["axis", "position"], "left")
    long = rows.select("axis", "position", "train", F.explode(F.array(*[F.struct(F.lit(m).alias("modality"), features.feature_vector(m).alias("features")) for m in modalities])).alias("m")).select("axis", "position", "train", "m.*")

    def work(pdf):
        pdf = pdf.sort_values("position")
        if pdf["features"].isna().any():
            raise ValueError(f"no sample at {pdf.loc[pdf['features'].isna(), 'position'].tolist()}")
        x, y, keep = np.array(pdf["features"].tolist(), np.float64), pdf["position"].to_numpy()[:, None], pdf["train"].to_numpy()
        guess = decode.fit_ridge(x[keep], y[keep], alpha)(x)[:, 0]
        return pdf[["axis", "modality", "position", "train"]].assign(active=int((x[keep].std(0) > 1e-12).sum()), actual=y[:, 0], predicted=guess)

    return long.groupBy("axis", "modality").applyInPandas(work, "axis string, modality string, active long, position double, train boolean, actual double, predicted double")


def readout_metrics(predictions: DataFrame) -> DataFrame:
    """Prediction metrics per axis, modality and half (train or test)."""
    return metrics.prediction(predictions, ["axis", "modality", "train"])


def topographic_readout(samples: DataFrame, backprojection: DataFrame, coordinates: DataFrame, train: list[float]) -> DataFrame:
    """(axis, position, train, centroid, predicted): activity of columns behind the responding neurons, its centroid, and a line from centroid to position.

    samples: axis, position, neuron_index, drive. backprojection: (target_index, column, share); coordinates: (column, u, v).
    """
    weighed = samples.join(backprojection.withColumnRenamed("target_index", "neuron_index"), "neuron_index").withColumn("w", F.abs("drive") * F.col("share")).join(coordinates, "column")
    at = F.when(F.col("axis") == "horizontal", F.col("u")).otherwise(F.col("v"))
    centers = weighed.groupBy("axis", "position").agg(F.try_divide(F.sum(at * F.col("w")), F.sum("w")).alias("centroid")).withColumn("train", F.col("position").isin([float(p) for p in train]))
    line = decode.affine(centers.where("train"), ["axis"], "centroid", "position")
    return centers.join(line, "axis").select("axis", "position", "train", "centroid", (F.col("slope") * F.col("centroid") + F.col("intercept")).alias("predicted"))


def visual_pathway(data: Dataset, luminance: DataFrame, inputs: tuple[int, ...], members: DataFrame, rate_hz: float, most_pulses: int, duration_s: float, start_s: float, end_s: float, config: events.Lif = events.Lif()) -> dict[str, DataFrame]:
    """responses and gates of populations (population, neuron) to a screen's mean luminance (condition, frame, luminance), coded as pulses of the inputs."""
    dt = config.dt / 1000
    coded = signals.pulses(luminance, rate_hz, most_pulses, config.dt, ["condition"])
    pulses = coded.select(F.col("condition").cast("string").alias("condition"), (F.col("step") * dt).alias("time_s")).where(F.col("time_s") < duration_s).distinct()
    stimuli = pulses.crossJoin(F.broadcast(data.neurons.sparkSession.createDataFrame([(i,) for i in inputs], "neuron_index int")))  # the caller's inputs
    runs = storage.materialize(events.run_conditions(events.collect_graph(data.neurons, data.edges), stimuli, duration_s, config), "runs")
    spikes = runs.where("step is not null").join(members, F.col("neuron_index") == F.col("neuron")).select(F.concat_ws("|", "condition", "population").alias("population"), "neuron", (F.col("step") * dt).alias("time_s"))
    size = members.groupBy("population").agg(F.count("*").alias("members"))
    grid = pulses.select("condition").distinct().crossJoin(size).select(F.concat_ws("|", "condition", "population").alias("population"), "members")
    return {"responses": metrics.response(spikes, grid, start_s, end_s, duration_s), "totals": runs.where("step is null").select("condition", "spikes", "visited")}


def sensitivity(settings: list[dict], run: Callable[[dict], DataFrame], value: str, spikes: str) -> DataFrame:
    """(setting, largest, range, any_spike) over a list of settings: run(setting) gives rows with value and spikes. Tonic drives, relays' gains and spans go this way."""
    out = None
    for i, setting in enumerate(settings):
        rows = run(setting).select(F.lit(i).alias("setting"), value, spikes)
        out = rows if out is None else out.unionByName(rows)
    return responses.sensitivity(out, ["setting"], value, spikes)


def grid(**axes) -> list[dict]:
    """All combinations of named values, as settings."""
    return [dict(zip(axes, x, strict=True)) for x in itertools.product(*axes.values())]


def relay_runs(data: Dataset, stimuli: DataFrame, duration_s: float, relays: tuple[int, ...], watch: DataFrame, config: events.Lif = events.Lif()) -> Callable[[dict], DataFrame]:
    """run() for sensitivity(): the network with graded relays of a setting's gain and span, and tonic bias; per watched neuron its spikes."""
    arrays = events.collect_graph(data.neurons, data.edges)

    def run(setting: dict) -> DataFrame:
        bias = dict.fromkeys(setting.get("tonic_neurons", ()), setting.get("tonic_mv", 0.0))
        out = events.run_conditions(arrays, stimuli, duration_s, config, relays=relays, relay_gain=setting.get("gain", 0.0), relay_span=setting.get("span", 7.0), bias=bias)
        seen = out.where("step is not null").groupBy("condition", "neuron_index").agg(F.count("*").alias("spikes"))
        every = stimuli.select("condition").distinct().crossJoin(watch.select("neuron_index").distinct())
        return every.join(seen, ["condition", "neuron_index"], "left").select(F.coalesce("spikes", F.lit(0)).cast("double").alias("value"), F.coalesce("spikes", F.lit(0)).alias("spikes"))

    return run


def hop_geometry(samples: DataFrame, layers: DataFrame, train: list[float], test: list[float], alpha: float, most_error: float) -> dict[str, DataFrame]:
    """decodability of the position from each layer's neurons per target and axis, and the first hop that fails.

    samples: axis, position, neuron_index, voltage. layers: (target, length, layer, node).
    """
    joined = layers.where("layer >= 1").select("target", "layer", F.col("node").alias("neuron_index")).join(samples, "neuron_index")
    wanted = [float(p) for p in (*train, *test)]
    known = [float(p) for p in train]

    def work(pdf):
        wide = pdf.pivot_table(index="position", columns="neuron_index", values="voltage", fill_value=0.0).sort_index()
        wide = wide[wide.index.isin(wanted)]
        keep = wide.index.isin(known)
        x, y = wide.to_numpy(np.float64), wide.index.to_numpy(np.float64)[:, None]
        first = pdf.iloc[0]
        mae = float("nan")
        if keep.sum() >= 2 and (~keep).any():
            guess = decode.fit_ridge(x[keep], y[keep], alpha)(x[~keep])
            mae = float(np.abs(guess - y[~keep]).mean())
        import pandas as pd

        return pd.DataFrame({"target": [first.target], "axis": [first.axis], "layer": [first.layer], "neurons": [x.shape[1]], "mae": [mae]})

    per = storage.materialize(joined.select("target", "axis", "layer", "neuron_index", "position", "voltage").groupBy("target", "axis", "layer").applyInPandas(work, "target long, axis string, layer int, neurons long, mae double"), "layers_decoded")
    failed = per.withColumn("passes", F.coalesce(F.col("mae") <= most_error, F.lit(False)) & ~F.isnan("mae"))
    first = failed.groupBy("target", "axis").agg(F.min(F.when(~F.col("passes"), F.col("layer"))).alias("first_failed_hop"))
    return {"layers": failed, "first_failed": first, "histogram": responses.failure_histogram(first, "first_failed_hop")}


def causal_variants(baseline: DataFrame, removed: DataFrame, added: DataFrame, run: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
    """Variant summary of interventions on relays: run(variant, relays) gives rows (hop_pass, target_pass, hop_error, target_error), one per target."""
    relays = storage.materialize(pathways.variants(baseline, removed, added), "variants")
    out = None
    for name in pathways.VARIANTS:
        rows = run(name, relays.where(F.col("variant") == name).select("neuron_index")).withColumn("variant", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return pathways.variant_summary(out, ["variant"])


def broad_recording(data: Dataset, sources: DataFrame, superclass: str, hops: int) -> dict[str, DataFrame]:
    """watch (neuron_index, hop) of a superclass within hops of the sources, and their annotation records."""
    found = storage.materialize(graph.distances(data.neurons, data.edges, sources, hops), "distances")
    watch = pathways.within_hops(found, data.neurons, superclass, hops)
    return {"watch": watch, "records": pathways.annotation_records(watch, data.neurons, found)}


def cursor_calibration(runs: DataFrame, populations: list[str], train: list[float], alpha: float) -> DataFrame:
    """(axis, position, train, actual, predicted): a ridge from the populations' values (axis, position, population, value) to the position."""
    vectors = features.population_vector(runs, ["axis", "position"], populations, "value")
    vectors = vectors.withColumn("train", F.col("position").isin([float(p) for p in train]))

    def work(pdf):
        pdf = pdf.sort_values("position")
        x, y, keep = np.nan_to_num(np.array(pdf["features"].tolist(), np.float64)), pdf["position"].to_numpy()[:, None], pdf["train"].to_numpy()
        return pdf[["axis", "position", "train"]].assign(actual=y[:, 0], predicted=decode.fit_ridge(x[keep], y[keep], alpha)(x)[:, 0])

    return vectors.groupBy("axis").applyInPandas(work, "axis string, position double, train boolean, actual double, predicted double")


def pixel_motor(frames: DataFrame, eye: eyes.Eye, screen: vision.Screen, protocol: eyes.Protocol, graph_arrays: events.Adjacency, populations: dict[str, tuple[int, ...]], chunk_ms: float, most_frames: int = 600, **options) -> dict[str, DataFrame]:
    """ticks and summary of pixel sequences (condition, frame, y, x, intensity), with the eye and (control) without it. A sequence that isn't admitted raises."""
    bad = vision.admit(frames.drop("condition"), most_frames, screen.width * screen.height).first()["reason"]
    if bad not in (None, "missing pixels"):
        raise ValueError(f"sequence not admitted: {bad}")
    n = frames.agg(F.max("frame")).first()[0] + 1
    samples = storage.materialize(eyes.column_samples(frames, eye, screen, n), "samples")
    out = None
    for control in (False, True):
        some = eyes.motor_sequence(samples, n, eye, screen.background, protocol, graph_arrays, populations, chunk_ms, connected=not control, **options).withColumn("control", F.lit(control))
        out = some if out is None else out.unionByName(some)
    ticks = storage.materialize(out, "ticks")
    both = eyes.sequence_summary(ticks.where("not control")).withColumn("control", F.lit(False)).unionByName(eyes.sequence_summary(ticks.where("control")).withColumn("control", F.lit(True)))
    return {"ticks": ticks, "summary": both}


def propagation_audit(data: Dataset, sources: DataFrame, hops: int, spikes: DataFrame) -> DataFrame:
    """(hop, nodes, spiking, spikes): neurons at each distance from the sources and how many of them spiked (spikes: neuron_index, n)."""
    reach = graph.distances(data.neurons, data.edges, sources, hops).select(F.col("node").alias("neuron_index"), F.col("distance").alias("hop"))
    return reach.join(spikes, "neuron_index", "left").groupBy("hop").agg(F.count("*").alias("nodes"), F.count("n").alias("spiking"), F.coalesce(F.sum("n"), F.lit(0)).alias("spikes"))


def runtime_validation(data: Dataset, stimuli: DataFrame, duration_s: float, chunk_s: float, config: events.Lif = events.Lif()) -> DataFrame:
    """(condition, agree): whether a run in chunks and an uninterrupted one give the same spikes and totals."""
    arrays = events.collect_graph(data.neurons, data.edges)
    name = lambda df, to: df.groupBy("condition").agg(F.sum(F.xxhash64(*[c for c in df.columns if c != "condition"]).cast("decimal(38,0)")).alias(to))
    whole = name(events.run_conditions(arrays, stimuli, duration_s, config), "a")
    parts = name(events.run_conditions(arrays, stimuli, duration_s, config, chunk_s=chunk_s), "b")
    return whole.join(parts, "condition", "full").select("condition", F.col("a").eqNullSafe(F.col("b")).alias("agree"))


def subnormal_cost(n: int = 166_700, updates: int = 100) -> list[tuple[str, float]]:
    """(case, seconds) of plain decay updates on zeros, on subnormal numbers, and on subnormal numbers that are cut to zero first."""
    import time

    found = []
    for case in ("zero", "subnormal", "cut"):
        g = np.full(n, 0.0 if case == "zero" else 1e-310)
        start = time.perf_counter()
        for _ in range(updates):
            if case == "cut":
                g[np.abs(g) < np.finfo(np.float64).tiny] = 0.0
            g = g * 0.98
        found.append((case, time.perf_counter() - start))
    return found

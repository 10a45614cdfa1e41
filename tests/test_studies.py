"""Studies on tiny networks; features of positions and motor ticks against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import events, pathways, signals, vision
from spindrift.plans import eye as eyes
from spindrift.plans import studies
from spindrift.plans.dataset import Dataset
from spindrift.queries import readouts

SCREEN = vision.Screen(width=16, height=9, bar_width=0.2)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    n = 30
    neurons = spark.createDataFrame([(i, 100 + i, f"T{i % 3}_{'LR'[i % 2]}", f"T{i % 3}", "motor" if i >= 24 else "relay" if i >= 6 else "input", int((-1) ** (i % 4 == 3))) for i in range(n)], "neuron_index int, body_id long, instance string, type string, superclass string, sign int")
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (160, 2)) if a != b})
    return Dataset(neurons, spark.createDataFrame([(a, b, 40 + (a * b) % 90) for a, b in edges], "source_index int, target_index int, synapse_count long"))


def plain_frames(kind, across, position):
    frames = np.full((4, 9, 16), 0.5)
    extent = 16 if across else 9
    low, high = max(0, round((position - 0.1) * (extent - 1))), min(extent, round((position + 0.1) * (extent - 1)) + 1)
    if kind != "baseline":
        value = 0.0 if kind == "dark" else 1.0
        if across:
            frames[1:3, :, low:high] = value
        else:
            frames[1:3, low:high, :] = value
    return frames


def plain_samples(frames, eye):
    """frames x columns, a pixel lookup at a time; the background off the screen."""
    out = np.full((len(frames), len(eye.keys)), 0.5)
    for c, (f, r, u) in enumerate(eye.directions):
        x, y = r / f / math.tan(math.radians(60)), u / f / math.tan(math.radians(45))
        if f > 0 and abs(x) <= 1 and abs(y) <= 1:
            px, py = (x + 1) / 2 * 15, (1 - y) / 2 * 8
            x0, y0 = min(int(px), 14), min(int(py), 7)
            dx, dy = px - x0, py - y0
            for k, frame in enumerate(frames):
                out[k, c] = frame[y0, x0] * (1 - dx) * (1 - dy) + frame[y0, x0 + 1] * dx * (1 - dy) + frame[y0 + 1, x0] * (1 - dx) * dy + frame[y0 + 1, x0 + 1] * dx * dy
    return out


def plain_amplitudes(shown, protocol):
    """Amplitude of (kind, column) at each step, from the filters' definitions."""
    c, per = protocol.vision, 100
    steps = len(shown) * per
    rest = c.tonic + (1 - c.tonic) * c.background
    gain = lambda tau: 1 - math.exp(-c.dt_ms / tau)
    out = {k: np.zeros((steps, shown.shape[1])) for k in eyes.KINDS}
    for col in range(shown.shape[1]):
        p, fast, slow, late = c.background, rest, rest, rest
        for t in range(steps):
            p += gain(c.photoreceptor_ms) * (shown[t // per, col] - p)
            release = c.tonic + (1 - c.tonic) * p
            fast += gain(c.fast_ms) * (release - fast)
            slow += gain(c.slow_ms) * (release - slow)
            late += gain(c.l3_ms) * (release - late)
            w = c.l2_slow_weight
            for kind, x in (("l1", -c.l1_gain * (fast - slow)), ("l2", -c.l2_gain * (fast - w * slow - (1 - w) * rest)), ("l3", -c.l3_gain * (late - rest))):
                a = max(-1.0, min(1.0, x / protocol.gain))
                if t + 18 < steps:
                    out[kind][t + 18, col] = 0.0 if abs(a) <= protocol.epsilon else a * protocol.factor
    return out


def plain_run(graph, drives, steps, config=events.Lif()):
    """v and g of all neurons after each step, and spikes, with drives {target: amplitude per step}."""
    n = graph.n
    v, g, r, due, spikes = [config.resting] * n, [0.0] * n, [0] * n, {}, []
    ev, eg = math.exp(-config.dt / config.membrane_tau), math.exp(-config.dt / config.synapse_tau)
    k = config.synapse_tau / (config.synapse_tau - config.membrane_tau) * (eg - ev)
    vs, gs = [], []
    for t in range(steps):
        frozen, fired = [x > 0 for x in r], []
        for i in range(n):
            if frozen[i]:
                r[i] -= 1
            else:
                v[i], g[i] = config.resting + (v[i] - config.resting) * ev + g[i] * k, g[i] * eg
                if v[i] > config.threshold:
                    fired.append(i)
        for i in due.pop(t, []):
            for e in range(graph.start[i], graph.start[i + 1]):
                if not frozen[graph.target[e]]:
                    g[graph.target[e]] += config.scale * graph.count[e] * graph.sign[i]
        for i in range(n):
            if not frozen[i]:
                g[i] += drives[t, i]
        for i in fired:
            v[i], g[i], r[i] = config.reset, 0.0, max(0, config.steps(config.refractory) - 1)
            due.setdefault(t + config.steps(config.delay), []).append(i)
            spikes.append((t, i))
        vs.append(list(v))
        gs.append(list(g))
    return np.array(vs) - config.resting, np.array(gs), spikes


@pytest.fixture(scope="module")
def plain(spark, sf):
    """Every condition of the nations' screen, run plainly."""
    eye, graph, protocol = readouts.nation_eye(spark, sf), readouts._network(spark, sf), readouts.PROTOCOL
    found = {}
    for r in readouts.seen_conditions(spark, sf).collect():
        amplitude = plain_amplitudes(plain_samples(plain_frames(r.kind, r.axis == "horizontal", r.position), eye), protocol)
        drives = np.zeros((400, graph.n))
        for kind in eyes.KINDS:
            for col, sources in enumerate(eye.sources):
                for e in range(graph.start[sources[kind]], graph.start[sources[kind] + 1]):
                    drives[:, graph.target[e]] += amplitude[kind][:, col] * graph.count[e] * graph.sign[sources[kind]]
        found[r.condition] = (r.kind, *plain_run(graph, drives, 400))
    return found


def peak(x):
    return max(x) if abs(max(x)) >= abs(min(x)) else min(x)


def test_position_features(spark, sf, plain):
    rows = readouts.QUERIES["position_features"](spark, sf).collect()
    assert {r.condition for r in rows} == {c for c, p in plain.items() if p[0] != "baseline"} and len(rows) == 25 * len({r.condition for r in rows})
    for r in rows:
        _, v, g, spikes = plain[r.condition]
        i = r.neuron_index
        assert r.voltage == pytest.approx(peak(v[100:, i]), abs=2e-6) and r.drive == pytest.approx(peak(g[100:, i]), abs=2e-6)
        assert (r.voltage_0, r.drive_1) == pytest.approx((peak(v[100:250, i]), peak(g[250:, i])), abs=2e-6)
        assert r.spikes == sum(k == i for _, k in spikes) and r.total_spikes == len(spikes)
    assert any(r.voltage > 0.01 for r in rows) and any(r.voltage < -0.01 for r in rows)


def test_motor_ticks(spark, sf, plain):
    rows = readouts.QUERIES["motor_ticks"](spark, sf).collect()
    assert len(rows) == 25 * 8
    groups = {"left": (1, 3, 5), "right": (2, 4, 6), "up": (7,), "down": (8, 10), "click": (24,)}
    watch = sorted({i for m in groups.values() for i in m})
    for r in rows:
        _, v, _, spikes = plain[r.condition]
        inside = [i for t, i in spikes if 50 * r.tick <= t < 50 * r.tick + 50]
        rate = {k: sum(i in m for i in inside) / len(m) / 0.005 for k, m in groups.items()}
        clip = lambda x: max(-0.5, min(0.5, x * 0.01))
        assert (r.spikes, r.dx, r.dy, r.click) == (len(inside), pytest.approx(clip(rate["right"] - rate["left"])), pytest.approx(clip(rate["down"] - rate["up"])), rate["click"] >= 20)
        assert r.peak_mv == pytest.approx(np.abs(v[50 * r.tick : 50 * r.tick + 50][:, watch]).max(), abs=2e-6)


def test_pixel_motor_with_its_control(spark, sf):
    eye, graph = readouts.nation_eye(spark, sf), readouts._network(spark, sf)
    frames = vision.condition_frames(readouts.seen_conditions(spark, sf), SCREEN, 1, 2, 1)
    out = studies.pixel_motor(frames, eye, SCREEN, readouts.PROTOCOL, graph, {"left": (1,), "right": (2,)}, 10.0)
    control = out["summary"].where("control").collect()
    assert len(control) == 25 and not any(r.motor_nonzero or r.spikes or r.peak_mv for r in control) and out["ticks"].count() == 2 * 25 * 4
    with pytest.raises(ValueError, match="too many frames"):
        studies.pixel_motor(frames, eye, SCREEN, readouts.PROTOCOL, graph, {"left": (1,)}, 10.0, most_frames=3)


def test_spatial_neural_vision(spark, sf):
    eye, graph = readouts.nation_eye(spark, sf), readouts._network(spark, sf)
    conditions = readouts.seen_conditions(spark, sf)
    receptors, targets = tuple((k, (k + 3) % 25) for k in range(25)), tuple((k + 1) % 25 for k in range(25))
    out = {r.condition: r for r in studies.spatial_neural_vision(conditions, eye, SCREEN, readouts.PROTOCOL, graph, receptors, targets).collect()}
    gain = lambda tau: 1 - math.exp(-0.1 / tau)
    for r in conditions.collect():
        shown = plain_samples(plain_frames(r.kind, r.axis == "horizontal", r.position), eye)
        drives = np.zeros((400, 25))
        for col in range(25):
            p = 0.5
            for t in range(400 - 18):
                p += gain(15.0) * (shown[t // 100, col] - p)
                x = 0.9 * (p - 0.5)
                amplitude = 0.0 if abs(x) <= 0.01 else max(-1.0, min(1.0, x)) * 0.002
                for source in receptors[col]:
                    for e in range(graph.start[source], graph.start[source + 1]):
                        drives[t + 18, graph.target[e]] += amplitude * graph.count[e] * graph.sign[source]
        v, g, _ = plain_run(graph, drives, 400)
        got, window = out[r.condition], slice(100, 300)
        mean = shown[1:3].mean(0)
        active = {"baseline": np.zeros(25, bool), "dark": mean < 0.5 - 1e-9, "bright": mean > 0.5 + 1e-9}[r.kind]
        assert (got.active_columns, got.active_sources) == (active.sum(), 2 * active.sum())
        assert got.max_drive == pytest.approx(g[window].max(), abs=1e-9) and got.min_voltage == pytest.approx(v[window].min(), abs=1e-9)
        own = [targets[k] for k in range(25) if active[k]]
        want = None if not own else np.mean([g[window, i].max() > 0 if r.kind == "dark" else g[window, i].min() < 0 for i in own])
        assert got.expected_sign == pytest.approx(want) if own else got.expected_sign is None


def test_lamina_motor_and_early_vision(spark, sf):
    eye, graph = readouts.nation_eye(spark, sf), readouts._network(spark, sf)
    conditions = readouts.seen_conditions(spark, sf).where("kind <> 'baseline'")
    out = studies.graded_lamina(conditions, eye, SCREEN, readouts.PROTOCOL, graph, tuple(range(25)), 0.05, 5)
    features = readouts.QUERIES["position_features"](spark, sf).collect()
    summary, top = out["summary"].first(), out["top"].collect()
    assert summary.watched == 25 and len(top) == 5 and top[0].peak_v == pytest.approx(summary.max_peak) and summary.max_peak >= max(abs(r.voltage) for r in features) - 1e-5
    populations = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "population string, neuron_index int")
    limits = spark.createDataFrame([("a|3", None, None), ("none", 0.0, None)], "name string, low double, high double")
    motor = studies.motor_characterization(out["traces"], populations, -52.0, "a", "b", limits)
    n = conditions.count()
    assert motor["members"].count() == 3 * n and motor["populations"].count() == 2 * n and motor["difference"].count() == n and {r.name: r.passed for r in motor["gates"].collect()}["none"] is False
    shown = spark.createDataFrame([(c, f, 0.1 if 1 <= f < 3 else 0.5) for c in range(3) for f in range(4)], "channel long, frame long, luminance double")
    trace = spark.createDataFrame([(t / 1000, n, -52.0 + n * t) for t in range(40) for n in range(3)], "time_s double, neuron int, v double")
    rows = {r.signal: r for r in studies.early_vision_comparison(shown, trace, readouts.PROTOCOL, -52.0).collect()}
    assert set(rows) == {"l1", "l2", "l3", "voltage"} and rows["l1"].stimulus_max > 0.1 and rows["voltage"].abs_peak == 39.0


def test_position_readout(spark):
    rows = [(a, p / 10, [p / 10, 1.0, float(p % 3)], [0.0] * 3, [1.0, p * p / 100, 0.0]) for a in ("horizontal", "vertical") for p in range(11)]
    samples = spark.createDataFrame(rows, "axis string, position double, voltage array<double>, drive array<double>, spike array<double>")
    train, test = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0], [0.1, 0.3, 0.5]
    out = studies.position_readout(samples, train, test, 1e-6)
    errors = {(r.modality, r.train): r.mae for r in studies.readout_metrics(out).where("axis = 'vertical'").collect()}
    assert errors["voltage", False] < 1e-3 < errors["drive", False] and out.count() == 2 * 3 * 9
    with pytest.raises(ValueError):
        studies.position_readout(samples, train, train[:1], 1.0)
    with pytest.raises(Exception, match="no sample"):
        studies.position_readout(samples, train, [0.55], 1.0).count()


def test_screen_geometry(spark):
    rng = np.random.default_rng(2)
    directions = spark.createDataFrame([(i, 1.0, float(rng.uniform(-1.6, 1.6)), float(rng.uniform(-0.9, 0.9))) for i in range(800)], "key long, forward double, right double, up double")
    out = studies.screen_geometry(spark, directions, vision.Screen(64, 48, bar_width=0.2), [0.2, 0.35, 0.5, 0.65, 0.8])
    summary = out["summary"].collect()
    assert len(summary) == 2 and all(r.correlation > 0.99 and r.least_active > 20 and r.visible > 500 for r in summary)


def test_mapping(spark, data):
    official = spark.createDataFrame([(10 * k, 100 + k if k % 4 else None) for k in range(10, 24)], "column long, body_id long")
    typed = data.neurons.where("type = 'T1'")
    out = studies.retinotopic_mapping(data, data.neurons.where("superclass = 'input'"), official, typed, 30, 0.6, 0.3)
    edges = [(r.source_index, r.target_index, r.synapse_count) for r in data.edges.collect()]
    assert out["assignments"].count() == 6 == sum(r.n for r in out["status"].collect())
    for r in out["assignments"].collect():
        mine = sorted((-w, 10 * t) for s, t, w in edges if s == r.source and 10 <= t < 24 and t % 4)
        assert r.candidates == len(mine) and (r.reason is None) == bool(mine)
        if r.column is not None:
            assert (-r.contacts, r.column) == mine[0]
    counts = out["counts"].first()
    assert counts.sources == 6 and counts.covered <= counts.assigned


def test_variants_and_recording(spark, data):
    base, gone, more = (data.neurons.where(f"neuron_index between {a} and {b}").select("neuron_index") for a, b in ((6, 15), (10, 12), (20, 21)))
    seen = {}

    def run(name, relays):
        seen[name] = sorted(r[0] for r in relays.collect())
        return relays.select((F.col("neuron_index") > 9).alias("hop_pass"), F.lit(True).alias("target_pass"), F.lit(0.5).alias("hop_error"), F.lit(0.1).alias("target_error"))

    out = {r.variant: r for r in studies.causal_variants(base, gone, more, run).collect()}
    assert seen["baseline"] == list(range(6, 16)) and seen["combined"] == [6, 7, 8, 9, 13, 14, 15, 20, 21] and out["remove"].targets == 7 and out["add"].hop_passes == 8
    rec = studies.broad_recording(data, data.neurons.where("neuron_index < 3"), "motor", 3)
    assert rec["records"].count() == rec["watch"].count() > 0 and all(1 <= r.hop <= 3 and r.superclass == "motor" for r in rec["records"].collect())
    audit = studies.propagation_audit(data, data.neurons.where("neuron_index < 3"), 3, spark.createDataFrame([(0, 4), (25, 2)], "neuron_index int, n long"))
    assert audit.where("hop = 0").first().spikes == 4 and audit.agg(F.sum("nodes")).first()[0] <= 30


def test_network_studies(spark, data):
    stimuli = spark.createDataFrame([(f"c{c}", i, 0.001 * k) for c in range(2) for i in range(3 + c) for k in (1, 4, 7)], "condition string, neuron_index int, time_s double")
    assert all(r.agree for r in studies.runtime_validation(data, stimuli, 0.02, 0.006).collect())
    run = studies.relay_runs(data, stimuli, 0.02, (6, 7), data.neurons.where("superclass = 'motor'"))
    settings = studies.grid(gain=(0.0, 0.5), span=(7.0,), tonic_neurons=((24,),), tonic_mv=(0.0, 2.0))
    out = studies.sensitivity(settings, run, "value", "spikes").collect()
    assert len(settings) == len(out) == 4
    shown = spark.createDataFrame([(c, f, 0.2 + 0.2 * c) for c in range(3) for f in range(3)], "condition long, frame long, luminance double")
    members = data.neurons.select(F.col("superclass").alias("population"), F.col("neuron_index").alias("neuron"))
    got = studies.visual_pathway(data, shown, (0, 1), members, 60.0, 5, 0.05, 0.0, 0.03)
    assert got["responses"].count() == 3 * 3 and {r.condition for r in got["totals"].collect()} == {"0", "1", "2"}
    assert [c for c, _ in studies.subnormal_cost(1000, 3)] == ["zero", "subnormal", "cut"]


def test_hops_and_calibration(spark, data):
    layers = spark.createDataFrame([(25, 2, 0, 1), (25, 2, 1, 7), (25, 2, 1, 8), (25, 2, 2, 25)], "target long, length int, layer int, node int")
    samples = spark.createDataFrame([("horizontal", p / 10, n, p / 10 * (n == 7) + (0.3 if n == 25 else 0.0)) for p in range(11) for n in (7, 8, 25)], "axis string, position double, neuron_index int, voltage double")
    out = studies.hop_geometry(samples, layers, [p / 10 for p in range(0, 11, 2)], [0.1, 0.5, 0.9], 1e-6, 0.05)
    assert out["first_failed"].first().first_failed_hop == 2 and {r.layer: r.passes for r in out["layers"].collect()} == {1: True, 2: False}
    runs = spark.createDataFrame([("horizontal", p / 10, k, p * (1.0 if k == "a" else -0.5)) for p in range(11) for k in ("a", "b")], "axis string, position double, population string, value double")
    got = studies.cursor_calibration(runs, ["a", "b"], [0.0, 0.5, 1.0], 1e-9).collect()
    assert len(got) == 11 and all(abs(r.actual - r.predicted) < 1e-3 for r in got)
    shares = spark.createDataFrame([(7, 1, 0.5), (7, 2, 0.5), (25, 2, 1.0)], "target_index int, column long, share double")
    places = spark.createDataFrame([(1, 0.2, 0.5), (2, 0.8, 0.5)], "column long, u double, v double")
    drives = spark.createDataFrame([("horizontal", p / 10, 7, 1.0) for p in range(11)] + [("horizontal", p / 10, 25, p / 5.0) for p in range(11)], "axis string, position double, neuron_index int, drive double")
    got = {r.position: r for r in studies.topographic_readout(drives, shares, places, [0.2, 0.8]).collect()}
    assert got[0.0].centroid == pytest.approx(0.5) and got[1.0].centroid == pytest.approx((0.2 * 0.5 + 0.8 * 2.5) / 3) and got[0.2].predicted == pytest.approx(0.2)


def test_raising_operators(spark, data):
    bad = spark.createDataFrame([(1, "l1", 5)], "column long, kind string, source long")
    with pytest.raises(Exception, match="official"):
        pathways.checked_cartridges(bad, spark.createDataFrame([(1, "l1", 6)], "column long, kind string, source long")).collect()
    groups, official = spark.createDataFrame([("x", 1)], "column string, neuron_index int"), spark.createDataFrame([("x", None)], "column string, body_id long")
    with pytest.raises(Exception, match="official neuron"):
        pathways.column_of_groups(groups, official, data.neurons).collect()
    with pytest.raises(ValueError):
        pathways.require_disjoint(groups, groups, "column")
    with pytest.raises(ValueError):
        pathways.require_subset(groups, official.where("false"), "column")
    with pytest.raises(ValueError):
        pathways.motor_populations(data.neurons, [("a", "T1", None), ("a", "T2", None)])
    with pytest.raises(Exception, match="no such neuron"):
        pathways.annotation_records(spark.createDataFrame([(999,)], "neuron_index int"), data.neurons).collect()
    frames = vision.bar_frames(spark, "vertical", [0.5], SCREEN)
    reason = lambda df, *limits: vision.admit(df, *limits).first()["reason"]
    assert reason(frames, 9, 999) is None and reason(frames, 9, 10) == "too many pixels" and reason(frames.where("x > 0"), 9, 999) == "missing pixels" and reason(frames.where("false"), 9, 9) == "empty"
    assert reason(frames.withColumn("intensity", F.lit(1.5)), 9, 999) == "values"
    assert vision.content_hash(frames).first() == vision.content_hash(frames.repartition(3)).first() != vision.content_hash(frames.withColumn("intensity", F.lit(0.1))).first()
    assert signals.chunk_pulses(spark.createDataFrame([(0, 5.0, 6.0)], "chunk int, from_s double, to_s double"), data.neurons.limit(1), 0.0, 1.0, 0.1, 0.1).count() == 0

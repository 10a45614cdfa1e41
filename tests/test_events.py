"""The event engine against itself in chunks, its DataFrame twin and a plain loop; filters and decoders on toy data."""

import math

import numpy as np
import pytest

from spindrift.operators import decode as dec
from spindrift.operators import signals as sig
from spindrift.operators.events import Adjacency, Lif, Simulator, dataframe_step
from spindrift.streaming import simulation
from spindrift.streaming.telemetry import next_state

CHAIN = Adjacency.of(3, [0, 1], [1, 2], [250, 250], [1, 1, -1])


def test_chain_and_chunks():
    sim = Simulator(CHAIN)
    whole = sim.fresh()
    pulses = sim.schedule([0], [0.001])
    one = sim.advance(whole, 0.012, pulses, watch=(0, 1, 2))
    assert one["spikes"] >= 2 and one["events"][0][1] == 0 and one["dropped"] == 0
    parts, state = [], sim.fresh()
    for base in (0, 40, 80):
        out = sim.advance(state, 0.004, {k - base: v for k, v in pulses.items() if base <= k < base + 40}, watch=(0, 1, 2))
        parts += out["trace"]
        state = simulation.load(simulation.dump(state))
    assert parts == one["trace"]
    np.testing.assert_array_equal(state.v, whole.v)


def plain_loop(graph, config, pulses, steps):
    """Another writing of the rules, neuron by neuron."""
    n = graph.n
    v, g, r, due, spikes = [config.resting] * n, [0.0] * n, [0] * n, {}, []
    ev, eg = math.exp(-config.dt / config.membrane_tau), math.exp(-config.dt / config.synapse_tau)
    k = config.synapse_tau / (config.synapse_tau - config.membrane_tau) * (eg - ev)
    for t in range(steps):
        fired, frozen = [], [x > 0 for x in r]
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
        for i in pulses.get(t, []):
            if not frozen[i]:
                v[i] += 8.0
        for i in fired:
            v[i], g[i], r[i] = config.reset, 0.0, max(0, config.steps(config.refractory) - 1)
            due.setdefault(t + config.steps(config.delay), []).append(i)
            spikes.append((t, i))
    return spikes, v, g


def test_against_plain_loop():
    loop = Adjacency.of(3, [0, 1, 2], [1, 2, 1], [250, 250, 100], [1, 1, -1])
    sim = Simulator(loop)
    pulses = sim.schedule([0, 2, 0], [0.001, 0.001, 0.006])
    state = sim.fresh()
    out = sim.advance(state, 0.03, pulses)
    spikes, v, g = plain_loop(loop, Lif(), {k: x.tolist() for k, x in pulses.items()}, 300)
    assert out["events"] == spikes and len(spikes) > 3
    np.testing.assert_allclose(state.v, v, atol=1e-10)
    np.testing.assert_allclose(state.g, g, atol=1e-10)


def test_dataframe_step(spark):
    sim, config = Simulator(CHAIN), Lif()
    state = sim.fresh()
    state.v[:] = [-44.0, -50.0, -52.0]
    state.g[:] = [1.0, 2.0, 0.0]
    state.pending[0] = [1]
    df = spark.createDataFrame([(i, float(state.v[i]), float(state.g[i]), 0, int(CHAIN.sign[i])) for i in range(3)], "neuron_index int, v double, g double, refractory long, sign int")
    e = spark.createDataFrame([(0, 1, 250), (1, 2, 250)], "source_index int, target_index int, synapse_count long")
    got = dataframe_step(df, e, spark.createDataFrame([(1,)], "source_index int"), spark.createDataFrame([(2,)], "neuron_index int"), config).orderBy("neuron_index").collect()
    spiked, _ = sim.step(state, np.array([2]), 8.0, [], 0)
    np.testing.assert_allclose([r.v for r in got], state.v)
    np.testing.assert_allclose([r.g for r in got], state.g)
    assert [r.neuron_index for r in got if r.spiked] == spiked.tolist() and [r.refractory for r in got] == state.refractory.tolist()


def test_rules():
    with pytest.raises(ValueError):
        Lif(delay=1.85)
    with pytest.raises(ValueError):
        Simulator(CHAIN).schedule([0, 0], [0.001, 0.001])
    sim = Simulator(CHAIN, clamped=(1,))
    out = sim.advance(sim.fresh(), 0.012, sim.schedule([0], [0.001]))
    assert {i for _, i in out["events"]} == {0}
    capped = Simulator(CHAIN).advance(Simulator(CHAIN).fresh(), 0.012, sim.schedule([0], [0.001]), max_events=1)
    assert len(capped["events"]) == 1 and capped["dropped"] == capped["spikes"] - 1
    assert next_state("idle", "pause") == ("idle", False) and next_state("running", "pause") == ("paused", True)


def test_low_pass_settles():
    out = sig.graded_traces(np.full((6, 2), 0.5), sig.EarlyVision(frame_rate_hz=100.0))
    assert all(np.abs(out[k]).max() < 1e-12 for k in ("l1", "l2", "l3"))
    rising = sig.graded_traces(np.full((6, 1), 0.9), sig.EarlyVision(frame_rate_hz=100.0))
    assert rising["l1"].min() < 0 and rising["photoreceptor"][-1, 0] > 0.8


def test_decoders():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((20, 50))
    y = x[:, :1] * 2 + 1
    assert np.abs(dec.fit_ridge(x, y, 1e-6)(x) - y).max() < 1e-3
    constant = np.ones((4, 3))
    assert np.allclose(dec.fit_ridge(constant, np.arange(4.0)[:, None], 1.0)(constant), 1.5)
    labels = (x[:, 0] > 0).astype(float)[:, None]
    assert ((dec.fit_rbf(x[:, :2], labels, 0.1, 0.5)(x[:, :2]) > 0.5) == (labels > 0.5)).mean() > 0.9
    z = dec.pca(x, 3, whiten=True)(x)
    assert np.allclose(z.std(0, ddof=1), 1)

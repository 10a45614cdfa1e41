"""Event time, telemetry and simulation queries. Streams here are files read to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spindrift.operators import events as ev
from spindrift.operators import normalize, storage
from spindrift.queries import views as v
from spindrift.streaming import clients, live, simulation, telemetry as t

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, d: v.longs(f(spark, d))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _events(s, d):
    """Events with an absolute second: timestamps without zone count as UTC in any session."""
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 1e6
    return v.read(s, d, "events").withColumn("time_s", at).withColumn("hour", F.floor(F.col("time_s") / 3600))


_BASE = "WITH e AS (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6::DOUBLE AS time_s, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 / 3600)::BIGINT AS hour FROM events) "


def _instants(s, d):
    """Events with ts as an instant that shows the stored time in UTC."""
    return v.read(s, d, "events").withColumn("ts", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")))


def run_to_end(stream, s, mode: str = "append"):
    """What a stream over existing files writes, as a table in the shared folder."""
    path = f"{storage.shared_dir(s)}/stream-{uuid.uuid4().hex}"

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    running = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).foreachBatch(write).start()
    running.awaitTermination()
    return s.read.option("basePath", f"{path}/out").parquet(f"{path}/out").drop("batch")


_DAY = "epoch_us(ts) // 86400000000"


@query(f"SELECT {_DAY} AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def chunk_windows(s, d):
    w = t.chunks(_instants(s, d), "ts", "1 day", ["event_type"], "value")
    return w.select((F.unix_micros("start") / 86400000000).cast("long").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"SELECT {_DAY} AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def chunk_windows_stream(s, d):
    """The same by a stream in update mode: each day's last update is its count."""
    schema = v.read(s, d, "events").schema
    path = f"{d}/events.parquet"
    stream = s.readStream.schema(schema).parquet(path) if _is_folder(s, path) else s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    stream = stream.withColumn("ts", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")))
    out = run_to_end(t.chunks(stream, "ts", "1 day", ["event_type"], "value"), s, "update")
    return out.groupBy((F.unix_micros("start") / 86400000000).cast("long").alias("day"), "event_type").agg(F.max("n").alias("n"))


def _is_folder(s, path: str) -> bool:
    where = s._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


@query("WITH w AS (SELECT event_type, value, unnest([epoch_us(ts) // 21600000000, epoch_us(ts) // 21600000000 - 1]) AS slot FROM events) SELECT slot * 6 AS start_hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2")
def sliding_windows(s, d):
    w = t.sliding(_instants(s, d), "ts", "12 hours", "6 hours", ["event_type"], "value")
    return w.select((F.unix_micros("start") / 3600000000).cast("long").alias("start_hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT user_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), k AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS run FROM g) SELECT user_id, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS n FROM k GROUP BY user_id, run")
def session_windows(s, d):
    w = t.sessions(_instants(s, d), "ts", "6 hours", ["user_id"])
    return w.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value, arg_max(event_type, (ts, event_id)) AS event_type, count(*) - 1 AS dropped FROM events GROUP BY 1")
def latest_value(s, d):
    return t.latest(v.read(s, d, "events"), ["user_id"], ["ts", "event_id"], ["value", "event_type"])


@query(_BASE + "SELECT user_id, hour AS slot, arg_min(event_id, (time_s, event_id)) AS event_id FROM e GROUP BY 1, 2")
def rate_limited(s, d):
    return t.sampled(_events(s, d), ["user_id"], "time_s", "event_id", 1 / 3600).select("user_id", "slot", "event_id")


@query("SELECT event_type, event_id, greatest(0, count(*) OVER (PARTITION BY event_type) - 50) AS dropped FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 50")
def event_cap(s, d):
    return t.first_events(v.read(s, d, "events"), ["event_type"], ["ts", "event_id"], 50).select("event_type", "event_id", "dropped")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS age FROM events QUALIFY age < 5")
def ring_history(s, d):
    return t.ring(v.read(s, d, "events"), ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id", "age")


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_chunks(s, d):
    return t.distinct_chunks(v.read(s, d, "events").select("user_id", "event_type"), ["user_id", "event_type"], "ts")


@query("WITH p AS (SELECT user_id, event_id AS pulse, ts AS pulse_at FROM events WHERE event_type = 'click'), c AS (SELECT user_id, event_id AS chunk, ts AS chunk_at FROM events WHERE event_type = 'view') SELECT user_id, pulse, chunk FROM p JOIN c USING (user_id) WHERE pulse_at >= chunk_at AND pulse_at < chunk_at + INTERVAL 6 HOUR")
def joined_streams(s, d):
    """Clicks in the six hours after a view, of two streams."""
    side = lambda kind, name: _event_stream(s, d).where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name), F.col("at").alias(f"{name}_at"))
    return run_to_end(t.pulses_in_chunks(side("click", "pulse"), side("view", "chunk"), "user_id", "6 hours"), s).select("user_id", "pulse", "chunk")


_HALF_DAY = 43_200_000_000


def _event_stream(s, d):
    """Events as a stream: at (an instant), us (microseconds), time_s (seconds of 2024)."""
    rows = t.from_files(s, f"{d}/events.parquet", v.read(s, d, "events").schema)
    rows = rows.withColumn("us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))
    return rows.withColumns({"at": F.timestamp_micros("us"), "time_s": (F.col("us") - 1_704_067_200_000_000) / 1e6})


def _live(stream, s, mode: str = "append"):
    with live.rocksdb(s):
        return run_to_end(stream, s, mode)


@query(ORACLE["latest_value"])
def latest_value_stream(s, d):
    """latest_value with the newest row of each key in the state store; a key's last update has dropped the most."""
    out = _live(live.latest(_event_stream(s, d), "user_id", ["us", "event_id"], ["value", "event_type"]), s, "update")
    return out.groupBy("user_id").agg(F.max_by(F.struct("value", "event_type", "dropped"), "dropped").alias("r")).select("user_id", "r.*")


@query(ORACLE["rate_limited"])
def rate_limited_stream(s, d):
    return _live(live.sampled(_event_stream(s, d).select("user_id", "time_s", "event_id"), "user_id", "time_s", "event_id", 1 / 3600), s).select("user_id", "slot", "event_id")


@query(ORACLE["event_cap"])
def event_cap_stream(s, d):
    out = _live(live.capped(_event_stream(s, d), "event_type", ["us", "event_id"], 50), s)
    gone = out.where("position is null").groupBy("event_type").agg(F.max("dropped").alias("dropped"))
    return out.where("position is not null").select("event_type", "event_id").join(gone, "event_type", "left").fillna(0, ["dropped"])


@query(ORACLE["ring_history"])
def ring_history_stream(s, d):
    out = _live(live.ring(_event_stream(s, d), "user_id", ["us", "event_id"], [], 5), s, "update")
    last = out.groupBy("user_id").agg(F.max("seen").alias("seen"))
    return out.join(last, ["user_id", "seen"]).select("user_id", "event_id", "age")


@query(f"WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events), m AS (SELECT max(us) // 1000 * 1000 AS stop FROM e), g AS (SELECT user_id, us, lead(us) OVER (PARTITION BY user_id ORDER BY us) AS next FROM e), n AS (SELECT user_id, us, unnest(range(1, CASE WHEN next IS NULL THEN (stop - us) // {_HALF_DAY} + 1 ELSE (next - us + {_HALF_DAY} - 1) // {_HALF_DAY} END)) AS beat FROM g, m) SELECT user_id, us AS after_us, beat, us + beat * {_HALF_DAY} AS at_us FROM n")
def heartbeats_stream(s, d):
    """Beats for each half day of a key's silence, by event-time timers where no later row tells of it."""
    return _live(live.heartbeats(_event_stream(s, d), "user_id", "at", _HALF_DAY / 1e6), s)


@query("WITH e AS (SELECT *, ntile(3) OVER (ORDER BY ts, event_id) - 1 AS epoch FROM events), p AS (SELECT 'steady' AS client, epoch AS poll, * FROM e UNION ALL SELECT 'stalled', 2, * FROM e) SELECT client, poll, user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value, count(*) - 1 AS dropped FROM p GROUP BY ALL")
def client_frames(s, d):
    """Events in three epochs of equal size; one client polls after each, another one only at the end."""
    path = f"{storage.shared_dir(s)}/clients-{uuid.uuid4().hex}"
    e = v.read(s, d, "events").select("user_id", "ts", "event_id", "value")
    n = e.count()
    rank = normalize.dense_index(e, "event_id", "place")  # ids are in the order of time
    third = lambda i: n // 3 * i + min(i, n % 3)
    for epoch in range(3):
        clients.put(rank.where(F.col("place").between(third(epoch), third(epoch + 1) - 1)).drop("place"), epoch, f"{path}/log")
        for client in ("steady", "stalled") if epoch == 2 else ("steady",):
            given = lambda frames, client=client, poll=epoch: frames.withColumns({"client": F.lit(client), "poll": F.lit(poll).cast("long")}).write.mode("append").parquet(f"{path}/out")
            clients.poll(s, f"{path}/log", f"{path}/places", client, "user_id", ["ts", "event_id"], given)
    return s.read.parquet(f"{path}/out").select("client", "poll", "user_id", "event_id", "value", "dropped")


_ACTIONS = ["start", "pause", "resume", "finish", "reset", "observe"]


def _commands(s, d):
    names = F.array(*[F.lit(a) for a in _ACTIONS])
    return v.read(s, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.element_at(names, (F.col("event_id") % len(_ACTIONS) + 1).cast("int")).alias("action"))


_NEXT = " ".join(f"WHEN state = '{a}' AND action = '{b}' THEN '{c}'" for (a, b), c in t.TRANSITIONS.items())
_NEXT_K = _NEXT.replace("state = ", "f.state = ").replace("action = ", "k.action = ")


@query(f"WITH RECURSIVE k AS (SELECT user_id AS session, ['start', 'pause', 'resume', 'finish', 'reset', 'observe'][event_id % 6 + 1] AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position FROM events), f AS (SELECT session, position, action, CASE {_NEXT} ELSE state END AS state, (CASE {_NEXT} END) IS NOT NULL AS legal FROM (SELECT *, 'idle' AS state FROM k WHERE position = 0) UNION ALL SELECT k.session, k.position, k.action, CASE {_NEXT_K} ELSE f.state END, (CASE {_NEXT_K} END) IS NOT NULL FROM f JOIN k ON k.session = f.session AND k.position = f.position + 1) SELECT session, position, action, state, legal FROM f")
def session_state(s, d):
    return t.session_states(_commands(s, d), ["session"], ["seq"])


@query("WITH e AS (SELECT user_id, event_type AS kind, event_id, value FROM events) SELECT 2 AS schema_version, CASE WHEN kind = 'view' THEN 'simulated_neural_measurement' ELSE 'session_status' END AS source, user_id AS session_id, CASE WHEN kind = 'view' THEN event_id END AS step_id, value AS simulated_time_s, 'unknown' AS status, NULL::VARCHAR AS reason, CASE WHEN kind = 'view' THEN event_id % 7 END AS chunk_spikes, CASE WHEN kind = 'view' THEN event_id * 2 END AS total_spikes FROM e")
def telemetry_projection(s, d):
    e = v.read(s, d, "events").select(F.when(F.col("event_type") == "view", "telemetry").otherwise("status").alias("kind"), F.col("user_id").alias("experiment_id"), F.col("event_id").alias("chunks"), F.col("value").alias("simulated_time_s"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("reason"), (F.col("event_id") % 7).alias("chunk_spikes"), (F.col("event_id") * 2).alias("total_spikes"))
    return t.projected(e)


@query("SELECT conv_id AS episode, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step, (length(text) - turn)::DOUBLE AS dx, (turn - 1)::DOUBLE AS dy, (length(text) - 2 * turn)::DOUBLE AS distance_delta, 2 * turn < length(text) AS improved FROM conversations")
def replay_flatten(s, d):
    n, k = F.length("text").cast("double"), F.col("turn").cast("double")
    step = F.struct("turn", k.alias("x0"), n.alias("x1"), F.lit(1.0).alias("y0"), k.alias("y1"), n.alias("distance_before"), (k * 2).alias("distance_after"))
    nested = v.read(s, d, "conversations").groupBy(F.col("conv_id").alias("episode")).agg(F.sort_array(F.collect_list(step)).alias("steps"))
    return t.replay_steps(nested)


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k')::BIGINT, -1) AS k FROM events")
def json_fields(s, d):
    return v.read(s, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1)).alias("k"))


def _small_graph(s, d):
    """The trade graph of nations as arrays: at most 625 edges."""
    e = v.trade(s, d)
    n = s.range(25).select(F.col("id").cast("int").alias("neuron_index"), F.when(F.col("id") % 2 == 1, -1).otherwise(1).alias("sign"))
    return n, e, ev.collect_graph(n, e, 10_000)


def _stimuli(s):
    return s.range(24).select(F.concat(F.lit("c"), F.col("id") % 4).alias("condition"), (F.col("id") * 7 % 25).cast("int").alias("neuron_index"), (F.lit(0.001) * (F.col("id") % 3 + 1)).alias("time_s")).distinct()


@query()
def lif_run(s, d):
    _, _, graph = _small_graph(s, d)
    return ev.run_conditions(graph, _stimuli(s), 0.02, ev.Lif(), 12.0)


@query()
def lif_chunked(s, d):
    _, _, graph = _small_graph(s, d)
    return ev.run_conditions(graph, _stimuli(s), 0.02, ev.Lif(), 12.0, chunk_s=0.003)


@query("""WITH t AS (SELECT c_nationkey AS source_index, s_nationkey AS target_index, count(*) AS n, CASE WHEN c_nationkey % 2 = 1 THEN -1 ELSE 1 END AS sign FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
st AS (SELECT i AS neuron_index, (-52.0 + (i % 9))::DOUBLE AS v, (i % 5)::DOUBLE AS g, (CASE WHEN i % 6 = 0 THEN 3 ELSE 0 END)::BIGINT AS r FROM range(25) q(i)), a AS (SELECT target_index AS neuron_index, sum(n * sign) AS arrived FROM t WHERE source_index < 4 GROUP BY 1),
c AS (SELECT exp(-0.1::DOUBLE / 20) AS ev, exp(-0.1::DOUBLE / 5) AS eg, 5.0::DOUBLE / (5 - 20) * (exp(-0.1::DOUBLE / 5) - exp(-0.1::DOUBLE / 20)) AS k),
m AS (SELECT neuron_index, r, r = 0 AS active, CASE WHEN r = 0 THEN -52.0 + (v + 52.0) * ev + g * k ELSE v END AS v1, CASE WHEN r = 0 THEN g * eg + coalesce(arrived, 0) * 0.275::DOUBLE ELSE g END AS g1 FROM st LEFT JOIN a USING (neuron_index), c)
SELECT neuron_index, round(CASE WHEN active AND v1 > -45.0 THEN -52.0 WHEN active AND neuron_index % 4 = 1 THEN v1 + 8.0 ELSE v1 END, 6) AS v, round(CASE WHEN active AND v1 > -45.0 THEN 0.0 ELSE g1 END, 6) AS g, CASE WHEN active AND v1 > -45.0 THEN 21 ELSE greatest(0, r - 1) END AS refractory, active AND v1 > -45.0 AS spiked FROM m""")
def lif_dataframe_step(s, d):
    e = v.trade(s, d).drop("sign")
    i = F.col("id")
    state = s.range(25).select(i.cast("int").alias("neuron_index"), (F.lit(-52.0) + i % 9).alias("v"), (i % 5).cast("double").alias("g"), F.when(i % 6 == 0, 3).otherwise(0).cast("long").alias("refractory"), F.when(i % 2 == 1, -1).otherwise(1).alias("sign"))
    due = s.range(4).select(i.cast("int").alias("source_index"))
    pulses = s.range(25).where("id % 4 = 1").select(i.cast("int").alias("neuron_index"))
    out = ev.dataframe_step(state, e, due, pulses)
    return out.select("neuron_index", F.round("v", 6).alias("v"), F.round("g", 6).alias("g"), "refractory", "spiked")


@query()
def lif_session_stream(s, d):
    """Sessions in chunks by a stateful stream over files written for it."""
    _, _, graph = _small_graph(s, d)
    path = f"{storage.shared_dir(s)}/commands-{uuid.uuid4().hex}"
    pulse = F.array(F.struct(F.lit(1).cast("long").alias("step"), F.col("id").cast("long").alias("neuron")))
    commands = s.range(0, 24, 1, 2).select(F.concat(F.lit("s"), F.col("id") % 4).alias("session"), (F.col("id") / 4).cast("long").alias("chunk"), F.lit(0.005).alias("duration_s"), pulse.alias("pulses"))
    commands.write.parquet(path)
    return run_to_end(simulation.simulate(s.readStream.schema(commands.schema).parquet(path), graph), s)



"""Window metrics, safe statistics, summaries and gates. Undefined statistics are null, never NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators import storage


def response(spikes: DataFrame, members: DataFrame, start: float, stop: float, end: float) -> DataFrame:
    """Per population: spikes before, in and after [start, stop) up to end, rates per neuron, latency, duration, persistence.

    spikes: population, neuron, time_s. members: population, members. A response is a spike at start or
    later; persistence counts from stop to the last spike, 0 if none is later. Populations without spikes have rows.
    """
    t = F.col("time_s")
    agg = spikes.groupBy("population").agg(
        F.count_if(t < start).alias("baseline_spikes"), F.count_if((t >= start) & (t < stop)).alias("stimulus_spikes"), F.count_if((t >= stop) & (t < end)).alias("post_spikes"),
        F.min(F.when((t >= start) & (t < end), t)).alias("first_response"), F.max(F.when((t >= start) & (t < end), t)).alias("last_response"),
    )
    out = members.join(agg, "population", "left").fillna(0, ["baseline_spikes", "stimulus_spikes", "post_spikes"])
    rate = lambda n, seconds: F.try_divide(F.col(n).cast("double"), F.col("members") * F.lit(seconds))
    return out.select(
        "population", "members", "baseline_spikes", "stimulus_spikes", "post_spikes",
        rate("baseline_spikes", start).alias("baseline_hz"), rate("stimulus_spikes", stop - start).alias("stimulus_hz"), rate("post_spikes", end - stop).alias("post_hz"),
        (F.col("first_response") - start).alias("latency_s"), (F.col("last_response") - F.col("first_response")).alias("duration_s"),
        F.greatest(F.lit(0.0), F.col("last_response") - stop).alias("persistence_s"), F.col("first_response").isNull().alias("no_response"),
    )


def rates(spikes: DataFrame, members: DataFrame, duration: float) -> DataFrame:
    """(population, members, spikes, rate_hz), also for silent populations."""
    n = spikes.groupBy("population").agg(F.count("*").alias("spikes"))
    return members.join(n, "population", "left").fillna(0, ["spikes"]).withColumn("rate_hz", F.try_divide(F.col("spikes").cast("double"), F.col("members") * F.lit(duration)))


def baseline_change(responses: DataFrame, controls: DataFrame) -> DataFrame:
    """responses with change_hz: the rate less that of the population's first control run."""
    first = controls.groupBy("population").agg(F.min_by("rate_hz", "run").alias("control_hz"))
    return responses.join(first, "population", "left").withColumn("change_hz", F.col("rate_hz") - F.col("control_hz"))


def similarity(patterns: DataFrame) -> DataFrame:
    """(left_run, right_run, cosine, jaccard, reason) for all pairs of runs: patterns holds run, item, count.

    The pairs are of runs, which are few; items only meet by equality. A silent run gives nulls and a reason.
    """
    p = patterns.where("count > 0")
    norms = patterns.groupBy("run").agg(F.sum(F.col("count") * F.col("count")).alias("square"), F.count_if(F.col("count") > 0).alias("active"))
    a, b = norms.select(*[F.col(c).alias(f"left_{c}") for c in norms.columns]), norms.select(*[F.col(c).alias(f"right_{c}") for c in norms.columns])
    dots = p.alias("a").join(p.alias("b"), (F.col("a.item") == F.col("b.item")) & (F.col("a.run") < F.col("b.run"))).groupBy(F.col("a.run").alias("left_run"), F.col("b.run").alias("right_run")).agg(F.sum(F.col("a.count") * F.col("b.count")).alias("dot"), F.count("*").alias("shared"))
    pairs = a.join(b, F.col("left_run") < F.col("right_run")).join(dots, ["left_run", "right_run"], "left").fillna(0, ["dot", "shared"])
    silent = (F.col("left_active") == 0) | (F.col("right_active") == 0)
    return pairs.select("left_run", "right_run", F.when(~silent, F.try_divide(F.col("dot").cast("double"), F.sqrt("left_square") * F.sqrt("right_square"))).alias("cosine"), F.when(~silent, F.try_divide(F.col("shared").cast("double"), F.col("left_active") + F.col("right_active") - F.col("shared"))).alias("jaccard"), F.when(silent, F.lit("silent pattern")).alias("reason"))


def correlation(x: Column, y: Column, floor: float = 1e-15) -> Column:
    """Pearson's; null where a spread is at most floor. Safe under ANSI, where corr() raises on zero variance."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > floor) & (sy > floor), F.try_divide(F.covar_pop(x, y), sx * sy))


def prediction(df: DataFrame, by: list[str], actual: str = "actual", predicted: str = "predicted", order: str = "position") -> DataFrame:
    """Per group: n, mae, rmse, correlation, strictly_increasing (predictions in order), min, max."""
    e = F.col(predicted) - F.col(actual)
    before = F.lag(predicted).over(Window.partitionBy(*by).orderBy(order))
    marked = df.withColumn("__rises", F.coalesce(F.col(predicted) > before, F.lit(True)))
    return marked.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), correlation(F.col(actual), F.col(predicted), 1e-12).alias("correlation"), F.bool_and("__rises").alias("strictly_increasing"), F.min(predicted).alias("min_prediction"), F.max(predicted).alias("max_prediction"))


def monotonic(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Per group: whether value strictly increases, whether it never falls."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    marked = df.select(*by, (F.col(value) > before).alias("up"), (F.col(value) >= before).alias("flat"))
    return marked.groupBy(*by).agg(F.coalesce(F.bool_and("up"), F.lit(True)).alias("strictly_increasing"), F.coalesce(F.bool_and("flat"), F.lit(True)).alias("non_decreasing"))


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group: n, min, median, 95th percentile (linear), max, mean."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min_value"), F.percentile(value, 0.5).alias("median_value"), F.percentile(value, 0.95).alias("p95_value"), F.max(value).alias("max_value"), F.avg(value).alias("mean_value"))


#: Ranges that rows are counted by, and rows of a range that are sorted without cutting it again.
CUTS, SMALL = 64, 200_000


def quantiles(df: DataFrame, by: list[str], value: str, at: list[float]) -> DataFrame:
    """(by, q, value): exact quantiles of each group by linear interpolation, whatever its size; nulls don't count, and a group of nulls has no row.

    Each wanted rank is searched for by narrowing: rows are counted by the ranges between approximate quantiles, and the range
    that holds the rank is cut again until it has few rows or one value. What is gathered is counts by range, and
    at the end at most SMALL rows for a rank. Where groups are too many to be broadcast, rows meet their group's ranges by a
    shuffle, whose hot groups adaptive execution splits.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("v"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).where("n > 0")
    wanted = sizes.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in at]))).withColumn("exact", F.col("q") * (F.col("n") - 1))
    ranks = wanted.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("exact"), F.ceil("exact"))))).select(*keys, "q", "exact", "rank", F.col("rank").alias("left"), "n", "low", "high")
    ranks = storage.materialize(ranks.withColumn("rows", F.col("n")), "ranks")  # some rows for each group
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))
    done = None
    while True:
        ready = (F.col("low") == F.col("high")) | (F.col("rows") <= SMALL)
        done = ranks.where(ready) if done is None else done.unionByName(ranks.where(ready))
        open_ = ranks.where(~ready)
        if open_.isEmpty():
            break
        ask = open_.select(*keys, "low", "high").distinct().alias("r")
        inside = rows.alias("d").join(F.broadcast(ask) if not keys else ask, same("d", "r") & F.col("d.v").between(F.col("r.low"), F.col("r.high"))).select(*[F.col(f"d.{k}") for k in keys], "d.v", "r.low", "r.high")
        span = [*keys, "low", "high"]
        cuts = inside.groupBy(*span).agg(F.array_distinct(F.percentile_approx("v", [i / CUTS for i in range(1, CUTS)], 10_000)).alias("cuts"))
        matched = inside.alias("d").join(cuts.alias("r"), same("d", "r") & (F.col("d.low") == F.col("r.low")) & (F.col("d.high") == F.col("r.high"))).select("d.*", "r.cuts")
        number = (2 * F.size(F.filter("cuts", lambda c: c < F.col("v"))) + F.array_contains("cuts", F.col("v")).cast("int")).alias("bin")  # a cut's own value is a range, so that each round gets on
        counted = matched.groupBy(*span, number).agg(F.count("*").alias("rows"), F.min("v").alias("bin_low"), F.max("v").alias("bin_high"))
        before = Window.partitionBy(*span).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 * CUTS rows
        counted = counted.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        met = open_.drop("rows").alias("d").join(counted.alias("r"), same("d", "r") & (F.col("d.low") == F.col("r.low")) & (F.col("d.high") == F.col("r.high")) & (F.col("d.left") >= F.col("r.before")) & (F.col("d.left") < F.col("r.before") + F.col("r.rows")))
        ranks = storage.materialize(met.select(*[F.col(f"d.{k}") for k in keys], "q", "exact", "rank", (F.col("d.left") - F.col("r.before")).alias("left"), "n", F.col("r.bin_low").alias("low"), F.col("r.bin_high").alias("high"), "r.rows"), "ranks")
    done = storage.materialize(done, "ranks")
    few = done.where("low <> high").select(*keys, "low", "high").distinct().alias("r")
    inside = rows.alias("d").join(few, same("d", "r") & F.col("d.v").between(F.col("r.low"), F.col("r.high"))).groupBy(*[F.col(f"d.{k}").alias(k) for k in keys], "r.low", "r.high").agg(F.array_sort(F.collect_list("d.v")).alias("vs"))
    chosen = done.alias("d").join(inside.alias("r"), same("d", "r") & (F.col("d.low") == F.col("r.low")) & (F.col("d.high") == F.col("r.high")), "left")
    one = chosen.select(*[F.col(f"d.{k}") for k in keys], "d.q", "d.exact", "d.rank", F.when(F.col("d.low") == F.col("d.high"), F.col("d.low")).otherwise(F.get("r.vs", F.col("d.left").cast("int"))).alias("v"))
    below, above = F.min_by("v", "rank"), F.max_by("v", "rank")
    share = F.first("exact") - F.floor(F.first("exact"))
    return one.groupBy(*keys, "q").agg((below + (above - below) * share).alias("value")).select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], "q", "value")


def windowed_signal(df: DataFrame, by: list[str], value: str, time: str, start: float, stop: float, late: float = 0.25) -> DataFrame:
    """Per group: peak |value|, extremes in [start, stop), mean of that window's last part, extremes afterwards (0 if none)."""
    inside = (F.col(time) >= start) & (F.col(time) < stop)
    tail = (F.col(time) >= stop - late * (stop - start)) & (F.col(time) < stop)
    x = F.col(value)
    return df.groupBy(*by).agg(F.max(F.abs(x)).alias("abs_peak"), F.min(F.when(inside, x)).alias("stimulus_min"), F.max(F.when(inside, x)).alias("stimulus_max"), F.avg(F.when(tail, x)).alias("late_mean"), F.coalesce(F.min(F.when(F.col(time) >= stop, x)), F.lit(0.0)).alias("post_min"), F.coalesce(F.max(F.when(F.col(time) >= stop, x)), F.lit(0.0)).alias("post_max"))


def top_annotations(df: DataFrame, label: str, missing: str, n: int, count: str = "spikes") -> DataFrame:
    """(label, active, spikes): active members and spikes by annotation, the n first by spikes, members, label."""
    named = F.coalesce(F.col(label), F.lit(missing))
    return df.where(F.col(count) > 0).groupBy(named.alias("label")).agg(F.count("*").alias("active"), F.sum(count).alias("spikes")).orderBy(F.desc("spikes"), F.desc("active"), "label").limit(n)


def activity_summary(chunks: DataFrame, by: list[str], value: str, order: str, time: str) -> DataFrame:
    """Per group: active chunks, peak, last active time, last chunk's value, sum over the last tenth (one chunk at least)."""
    back = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    n = F.count("*").over(Window.partitionBy(*by))
    marked = chunks.withColumn("__back", back).withColumn("__n", n)
    return marked.groupBy(*by).agg(F.count_if(F.col(value) > 0).alias("active_chunks"), F.max(value).alias("peak"), F.max(F.when(F.col(value) > 0, F.col(time))).alias("last_active"), F.max_by(value, order).alias("last_value"), F.sum(F.when(F.col("__back") <= F.greatest(F.lit(1), F.floor(F.col("__n") / 10)), F.col(value))).alias("tail_sum"))


def weighted_centroid(weight: str, *coordinates: str) -> list[Column]:
    """Weighted means; null where the weights don't add up to more than 0."""
    total = F.sum(weight)
    return [F.when(total > 0, F.try_divide(F.sum(F.col(c) * F.col(weight)), total)).alias(f"centroid_{c}") for c in coordinates]


def pooled_profile(df: DataFrame, by: list[str], coordinate: str, weight: str, bins: int) -> DataFrame:
    """(by, bin, share): weights pooled in equal bins over 0..1, as shares of the group's sum (0 if that is 0)."""
    at = F.least(F.floor(F.col(coordinate) * bins), F.lit(bins - 1)).cast("int")
    pooled = df.groupBy(*by, at.alias("bin")).agg(F.sum(weight).alias("pooled"))
    total = F.sum("pooled").over(Window.partitionBy(*by))
    return pooled.select(*by, "bin", F.coalesce(F.try_divide(F.col("pooled"), total), F.lit(0.0)).alias("share"))


def backprojection(edges: DataFrame, target: str, column: str, weight: str) -> DataFrame:
    """(target, column, share): absolute weights per column, as shares of each target's sum."""
    pooled = edges.groupBy(target, column).agg(F.sum(F.abs(weight)).alias("pooled"))
    return pooled.select(target, column, F.try_divide(F.col("pooled").cast("double"), F.sum("pooled").over(Window.partitionBy(target))).alias("share"))


def backprojected(shares: DataFrame, responses: DataFrame, target: str, column: str, epsilon: float) -> DataFrame:
    """(column, activity): |response| over epsilon carried back by shares and normalised to 1 (0 if all is 0)."""
    strong = responses.withColumn("__r", F.when(F.abs("response") > epsilon, F.abs("response")).otherwise(0.0))
    back = shares.join(strong, target).groupBy(column).agg(F.sum(F.col("share") * F.col("__r")).alias("__sum"))
    total = F.sum("__sum").over(Window.partitionBy())  # one row per column
    return back.select(column, F.coalesce(F.try_divide(F.col("__sum"), total), F.lit(0.0)).alias("activity"))


def temporal_bins(df: DataFrame, by: list[str], value: str, order: str, bins: int) -> DataFrame:
    """(by, bin, peak): the signed peak in each of bins runs of equal length (the first ones a row longer)."""
    from spindrift.functions.scalars import signed_peak

    cut = df.withColumn("bin", F.ntile(bins).over(Window.partitionBy(*by).orderBy(order)))
    return cut.groupBy(*by, "bin").agg(signed_peak(F.max(value), F.min(value)).alias("peak"))


def delay_shift(df: DataFrame, by: list[str], value: str, order: str, steps: int) -> DataFrame:
    """value as it was steps rows earlier; 0 before that."""
    return df.withColumn(value, F.lag(value, steps, 0.0).over(Window.partitionBy(*by).orderBy(order)))


def gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(name, value, low, high, passed): metrics (name, value) against thresholds (name, low, high; null: open). A missing metric fails."""
    joined = thresholds.join(metrics, "name", "left")
    ok = F.col("value").isNotNull() & (F.col("low").isNull() | (F.col("value") >= F.col("low"))) & (F.col("high").isNull() | (F.col("value") <= F.col("high")))
    return joined.select("name", "value", "low", "high", F.coalesce(ok, F.lit(False)).alias("passed"))


def repeats_agree(runs: DataFrame, key: list[str], ignore: tuple[str, ...] = ()) -> DataFrame:
    """(key, repeats, agree): whether all runs of a key have equal results, apart from the ignored columns."""
    columns = sorted(c for c in runs.columns if c not in (*key, *ignore))
    return runs.groupBy(*key).agg(F.count("*").alias("repeats"), (F.count_distinct(F.xxhash64(*columns)) == 1).alias("agree"))


def trace_difference(a: DataFrame, b: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(missing, and for each value its largest absolute difference) of two traces joined on by."""
    both = a.alias("a").join(b.alias("b"), by, "full")
    return both.agg(F.count_if(F.col(f"a.{values[0]}").isNull() | F.col(f"b.{values[0]}").isNull()).alias("missing"), *[F.max(F.abs(F.col(f"a.{v}") - F.col(f"b.{v}"))).alias(f"max_{v}_error") for v in values])


def edge_groups(edges: DataFrame, type_: str = "type", category: str = "category", missing: str = "<none>") -> DataFrame:
    """(type, category, edges, contacts, signed, excitatory, inhibitory) by type, by category and in all, in one pass.

    Rows of one grouping have null in the other; the row of all has both null.
    """
    named = edges.withColumns({"__t": F.coalesce(type_, F.lit(missing)), "__c": F.coalesce(category, F.lit(missing))})
    n, s = F.col("count"), F.col("sign")
    grouped = named.groupingSets([["__t"], ["__c"], []], "__t", "__c").agg(F.count("*").alias("edges"), F.sum(n).alias("contacts"), F.sum(n * s).cast("long").alias("signed"), F.coalesce(F.sum(F.when(s > 0, n)), F.lit(0)).cast("long").alias("excitatory"), F.coalesce(F.sum(F.when(s < 0, n)), F.lit(0)).cast("long").alias("inhibitory"))
    return grouped.withColumnsRenamed({"__t": "type", "__c": "category"})


def paired_asymmetry(df: DataFrame, family: str, side: str, value: str) -> DataFrame:
    """(family, left, right, difference): right minus left of families that have both sides."""
    wide = df.groupBy(family).pivot(side, ["L", "R"]).agg(F.sum(value))
    return wide.where("L is not null and R is not null").select(F.col(family).alias("family"), F.col("L").alias("left"), F.col("R").alias("right"), (F.col("R") - F.col("L")).alias("difference"))


def infer_columns(contacts: DataFrame, least: int, high: float, low: float) -> DataFrame:
    """(source, status, column, contacts, total, fraction, margin): each source's column by its contacts (source, column, contacts).

    unmapped: fewer than least contacts; unique: one candidate; dominant: its fraction is at least high;
    low: at least low; else ambiguous, without a column. Ties go to the smaller column.
    """
    summed = contacts.groupBy("source", "column").agg(F.sum("contacts").alias("contacts"))
    order = Window.partitionBy("source").orderBy(F.desc("contacts"), "column")
    ranked = summed.withColumns({"__rank": F.row_number().over(order), "__second": F.lead("contacts", 1, 0).over(order), "total": F.sum("contacts").over(Window.partitionBy("source")), "candidates": F.count("*").over(Window.partitionBy("source"))})
    best = ranked.where("__rank = 1").withColumn("fraction", F.try_divide(F.col("contacts").cast("double"), F.col("total"))).withColumn("margin", F.try_divide((F.col("contacts") - F.col("__second")).cast("double"), F.col("total")))
    status = F.when(F.col("total") < least, "unmapped").when(F.col("candidates") == 1, "unique").when(F.col("fraction") >= high, "dominant").when(F.col("fraction") >= low, "low").otherwise("ambiguous")
    return best.withColumn("status", status).select("source", "status", F.when(F.col("status").isin("unique", "dominant", "low"), F.col("column")).alias("column"), "contacts", "total", "candidates", "fraction", "margin")


def population_state(trace: DataFrame, members: DataFrame, rest: float) -> DataFrame:
    """(population, chunk, voltage, drive): means over members (population, neuron) of voltage over rest and of drive, each at its chunk's last step.

    trace: chunk, step, neuron, v, g.
    """
    last = trace.groupBy("chunk", "neuron").agg(F.max_by(F.struct("v", "g"), "step").alias("at"))
    return last.join(members, "neuron").groupBy("population", "chunk").agg(F.avg(F.col("at.v") - rest).alias("voltage"), F.avg("at.g").alias("drive"))


def pathway_measurement(trace: DataFrame, route: DataFrame, counts: DataFrame) -> DataFrame:
    """(chunk, neurons, voltage_mean, drive_mean, spikes) of a route (position, neuron): last samples of each chunk, and its spikes (chunk, neuron, spikes)."""
    last = trace.join(route, "neuron").groupBy("chunk", "neuron").agg(F.max_by(F.struct("v", "g"), "step").alias("at"))
    seen = last.join(counts, ["chunk", "neuron"], "left")
    return seen.groupBy("chunk").agg(F.count("*").alias("neurons"), F.avg("at.v").alias("voltage_mean"), F.avg("at.g").alias("drive_mean"), F.coalesce(F.sum("spikes"), F.lit(0)).cast("long").alias("spikes"))


def route_positions(route: DataFrame, watch: DataFrame) -> DataFrame:
    """(position, neuron, column): where each neuron of a route stands among the watched ones in ascending order; null where it isn't watched."""
    from spindrift.operators.normalize import dense_index

    return route.join(dense_index(watch.select("neuron").distinct(), "neuron", "column"), "neuron", "left").select("position", "neuron", "column")


def median_trace(trace: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """(by, time, value): the median over the watched neurons at each time; what signal metrics of a population are taken of."""
    return trace.groupBy(*by, time).agg(F.percentile(value, 0.5).alias(value))


def finite_correlation(x: Column, y: Column) -> Column:
    """Pearson's r; raises where it is not a finite number."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(r.isNotNull() & ~F.isnan(r) & (F.abs(r) < F.lit(float("inf"))), r).otherwise(F.raise_error(F.lit("correlation is not finite")).cast("double"))


def condition_summary(columns: DataFrame) -> DataFrame:
    """Per condition of columns (condition, kind, coordinate, mean, background, sources, peak, low, v_peak, v_low): active columns and
    their sources, the part of the active ones that answers with the expected sign, the drive's centroid and the extremes.

    Active: mean intensity off the background the way the kind goes. The centroid is that of dark conditions.
    """
    from spindrift.operators.vision import active

    is_active = active(F.col("mean"), F.col("kind"), F.col("background"))
    expected = F.when(F.col("kind") == "dark", F.col("peak") > 0).otherwise(F.col("low") < 0)
    weight = F.when(F.col("kind") == "dark", F.greatest(F.lit(0.0), F.col("peak")))
    marked = columns.withColumns({"__a": is_active, "__w": weight})
    return marked.groupBy("condition", "kind").agg(
        F.count_if("__a").alias("active_columns"), F.coalesce(F.sum(F.when(F.col("__a"), F.col("sources"))), F.lit(0)).cast("long").alias("active_sources"),
        F.avg(F.when(F.col("__a"), expected.cast("double"))).alias("expected_sign"), F.try_divide(F.sum(F.col("coordinate") * F.col("__w")), F.sum("__w")).alias("centroid"),
        F.max(F.greatest(F.abs("peak"), F.abs("low"))).alias("max_abs_drive"), F.max("peak").alias("max_drive"), F.min("low").alias("min_drive"), F.max("v_peak").alias("max_voltage"), F.min("v_low").alias("min_voltage"),
    )


def run_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Per group of repeated runs (wall_s, simulated_s, spikes, visited, memory): how many, median and 95th percentile of the time, median
    ratio of simulated to wall time, whether spikes and visited edges are the same in all, and the most memory."""
    same = lambda c: F.count_distinct(c) == 1
    ratio = F.try_divide(F.col("simulated_s"), F.col("wall_s"))
    return runs.groupBy(*by).agg(
        F.count("*").alias("repeats"), F.percentile("wall_s", 0.5).alias("median_s"), F.percentile("wall_s", 0.95).alias("p95_s"), F.percentile(ratio, 0.5).alias("median_ratio"),
        same("spikes").alias("same_spikes"), same("visited").alias("same_visited"), F.max("memory").alias("max_memory"),
    )

"""Model fitting: on small samples each fit in one task, parallel over a grid of settings and held-out rows; linear ones on any number of rows from aggregated moments."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators import folds, storage


def standardize(train: np.ndarray, *others: np.ndarray, floor: float = 1e-12) -> list[np.ndarray]:
    """Columns to mean 0, deviation 1 (population) by the training rows; constant columns become 0."""
    mean, sd = train.mean(0), train.std(0)
    scale = np.where(sd > floor, sd, np.inf)
    return [(x - mean) / scale for x in (train, *others)]


def ridge_dual(x: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    """Weights of a ridge regression without intercept, solved in the space of samples (few rows, many features)."""
    return x.T @ np.linalg.solve(x @ x.T + alpha * np.eye(len(x)), y)


def ridge_primal(x: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    """Weights with a last row of intercepts, which isn't penalised."""
    z = np.hstack([x, np.ones((len(x), 1))])
    penalty = alpha * np.eye(z.shape[1])
    penalty[-1, -1] = 0
    return np.linalg.solve(z.T @ z + penalty, z.T @ y)


def fit_ridge(x: np.ndarray, y: np.ndarray, alpha: float):
    """A predictor: standardized features, centred target; the mean where every feature is constant."""
    (z,), center = standardize(x), y.mean(0)
    weights = ridge_dual(z, y - center, alpha)
    return lambda new: standardize(x, new)[1] @ weights + center


def pca(x: np.ndarray, k: int, whiten: bool = False):
    """A projection on the first k principal components; whiten: to unit variance. Signs make each component's largest loading positive."""
    center = x.mean(0)
    _, s, v = np.linalg.svd(x - center, full_matrices=False)
    k = min(k, int((s > 1e-12).sum()))
    v = v[:k] * np.sign(v[np.arange(k), np.abs(v[:k]).argmax(1)])[:, None]
    scale = s[:k] / np.sqrt(max(1, len(x) - 1)) if whiten else 1.0
    return lambda new: (new - center) @ v.T / scale


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


def fit_rbf(x: np.ndarray, y: np.ndarray, alpha: float, gamma: float):
    """Kernel ridge on standardized features and centred targets."""
    (z,), center = standardize(x), y.mean(0)
    dual = np.linalg.solve(rbf(z, z, gamma) + alpha * np.eye(len(z)), y - center)
    return lambda new: rbf(standardize(x, new)[1], z, gamma) @ dual + center


def pipeline(x: np.ndarray, y: np.ndarray, components: int, alpha: float, gamma: float | None = None, whiten: bool = False):
    """Standardize, project, fit: linear without gamma, else with the kernel."""
    (z,) = standardize(x)
    project = pca(z, components, whiten)
    fit = fit_rbf(project(z), y, alpha, gamma) if gamma else fit_ridge(project(z), y, alpha)
    return lambda new: fit(project(standardize(x, new)[1]))


def held_out_score(x: np.ndarray, target: np.ndarray, components: int, alpha: float, gamma: float | None, kind: str) -> float | None:
    """Leave-one-out score of one setting: mean absolute error, or accuracy of the largest of one-hot scores (ties: the first class)."""
    if len(x) < 2:
        return None
    classes = np.unique(target)
    y = target.astype(np.float64)[:, None] if kind == "regression" else (target[:, None] == classes[None]).astype(np.float64)
    errors = []
    for held in range(len(x)):
        keep = np.arange(len(x)) != held
        out = pipeline(x[keep], y[keep], components, alpha, gamma)(x[held : held + 1])[0]
        errors.append(abs(out[0] - y[held, 0]) if kind == "regression" else float(out.argmax() == y[held].argmax()))
    return float(np.mean(errors))


def loocv_sets(samples: DataFrame, grid: DataFrame, kind: str = "classification") -> DataFrame:
    """(set, components, alpha, gamma, n, score): leave-one-out of every setting of grid in each set of samples (set, row, features, target).

    A set is one experiment's samples, few by nature; sets are worked side by side. A set of one row has a null score.
    """
    settings = [(int(r["components"]), float(r["alpha"]), r["gamma"]) for r in grid.select("components", "alpha", F.col("gamma").cast("double").alias("gamma")).collect()]

    def work(key, table):
        table = table.sort_by("row")
        x = np.array(table.column("features").to_pylist(), np.float64)
        target = np.array(table.column("target").to_pylist())
        rows = [(key[0].as_py(), c, a, g, len(x), held_out_score(x, target, c, a, g, kind)) for c, a, g in settings]
        types = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.float64())
        return pa.table({name: pa.array([r[i] for r in rows], t) for i, (name, t) in enumerate(zip(("set", "components", "alpha", "gamma", "n", "score"), types, strict=True))})

    return storage.dealt(samples.select("set", "row", "features", "target"), "set").groupBy("set").applyInArrow(work, "set long, components int, alpha double, gamma double, n long, score double")


def best_settings(scored: DataFrame, by: list[str], largest: bool = True) -> DataFrame:
    """The best row of each group; ties go to fewer components, then smaller alpha, then smaller gamma."""
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last("score") if largest else F.asc_nulls_last("score"), "components", "alpha", "gamma")
    return scored.withColumn("__at", F.row_number().over(order)).where("__at = 1").drop("__at")


def loocv(samples: DataFrame, grid: DataFrame, kind: str = "regression", most: int = 5_000) -> DataFrame:
    """(components, alpha, gamma, n, score): leave-one-out over samples (row, features, target) for every row of grid (components, alpha, gamma).

    regression: mean absolute error; classification: accuracy of the largest of one-hot scores (ties: the
    first class). Each pair of setting and held-out row is a task's row; the samples go along with the
    function, and more than most of them raise.
    """
    if samples.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} samples: see ridge_loocv() and loocv_sets()")
    table = samples.orderBy("row").toPandas()
    x = np.array(table["features"].tolist(), np.float64)
    target = table["target"].to_numpy()
    classes = sorted(set(target.tolist()))
    y = target.astype(np.float64)[:, None] if kind == "regression" else (target[:, None] == np.array(classes)[None]).astype(np.float64)

    def run(frames):
        for pdf in frames:
            errors = []
            for held, c, a, g in pdf[["held", "components", "alpha", "gamma"]].itertuples(index=False):
                keep = np.arange(len(x)) != held
                out = pipeline(x[keep], y[keep], int(c), a, g if g and g == g else None)(x[held : held + 1])[0]
                errors.append(abs(out[0] - y[held, 0]) if kind == "regression" else float(out.argmax() == y[held].argmax()))
            yield pdf.assign(score=errors)

    jobs = grid.select("components", "alpha", F.col("gamma").cast("double").alias("gamma")).crossJoin(samples.sparkSession.range(len(x)).withColumnRenamed("id", "held")).repartition(F.col("held"))
    scored = jobs.mapInPandas(run, "components int, alpha double, gamma double, held long, score double")
    return scored.groupBy("components", "alpha", "gamma").agg(F.count("*").alias("n"), F.avg("score").alias("score"))


def _merged(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and centred scatter matrix of all parts together."""
    n, mean, scatter = parts[0]
    for more, m, s in parts[1:]:
        away, both = m - mean, n + more
        n, mean, scatter = both, mean + away * (more / both), scatter + s + np.outer(away, away) * (n * more / both)
    return n, mean, scatter


def moments(samples: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and centred scatter matrix over all rows; columns: arrays of one length each, or numbers, side by side.

    Each task sums its own rows; 16 tasks merge those sums, and the driver merges 16.
    """
    shape = "n long, mean array<double>, scatter array<double>"

    def packed(n, mean, scatter):
        return pd.DataFrame({"n": [n], "mean": [mean.tolist()], "scatter": [scatter.ravel().tolist()]})

    def unpacked(pdf):
        return [(n, np.array(m), np.array(s).reshape(len(m), len(m))) for n, m, s in zip(pdf["n"], pdf["mean"], pdf["scatter"], strict=True)]

    def sums(frames):
        total = []
        for pdf in frames:
            if len(pdf):
                x = joined(pdf, columns)
                mean = x.mean(0)
                total = [_merged([*total, (len(x), mean, (x - mean).T @ (x - mean))])]
        if total:
            yield packed(*total[0])

    def merge(frames):
        parts = [p for pdf in frames for p in unpacked(pdf)]
        if parts:
            yield packed(*_merged(parts))

    parts = unpacked(samples.select(*columns).mapInPandas(sums, shape).repartition(16).mapInPandas(merge, shape).toPandas())
    return _merged(parts) if parts else (0, np.zeros(0), np.zeros((0, 0)))


def joined(pdf: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """The columns of a frame side by side, a row each."""
    return np.hstack([np.array(pdf[c].tolist(), np.float64).reshape(len(pdf), -1) for c in columns])


def components_of(scatter: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of scatter matrices (..., d, d) and, as columns, their vectors: pca() from moments."""
    values, vectors = np.linalg.eigh(scatter)
    values, vectors = values[..., ::-1][..., :k], vectors[..., ::-1][..., :k]
    largest = np.take_along_axis(vectors, np.abs(vectors).argmax(-2)[..., None, :], -2)
    return values, vectors * np.sign(largest)


def pca_projection(samples: DataFrame, features: str, k: int):
    """pca() of any number of rows: their scatter matrix is aggregated. Components beyond the rank are left out."""
    n, center, scatter = moments(samples, [features])
    values, vectors = components_of(scatter, k)
    v = vectors[:, values > 1e-12 * max(values.max(initial=0), 0)]
    return lambda new: (new - center) @ v


def ridge_loocv(samples: DataFrame, grid: DataFrame) -> DataFrame:
    """loocv() of the linear pipeline on numbers, for any number of samples (row, features, target).

    The moments of all samples are aggregated; those without a held-out row follow by taking it away, and
    the standardizer, the components and the weights come from these. One pass over the rows, in parallel.
    """
    settings = [(r["components"], r["alpha"], r["gamma"]) for r in grid.select("components", "alpha", F.col("gamma").cast("double").alias("gamma")).collect()]
    n, mean, scatter = moments(samples, ["features", "target"])
    most = max(s[0] for s in settings)

    def run(frames):
        for pdf in frames:
            for start in range(0, len(pdf), 256):
                w = joined(pdf[start : start + 256], ["features", "target"])
                away, rest = w - mean, max(1, n - 1)
                m, s = mean - away / rest, scatter - np.einsum("bi,bj->bij", away, away) * (n / rest)
                sd = np.sqrt(np.maximum(0, np.einsum("bii->bi", s)[:, :-1]) / rest)
                scale = np.where(sd > 1e-12, 1 / np.maximum(sd, 1e-300), 0.0)
                values, vectors = components_of(s[:, :-1, :-1] * scale[:, :, None] * scale[:, None, :], most)
                spread = np.sqrt(np.maximum(values, 0) / rest)
                inside = (values > 1e-12 * values[:, :1]) & (spread > 1e-12)
                unit = np.where(inside, 1 / np.where(inside, spread, 1.0), 0.0)
                z = np.einsum("bi,bik->bk", (w[:, :-1] - m[:, :-1]) * scale, vectors) * unit
                zy = np.einsum("bi,bik->bk", s[:, :-1, -1] * scale, vectors) * unit
                for c, a, g in settings:  # components are uncorrelated, so each has its weight alone
                    out = m[:, -1] + (z[:, :c] * zy[:, :c]).sum(1) / (rest + a)
                    yield pd.DataFrame({"components": [c], "alpha": [a], "gamma": [g], "n": [len(w)], "score": [np.abs(out - w[:, -1]).sum()]})

    made = samples.select("features", "target").mapInPandas(run, "components int, alpha double, gamma double, n long, score double")
    return made.groupBy("components", "alpha", "gamma").agg(F.sum("n").alias("n"), (F.sum("score") / F.sum("n")).alias("score"))


def best_setting(scored: DataFrame, largest: bool = True) -> DataFrame:
    """The best row; ties go to fewer components, then smaller alpha, then smaller gamma."""
    return scored.orderBy(F.desc("score") if largest else F.asc("score"), "components", "alpha", "gamma").limit(1)


def fisher_scores(samples: DataFrame, features: str, label: str, floor: float = 1e-9) -> DataFrame:
    """(feature, score): |mean1 - mean0| / max(sqrt((var0 + var1) / 2), floor) of each element of features."""
    long = samples.select(label, F.posexplode(features).alias("feature", "x"))
    one, zero = F.when(F.col(label) == 1, F.col("x")), F.when(F.col(label) == 0, F.col("x"))
    agg = long.groupBy("feature").agg(F.avg(one).alias("m1"), F.avg(zero).alias("m0"), F.var_pop(one).alias("v1"), F.var_pop(zero).alias("v0"))
    return agg.select("feature", (F.abs(F.col("m1") - F.col("m0")) / F.greatest(F.sqrt((F.col("v0") + F.col("v1")) * 0.5), F.lit(floor))).alias("score"))


def rest_scores(samples: DataFrame, features: str, label: str, floor: float = 1e-9) -> DataFrame:
    """(label, feature, score): fisher_scores of each label against all other rows, by moments of each label and of all; any number of labels and rows.

    A label that no row or every row has gives a score against nothing: null. Null labels are rest to all.
    """
    long = samples.select(F.col(label).alias("label"), F.posexplode(features).alias("feature", "x"))
    middle = long.groupBy("feature").agg(F.avg("x").alias("c"))  # sums of squares about the middle keep their digits
    own = long.join(F.broadcast(middle), "feature").groupBy("label", "feature").agg(F.count("*").alias("n"), F.sum(F.col("x") - F.col("c")).alias("s"), F.sum((F.col("x") - F.col("c")) * (F.col("x") - F.col("c"))).alias("q"))
    all_ = own.groupBy("feature").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "s", "q")])
    both = own.join(F.broadcast(all_), "feature").where("label is not null")  # a row for each feature
    rest = [F.col(f"all_{c}") - F.col(c) for c in ("n", "s", "q")]
    mean, var = (lambda n, s, q: F.try_divide(s, n)), (lambda n, s, q: F.greatest(F.try_divide(q, n) - F.try_divide(s, n) * F.try_divide(s, n), F.lit(0.0)))
    mine = [F.col(c) for c in ("n", "s", "q")]
    score = F.abs(mean(*mine) - mean(*rest)) / F.greatest(F.sqrt((var(*mine) + var(*rest)) * 0.5), F.lit(floor))
    return both.select("label", "feature", F.when(rest[0] > 0, score).alias("score"))


def top_per_label(scores: DataFrame, k: int) -> DataFrame:
    """The k best features of each label; ties by feature."""
    order = Window.partitionBy("label").orderBy(F.desc("score"), "feature")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_features(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "feature").limit(k)


def standardized(df: DataFrame, features: str, key: str, floor: float = 1e-12) -> DataFrame:
    """(key, feature, z): the standardizer as aggregates, for any number of rows."""
    long = df.select(key, F.posexplode(features).alias("feature", "x"))
    moments = long.groupBy("feature").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return long.join(F.broadcast(moments), "feature").select(key, "feature", F.when(F.col("s") > floor, (F.col("x") - F.col("m")) / F.col("s")).otherwise(0.0).alias("z"))  # moments: one row per feature


def affine(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, slope, intercept): least squares; a constant x gives slope null."""
    slope = F.try_divide(F.covar_pop(x, y), F.var_pop(x))
    return df.groupBy(*by).agg(slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept"))


def motor_rates(rates: DataFrame, gain: float, most: float, click_hz: float = 20.0) -> DataFrame:
    """(dx, dy, click) from a map column rates: clamped differences right - left and down - up; absent rates are 0."""
    r = lambda k: F.coalesce(F.try_element_at("rates", F.lit(k)), F.lit(0.0))
    bound = lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), x))
    return rates.withColumns({"dx": bound((r("right") - r("left")) * gain), "dy": bound((r("down") - r("up")) * gain), "click": r("click") >= click_hz})


def cursor_path(commands: DataFrame, by: list[str], order: str, dx: str, dy: str, step: float, start: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """(by, position, x, y): a cursor moved by commands and kept inside 0..1 after each."""
    return folds.folded(commands, by, [order], {"x": F.col(dx) * step, "y": F.col(dy) * step}, folds.clamped_walk(0.0, 1.0, start, ("x", "y")), "x double, y double")


def hysteresis(scores: DataFrame, by: list[str], order: str, margin: str, threshold: float) -> DataFrame:
    """(by, position, action): the sign of margin, but a reversal needs |margin| of at least threshold."""

    def choose(last, m):
        raw = 1 if m >= 0 else -1
        return last if last and raw != last and abs(m) < threshold else raw

    return folds.folded(scores, by, [order], {"m": F.col(margin).cast("double")}, folds.machine((-1, 0, 1), 0, choose, ("m",), lambda before, after, m: {"action": after}), "action int")


def episodes(path: DataFrame, by: list[str], order: str, target: tuple[float, float], radius: float) -> DataFrame:
    """(by, steps, first_distance, last_distance, reduction, success, nonincreasing) of cursor paths."""
    d = F.hypot(F.col("x") - target[0], F.col("y") - target[1])
    w = Window.partitionBy(*by).orderBy(order)
    marked = path.withColumn("d", d).withColumn("__ok", F.coalesce(F.col("d") <= F.lag("d").over(w), F.lit(True)))
    out = marked.groupBy(*by).agg(F.count("*").alias("steps"), F.min_by("d", order).alias("first_distance"), F.max_by("d", order).alias("last_distance"), F.bool_and("__ok").alias("nonincreasing"))
    return out.withColumns({"reduction": F.col("first_distance") - F.col("last_distance"), "success": F.col("last_distance") <= radius})




def voltage_command(state: DataFrame, gains: tuple[float, float] = (1.0, 1.0), deadzone: float = 0.0, most: float = 1.0) -> DataFrame:
    """(dx, dy, click) from a map column state of population voltages: right - left and backward - forward, small ones 0, times gain, clamped. Never a click; absent populations count 0."""
    v = lambda k: F.coalesce(F.try_element_at("state", F.lit(k)), F.lit(0.0))
    moved = lambda plus, minus, gain: F.greatest(F.lit(-most), F.least(F.lit(most), F.when(F.abs(v(plus) - v(minus)) <= deadzone, 0.0).otherwise(v(plus) - v(minus)) * gain))
    return state.withColumns({"dx": moved("steer_right", "steer_left", gains[0]), "dy": moved("backward", "forward", gains[1]), "click": F.lit(False)})


def heldout_affine(df: DataFrame, by: list[str], x: str, y: str, train: Column) -> DataFrame:
    """(by, n, mae, rmse, accuracy) of a line fitted to the train rows on the others; accuracy: predictions on y's side of the train mean."""
    fitted = affine(df.where(train), by, x, y).join(df.where(train).groupBy(*by).agg(F.avg(y).alias("center")), by)
    guess = F.col("slope") * F.col(x) + F.col("intercept")
    test = df.where(~train).join(fitted, by).withColumns({"__e": guess - F.col(y), "__same": ((guess > F.col("center")) == (F.col(y) > F.col("center"))).cast("double")})
    return test.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs("__e")).alias("mae"), F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse"), F.avg("__same").alias("accuracy"))


def evaluate(x: np.ndarray, y: np.ndarray, train: np.ndarray, settings: list[tuple], kind: str, whiten: bool = False) -> tuple[tuple, float | None, np.ndarray]:
    """The setting (components, alpha, gamma) that leave-one-out on the train rows likes best (the first of equals), its score there,
    and the fitted pipeline's outputs for the other rows: numbers, or a score per class."""
    largest = kind == "classification"
    scored = [(held_out_score(x[train], y[train], c, a, g, kind), (c, a, g)) for c, a, g in sorted(settings, key=lambda s: (s[0], s[1], s[2] or 0.0))]
    best = max if largest else min
    score, setting = best(scored, key=lambda s: s[0]) if scored[0][0] is not None else scored[0]
    goal = y[train].astype(np.float64)[:, None] if not largest else (y[train][:, None] == np.unique(y[train])[None]).astype(np.float64)
    return setting, score, pipeline(x[train], goal, *setting, whiten=whiten)(x[~train])


def benchmark_sets(samples: DataFrame, grid: DataFrame, kind: str = "classification", whiten: bool = False, least: float = 0.0) -> DataFrame:
    """(set, modality, row, actual, predicted, components, alpha, gamma, train_score, test_score, passes): every held-out row of every
    set, by the modality and setting that leave-one-out on its train rows likes best.

    samples: set, modality, row, features, target, train. Sets are experiments, few rows each, worked side by side; of
    equal modalities the first by name wins. test_score: accuracy or mean absolute error over the held-out rows; passes:
    at least (error: at most) least.
    """
    settings = [(int(r["components"]), float(r["alpha"]), r["gamma"]) for r in grid.select("components", "alpha", F.col("gamma").cast("double").alias("gamma")).collect()]
    largest = kind == "classification"

    def work(key, table):
        found = []
        for modality in sorted(set(table.column("modality").to_pylist())):
            own = table.filter(pa.compute.equal(table.column("modality"), modality)).sort_by("row")
            x, y, train = (np.array(own.column(c).to_pylist()) for c in ("features", "target", "train"))
            if train.sum() < 2 or train.all():
                continue
            setting, score, out = evaluate(x.astype(np.float64), y, train, settings, kind, whiten)
            guess = np.unique(y[train])[out.argmax(1)].astype(np.float64) if largest else out[:, 0]
            found.append((-score if largest else score, modality, setting, np.array(own.column("row"))[~train], y[~train].astype(np.float64), guess))
        rows = []
        if found:
            score, modality, setting, ids, actual, guess = min(found, key=lambda f: f[:2])
            test = float(np.mean(actual == guess) if largest else np.mean(np.abs(actual - guess)))
            rows = [(key[0].as_py(), modality, int(i), a, p, *setting, abs(score), test, test >= least if largest else test <= least) for i, a, p in zip(ids.tolist(), actual.tolist(), guess.tolist(), strict=True)]
        types = (("set", pa.int64()), ("modality", pa.string()), ("row", pa.int64()), ("actual", pa.float64()), ("predicted", pa.float64()), ("components", pa.int32()), ("alpha", pa.float64()), ("gamma", pa.float64()), ("train_score", pa.float64()), ("test_score", pa.float64()), ("passes", pa.bool_()))
        return pa.table({name: pa.array([r[i] for r in rows], t) for i, (name, t) in enumerate(types)})

    chosen = samples.select("set", "modality", "row", "features", "target", "train")
    return storage.dealt(chosen, "set").groupBy("set").applyInArrow(work, "set long, modality string, row long, actual double, predicted double, components int, alpha double, gamma double, train_score double, test_score double, passes boolean")

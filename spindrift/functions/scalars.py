"""Scalar functions as column expressions: texts, labels, geometry, clamping, rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def deadzone(x: Column, epsilon: float) -> Column:
    """0 where |x| is at most epsilon."""
    return F.when(F.abs(x) <= epsilon, F.lit(0.0)).otherwise(x)


def half_up(x: Column) -> Column:
    """floor(x + 0.5); F.rint is half-even."""
    return F.floor(x + 0.5)


def whole_steps(duration: Column, dt: float, tolerance: float = 1e-9) -> Column:
    """duration / dt as a long; null where it isn't whole."""
    steps = F.rint(duration / dt)
    return F.when(F.abs(duration / dt - steps) < tolerance, steps.cast("long"))


def position(x: Column, extent: Column) -> Column:
    """Pixel to 0..1 over extent pixels."""
    return clamp(x / F.greatest(F.lit(1.0), extent - 1), 0.0, 1.0)


#: What full case folding makes of characters where it isn't their lower case; one character or several.
FOLDED = {c: c.casefold() for c in map(chr, range(0x80, 0x1E943)) if c.isalpha() and c.casefold() != c.lower()}
_ONE = {c: x for c, x in FOLDED.items() if len(x) == 1}
_MORE = {c: x for c, x in FOLDED.items() if len(x) > 1}


def normalized_goal(text: Column) -> Column:
    """Case folded (lower case, and the letters that folding writes out), white space collapsed; null where nothing is left."""
    low = F.translate(F.lower(text), "".join(_ONE), "".join(_ONE.values()))
    wide = low
    for letter, out in _MORE.items():
        wide = F.replace(wide, F.lit(letter), F.lit(out))
    folded = F.when(low.rlike(f"[{''.join(_MORE)}]"), wide).otherwise(low)  # few texts have such letters
    return F.nullif(F.trim(F.regexp_replace(folded, r"\s+", " ")), F.lit(""))


def normalized_header(text: Column) -> Column:
    """Lower-case words joined by underscores."""
    return F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_")


#: Column labels, and the grid position of p = q = 0. Fixed values.
LABEL = r"^ME_([LR])_col_(\d+)_(\d+)$"
P_ZERO, Q_ZERO = 19, 18


def label_parts(label: Column) -> list[Column]:
    """side, grid_row, grid_column of a column label; nulls where it isn't one."""
    ok = label.rlike(LABEL)
    return [F.when(ok, F.regexp_extract(label, LABEL, 1)).alias("side"), F.when(ok, F.regexp_extract(label, LABEL, 2)).cast("int").alias("grid_row"), F.when(ok, F.regexp_extract(label, LABEL, 3)).cast("int").alias("grid_column")]


def label_pq(row: Column, column: Column) -> list[Column]:
    return [(column - P_ZERO).alias("p"), (row - Q_ZERO).alias("q")]


def label_of(side: Column, p: Column, q: Column) -> Column:
    return F.format_string("ME_%s_col_%02d_%02d", side, q + Q_ZERO, p + P_ZERO)


def family_side(name: Column) -> list[Column]:
    """family and side of names that end in _L or _R; nulls for others."""
    pattern = r"^(.*)_([LR])$"
    return [F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1)).alias("family"), F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 2)).alias("side")]


def optional_id(x: Column) -> Column:
    """Negative ids mean none."""
    return F.when(x >= 0, x)


def elevation_azimuth(forward: Column, right: Column, up: Column) -> list[Column]:
    """Degrees of a vector of any length but 0."""
    norm = F.sqrt(forward * forward + right * right + up * up)
    return [F.degrees(F.asin(clamp(F.try_divide(up, norm), -1.0, 1.0))).alias("elevation_deg"), F.degrees(F.atan2(right, forward)).alias("azimuth_deg")]


def screen(forward: Column, right: Column, up: Column, horizontal_deg: float, vertical_deg: float) -> list[Column]:
    """visible, u, v: perspective projection on a screen of the given fields of view; u and v are null off it."""
    x = F.try_divide(right, forward) / math.tan(math.radians(horizontal_deg) / 2)
    y = F.try_divide(up, forward) / math.tan(math.radians(vertical_deg) / 2)
    seen = (forward > 0) & (F.abs(x) <= 1) & (F.abs(y) <= 1)
    seen = F.coalesce(seen, F.lit(False))
    return [seen.alias("visible"), F.when(seen, (x + 1) / 2).alias("u"), F.when(seen, (1 - y) / 2).alias("v")]


def filter_gain(dt: float, tau: float) -> float:
    """Of a first-order low-pass."""
    return 1 - math.exp(-dt / tau)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def binary_label(position: Column, center: float) -> Column:
    return F.when(position < center, 0).otherwise(1)


def sign_label(x: Column) -> Column:
    return F.signum(x).cast("int")


def threeway_label(position: Column, center: float, band: float) -> Column:
    """0 below, 1 within band of, 2 above the centre."""
    return F.when(position < center - band, 0).when(position > center + band, 2).otherwise(1)


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == label).cast("double"))


def signed_peak(values_max: Column, values_min: Column) -> Column:
    """The extreme of larger magnitude; the positive one of equals."""
    return F.when(F.abs(values_max) >= F.abs(values_min), values_max).otherwise(values_min)


def first_argmax(scores: Column) -> Column:
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def index_list(text: Column) -> Column:
    """Whole non-negative numbers of a comma list; null if any part isn't one or exceeds what a double holds exactly."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x))
    ok = F.forall(parts, lambda x: x.rlike(r"^\d{1,16}$"))
    numbers = F.transform(parts, lambda x: F.try_to_number(x, F.lit("9999999999999999")).cast("long"))
    return F.when(ok & F.forall(numbers, lambda x: x <= 2**53 - 1), numbers)


def utc_stamp(at: Column) -> Column:
    """An instant as ISO 8601 text in UTC with microseconds."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def frame_at(time_s: Column, rate_hz: float, frames: int) -> Column:
    """The frame that shows at a time, the last one from its start on."""
    return F.least(F.floor(time_s * rate_hz + 1e-12), F.lit(frames - 1)).cast("long")


def relative_position(target: Column, cursor: Column, center: float = 0.5, low: float = 0.0, high: float = 1.0) -> Column:
    """Where a target appears around a cursor that stays at the centre, kept within bounds."""
    return clamp(F.lit(center) + target - cursor, low, high)

"""Requests that come from outside, with their bounds; unknown fields and values out of bounds raise ValueError."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable
from dataclasses import dataclass, field

#: Largest numbers of things in one request. Fixed values.
BOUNDS = {"indices": 4096, "watch": 32, "populations": 16, "seeds": 64, "nodes": 256, "edges": 2048}


def _indices(name: str, values, most: int, least: int = 0) -> tuple[int, ...]:
    values = tuple(values)
    if not least <= len(values) <= most or len(set(values)) != len(values) or any(not isinstance(v, int) or v < 0 for v in values):
        raise ValueError(f"{name}: {least} to {most} different non-negative numbers")
    return values


def _within(name: str, x: float, low: float, high: float) -> None:
    if not low <= x <= high:
        raise ValueError(f"{name}: {low} to {high}, not {x}")


@dataclass(frozen=True)
class Stimulus:
    neuron_indices: tuple[int, ...] = (0,)
    start_s: float = 0.0
    stop_s: float = 0.05
    interval_ms: float = 5.0
    amplitude_mv: float = 8.0

    def __post_init__(self):
        object.__setattr__(self, "neuron_indices", _indices("stimulus", self.neuron_indices, BOUNDS["indices"], 1))
        _within("start_s", self.start_s, 0, 60)
        _within("interval_ms", self.interval_ms, 0.1, 10_000)
        if not self.start_s < self.stop_s <= 60 or not 0 < self.amplitude_mv <= 100:
            raise ValueError("a stimulus stops after its start, within 60 s, and has 0 to 100 mV")


@dataclass(frozen=True)
class Population:
    name: str
    neuron_indices: tuple[int, ...]

    def __post_init__(self):
        if not re.fullmatch(r"[A-Za-z0-9 _-]{1,40}", self.name):
            raise ValueError("a population's name has 1 to 40 letters, digits, spaces, _ or -")
        object.__setattr__(self, "neuron_indices", _indices(self.name, self.neuron_indices, BOUNDS["indices"], 1))


@dataclass(frozen=True)
class Experiment:
    duration_s: float = 1.0
    seed: int = 0
    chunk_duration_s: float = 0.02
    telemetry_hz: float = 10.0
    flush_subnormal: bool = False
    watch_indices: tuple[int, ...] = (0,)
    visualization_indices: tuple[int, ...] = (0,)
    populations: tuple[Population, ...] = (Population("stimulus targets", (0,)),)
    stimulus: Stimulus = field(default_factory=Stimulus)

    def __post_init__(self):
        _within("duration_s", self.duration_s, 0.01, 60)
        _within("seed", self.seed, 0, 2**32 - 1)
        _within("chunk_duration_s", self.chunk_duration_s, 0.001, 0.25)
        _within("telemetry_hz", self.telemetry_hz, 1, 30)
        object.__setattr__(self, "watch_indices", _indices("watch", self.watch_indices, BOUNDS["watch"]))
        object.__setattr__(self, "visualization_indices", _indices("visualization", self.visualization_indices, BOUNDS["indices"]))
        if len(self.populations) > BOUNDS["populations"] or len({p.name for p in self.populations}) != len(self.populations):
            raise ValueError("at most 16 populations of different names")
        if self.chunk_duration_s > self.duration_s or self.stimulus.stop_s > self.duration_s:
            raise ValueError("chunks and stimulus lie within the duration")


def parse(kind: type, raw: dict):
    """A request from JSON-like data; fields that kind doesn't have raise."""
    known = {f.name for f in dataclasses.fields(kind)}
    if set(raw) - known:
        raise ValueError(f"unknown fields: {', '.join(sorted(set(raw) - known))}")
    made = dict(raw)
    if kind is Experiment:
        if "stimulus" in made:
            made["stimulus"] = parse(Stimulus, made["stimulus"])
        if "populations" in made:
            made["populations"] = tuple(parse(Population, p) for p in made["populations"])
    return kind(**made)


class Registry:
    """Named factories, none of them active until asked for by name."""

    def __init__(self):
        self._makers: dict[str, Callable] = {}

    def register(self, name: str, maker: Callable) -> None:
        if name in self._makers:
            raise ValueError(f"{name} is registered already")
        self._makers[name] = maker

    def build(self, name: str | None, **options):
        """None where nothing is asked for; an unknown name raises KeyError."""
        if name is None:
            return None
        if name not in self._makers:
            raise KeyError(name)
        return self._makers[name](**options)


def memory_limit(text: str) -> str:
    """A limit such as 512MB or 4GB; anything else raises."""
    if not re.fullmatch(r"[1-9][0-9]*(?:MB|GB)", text):
        raise ValueError(f"{text!r} is no memory limit")
    return text


def sql_text(path: str) -> str:
    """A path as an SQL string: single quotes doubled."""
    doubled = path.replace("'", "''")
    return f"'{doubled}'"

"""Plain records shared by the engine."""

from __future__ import annotations

import enum
import json
import os
import tomllib
import types
import typing
from collections.abc import Mapping
from dataclasses import dataclass, field


class Stage(enum.IntEnum):
    """Stages in the order in which they count as reached. A stage's side branch (a failure, the layout step) stands before it,
    as work that the stage needs goes on meanwhile."""

    START_HANDLER = 10
    CHUNKS = 20
    BULK_COPY = 30
    BULK_VALIDATION_FAILED = 39
    BULK_VALIDATION = 40
    APPLY = 50
    LAYOUT = 59
    PRE_VALIDATION = 60
    VALIDATION = 70
    SWAP_FAILED = 79
    SWAP = 80
    DONE = 90


class ChunkStatus(enum.StrEnum):
    NOT_STARTED = "not_started"
    IN_PROGRESS = "in_progress"
    DUPLICATE_KEY = "duplicate_key"
    DONE = "done"


class Unmatched(enum.StrEnum):
    NOT_UPDATED = "not_updated"
    NOT_REMOVED = "not_removed"


@dataclass(frozen=True)
class LayoutSpec:
    """Takes the place of an index: how rows are laid out, and whether the columns must be unique."""

    name: str
    columns: tuple[str, ...]
    unique: bool = False


@dataclass
class Config:
    """Settings of a copy. Unknown names are refused when it is made from a mapping, a file or the environment."""

    source: str = "source"
    destination: str = "destination"
    #: Where the two sides are. If both are given and differ, values are compared across types and names aren't swapped automatically.
    source_endpoint: str | None = None
    destination_endpoint: str | None = None
    min_chunk_size: int = 100_000
    max_chunk_count: int = 200
    auto_swap: bool = False
    preferred_window: tuple[str, str] = ("00:00", "23:59")
    skip_bulk_copy: bool = False
    disable_apply: bool = False
    disable_handler: bool = False
    operation: str = "base"
    operation_settings: dict = field(default_factory=dict)
    layouts: tuple[LayoutSpec, ...] = ()
    layouts_at_once: int = 4
    #: Rows of a task and chunks copied at once, and how they are tuned.
    min_batch_size: int = 1000
    batch_size_step: int = 500
    max_batch_size: int = 3000
    min_threads: int = 1
    threads_step: int = 1
    max_threads: int = 8
    optimal_use_limit: int = 3
    #: Batches are so many thousands of rows: a task costs more than a statement.
    batch_unit: int = 1000
    cpu_soft: float = 40
    cpu_hard: float = 60
    latency_soft: float = 30
    latency_hard: float = 50
    full_validation_hours: float = 0
    #: Keys that are loaded from the log at most before they are applied, and seconds of the loader's first window.
    pending_max: int = 100_000
    window_seconds: int = 3600
    #: Seconds of log that may be left when application counts as caught up.
    lag_seconds: int = 60
    segments_per_round: int = 4
    #: Tries of the last validation, while names are swapped already, and seconds that one may take.
    swap_tries: int = 10
    swap_seconds: float = 60

    def __post_init__(self) -> None:
        ends = self.source_endpoint, self.destination_endpoint
        if all(ends) and ends[0] != ends[1]:
            self.auto_swap = False
            if self.operation == "base":
                self.operation = "cross"

    @classmethod
    def of(cls, settings: Mapping) -> Config:
        known = cls.__dataclass_fields__
        if unknown := sorted(k for k in settings if k.lower() not in known):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        values = {k.lower(): v for k, v in settings.items()}
        if "layouts" in values:
            values["layouts"] = tuple(x if isinstance(x, LayoutSpec) else LayoutSpec(x["name"], tuple(x["columns"]), x.get("unique", False)) for x in values["layouts"])
        if "preferred_window" in values:
            window = values["preferred_window"]
            values["preferred_window"] = tuple(window.split("-")) if isinstance(window, str) else tuple(window)
        return cls(**values)

    @classmethod
    def load(cls, path: str | None = None, environment: Mapping[str, str] = os.environ, prefix: str = "KEYTIDE_") -> Config:
        """Settings of a JSON or TOML file, over them those of the environment: the prefix and a setting's name in capitals, as JSON or plain text."""
        values: dict = {}
        if path:
            with open(path, "rb") as f:
                values = tomllib.load(f) if path.endswith(".toml") else json.load(f)
        kinds = typing.get_type_hints(cls)
        for name, text in environment.items():
            if name.startswith(prefix):
                key = name.removeprefix(prefix).lower()
                kind = kinds.get(key)
                plain = kind is str or (isinstance(kind, types.UnionType) and str in typing.get_args(kind)) or (key == "preferred_window" and not text.startswith("["))
                values[key] = text if plain else json.loads(text.lower() if kind is bool else text)
        return cls.of(values)

"""Settings: dataclasses with defaults, JSON files over them, command-line flags over both."""

from __future__ import annotations

import argparse
import dataclasses
import json
from pathlib import Path
from typing import Any, get_type_hints


@dataclasses.dataclass
class SentenceConfig:
    min_chars: int = 10
    max_chars: int = 1000


@dataclasses.dataclass
class PhraseConfig:
    longest: int = 3
    support: int = 20
    part_support: int = 5
    sample_rate: float = 1.0


@dataclasses.dataclass
class VectorConfig:
    """cells: 0 follows the number of vectors, as its root. `parts` must divide `dimensions`."""

    dimensions: int = 768
    neighbours: int = 100
    cells: int = 2048
    probes: int = 16
    parts: int = 96
    bits: int = 8
    train_rate: float = 0.01


@dataclasses.dataclass
class TopicConfig:
    topics: int = 20
    rounds: int = 50
    seed: int = 7
    max_degree: int = 1000
    nearby: int = 2000
    least_df: int = 3


@dataclasses.dataclass
class BuildConfig:
    root: str = ""
    cut_date: str = "9999-99-99"
    language: str = "eng"
    halt_after: str = ""
    sentences: SentenceConfig = dataclasses.field(default_factory=SentenceConfig)
    phrases: PhraseConfig = dataclasses.field(default_factory=PhraseConfig)
    vectors: VectorConfig = dataclasses.field(default_factory=VectorConfig)
    topics: TopicConfig = dataclasses.field(default_factory=TopicConfig)


def get_field(config: Any, path: str) -> Any:
    for part in path.split("."):
        config = getattr(config, part)
    return config


def set_field(config: Any, path: str, value: Any) -> None:
    *parents, last = path.split(".")
    owner = get_field(config, ".".join(parents)) if parents else config
    if last not in {f.name for f in dataclasses.fields(owner)}:
        raise AttributeError(f"no setting {path}")
    setattr(owner, last, value)


def field_paths(kind: type, prefix: str = "") -> dict[str, type]:
    """Dotted names of all plain settings with their types."""
    out: dict[str, type] = {}
    for name, t in get_type_hints(kind).items():
        out |= field_paths(t, f"{prefix}{name}.") if dataclasses.is_dataclass(t) else {f"{prefix}{name}": t}
    return out


def merge(config: Any, values: dict, prefix: str = "") -> None:
    for k, v in values.items():
        if isinstance(v, dict):
            merge(config, v, f"{prefix}{k}.")
        else:
            set_field(config, prefix + k, v)


def load(kind: type, path: str | None = None, flags: list[str] | None = None) -> Any:
    """Defaults, then the JSON file, then flags like --topics.rounds 20."""
    config = kind()
    if path:
        merge(config, json.loads(Path(path).read_text()))
    parser = argparse.ArgumentParser()
    for name, t in field_paths(kind).items():
        parser.add_argument(f"--{name}", type=t, default=None)
    for name, value in vars(parser.parse_args(flags or [])).items():
        if value is not None:
            set_field(config, name, value)
    return config


def without_paths(settings: dict[str, Any]) -> dict[str, Any]:
    """Settings that don't name places on a disk."""
    return {k: v for k, v in settings.items() if not k.endswith(("_db", "_dir", "_path")) and not isinstance(v, Path)}

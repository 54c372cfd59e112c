"""Run configurations and processor artifacts as JSON files, and plain values of nested objects."""

import dataclasses
import enum
import os

import numpy as np

from trajspark.operators.stats import read_json, write_json


def plain(x):
    """Nested dataclasses, arrays, enumerations and sets as what JSON can hold; sets are sorted."""
    if dataclasses.is_dataclass(x) and not isinstance(x, type):
        return {f.name: plain(getattr(x, f.name)) for f in dataclasses.fields(x)}
    if isinstance(x, enum.Enum):
        return plain(x.value)
    if isinstance(x, dict):
        return {str(plain(k)): plain(v) for k, v in x.items()}
    if isinstance(x, (set, frozenset)):
        return sorted((plain(v) for v in x), key=str)
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, np.ndarray):
        return x.tolist()
    if isinstance(x, np.generic):
        return x.item()
    if isinstance(x, (str, int, float, bool)) or x is None:
        return x
    return str(x)


def save(config, path: str) -> None:
    write_json(path, plain(config))


def load(cls, path: str):
    """A dataclass from its file; unknown fields are an error, missing ones keep their defaults."""
    data = read_json(path)
    names = {f.name for f in dataclasses.fields(cls)}
    if unknown := data.keys() - names:
        raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
    return cls(**data)


def save_artifacts(folder: str, config, statistics: dict, ids: dict[str, int]) -> None:
    """A processor's configuration, statistics and tag numbers, in files of their own."""
    os.makedirs(folder, exist_ok=True)
    for name, data in (("processor_config", config), ("statistics", statistics), ("embodiment_id", ids)):
        write_json(f"{folder}/{name}.json", plain(data))


def load_artifacts(folder: str) -> tuple[dict, dict, dict]:
    out = tuple(read_json(f"{folder}/{name}.json") for name in ("processor_config", "statistics", "embodiment_id"))
    if not out[0]:
        raise FileNotFoundError(f"{folder} holds no processor configuration")
    return out


def seed_of(environment: dict[str, str] | None = None, name: str = "SEED", default: int = 0) -> int:
    """The seed an environment variable names, else the default; anything but a whole number is an error."""
    value = (os.environ if environment is None else environment).get(name, "")
    return int(value) if value else default

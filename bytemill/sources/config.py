"""Settings: a JSON object with overrides, paths beside it, and how many grams of each n to keep."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from pathlib import PurePosixPath

DEFAULT_TOP_K = 1024


def load_config(text: str, overrides: Mapping[str, object] | None = None) -> dict:
    """The settings of a JSON object; overrides that are not None replace them, dotted names reach into blocks."""
    config = json.loads(text)
    if not isinstance(config, dict):
        raise ValueError("settings must be a JSON object")
    for name, value in (overrides or {}).items():
        if value is None:
            continue
        *blocks, last = name.split(".")
        at = config
        for b in blocks:
            at = at.setdefault(b, {})
        at[last] = value
    return config


def resolve_path(path: str, folder: str) -> str:
    """A path beside the settings' folder; backslashes count as slashes, absolute paths and URIs stay."""
    plain = path.replace("\\", "/")
    if plain.startswith("/") or "://" in plain:
        return plain
    return str(PurePosixPath(folder.replace("\\", "/")) / plain)


def top_k_setting(values: Iterable[int] | int, ns: Iterable[int]) -> int | dict[int, int]:
    """One value for all n, or one for each n in their order."""
    if isinstance(values, int):
        return values
    values, ns = list(values), list(ns)
    if len(values) == 1:
        return values[0]
    if len(values) != len(ns):
        raise ValueError(f"{len(values)} values for {len(ns)} sizes")
    return dict(zip(ns, values, strict=True))


def resolve_top_k(setting: int | Mapping[object, int] | None, n: int, size: int) -> int:
    """How many grams of n to keep: the default without a setting, all ``size`` where it is 0 or less or covers them."""
    value = DEFAULT_TOP_K
    if isinstance(setting, Mapping):
        value = int(setting.get(n, setting.get(str(n), DEFAULT_TOP_K)))
    elif setting is not None:
        value = int(setting)
    return size if value <= 0 or value >= size else value

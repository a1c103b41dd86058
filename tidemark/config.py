"""Settings from a file, the environment and arguments, each over the one before."""

from __future__ import annotations

import os
import tomllib
from dataclasses import fields, is_dataclass
from typing import Any, get_args, get_origin, get_type_hints

from tidemark.model import ConfigError, EngineConfig

ENV_PREFIX = "TIDEMARK"


def _typed(kind: Any, value: Any, name: str) -> Any:
    if get_origin(kind) is tuple:  # a list in a file, a text with commas elsewhere
        if not isinstance(value, (list, tuple, str)):
            raise ConfigError(f"bad value for {name}: {value!r}")
        return tuple(v for v in (value.split(",") if isinstance(value, str) else map(str, value)) if v)
    kinds = [k for k in (get_args(kind) or (kind,)) if k is not type(None)]
    kind = kinds[0]
    try:
        if kind is bool and isinstance(value, str):
            return {"true": True, "1": True, "false": False, "0": False}[value.lower()]
        return kind(value) if kind in (int, float, str, bool) else value
    except (KeyError, TypeError, ValueError):
        raise ConfigError(f"bad value for {name}: {value!r}") from None


def _merge(target: Any, values: dict[str, Any], path: str = "") -> None:
    hints = get_type_hints(type(target))
    names = {f.name for f in fields(target)}
    for k, v in values.items():
        if k not in names:
            raise ConfigError(f"unknown setting {path}{k}")
        if is_dataclass(getattr(target, k)) and isinstance(v, dict):
            _merge(getattr(target, k), v, f"{path}{k}.")
        else:
            setattr(target, k, _typed(hints[k], v, path + k))


def load(file: str | None = None, env: dict[str, str] | None = None, **arguments: Any) -> EngineConfig:
    """Defaults, then a TOML file, then variables such as ``TIDEMARK__SEGMENT_STORE__ENABLE_TAG_INDEX``, then arguments."""
    config = EngineConfig()
    if file is not None:
        try:
            with open(file, "rb") as f:
                _merge(config, tomllib.load(f))
        except (OSError, tomllib.TOMLDecodeError) as e:
            raise ConfigError(f"cannot read {file}: {e}") from None
    for k, v in (os.environ if env is None else env).items():
        parts = k.split("__")
        if parts[0] == ENV_PREFIX and len(parts) > 1 and v != "":
            tree: dict[str, Any] = {}
            at = tree
            for p in parts[1:-1]:
                at = at.setdefault(p.lower(), {})
            at[parts[-1].lower()] = v
            _merge(config, tree)
    _merge(config, arguments)
    return config

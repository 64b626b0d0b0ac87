"""Configuration: YAML by name, dotted look-up, and parameters for the window detector. PyYAML is optional; JSON works without it."""

from __future__ import annotations

import json
import os
from pathlib import Path
from typing import Any


def load(name: str, folder: str = "configs") -> dict[str, Any]:
    for suffix in (".yaml", ".yml", ".json"):
        path = Path(folder, name + suffix)
        if path.is_file():
            text = path.read_text(encoding="utf-8")
            if suffix == ".json":
                return json.loads(text)
            import yaml

            return yaml.safe_load(text) or {}
    raise FileNotFoundError(f"no configuration {name!r} in {folder}")


def get(config: dict[str, Any], path: str, default: Any = None) -> Any:
    """Value at a dotted path, or the default if a part is missing."""
    for part in path.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config


def secret(variable: str) -> str:
    """A secret from the environment; its absence is named, its value never is."""
    value = os.environ.get(variable, "")
    if not value:
        raise RuntimeError(f"environment variable {variable} is not set")
    return value


#: Options of the ``windows`` section: the detector's own parameters. Durations are in hours.
WINDOWS = ["enter_quantile", "leave_quantile", "enter_value", "leave_value", "floor", "ceiling", "shortest", "longest", "most"]


def window_parameters(config: dict[str, Any], **overrides: Any) -> dict[str, Any]:
    """Parameters of ``low_carbon_windows`` from a configuration; overrides win. ``quantile`` stands for both thresholds where they are absent, ``merge_hours`` for the longest gap joined."""
    w = config.get("windows", {})
    out: dict[str, Any] = {"enter_quantile": w.get("quantile", 0.25)}
    out |= {name: w[name] for name in WINDOWS if w.get(name) is not None}
    out.setdefault("leave_quantile", out["enter_quantile"])
    out |= {k: int(out[k]) for k in ("shortest", "longest", "most") if k in out}
    out["merge_gap"] = int(float(w.get("merge_hours", 1.0)) * 3600)
    return out | overrides

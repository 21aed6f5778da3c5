"""Settings of the engine: defaults, then a file's, then the environment's, then explicit ones."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

#: First and second tier of result sources.
PRIMARY = ("duckduckgo", "mojeek", "googlenews")
FALLBACK = ("bing", "baidu", "sogou", "so360")


@dataclass(frozen=True)
class Config:
    rrf_k: int = 60
    consensus_bonus: float = 0.12
    max_per_domain: int = 3
    title_threshold: float = 0.82
    max_results: int = 12
    per_engine: int = 10
    primary_min_results: int = 5
    failure_threshold: int = 3
    cooldown_ms: int = 600_000
    unreachable_ms: int = 300_000
    page_ttl_s: int = 86_400
    response_ttl_s: int = 900
    robots_ttl_s: int = 21_600
    max_markdown_chars: int = 120_000
    auto_engines: bool = True
    allow_private_hosts: bool = False
    respect_robots: bool = True
    language: str = ""
    region: str = ""
    engines: tuple[str, ...] = PRIMARY
    primary_engines: tuple[str, ...] = PRIMARY
    fallback_engines: tuple[str, ...] = FALLBACK
    keys: Mapping[str, str] = field(default_factory=dict)


def parse_dotenv(text: str) -> dict[str, str]:
    """NAME=value lines; comments, ``export`` and quotes are taken off."""
    out = {}
    for line in text.splitlines():
        name, sep, value = line.strip().removeprefix("export ").partition("=")
        if not sep or name.startswith("#") or not name.strip():
            continue
        value = value.strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        else:
            value = value.split(" #")[0].rstrip()
        out[name.strip()] = value
    return out


def _as(kind: object, value: object) -> object:
    if isinstance(kind, bool):
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    if isinstance(kind, int):
        return int(str(value))
    if isinstance(kind, float):
        return float(str(value))
    if isinstance(kind, tuple):
        return tuple(value) if isinstance(value, (list, tuple)) else tuple(x.strip() for x in str(value).split(",") if x.strip())
    return value


def load_config(path: str | None = None, dotenv: str | None = None, env: Mapping[str, str] | None = None, prefix: str = "LODESTAR_", **overrides: object) -> Config:
    """Later layers win; values that can't be read are passed over."""
    out, layers = Config(), []
    if path and os.path.isfile(path):
        with open(path, encoding="utf-8") as file:
            layers.append(json.load(file))
    for names in (parse_dotenv(dotenv or ""), os.environ if env is None else env):
        layers.append({k[len(prefix) :].lower(): v for k, v in names.items() if k.startswith(prefix)})
    layers.append(overrides)
    known = {f.name: getattr(out, f.name) for f in fields(out)}
    for layer in layers:
        for name, value in layer.items():
            if name in known and value is not None:
                try:
                    out = replace(out, **{name: _as(known[name], value)})
                except (TypeError, ValueError):
                    continue
    return out


def redact(config: Config) -> dict[str, object]:
    """The settings with secrets reduced to their ends and lengths."""
    shown = {f.name: getattr(config, f.name) for f in fields(config)}
    shown["keys"] = {k: f"{v[:4]}…{v[-2:]} ({len(v)} chars)" if len(v) > 8 else "set" for k, v in config.keys.items() if v}
    return shown

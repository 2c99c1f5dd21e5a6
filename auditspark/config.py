"""Configuration: frozen sections, read from TOML, merged from several places, overlaid by the environment."""

from __future__ import annotations

import dataclasses
import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

ENV_PREFIX = "AUDITSPARK_"
FILE_NAME = "auditspark.toml"

CHECKERS = (
    "hardcoded_secrets", "sql_injection", "dangerous_ai_logic", "vibe_naming", "comment_quality", "edge_cases",
    "package_check", "dependency_validation", "boilerplate",
)
CLASSICAL = frozenset({"hardcoded_secrets", "sql_injection", "package_check", "dependency_validation", "boilerplate", "contextual_sqli_audit"})


@dataclass(frozen=True)
class Scan:
    include: tuple[str, ...] = ("*.py", "*requirements*.txt", "*pyproject.toml", "*setup.cfg", "*Pipfile*", "*package*.json", "*yarn.lock")
    exclude: tuple[str, ...] = ("__pycache__/", "*.pyc", "node_modules/", ".git/", ".venv/", ".env/", "build/", "dist/")
    max_file_size: int = 1 << 20
    max_files: int = 1000


@dataclass(frozen=True)
class Llm:
    provider: str = "google"
    model: str = ""
    api_key: str = ""
    base_url: str = ""
    temperature: float = 0.1
    max_tokens: int = 100_000
    timeout: int = 60


@dataclass(frozen=True)
class Checkers:
    enabled: tuple[str, ...] = CHECKERS
    classical_only: bool = False
    llm_only: bool = False


@dataclass(frozen=True)
class Chunking:
    max_chunk_lines: int = 500
    parallel_chunks: bool = True
    max_parallel_requests: int = 10
    use_ast_boundaries: bool = True
    stack_small_files: bool = True
    stack_threshold: float = 0.5


@dataclass(frozen=True)
class Output:
    format: str = "plain"
    verbose: bool = False
    show_fixes: bool = True
    color: bool = True
    debug: bool = False


@dataclass(frozen=True)
class Config:
    scan: Scan = field(default_factory=Scan)
    llm: Llm = field(default_factory=Llm)
    checkers: Checkers = field(default_factory=Checkers)
    chunking: Chunking = field(default_factory=Chunking)
    output: Output = field(default_factory=Output)


_RANGES = {
    ("llm", "temperature"): (0, 2),
    ("chunking", "max_chunk_lines"): (50, 1500),
    ("chunking", "max_parallel_requests"): (1, 10),
    ("chunking", "stack_threshold"): (0, 1),
}
_CHOICES = {("llm", "provider"): ("openai", "google", "claude"), ("output", "format"): ("rich", "json", "plain")}


def build(data: dict[str, Any]) -> Config:
    """A checked Config from nested dicts; unknown keys are errors."""
    sections = {}
    for section in fields(Config):
        kind = section.default_factory
        known = {f.name: f for f in fields(kind)}
        values = dict(data.get(section.name, {}))
        if unknown := set(values) - set(known):
            raise ValueError(f"unknown keys in [{section.name}]: {', '.join(sorted(unknown))}")
        for name, value in values.items():
            if isinstance(value, list):
                values[name] = tuple(value)
            low_high, choices = _RANGES.get((section.name, name)), _CHOICES.get((section.name, name))
            if low_high and not low_high[0] <= value <= low_high[1]:
                raise ValueError(f"{section.name}.{name} must lie between {low_high[0]} and {low_high[1]}")
            if choices and value not in choices:
                raise ValueError(f"{section.name}.{name} must be one of {', '.join(choices)}")
        sections[section.name] = kind(**values)
    if unknown := set(data) - {f.name for f in fields(Config)}:
        raise ValueError(f"unknown sections: {', '.join(sorted(unknown))}")
    return Config(**sections)


def merge(base: dict, over: dict) -> dict:
    """Nested merge; an empty string never replaces a value that is set."""
    out = dict(base)
    for k, v in over.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merge(out[k], v)
        elif not (v == "" and out.get(k)):
            out[k] = v
    return out


def global_path(environ: dict[str, str]) -> Path:
    """Where the user's own configuration belongs."""
    base = Path(environ.get("XDG_CONFIG_HOME") or Path(environ.get("HOME", "~")).expanduser() / ".config")
    return base / "auditspark" / FILE_NAME


def global_file(environ: dict[str, str]) -> Path | None:
    for p in (global_path(environ), Path(environ.get("HOME", "~")).expanduser() / f".{FILE_NAME}"):
        if p.is_file():
            return p
    return None


def project_file(start: Path) -> Path | None:
    """The configuration file of the nearest ancestor."""
    at = start if start.is_dir() else start.parent
    for d in (at, *at.parents):
        if (d / FILE_NAME).is_file():
            return d / FILE_NAME
    return None


def from_environment(environ: dict[str, str]) -> dict:
    """PREFIX + SECTION__KEY; values become booleans, numbers or (with commas) lists where they read as such."""
    out: dict[str, Any] = {}
    for name, raw in environ.items():
        if name.startswith(ENV_PREFIX):
            *parents, last = name[len(ENV_PREFIX) :].lower().split("__")
            at = out
            for p in parents:
                at = at.setdefault(p, {})
            at[last] = _value(raw)
    return out


def _value(raw: str) -> Any:
    low = raw.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    for kind in (int, float):
        try:
            return kind(raw)
        except ValueError:
            pass
    return [x.strip() for x in raw.split(",")] if "," in raw else raw


def load(start: str | Path = ".", explicit: str | Path | None = None, environ: dict[str, str] | None = None) -> Config:
    """Global file, then the explicit or else the project's file, then the environment."""
    environ = dict(os.environ if environ is None else environ)
    data: dict = {}
    for p in (global_file(environ), Path(explicit) if explicit else project_file(Path(start).resolve())):
        if p is not None:
            data = merge(data, tomllib.loads(Path(p).read_text(encoding="utf-8")))
    return build(merge(data, from_environment(environ)))


def to_toml(config: Config) -> str:
    show = lambda v: "true" if v is True else "false" if v is False else "[" + ", ".join(map(show, v)) + "]" if isinstance(v, tuple) else f'"{v}"' if isinstance(v, str) else str(v)
    parts = [f"[{s}]\n" + "".join(f"{k} = {show(v)}\n" for k, v in values.items()) for s, values in dataclasses.asdict(config).items()]
    return "\n".join(parts)


def selected_checkers(config: Config) -> list[str]:
    c = config.checkers
    return [x for x in c.enabled if not (c.classical_only and x not in CLASSICAL) and not (c.llm_only and x in CLASSICAL)]

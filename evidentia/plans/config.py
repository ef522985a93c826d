"""Settings of a run as typed, frozen classes: strict conversion, rules, frozen parameters, a small profile, and digests of code."""

from __future__ import annotations

import dataclasses
import hashlib
import math
import types
import typing
from dataclasses import dataclass, field
from pathlib import Path

from ..operators.inference import Settings as Inference
from ..operators.ranking import COMPARE


class ConfigError(ValueError):
    """A configuration that breaks its form or its rules."""


@dataclass(frozen=True)
class Signature:
    fdr: float = 0.05
    change: float = 0.5
    floor: float = 1.0
    share: float = 0.2
    threshold: float = 0.95
    null_draws: int = 1500
    seed: int = 42


@dataclass(frozen=True)
class Proximity:
    draws: int = 1000
    least_bin: int = 100
    seed: int = 452456
    batch: int = 32


@dataclass(frozen=True)
class Graph:
    top_targets: int = 5
    tag: str = "UserLibrary:"
    prefix: str = "mol:user:"
    valid: float = 0.1
    test: float = 0.05
    split_seed: int = 42
    pin: bool = True
    dimension: int = 128
    pretrain_epochs: int = 5
    pretrain_batch: int = 4096
    pretrain_rate: float = 1e-3
    finetune_epochs: int = 1000
    finetune_rate: float = 5e-4
    seeds: tuple[int, ...] = (1, 2, 3, 4, 5)


@dataclass(frozen=True)
class Stream:
    direction: str = "ascending"
    operator: str = "lt"
    threshold: float = 0.0


@dataclass(frozen=True)
class Ranking:
    most: int = 200
    proximity: Stream = Stream()
    gps: Stream = Stream()


@dataclass(frozen=True)
class Config:
    species: str = "human"
    batch: int = 5000
    inference: Inference = Inference()
    signature: Signature = Signature()
    proximity: Proximity = Proximity()
    graph: Graph = Graph()
    ranking: Ranking = Ranking()
    resources: dict[str, str] = field(default_factory=dict)


def converted(value: object, kind: object = Config, at: str = "config") -> object:
    """A document as a typed class: unknown and missing keys, and values of another type, are errors; a boolean is no number."""
    if dataclasses.is_dataclass(kind):
        if not isinstance(value, dict):
            raise ConfigError(f"{at}: a mapping is wanted")
        names = {f.name for f in dataclasses.fields(kind)}
        if set(value) != names:
            raise ConfigError(f"{at}: missing {sorted(names - set(value))}, unknown {sorted(map(str, set(value) - names))}")
        hints = typing.get_type_hints(kind)
        try:
            return kind(**{n: converted(value[n], hints[n], f"{at}.{n}") for n in names})
        except ConfigError:
            raise
        except ValueError as e:
            raise ConfigError(f"{at}: {e}") from e
    origin, inner = typing.get_origin(kind), typing.get_args(kind)
    if origin in (typing.Union, types.UnionType):
        if value is None and type(None) in inner:
            return None
        return converted(value, next(k for k in inner if k is not type(None)), at)
    if origin is tuple:
        if not isinstance(value, list):
            raise ConfigError(f"{at}: a list is wanted")
        return tuple(converted(v, inner[0], f"{at}[{i}]") for i, v in enumerate(value))
    if origin is dict:
        if not isinstance(value, dict):
            raise ConfigError(f"{at}: a mapping is wanted")
        return {converted(k, inner[0], f"{at}.key"): converted(v, inner[1], f"{at}.{k}") for k, v in value.items()}
    fits = {bool: lambda v: type(v) is bool, int: lambda v: type(v) is int, float: lambda v: type(v) in (int, float), str: lambda v: isinstance(v, str) and v != ""}[kind]
    if not fits(value):
        raise ConfigError(f"{at}: {kind.__name__} is wanted")
    return kind(value)


def document(config: object) -> object:
    """The plain document of a configuration, which ``converted`` takes back."""
    if dataclasses.is_dataclass(config):
        return {f.name: document(getattr(config, f.name)) for f in dataclasses.fields(config)}
    return [document(v) for v in config] if isinstance(config, tuple) else {k: document(v) for k, v in config.items()} if isinstance(config, dict) else config


def checked(config: Config) -> Config:
    """``config`` if it keeps the rules; all that it breaks are told at once."""
    c, g = config, config.graph
    rules = {
        "species: only human": c.species == "human",
        "batch sizes must be positive": min(c.batch, c.proximity.batch, g.pretrain_batch) > 0,
        "shares must lie between 0 and 1": all(0 <= x <= 1 for x in (c.signature.fdr, c.signature.share, c.signature.threshold, g.valid, g.test)),
        "valid and test must leave rows to train": g.valid + g.test < 1,
        "draws, bins and epochs must be positive": min(c.proximity.draws, c.proximity.least_bin, c.signature.null_draws, g.pretrain_epochs, g.finetune_epochs) > 0,
        "rates must be positive": min(g.pretrain_rate, g.finetune_rate) > 0,
        "seeds must be there and be unique": bool(g.seeds) and len(set(g.seeds)) == len(g.seeds),
        "between 1 and 10 targets become edges": 1 <= g.top_targets <= 10,
        "tags and prefixes must not be blank": bool(g.tag.strip() and g.prefix.strip()),
        "the selection must be positive": c.ranking.most > 0,
        "directions are ascending or descending": all(s.direction in ("ascending", "descending") for s in (c.ranking.proximity, c.ranking.gps)),
        "operators are lt, le, gt or ge": all(s.operator in COMPARE for s in (c.ranking.proximity, c.ranking.gps)),
        "thresholds must be finite": all(math.isfinite(s.threshold) for s in (c.ranking.proximity, c.ranking.gps)),
        "resources are relative paths": all(not p.startswith(("/", "~")) and ".." not in p.split("/") and "\\" not in p for p in c.resources.values()),
    }
    if broken := [k for k, fine in rules.items() if not fine]:
        raise ConfigError("; ".join(broken))
    return config


#: Parameters of the method that a run may not change.
FROZEN = {"alpha": 0.4, "beta": 0.2, "gamma": -0.5, "delta": 20, "epsilon": 4, "steps": 2, "most": 10}


def frozen(settings: Inference) -> Inference:
    """``settings`` if they are those of the method."""
    if changed := {k: getattr(settings, k) for k, v in FROZEN.items() if getattr(settings, k) != v}:
        raise ConfigError(f"parameters of the method are fixed: {changed}")
    return settings


def smoke(config: Config) -> Config:
    """The same run at a small scale: fewer draws, epochs and seeds, all steps real."""
    r = dataclasses.replace
    return r(config, proximity=r(config.proximity, draws=20), graph=r(config.graph, pretrain_epochs=1, pretrain_batch=8192, finetune_epochs=2, seeds=(5,)), ranking=r(config.ranking, most=20))


def source_digest(root: str | Path, folders: tuple[str, ...] = ("evidentia",), suffixes: tuple[str, ...] = (".py",)) -> str:
    """One digest of the code: names and contents of its files in order, each with its length before it."""
    out, base = hashlib.sha256(), Path(root)
    for path in sorted((p for f in folders for p in (base / f).rglob("*") if p.suffix in suffixes and "__pycache__" not in p.parts), key=lambda p: p.relative_to(base).as_posix()):
        for part in (path.relative_to(base).as_posix().encode(), path.read_bytes()):
            out.update(len(part).to_bytes(8, "big") + part)
    return out.hexdigest()

"""Thresholds and knobs as values that are passed to operators; nothing is global."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Profile:
    """Cosine thresholds of an embedding model."""

    name: str
    dim: int
    cross_link: float
    dedup: float
    novelty: float

    def __post_init__(self):
        if not (0 <= self.cross_link < self.dedup <= 1 and 0 <= self.novelty <= 1):
            raise ValueError(f"thresholds of {self.name} are out of order")


#: Calibrated models; test-64 is for the 64-dimensional test vectors.
PROFILES = {p.name: p for p in (Profile("gte-large", 1024, 0.90, 0.94, 0.95), Profile("MiniLM", 384, 0.70, 0.82, 0.82), Profile("test-64", 64, 0.35, 0.45, 0.45))}


#: Other names of the calibrated models.
ALIASES = {"thenlper/gte-large": "gte-large", "all-MiniLM-L6-v2": "MiniLM", "sentence-transformers/all-MiniLM-L6-v2": "MiniLM"}


def profile(name: str) -> Profile:
    name = ALIASES.get(name, name)
    if name not in PROFILES:
        raise KeyError(f"no calibrated thresholds for {name}")
    return PROFILES[name]


@dataclass(frozen=True)
class Knobs:
    token_budget: int = 2000
    top_k: int = 10
    walk_depth: int = 2
    seeds: int = 5
    picks: int = 3
    hops: int = 3
    gc_threshold: float = 0.05
    grace_days: int = 7
    think_penalty: float = 1.5
    promote_at: int = 10
    decay_days: int = 14
    cascade_days: int = 30
    node_types: tuple[str, ...] = field(default=("fact", "observation", "insight", "decision", "commitment", "belief"))


@dataclass(frozen=True)
class Settings:
    """All that a deployment sets; load() fills it from a file."""

    graph_path: str = "graph"
    backup_path: str = "backups"
    embedding_model: str = "gte-large"
    token_budget: int = 2000
    top_k: int = 10
    walk_depth: int = 2
    think_cycle_nodes: int = 5
    similarity_threshold: float = 0.3
    access_weight: float = 0.2
    temporal_weight: float = 0.1
    user_domain: str = "user"
    ai_domain: str = "ai"
    gc_mode: str = "soft"
    gc_threshold: float = 0.05
    gc_grace_days: int = 7
    gc_think_cycle_penalty: float = 1.5
    metrics_enabled: bool = True
    backup_every: str = "6h"
    backup_keep: str = "7d"
    extract_every: str = "2h"
    think_every: str = "12h"
    sleep_every: str = "6h"
    domain_aliases: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        positive = ("token_budget", "top_k", "think_cycle_nodes")
        if bad := [n for n in positive if getattr(self, n) <= 0]:
            raise ValueError(f"must be positive: {', '.join(bad)}")
        if self.walk_depth < 0 or not 0 <= self.similarity_threshold <= 1:
            raise ValueError("walk_depth must not be negative and similarity_threshold must lie in [0, 1]")
        if self.access_weight + self.temporal_weight > 1:
            raise ValueError("access_weight and temporal_weight must not exceed 1 together")
        if self.gc_mode not in ("soft", "hard", "off"):
            raise ValueError(f"gc_mode: {self.gc_mode}")

    def knobs(self) -> Knobs:
        return Knobs(token_budget=self.token_budget, top_k=self.top_k, walk_depth=self.walk_depth, seeds=self.think_cycle_nodes, gc_threshold=self.gc_threshold, grace_days=self.gc_grace_days, think_penalty=self.gc_think_cycle_penalty)

    def scoring_weights(self) -> dict[str, float]:
        """What is left of 1 is the embedding's."""
        return {"embedding": 1.0 - self.access_weight - self.temporal_weight, "access": self.access_weight, "temporal": self.temporal_weight}

    def aliases(self) -> dict[str, str]:
        return {"user": self.user_domain, "ai": self.ai_domain} | dict(self.domain_aliases)

    def due(self, job: str) -> int:
        """Hours between two runs of extract, think, sleep or backup."""
        return retention_hours(getattr(self, f"{job}_every"))

    def to_dict(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)} | {"scoring_weights": self.scoring_weights()}


def load(path: str | None = None, **given) -> Settings:
    """Defaults, then a file (JSON, or YAML where its library is there; sections are merged, ${NAME:-default} comes from the
    environment), then what is given. Names that are no setting are an error.
    """
    told: dict = {}
    if path:
        with open(path, encoding="utf-8") as f:
            text = expand_env(f.read())
        if path.endswith(".json"):
            read = json.loads(text)
        else:
            import yaml

            read = yaml.safe_load(text) or {}
        for key, value in read.items():
            told |= value if isinstance(value, dict) and key != "domain_aliases" else {key: value}
    told |= given
    if isinstance(told.get("domain_aliases"), dict):
        told["domain_aliases"] = tuple(sorted(told["domain_aliases"].items()))
    known = {f.name: f.type for f in fields(Settings)}
    if odd := sorted(set(told) - set(known)):
        raise ValueError(f"no such settings: {', '.join(odd)}")
    kinds = {"int": int, "float": float}
    told = {k: kinds[known[k]](v) if known[k] in kinds else (str(v).lower() in ("1", "true", "yes") if known[k] == "bool" else v) for k, v in told.items()}
    for name in ("graph_path", "backup_path"):
        if name in told:
            told[name] = os.path.expanduser(told[name]) if "://" not in told[name] else told[name]
    return Settings(**told)


def graph_path(argument: str | None, settings: Settings, variable: str = "GRAPHLOOM_PATH") -> str:
    """The argument, else the environment, else the settings."""
    return argument or os.environ.get(variable) or settings.graph_path


def expand_env(text: str) -> str:
    """${NAME:-default} from the environment."""
    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: os.environ.get(m[1], m[2] if m[2] is not None else m[0]), text)


def retention_hours(text: str) -> int:
    """24h, 2d, 1w or a bare number of hours."""
    found = re.fullmatch(r"\s*(\d+)\s*([hdw]?)\s*", text.lower())
    if not found:
        raise ValueError(f"not a period: {text}")
    return int(found[1]) * {"": 1, "h": 1, "d": 24, "w": 168}[found[2]]

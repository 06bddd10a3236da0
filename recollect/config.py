"""Engine settings: defaults, environment variables and Spark configuration, with one set of parsing rules."""

from __future__ import annotations

import os
import socket
from collections.abc import Mapping
from dataclasses import dataclass, fields

# Fixed values of the data model.
TYPES = ("user", "feedback", "project", "reference")
KINDS = ("explicit", "crystallized", "hebbian", "semantic")  # in the order in which equal weights are settled
KIND_WEIGHT = {"semantic": 1.0, "explicit": 1.2, "hebbian": 1.0, "crystallized": 1.2}
DEGREE_KINDS = ("explicit", "hebbian", "crystallized")

ON, OFF = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}
PREFIX = "RECOLLECT_"


@dataclass(frozen=True)
class EngineConfig:
    """All tunable constants. Bad values in the environment or in Spark's configuration leave the default."""

    # graph
    knn_k: int = 8
    hop_decay: float = 0.4
    epsilon: float = 1e-4
    recall_budget: int = 8
    # sessions
    session_decay: float = 0.5
    session_gap_seconds: int = 1800
    session_ttl_activation: float = 0.05
    session_sweep_horizon: int = 86400
    session_sweep_interval: int = 50
    hebbian_increment: float = 0.5
    hebbian_cap: float = 5.0
    hebbian_top_m: int = 8
    hebbian_bump_decay: float = 0.5
    hebbian_wire_floor: float = 0.25
    learn_from_head: bool = True
    # retrieval
    rrf_k: int = 60
    recency_weight: float = 0.25
    priming_weight: float = 0.25
    protect_head: int = 8
    seed_floor: float = 0.35
    arm_limit: int = 200
    recall_limit: int = 20
    decay_half_life_days: float | None = None
    excerpt_chars: int = 500
    excerpt_snap: int = 40
    # store
    semantic: bool = True
    assoc: bool = True
    consolidate: bool = False
    dedup_threshold: float = 0.92
    device_id: str = ""
    author: str = ""
    # clusters
    crystallize: bool = True
    peak_floor: float = 0.5
    expand_cos: float = 0.5
    min_cluster: int = 3
    dedup_overlap: float = 0.6
    fallback_z: float = 2.0
    fallback_min_degree: int = 2
    # index and retention
    boot_index_cap: int = 50
    forget: bool = True
    forget_age_days: float = 90.0
    forget_interval: int = 20
    forget_max_per_sweep: int = 10

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None, conf: Mapping[str, str] | None = None) -> EngineConfig:
        """From RECOLLECT_<NAME> variables; keys ``recollect.<name>`` of Spark's configuration come first."""
        env, conf = os.environ if env is None else env, conf or {}
        values = {}
        for f in fields(cls):
            raw = conf.get(f"recollect.{f.name}", env.get(PREFIX + f.name.upper()))
            values[f.name] = f.default if raw is None else _parsed(f.name, str(raw), f.default)
        values["device_id"] = values["device_id"] or socket.gethostname()
        values["author"] = values["author"] or values["device_id"]
        return cls(**values)


def flag(raw: str, default: bool) -> bool:
    """On and off words in any case and with blanks around; anything else is the default."""
    word = raw.strip().lower()
    return True if word in ON else False if word in OFF else default


def _parsed(name: str, raw: str, default):
    if isinstance(default, bool):
        return flag(raw, default)
    if isinstance(default, str):
        return raw.strip() or default
    try:
        value = int(raw) if isinstance(default, int) else float(raw)
    except ValueError:
        return default
    if value != value:
        return default
    if name == "seed_floor":
        return value if 0 <= value <= 1 else default
    if name == "decay_half_life_days":
        return value if value > 0 else None
    if name in ("boot_index_cap", "forget_interval", "forget_max_per_sweep"):
        return value if value >= 1 else default
    if name in ("excerpt_chars", "recall_budget", "protect_head", "forget_age_days"):
        return value if value >= 0 else default
    return value

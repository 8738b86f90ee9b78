"""Configuration: defaults, loading, merging, checking."""

from __future__ import annotations

import copy
import json
from pathlib import Path

NAMES = ("loomspan.config.json", ".loomspanrc", ".loomspanrc.json", "loomspan.json", ".loomspan/config.json")
DEFAULTS: dict = {
    "index": {"extensions": None, "ignore": [], "max_file_bytes": 1_000_000, "follow_symlinks": False},
    "retrieval": {"mode": "hybrid", "max_tokens": 8000, "min_score": 0.0, "sparse_limit": 50, "dense_limit": 50, "k1": 1.2, "b": 0.75, "rrf_k": 60},
    "embeddings": {"provider": "local", "dimensions": 512, "batch": 50},
    "graph": {"max_depth": 3, "max_path": 10},
    "chunks": {"max": 1600, "min": 160, "best": 1200, "min_tokens": 50, "max_tokens": 500},
    "watch": {"debounce_ms": 300, "cascade": True},
    "analytics": {"long_method": 50, "parameters": 5, "nesting": 4, "god_class": 20},
    "memory": {"retention_days": 30, "max_sessions": 100, "summary_every": 10},
    "qa": {"max_tokens": 4000}, "state": {"enabled": True}, "sharing": {"anonymize": False, "exclude": []},
}


def merge(base: dict, more: dict) -> dict:
    """Every section is merged; None in `more` leaves the default."""
    out = copy.deepcopy(base)
    for k, v in more.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else out.get(k) if v is None else v
    return out


def load(root: str = ".") -> dict:
    for name in NAMES:
        at = Path(root, name)
        if at.is_file():
            return merge(DEFAULTS, json.loads(at.read_text()))
    package = Path(root, "package.json")
    own = json.loads(package.read_text()).get("loomspan", {}) if package.is_file() else {}
    return merge(DEFAULTS, own)


def problems(config: dict) -> list[str]:
    out = [f"unknown section {k}" for k in config if k not in DEFAULTS]
    r = config.get("retrieval", {})
    if r.get("mode") not in ("hybrid", "bm25", "keyword"):
        out.append("retrieval.mode is hybrid, bm25 or keyword")
    out += [f"retrieval.{k} must be above 0" for k in ("max_tokens", "rrf_k") if not r.get(k, 1) > 0]
    return out

"""The two generations of the router, as two sets of constants."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Profile:
    """What distinguishes one generation from the other; every operator takes these as arguments."""

    actions: tuple[str, ...]
    signals: tuple[str, ...]
    budget: str  # "middle": the mean cost of always-A1; "midpoint": half way between the two actions'


V3 = Profile(("A0", "A1", "A2"), ("S1", "S2", "S3", "S4"), "middle")
V4 = Profile(("A1", "A2"), ("S2", "S3", "S4"), "midpoint")

# Fixed values.
POOL = 50
TOP_N = 5
A1_RERANK = 20
A2_RERANK = 30
A2_KEEP, A2_NEW = 3, 2
K = 10
RBO_P = 0.9
TEMPERATURE = 0.1
EPS = 1e-9
DELTA = 0.02
TOL = 1e-12
BM25_K1, BM25_B = 0.9, 0.4
WIDTH_FLOOR, WIDTH_CAP = 0.20, 0.25
CENTRES = (0.35, 0.65)
COSINE_MIN = 0.75
N_BOOT, CONFIDENCE, SEED = 1000, 0.95, 42
OUTPUT_POINTS = 1001
SLOW_RATE, SLOW_RUN = 120.0, 5
MAX_IDENTICAL, MAX_CLIPPED, REVISIT_CLIPPED, MAX_CORRELATION = 0.80, 0.80, 0.20, 0.90
SECTIONS = ("data", "generator", "paraphrase", "retrieval", "signals", "fuzzy", "routing", "actions", "baselines", "calibration", "splits", "evaluation", "fitted", "v4")


def load_config(path: str) -> dict:
    """An experiment's parameters from a JSON file on the driver, or a YAML one where the yaml package is there; a missing section is an error."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        import yaml

        found = yaml.safe_load(text)
    missing = [s for s in SECTIONS if s not in (found or {})]
    if missing:
        raise ValueError(f"{path}: missing sections {missing}")
    return found

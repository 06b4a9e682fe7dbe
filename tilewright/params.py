"""Parameters of the workflows, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Design:
    window: int = 1000
    step: int = 500
    k: int = 31
    similarity: float = 0.8
    band: int | None = 100
    amplicon: int = 500
    overlap: int = 75
    min_amplicon: int = 400
    max_amplicon: int = 600
    min_cluster: int = 1
    consensus: str = "aligned"  # or "majority", "first"


@dataclass(frozen=True)
class Selection:
    min_gap: int = 100
    overlap_threshold: float = 0.7
    min_per_locus: int = 5
    max_mismatches: int = 2
    keep_unmapped: bool = True


@dataclass(frozen=True)
class Simulation:
    cycles: int = 25
    efficiency: float = 0.9
    templates: int = 1000
    depth: int = 100
    replicates: int = 10
    read_length: int = 150
    error_rate: float = 0.001
    k: int = 31
    max_mismatches: int = 5
    seed: int = 0

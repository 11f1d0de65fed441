"""Thresholds and classification extras: frozen values that are passed along, never global state."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Thresholds:
    god_header_fan_in: int = 50
    chain_length: int = 10
    duplication_max_bytes: int = 40 << 20
    mass_added_lines: int = 10_000
    lateral_max_added_edges: int = 150


@dataclass(frozen=True)
class Extras:
    """Additions to the built-in classification; ``self_dir`` is the scan root's own directory name."""

    vendored_dirs: tuple[str, ...] = ()
    test_dirs: tuple[str, ...] = ()
    generated_markers: tuple[str, ...] = ()
    self_dir: str = ""


@dataclass(frozen=True)
class CloneOptions:
    min_tokens: int = 30
    max_tokens: int = 600
    rare_df: int = 4
    rare_df_percent: float | None = None
    min_shared_rare: int = 2
    kgram: int = 5
    window: int = 8
    max_postings: int = 20
    min_weighted: float = 0.60
    floor_weighted: float = 0.75
    floor_line: float = 0.50
    floor_statements: int = 2
    floor_lcs_lines: int = 6
    floor_diversity: float = 0.30
    table_diversity: float = 0.30
    metric: str = "weighted"
    precise: bool = False
    min_diversity: float = 0.0
    whole_file: bool = True
    whole_file_share: float = 0.80


@dataclass(frozen=True)
class Options:
    thresholds: Thresholds = field(default_factory=Thresholds)
    extras: Extras = field(default_factory=Extras)
    clones: CloneOptions = field(default_factory=CloneOptions)
    newest_first: bool = True

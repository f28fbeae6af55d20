"""Parameters of the pipelines, with their usual values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ReadParams:
    r1_crop: tuple[int, int] | None = (0, 32)
    r2_crop: tuple[int, int] | None = (0, 30)
    consensus_pos: tuple[int, int] = (37, 42)
    consensus_seq: str = "GCGGC"
    neuron: tuple[int, int] = (0, 32)
    umi: tuple[int, int] = (32, 46)
    tag_length: int = 16
    n_mismatch: int = 2


@dataclass(frozen=True)
class MoleculeParams:
    umi_scope: str = "neuron"  # or "sample"
    umi_cutoff: int = 3
    template_switch_abundance: float = 8.0
    spike_pattern: str = r"^.{24}ATCAGTCA"
    neuron_pattern: str = r"^.{30}[CT][CT]"
    barcode_range: tuple[int, int] = (1, 96)


@dataclass(frozen=True)
class MatrixParams:
    min_total: float = 100
    min_per_sample: int = 2
    more_than_samples: int = 2
    spike_cutoff: float = 10
    soma_ratio: float = 5
    soma_second: float = 10


@dataclass(frozen=True)
class AreaParams:
    area_threshold: float = 0.1
    source_area: str = "AUDp"
    dropped_areas: tuple[str, ...] = ("fiber tracts", "root")
    # Areas of subcortical targets, matched as parts of a region's name, and visual areas.
    subcortical: tuple[str, ...] = ("IC", "SCs", "SCm", "LGd", "LGv", "MGv", "RT", "LP", "MGd", "P,")
    visual: tuple[str, ...] = ("VISli", "VISpor", "VISpl", "VISl", "VISp", "VISal", "VISam", "VISpm", "VISa", "VISrl")
    mixed_fraction: float = 0.1
    scale: str = "range"  # or "minmax"
    binary: bool = False


#: A fixed map of area names for display.
AREA_NAMES: dict[str, str] = {"VISp": "V1", "VISpor": "POR", "VISli": "LI", "VISal": "AL", "VISl": "LM", "VISpl": "P", "VISpm": "PM", "VISrl": "RL", "VISam": "AM", "VISa": "A"}


@dataclass(frozen=True)
class Mix:
    """Sample roles of one brain."""

    cortical: tuple[int, ...] = field(default=())
    contra: tuple[int, ...] = field(default=())
    dropped: tuple[int, ...] = field(default=())

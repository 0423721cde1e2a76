"""Run parameters: a typed record, its text form and its checks."""

from __future__ import annotations

import dataclasses
import warnings
from dataclasses import dataclass
from pathlib import Path

# The keys of a parameter file, and the field that each sets.
KEYS = {
    "InFaFile": "input_path",
    "OErrFile": "output_prefix",
    "QFlag": "quality_flag",
    "BatchSize": "batch_size",
    "KmerLen": "k",
    "Step": "step",
    "hd_max": "max_distance",
    "ExpectSearch": "expect_search",
    "T_ratio": "ratio",
    "QThreshold": "quality_threshold",
    "MaxBadQPerKmer": "max_bad",
    "Qlb": "low_quality",
    "T_expGoodCnt": "trusted_count",
    "T_card": "min_count",
    "StoreReads": "store_reads",
    "CacheOptimizedSearch": "lookup_layout",
    "KmerCacheSize": "kmer_node",
    "TileCacheSize": "tile_node",
    "WriteOutput": "write_output",
    "WriteSpectrum": "write_spectrum",
    "KmerSpectrumOutFile": "kmer_out",
    "TileSpectrumOutFile": "tile_out",
    "KmerSpectrumInFile": "kmer_in",
    "TileSpectrumInFile": "tile_in",
    "KmerSpectrumInAbsent": "kmer_in_absent",
    "RunType": "run_type",
    "Threads": "threads",
    "WorkDistribution": "dynamic_work",
    "WorkFactor": "work_factor",
}

#: Accepted for old parameter files; Spark's scheduler or one lookup makes them moot.
WITHOUT_EFFECT = {"quality_flag", "batch_size", "expect_search", "store_reads", "lookup_layout", "kmer_node", "tile_node", "threads", "dynamic_work", "work_factor"}


@dataclass(frozen=True)
class Params:
    k: int = 10
    step: int = 4
    max_distance: int = 1
    ratio: float = 0.5
    quality_threshold: int = 50
    max_bad: int = 8
    low_quality: int = 50
    trusted_count: int = 8
    min_count: int = 1
    input_path: str = ""
    output_prefix: str = ""
    run_type: int = 0
    write_output: bool = True
    write_spectrum: bool = False
    kmer_out: str = "kmer-spectrum"
    tile_out: str = "tile-spectrum"
    kmer_in: str = ""
    tile_in: str = ""
    kmer_in_absent: bool = False

    @property
    def tile(self) -> int:
        return self.k + self.step

    def check(self) -> "Params":
        if not 3 <= self.k <= 16:
            raise ValueError("k must be 3 to 16")
        if not 1 <= self.step <= self.k:
            raise ValueError("step must be 1 to k")
        if self.max_distance < 0 or self.ratio <= 0:
            raise ValueError("max_distance must not be negative, ratio must be positive")
        if self.run_type not in (0, 1, 2):
            raise ValueError("run_type must be 0, 1 or 2")
        if self.run_type == 2 and not (self.kmer_in and self.tile_in):
            raise ValueError("run_type 2 reads both spectra")
        return self

    def describe(self) -> list[tuple[str, str]]:
        return [(f.name, str(getattr(self, f.name))) for f in dataclasses.fields(self)]


def parse(text: str) -> Params:
    """Parameters from ``Key value`` lines; ``#`` starts a comment, unknown keys are warned of."""
    fields = {f.name: f.type for f in dataclasses.fields(Params)}
    got: dict = {}
    for line in text.splitlines():
        words = line.split("#", 1)[0].split()
        if len(words) < 2:
            continue
        name = KEYS.get(words[0])
        if name is None or name in WITHOUT_EFFECT:
            warnings.warn(f"{words[0]} has no effect", stacklevel=2)
            continue
        kind = fields[name]
        got[name] = words[1] not in ("0", "false", "False") if kind == "bool" else {"int": int, "float": float}.get(kind, str)(words[1])
    return Params(**got)


def load(path: str) -> Params:
    return parse(Path(path).read_text()).check()


def to_text(params: Params) -> str:
    """Parameter file of a record."""
    back = {v: k for k, v in KEYS.items()}
    shown = lambda v: int(v) if isinstance(v, bool) else v
    return "".join(f"{back[n]} {shown(getattr(params, n))}\n" for n, _ in params.describe() if getattr(params, n) != "")


def grid(base: Params, **choices) -> list[tuple[str, Params]]:
    """Named records for all combinations of the choices, in order: for benchmark runs."""
    import itertools

    names = list(choices)
    combos = itertools.product(*(choices[n] for n in names))
    return [("-".join(f"{n}{v}" for n, v in zip(names, c)), dataclasses.replace(base, **dict(zip(names, c)))) for c in combos]

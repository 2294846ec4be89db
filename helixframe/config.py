"""Settings of the three commands, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class CallConfig:
    genome: str = ""
    mappability: str = ""
    sample: str = "NA12878"
    quality: int = 10
    minsize: int = 500
    ploidy: int = 2
    fragment: float = 0.97
    outprefix: str = "out"
    window_size: int = 10_000
    window_offset: int = 10_000
    bed_intervals: str | None = None
    fraction_window: float = 0.25
    scan_window: int = 10_000
    fraction_unique: float = 0.8
    scan_regions: str | None = None
    mad_cutoff: int = 3
    percentile: float = 0.0005
    no_window_selection: bool = False
    basequality: int = 10
    snps: int = 3
    coverage: int = 10
    vcffile: str | None = None
    controlfile: str | None = None
    statsfile: str | None = None
    #: Contigs that scanning leaves out by name, and the coverage after which small contigs are left out.
    sex_contigs: tuple[str, ...] = field(default=("chrX", "chrY", "X", "Y"))
    enough_coverage: int = 1_000_000
    #: Repeats the known quirks of the genotype quality (see operators.genotype).
    compat: bool = True

    def __post_init__(self):
        # In this order: an offset over the size becomes the size, then empty sizes and offsets become 1.
        self.window_offset = min(self.window_offset, self.window_size)
        self.window_size = self.window_size or 1
        self.window_offset = self.window_offset or 1
        if self.minsize < 8:
            raise ValueError("minsize must be 8 or more: smaller scales never grow")


@dataclass
class MergeConfig:
    by_type: str = "CN"
    outfile: str = "cov.gz"


@dataclass
class SegmentConfig:
    ploidy: int = 2
    dpthreshold: float = 0.5
    epsilon: float = 1e-9
    kchange: int = 300
    outfile: str = "segment.gz"

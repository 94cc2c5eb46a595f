"""Assay presets, use-case profiles and the run's configuration."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from .constants import DEFAULT_LOCI, EXTENDED


@dataclass(frozen=True)
class Preset:
    """Thresholds of an assay.

    coverage, min_coverage, confidence, assembler, timeout, genome and
    informative are told to other programs or people; no step here reads them.
    """

    aligner: str
    coverage: int
    min_coverage: int
    unmapped: bool
    exons_only: bool
    candidates: int
    refined: int
    confidence: float
    assembly_trigger: float
    het_depth: int
    minor_share: float
    min_sites: int
    k: int
    kmer_covered: float
    kmer_unexpected: float
    assembler: str
    timeout: int
    genome: int
    informative: int


# Thresholds by assay.
PRESETS = {
    "short": Preset(
        aligner="sr", coverage=30, min_coverage=5, unmapped=True, exons_only=False, candidates=80, refined=20, confidence=0.9, assembly_trigger=0.8,
        het_depth=5, minor_share=0.15, min_sites=2, k=31, kmer_covered=0.9, kmer_unexpected=0.3, assembler="megahit", timeout=300, genome=15000,
        informative=5,
    ),
    "exome": Preset(
        aligner="sr", coverage=60, min_coverage=10, unmapped=True, exons_only=True, candidates=60, refined=15, confidence=0.9, assembly_trigger=0.85,
        het_depth=8, minor_share=0.15, min_sites=2, k=31, kmer_covered=0.85, kmer_unexpected=0.35, assembler="megahit", timeout=300, genome=10000,
        informative=3,
    ),
    "targeted_capture": Preset(
        aligner="sr", coverage=200, min_coverage=20, unmapped=False, exons_only=False, candidates=100, refined=25, confidence=0.95,
        assembly_trigger=0.9, het_depth=10, minor_share=0.2, min_sites=2, k=31, kmer_covered=0.95, kmer_unexpected=0.2, assembler="megahit",
        timeout=300, genome=15000, informative=5,
    ),
    "pacbio": Preset(
        aligner="map-pb", coverage=15, min_coverage=3, unmapped=True, exons_only=False, candidates=60, refined=15, confidence=0.85,
        assembly_trigger=0.75, het_depth=3, minor_share=0.2, min_sites=1, k=21, kmer_covered=0.8, kmer_unexpected=0.4, assembler="flye", timeout=600,
        genome=15000, informative=3,
    ),
    "hifi": Preset(
        aligner="map-hifi", coverage=20, min_coverage=5, unmapped=True, exons_only=False, candidates=60, refined=15, confidence=0.95,
        assembly_trigger=0.85, het_depth=3, minor_share=0.2, min_sites=1, k=31, kmer_covered=0.92, kmer_unexpected=0.25, assembler="hifiasm",
        timeout=600, genome=15000, informative=3,
    ),
    "ont": Preset(
        aligner="map-ont", coverage=20, min_coverage=5, unmapped=True, exons_only=False, candidates=60, refined=15, confidence=0.85,
        assembly_trigger=0.75, het_depth=3, minor_share=0.2, min_sites=1, k=21, kmer_covered=0.8, kmer_unexpected=0.4, assembler="flye", timeout=600,
        genome=15000, informative=3,
    ),
    "rna": Preset(
        aligner="splice", coverage=50, min_coverage=10, unmapped=True, exons_only=True, candidates=60, refined=15, confidence=0.9,
        assembly_trigger=0.85, het_depth=8, minor_share=0.15, min_sites=2, k=31, kmer_covered=0.85, kmer_unexpected=0.35, assembler="megahit",
        timeout=300, genome=10000, informative=3,
    ),
}


@dataclass(frozen=True)
class Profile:
    """What a use case asks of a run."""

    loci: tuple[str, ...]
    least: str
    phasing: bool
    resolution: str | int
    novel: bool
    clinical: bool
    strict: bool


# Use cases.
PROFILES = {
    "transplant": Profile(
        loci=("A", "B", "C", "DRB1", "DQB1", "DPB1"), least="HIGH", phasing=True, resolution=2, novel=True, clinical=True, strict=True,
    ),
    "research": Profile(
        loci=DEFAULT_LOCI + EXTENDED, least="LOW", phasing=False,
        resolution="max", novel=True, clinical=False, strict=False,
    ),
    "immuno_onc": Profile(
        loci=("A", "B", "C"), least="MEDIUM", phasing=False, resolution=2, novel=False, clinical=False, strict=False,
    ),
}


@dataclass(frozen=True)
class Config:
    """Configuration of a typing run; a profile's loci and resolution come before those given, its flags are added.

    least: the lowest tier that a clinical report shows; phasing: loci whose
    heterozygous sites are not phased are flagged; strict: outputs include a
    manifest and a lock; pairs: how many pairs of the largest variational
    weights enter the posteriors (None: all, the exact way; 60 is the usual cut).
    """

    assay: str = "short"
    loci: tuple[str, ...] = DEFAULT_LOCI
    resolution: str | int = 2
    release: str = "unknown"
    clinical: bool = False
    strict: bool = False
    least: str = "MEDIUM"
    phasing: bool = False
    pairs: int | None = None
    preset: Preset = field(default=PRESETS["short"])

    @classmethod
    def create(cls, assay: str = "short", profile: str | None = None, candidates: int | None = None, **given) -> "Config":
        if assay not in PRESETS:
            raise ValueError(f"unknown assay {assay!r}; one of {', '.join(PRESETS)}")
        preset = PRESETS[assay] if candidates is None else replace(PRESETS[assay], candidates=candidates)
        if profile is not None:
            p = PROFILES[profile]
            given |= {"loci": p.loci, "resolution": p.resolution, "least": p.least, "phasing": p.phasing, "clinical": p.clinical or given.get("clinical", False), "strict": p.strict or given.get("strict", False)}
        return cls(assay=assay, preset=preset, **given)


def check_release(wanted: str, found: str) -> None:
    """Raises if the reference's release is known and another one."""
    if found not in ("unknown", wanted):
        raise ValueError(f"reference release is {found}, not {wanted}")

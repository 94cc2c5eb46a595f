"""A typing run: from alignments to final calls and their reports, for all samples at once.

Every stage is a DataFrame keyed by (sample_id, locus) and nothing is
collected.  The evidence matrix, the genotypes and the best pairs, which many
stages share, are checkpointed in the shared folder; all else is lazy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import names
from ..functions import sequences as S
from ..operators import candidates, genotype, kernels, kmers, matrix, novel, phasing, posterior, reports, samples
from ..storage import kept

LOCUS = ["sample_id", "locus"]


@dataclass
class Result:
    """The tables of a run; those that need an input which was not given are None."""

    candidates: DataFrame
    matrix: DataFrame
    genotypes: DataFrame
    copies: DataFrame
    posteriors: DataFrame
    alternatives: DataFrame
    weights: DataFrame
    sites: DataFrame
    bins: DataFrame
    phased: DataFrame | None
    contamination: DataFrame
    dropout: DataFrame
    kmers: DataFrame | None
    assembly_needed: DataFrame
    assembly: DataFrame | None
    calls: DataFrame
    best: DataFrame
    ambiguity: DataFrame
    novel: DataFrame
    qc_loci: DataFrame
    qc_summary: DataFrame
    clinical_loci: DataFrame
    clinical_summary: DataFrame


def phased_alleles(bins: DataFrame, matrix_: DataFrame, sites: DataFrame, found: DataFrame, sequences: DataFrame) -> DataFrame:
    """(locus keys, bin, allele, ...): the candidate that each of a locus's two bins agrees with most, where both have one."""
    usual = found.select(*LOCUS, "allele").join(sequences.select("locus", "allele", "seq"), ["locus", "allele"])
    consensus = phasing.bin_consensus(matrix_, bins, sites)
    best = phasing.match_bins(consensus, usual, LOCUS)
    return best.join(best.groupBy(*LOCUS).agg(F.count("*").alias("_b")).where("_b = 2").select(*LOCUS), LOCUS, "left_semi")


def called_kmers(genotypes: DataFrame, sequences: DataFrame, reads: DataFrame, a: DataFrame, c: Config) -> DataFrame:
    """k-mer validation of each locus's selected pair by the reads that align to the locus."""
    pair = genotypes.where("allele1 <> '' and allele2 <> ''").select(*LOCUS, F.explode(F.array_distinct(F.array("allele1", "allele2"))).alias("allele"))
    wanted = pair.join(sequences.select("locus", "allele", "seq"), ["locus", "allele"]).select(*LOCUS, "seq")
    own = a.select(*LOCUS, "read_id").join(reads.select("sample_id", "read_id", "seq"), ["sample_id", "read_id"]).join(pair.select(*LOCUS).distinct(), LOCUS, "left_semi")
    depths = kmers.depth_of_dna(wanted, own.select(*LOCUS, "seq"), LOCUS, c.preset.k)
    return kmers.validate(depths, c.preset.kmer_covered, c.preset.kmer_unexpected)


def next_best(posteriors: DataFrame, sequences: DataFrame | None) -> DataFrame:
    """(locus keys, same_protein, snp_diff): how the best pair differs from the second; snp_diff is null without sequences."""
    r = posterior.ranked(posteriors, 2)
    side = lambda k, *cols: r.where(F.col("rank") == k).select(*LOCUS, *cols)
    both = side(1, "a1", "a2").join(side(2, F.col("a1").alias("b1"), F.col("a2").alias("b2")), LOCUS)
    same = names.same_to_two_fields(F.col("a1"), F.col("b1")) & names.same_to_two_fields(F.col("a2"), F.col("b2"))
    out = both.withColumn("same_protein", same)
    if sequences is None:
        return out.select(*LOCUS, "same_protein", F.lit(None).cast("int").alias("snp_diff"))
    moved = out.select(*LOCUS, F.explode(F.array(F.struct(F.col("a1").alias("x"), F.col("b1").alias("y")), F.struct(F.col("a2").alias("x"), F.col("b2").alias("y")))).alias("p")).select(*LOCUS, "p.*").where("x <> y")
    seq = lambda n: sequences.select("locus", F.col("allele").alias(n), F.col("seq").alias(f"_{n}"))
    far = moved.join(seq("x"), ["locus", "x"]).join(seq("y"), ["locus", "y"]).groupBy(*LOCUS).agg(F.sum(S.snp_distance(F.col("_x"), F.col("_y"))).cast("int").alias("snp_diff"))
    return out.join(far, LOCUS, "left").select(*LOCUS, "same_protein", "snp_diff")


def run(
    alignments: DataFrame, config: Config | None = None, validated: DataFrame | None = None, groups: DataFrame | None = None, *,
    bases: DataFrame | None = None, sequences: DataFrame | None = None, reads: DataFrame | None = None, frequencies: DataFrame | None = None,
    contigs: DataFrame | None = None, contig_hits: DataFrame | None = None,
) -> Result:
    """alignments(sample_id, read_id, locus, allele, as_score, mapq, is_secondary, pos, base) to calls and reports.

    Keys may be of any type.  What may be given besides:
    bases(sample_id, read_id, locus, allele, pos, base [, quality]): the bases
    of whole reads, else those of the alignments' own rows are phased;
    sequences(locus, allele, seq): then bins are matched with candidates, whose
    alleles join them, and differences between pairs are counted;
    reads(sample_id, read_id, seq), with sequences: then the selected pairs are
    validated by k-mers (or pass validated(locus keys, concordant, covered));
    frequencies(allele, freq): priors, by default the built-in ones;
    contigs(sample_id, locus, seq) with contig_hits(.., allele, cigar, nm): of
    the loci that need assembly; groups is needed for resolution 'G'.
    No loci or reads give empty tables.
    """
    c = config or Config.create()
    a = alignments.where(F.col("locus").isin(*c.loci))
    if c.preset.exons_only and sequences is not None and "kind" in sequences.columns:
        sequences = sequences.where("kind = 'nuc'")
    # 1, 2: candidates
    found = candidates.prefilter(a, c.preset.candidates)
    refined = candidates.refine(a, four=c.preset.refined, found=found).select(*LOCUS, "allele")
    # 2.5: phases, and what they add to the candidates
    at = a if bases is None else bases.where(F.col("locus").isin(*c.loci)).join(found.where("rank = 1").select(*LOCUS, "allele"), [*LOCUS, "allele"], "left_semi")
    sites = phasing.het_sites(at, c.preset.het_depth, c.preset.minor_share, 1 - c.preset.minor_share)
    observed = phasing.read_matrix(at, sites)
    long_reads = c.preset.aligner.startswith("map-")
    bins = kept(kernels.phase(observed, "signature" if long_reads else "greedy", c.preset.min_sites))
    phased = None
    if sequences is not None:
        phased = phased_alleles(bins, observed, sites, refined, sequences)
        refined = candidates.add_phased(refined, phased)
    # 3: the matrix is what most stages start from: written once, it also keeps the plans after it short.
    m = kept(matrix.evidence(a, refined.select("sample_id", "allele").distinct()))
    whole, local = matrix.normalise(m), matrix.normalise(m, within_locus=True)
    depth = samples.depths(a)
    copies = samples.copy_number(depth)
    genotypes = kept(samples.apply_copy_number(genotype.calls(whole), copies))
    # 4: weights and posteriors
    if frequencies is None:
        frequencies = names.frequency(m.select("allele").distinct(), column="allele").withColumnRenamed("frequency", "freq")
    weights = kernels.vb_em(local, frequencies)
    posteriors = kept(posterior.pair_posteriors(local, kept(weights) if c.pairs else None, c.pairs or 0))
    best = posterior.best_with_gap(posteriors)
    # 5: k-mers, assembly
    if validated is None and sequences is not None and reads is not None:
        validated = kept(called_kmers(genotypes, sequences, reads, a, c))
    evidence = genotypes.join(best.select(*LOCUS, "p", "gap"), LOCUS, "left")
    blank = {"concordant": "boolean", "covered": "double", "unexpected": "double"}
    if validated is not None:
        evidence = evidence.join(validated.select(*LOCUS, *[n for n in blank if n in validated.columns]), LOCUS, "left")
    for n, kind in blank.items():
        if n not in evidence.columns:
            evidence = evidence.withColumn(n, F.lit(None).cast(kind))
    share = F.col("reads_explained") / F.greatest("total_reads", F.lit(1))
    needed = evidence.where(reports.assembly_trigger(F.col("p"), F.col("concordant"), share, F.col("reads_explained"), c.preset.assembly_trigger)).select(*LOCUS)
    assembly = None
    if contigs is not None and sequences is not None:
        assembly = kept(kmers.closest_alleles(needed, contigs, sequences, contig_hits))
        evidence = evidence.join(assembly.select(*LOCUS, F.col("is_novel").alias("assembly_novel")), LOCUS, "left")
    else:
        evidence = evidence.withColumn("assembly_novel", F.lit(None).cast("boolean"))
    # Phases as evidence
    n_sites = sites.groupBy(*LOCUS).agg(F.count("*").alias("n_het_sites"))
    halves = phasing.balance(bins).withColumn("phased", (F.col("n0") > 0) & (F.col("n1") > 0))
    evidence = evidence.join(n_sites, LOCUS, "left").na.fill(0, ["n_het_sites"]).join(halves.select(*LOCUS, "phased", "balance"), LOCUS, "left")
    evidence = evidence.withColumn("phased", F.coalesce("phased", F.lit(False))).withColumn("balance", F.when(F.col("phased"), F.col("balance")))
    evidence = evidence.join(next_best(posteriors, sequences), LOCUS, "left")
    evidence = kept(evidence.withColumn("data_type", F.lit(c.assay)))
    # Calls and reports
    calls = reports.at_resolution(reports.compile_calls(genotypes, best, validated), c.resolution, c.assay, groups)
    reasons = reports.ambiguity(evidence.withColumn("posterior", F.coalesce("p", F.lit(0.5))).withColumn("kmer_coverage", F.col("covered")))
    extra = evidence.select(*LOCUS, "n_het_sites", "phased", "balance", "covered", "assembly_novel")
    if c.phasing:
        unlinked = F.when((F.col("n_het_sites") > 0) & ~F.col("phased"), F.array(F.lit("phase_required"))).otherwise(F.array().cast("array<string>"))
    else:
        unlinked = F.array().cast("array<string>")
    calls = calls.join(extra, LOCUS, "left").join(reasons.select(*LOCUS, "reason", "secondary", "suggestion"), LOCUS, "left")
    calls = calls.withColumn("flags", F.concat(F.when(F.col("status") == "optimal", F.array().cast("array<string>")).otherwise(F.array("status")), unlinked))
    calls = kept(calls.withColumn("is_novel", F.coalesce("assembly_novel", F.lit(False))).drop("assembly_novel"))
    tested = reports.locus_qc(calls).drop("passed").withColumn("n_issues", F.size("issues"))
    qc_loci, qc_summary = reports.qc_report(tested)
    clinical_loci, clinical_summary = reports.clinical(calls.withColumn("is_ambiguous", F.coalesce(F.col("reason") != "unambiguous", F.lit(False))), c.least)
    screened = novel.screen(evidence.select(*LOCUS, F.col("reads_explained").alias("explained"), F.col("total_reads").alias("total"), "unexpected", "covered", "assembly_novel"))
    dropout = samples.dropout_risk(evidence.select(*LOCUS, "is_homozygous", F.col("p").alias("posterior"), "n_het_sites").join(depth, LOCUS))
    return Result(
        found, m, genotypes, copies, posteriors, posterior.alternatives(posteriors), weights, sites, bins, phased, samples.contamination(a), dropout, validated, needed,
        assembly, calls, best, reasons, screened, qc_loci, qc_summary, clinical_loci, clinical_summary,
    )

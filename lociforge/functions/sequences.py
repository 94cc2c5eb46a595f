"""Sequence functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CODONS


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def kmers(s: Column, k: int = 31) -> Column:
    """All windows of k without N; empty if the sequence is shorter."""
    every = F.transform(F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substring(s, i, F.lit(k)))
    return F.filter(F.when(F.length(s) >= k, every).otherwise(F.array().cast("array<string>")), lambda x: ~F.upper(x).contains("N"))


def canonical_kmers(s: Column, k: int = 31) -> Column:
    return F.array_distinct(F.transform(kmers(s, k), canonical))


def phred_error(ch: Column) -> Column:
    return F.pow(F.lit(10.0), -(F.ascii(ch) - 33) / F.lit(10.0))


def phred_correct(ch: Column) -> Column:
    return 1 - phred_error(ch)


def cigar(c: Column) -> Column:
    """array<struct<len, op>>."""
    n = F.regexp_extract_all(c, F.lit(r"(\d+)([A-Z=])"), F.lit(1))
    op = F.regexp_extract_all(c, F.lit(r"(\d+)([A-Z=])"), F.lit(2))
    return F.zip_with(n, op, lambda a, b: F.struct(a.cast("int").alias("len"), b.alias("op")))


def identity(c: Column, nm: Column) -> Column:
    """(aligned length - edit distance) / aligned length, counting M, I and D."""
    n = F.aggregate(F.filter(cigar(c), lambda t: t.op.isin("M", "I", "D")), F.lit(0), lambda acc, t: acc + t.len)
    return F.when(n > 0, (n - nm).cast("double") / n).otherwise(F.lit(0.0))


def amino_acid(codon: Column) -> Column:
    """One-letter amino acid of a codon, '?' if it is none."""
    at = [F.instr(F.lit("TCAG"), F.substring(codon, i, 1)) for i in (1, 2, 3)]
    ok = (F.length(codon) == 3) & (at[0] > 0) & (at[1] > 0) & (at[2] > 0)
    return F.when(ok, F.substring(F.lit(CODONS), 16 * (at[0] - 1) + 4 * (at[1] - 1) + at[2], F.lit(1))).otherwise(F.lit("?"))


def snp_distance(a: Column, b: Column) -> Column:
    """Differing positions over the shorter length where both bases are A, C, G or T."""
    n = F.least(F.length(a), F.length(b))
    bases = lambda x: F.split(F.left(x, n), "")
    return F.aggregate(F.zip_with(bases(a), bases(b), lambda x, y: F.when((x != y) & x.rlike("^[ACGT]$") & y.rlike("^[ACGT]$"), 1).otherwise(0)), F.lit(0), lambda s, v: s + v)


def hgvs(allele: Column, kind: Column, position: Column, ref: Column, alt: Column) -> Column:
    """Variant name, counted from 1."""
    p = (position + 1).cast("string")
    last = (position + F.greatest(F.length(ref), F.lit(1))).cast("string")
    return F.concat(
        allele,
        F.lit(":g."),
        F.when(kind == "SNP", F.concat(p, ref, F.lit(">"), alt))
        .when(kind == "INS", F.concat(p, F.lit("_"), (position + 2).cast("string"), F.lit("ins"), alt))
        .otherwise(F.concat(p, F.lit("_"), last, F.lit("del"))),
    )


def indel_class(region: Column, kind: Column, length: Column) -> Column:
    return (
        F.when(region.startswith("exon_"), F.when(length % 3 != 0, F.lit("frameshift")).when(kind == "INS", F.lit("in_frame_ins")).otherwise(F.lit("in_frame_del")))
        .when(region.startswith("intron"), F.lit("intronic"))
        .otherwise(F.lit("non_coding"))
    )


def temporary_name(locus: Column, field1: Column) -> Column:
    return F.concat(locus, F.lit("*"), field1, F.lit(":new"))

"""The driver's tables seen as the engine's relations.

The text of each view is plain SQL that both Spark and another engine read;
{lineitem}, {part} and {documents} stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALIGNMENTS = """b as (select l_orderkey as read_id, cast(floor(l_orderkey/64) as bigint) % 4 as sample_id, l_orderkey % 64 as bk, l_partkey as pk, l_suppkey as sk, l_linenumber as ln, cast(l_quantity as int) as as_score, cast(round(l_discount*100) as int) as mapq from {lineitem}),
l as (select *, case when bk<8 then 'A' when bk<16 then 'B' when bk<23 then 'C' when bk<35 then 'DRB1' when bk<39 then 'DQA1' when bk<45 then 'DQB1' when bk<48 then 'DPA1' when bk<51 then 'DPB1' when bk<54 then 'DRB3' when bk<63 then 'DRB4' else 'DRB5' end as locus, least(pk % 10, sk % 10) as ai from b),
aln as (select sample_id, read_id, locus, concat(locus,'*',lpad(cast(1+cast(floor(ai/4) as int) as string),2,'0'),':',lpad(cast(1+ai%4 as string),2,'0')) as allele, as_score, mapq, ln>1 as is_secondary, sk%100 as pos,
 substring('ACGT', cast(1 + (sk%100 + case when read_id%3=0 and sk%2=0 then 1 else 0 end + case when pk%25=0 then 1 else 0 end) % 4 as int), 1) as base from l)"""

ALLELES = """a0 as (select p_partkey as pk, p_size as sz, p_partkey % 11 as li, cast(floor(p_partkey/11) as bigint) as ix from {part}),
a1 as (select pk, sz, ix, case li when 0 then 'A' when 1 then 'B' when 2 then 'C' when 3 then 'DRB1' when 4 then 'DQA1' when 5 then 'DQB1' when 6 then 'DPA1' when 7 then 'DPB1' when 8 then 'DRB3' when 9 then 'DRB4' else 'DRB5' end as lc, lpad(cast(1+ix%5 as string),2,'0') f1, lpad(cast(1+cast(floor(ix/5) as bigint)%4 as string),2,'0') f2, lpad(cast(1+cast(floor(ix/20) as bigint)%3 as string),2,'0') f3, lpad(cast(1+cast(floor(ix/60) as bigint)%2 as string),2,'0') f4 from a0),
alleles as (select pk, concat(case when pk%4=0 then 'HLA-' else '' end, lc,'*',f1,':',f2, case when sz%5=0 then '' when sz%2=0 then concat(':',f3) else concat(':',f3,':',f4) end, case when ix%17=0 then 'N' when ix%19=0 then 'Q' else '' end) as name from a1)"""

#: The same, parsed by regular expressions; what the engine's own parser is held against.
PARSED = (
    ALLELES
    + """, parsed as (select pk,name, regexp_extract(name,'^(?:HLA-)?([^*]+)[*]',1) locus, regexp_extract(name,'[*]([^:NLSCAQ]+)',1) f1, regexp_extract(name,'[*][^:]+:([^:NLSCAQ]+)',1) f2, regexp_extract(name,'[*][^:]+:[^:]+:([^:NLSCAQ]+)',1) f3, regexp_extract(name,'[*][^:]+:[^:]+:[^:]+:([^:NLSCAQ]+)',1) f4, regexp_extract(name,'([NLSCAQ])$',1) suffix from alleles)"""
)

VARIANTS = """v as (select l_orderkey ok, l_linenumber ln, (l_partkey*37+l_suppkey)%3600 pos, case when l_suppkey%5=0 then 'INS' when l_suppkey%7=0 then 'DEL' else 'SNP' end kind, 1+l_partkey%4 len from {lineitem})"""


def relation(spark: SparkSession, sf_dir: str, text: str, select: str) -> DataFrame:
    """`select` over the views of `text`."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part", "documents", "benchmark") if "{" + t + "}" in text + select}
    return spark.sql(f"with {text} {select}", **used)


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, ALIGNMENTS, "select * from aln")


def allele_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, ALLELES, "select pk, name from alleles")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, VARIANTS, "select * from v")


def bases(text: Column) -> Column:
    """Text read as a sequence: letters to bases, all else left out."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26])


def dna(spark: SparkSession, sf_dir: str, table: str, key: str, name: str) -> DataFrame:
    """Texts of a table read as sequences: letters to bases, all else left out."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias(name), bases(F.col("text")).alias("seq"))


#: Evidence of every kind for (sample, locus), made from the alignments' counts.
EVIDENCE = (
    ALIGNMENTS
    + """, en as (select sample_id*100+pos as sample_id, locus, count(*)+pos as n, count(*) as k from aln group by sample_id*100+pos, locus, pos),
ev as (select sample_id, locus, n, n%60 as total_reads, cast(floor((n%60)*(n%7)/6) as bigint) as explained, 0.5e0+(n%11)*0.05e0 as posterior, (n%5)*0.05e0 as gap, 0.6e0+(n%9)*0.05e0 as covered, (n%8)*0.05e0 as unexpected,
 n%7 as snp_diff, n%4 as n_het_sites, n%3<>0 as phased, (n%10)*0.1e0 as balance, n%9>=6 as concordant, n%2=0 as same_protein, n%3=0 as is_homozygous, case when n%4=0 then 'exome' else 'short' end as data_type, n%6=0 as assembly_novel,
 case when n%17=0 then '' else concat(locus,'*0',cast(1+n%3 as string),':0',cast(1+n%4 as string)) end as allele1, case when n%17=0 then '' else concat(locus,'*0',cast(1+n%2 as string),':0',cast(1+(n+1)%4 as string)) end as allele2,
 case when n%5=0 then concat(locus,'*09:01') else concat(locus,'*0',cast(1+n%2 as string),':0',cast(1+(n+1)%4 as string)) end as t1, case when n%11=0 then concat(locus,'*08:01') else concat('HLA-',locus,'*0',cast(1+n%3 as string),':0',cast(1+n%4 as string),':01') end as t2,
 case sample_id%5 when 0 then 'AFR' when 1 then 'AMR' when 2 then 'EAS' when 3 then 'EUR' else 'SAS' end as ancestry from en)"""
)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, EVIDENCE, "select * from ev")

"""Catalogue: kernels, reports, evaluation and parsers of other callers' results, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import DEFAULT_LOCI
from ..functions import names
from ..operators import evaluate, genotype, kernels, matrix, novel, phasing, posterior, reports, samples
from ..sources import callers
from . import adapter, annotation, genotyping

QUERIES, SQL = {}, {}
_E = "with recursive " + adapter.EVIDENCE.format(lineitem="lineitem")
_T = "regexp_replace(t2,'^HLA-([^:]*:[^:]*):.*$','\\1')"
_NT = "case when {a} like 'HLA-%' then substring({a},5) else {a} end"
_CUT = "concat_ws(':',split_part(" + _NT + ",':',1),nullif(split_part(" + _NT + ",':',2),''))"
_CMP = _E + ", z as (select *," + ",".join(_CUT.format(a=c) + f" x{i}" for i, c in enumerate(("allele1", "allele2", "t1", "t2"))) + " from ev), cm as (select *, cast(case when x0='' and x1='' then -1 when (x0=x2 and x1=x3) or (x0=x3 and x1=x2) then 2 when x0=x2 or x0=x3 or (x1<>'' and (x1=x2 or x1=x3)) then 1 else 0 end as int) matches from z)"
_COUNT = "count(*) n_samples,count(*) filter (where matches=2) n_correct_both,count(*) filter (where matches=1) n_correct_one,count(*) filter (where matches=0) n_incorrect,count(*) filter (where matches=-1) n_no_call,round((2*count(*) filter (where matches=2)+count(*) filter (where matches=1))/(2.0::double*count(*)),6) accuracy,round(1-count(*) filter (where matches=-1)/(1.0::double*count(*)),6) call_rate"


def _suggestions() -> str:
    """The suggestions as a SQL expression."""
    values = {"{kmer_coverage}": "round(covered*100)::int||'%'", "{snp_diff_to_alternative}": "snp_diff", "{total_reads}": "total_reads", "{low_depth_threshold}": str(reports.LOW_DEPTH)}

    def filled(text: str) -> str:
        sql = "'" + text.replace("'", "''") + "'"
        for k, v in values.items():
            sql = sql.replace(k, f"'||{v}||'")
        return sql

    return "case h[1] " + " ".join(f"when '{r}' then {filled(t)}" for r, t in reports.SUGGESTIONS.items()) + f" else '{reports.NO_SUGGESTION}' end"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _weights(spark, d, local=False):
    return matrix.normalise(matrix.best_scores(adapter.alignments(spark, d)), within_locus=local)


@query()
def vb_em(spark, d):
    return kernels.vb_em(_weights(spark, d)).select("sample_id", "locus", "allele", *[F.round(c, 6).alias(c) for c in ("weight", "dosage")], F.round("elbo", 3).alias("elbo"), "iterations")


def _phase(spark, d, method):
    a = adapter.alignments(spark, d)
    return kernels.phase(phasing.read_matrix(a, phasing.het_sites(a)), method)


@query()
def phase_greedy(spark, d):
    return _phase(spark, d, "greedy")


@query()
def phase_longread(spark, d):
    return _phase(spark, d, "signature")


@query()
def phase_spectral(spark, d):
    return _phase(spark, d, "spectral")


@query()
def kmer_chi2_pvalue(spark, d):
    return annotation.kmer_chi2(spark, d).withColumn("p", F.round(kernels.chi2_pvalue(F.col("chi2"), F.col("df").cast("double")), 9))


@query(_E + ", s as (select sample_id,locus,case when total_reads>=20 and 1-explained/(1.0e0*greatest(total_reads,1))>0.15 then 1 else 0 end u,case when unexpected>0.20 then 1 else 0 end x,case when covered<0.85 then 1 else 0 end c,case when assembly_novel then 1 else 0 end a from ev) select sample_id,locus,concat_ws(',',case when u=1 then 'unexplained_reads' end,case when x=1 then 'unexpected_kmers' end,case when c=1 then 'low_kmer_coverage' end,case when a=1 then 'assembly' end) signals,(u+x+c+a)::int n_signals,case when u+x+c+a>=3 then 'HIGH' when u+x+c+a=2 then 'MEDIUM' else 'LOW' end confidence from s where u+x+c+a>0")
def novel_screen(spark, d):
    e = adapter.evidence(spark, d).select("sample_id", "locus", "explained", F.col("total_reads").alias("total"), "unexpected", "covered", "assembly_novel")
    return novel.screen(e).select("sample_id", "locus", F.array_join("signals", ",").alias("signals"), "n_signals", "confidence")


@query(_E + ", r as (select sample_id,locus,total_reads,snp_diff,covered,case when posterior>=0.99 and gap>=0.10 then ['unambiguous'] else list_filter([case when total_reads<10 then 'low_depth' end,case when snp_diff<=3 then 'close_alleles' end,case when n_het_sites>0 and not phased then 'phase_break' end,case when covered<0.70 then 'coverage_gap' end,case when data_type in ('exome','rna') and same_protein then 'exon_only' end,case when is_homozygous and gap<0.10 then 'homo_ambig' end], lambda x: x is not null) end f from ev), g as (select *,case when len(f)=0 then ['close_alleles'] else f end h from r) select sample_id,locus,h[1] reason,array_to_string(h[2:],',') secondary," + _suggestions() + " suggestion from g")
def ambiguity_reason(spark, d):
    e = adapter.evidence(spark, d).withColumnRenamed("covered", "kmer_coverage")
    return reports.ambiguity(e).select("sample_id", "locus", "reason", "secondary", "suggestion")


_QC = _E + ", q as (select *,list_filter([case when balance<0.3 then 'haplotype_imbalance' end,case when covered<0.85 then 'low_kmer_coverage' end,case when n_het_sites>0 and not phased then 'phasing_failed' end,case when n_het_sites=0 then 'no_het_sites' end], lambda x: x is not null) i,case when posterior>=0.99 and gap>=0.10 then 'HIGH' when posterior>=0.90 and gap>=0.05 then 'MEDIUM' when posterior>=0.50 then 'LOW' else 'VERY_LOW' end confidence,explained/(1.0e0*greatest(total_reads,1)) evidence from ev)"


@query(_QC + " select sample_id,locus,array_to_string(i,',') issues,len(i)=0 passed from q")
def locus_qc(spark, d):
    return reports.locus_qc(adapter.evidence(spark, d)).select("sample_id", "locus", F.array_join("issues", ",").alias("issues"), "passed")


def _tiered(spark, d):
    e = reports.locus_qc(adapter.evidence(spark, d)).drop("passed").withColumn("n_issues", F.size("issues"))
    e = e.withColumn("confidence", posterior.tier(F.col("posterior"), F.col("gap"))).withColumn("evidence", F.col("explained") / F.greatest("total_reads", F.lit(1)))
    return e.withColumn("kmer_ok", F.col("concordant"))


@query(_QC + " select sample_id,count(*) n_loci,count(*) filter (where confidence='HIGH') n_high,count(*) filter (where confidence='MEDIUM') n_medium,count(*) filter (where confidence='LOW') n_low,count(*) filter (where confidence in ('HIGH','MEDIUM') and evidence>=0.5 and concordant and len(i)=0) n_passed from q group by 1")
def qc_report(spark, d):
    return reports.qc_report(_tiered(spark, d))[1]


@query(_QC + ", c as (select *,confidence in ('HIGH','MEDIUM') and allele1<>'' rep from q), w as (select *,case when not rep then 'HLA-'||locus||': withheld (confidence='||confidence||')' when not concordant then 'HLA-'||locus||': k-mer discordant' end warn from c) select sample_id,count(*) filter (where rep) n_reported,coalesce(string_agg(distinct case when not rep then locus end,'; ' order by case when not rep then locus end),'') withheld,coalesce(string_agg(distinct warn,'; ' order by warn),'') warnings,case when count(*) filter (where rep)=0 then 'INSUFFICIENT' when count(*) filter (where rep)=count(*) filter (where rep and confidence='HIGH') then 'HIGH' when count(*) filter (where rep and confidence='HIGH')>0 then 'MIXED' else 'MODERATE' end overall from w group by 1")
def clinical_report(spark, d):
    e = _tiered(spark, d).withColumn("is_ambiguous", ~F.col("phased")).withColumn("reason", F.lit("phase_break"))
    return reports.clinical(e)[1]


@query(_QC + " select sample_id,locus,posterior<0.80 or not concordant or evidence<0.5 needed from q")
def assembly_trigger(spark, d):
    e = _tiered(spark, d)
    return e.select("sample_id", "locus", reports.assembly_trigger(F.col("posterior"), F.col("concordant"), F.col("evidence"), F.col("explained")).alias("needed"))


def _compiled(spark, d):
    a = adapter.alignments(spark, d)
    g = samples.apply_copy_number(genotype.calls(_weights(spark, d)), samples.copy_number(samples.depths(a)))
    return reports.compile_calls(g, posterior.best_with_gap(posterior.pair_posteriors(_weights(spark, d, True))))


def _compile_sql() -> str:
    g = genotyping
    rest = g.SQL["cnv_rewrite"].split("from l)", 1)[1]
    head, tail = rest.rsplit(" select c.sample_id", 1)
    gap = g._GAP.split("from l)", 1)[1].replace("m as", "m2 as", 1).replace(" nrm", " nrm2").replace("from m)", "from m2)").replace(", al as", ", al2 as").replace("from al a join al b", "from al2 a join al2 b")
    gap = gap.replace(" p as (select", " pp as (select").replace("from p)", "from pp)").replace(", r as", ", r_2 as").replace(" e as", " e2 as").replace("from e)", "from e2)").replace(" g as", " g2 as").replace("from g)", "from g2)").replace(" k as", " k2 as").replace("from k)", "from k2)")
    final = ", cw as (select c.sample_id" + tail + "), bp as (select * from gp where rank=1) select cw.sample_id,cw.locus,case when cw.status like 'cnv%' then cw.allele1 else bp.a1 end allele1,case when cw.status like 'cnv%' then cw.allele2 else bp.a2 end allele2,case when cw.allele1='' then 'VERY_LOW' when p>=0.99 and gap>=0.10 then 'HIGH' when p>=0.90 and gap>=0.05 then 'MEDIUM' when p>=0.50 then 'LOW' else 'VERY_LOW' end confidence,case when cw.allele1='' then 'no_call' else cw.status end status from cw join bp on bp.sample_id=cw.sample_id and bp.locus=cw.locus"
    return g._ALN + head + gap + final


@query(_compile_sql())
def compile_calls(spark, d):
    return _compiled(spark, d).select("sample_id", "locus", "allele1", "allele2", "confidence", "status")


def _compared(spark, d):
    e = adapter.evidence(spark, d)
    return evaluate.against_truth(e.select("sample_id", "locus", "ancestry", "t1", "t2"), e.select("sample_id", "locus", "allele1", "allele2"))


@query(_CMP + " select sample_id,locus,matches from cm")
def compare_diploid(spark, d):
    return _compared(spark, d).select("sample_id", "locus", "matches")


def _rounded(df):
    return df.withColumn("accuracy", F.round("accuracy", 6)).withColumn("call_rate", F.round("call_rate", 6))


@query(_CMP + " select locus," + _COUNT + " from cm group by 1")
def locus_accuracy(spark, d):
    return _rounded(evaluate.accuracy(_compared(spark, d), "locus"))


@query(_CMP + " select ancestry,locus," + _COUNT + " from cm group by 1,2")
def accuracy_by_ancestry(spark, d):
    return _rounded(evaluate.accuracy(_compared(spark, d), "ancestry", "locus"))


@query(_CMP + " select " + _COUNT + " from cm")
def overall_accuracy(spark, d):
    return _rounded(evaluate.accuracy(_compared(spark, d)))


@query(_CMP + " select sample_id,locus,allele1 c1,allele2 c2,t1,t2,matches from cm where matches in (0,1)")
def discordant(spark, d):
    return evaluate.discordant(_compared(spark, d)).select("sample_id", "locus", "c1", "c2", "t1", "t2", "matches")


@query(_CMP + ", aa as (select concat(sample_id,'-',locus) k,x0,x1 from cm where n%13<>0), bb as (select concat(sample_id,'-',locus) k,x2,x3 from cm where n%14<>0), j as (select coalesce(aa.k,bb.k) k,coalesce(x0,'') x0,coalesce(x1,'') x1,coalesce(x2,'') x2,coalesce(x3,'') x3 from aa full join bb on aa.k=bb.k) select k as key,case when x0='' and x1='' then 'NO_CALL' when (x0=x2 and x1=x3) or (x0=x3 and x1=x2) then 'OK' when x0=x2 or x0=x3 or (x1<>'' and (x1=x2 or x1=x3)) then 'PARTIAL' else 'MISMATCH' end status from j")
def validate_full(spark, d):
    e = adapter.evidence(spark, d).withColumn("key", F.concat("sample_id", F.lit("-"), "locus"))
    r = e.where("n % 13 <> 0").select("key", F.col("allele1").alias("c1"), F.col("allele2").alias("c2"))
    return evaluate.validate(r, e.where("n % 14 <> 0").select("key", "t1", "t2")).select("key", "status")


_ALNS = "with " + adapter.ALIGNMENTS.format(lineitem="lineitem")


@query(_ALNS + ", t as (select sample_id,locus,allele,sum(as_score) s1,count(*) s2,max(as_score*100+mapq) s3 from aln group by 1,2,3), r as (select *,row_number() over (partition by sample_id,locus order by s1 desc,allele) r1,row_number() over (partition by sample_id,locus order by s2 desc,allele) r2,row_number() over (partition by sample_id,locus order by s3 desc,allele) r3 from t), cl as (select 'sum' caller,sample_id,locus,min(allele) a1,max(allele) a2 from r where r1<=2 group by 2,3 union all select 'cnt',sample_id,locus,min(allele),max(allele) from r where r2<=2 group by 2,3 union all select 'mx',sample_id,locus,min(allele),max(allele) from r where r3<=2 group by 2,3), vt as (select sample_id,locus,a1,a2,count(*) n,min(caller) fc from cl group by 1,2,3,4), k as (select *,row_number() over (partition by sample_id,locus order by n desc,fc) rk from vt) select sample_id,locus,a1,a2,n,round(n/3.0e0,4) rate,n>=2 ok from k where rk=1")
def consensus(spark, d):
    a = adapter.alignments(spark, d).groupBy("sample_id", "locus", "allele").agg(F.sum("as_score").alias("sum"), F.count("*").alias("cnt"), F.max(F.col("as_score") * 100 + F.col("mapq")).alias("mx"))
    found = None
    for c in ("sum", "cnt", "mx"):
        top = genotype.Window.partitionBy("sample_id", "locus").orderBy(F.col(c).desc(), "allele")
        one = a.withColumn("_r", F.row_number().over(top)).where("_r <= 2").groupBy("sample_id", "locus").agg(F.min("allele").alias("a1"), F.max("allele").alias("a2")).withColumn("caller", F.lit(c))
        found = one if found is None else found.unionByName(one)
    return evaluate.consensus(found).select("sample_id", "locus", "a1", "a2", "n", F.round("rate", 4).alias("rate"), "ok")


@query(_E + ", w as (select sample_id,max(case when locus='A' then allele1 end) a1,max(case when locus='A' then allele2 end) a2,max(case when locus='B' then allele1 end) b1,max(case when locus='B' then allele2 end) b2,max(case when locus='C' then allele1 end) c1,max(case when locus='C' then allele2 end) c2 from ev group by 1) select * from (select sample_id,'A' locus,a1,a2 from w union all select sample_id,'B',b1,b2 from w union all select sample_id,'C',c1,c2 from w) x where a1<>'' and a2<>''")
def parse_optitype_wide(spark, d):
    e = adapter.evidence(spark, d).where("locus in ('A','B','C')")
    wide = e.groupBy("sample_id").agg(*[F.max(F.when(F.col("locus") == x, F.col(f"allele{i}"))).alias(f"{x}{i}") for x in "ABC" for i in (1, 2)])
    return callers.wide(wide, "sample_id")


@query(_E + " select sample_id,locus,allele1 a1,case when n%3=0 then allele1 else allele2 end a2 from ev where locus in ('A','B','DRB1')")
def parse_arcas_json(spark, d):
    e = adapter.evidence(spark, d).where("locus in ('A','B','DRB1')")
    one = F.when(F.col("n") % 3 == 0, F.array("allele1")).otherwise(F.array("allele1", "allele2"))
    doc = e.groupBy("sample_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("locus", one.alias("v"))))).alias("json"))
    return callers.json_map(doc, "sample_id", "json")


@query(_E + ", s as (select * from ev where locus in ('A','B','C') and allele1<>'') select sample_id,locus,allele1 a1,allele2 a2 from s")
def parse_xhla_json(spark, d):
    e = adapter.evidence(spark, d).where("locus in ('A','B','C') and allele1 <> ''").orderBy("sample_id", "locus")
    doc = e.groupBy("sample_id").agg(F.flatten(F.collect_list(F.array("allele1", "allele2"))).alias("alleles"))
    return callers.json_list(doc.select("sample_id", F.to_json(F.struct(F.struct("alleles").alias("hla"))).alias("json")), "sample_id", "json")


_CT = "select 's'||c_custkey sample,case when c_custkey%3=0 then 'chr6' when c_custkey%3=1 then '6' else 'chr7' end as name,cast(169500000+(c_custkey*7919)%3000000 as bigint) length,cast(c_custkey%1000 as bigint) reads from customer"


def _contigs(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    name = F.when(F.col("c_custkey") % 3 == 0, "chr6").when(F.col("c_custkey") % 3 == 1, "6").otherwise("chr7")
    return c.select(name.alias("name"), (169500000 + (F.col("c_custkey") * 7919) % 3000000).cast("long").alias("length"), (F.col("c_custkey") % 1000).cast("long").alias("reads"))


@query("with c as (" + _CT + ") select case when max(case when name='chr6' then 1 else 0 end)=1 then 'GRCh38' when count(*)>0 then 'GRCh37' end build from c where name in ('chr6','6') and length>170000000 and length<172000000")
def detect_build(spark, d):
    return evaluate.detect_build(_contigs(spark, d))


@query("with c as (" + _CT + ") select round(coalesce(sum(reads*150.0e0)/nullif(sum(length),0),30.0),9) depth from c where name<>'*'")
def estimate_depth(spark, d):
    return evaluate.estimate_depth(_contigs(spark, d)).withColumn("depth", F.round("depth", 9))


@query("with r as (select l_orderkey id,l_linenumber ln,case when l_suppkey%4=0 then 'chr7' else 'chr6' end chrom,28000000+(l_partkey*104729)%7000000 pos,l_suppkey%9 flag from lineitem) select id,ln,chrom,pos,flag from r where (chrom='chr6' and pos<33480577 and pos+150>28510120) or (flag&4)<>0")
def mhc_reads(spark, d):
    r = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ln"), F.when(F.col("l_suppkey") % 4 == 0, "chr7").otherwise("chr6").alias("chrom"), (28000000 + (F.col("l_partkey") * 104729) % 7000000).alias("pos"), (F.col("l_suppkey") % 9).alias("flag"))
    return evaluate.region_reads(r.withColumn("end", F.col("pos") + 150), "chr6", 28510120, 33480577).drop("end")


_H = ", h as (select *, ('0x'||substr(md5('42|'||read_id::varchar),1,8))::bigint % 100 h from aln)"


@query(_ALNS + _H + " select sample_id,locus,count(distinct read_id) reads from h where h<25 group by 1,2")
def downsample(spark, d):
    return evaluate.downsample(adapter.alignments(spark, d), 0.25).groupBy("sample_id", "locus").agg(F.countDistinct("read_id").alias("reads"))


@query(_ALNS + _H + ", t as (select * from (values (5,8),(10,16),(20,33),(30,50),(50,83),(100,100)) v(target,share)) select target::int target,sample_id,locus,count(distinct read_id) reads from h join t on h.h<share group by 1,2,3")
def depth_curve(spark, d):
    kept = evaluate.depth_curve(adapter.alignments(spark, d), 60.0)
    return kept.groupBy("target", "sample_id", "locus").agg(F.countDistinct("read_id").alias("reads"))


#: A whole run of the default loci: its candidates, evidence, genotypes, copies and posteriors.
_RUN = genotyping.RUN.replace("from l)", "from l where locus in (" + ",".join(f"'{x}'" for x in DEFAULT_LOCI) + "))", 1) + genotyping.RUN_COPIES + ", rc as (select gt.*,cn.copies,gp.a1,gp.a2,gp.p,gp.gap from gt join cn using (sample_id,locus) join gp using (sample_id,locus) where gp.rank=1)"


def _run(spark, d):
    from . import typing_run

    return typing_run.run(adapter.alignments(spark, d))


@query(_RUN + " select sample_id,locus,case when copies=0 then '' when copies=1 then allele1 else a1 end allele1,case when copies<=1 then '' else a2 end allele2,case when copies=0 then 'VERY_LOW' when p>=0.99 and gap>=0.10 then 'HIGH' when p>=0.90 and gap>=0.05 then 'MEDIUM' when p>=0.50 then 'LOW' else 'VERY_LOW' end confidence,case when copies=0 then 'no_call' when copies=1 then 'cnv_hemizygous' when kk=1 then 'trivial' else 'optimal' end status,reads_explained,total_reads from rc")
def typing_run_calls(spark, d):
    return _run(spark, d).calls.select("sample_id", "locus", "allele1", "allele2", "confidence", "status", "reads_explained", "total_reads")


_HETS = genotyping._HET.split("from l)", 1)[1].split(", rb as", 1)[0]


@query(
    _RUN
    + _HETS
    + ", hs as (select sample_id,locus,count(*) c from het group by 1,2), ev as (select rc.*,dr.n locus_reads,dr.r ref_reads,coalesce(hs.c,0) n_het_sites from rc join dr using (sample_id,locus) left join hs using (sample_id,locus)),"
    " sg as (select *,case when kk=1 then case when ref_reads>0 and locus_reads*1.0::double/ref_reads<0.6 then 1 else 0 end+case when n_het_sites>=2 then 2 when n_het_sites=1 then 1 else 0 end+case when p<0.90 then 1 else 0 end else 0 end signals from ev)"
    " select sample_id,locus,n_het_sites,case when signals>=3 then 'HIGH' when signals=2 then 'MEDIUM' when signals=1 then 'LOW' else 'NONE' end dropout,"
    "p<0.8 or reads_explained<0.5*greatest(total_reads,1) needs_assembly,total_reads>=20 and 1-reads_explained/(1.0::double*greatest(total_reads,1))>0.15 unexplained from sg"
)
def typing_run_reports(spark, d):
    """What the run itself reports of each locus: heterozygous sites, risk of dropout, need of assembly, signs of a novel allele."""
    r = _run(spark, d)
    keys = ["sample_id", "locus"]
    n = r.sites.groupBy(*keys).agg(F.count("*").alias("n_het_sites"))
    flag = lambda df, name: df.select(*keys, F.lit(True).alias(name))
    out = r.calls.select(*keys).join(n, keys, "left").join(r.dropout.select(*keys, F.col("risk").alias("dropout")), keys, "left").join(flag(r.assembly_needed, "needs_assembly"), keys, "left").join(flag(r.novel, "unexplained"), keys, "left")
    return out.na.fill(0, ["n_het_sites"]).na.fill(False, ["needs_assembly", "unexplained"])


#: The run above for every target depth of every sample: its reads below the target's share of 60.
_DEPTHS = (5, 20, 60)
_BY_DEPTH = _RUN.replace("aln as (", "aln0 as (", 1).replace(
    "where locus in (" + ",".join(f"'{x}'" for x in DEFAULT_LOCI) + "))",
    "where locus in (" + ",".join(f"'{x}'" for x in DEFAULT_LOCI) + ")), hh as (select *,('0x'||substr(md5('42|'||read_id::varchar),1,8))::bigint % 100 h from aln0), aln as (select target||'|'||sample_id sample_id,read_id,locus,allele,as_score,mapq,is_secondary,pos,base from hh join (values (5,8),(20,33),(60,100)) v(target,share) on h<share)",
    1,
)
_TRUTH = "select distinct sample_id,locus,concat(locus,'*0',cast(1+sample_id%2 as string),':01') t1,concat(locus,'*0',cast(1+sample_id%3 as string),':02') t2"


@query(
    _BY_DEPTH
    + ", tr as (" + _TRUTH + " from aln0), tg as (select tr.*,target from tr cross join (values (5),(20),(60)) v(target)), fc as (select sample_id,locus,case when copies=0 then '' when copies=1 then allele1 else a1 end c1,case when copies<=1 then '' else a2 end c2 from rc),"
    " mm as (select target::int target,coalesce(c1,'') x0,coalesce(c2,'') x1,t1 x2,t2 x3 from tg left join fc on fc.sample_id=target||'|'||tg.sample_id and fc.locus=tg.locus),"
    " cm as (select target,case when x0='' and x1='' then -1 when (x0=x2 and x1=x3) or (x0=x3 and x1=x2) then 2 when x0=x2 or x0=x3 or (x1<>'' and (x1=x2 or x1=x3)) then 1 else 0 end matches from mm) select target," + _COUNT + " from cm group by 1"
)
def depth_accuracy(spark, d):
    """Accuracy of whole runs at three depths, against a truth made from the sample's number."""
    from . import outputs

    a = adapter.alignments(spark, d).where(F.col("locus").isin(*DEFAULT_LOCI))
    s = F.col("sample_id")
    truth = a.select("sample_id", "locus").distinct().withColumn("t1", F.concat("locus", F.lit("*0"), 1 + s % 2, F.lit(":01"))).withColumn("t2", F.concat("locus", F.lit("*0"), 1 + s % 3, F.lit(":02")))
    return _rounded(outputs.depth_accuracy(a, truth, 60.0, targets=_DEPTHS))


_ONE = _ALNS + ", o as (select sample_id*1000+read_id%997 as s, read_id, as_score, mapq, is_secondary from aln where locus='A' and allele='A*01:01'), n as (select s,count(*) filter (where mapq>=1) n from o group by 1), pm as (select distinct o.s,read_id from o join n on n.s=o.s where n>=2 and not is_secondary and mapq>=0), t as (select s,count(*) reads from pm group by 1)"


@query(_ONE + " select s sample_id,'A' locus,least(1.0,reads/20.0)::double posterior,1.0::double gap,case when reads>=20 then 'HIGH' when reads>=18 then 'MEDIUM' when reads>=10 then 'LOW' else 'VERY_LOW' end confidence,reads total_reads,'trivial' status from t")
def typing_run_single(spark, d):
    """Loci with one candidate allele and few reads: the posterior is a twentieth a read."""
    from . import typing_run

    a = adapter.alignments(spark, d).where("locus = 'A' and allele = 'A*01:01'").withColumn("sample_id", F.col("sample_id") * 1000 + F.col("read_id") % 997)
    return typing_run.run(a).calls.select("sample_id", "locus", "posterior", "gap", "confidence", "total_reads", "status")


@query("select time_bucket(interval '1 hour', ts) as start,event_type,count(*) n,round(sum(value),4) total from events group by 1,2")
def stream_windows(spark, d):
    from ..streaming import depth

    return depth.windowed(spark.read.parquet(f"{d}/events.parquet")).withColumn("total", F.round("total", 4))


_RES = annotation._G + ", c as (select *,case when locus in ('A','B','C') then 3 else 2 end mx from parsed), gg as (select al,gg from g), q as (select c.*,coalesce(gg.gg,c.name) g1 from c left join gg on gg.al=concat(c.locus,'*',c.f1,':',c.f2))"


@query(_RES + " select pk,concat(locus,'*',f1,suffix) one,concat(locus,'*',f1,':',f2,case when mx=3 and f3<>'' then ':'||f3 else '' end,suffix) most,g1 grp,case when pk%7=0 then '' else concat(locus,'*',f1,suffix) end other from q")
def resolution_control(spark, d):
    """Both alleles shown by number of fields, at the assay's most, and as G groups."""
    n = adapter.allele_names(spark, d)
    p = n.select(names.parse(F.col("name")).alias("p"))
    groups = p.where(F.col("p.field2").isin("01", "02")).select(names.four_digit(F.col("p")).alias("allele"), F.concat(F.col("p.locus"), F.lit("*"), F.col("p.field1"), F.lit(":01:01G")).alias("g_group")).distinct()
    calls = n.select("pk", names.parse(F.col("name")).locus.alias("locus"), F.col("name").alias("allele1"), F.when(F.col("pk") % 7 == 0, "").otherwise(F.col("name")).alias("allele2"))
    one = reports.at_resolution(calls, 1).select("pk", F.col("allele1").alias("one"), F.col("allele2").alias("other"))
    most = reports.at_resolution(calls, "max", "short").select("pk", F.col("allele1").alias("most"))
    grp = reports.at_resolution(calls, "G", groups=groups).select("pk", F.col("allele1").alias("grp"))
    return one.join(most, "pk").join(grp, "pk").select("pk", "one", "most", "grp", "other")

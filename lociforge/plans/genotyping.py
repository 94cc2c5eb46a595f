"""Catalogue: genotyping queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates, genotype, matrix, phasing, posterior, samples
from . import adapter

QUERIES, SQL = {}, {}
_ALN = "with recursive " + adapter.ALIGNMENTS.format(lineitem="lineitem")
_M = _ALN + ", m as (select sample_id,locus,read_id,allele,max(as_score) sc from aln group by 1,2,3,4)"
_NRM = _M + ", nrm as (select *, cast(sc as double)/max(sc) over (partition by sample_id,read_id) w from m)"
_LOC = _M + ", nrm as (select *, cast(sc as double)/max(sc) over (partition by sample_id,locus,read_id) w from m)"
_OBJ = _NRM + ", t as (select sample_id,locus,allele,round(sum(w),6) obj, count(*) n from nrm group by 1,2,3), r as (select *, row_number() over (partition by sample_id,locus order by obj desc, allele) rn from t)"
_PAIR = (
    _LOC
    + """, al as (select distinct sample_id,locus,allele from nrm), pr as (select a.sample_id,a.locus,a.allele a1,b.allele a2 from al a join al b on a.sample_id=b.sample_id and a.locus=b.locus and a.allele<=b.allele),
 rd as (select distinct sample_id,locus,read_id from nrm),
 pw as (select pr.*, rd.read_id, coalesce(x.w,0) p1, coalesce(y.w,0) p2 from pr join rd on pr.sample_id=rd.sample_id and pr.locus=rd.locus left join nrm x on x.sample_id=rd.sample_id and x.locus=rd.locus and x.read_id=rd.read_id and x.allele=pr.a1 left join nrm y on y.sample_id=rd.sample_id and y.locus=rd.locus and y.read_id=rd.read_id and y.allele=pr.a2),
 g as (select sample_id,locus,a1,a2,sum(case when p1>0 or p2>0 then ln((p1+p2)/2) else ln(1e-10) end) ll from pw group by 1,2,3,4),
 e as (select *, exp(ll-max(ll) over (partition by sample_id,locus)) ex from g),
 p as (select sample_id,locus,a1,a2,ll,ex/sum(ex) over (partition by sample_id,locus) p from e),
 k as (select *, row_number() over (partition by sample_id,locus order by round(p,9) desc, round(ll,6) desc, a1, a2) rank from p)"""
)
_DEPTH = _ALN + ", d as (select sample_id,locus,count(distinct read_id) n from aln group by 1,2), dr as (select d.*, coalesce(r.n,0) r from d left join d r on r.sample_id=d.sample_id and r.locus='DRB1')"
_CN = """, cn as (select sample_id, locus, n as reads, r as ref_reads,
  case when locus not in ('DRB3','DRB4','DRB5') then 1.0 when r<10 then 0.0 else round(cast(n as double)/r,4) end ratio,
  cast(case when locus not in ('DRB3','DRB4','DRB5') or r<10 then 2 when cast(n as double)/r<0.10 then 0 when cast(n as double)/r<0.65 then 1 else 2 end as int) copies,
  case when locus not in ('DRB3','DRB4','DRB5') then 'HIGH' when r<10 then 'LOW' when cast(n as double)/r<0.05 then 'HIGH' when cast(n as double)/r>0.80 then 'HIGH'
   when cast(n as double)/r between 0.10 and 0.6499999999999 then case when abs(cast(n as double)/r-0.375)<0.10 then 'MEDIUM' else 'LOW' end else 'MEDIUM' end confidence,
  case when locus not in ('DRB3','DRB4','DRB5') then 'fixed' when r<10 then 'fallback' else 'depth_ratio' end as method from dr)"""
_CALLS = _OBJ.replace("with recursive ", "with ", 1) + """, best as (select * from r where rn<=2),
 cl as (select sample_id,locus,min(allele) allele1,max(allele) allele2,round(sum(obj),6) objective,count(*) kk from best group by 1,2),
 ex as (select n.sample_id,n.locus,count(distinct n.read_id) reads_explained from nrm n join best b on b.sample_id=n.sample_id and b.locus=n.locus and b.allele=n.allele where w>0 group by 1,2),
 tt as (select sample_id,locus,count(distinct read_id) total_reads from nrm group by 1,2),
 calls as (select cl.sample_id,cl.locus,allele1,allele2,objective,coalesce(reads_explained,0) reads_explained,total_reads,kk=1 is_homozygous,case when kk=1 then 'trivial' else 'optimal' end status
  from cl join tt on tt.sample_id=cl.sample_id and tt.locus=cl.locus left join ex on ex.sample_id=cl.sample_id and ex.locus=cl.locus)"""
_HET = _ALN + """, pl as (select sample_id,locus,pos,base,count(*) n from aln group by 1,2,3,4), wl as (select *, sum(n) over (partition by sample_id,locus,pos) depth, row_number() over (partition by sample_id,locus,pos order by n desc, base) rk from pl),
 het as (select sample_id,locus,pos,cast(max(depth) as bigint) depth, max(case when rk=1 then base end) major, max(case when rk=2 then base end) minor from wl group by 1,2,3 having max(depth)>=5 and max(case when rk=2 then n end)*1.0/max(depth) between 0.15 and 0.85),
 rb as (select sample_id,locus,read_id,pos,min(base) base from aln group by 1,2,3,4),
 mx as (select rb.sample_id,rb.locus,rb.read_id,rb.pos,cast(case when base=major then 0 else 1 end as int) v from rb join het on het.sample_id=rb.sample_id and het.locus=rb.locus and het.pos=rb.pos where base in (major,minor))"""
_BINS = ", con as (select mx.sample_id,mx.locus,cast(case when mx.read_id%3=0 then 0 else 1 end as int) bin,mx.pos,cast(case when avg(v)>0.5 then 1 else 0 end as int) v,count(*) n from mx group by 1,2,3,4), cons as (select con.sample_id,con.locus,bin,con.pos,case when v=0 then major else minor end base,n from con join het on het.sample_id=con.sample_id and het.locus=con.locus and het.pos=con.pos)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _scores(spark, d):
    return matrix.best_scores(adapter.alignments(spark, d))


def _weights(spark, d):
    return matrix.normalise(_scores(spark, d))


def _local(spark, d):
    return matrix.normalise(_scores(spark, d), within_locus=True)


def _posteriors(spark, d):
    return posterior.pair_posteriors(_local(spark, d))


@query(_OBJ + " select sample_id,locus,allele,obj,n,rn from r where rn<=2")
def top2_genotype(spark, d):
    return genotype.top_pair(_weights(spark, d))


@query(_CALLS + " select * from calls")
def reads_explained(spark, d):
    return genotype.calls(_weights(spark, d))


@query(_M + ", h as (select distinct sample_id,locus,read_id,allele from m where sc>0), n as (select sample_id,locus,allele,count(*) n from h group by 1,2,3), pr as (select a.sample_id,a.locus,a.allele a1,b.allele a2,a.n na,b.n nb from n a join n b on a.sample_id=b.sample_id and a.locus=b.locus and a.allele<b.allele), s as (select x.sample_id,x.locus,x.allele a1,y.allele a2,count(*) c from h x join h y on x.sample_id=y.sample_id and x.locus=y.locus and x.read_id=y.read_id and x.allele<y.allele group by 1,2,3,4), u as (select pr.sample_id,pr.locus,pr.a1,pr.a2,na+nb-coalesce(c,0) covered from pr left join s on s.sample_id=pr.sample_id and s.locus=pr.locus and s.a1=pr.a1 and s.a2=pr.a2), z as (select *, row_number() over (partition by sample_id,locus order by covered desc,a1,a2) rr from u) select sample_id,locus,a1,a2,cast(covered as bigint) covered from z where rr=1")
def max_coverage_pair(spark, d):
    return genotype.max_coverage_pair(_scores(spark, d))


@query(_PAIR + " select sample_id,locus,a1,a2,round(sum(ln((p1+p2)/2)),4) ll,count(*) n_reads from pw where p1>0 or p2>0 group by 1,2,3,4")
def diploid_loglik(spark, d):
    return genotype.pair_loglik(_local(spark, d))


@query(_PAIR + " select sample_id,locus,a1,a2,round(ll,4) ll,round(p,6) p from p")
def pair_posterior(spark, d):
    return _posteriors(spark, d).withColumn("ll", F.round("ll", 4)).withColumn("p", F.round("p", 6))


@query(_PAIR + " select sample_id,locus,a1,a2,round(ll,4) ll,round(p,6) p,rank from k where rank between 2 and 6")
def posterior_top5(spark, d):
    return posterior.alternatives(_posteriors(spark, d)).withColumn("ll", F.round("ll", 4)).withColumn("p", F.round("p", 6))


_GAP = _PAIR + ", gp as (select *, coalesce(p-lead(p) over (partition by sample_id,locus order by rank),1.0) gap from k)"


@query(_GAP + " select sample_id,locus,a1,a2,round(p,6) p,round(gap,6) gap from gp where rank=1")
def ambiguity_gap(spark, d):
    return posterior.best_with_gap(_posteriors(spark, d)).select("sample_id", "locus", "a1", "a2", F.round("p", 6).alias("p"), F.round("gap", 6).alias("gap"))


@query(_PAIR + ", q as (select sample_id,locus,p/sum(p) over (partition by sample_id,locus) q from p where p>0) select sample_id,locus,round(-sum(q*ln(q)),6)+0.0 entropy from q group by 1,2")
def posterior_entropy(spark, d):
    return posterior.entropy(_posteriors(spark, d)).withColumn("entropy", F.round("entropy", 6) + 0.0)


@query(_GAP + " select sample_id,locus,case when p>=0.99 and gap>=0.10 then 'HIGH' when p>=0.90 and gap>=0.05 then 'MEDIUM' when p>=0.50 then 'LOW' else 'VERY_LOW' end tier, case when p>0.99 then 'HIGH' when p>0.90 then 'MEDIUM' else 'LOW' end strict_class from gp where rank=1")
def confidence_tier(spark, d):
    b = posterior.best_with_gap(_posteriors(spark, d))
    return b.select("sample_id", "locus", posterior.tier(F.col("p"), F.col("gap")).alias("tier"), posterior.strict_class(F.col("p")).alias("strict_class"))


@query(_ALN + " select sample_id,locus,allele,count(distinct read_id) reads,least(1.0,count(distinct read_id)/20.0)::double posterior,case when count(distinct read_id)>10 then 'HIGH' when count(distinct read_id)>3 then 'MEDIUM' else 'LOW' end confidence from aln group by 1,2,3")
def single_allele_confidence(spark, d):
    n = adapter.alignments(spark, d).groupBy("sample_id", "locus", "allele").agg(F.countDistinct("read_id").alias("reads"))
    p, c = posterior.single_allele(F.col("reads"))
    return n.select("*", p.cast("double").alias("posterior"), c.alias("confidence"))


@query(_DEPTH + _CN + " select * from cn")
def copy_number(spark, d):
    return samples.copy_number(samples.depths(adapter.alignments(spark, d)))


@query(_CALLS + _DEPTH.split("aln as", 1)[1].split("from l)", 1)[1] + _CN + " select c.sample_id,c.locus,case when copies=0 then '' else allele1 end allele1,case when copies<=1 then '' else allele2 end allele2,case when copies=0 then 'cnv_absent' when copies=1 then 'cnv_hemizygous' else status end status,copies from calls c join cn on cn.sample_id=c.sample_id and cn.locus=c.locus")
def cnv_rewrite(spark, d):
    c = samples.apply_copy_number(genotype.calls(_weights(spark, d)), samples.copy_number(samples.depths(adapter.alignments(spark, d))))
    return c.select("sample_id", "locus", "allele1", "allele2", "status", "copies")


_THIRD = _DEPTH + ", an as (select sample_id,locus,allele,count(distinct read_id) n from aln group by 1,2,3), th as (select *,row_number() over (partition by sample_id,locus order by n desc,allele) rr from an), t3 as (select th.sample_id,th.locus,th.allele,th.n,d.n total,cast(th.n as double)/d.n fraction from th join d on d.sample_id=th.sample_id and d.locus=th.locus where rr=3)"


@query(_THIRD + " select sample_id,locus,allele,n,total,round(fraction,6) fraction from t3")
def third_allele(spark, d):
    return samples.third_allele(samples.read_counts(adapter.alignments(spark, d))).withColumn("fraction", F.round("fraction", 6))


@query(_THIRD + ", f as (select sample_id,count(*) c,string_agg(locus,',' order by locus) l from t3 where total>=20 and fraction>=0.10 group by 1), a as (select sample_id,count(distinct locus) n_loci from aln group by 1) select a.sample_id,n_loci,coalesce(c,0) n_flagged,coalesce(l,'') flagged_loci,round(coalesce(c,0)*1.0::double/n_loci,4) score,coalesce(c,0)>=2 is_contaminated from a left join f on f.sample_id=a.sample_id")
def contamination(spark, d):
    return samples.contamination(adapter.alignments(spark, d))


@query(_HET + " select * from het")
def het_sites(spark, d):
    return phasing.het_sites(adapter.alignments(spark, d))


def _sites(spark, d):
    a = adapter.alignments(spark, d)
    s = phasing.het_sites(a)
    return a, s, phasing.read_matrix(a, s)


def _truth_bins(m):
    """Bins of the adapter's known haplotypes."""
    return m.select("sample_id", "locus", "read_id").distinct().withColumn("bin", F.when(F.col("read_id") % 3 == 0, 0).otherwise(1))


@query(_HET + " select * from mx")
def read_snp_matrix(spark, d):
    return _sites(spark, d)[2]


@query(_HET + _BINS + " select * from cons")
def bin_consensus(spark, d):
    _, s, m = _sites(spark, d)
    return phasing.bin_consensus(m, _truth_bins(m), s)


_SEQS = "select locus, allele, repeat(substring('ACGTTGCA', cast(1+length(allele)%3+cast(right(allele,1) as int) as int), 4), 30) seq from (select distinct locus, allele from aln) q"


@query(_HET + _BINS + ", sq as (" + _SEQS + "), sc as (select cons.sample_id,cons.locus,bin,sq.allele,count(*) filter (where pos<length(seq) and substring(seq,pos+1,1)=base) matches,count(*) filter (where pos<length(seq)) compared from cons join sq on sq.locus=cons.locus group by 1,2,3,4), z as (select *,cast(matches as double)/greatest(compared,1) score,row_number() over (partition by sample_id,locus,bin order by cast(matches as double)/greatest(compared,1) desc,allele) rr from sc) select sample_id,locus,bin,allele,matches,compared,round(score,6) score from z where rr=1")
def bin_match(spark, d):
    a, s, m = _sites(spark, d)
    seqs = adapter.relation(spark, d, adapter.ALIGNMENTS, _SEQS)
    return phasing.match_bins(phasing.bin_consensus(m, _truth_bins(m), s), seqs).withColumn("score", F.round("score", 6))


@query(_HET + ", rr as (select distinct sample_id,locus,read_id from mx), n as (select sample_id,locus,count(*) filter (where read_id%3=0) n0,count(*) filter (where read_id%3<>0) n1,count(*) reads from rr group by 1,2) select sample_id,locus,n0,n1,reads,round(cast(least(n0,n1) as double)/greatest(n0,n1),6) balance,1.0::double confidence from n")
def haplotype_balance(spark, d):
    return phasing.balance(_truth_bins(_sites(spark, d)[2])).withColumn("balance", F.round("balance", 6))


_PRE = _ALN + ", n as (select sample_id,locus,allele,count(*) n from aln where mapq>=1 group by 1,2,3), tt as (select sample_id,sum(n) t from n group by 1), f as (select n.* from n join tt on tt.sample_id=n.sample_id where n.n>=greatest(2,floor(t*0.01))), rk as (select *,row_number() over (partition by sample_id,locus order by n desc,allele) rank from f)"


@query(_PRE + " select * from rk where rank<=80")
def prefilter_candidates(spark, d):
    return candidates.prefilter(adapter.alignments(spark, d))


_SC = _ALN + ", s as (select sample_id,locus,allele,cast(sum(greatest(0,coalesce(as_score,mapq))) as bigint) score from aln group by 1,2,3)"
_GROUP = ", g as (select sample_id,locus,{e} grp,cast(sum(score) as bigint) score,count(*) members from s group by 1,2,3), rk as (select *,row_number() over (partition by sample_id,locus order by score desc,grp) rank from g)"


@query(_SC + _GROUP.format(e="split_part(allele,':',1)") + " select * from rk where rank<=6")
def refine_groups_2digit(spark, d):
    return candidates.best_groups(candidates.allele_scores(adapter.alignments(spark, d)), 2, 6)


@query(_SC + _GROUP.format(e="allele") + " select * from rk where rank<=20")
def refine_groups_4digit(spark, d):
    return candidates.best_groups(candidates.allele_scores(adapter.alignments(spark, d)), 4, 20)


@query(_SC + _GROUP.format(e="split_part(allele,':',1)") + ", kk as (select s.*,grp g2 from s join rk on rk.sample_id=s.sample_id and rk.locus=s.locus and rk.grp=split_part(s.allele,':',1) where rank<=6), r4 as (select *,row_number() over (partition by sample_id,locus order by score desc,allele) r from kk) select sample_id,locus,allele,score,g2,allele g4 from r4 where r<=20")
def refine_alleles(spark, d):
    return candidates.refine(adapter.alignments(spark, d))


@query(_ALN + ", pm as (select * from aln where not is_secondary and mapq>=1), rd as (select distinct sample_id,read_id from pm), u as (select sample_id,locus,read_id,allele,as_score from pm union all select a.sample_id,a.locus,a.read_id,a.allele,a.as_score from aln a join rd on rd.sample_id=a.sample_id and rd.read_id=a.read_id where is_secondary), m as (select sample_id,locus,read_id,allele,max(as_score) score from u group by 1,2,3,4) select *, cast(score as double)/max(score) over (partition by sample_id,read_id) weight from m")
def matrix_secondary(spark, d):
    return matrix.normalise(matrix.evidence(adapter.alignments(spark, d), min_mapq=1))


@query(_ALN + ", pm as (select * from aln where not is_secondary and mapq>=2 and as_score>=5 and allele not like '%:04') select sample_id,locus,allele,count(*) n from pm group by 1,2,3")
def primary_filter(spark, d):
    a = adapter.alignments(spark, d)
    few = a.select("sample_id", "allele").distinct().where(~F.col("allele").like("%:04"))
    kept = a.where(~F.col("is_secondary") & (F.col("mapq") >= 2) & (F.col("as_score") >= 5)).join(few, ["sample_id", "allele"], "left_semi")
    return kept.groupBy("sample_id", "locus", "allele").agg(F.count("*").alias("n"))


@query(_DEPTH + _HET.split("from l)", 1)[1] + ", ev as (select dr.sample_id,dr.locus,dr.n reads,dr.r ref_reads,coalesce(h.c,0) n_het_sites,dr.n%2=0 is_homozygous,0.80+(dr.n%20)*0.01 posterior from dr left join (select sample_id,locus,count(*) c from het group by 1,2) h on h.sample_id=dr.sample_id and h.locus=dr.locus), s as (select *,case when is_homozygous then case when ref_reads>0 and cast(reads as double)/ref_reads<0.6 then 1 else 0 end+case when n_het_sites>=2 then 2 when n_het_sites=1 then 1 else 0 end+case when posterior<0.90 then 1 else 0 end else 0 end signals from ev) select sample_id,locus,cast(signals as int) signals,case when signals>=3 then 'HIGH' when signals=2 then 'MEDIUM' when signals=1 then 'LOW' else 'NONE' end risk from s")
def dropout_risk(spark, d):
    a, s, _ = _sites(spark, d)
    n = s.groupBy("sample_id", "locus").agg(F.count("*").alias("c"))
    e = samples.depths(a).join(n, ["sample_id", "locus"], "left").withColumn("n_het_sites", F.coalesce("c", F.lit(0)))
    e = e.withColumn("is_homozygous", F.col("reads") % 2 == 0).withColumn("posterior", F.lit(0.80) + (F.col("reads") % 20) * 0.01)
    return samples.dropout_risk(e).select("sample_id", "locus", "signals", "risk")


@query(_CALLS + ", x as (select sample_id,locus,allele1 allele from calls union all select sample_id,locus,concat(locus,'*99:01') from calls) select distinct sample_id,locus,allele from (select sample_id,locus,allele from aln union select * from x) y")
def candidates_with_phased(spark, d):
    c = genotype.calls(_weights(spark, d))
    phased = c.select("sample_id", "locus", F.col("allele1").alias("allele")).unionByName(c.select("sample_id", "locus", F.concat("locus", F.lit("*99:01")).alias("allele")))
    return candidates.add_phased(adapter.alignments(spark, d).select("sample_id", "locus", "allele").distinct(), phased)


# Candidates of a whole run, and the evidence of the alleles that are left.
RUN = (
    _PRE
    + """, c1 as (select a.* from aln a join rk on rk.sample_id=a.sample_id and rk.locus=a.locus and rk.allele=a.allele where rk.rank<=80),
 s as (select sample_id,locus,allele,split_part(allele,':',1) g2,cast(sum(greatest(0,as_score)) as bigint) score from c1 group by 1,2,3),
 s2 as (select *,sum(score) over (partition by sample_id,locus,g2) gs from s),
 s3 as (select *,dense_rank() over (partition by sample_id,locus order by gs desc,g2) gr from s2),
 s4 as (select *,dense_rank() over (partition by sample_id,locus order by score desc,allele) ar from s3 where gr<=6),
 left_ as (select distinct sample_id,allele from s4 where ar<=20),
 own as (select a.* from aln a join left_ using (sample_id,allele)),
 pm as (select * from own where not is_secondary),
 u as (select sample_id,locus,read_id,allele,as_score from pm union all select o.sample_id,o.locus,o.read_id,o.allele,o.as_score from own o where o.is_secondary and exists (select 1 from pm where pm.sample_id=o.sample_id and pm.read_id=o.read_id)),
 m as (select sample_id,locus,read_id,allele,max(as_score) sc from u group by 1,2,3,4),
 w1 as (select *,cast(sc as double)/max(sc) over (partition by sample_id,read_id) w from m),
 w2 as (select *,cast(sc as double)/max(sc) over (partition by sample_id,locus,read_id) w from m)"""
)
RUN += """, ob as (select sample_id,locus,allele,round(sum(w),6) obj from w1 group by 1,2,3),
 ro as (select *,row_number() over (partition by sample_id,locus order by obj desc,allele) rn from ob),
 b2 as (select * from ro where rn<=2),
 cl as (select sample_id,locus,min(allele) allele1,max(allele) allele2,count(*) kk from b2 group by 1,2),
 ex as (select w1.sample_id,w1.locus,count(distinct w1.read_id) reads_explained from w1 join b2 using (sample_id,locus,allele) where w>0 group by 1,2),
 tq as (select sample_id,locus,count(distinct read_id) total_reads from w1 group by 1,2),
 gt as (select cl.*,total_reads,coalesce(reads_explained,0) reads_explained from cl join tq using (sample_id,locus) left join ex using (sample_id,locus)),
 al as (select distinct sample_id,locus,allele from w2),
 pr as (select a.sample_id,a.locus,a.allele a1,b.allele a2 from al a join al b on a.sample_id=b.sample_id and a.locus=b.locus and a.allele<=b.allele),
 rd as (select distinct sample_id,locus,read_id from w2),
 pw as (select pr.*,rd.read_id,coalesce(x.w,0) p1,coalesce(y.w,0) p2 from pr join rd on pr.sample_id=rd.sample_id and pr.locus=rd.locus left join w2 x on x.sample_id=rd.sample_id and x.locus=rd.locus and x.read_id=rd.read_id and x.allele=pr.a1 left join w2 y on y.sample_id=rd.sample_id and y.locus=rd.locus and y.read_id=rd.read_id and y.allele=pr.a2),
 g as (select sample_id,locus,a1,a2,sum(case when p1>0 or p2>0 then ln((p1+p2)/2) else ln(1e-10) end) ll,count(*) filter (where p1>0 or p2>0) hit,count(*) over (partition by sample_id,locus) pairs from pw group by 1,2,3,4),
 e as (select *,exp(ll-max(ll) over (partition by sample_id,locus)) ex from g),
 p as (select *,case when pairs=1 then least(1.0,hit/20.0) else ex/sum(ex) over (partition by sample_id,locus) end p from e),
 k as (select *,row_number() over (partition by sample_id,locus order by round(p,9) desc,round(ll,6) desc,a1,a2) rank from p),
 gp as (select *,coalesce(p-lead(p) over (partition by sample_id,locus order by rank),1.0) gap from k)"""
RUN_COPIES = _DEPTH.split("from l)", 1)[1] + _CN + _THIRD.replace(_DEPTH, "").replace("th as", "t_ as").replace("from th join", "from t_ th join")

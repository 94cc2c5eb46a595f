"""The jobs as queries over the driver's tables: each runs twice into one new folder, and its whole output is what the second run leaves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lociforge.constants import DEFAULT_LOCI, EXTENDED
from lociforge.plans import adapter, annotation, genotyping
from lociforge.storage import shared_dir

from . import screen_reads, triage_cohort

_VIEW = "with " + adapter.ALIGNMENTS.format(lineitem="{rows}") + " select * from aln"
_SCREEN = {
    "reads": {"schema": "doc_id long, text string, lang string", "sample_id": "lang", "read_id": "doc_id", "seq": "text"},
    "panel": {"locus": "'P'", "allele": "concat('P*', item_id)", "seq": "text"},
    "seeds": {"k": 15, "least": 4, "texts": True},
}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lociforge/{name}-{uuid.uuid4().hex}"


def job1_triage_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job1_triage_cohort")
    for _ in range(2):
        back = triage_cohort.run(spark, f"{sf_dir}/lineitem.parquet", out, {"view": _VIEW, "loci": [*DEFAULT_LOCI, *EXTENDED]})
    return back.selectExpr("* except (posterior, gap)", "round(posterior, 6) as posterior", "round(gap, 6) as gap")


def job2_screen_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job2_screen_reads")
    for _ in range(2):
        # A glob, as the table may be one file and a stream's folder may not be.
        back = screen_reads.run(spark, f"{sf_dir}/documents.parque[t]", f"{sf_dir}/benchmark.parquet", out, _SCREEN)
    return back.drop("batch")


JOB1_SQL = (
    genotyping.RUN
    + genotyping.RUN_COPIES
    + """, fl as (select sample_id,count(*) c from t3 where total>=20 and fraction>=0.10 group by 1),
 j as (select gt.*,cn.copies,gp.a1,gp.a2,gp.p,gp.gap,coalesce(fl.c,0)>=2 is_contaminated from gt join cn using (sample_id,locus) join gp using (sample_id,locus) left join fl using (sample_id) where gp.rank=1)
select sample_id,locus,case when copies=0 then '' when copies=1 then allele1 else a1 end allele1,case when copies<=1 then '' else a2 end allele2,
 case when copies=0 then 'VERY_LOW' when p>=0.99 and gap>=0.10 then 'HIGH' when p>=0.90 and gap>=0.05 then 'MEDIUM' when p>=0.50 then 'LOW' else 'VERY_LOW' end confidence,
 round(p,6) posterior,round(gap,6) gap,copies,case when copies=0 then 'no_call' when copies=1 then 'cnv_hemizygous' when kk=1 then 'trivial' else 'optimal' end status,
 reads_explained,total_reads,is_contaminated,p<0.8 or reads_explained<0.5*greatest(total_reads,1) needs_run from j"""
)
_SEEDS = "select distinct id,least(k,reverse(translate(k,'ACGT','TGCA'))) km from (select id,unnest(list_transform(range(1,length(seq)-13), lambda i: substring(seq,i::int,15))) k from {t} where length(seq)>=15) q"
JOB2_SQL = (
    "with a as (select doc_id id," + annotation._DNA + " seq from documents), b as (select item_id id," + annotation._DNA + " seq from benchmark), ka as (" + _SEEDS.format(t="a") + "), kb as (" + _SEEDS.format(t="b") + "),"
    " c as (select ka.id,concat('P*',kb.id) allele,count(*)::int s from ka join kb using (km) group by 1,2 having count(*)>=4),"
    " h as (select *,max(s) over (partition by id) best,row_number() over (partition by id order by s desc,allele) r from c), n as (select *,count(*) filter (where s=best) over (partition by id) top from h)"
    " select lang sample_id,doc_id read_id,'P' locus,allele,s as_score,(case when s<best then 0 when top>1 then 1 else 60 end)::int mapq,r>1 is_secondary from n join documents on doc_id=id"
)

QUERIES = {"job1_triage_cohort": job1_triage_cohort, "job2_screen_reads": job2_screen_reads}
ORACLE_SQL = {"job1_triage_cohort": JOB1_SQL, "job2_screen_reads": JOB2_SQL}

"""The engine's functions for SQL: temporary functions of a session, written in SQL, and a table function for alignments.

    register(spark)
    select parse_allele('HLA-A*02:01N').suffix, truncate_allele(name, 1) from calls
    select id, k.* from reads, lateral kmers(seq, 21) k

Scalar functions and `kmers` are inlined by the optimizer; no Python runs for
them.  `alignment_variants` walks operations in Python, a batch at a time.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: Functions by name: (parameters, result, body).  Later ones use earlier ones.
SCALARS = {
    "reverse_complement": ("s STRING", "STRING", "reverse(translate(s, 'ACGTacgt', 'TGCAtgca'))"),
    "canonical_kmer": ("s STRING", "STRING", "least(s, reverse_complement(s))"),
    "phred_error": ("c STRING", "DOUBLE", "pow(10.0D, -(ascii(c) - 33) / 10.0D)"),
    "parse_allele": (
        "name STRING",
        "STRUCT<locus: STRING, field1: STRING, field2: STRING, field3: STRING, field4: STRING, suffix: STRING>",
        """transform(array(regexp_replace(name, '^HLA-', '')), b ->
             transform(array(if(right(b, 1) in ('N', 'L', 'S', 'C', 'A', 'Q'), named_struct('body', left(b, length(b) - 1), 'suffix', right(b, 1)), named_struct('body', b, 'suffix', ''))), p ->
               transform(array(split(if(instr(p.body, '*') > 0, regexp_replace(p.body, '^[^*]*[*]', ''), regexp_replace(p.body, '^[^0-9]*', '')), ':')), f ->
                 named_struct('locus', if(instr(p.body, '*') > 0, substring_index(p.body, '*', 1), regexp_extract(p.body, '^([^0-9]*)', 1)),
                   'field1', coalesce(get(f, 0), ''), 'field2', coalesce(get(f, 1), ''), 'field3', coalesce(get(f, 2), ''), 'field4', coalesce(get(f, 3), ''), 'suffix', p.suffix))[0])[0])[0]""",
    ),
    "truncate_allele": (
        "name STRING, fields INT",
        "STRING",
        """transform(array(parse_allele(name)), p -> transform(array(filter(slice(array(p.field1, p.field2, p.field3, p.field4), 1, fields), x -> x <> '')), f ->
             if(size(f) = 0, name, concat(p.locus, '*', array_join(f, ':'), p.suffix)))[0])[0]""",
    ),
    "matching_alleles": (
        "c1 STRING, c2 STRING, t1 STRING, t2 STRING, fields INT",
        "INT",
        """transform(array(named_struct('a', if(c1 = '', '', truncate_allele(c1, fields)), 'b', if(c2 = '', '', truncate_allele(c2, fields)), 'c', if(t1 = '', '', truncate_allele(t1, fields)), 'd', if(t2 = '', '', truncate_allele(t2, fields)))), z ->
             case when z.a = '' and z.b = '' then -1 when (z.a = z.c and z.b = z.d) or (z.a = z.d and z.b = z.c) then 2
               when z.a = z.c or z.a = z.d or (z.b <> '' and (z.b = z.c or z.b = z.d)) then 1 else 0 end)[0]""",
    ),
    "alignment_identity": (
        "cigar STRING, nm INT",
        "DOUBLE",
        """transform(array(aggregate(regexp_extract_all(cigar, '([0-9]+)[MID]', 1), 0, (n, x) -> n + cast(x as int))), n -> if(n > 0, cast(n - nm as double) / n, 0.0D))[0]""",
    ),
}
TABLES = {
    "kmers": (
        "seq STRING, k INT",
        "position INT, kmer STRING, canonical STRING",
        """SELECT w.i - 1, w.x, canonical_kmer(w.x) FROM (SELECT s.i, substring(seq, s.i, k) AS x FROM (SELECT explode(if(length(seq) >= k, sequence(1, length(seq) - k + 1), cast(array() as array<int>))) AS i) s) w
           WHERE NOT w.x RLIKE '[^ACGTacgt]'""",
    ),
}

_STEP = re.compile(r"(\d+)([A-Z=])")


@udtf(returnType="position int, ref_base string, alt_base string, kind string", useArrow=True)
class AlignmentVariants:
    """Differences of an alignment (pos0, cigar, query, ref): base changes, insertions and deletions by position on the reference, from 0."""

    def eval(self, pos0: int, cigar: str, query: str, ref: str):
        if None in (pos0, cigar, query, ref):
            return
        q, r = 0, pos0
        for n, op in _STEP.findall(cigar):
            n = int(n)
            if op in "M=X":
                for i in range(n):
                    a, b = ref[r + i : r + i + 1], query[q + i : q + i + 1]
                    if a != b and a in tuple("ACGT") and b in tuple("ACGT"):
                        yield r + i, a, b, "SNP"
            elif op == "I":
                yield r, "-", query[q : q + n] if q + n <= len(query) else "?", "INS"
            elif op == "D":
                yield r, ref[r : r + n] if r + n <= len(ref) else "?", "-", "DEL"
            q += n if op in "M=XIS" else 0
            r += n if op in "M=XDN" else 0


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL, in place of any temporary ones of those names, and returns their names."""
    for name, (parameters, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, (parameters, result, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({result}) RETURN {body}")
    spark.udtf.register("alignment_variants", AlignmentVariants)
    return [*SCALARS, *TABLES, "alignment_variants"]

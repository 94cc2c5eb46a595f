"""Outputs of a run.  Tables are written by Spark; documents of one sample are small and formatted on the driver."""

from __future__ import annotations

import hashlib
import html
import json
import platform
import shutil
from datetime import datetime, timezone
from importlib import metadata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names

STATEMENT = "lociforge {version} ranked allele pairs by the likelihood of aligned reads, with alleles of reference release {release} and reads of assay {assay}."
DISCLAIMER = "Made by software that no regulator has assessed: confirm by an accredited method before any use in care."


def fasta_lines(sequences: DataFrame, name: str = "allele", seq: str = "seq", width: int = 80, prefix: str = "") -> DataFrame:
    """value: one FASTA record a row, sequence lines of `width`; repeated names count once."""
    title = F.when(F.col(name).startswith(prefix), F.col(name)).otherwise(F.concat(F.lit(prefix), F.col(name))) if prefix else F.col(name)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(seq), F.lit(1)), F.lit(width)), lambda i: F.substring(F.col(seq), i, F.lit(width)))
    one = sequences.select(title.alias("_t"), F.col(seq)).groupBy("_t").agg(F.max(seq).alias(seq))
    return one.select(F.concat(F.lit(">"), "_t", F.lit("\n"), F.array_join(cut, "\n")).alias("value"))


def write_fasta(sequences: DataFrame, path: str, **options) -> None:
    fasta_lines(sequences, **options).write.text(path)


# The columns of a types table.
TYPE_COLUMNS = (
    "Locus", "Chromosome", "Allele", "G_Group", "GL_String", "Confidence", "Posterior", "EvidenceScore", "AmbiguityGap", "AmbiguityReason", "ReadsExplained", "TotalReads",
    "KmerCovered", "KmerConcordant", "IsNovel", "Flags",
)


def type_rows(calls: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Two rows a locus, by chromosome, in TYPE_COLUMNS beside the sample; numbers to four digits, G groups empty where none are given."""
    four = lambda c: F.format_string("%.4f", F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    c = calls
    for n in ("allele1", "allele2"):
        c = names.g_group(c, groups, n).drop("perfect").withColumnRenamed("g_group", f"_{n}") if groups is not None else c.withColumn(f"_{n}", F.lit(""))
    pair = F.posexplode(F.array(F.struct(F.col("allele1").alias("a"), F.col("_allele1").alias("g")), F.struct(F.col("allele2").alias("a"), F.col("_allele2").alias("g"))))
    have = lambda n, value, blank: value if n in calls.columns else blank
    return c.select("*", pair.alias("_i", "_p")).select(
        "sample_id", F.concat(F.lit("HLA-"), F.col("locus")).alias("Locus"), (F.col("_i") + 1).alias("Chromosome"), F.col("_p.a").alias("Allele"), F.col("_p.g").alias("G_Group"),
        F.col("gl_string").alias("GL_String"), F.col("confidence").alias("Confidence"), four("posterior").alias("Posterior"), four("evidence").alias("EvidenceScore"), four("gap").alias("AmbiguityGap"),
        have("reason", F.coalesce("reason", F.lit("")) if "reason" in calls.columns else None, F.lit("")).alias("AmbiguityReason"), F.col("reads_explained").alias("ReadsExplained"), F.col("total_reads").alias("TotalReads"),
        have("covered", four("covered") if "covered" in calls.columns else None, F.lit("0.0000")).alias("KmerCovered"), F.col("kmer_ok").alias("KmerConcordant"),
        have("is_novel", F.col("is_novel") if "is_novel" in calls.columns else None, F.lit(False)).alias("IsNovel"),
        have("flags", F.array_join("flags", ";") if "flags" in calls.columns else None, F.col("status")).alias("Flags"),
    )


def lines(rows: DataFrame, columns: tuple[str, ...], order: list[str], head: list[str] | None = None, sep: str = "\t") -> DataFrame:
    """(sample_id, value): a sample's rows as one text, by `order`, below its header; a sample has a few dozen rows."""
    line = F.concat_ws(sep, *[F.col(c).cast("string") for c in columns])
    got = rows.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], line.alias("_l")))).alias("_r"))
    top = "\n".join([*(head or []), sep.join(columns)])
    return got.select("sample_id", F.concat(F.lit(top + "\n"), F.array_join(F.col("_r._l"), "\n")).alias("value"))


def provenance(release: str, commit: str, version: str, assay: str, resolution) -> list[str]:
    """Header lines of a types table."""
    return [f"## Reference release: {release}", f"## Reference commit: {commit}", f"## lociforge: {version}", f"## Assay: {assay}", f"## Resolution: {resolution}"]


def write_samples(texts: DataFrame, path: str) -> None:
    """(sample_id, value) as one text file a sample, in folders sample_id=...; other samples' files stay."""
    texts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample_id").text(path)


def write_types(calls: DataFrame, path: str, head: list[str] | None = None, groups: DataFrame | None = None) -> None:
    """The types table of every sample, tab-separated, below its provenance."""
    write_samples(lines(type_rows(calls, groups), TYPE_COLUMNS, ["Locus", "Chromosome"], head), path)


def call_json(calls: DataFrame, alternatives: DataFrame | None = None) -> DataFrame:
    """(sample_id, json): all loci of a sample with their scores and ranked alternatives."""
    c = calls
    if alternatives is not None:
        alt = alternatives.groupBy("sample_id", "locus").agg(F.array_sort(F.collect_list(F.struct("rank", "a1", "a2", F.round("p", 6).alias("p")))).alias("alternatives"))
        c = c.join(alt, ["sample_id", "locus"], "left")
    body = F.struct(*[F.col(x) for x in c.columns if x not in ("sample_id", "locus")])
    return c.groupBy("sample_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("locus", body.alias("v"))), lambda a, b: F.when(a.locus < b.locus, -1).otherwise(1)))).alias("json"))


def ambiguity_rows(calls: DataFrame, alternatives: DataFrame) -> DataFrame:
    """(sample_id, locus, rank, a1, a2, posterior): the call first, alternatives after it; loci without a call are left out."""
    best = calls.where("allele1 <> ''").select("sample_id", "locus", F.lit(1).cast("long").alias("rank"), F.col("allele1").alias("a1"), F.col("allele2").alias("a2"), "posterior")
    rest = alternatives.join(best.select("sample_id", "locus"), ["sample_id", "locus"], "left_semi").select("sample_id", "locus", "rank", "a1", "a2", F.col("p").alias("posterior"))
    return best.unionByName(rest)


def qc_json(loci: DataFrame, summary: DataFrame) -> DataFrame:
    """(sample_id, json): summary and loci of each sample."""
    l = loci.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.to_json(F.struct(*[c for c in loci.columns if c != "sample_id"])))).alias("loci"))
    s = summary.select("sample_id", F.to_json(F.struct(*[c for c in summary.columns if c != "sample_id"])).alias("summary"))
    return l.join(s, "sample_id").select("sample_id", F.concat(F.lit('{"summary":'), "summary", F.lit(',"loci":['), F.array_join("loci", ","), F.lit("]}")).alias("json"))


def _html(c) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def dashboard(loci: DataFrame, title: str = "Quality") -> DataFrame:
    """(sample_id, value): standalone HTML of each sample's loci."""
    columns = [c for c in loci.columns if c != "sample_id"]
    cell = lambda c: F.concat(F.lit("<td>"), _html(F.coalesce(F.to_json(c) if c in nested else F.col(c).cast("string"), F.lit(""))), F.lit("</td>"))
    nested = {f.name for f in loci.schema if f.dataType.typeName() in ("array", "map", "struct")}
    row = F.concat(F.lit("<tr>"), *[cell(c) for c in columns], F.lit("</tr>"))
    got = loci.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct(F.col("locus").alias("o"), row.alias("r")))).alias("_r"))
    top = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in columns) + "</tr>"
    return got.select("sample_id", F.concat(F.lit(top), F.array_join(F.col("_r.r"), ""), F.lit("</table></body></html>")).alias("value"))


def clinical_text(loci: DataFrame, summary: DataFrame, assay: str = "short", release: str = "unknown", version: str = "1") -> DataFrame:
    """(sample_id, value): the clinical report of each sample as text."""
    line = F.concat(F.lit("HLA-"), F.col("locus"), F.lit(": "), F.col("allele1"), F.lit(" / "), F.col("allele2"), F.lit(" ["), F.col("confidence"), F.lit("]"), F.array_join(F.transform("notes", lambda n: F.concat(F.lit("\n  - "), n)), ""))
    shown = loci.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.when(F.col("reported"), F.struct(F.col("locus").alias("o"), line.alias("l"))))).alias("_r"))
    none = lambda c: F.when(F.col(c) == "", F.lit("none")).otherwise(F.col(c))
    end = STATEMENT.format(version=version, release=release, assay=assay) + "\n" + DISCLAIMER
    parts = [F.lit("CLINICAL TYPING REPORT"), F.concat(F.lit("Overall confidence: "), F.col("overall")), F.lit(""), F.array_join(F.col("_r.l"), "\n"), F.lit(""), F.concat(F.lit("Withheld: "), none("withheld")), F.concat(F.lit("Warnings: "), none("warnings")), F.lit(""), F.lit(end)]
    return summary.join(shown, "sample_id").select("sample_id", F.concat_ws("\n", *parts).alias("value"))


def clinical_json(loci: DataFrame, summary: DataFrame) -> DataFrame:
    """(sample_id, value): summary, reported loci and disclaimer."""
    own = [c for c in loci.columns if c != "sample_id"]
    got = loci.where("reported").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.to_json(F.struct("locus", *[c for c in own if c != "locus"])))).alias("_l"))
    s = summary.join(got, "sample_id", "left")
    head = F.to_json(F.struct(*[c for c in summary.columns if c != "sample_id"]))
    return s.select("sample_id", F.concat(F.lit('{"summary":'), head, F.lit(',"loci":['), F.coalesce(F.array_join("_l", ","), F.lit("")), F.lit('],"disclaimer":' + json.dumps(DISCLAIMER) + "}")).alias("value"))


def novel_json(annotated: DataFrame) -> DataFrame:
    """(sample_id, value): the annotated novel alleles of each sample by locus."""
    body = F.struct(*[c for c in annotated.columns if c not in ("sample_id", "locus")])
    return annotated.groupBy("sample_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("locus", body.alias("v"))), lambda a, b: F.when(a.locus < b.locus, -1).otherwise(1)))).alias("value"))


def summary_text(calls: DataFrame, screened: DataFrame, files: list[str]) -> DataFrame:
    """(sample_id, value): what a run says on the console: calls, novel candidates, flags and files."""
    pad = lambda c, n: F.rpad(c, n, " ")
    line = F.concat_ws(" ", pad(F.concat(F.lit("HLA-"), F.col("locus")), 12), pad(F.col("allele1"), 20), pad(F.col("allele2"), 20), pad(F.col("confidence"), 8), F.coalesce("reason", F.lit("")))
    flag = F.when(F.size("flags") > 0, F.concat(F.lit("  HLA-"), F.col("locus"), F.lit(": "), F.array_join("flags", ", ")))
    got = calls.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct(F.col("locus").alias("o"), line.alias("l")))).alias("_r"), F.array_sort(F.collect_list(flag)).alias("_f"))
    found = screened.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("  HLA-"), F.col("locus"), F.lit(": "), F.array_join("signals", ", "), F.lit(" ("), F.col("confidence"), F.lit(")")))).alias("_n"))
    block = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n\n{title}:\n"), F.array_join(c, "\n"))).otherwise("")
    empty = F.array().cast("array<string>")
    return got.join(found, "sample_id", "left").withColumn("_n", F.coalesce("_n", empty)).select("sample_id", F.concat(F.array_join(F.col("_r.l"), "\n"), block("Novel allele candidates", "_n"), block("Flags", "_f"), F.lit("\n\nOutputs: " + ", ".join(files))).alias("value"))


def versions() -> dict[str, str]:
    """Versions of the packages that a run depends on, and of the programs beside it where they are installed."""
    out = {}
    for p in ("pyspark", "numpy", "pandas", "pyarrow"):
        try:
            out[p] = metadata.version(p)
        except metadata.PackageNotFoundError:
            out[p] = "not installed"
    for tool in ("java", "samtools", "minimap2"):
        out[tool] = "installed" if shutil.which(tool) else "not installed"
    return out


def manifest(config, release: str, packages: dict[str, str] | None = None) -> str:
    return json.dumps({"created": datetime.now(timezone.utc).isoformat(), "platform": platform.platform(), "python": platform.python_version(), "release": release, "config": str(config), "packages": packages or versions()}, sort_keys=True)


def lockfile(counts: DataFrame, release: str, commit: str, allele_list: bytes) -> str:
    """Lock of a reference: alleles by locus (one row a locus), their sum, and the list's SHA-256."""
    n = {r["locus"]: r["n"] for r in counts.collect()}
    return json.dumps({"release": release, "git_commit": commit, "counts": n, "total": sum(n.values()), "sha256": hashlib.sha256(allele_list).hexdigest()}, sort_keys=True)


def verify_lock(lock: str, release: str, commit: str = "") -> bool:
    """Equal releases; commits are compared if both are known."""
    found = json.loads(lock)
    return found["release"] == release and (not found["git_commit"] or not commit or found["git_commit"] == commit)


def benchmark_json(overall: dict, loci: list[dict], discordant: DataFrame, most: int = 100) -> str:
    """Benchmark report; its list of discordant calls is cut at `most`, as its format has it."""
    rows = [r.asDict() for r in discordant.orderBy("sample_id", "locus").limit(most).collect()]
    return json.dumps({"overall": overall, "loci": loci, "discordant": rows}, default=str, sort_keys=True)

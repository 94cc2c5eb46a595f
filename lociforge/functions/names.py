"""Allele names as column expressions; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CLASS_I, CLASS_II, FREQUENCIES, FREQUENCY_FLOOR, MAX_FIELDS

SUFFIXES = "NLSCAQ"


def strip_prefix(name: Column) -> Column:
    return F.regexp_replace(name, "^HLA-", "")


def parse(name: Column) -> Column:
    """struct<locus, field1..field4, suffix>.

    A trailing expression letter is the suffix, even where it is the whole
    name; the locus ends at '*', or before the first digit; fields beyond the
    fourth are ignored.
    """
    def fields(body: Column, suffix: Column) -> Column:
        star = F.instr(body, "*") > 0
        locus = F.when(star, F.substring_index(body, "*", 1)).otherwise(F.regexp_extract(body, "^([^0-9]*)", 1))
        rest = F.when(star, F.regexp_replace(body, "^[^*]*[*]", "")).otherwise(F.regexp_replace(body, "^[^0-9]*", ""))
        part = lambda x, i: F.coalesce(F.get(x, F.lit(i)), F.lit("")).alias(f"field{i + 1}")
        return let(F.split(rest, ":"), lambda x: F.struct(locus.alias("locus"), *[part(x, i) for i in range(4)], suffix.alias("suffix")))

    def split(bare: Column) -> Column:
        has = F.right(bare, F.lit(1)).isin(*SUFFIXES)
        suffix = F.when(has, F.right(bare, F.lit(1))).otherwise(F.lit(""))
        return let(F.when(has, F.left(bare, F.length(bare) - 1)).otherwise(bare), lambda body: fields(body, suffix))

    return let(strip_prefix(name), split)


def let(value: Column, then) -> Column:
    """then(value) with value bound once, which keeps the generated code small."""
    return F.transform(F.array(value), then)[0]


def two_digit(p: Column) -> Column:
    return F.concat(p.locus, F.lit("*"), p.field1)


def four_digit(p: Column) -> Column:
    return F.when(p.field2 == "", two_digit(p)).otherwise(F.concat(p.locus, F.lit("*"), p.field1, F.lit(":"), p.field2))


def full_name(p: Column) -> Column:
    """Locus and fields up to the first empty one, then the suffix."""
    out, going = F.concat(p.locus, F.lit("*"), p.field1), F.lit(True)
    for f in ("field2", "field3", "field4"):
        going = going & (p[f] != "")
        out = F.concat(out, F.when(going, F.concat(F.lit(":"), p[f])).otherwise(F.lit("")))
    return F.concat(out, p.suffix)


def truncate(name: Column, fields: Column | int) -> Column:
    """The name cut to its first fields, suffix kept, prefix dropped; a name without fields as it is."""
    return let(F.struct(name.alias("name"), parse(name).alias("p")), lambda x: truncated(x["name"], x.p, fields))


def truncated(name: Column, p: Column, fields: Column | int) -> Column:
    """truncate of a name whose parts are at hand."""
    n = F.lit(fields) if isinstance(fields, int) else fields
    kept = F.filter(F.slice(F.array(p.field1, p.field2, p.field3, p.field4), F.lit(1), n), lambda x: x != "")
    return let(kept, lambda k: F.when(F.size(k) == 0, name).otherwise(F.concat(p.locus, F.lit("*"), F.array_join(k, ":"), p.suffix)))


def max_fields(locus: Column, assay: str) -> Column:
    """Fields that the assay resolves at the locus, 2 where nothing is registered."""
    one, two = MAX_FIELDS.get(assay, (2, 2))
    return F.when(locus.isin(*CLASS_I), F.lit(one)).when(locus.isin(*CLASS_II), F.lit(two)).otherwise(F.lit(2))


def gl_string(a: Column, b: Column) -> Column:
    return F.concat(F.lit("HLA-"), a, F.lit("+HLA-"), b)


def same_to_two_fields(a: Column, b: Column) -> Column:
    p, q = parse(a), parse(b)
    return (p.locus == q.locus) & (p.field1 == q.field1) & (p.field2 == q.field2)


def frequency(names: DataFrame, table: DataFrame | None = None, column: str = "name") -> DataFrame:
    """names with `frequency`: that of the name, the name without prefix, its four-digit, its two-digit form, or the floor.

    table(allele, freq): by default the built-in table, whose size is fixed.
    """
    spark = names.sparkSession
    t = table if table is not None else spark.createDataFrame(list(FREQUENCIES.items()), "allele string, freq double")
    t = F.broadcast(t) if table is None else t
    p = parse(F.col(column))
    out = names
    for i, k in enumerate((F.col(column), strip_prefix(F.col(column)), four_digit(p), two_digit(p))):
        out = out.withColumn(f"_k{i}", k).join(t.select(F.col("allele").alias(f"_a{i}"), F.col("freq").alias(f"_f{i}")), F.col(f"_k{i}") == F.col(f"_a{i}"), "left")
    return out.select(*names.columns, F.coalesce(*[F.col(f"_f{i}") for i in range(4)], F.lit(FREQUENCY_FLOOR)).alias("frequency"))


def g_group(names: DataFrame, groups: DataFrame, column: str = "name") -> DataFrame:
    """names with `g_group` and `perfect`: the group of the name, else of its longest registered prefix, else the name itself."""
    p = parse(F.col(column))
    fields = F.filter(F.array(p.field1, p.field2, p.field3, p.field4), lambda x: x != "")
    n = F.size(fields)
    prefix = F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda i: F.struct(i.alias("n"), F.concat(p.locus, F.lit("*"), F.array_join(F.slice(fields, F.lit(1), i), ":")).alias("k")))
    exact = F.array(F.struct(F.lit(9).alias("n"), strip_prefix(F.col(column)).alias("k")))
    keys = names.select(column).distinct().select(column, F.explode(F.concat(exact, F.when(n > 0, prefix).otherwise(F.slice(exact, 1, 0)))).alias("e"))
    hit = keys.join(groups.select(F.col("allele").alias("_a"), F.col("g_group").alias("_g")), F.col("e.k") == F.col("_a")).groupBy(column).agg(F.max_by("_g", "e.n").alias("g_group"), F.max("e.n").alias("_n"))
    out = names.join(hit.withColumnRenamed(column, "_name"), F.col(column) == F.col("_name"), "left")
    return out.select(*names.columns, F.coalesce("g_group", F.col(column)).alias("g_group"), F.coalesce(F.col("_n") == 9, F.lit(False)).alias("perfect"))

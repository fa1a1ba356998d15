"""Rules for submitted id lists, one finding a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .classes import Classes

EXAMPLES = 5


def check_header(first: str | None, expected: tuple[str, str]) -> str | None:
    """What is wrong with a file's first line, or None."""
    if first is None or first == "":
        return "the file is empty"
    if "\t" not in first and "," in first:
        return "the header has commas but no tab; lists must be tab-separated"
    found = tuple(c.strip().lower() for c in first.split("\t"))
    return None if found == expected else f"unexpected header {list(found)}, expected {list(expected)}"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def check_file(spark: SparkSession, path: str, expected: tuple[str, str]) -> str | None:
    """What keeps a file from being read as id lists, or None."""
    if not exists(spark, path):
        return f"file not found: {path}"
    first = spark.read.text(path).limit(1).collect()
    fault = check_header(first[0][0] if first else None, expected)
    return f"{path}: {fault}" if fault else None


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) after the header. Line numbers need the file's order: one numbering per
    input file, made from the places of its partitions."""
    from .numbering import numbered

    return numbered(spark.read.text(path), "line_no").where("line_no > 1")


def parse(lines: DataFrame) -> DataFrame:
    """(line_no, s1_id, ids, tab): ids untrimmed, empty if the list is blank. Other columns stay."""
    tab = F.instr("value", "\t")
    rest = F.expr("substring(value, instr(value, '\t') + 1)")
    ids = F.when(F.trim(rest) == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(rest, ","))
    return lines.select("line_no", F.when(tab > 0, F.substring_index("value", "\t", 1)).alias("s1_id"), ids.alias("ids"), (tab > 0).alias("tab"), *(c for c in lines.columns if c != "line_no"))


def _strangers(rows: DataFrame, shared: DataFrame, candidates: Classes) -> DataFrame:
    """(s1_id, tid) of rows (s1_id, list) that are no candidates. A list that lies in a class of its
    row is settled by their sizes; the others are gone through id by id."""
    size = shared.groupBy("list").agg(F.count("*").alias("n"))
    inside = shared.join(candidates.targets, "tid").groupBy("list", "class").agg(F.count("*").alias("n")).join(size, ["list", "n"]).select("list", "class")
    settled = rows.join(candidates.s1, "s1_id").join(inside, ["list", "class"], "left_semi").select("s1_id", "list")
    open_ = rows.join(settled, ["s1_id", "list"], "left_anti").join(shared, "list").select("s1_id", "tid").distinct()
    return candidates.mark(open_).where("not linked").select("s1_id", "tid")


def findings(rows: DataFrame, required: DataFrame, valid: DataFrame | None = None, candidates: DataFrame | Classes | None = None, shared: DataFrame | None = None) -> DataFrame:
    """(rule, n, examples): offenders of each rule that has any, with the five least.

    rows: from parse(). required: (s1_id). valid: (tid) known ids. candidates: (s1_id, tid) that
    matches should be among (a warning), or classes. shared: (list, tid) without repeats, ids that a
    row has besides its own, once each, for all lists named in its column lists: what many rows share
    is looked through once, not for each of them.
    """
    good = rows.where("tab")
    bad = rows.where("not tab and trim(value) <> ''").select(F.lit("malformed_row").alias("rule"), F.concat(F.lit("line "), "line_no").alias("offender"))
    again = good.groupBy("s1_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_row").alias("rule"), F.col("s1_id").alias("offender"))
    twice = good.where(F.size("ids") != F.size(F.array_distinct("ids"))).select("s1_id")
    ids = good.select("s1_id", F.explode("ids").alias("tid")).distinct()
    distinct = ids.select("tid")
    if shared is not None:
        both = good.select("s1_id", F.explode("lists").alias("list"), F.array_distinct("ids").alias("ids"))
        twice = twice.union(both.select("s1_id", "list", F.explode("ids").alias("tid")).join(shared, ["list", "tid"], "left_semi").select("s1_id"))
        both = both.select("s1_id", "list").distinct()
        distinct = distinct.union(shared.join(both.select("list").distinct(), "list", "left_semi").select("tid"))
    twice, distinct = twice.select(F.lit("duplicate_in_list"), "s1_id").distinct(), distinct.distinct()
    own = distinct.where(F.col("tid").startswith("S1-")).select(F.lit("self_match"), "tid")
    wrong = distinct.where("not (tid like 'S1-%' or tid like 'S2-%' or tid like 'S3-%')").select(F.lit("wrong_prefix"), "tid")
    out = bad.union(again).union(twice).union(own).union(wrong)
    seen = good.select("s1_id").distinct()
    out = out.union(required.join(seen, "s1_id", "left_anti").select(F.lit("missing_row"), "s1_id")).union(seen.join(required, "s1_id", "left_anti").select(F.lit("unexpected_row"), "s1_id"))
    if valid is not None:
        out = out.union(distinct.where("tid like 'S2-%' or tid like 'S3-%'").join(valid, "tid", "left_anti").select(F.lit("unknown_id"), "tid"))
    if isinstance(candidates, Classes):
        strange = candidates.mark(ids).where("not linked").select("s1_id", "tid")
        strange = strange if shared is None else strange.union(_strangers(both, shared, candidates))
    elif candidates is not None:
        listed = ids if shared is None else ids.union(both.join(shared, "list").select("s1_id", "tid")).distinct()
        strange = listed.join(candidates, ["s1_id", "tid"], "left_anti")
    if candidates is not None:
        out = out.union(strange.select(F.lit("match_not_candidate"), "s1_id").distinct())
    place = F.row_number().over(Window.partitionBy("rule").orderBy("offender"))
    some = out.withColumn("place", place).where(F.col("place") <= EXAMPLES).groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("offender")), ",").alias("examples"))
    return out.groupBy("rule").agg(F.count("*").alias("n")).join(some, "rule")


WARNINGS = ("match_not_candidate",)


def passed(found: DataFrame) -> bool:
    return found.where(~F.col("rule").isin(*WARNINGS)).isEmpty()

"""Checks of result files: each check is a row with its severity, how often it fails and the first examples."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tsv import scan_ids, scan_lines, scan_targets

REPORT = "file string, check string, severity string, n bigint, examples string"
HEADERS = {"matching": ("source1_entity_id", "matched_entity_ids"), "candidates": ("source1_entity_id", "candidate_entity_ids")}
EXAMPLES = 5
#: Checks after which a file has no rows to count.
UNREAD = ("missing file", "candidate file missing", "comma-separated")


def examples(df: DataFrame, column: str, name: str, severity: str, file: str) -> DataFrame:
    """One report row: how many distinct values, and the smallest few of them."""
    values = df.select(F.col(column).cast("string").alias("v")).distinct()
    first = values.orderBy("v").limit(EXAMPLES).agg(F.concat_ws(", ", F.array_sort(F.collect_list("v"))).alias("examples"))
    return values.agg(F.count("*").alias("n")).crossJoin(F.broadcast(first)).select(F.lit(file).alias("file"), F.lit(name).alias("check"), F.lit(severity).alias("severity"), "n", "examples")


def split_rows(lines: DataFrame) -> DataFrame:
    """(line, value, entity_id, ids, has_tab) of the lines behind the header, parted at the first tab."""
    tab = F.instr("value", "\t")
    rows = lines.filter("line > 1")
    return rows.select("line", "value", F.when(tab > 0, F.trim(F.substring_index("value", "\t", 1))).alias("entity_id"), F.when(tab > 0, F.expr("substring(value, instr(value, '\t') + 1)")).alias("ids"), (tab > 0).alias("has_tab"))


def list_counts(rows: DataFrame) -> DataFrame:
    """(rows, empty, filled) of a file's rows with a tab: how many there are, and how many lists are empty and not."""
    blank = F.trim(F.regexp_replace("ids", "[\r\n]+$", "")) == ""
    one = rows.filter("has_tab").select(blank.cast("bigint").alias("blank"))
    return one.agg(F.count("*").alias("rows"), F.coalesce(F.sum("blank"), F.lit(0)).alias("empty"), F.coalesce(F.sum(1 - F.col("blank")), F.lit(0)).alias("filled"))


def listed(rows: DataFrame) -> DataFrame:
    """(line, entity_id, id) for each element of the lists; elements aren't trimmed."""
    return rows.filter("has_tab and trim(ids) <> ''").select("line", "entity_id", F.explode(F.split(F.regexp_replace("ids", "[\r\n]+$", ""), ",")).alias("id"))


def duplicate_rows(rows: DataFrame) -> DataFrame:
    return rows.filter("has_tab").groupBy("entity_id").count().filter("count > 1").select("entity_id", "count")


def duplicate_ids(items: DataFrame) -> DataFrame:
    """Rows whose list names an id twice."""
    return items.groupBy("line", "entity_id", "id").count().filter("count > 1").select("line", "entity_id").distinct()


def prefix_kind(id_: Column) -> Column:
    """What an id in a list is: a target, the reference source itself, or neither."""
    return F.when(id_.startswith("S2-") | id_.startswith("S3-"), "ok").when(id_.startswith("S1-"), "self").otherwise("prefix")


def coverage(rows: DataFrame, required: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Required ids without a row, and rows of no required id."""
    seen = rows.filter("has_tab").select("entity_id").distinct()
    return required.join(seen, "entity_id", "left_anti"), seen.join(required, "entity_id", "left_anti")


def _header(lines: DataFrame, name: str, exact: bool) -> str:
    """ok, csv or wrong."""
    first = (lines.filter("line = 1").first() or {"value": ""})["value"].lstrip("﻿")
    want = "\t".join(HEADERS[name])
    if not exact and "," in first and "\t" not in first:
        return "csv"
    fold = (lambda s: s) if exact else (lambda s: [x.strip().lower() for x in s.split("\t")])
    return "ok" if fold(first.rstrip("\r\n")) == fold(want) else "wrong"


def check_file(spark: SparkSession, path: str, name: str, required: DataFrame, valid: DataFrame | None = None, *, exact_header: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(report, pairs) of one file of lists; pairs (entity_id_s1, entity_id_s2s3) of each id's last row, None if it can't be read."""
    empty = spark.createDataFrame([], REPORT)
    problem = lambda check: spark.createDataFrame([(name, check, "error", 1, path)], REPORT)
    try:
        lines = scan_lines(spark, path)
        head = _header(lines, name, exact_header)
    except AnalysisException:
        return problem("missing file"), None
    if head == "csv":
        return problem("comma-separated"), None
    broken = lines.filter(~F.is_valid_utf8("value"))
    if broken.limit(1).count():
        return examples(broken, "line", "not UTF-8", "error", name), None
    rows = split_rows(lines)
    items = listed(rows)
    kinds = items.withColumn("kind", prefix_kind(F.col("id")))
    missing, extra = coverage(rows, required)
    parts = [
        examples(rows.filter("not has_tab and trim(value) <> ''"), "line", "malformed row", "error", name),
        examples(duplicate_rows(rows), "entity_id", "duplicate row", "error", name),
        examples(duplicate_ids(items), "entity_id", "duplicate id in list", "error", name),
        examples(kinds.filter("kind = 'self'"), "id", "id of the reference source", "error", name),
        examples(kinds.filter("kind = 'prefix'"), "id", "wrong prefix", "error", name),
        examples(missing, "entity_id", "missing entity", "error", name),
        examples(extra, "entity_id", "unexpected entity", "error", name),
    ]
    if valid is not None:
        known = valid.select(F.col("entity_id").alias("id"))
        parts.append(examples(kinds.filter("kind = 'ok'").join(known, "id", "left_anti"), "id", "unknown id", "error", name))
    report = reduce(DataFrame.unionByName, parts, empty if head == "ok" else problem("wrong header")).filter("n > 0")
    last = rows.filter("has_tab").groupBy("entity_id").agg(F.max("line").alias("line"))
    pairs = items.join(last, ["entity_id", "line"], "left_semi").select(F.col("entity_id").alias("entity_id_s1"), F.col("id").alias("entity_id_s2s3")).distinct()
    return report, pairs


def validate(spark: SparkSession, matching: str, candidates: str | None, test_s1: str, targets: list[str] | None = None, *, check_ids: bool = False) -> DataFrame:
    """All checks of both files. The candidate file is optional, and matches outside it only warn."""
    required = scan_ids(spark, test_s1)
    valid, warnings = None, []
    warn = lambda check, n, what: spark.createDataFrame([("matching", check, "warning", n, what)], REPORT)
    if check_ids:
        valid = scan_targets(spark, targets or [])
        if valid is None:
            warnings.append(warn("ids not checked: target file missing", 1, ", ".join(targets or [])))
    report, matched = check_file(spark, matching, "matching", required, valid)
    if candidates is None:
        return reduce(DataFrame.unionByName, warnings, report)
    more, offered = check_file(spark, candidates, "candidates", required, valid)
    if offered is None and more.filter("check = 'missing file'").count():
        return reduce(DataFrame.unionByName, [*warnings, warn("candidate file missing", 1, candidates)], report)
    report = report.unionByName(more)
    if matched is not None and offered is not None:
        outside = matched.join(offered, ["entity_id_s1", "entity_id_s2s3"], "left_anti")
        warnings.append(examples(outside, "entity_id_s1", "match is no candidate", "warning", "matching").filter("n > 0"))
    return reduce(DataFrame.unionByName, warnings, report)


def validate_quick(spark: SparkSession, matching: str, test_s1: str) -> DataFrame:
    """The short check: exact header, no look at whether ids exist, every bad id counted."""
    report, _ = check_file(spark, matching, "matching", scan_ids(spark, test_s1), exact_header=True)
    return report


def main(argv: list[str] | None = None) -> int:
    """Command line: 0 if no check fails."""
    import argparse

    parser = argparse.ArgumentParser(description="Check result files.")
    parser.add_argument("matching")
    parser.add_argument("--candidates")
    parser.add_argument("--test-s1", required=True)
    parser.add_argument("--targets", nargs="*", default=[])
    parser.add_argument("--check-ids", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("validate").getOrCreate()
    try:
        rows = validate(spark, args.matching, args.candidates, args.test_s1, args.targets, check_ids=args.check_ids).collect()
        for path in filter(None, (args.matching, args.candidates)):
            if not any(r["check"] in UNREAD and r["examples"] == path for r in rows):
                n = list_counts(split_rows(scan_lines(spark, path))).first()
                print(f"{path}: {n['rows']} rows, {n['filled']} with and {n['empty']} without ids")
    except PySparkException as e:  # a file that is missing or can't be read
        print(f"error: {str(e).splitlines()[0]}")
        print("FAIL")
        return 1
    for r in rows:
        print(f"{r['severity']}: {r['file']}: {r['check']}: {r['n']} ({r['examples']})")
    failed = any(r["severity"] == "error" for r in rows)
    print("FAIL" if failed else "PASS")
    return int(failed)


if __name__ == "__main__":
    raise SystemExit(main())

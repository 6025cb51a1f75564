"""python -m tonegrid COMMAND PATH: findings of all audio files under a path, and an exit code.

analyze writes findings; inspect what the files are; validate checks the profile PATH; compliance their distance from delivery targets;
compare the changes from PATH to --other, file by file; freeze and verify golden findings in --golden; calibrate their tolerances;
audit the problems of log files, or with --segments of the log PATH that audit --append adds to. Files are matched by name without suffix.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.operators import calibration, comparison, kernels, policy
from tonegrid.operators.analysis import analyze, known_parameters, load_plugin, release
from tonegrid.operators.audit import append, read_logs, read_segments, verify_logs
from tonegrid.sources import sinks
from tonegrid.sources.audio import audio_headers, scan_audio
from tonegrid.sources.profiles import ProfileError, load_profile
from tonegrid.sources.wav import subjects

OK, FINDING, USAGE = 0, 1, 2
GOLDEN = ("file_id", "analyzer", "metric", "value", "status")


def by_name(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("file_id", F.regexp_extract("source_path", r"([^/]+)\.[^./]*$", 1))


def against(args: argparse.Namespace, spark: SparkSession, findings: Callable[[str], DataFrame]) -> int:
    """Two sides, or one side and its golden findings."""
    mine = findings(args.path)
    if args.command == "freeze":
        sinks.write_json(mine, args.golden)
        return OK
    if args.command == "compare":
        other = findings(args.other)
        comparison.comparison(mine, other, "file_id").write.json(args.output)
        return FINDING if spark.read.json(args.output).where("regression").limit(1).count() else OK
    golden = spark.read.json(args.golden).select(*GOLDEN)
    side = lambda df: df.select(F.col("file_id").alias("fixture"), *GOLDEN[1:])
    comparison.golden_diff(side(golden), side(mine), F.lit(args.tolerance)).write.json(args.output)
    return FINDING if spark.read.schema("kind string").json(args.output).limit(1).count() else OK


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser("tonegrid")
    parser.add_argument("command", choices=("analyze", "inspect", "validate", "compliance", "compare", "freeze", "verify", "calibrate", "audit"))
    parser.add_argument("path")
    parser.add_argument("--profile", default="default")
    parser.add_argument("--strict", action="store_true")
    parser.add_argument("--only", type=lambda s: tuple(s.split(",")))
    parser.add_argument("--skip", type=lambda s: tuple(s.split(",")), default=())
    parser.add_argument("--format", choices=("json", "csv", "sarif", "html", "bundle"), default="json")
    parser.add_argument("--other", help="the side to compare with")
    parser.add_argument("--golden", help="the folder of golden findings")
    parser.add_argument("--tolerance", type=float, default=0.01)
    parser.add_argument("--plugin", action="append", default=[], help="a Python file that registers analyzers")
    parser.add_argument("--resample", type=int, help="a sample rate that all files are brought to; bundles tell what they had")
    parser.add_argument("--append", type=json.loads, help="an entry for the log PATH: JSON with actor, action, subject and details")
    parser.add_argument("--segments", action="store_true", help="PATH is a log that is appended to")
    parser.add_argument("--output", help="a folder, on any file system that Spark writes")
    args = parser.parse_args(argv)
    for plugin in args.plugin:
        load_plugin(plugin)
    if args.command == "validate":
        try:
            load_profile(args.path, args.strict, known_parameters())
        except ProfileError as error:
            print(error, file=sys.stderr)
            return USAGE
        return OK
    if args.append is not None:
        append(spark or SparkSession.builder.appName("tonegrid").getOrCreate(), args.path, [args.append])
        return OK
    if not args.output and args.command != "freeze":
        parser.error("--output is needed")
    spark = spark or SparkSession.builder.appName("tonegrid").getOrCreate()
    if args.command == "audit":
        verify_logs((read_segments if args.segments else read_logs)(spark, args.path)).write.json(args.output)
        return FINDING if spark.read.schema("log string, line long, problem string").json(args.output).limit(1).count() else OK
    if args.command == "inspect":
        audio_headers(spark, args.path).write.json(args.output)
        return OK
    options = {"resample": args.resample} if args.resample else {}
    chunks = scan_audio(spark, args.path, **options)
    if args.command == "compliance":
        good = chunks.where("error IS NULL")
        measured = kernels.integrated_loudness(kernels.block_loudness(good)).join(kernels.true_peak(good), "file_id")
        policy.compliance(measured).write.json(args.output)
        return FINDING if spark.read.json(args.output).where("overall = 'fail'").limit(1).count() else OK
    try:
        profile = load_profile(args.profile, args.strict, known_parameters())
    except ProfileError as error:
        print(error, file=sys.stderr)
        return USAGE
    if args.command == "calibrate":
        asked = {a: profile["analyzers"].get(a, {}) for a in comparison.COMPARED if args.only is None or a in args.only}
        calibration.calibrated(chunks, profile | {"analyzers": asked}).write.json(args.output)
        release()
        return OK
    if args.command in ("compare", "freeze", "verify"):
        # always the same analyzers, and what they say as it is: no policy raises it
        fixed = profile | {"analyzers": {a: profile["analyzers"].get(a, {}) for a in comparison.COMPARED}, "strict_overlay": {}}
        done = against(args, spark, lambda path: analyze(by_name(scan_audio(spark, path, **options)).persist(StorageLevel.DISK_ONLY), fixed, args.only, args.skip))
        release()
        return done
    # every analyzer reads the chunks: decoded once, recomputed where an executor is lost
    chunks = chunks.persist(StorageLevel.DISK_ONLY)
    findings = analyze(chunks, profile, args.only, args.skip).persist()
    if args.format == "csv":
        sinks.write_csv(findings, args.output)
    elif args.format == "json":
        sinks.write_json(findings, args.output)
    elif args.format == "bundle":
        heads = audio_headers(spark, args.path).select("source_path", "file_sha256", F.struct(F.col("sample_rate").alias("sample_rate_hz"), "frames", F.lit(args.resample).cast("int").alias("resampled_to_hz")).alias("provenance"))
        files = subjects(chunks).drop("file_sha256").join(heads, "source_path")
        sinks.bundle_documents(findings, files, profile).select("bundle").write.text(args.output)
    else:
        documents = sinks.sarif_documents(findings) if args.format == "sarif" else sinks.html_documents(findings)
        documents.select(F.col(args.format)).write.text(args.output)
    bad = findings.where(F.col("status").isin("fail", "error")).limit(1).count()
    findings.unpersist()
    release()
    chunks.unpersist()
    return FINDING if bad else OK


if __name__ == "__main__":
    sys.exit(main())

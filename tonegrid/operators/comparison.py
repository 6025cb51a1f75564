"""Comparison of findings: two sides, golden values, tolerances, detector scores, frozen documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.operators.policy import RULES, literal_map

#: Statuses that flag a rule; analyzers whose rules can regress, and those that are only observed; metrics with deltas.
FLAGGED = ("warning", "fail", "needs_review")
OBJECTIVE = ("loudness", "true_peak", "clipping", "glitch", "loop", "mono_compat", "channel_balance")
OBSERVED = ("spectral_health", "lra", "timbre_distance", "harmonic_tension", "spectral_irregularity", "inharmonicity", "fatigue_index", "rhythmic_grid_alignment", "melodic_contour")
DELTAS = {"loudness": "integrated_loudness", "true_peak": "true_peak", "lra": "loudness_range", "mono_compat": "max_band_loss"}
COMPARED = OBJECTIVE + OBSERVED


def rule_of() -> Column:
    """The rule of a finding by its analyzer and metric; null for one without a rule."""
    return F.try_element_at(literal_map({f"{a}\x1f{m}": r for a, by in RULES.items() for m, r in by.items()}), F.concat_ws("\x1f", "analyzer", "metric"))


def metric_deltas(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """b less a for every metric that both sides have."""
    on = [*keys, "analyzer", "metric"]
    joined = a.select(*on, F.col("value").alias("value_a")).join(b.select(*on, F.col("value").alias("value_b")), on)
    return joined.withColumn("delta", F.round(F.col("value_b") - F.col("value_a"), 6))


def flag_changes(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """(keys, only_in_a, only_in_b, unchanged, regression): flagged rules of two sides as sets, joined in order.

    Only rules of objective analyzers count, and only warnings, failures and reviews flag one: a side whose analyzer
    broke off has no flag of it, and what descriptors say is no regression.
    """
    def flags(side: DataFrame, name: str) -> DataFrame:
        flagged = F.when(F.col("status").isin(*FLAGGED) & F.col("analyzer").isin(*OBJECTIVE), rule_of())
        return side.groupBy(*keys).agg(F.array_sort(F.collect_set(flagged)).alias(name))

    both = flags(a, "a").join(flags(b, "b"), list(keys), "full_outer")
    none = F.array().cast("array<string>")
    both = both.withColumns({"a": F.coalesce("a", none), "b": F.coalesce("b", none)})
    joined = lambda x: F.array_join(F.array_sort(x), ",")
    return both.select(
        *keys, joined(F.array_except("a", "b")).alias("only_in_a"), joined(F.array_except("b", "a")).alias("only_in_b"),
        joined(F.array_intersect("a", "b")).alias("unchanged"), (F.size(F.array_except("b", "a")) > 0).alias("regression"),
    )


def observations(side: DataFrame, *keys: str) -> DataFrame:
    """(keys, observations): what the observed analyzers say, in order of rule and metric; none of it is a regression."""
    said = F.struct(rule_of().alias("rule_id"), "metric", "analyzer", F.round("value", 6).alias("value"), "status")
    return side.where(F.col("analyzer").isin(*OBSERVED)).groupBy(*keys).agg(F.array_sort(F.collect_list(said)).alias("observations"))


def comparison(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """(keys, deltas, only_in_a, only_in_b, unchanged, regression, reasons, observations) of two sides' findings, for each key of either."""
    changes = flag_changes(a, b, *keys)
    asked = F.concat_ws(".", "analyzer", "metric").isin(*[f"{x}.{m}" for x, m in DELTAS.items()])
    deltas = metric_deltas(a.where(asked), b.where(asked), *keys).where("delta IS NOT NULL")
    deltas = deltas.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("metric", "analyzer", "value_a", "value_b", "delta"))).alias("deltas"))
    reasons = F.when(F.col("regression"), F.array(F.concat(F.lit("new objective defects: "), F.replace(F.col("only_in_b"), F.lit(","), F.lit(", "))))).otherwise(F.array().cast("array<string>"))
    return changes.join(deltas, list(keys), "left").join(observations(b, *keys), list(keys), "left").withColumn("reasons", reasons)


def golden_diff(expected: DataFrame, current: DataFrame, tolerance: Column) -> DataFrame:
    """(fixture, analyzer, metric, nth, kind): missing, extra, value_drift, status_change and, where both sides have rule_id, rule_id_change rows.

    A key that is on one side alone, or on both in different numbers (a drift), counts once; else its rows
    are matched in order of value. ``tolerance`` is an expression on the key.
    """
    key = ["fixture", "analyzer", "metric"]
    ruled = "rule_id" in expected.columns and "rule_id" in current.columns

    def numbered(side: DataFrame, s: str) -> DataFrame:
        of_key = Window.partitionBy(*key)
        nth, n = F.row_number().over(of_key.orderBy("value", "status")), F.count(F.lit(1)).over(of_key)
        rule = F.col("rule_id") if ruled else F.lit(None).cast("string")
        return side.select(*key, nth.cast("long").alias("nth"), n.alias(f"n_{s}"), F.col("value").alias(f"value_{s}"), F.col("status").alias(f"status_{s}"), rule.alias(f"rule_{s}"))

    both = numbered(expected, "e").join(numbered(current, "c"), [*key, "nth"], "full_outer")
    of_key = Window.partitionBy(*key)
    both = both.withColumns({"n_e": F.max("n_e").over(of_key), "n_c": F.max("n_c").over(of_key)})
    first, paired = F.col("nth") == 1, F.col("n_e") == F.col("n_c")
    drift = F.coalesce(F.abs(F.col("value_c") - F.col("value_e")) > tolerance, F.col("value_c").isNull() != F.col("value_e").isNull())
    kinds = F.array_compact(F.array(
        F.when(first & F.col("n_c").isNull(), "missing"), F.when(first & F.col("n_e").isNull(), "extra"),
        F.when((first & (F.col("n_e") != F.col("n_c"))) | (paired & drift), "value_drift"),
        F.when(paired & ~F.col("status_c").eqNullSafe(F.col("status_e")), "status_change"), F.when(paired & ~F.col("rule_c").eqNullSafe(F.col("rule_e")), "rule_id_change"),
    ))
    return both.select(*key, "nth", F.explode(kinds).alias("kind"))


def calibrated_tolerance(trials: DataFrame) -> DataFrame:
    """(metric, tolerance) of (fixture, trial, metric, value): twice the largest spread of any fixture, up to whole thousandths."""
    spread = trials.groupBy("metric", "fixture").agg(F.stddev_samp("value").alias("s"))
    return spread.groupBy("metric").agg(F.max("s").alias("s")).select("metric", (F.ceil(F.greatest(2 * F.col("s"), F.lit(1e-4)) * 1000) / 1000).alias("tolerance"))


def detector_scores(cases: DataFrame, *keys: str) -> DataFrame:
    """(keys, tp, fp, fn, precision, recall) of (keys, expected, flagged); null where nothing divides."""
    e, f = F.col("expected"), F.col("flagged")
    counts = cases.groupBy(*keys).agg(F.count_if(e & f).alias("tp"), F.count_if(~e & f).alias("fp"), F.count_if(e & ~f).alias("fn"))
    share = lambda *of: F.round(F.try_divide(F.col("tp").cast("double"), sum((F.col(x) for x in of), F.lit(0)).cast("double")), 4)
    return counts.withColumn("precision", share("tp", "fp")).withColumn("recall", share("tp", "fn"))


def detector_report(scores: DataFrame, key: str) -> DataFrame:
    """(line): a Markdown table of :func:`detector_scores`, head first, n/a where nothing divides."""
    shown = lambda c: F.when(F.col(c).isNull(), "n/a").otherwise(F.format_string("%.2f", F.col(c)))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.col(key), *[F.col(c).cast("string") for c in ("tp", "fp", "fn")], shown("precision"), shown("recall")), F.lit(" |"))
    head = scores.sparkSession.createDataFrame([(0, "", f"| {key} | TP | FP | FN | precision | recall |"), (1, "", "|---|---|---|---|---|---|")], "part int, key string, line string")
    return head.unionByName(scores.select(F.lit(2).alias("part"), F.col(key).cast("string").alias("key"), row.alias("line"))).orderBy("part", "key").select("line")


def oracle_matrix(measured: DataFrame, other: DataFrame, most: float = 0.5) -> DataFrame:
    """(key, delta, verdict) of two (key, value) tables."""
    both = measured.join(other.withColumnRenamed("value", "value_o"), "key")
    delta = F.abs(F.col("value") - F.col("value_o"))
    return both.select("key", F.round(delta, 4).alias("delta"), F.when(delta > most, "needs_investigation").otherwise("consistent").alias("verdict"))


def field_diff(frozen: DataFrame, current: DataFrame, masked: tuple = ()) -> DataFrame:
    """(subject, path, kind) of two (subject, path, value) tables: missing, added and changed fields, masked prefixes left out."""
    both = frozen.withColumnRenamed("value", "f").withColumn("in_f", F.lit(True)).join(
        current.withColumnRenamed("value", "c").withColumn("in_c", F.lit(True)), ["subject", "path"], "full_outer"
    )
    for prefix in masked:
        both = both.where((F.col("path") != prefix) & ~F.col("path").startswith(prefix + "."))
    kind = F.when(F.col("in_c").isNull(), "missing").when(F.col("in_f").isNull(), "added").when(~F.col("f").eqNullSafe(F.col("c")), "changed")
    return both.select("subject", "path", kind.alias("kind")).where("kind IS NOT NULL")

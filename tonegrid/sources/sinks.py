"""Sinks of findings: CSV, JSON lines, SARIF and HTML, one document per file where the format asks for one.

Documents are put together by Spark, by grouping a file's findings; the driver holds none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrid.operators.policy import rank

#: The columns of the CSV form, and the levels of SARIF.
CSV_COLUMNS = ("analyzer", "check_id", "metric", "value", "unit", "status", "time_range_ms_start", "time_range_ms_end", "confidence", "message", "limitations", "method")
LEVELS = {"pass": "none", "warning": "warning", "fail": "error", "not_applicable": "none", "indeterminate": "none", "needs_review": "note", "error": "error"}
SARIF_SCHEMA = "https://docs.oasis-open.org/sarif/sarif/v2.1.0/cs01/schemas/sarif-schema-2.1.0.json"
DEFAULTS = {"check_id": "metric", "unit": None, "confidence": None, "message": None, "method": None}


def completed(findings: DataFrame) -> DataFrame:
    """``findings`` with the optional fields that they lack."""
    have = set(findings.columns)
    out = findings.withColumns({c: F.col(of) if of else F.lit(None).cast("double" if c == "confidence" else "string") for c, of in DEFAULTS.items() if c not in have})
    if "limitations" not in have:
        out = out.withColumn("limitations", F.array().cast("array<string>"))
    return out if "time_range_ms" in have else out.withColumn("time_range_ms", F.lit(None).cast("array<double>"))


def csv_rows(findings: DataFrame) -> DataFrame:
    f = completed(findings)
    at = lambda i: F.get("time_range_ms", F.lit(i))
    return f.withColumns({"time_range_ms_start": at(0), "time_range_ms_end": at(1), "limitations": F.array_join("limitations", "; ")}).select(*CSV_COLUMNS)


def write_csv(findings: DataFrame, path: str) -> None:
    csv_rows(findings).write.option("header", True).option("lineSep", "\r\n").csv(path)


def write_json(findings: DataFrame, path: str) -> None:
    completed(findings).write.option("ignoreNullFields", False).json(path)


def _struct(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def sarif_documents(findings: DataFrame, tool: str = "tonegrid", version: str = "1") -> DataFrame:
    """(file_id, sarif): a SARIF 2.1.0 document per file; of findings of one rule, the first describes it."""
    level = F.coalesce(F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])[F.col("status")], F.lit("none"))
    f = completed(findings).withColumn("rule", F.concat_ws("/", "analyzer", "check_id"))
    rule = _struct(id=F.col("rule"), name=F.col("check_id"), shortDescription=_struct(text=F.substring(F.coalesce("message", F.lit("")), 1, 200)), properties=_struct(analyzer=F.col("analyzer"), method=F.col("method")))
    place = _struct(physicalLocation=_struct(artifactLocation=_struct(uri=F.col("file_id").cast("string"))))
    result = _struct(
        ruleId=F.col("rule"), level=level, message=_struct(text=F.coalesce("message", F.lit(""))), locations=F.array(place),
        properties=_struct(metric=F.col("metric"), value=F.col("value"), unit=F.col("unit"), confidence=F.col("confidence"), limitations=F.col("limitations")),
        partialFingerprints=F.struct(F.concat_ws(":", "analyzer", "check_id", F.col("value").cast("string")).alias("metric/v1")),
    )
    per = f.groupBy("file_id").agg(F.array_sort(F.collect_list(_struct(rule=F.col("rule"), metric=F.col("metric"), described=rule, result=result))).alias("all"))
    rules = F.filter("all", lambda x, i: (i == 0) | (F.element_at("all", F.greatest(i, F.lit(1)))["rule"] != x["rule"]))
    run = _struct(
        tool=_struct(driver=_struct(name=F.lit(tool), version=F.lit(version), rules=F.transform(rules, lambda x: x["described"]))),
        results=F.transform("all", lambda x: x["result"]), invocations=F.array(_struct(executionSuccessful=F.lit(True))),
    )
    head = F.lit(f'{{"$schema":"{SARIF_SCHEMA}","version":"2.1.0","runs":[')
    return per.select("file_id", F.concat(head, F.to_json(run), F.lit("]}")).alias("sarif"))


def _html(text: Column) -> Column:
    for char, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(reference))
    return text


def html_documents(findings: DataFrame) -> DataFrame:
    """(file_id, html): a table per file, every text escaped."""
    f = completed(findings)
    cells = [_html(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("analyzer", "metric")] + [F.when(F.col("value").isNull(), "").otherwise(F.format_string("%.4g", "value")), _html(F.coalesce("unit", F.lit(""))), _html(F.col("status")), _html(F.coalesce("message", F.lit("")))]
    row = F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>"))
    per = f.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("analyzer", "metric", row.alias("row")))).alias("rows"))
    head = "<!DOCTYPE html><html lang=\"en\"><head><meta charset=\"utf-8\"><title>Findings</title></head><body><table><caption>Findings of "
    columns = "</caption><tr><th scope=\"col\">" + "</th><th scope=\"col\">".join(("analyzer", "metric", "value", "unit", "status", "message")) + "</th></tr>"
    body = F.array_join(F.transform("rows", lambda r: r["row"]), "")
    return per.select("file_id", F.concat(F.lit(head), _html(F.col("file_id").cast("string")), F.lit(columns), body, F.lit("</table></body></html>")).alias("html"))


def bundle_documents(findings: DataFrame, files: DataFrame, profile: dict, tool: str = "tonegrid", version: str = "1") -> DataFrame:
    """(file_id, bundle): the evidence of each file as one JSON document, names in order, findings by analyzer, check and time.

    ``files`` are the rows of :func:`tonegrid.sources.wav.subjects`. The fingerprint covers the findings alone,
    so it doesn't change with a file's place.
    """
    f = completed(findings)
    order = [F.col("analyzer"), F.col("check_id"), *[F.coalesce(F.get("time_range_ms", F.lit(i)), F.lit(-1.0)).alias(f"t{i}") for i in (0, 1)]]
    said = sorted(c for c in f.columns if c != "file_id")
    rounded = {c: F.round(c, 6).alias(c) if f.schema[c].dataType.simpleString() == "double" else F.col(c) for c in said}
    per = f.select("file_id", F.struct(*order, F.struct(*rounded.values()).alias("finding")).alias("row")).groupBy("file_id").agg(
        F.transform(F.array_sort(F.collect_list("row"), lambda x, y: F.when(_before(x, y), -1).when(_before(y, x), 1).otherwise(0)), lambda r: r["finding"]).alias("findings"),
        F.coalesce(F.max_by("row.finding.status", rank(F.col("row.finding.status"))), F.lit("pass")).alias("aggregate_status"),
    )
    nulls = {"ignoreNullFields": "false"}
    described = files.select(F.col("file_id").alias("of"), F.struct(*[F.col(c) for c in ("channel_layout", "channels")], F.round("duration_s", 4).alias("duration_s"), *[F.col(c) for c in ("file_sha256", "frames")], *[F.col(c) for c in ("provenance",) if c in files.columns], F.col("sample_rate").alias("sample_rate_hz"), "source_path").alias("subject"))
    settings = _struct(analyzers=F.array(*[F.lit(a) for a in sorted(profile["analyzers"])]), data_classification=F.lit(profile.get("data_classification", "internal")), name=F.lit(profile["name"]), strict=F.lit(bool(profile.get("strict_overlay"))), version=F.lit(str(profile["version"])))
    whole = _struct(
        aggregate_status=F.col("aggregate_status"), findings=F.col("findings"), measurement_fingerprint=F.sha2(F.to_json("findings", nulls), 256), profile=settings,
        schema_version=F.lit("1.0.0"), subject=F.col("subject"), tool=_struct(name=F.lit(tool), version=F.lit(version)),
    )
    return per.join(described, F.col("file_id") == F.col("of")).select("file_id", F.to_json(whole, nulls).alias("bundle"))


def _before(x: Column, y: Column) -> Column:
    """Whether one finding comes before another: by analyzer, check and time."""
    fields = ("analyzer", "check_id", "t0", "t1")
    out = F.lit(False)
    for name in reversed(fields):
        out = (x[name] < y[name]) | ((x[name] == y[name]) & out)
    return out

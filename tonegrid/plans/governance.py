"""Queries of policy, comparison and evidence on findings derived from the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.functions.columns import by_channel, lufs, power_mean
from tonegrid.operators import comparison, evidence, levels, policy
from tonegrid.plans.measurements import CLIP, HOP, LUFS, SIZE, block_sql
from tonegrid.sources.signals import events_signal, table, views

QUERIES: dict = {}
ORACLES: dict = {}

#: Which findings a strict run raises.
OVERLAY = {"clipping": {"clipped_sample_pct": "fail"}, "glitch": {"*": "fail"}, "loudness": {"integrated_loudness": "pass"}, "true_peak": {"true_peak": "fail"}}


def query(name: str, sql: str):
    def add(run):
        QUERIES[name], ORACLES[name] = run, sql
        return run

    return add


def findings(spark, d, half: int | None = None) -> DataFrame:
    """(file_id, analyzer, metric, value, status) of every user's signal, or of one half of its frames.

    Everything is a window or a grouping by channel, so the events are exchanged once, for all five measurements.
    """
    signal = events_signal(spark, d)
    if half is not None:
        signal = signal.where(F.col("frame") % 2 == half).withColumn("frame", F.floor(F.col("frame") / 2))
    x, l, whole, ahead = F.col("x"), F.col("l"), Window.partitionBy("channel"), by_channel().rowsBetween(0, SIZE - 1)
    block = (F.col("frame") % HOP == 0) & (F.count(F.lit(1)).over(ahead) == SIZE)
    near = signal.withColumns({
        "d2": F.lead("x").over(by_channel()) - 2 * x + F.lag("x").over(by_channel()),
        "l": F.when(block, lufs(F.sum(x * x).over(ahead) / SIZE)),
    })
    mean_of = lambda level: 10.0 * F.log10(F.avg(F.pow(F.lit(10.0), level / 10.0)).over(whole))
    judged = near.withColumns({
        "over": F.coalesce(F.abs("d2") > 2.5 * (F.sqrt(F.avg(F.col("d2") * F.col("d2")).over(whole)) + 1e-12), F.lit(False)),
        "gate": mean_of(F.when(l >= -70, l)) - 10, "range_gate": mean_of(F.when(l > -70, l)) - 10,
    })
    judged = judged.withColumn("click", F.col("over") & ~F.coalesce(F.lag("over").over(by_channel()), F.lit(False)))
    heard, ranged, shares = F.when(l >= -70, l), F.when(l > -70, l), F.array(F.lit(0.1), F.lit(0.95))
    inside = F.when(ranged >= F.col("range_gate"), l)
    per = judged.groupBy("channel").agg(
        (100.0 * F.avg((F.abs("x") >= CLIP).cast("double"))).alias("pct"), F.count_if("click").cast("double").alias("clicks"), F.max(F.abs("x")).alias("peak"),
        F.coalesce(power_mean(F.when(heard >= F.col("gate"), l)), power_mean(heard)).alias("lufs"),
        F.count(ranged).alias("n"), F.count(inside).alias("g"), F.percentile(inside, shares).alias("p"), F.percentile(ranged, shares).alias("q"),
    )
    spread = lambda p: F.greatest(F.lit(0.0), p[1] - p[0])
    lra = F.when(F.col("n") >= 4, F.when(F.col("g") < 4, spread(F.col("q"))).otherwise(spread(F.col("p")))).when(F.col("n") > 0, F.lit(0.0))
    warn = lambda bad: F.when(bad, "warning").otherwise("pass")
    peak = F.round(20 * F.log10(F.greatest(F.col("peak") / 400.0, F.lit(1e-12))), 4)
    rows = (
        ("clipping", "clipped_sample_pct", F.col("pct"), F.when(F.col("pct") > 2.0, "fail").otherwise(warn(F.col("pct") > 0))),
        ("glitch", "glitch_event_count", F.col("clicks"), warn(F.col("clicks") > 0)),
        ("loudness", "integrated_loudness", F.col("lufs"), warn(~F.round("lufs", 4).between(33.0, 36.0))),
        ("true_peak", "true_peak", peak, F.when(peak > -6.0, "fail").when(peak > -9.0, "needs_review").otherwise("pass")),
        ("lra", "loudness_range", lra, F.lit("pass")),
    )
    listed = F.array(*[F.struct(F.lit(a).alias("analyzer"), F.lit(m).alias("metric"), F.round(v, 4).alias("value"), status.alias("status")) for a, m, v, status in rows])
    return per.select(F.col("channel").alias("file_id"), F.inline(listed)).where("value IS NOT NULL")


def findings_sql(half: int | None = None, name: str = "fnd") -> str:
    """The same findings as a chain of SQL expressions whose last is ``name``."""
    of = "sig" if half is None else f"(SELECT channel, frame // 2 AS frame, x FROM sig WHERE frame % 2 = {half})"
    p = name
    return f"""{p}_s AS (SELECT * FROM {of}),
{block_sql(f"{p}_s").replace("n AS (", f"{p}_n AS (", 1).replace("b AS (SELECT channel, unnest", f"{p}_b AS (SELECT channel, unnest", 1).replace("FROM n)", f"FROM {p}_n)").replace("blk AS (", f"{p}_blk AS (").replace("FROM b JOIN", f"FROM {p}_b b JOIN")},
{p}_d AS (SELECT channel, frame, lead(x) OVER w - 2 * x + lag(x) OVER w AS d2 FROM {p}_s WINDOW w AS (PARTITION BY channel ORDER BY frame)),
{p}_v AS (SELECT channel, sqrt(avg(d2 * d2)) + 1e-12 AS level FROM {p}_d GROUP BY channel),
{p}_g AS (SELECT channel, frame, frame - row_number() OVER (PARTITION BY channel ORDER BY frame) AS g FROM {p}_d JOIN {p}_v USING (channel) WHERE abs(d2) > 2.5 * level),
{p}_c AS (SELECT channel, count(DISTINCT g) AS n FROM {p}_g GROUP BY channel),
{p}_a AS (SELECT channel, {LUFS} AS l FROM {p}_blk),
{p}_m AS (SELECT channel, 10 * log10(avg(power(10, l / 10))) AS m, count(*) AS n FROM {p}_a WHERE l >= -70 GROUP BY channel),
{p}_l AS (SELECT channel, round(coalesce(10 * log10(avg(power(10, l / 10)) FILTER (WHERE l >= m - 10)), max(m)), 4) AS v FROM {p}_a JOIN {p}_m USING (channel) WHERE l >= -70 GROUP BY channel),
{p}_r AS (SELECT channel, n, count(*) FILTER (WHERE l >= m - 10) AS g, quantile_cont(l, 0.95) FILTER (WHERE l >= m - 10) - quantile_cont(l, 0.1) FILTER (WHERE l >= m - 10) AS p,
         quantile_cont(l, 0.95) - quantile_cont(l, 0.1) AS q FROM {p}_a JOIN {p}_m USING (channel) WHERE l > -70 GROUP BY channel, n),
{p}_k AS (SELECT channel, round(100.0 * count(*) FILTER (WHERE abs(x) >= {CLIP}) / count(*), 4) AS pct, round(20 * log10(greatest(max(abs(x)) / 400.0, 1e-12)), 4) AS peak FROM {p}_s GROUP BY channel),
{name} AS (
  SELECT channel AS file_id, 'clipping' AS analyzer, 'clipped_sample_pct' AS metric, pct AS value, CASE WHEN pct > 2.0 THEN 'fail' WHEN pct > 0 THEN 'warning' ELSE 'pass' END AS status FROM {p}_k
  UNION ALL SELECT {p}_k.channel, 'glitch', 'glitch_event_count', CAST(coalesce(n, 0) AS DOUBLE), CASE WHEN coalesce(n, 0) > 0 THEN 'warning' ELSE 'pass' END FROM {p}_k LEFT JOIN {p}_c ON {p}_k.channel = {p}_c.channel
  UNION ALL SELECT channel, 'loudness', 'integrated_loudness', v, CASE WHEN v BETWEEN 33.0 AND 36.0 THEN 'pass' ELSE 'warning' END FROM {p}_l
  UNION ALL SELECT channel, 'true_peak', 'true_peak', peak, CASE WHEN peak > -6.0 THEN 'fail' WHEN peak > -9.0 THEN 'needs_review' ELSE 'pass' END FROM {p}_k
  UNION ALL SELECT channel, 'lra', 'loudness_range', round(CASE WHEN n < 4 THEN 0 WHEN g < 4 THEN greatest(0, q) ELSE greatest(0, p) END, 4), 'pass' FROM {p}_r)"""


FINDINGS = views("sig") + ",\n" + findings_sql()
HALVES = views("sig") + ",\n" + findings_sql(0, "fa") + ",\n" + findings_sql(1, "fb")
RANK = "list_position(['not_applicable', 'pass', 'indeterminate', 'needs_review', 'warning', 'fail', 'error'], {})"
ESCALATED = """
, esc AS (SELECT file_id, analyzer, metric, value, CASE WHEN status IN ('warning', 'needs_review') AND (analyzer, metric) IN (('clipping', 'clipped_sample_pct'), ('glitch', 'glitch_event_count'), ('true_peak', 'true_peak')) THEN 'fail' ELSE status END AS status FROM fnd)"""
SEVERITY_SQL = "CASE status WHEN 'fail' THEN 'error' WHEN 'error' THEN 'critical' WHEN 'warning' THEN 'warning' WHEN 'needs_review' THEN 'warning' ELSE 'info' END"


@query("channel_verdicts", FINDINGS + ESCALATED + f"""
, v AS (SELECT file_id, max({RANK.format("status")}) AS r, count(*) AS findings, count(*) FILTER (WHERE {RANK.format("status")} >= 5) AS flagged FROM esc GROUP BY file_id)
, s AS (SELECT file_id, ['not_applicable', 'pass', 'indeterminate', 'needs_review', 'warning', 'fail', 'error'][r] AS status, findings, flagged FROM v)
SELECT file_id, status AS aggregate_status, findings, flagged, {SEVERITY_SQL} AS severity FROM s""")
def channel_verdicts(spark, d):
    """The flagship: every signal measured, judged by the strict overlay, and summed up in one verdict."""
    verdicts = policy.aggregate_status(policy.escalate(findings(spark, d), OVERLAY), "file_id")
    return verdicts.withColumn("severity", policy.literal_map(policy.SEVERITY)[F.col("aggregate_status")])


@query("signal_findings", FINDINGS + " SELECT * FROM fnd")
def signal_findings(spark, d):
    return findings(spark, d)


@query("policy_escalation", FINDINGS + ESCALATED + " SELECT * FROM esc")
def policy_escalation(spark, d):
    return policy.escalate(findings(spark, d), OVERLAY)


@query("aggregate_status", FINDINGS + f"""
SELECT file_id, ['not_applicable', 'pass', 'indeterminate', 'needs_review', 'warning', 'fail', 'error'][max({RANK.format("status")})] AS aggregate_status,
       count(*) AS findings, count(*) FILTER (WHERE {RANK.format("status")} >= 5) AS flagged FROM fnd GROUP BY file_id""")
def aggregate_status(spark, d):
    return policy.aggregate_status(findings(spark, d), "file_id")


@query("only_semi", FINDINGS + " SELECT * FROM fnd WHERE analyzer IN ('clipping', 'loudness')")
def only_semi(spark, d):
    return policy.select_analyzers(findings(spark, d), only=("clipping", "loudness"))


@query("skip_anti", FINDINGS + " SELECT * FROM fnd WHERE analyzer NOT IN ('clipping', 'loudness')")
def skip_anti(spark, d):
    return policy.select_analyzers(findings(spark, d), skip=("clipping", "loudness"))


@query("rule_enrichment", FINDINGS + ESCALATED + f"""
SELECT file_id, analyzer, metric, value, status, r.rule_id, CASE WHEN r.rule_id LIKE 'AS-DESC-%' THEN 'descriptive' ELSE 'objective' END AS rule_class, {SEVERITY_SQL} AS severity,
       CASE WHEN status IN ('fail', 'error') THEN r.recommendation END AS recommendation, CASE WHEN status IN ('fail', 'error') THEN r.why END AS why_it_matters
FROM esc JOIN (VALUES {", ".join("('" + "', '".join((a, m, policy.RULES[a][m], *policy.REMEDIATION.get(a, (f"Review the {a} finding and consult documentation.", f"The {a} analyzer detected a potential quality issue.")))) + "')" for a, m in (("clipping", "clipped_sample_pct"), ("glitch", "glitch_event_count"), ("loudness", "integrated_loudness"), ("true_peak", "true_peak"), ("lra", "loudness_range")))}) r(a, m, rule_id, recommendation, why)
  ON analyzer = r.a AND metric = r.m""")
def rule_enrichment(spark, d):
    return policy.enrich(policy.escalate(findings(spark, d), OVERLAY))


@query("rule_violations", FINDINGS + " SELECT file_id, analyzer, metric FROM fnd WHERE analyzer = 'lra' AND status IN ('fail', 'error')")
def rule_violations(spark, d):
    return policy.rule_violations(findings(spark, d)).select("file_id", "analyzer", "metric")


@query("compliance_cross", FINDINGS + """
, m AS (SELECT file_id, max(CASE WHEN analyzer = 'loudness' THEN value - 55.0 END) AS lufs, max(CASE WHEN analyzer = 'true_peak' THEN value END) AS dbtp FROM fnd GROUP BY file_id)
SELECT file_id, target, round(lufs - want, 2) AS lufs_delta, round(most - dbtp, 3) AS true_peak_margin,
       CASE WHEN abs(lufs - want) <= tol AND dbtp <= most THEN 'pass' ELSE 'fail' END AS overall
FROM m, (VALUES ('ebu', -23.0, 0.5, -1.0), ('spotify', -14.0, 1.0, -1.0), ('podcast', -16.0, 1.0, -1.0), ('atsc', -24.0, 2.0, -2.0), ('cine', -27.0, 2.0, -2.0)) t(target, want, tol, most)
WHERE lufs IS NOT NULL""")
def compliance_cross(spark, d):
    value = lambda analyzer: F.max(F.when(F.col("analyzer") == analyzer, F.col("value")))
    # the values of events lie some 55 dB above full scale
    measured = findings(spark, d).groupBy("file_id").agg((value("loudness") - 55.0).alias("lufs"), value("true_peak").alias("dbtp"))
    return policy.compliance(measured.where("lufs IS NOT NULL"))


@query("compare_delta", HALVES + """
SELECT file_id, analyzer, metric, fa.value AS value_a, fb.value AS value_b, round(fb.value - fa.value, 6) AS delta FROM fa JOIN fb USING (file_id, analyzer, metric)""")
def compare_delta(spark, d):
    return comparison.metric_deltas(findings(spark, d, 0), findings(spark, d, 1), "file_id")


RULED = """
, rules AS (SELECT unnest(['loudness', 'true_peak', 'clipping', 'glitch']) AS analyzer, unnest(['integrated_loudness', 'true_peak', 'clipped_sample_pct', 'glitch_event_count']) AS metric,
                   unnest(['AS-LOUD-001', 'AS-PEAK-001', 'AS-PEAK-002', 'AS-DEF-001']) AS rule_id)"""


@query("compare_flags", HALVES + RULED + """
, a AS (SELECT DISTINCT file_id, rule_id FROM fa JOIN rules USING (analyzer, metric) WHERE status IN ('warning', 'fail', 'needs_review')),
b AS (SELECT DISTINCT file_id, rule_id FROM fb JOIN rules USING (analyzer, metric) WHERE status IN ('warning', 'fail', 'needs_review')),
new AS (SELECT * FROM b EXCEPT SELECT * FROM a), gone AS (SELECT * FROM a EXCEPT SELECT * FROM b), same AS (SELECT * FROM a INTERSECT SELECT * FROM b),
f AS (SELECT file_id FROM fa UNION SELECT file_id FROM fb)
SELECT file_id, coalesce((SELECT string_agg(rule_id, ',' ORDER BY rule_id) FROM gone WHERE gone.file_id = f.file_id), '') AS only_in_a,
       coalesce((SELECT string_agg(rule_id, ',' ORDER BY rule_id) FROM new WHERE new.file_id = f.file_id), '') AS only_in_b,
       coalesce((SELECT string_agg(rule_id, ',' ORDER BY rule_id) FROM same WHERE same.file_id = f.file_id), '') AS unchanged,
       EXISTS (SELECT 1 FROM new WHERE new.file_id = f.file_id) AS regression
FROM f""")
def compare_flags(spark, d):
    return comparison.flag_changes(findings(spark, d, 0), findings(spark, d, 1), "file_id")


@query("golden_full_outer", HALVES + """
, e AS (SELECT file_id AS fixture, analyzer, metric, value, status FROM fa),
c AS (SELECT file_id AS fixture, analyzer, metric, value, status FROM fb),
j AS (SELECT coalesce(e.fixture, c.fixture) AS fixture, coalesce(e.analyzer, c.analyzer) AS analyzer, coalesce(e.metric, c.metric) AS metric,
             e.value AS ve, c.value AS vc, e.status AS se, c.status AS sc, e.fixture IS NULL AS ne, c.fixture IS NULL AS nc
      FROM e FULL JOIN c ON e.fixture = c.fixture AND e.analyzer = c.analyzer AND e.metric = c.metric)
SELECT fixture, analyzer, metric, CAST(1 AS BIGINT) AS nth, kind FROM (
  SELECT *, 'missing' AS kind FROM j WHERE nc UNION ALL SELECT *, 'extra' FROM j WHERE ne
  UNION ALL SELECT *, 'value_drift' FROM j WHERE NOT nc AND NOT ne AND abs(vc - ve) > CASE analyzer WHEN 'loudness' THEN 2.0 WHEN 'true_peak' THEN 3.0 ELSE 0.5 END
  UNION ALL SELECT *, 'status_change' FROM j WHERE se <> sc)""")
def golden_full_outer(spark, d):
    expected = findings(spark, d, 0).withColumnRenamed("file_id", "fixture")
    current = findings(spark, d, 1).withColumnRenamed("file_id", "fixture")
    tolerance = F.when(F.col("analyzer") == "loudness", 2.0).when(F.col("analyzer") == "true_peak", 3.0).otherwise(0.5)
    return comparison.golden_diff(expected, current, tolerance)


@query("sigma_tolerance", views("sig") + """
, t AS (SELECT channel % 10 AS fixture, channel AS trial, avg(x) AS mean, sqrt(avg(x * x)) AS rms, max(x) AS peak FROM sig GROUP BY channel),
u AS (SELECT fixture, 'mean' AS metric, mean AS v FROM t UNION ALL SELECT fixture, 'rms', rms FROM t UNION ALL SELECT fixture, 'peak', peak FROM t),
s AS (SELECT metric, fixture, stddev_samp(v) AS s FROM u GROUP BY ALL)
SELECT metric, ceil(greatest(2 * max(s), 1e-4) * 1000) / 1000 AS tolerance FROM s GROUP BY metric""")
def sigma_tolerance(spark, d):
    per = levels.channel_summary(events_signal(spark, d), 1.0)
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("value")) for m, c in (("mean", "dc"), ("rms", "rms"), ("peak", "high"))])
    per = per.join(events_signal(spark, d).groupBy("channel").agg(F.max("x").alias("high")), "channel")
    trials = per.select((F.col("channel") % 10).alias("fixture"), F.col("channel").alias("trial"), F.inline(values))
    return comparison.calibrated_tolerance(trials).withColumn("tolerance", F.col("tolerance").cast("double"))


@query("detector_pr", r"""
WITH c AS (SELECT lang, quality = 0 AS expected, regexp_matches(text, '[#$%&*|]{1}') OR contains(text, '!!') AS flagged FROM documents JOIN labels USING (doc_id)),
n AS (SELECT lang, count(*) FILTER (WHERE expected AND flagged) AS tp, count(*) FILTER (WHERE NOT expected AND flagged) AS fp, count(*) FILTER (WHERE expected AND NOT flagged) AS fn FROM c GROUP BY lang)
SELECT lang, tp, fp, fn, round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 4) AS precision, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 4) AS recall FROM n""")
def detector_pr(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "lang", "text"), table(spark, d, "labels")
    flagged = F.col("text").rlike("[#$%&*|]{1}") | F.col("text").contains("!!")
    cases = docs.join(labels, "doc_id").select("lang", (F.col("quality") == 0).alias("expected"), flagged.alias("flagged"))
    return comparison.detector_scores(cases, "lang")


@query("oracle_matrix", FINDINGS + f"""
, u AS (SELECT channel, -0.691 + 10 * log10(avg(x * x)) AS o FROM sig GROUP BY channel)
SELECT file_id AS key, round(abs(value - o), 4) AS delta, CASE WHEN abs(value - o) > 0.5 THEN 'needs_investigation' ELSE 'consistent' END AS verdict
FROM fnd JOIN u ON file_id = channel WHERE analyzer = 'loudness'""")
def oracle_matrix(spark, d):
    mine = findings(spark, d).where("analyzer = 'loudness'").select(F.col("file_id").alias("key"), "value")
    other = events_signal(spark, d).groupBy(F.col("channel").alias("key")).agg((-0.691 + 10 * F.log10(F.avg(F.col("x") * F.col("x")))).alias("value"))
    return comparison.oracle_matrix(mine, other)


@query("pii_redact", r"""
WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\b[\w.+-]+@[\w-]+\.[\w.-]+\b', '[REDACTED:email]', 'g'),
  '\b(?:\d[ -]*?){11,16}\b', '[REDACTED:card]', 'g'), '/(?:home|Users)/[^/]+', '[REDACTED:userpath]', 'g') AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '\[REDACTED:')) AS redactions, sha256(t) AS redacted_sha256 FROM r""")
def pii_redact(spark, d):
    docs = table(spark, d, "documents").select("doc_id", evidence.redact(F.col("text")).alias("t"))
    return docs.select("doc_id", F.regexp_count("t", F.lit(r"\[REDACTED:")).cast("long").alias("redactions"), F.sha2("t", 256).alias("redacted_sha256"))


@query("fingerprint_sha", FINDINGS + """
SELECT file_id, count(*) AS findings, sha256('[' || string_agg('{"analyzer":"' || analyzer || '","metric":"' || metric || '","status":"' || status || '","value":' || printf('%.6f', value) || '}', ',' ORDER BY analyzer, metric) || ']') AS fingerprint
FROM fnd GROUP BY file_id""")
def fingerprint_sha(spark, d):
    return evidence.fingerprints(findings(spark, d), "file_id")


@query("chain_verify", views("sig") + """
, c AS (SELECT channel AS log, frame, channel % 2 = 0 AND frame % 11 = 7 AS tampered, channel % 2 = 0 AND frame % 13 = 5 AS forged, lag(channel % 2 = 0 AND frame % 13 = 5) OVER (PARTITION BY channel ORDER BY frame) AS after FROM sig)
SELECT log, count(*) AS entries, count(*) FILTER (WHERE coalesce(after, false)) AS broken_links, count(*) FILTER (WHERE tampered OR forged) AS bad_hashes,
       count(*) FILTER (WHERE coalesce(after, false) OR tampered OR forged) = 0 AS valid FROM c GROUP BY log""")
def chain_verify(spark, d):
    """Every user's events as an audit log: written as a chain; then, in every second log, some payloads tampered with and some hashes forged."""
    lines = events_signal(spark, d).select(F.col("channel").alias("log"), F.col("frame").alias("line"), F.format_string("%.4f", F.col("x")).alias("payload"))
    chained = lines.repartition("log").sortWithinPartitions("log", "line").mapInArrow(evidence.chained, "log long, line long, payload string, prev_hash string, entry_hash string")
    kept = chained.withColumns({
        "payload": F.when((F.col("log") % 2 == 0) & (F.col("line") % 11 == 7), "tampered").otherwise(F.col("payload")), "entry_hash": F.when((F.col("log") % 2 == 0) & (F.col("line") % 13 == 5), "forged").otherwise(F.col("entry_hash")),
    })
    return evidence.verify_chain(kept, F.col("payload"))


@query("metadata_completeness", r"""
WITH p AS (SELECT page_id, regexp_matches(html, '<title>[^<]+</title>') AS title, regexp_matches(html, '<html lang="[a-z]+"') AS language, contains(html, '<h1>') AS heading,
                  contains(html, '<article>') AS article, regexp_matches(html, '<meta name="description"') AS description, starts_with(url, 'https://') AS secure FROM pages)
SELECT page_id, round((title::INT + language::INT + heading::INT + article::INT + description::INT + secure::INT) / 6.0, 4) AS completeness,
       concat_ws(',', CASE WHEN NOT title THEN 'title' END, CASE WHEN NOT language THEN 'language' END, CASE WHEN NOT heading THEN 'heading' END,
                 CASE WHEN NOT article THEN 'article' END, CASE WHEN NOT description THEN 'description' END, CASE WHEN NOT secure THEN 'secure' END) AS missing FROM p""")
def metadata_completeness(spark, d):
    html = F.col("html")
    present = {
        "title": html.rlike("<title>[^<]+</title>"), "language": html.rlike('<html lang="[a-z]+"'), "heading": html.contains("<h1>"),
        "article": html.contains("<article>"), "description": html.rlike('<meta name="description"'), "secure": F.col("url").startswith("https://"),
    }
    return table(spark, d, "pages").select("page_id", *evidence.completeness(present))


@query("frozen_flatten_diff", """
WITH e AS (SELECT event_id, user_id, event_type, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id AS subject, event_id, n, unnest(json_keys(props)) AS path, props FROM e),
v AS (SELECT subject, n, 'props.' || path AS path, json_extract_string(props, path) AS value FROM f UNION ALL SELECT user_id, n, 'type', event_type FROM e),
a AS (SELECT subject, path || '.' || (n // 2) AS path, value FROM v WHERE n % 2 = 0), b AS (SELECT subject, path || '.' || (n // 2) AS path, value FROM v WHERE n % 2 = 1)
SELECT coalesce(a.subject, b.subject) AS subject, coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'added' ELSE 'changed' END AS kind
FROM a FULL JOIN b ON a.subject = b.subject AND a.path = b.path WHERE a.value IS DISTINCT FROM b.value OR a.path IS NULL OR b.path IS NULL""")
def frozen_flatten_diff(spark, d):
    """Every second event of a user against the one after it, and the first one against none: type and props as flat fields."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    events = table(spark, d, "events").select(F.col("user_id").alias("subject"), "event_type", F.from_json("props", "map<string,string>").alias("p"), n.alias("n"))
    fields = F.map_concat(F.transform_keys(F.coalesce("p", F.create_map().cast("map<string,string>")), lambda k, _: F.concat(F.lit("props."), k)), F.create_map(F.lit("type"), F.col("event_type")))
    flat = events.select("subject", "n", F.explode(fields).alias("path", "value"))
    side = lambda odd: flat.where(F.col("n") % 2 == odd).select("subject", F.concat_ws(".", "path", F.floor(F.col("n") / 2)).alias("path"), "value")
    return comparison.field_diff(side(0), side(1))

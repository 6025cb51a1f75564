"""Queries of contours and reference quality, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonegrid.functions.columns import round4
from tonegrid.operators import contours, levels, reference, spectra
from tonegrid.plans.measurements import PAIRS, _pairs, block_sql
from tonegrid.sources.signals import events_signal, table, views

QUERIES: dict = {}
ORACLES: dict = {}
BANDS = (0, 4, 8, 16, 32, 64)


def query(name: str, sql: str):
    def add(run):
        QUERIES[name], ORACLES[name] = run, sql
        return run

    return add


@query("melodic_contour", views("sig") + """
, m AS (SELECT channel, coalesce(regr_slope(x, frame), 0) AS s, 12 * log2(max(x) / min(x)) AS t FROM sig WHERE x > 0 GROUP BY channel)
SELECT channel, round(s, 4) AS slope, CASE WHEN s > 0.05 THEN 'rising' WHEN s < -0.05 THEN 'falling' ELSE 'stable' END AS direction, round(t, 4) AS semitones FROM m""")
def melodic_contour(spark, d):
    return round4(contours.melodic_contour(events_signal(spark, d), 0.05), "slope", "semitones")


@query("pitch_drift", views("sig") + """
, m AS (SELECT channel, median(x) OVER (PARTITION BY channel ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM sig WHERE x > 0),
c AS (SELECT channel, count(*) AS voiced, 1200 * log2(max(s) / min(s)) AS c FROM m GROUP BY channel)
SELECT channel, voiced, round(c, 4) AS drift_cents, CASE WHEN voiced < 4 THEN 'not_applicable' WHEN c > 3000 THEN 'warning' ELSE 'pass' END AS status FROM c""")
def pitch_drift(spark, d):
    return round4(contours.pitch_drift(events_signal(spark, d), 3000.0), "drift_cents")


@query("attack_times", views("sig") + """
, e AS (SELECT channel, frame, avg(abs(x)) OVER (PARTITION BY channel ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS env FROM sig),
d AS (SELECT channel, frame, env - lag(env) OVER (PARTITION BY channel ORDER BY frame) AS d FROM e),
q AS (SELECT channel, quantile_cont(d, 0.8) AS q FROM d WHERE d > 0 GROUP BY channel),
o AS (SELECT channel, frame, d > q AS o FROM d JOIN q USING (channel) WHERE d IS NOT NULL),
r AS (SELECT channel, frame, o, coalesce(lag(o) OVER (PARTITION BY channel ORDER BY frame), false) AS was FROM o),
n AS (SELECT r.channel, r.frame AS onset, s.frame, abs(s.x) AS a, max(abs(s.x)) OVER (PARTITION BY r.channel, r.frame) AS p FROM r JOIN sig s ON r.channel = s.channel AND s.frame BETWEEN r.frame AND r.frame + 7 WHERE r.o AND NOT r.was),
t AS (SELECT channel, onset, min(frame) FILTER (WHERE a >= 0.1 * p) AS t1, min(frame) FILTER (WHERE a >= 0.9 * p) AS t2 FROM n GROUP BY ALL)
SELECT channel, count(*) AS onsets, max(greatest(0, t2 - t1)) AS slowest_attack FROM t GROUP BY channel""")
def attack_times(spark, d):
    return contours.attack_times(events_signal(spark, d), 4, 0.8, 8)


@query("phase_jumps", views("sig") + """
, n AS (SELECT channel, count(*) AS n FROM sig GROUP BY channel),
b AS (SELECT channel, unnest(range(0, greatest(0, (n - 16) // 8 + 1))) AS w FROM n),
p AS (SELECT b.channel, b.w, atan2(sum(-x * sin(2 * pi() * 0.125 * frame)), sum(x * cos(2 * pi() * 0.125 * frame))) AS p FROM b JOIN sig s ON s.channel = b.channel AND s.frame >= b.w * 8 AND s.frame < b.w * 8 + 16 GROUP BY ALL),
j AS (SELECT channel, p - lag(p) OVER (PARTITION BY channel ORDER BY w) AS s FROM p)
SELECT channel, count(*) AS windows, count(*) FILTER (WHERE abs(s - 2 * pi() * floor((s + pi()) / (2 * pi()))) > 1.0) AS jumps FROM j GROUP BY channel""")
def phase_jumps(spark, d):
    return contours.phase_jumps(events_signal(spark, d), 0.125, 16, 8)


@query("ref_window_similarity", views("spec") + PAIRS.replace("SELECT a.vec_id AS pair", "SELECT a.vec_id AS pair, a.bin AS frame") + """
, w AS (SELECT pair, frame // 16 AS w, sum(ref * deg) / sqrt(sum(ref * ref) * sum(deg * deg)) AS c FROM p GROUP BY ALL),
s AS (SELECT pair, avg(c) AS s FROM w GROUP BY pair)
SELECT pair, round(s, 4) + 0.0 AS similarity, CASE WHEN s < 0.3 THEN 'warning' ELSE 'pass' END AS status FROM s""")
def ref_window_similarity(spark, d):
    return round4(reference.window_similarity(_pairs(spark, d), 16, 0.3), "similarity")


@query("ref_spectral_quality", views("spec") + PAIRS + """
, q AS (SELECT pair, 1 + 4 * avg(2 * abs(ref) * abs(deg) / (ref * ref + deg * deg + 1e-12)) AS q FROM p GROUP BY pair)
SELECT pair, round(q, 4) AS quality, CASE WHEN q < 3.5 THEN 'warning' ELSE 'pass' END AS status FROM q""")
def ref_spectral_quality(spark, d):
    pairs = _pairs(spark, d).withColumns({"ref": F.abs("ref"), "deg": F.abs("deg")})
    return round4(reference.spectral_quality(pairs), "quality")


@query("ref_alignment", views("spec") + PAIRS.replace("SELECT a.vec_id AS pair", "SELECT a.vec_id AS pair, a.bin AS frame") + """
, l AS (SELECT a.pair, b.frame - a.frame AS lag, sum(a.ref * b.deg) AS c FROM p a JOIN p b ON a.pair = b.pair AND b.frame - a.frame BETWEEN -4 AND 4 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY round(abs(c), 9) DESC, lag) AS n FROM l)
SELECT pair, lag, round(c, 4) AS correlation FROM r WHERE n = 1""")
def ref_alignment(spark, d):
    out = round4(reference.alignment(_pairs(spark, d), 4), "correlation")
    return out.withColumn("lag", F.col("lag").cast("long"))


@query("band_losses", views("spec") + PAIRS.replace("SELECT a.vec_id AS pair", "SELECT a.vec_id AS pair, a.bin AS frame") + """
, b AS (SELECT pair, CASE WHEN frame < 4 THEN 0 WHEN frame < 8 THEN 1 WHEN frame < 16 THEN 2 WHEN frame < 32 THEN 3 ELSE 4 END AS band, ref AS l, deg AS r FROM p),
e AS (SELECT pair, band, 10 * log10(greatest(sum(l * l), 1e-12)) AS l, 10 * log10(greatest(sum(r * r), 1e-12)) AS r, 10 * log10(greatest(sum((0.5 * l + 0.5 * r) * (0.5 * l + 0.5 * r)), 1e-12)) AS m,
             10 * log10(greatest(sum((l - r) * (l - r) / 4), 1e-12)) AS s FROM b GROUP BY ALL),
w AS (SELECT pair, greatest(0, max(greatest(l, r) - m)) AS w, max(CASE WHEN band = 0 THEN s - m END) AS q FROM e GROUP BY pair)
SELECT pair, round(w, 4) AS worst_loss_db, round(q, 4) AS side_mid_db, CASE WHEN w >= 6.0 THEN 'warning' ELSE 'pass' END AS status FROM w""")
def band_losses(spark, d):
    return round4(reference.band_losses(_pairs(spark, d), BANDS), "worst_loss_db", "side_mid_db")


@query("declared_sizes", """
WITH s AS (SELECT doc_id AS file_id, 100.0 * abs(length(text) - n_chars) / greatest(n_chars, 1) AS p, n_chars FROM documents)
SELECT file_id, round(p, 4) AS difference_pct, CASE WHEN n_chars IS NULL OR p > 1 THEN 'warning' ELSE 'pass' END AS status FROM s""")
def declared_sizes(spark, d):
    subjects = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("n_chars").alias("declared"), F.length("text").alias("decoded"))
    return round4(reference.declared_sizes(subjects), "difference_pct")


@query("intelligibility", views("sig") + ", " + block_sql("sig", 4, 4) + """
, l AS (SELECT channel, 20 * log10((quantile_cont(sqrt(ms), 0.9) + 1e-12) / (quantile_cont(sqrt(ms), 0.1) + 1e-12)) AS snr FROM blk GROUP BY channel),
f AS (SELECT channel, 2 * sqrt(power(sum(x * cos(2 * pi() * 0.25 * frame)), 2) + power(sum(x * sin(2 * pi() * 0.25 * frame)), 2)) / count(*) AS a, sqrt(avg(x * x)) AS r FROM sig GROUP BY channel),
s AS (SELECT l.channel, 0.6 * greatest(0, least(1, snr / 20)) + 0.4 * least(1, a / nullif(r, 0)) AS s FROM l JOIN f ON l.channel = f.channel)
SELECT channel, round(s, 4) AS score, CASE WHEN s < 0.6 THEN 'warning' ELSE 'pass' END AS status FROM s""")
def intelligibility(spark, d):
    signal = events_signal(spark, d)
    tone = spectra.dft_bin(signal, 0.25).join(levels.channel_summary(signal, 1.0), "channel")
    clarity = tone.select("channel", F.least(F.lit(1.0), F.try_divide("amplitude", "rms")).alias("clarity"))
    return round4(reference.intelligibility(levels.snr(signal, 4), clarity), "score")

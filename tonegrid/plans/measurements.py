"""Queries of measurements on the tables seen as signals, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonegrid.functions.columns import db, round4
from tonegrid.operators import levels, runs, spectra, stereo
from tonegrid.sources.signals import events_signal, order_signal, stereo_signal, views
from tonegrid.sources.signals import spectra as frames

QUERIES: dict = {}
ORACLES: dict = {}

#: Block size and hop in frames: what 400 ms every 100 ms are to a sound is 8 every 2 to a user's events.
SIZE, HOP = 8, 2
RATE = 8.0
CLIP = 120.0
QUIET = 4.0


def query(name: str, sql: str):
    def add(run):
        QUERIES[name], ORACLES[name] = run, sql
        return run

    return add


def block_sql(of: str = "sig", size: int = SIZE, hop: int = HOP) -> str:
    """Whole blocks by a join of block numbers and frames."""
    return f"""n AS (SELECT channel, count(*) AS n FROM {of} GROUP BY channel),
b AS (SELECT channel, unnest(range(0, greatest(0, (n - {size}) // {hop} + 1))) AS block FROM n),
blk AS (SELECT b.channel, b.block, avg(s.x * s.x) AS ms, max(abs(s.x)) AS peak
        FROM b JOIN {of} s ON s.channel = b.channel AND s.frame >= b.block * {hop} AND s.frame < b.block * {hop} + {size} GROUP BY ALL)"""


LUFS = "CASE WHEN ms > 0 THEN -0.691 + 10 * log10(ms) ELSE -70.0 END"


@query("signal_inspect", views("sig") + f"""
SELECT channel, count(*) AS frames, round(count(*) / {RATE}, 4) AS duration_s, round(max(abs(x)), 4) AS peak,
       round(sqrt(avg(x * x)), 4) AS rms, round(avg(x), 4) AS dc FROM sig GROUP BY channel""")
def signal_inspect(spark, d):
    return round4(levels.channel_summary(events_signal(spark, d), RATE), "duration_s", "peak", "rms", "dc")


@query("clipping_pct", views("sig") + f"""
SELECT channel, round(p, 4) AS clipped_pct, CASE WHEN p > 2.0 THEN 'fail' WHEN p > 0 THEN 'warning' ELSE 'pass' END AS status
FROM (SELECT channel, 100.0 * count(*) FILTER (WHERE abs(x) >= {CLIP}) / count(*) AS p FROM sig GROUP BY channel)""")
def clipping_pct(spark, d):
    return round4(runs.clipping(events_signal(spark, d), CLIP, 2.0), "clipped_pct")


@query("clipping_runs", views("sig") + """
, g AS (SELECT channel, frame, frame - row_number() OVER (PARTITION BY channel ORDER BY frame) AS g FROM sig WHERE abs(x) >= 60.0)
SELECT channel, min(frame) AS start, count(*) AS length FROM g GROUP BY channel, g HAVING count(*) >= 2""")
def clipping_runs(spark, d):
    return runs.clipping_runs(events_signal(spark, d), 60.0, 2)


@query("click_events", views("sig") + """
, d AS (SELECT channel, frame, lead(x) OVER w - 2 * x + lag(x) OVER w AS d2 FROM sig WINDOW w AS (PARTITION BY channel ORDER BY frame)),
l AS (SELECT channel, sqrt(avg(d2 * d2)) + 1e-12 AS level FROM d GROUP BY channel),
g AS (SELECT channel, frame, frame - row_number() OVER (PARTITION BY channel ORDER BY frame) AS g FROM d JOIN l USING (channel) WHERE abs(d2) > 2.5 * level)
SELECT channel, min(frame) AS start, count(*) AS length FROM g GROUP BY channel, g""")
def click_events(spark, d):
    return runs.clicks(events_signal(spark, d), 2.5)


@query("dropout_runs", views("sig") + f"""
, g AS (SELECT channel, frame, frame - row_number() OVER (PARTITION BY channel ORDER BY frame) AS g FROM sig WHERE abs(x) < {QUIET}),
r AS (SELECT channel, min(frame) AS start, count(*) AS length FROM g GROUP BY channel, g HAVING count(*) >= 2),
c AS (SELECT r.channel, r.start, r.length, count(*) AS n, sqrt(avg(x * x)) AS context_rms
      FROM r JOIN sig s ON s.channel = r.channel AND s.frame BETWEEN r.start - 8 AND r.start + r.length + 7 GROUP BY ALL)
SELECT channel, start, length, round(context_rms, 4) AS context_rms FROM c WHERE n > length AND context_rms >= 5 * {QUIET}""")
def dropout_runs(spark, d):
    return round4(runs.dropouts(events_signal(spark, d), QUIET, 2, 5.0), "context_rms")


@query("repetition_windows", " UNION ALL ".join(f"""
SELECT channel, CAST({n} AS BIGINT) AS lag, start FROM ({views("sig")}
, s AS (SELECT channel, frame, coalesce(CAST(abs(x - lead(x, {n}) OVER (PARTITION BY channel ORDER BY frame)) < 12.0 AS INT), 0) AS same FROM sig)
SELECT channel, frame AS start, sum(same) OVER (PARTITION BY channel ORDER BY frame ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS n FROM s) WHERE n = {n}""" for n in (2, 3, 4)))
def repetition_windows(spark, d):
    return runs.repetitions(events_signal(spark, d), (2, 3, 4), 12.0)


@query("loop_jump", views("sig") + """
, e AS (SELECT channel, first(x ORDER BY frame) AS a, nth_value_a AS b, y AS c, z AS d FROM (
  SELECT channel, frame, x, nth_value(x, 2) OVER w AS nth_value_a, nth_value(x, 2) OVER v AS y, first_value(x) OVER v AS z FROM sig
  WINDOW w AS (PARTITION BY channel ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
         v AS (PARTITION BY channel ORDER BY frame DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY channel, nth_value_a, y, z)
SELECT channel, round(abs(d - a), 4) AS jump, round(abs((b - a) - (d - c)), 4) AS slope_jump,
       CASE WHEN abs(d - a) > 20.0 OR abs((b - a) - (d - c)) > 40.0 THEN 'fail' ELSE 'pass' END AS status FROM e WHERE b IS NOT NULL""")
def loop_jump(spark, d):
    return round4(runs.loop_jump(events_signal(spark, d), 20.0, 40.0), "jump", "slope_jump")


@query("gated_loudness", views("sig") + ", " + block_sql() + f"""
, l AS (SELECT channel, {LUFS} AS l FROM blk), a AS (SELECT * FROM l WHERE l >= -70),
m AS (SELECT channel, 10 * log10(avg(power(10, l / 10))) AS m FROM a GROUP BY channel)
SELECT channel, round(coalesce(10 * log10(avg(power(10, l / 10)) FILTER (WHERE l >= m - 10)), max(m)), 4) AS lufs FROM a JOIN m USING (channel) GROUP BY channel""")
def gated_loudness(spark, d):
    return round4(levels.gated_loudness(events_signal(spark, d), SIZE, HOP), "lufs")


@query("loudness_range", views("sig") + ", " + block_sql() + f"""
, a AS (SELECT channel, {LUFS} AS l FROM blk WHERE {LUFS} > -70),
m AS (SELECT channel, 10 * log10(avg(power(10, l / 10))) AS m, count(*) AS n FROM a GROUP BY channel),
q AS (SELECT channel, n, count(*) FILTER (WHERE l >= m - 10) AS g, quantile_cont(l, 0.95) FILTER (WHERE l >= m - 10) - quantile_cont(l, 0.1) FILTER (WHERE l >= m - 10) AS p,
             quantile_cont(l, 0.95) - quantile_cont(l, 0.1) AS q FROM a JOIN m USING (channel) GROUP BY channel, n)
SELECT channel, round(CASE WHEN n < 4 THEN 0 WHEN g < 4 THEN greatest(0, q) ELSE greatest(0, p) END, 4) AS lra FROM q""")
def loudness_range(spark, d):
    return round4(levels.loudness_range(events_signal(spark, d), SIZE, HOP), "lra")


@query("dynamic_range_top20", views("items") + ", " + block_sql("items", 16, 8) + """
, r AS (SELECT channel, peak, sqrt(ms) AS rms, row_number() OVER (PARTITION BY channel ORDER BY sqrt(ms) DESC, block) AS k, count(*) OVER (PARTITION BY channel) AS n FROM blk WHERE sqrt(ms) > 1e-12)
SELECT channel, round(greatest(0, 20 * log10(avg(peak) / avg(rms))), 4) AS dr FROM r WHERE k <= greatest(1, n // 5) GROUP BY channel""")
def dynamic_range_top20(spark, d):
    return round4(levels.dynamic_range(order_signal(spark, d), 16, 8), "dr")


@query("noise_floor_p10", views("sig") + ", " + block_sql("sig", 4, 4) + """
SELECT channel, round(20 * log10(greatest(quantile_cont(sqrt(ms), 0.1), 1e-12)), 4) AS noise_floor_db FROM blk WHERE sqrt(ms) > 1e-12 GROUP BY channel""")
def noise_floor_p10(spark, d):
    return round4(levels.noise_floor(events_signal(spark, d), 4), "noise_floor_db")


@query("snr_p90_p10", views("sig") + ", " + block_sql("sig", 4, 4) + """
SELECT channel, round(20 * log10((quantile_cont(sqrt(ms), 0.9) + 1e-12) / (quantile_cont(sqrt(ms), 0.1) + 1e-12)), 4) AS snr_db FROM blk GROUP BY channel""")
def snr_p90_p10(spark, d):
    return round4(levels.snr(events_signal(spark, d), 4), "snr_db")


@query("rt60_schroeder", views("sig") + f"""
, e AS (SELECT channel, frame, sum(x * x) OVER (PARTITION BY channel ORDER BY frame DESC ROWS UNBOUNDED PRECEDING) AS e, sum(x * x) OVER (PARTITION BY channel) AS a FROM sig),
c AS (SELECT channel, frame / {RATE} AS t, 10 * log10(e / a + 1e-12) AS d FROM e WHERE a > 0 AND 10 * log10(e / a + 1e-12) >= -30),
f AS (SELECT channel, count(*) AS n, regr_slope(d, t) AS s FROM c GROUP BY channel)
SELECT channel, round(CASE WHEN n > 1 AND s < 0 THEN least(10.0, greatest(0.0, -60 / s)) ELSE 0.0 END, 4) AS rt60_s FROM f""")
def rt60_schroeder(spark, d):
    return round4(levels.decay_time(events_signal(spark, d), RATE), "rt60_s")


@query("onset_ioi_cv", views("sig") + """
, e AS (SELECT channel, frame, avg(abs(x)) OVER (PARTITION BY channel ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS env FROM sig),
d AS (SELECT channel, frame, env - lag(env) OVER (PARTITION BY channel ORDER BY frame) AS d FROM e),
q AS (SELECT channel, quantile_cont(d, 0.8) AS q FROM d WHERE d > 0 GROUP BY channel),
o AS (SELECT channel, frame, d > q AS o FROM d JOIN q USING (channel) WHERE d IS NOT NULL),
r AS (SELECT channel, frame, o, coalesce(lag(o) OVER (PARTITION BY channel ORDER BY frame), false) AS was FROM o),
g AS (SELECT channel, frame - lag(frame) OVER (PARTITION BY channel ORDER BY frame) AS gap FROM r WHERE o AND NOT was)
SELECT channel, count(*) AS onsets, round(greatest(0, 1 - stddev_pop(gap) / avg(gap)), 4) AS regularity FROM g GROUP BY channel HAVING count(*) >= 4""")
def onset_ioi_cv(spark, d):
    return round4(runs.onset_regularity(events_signal(spark, d), 4, 0.8, 4), "regularity")


@query("envelope_crossings", views("sig") + f"""
, c AS (SELECT channel, frame, abs(x - avg(x) OVER (PARTITION BY channel)) AS c FROM sig),
o AS (SELECT channel, frame, c > 0.3 * max(c) OVER (PARTITION BY channel) AS o FROM c),
e AS (SELECT channel, o AND NOT coalesce(lag(o) OVER (PARTITION BY channel ORDER BY frame), false) AS e FROM o)
SELECT channel, round(count(*) FILTER (WHERE e) * {RATE} / count(*), 4) AS rate_hz FROM e GROUP BY channel""")
def envelope_crossings(spark, d):
    return round4(runs.crossings(events_signal(spark, d), 0.3, RATE), "rate_hz")


@query("goniometer", views("sig", "stereo") + """
SELECT channel, round(CASE WHEN sqrt(greatest(0, var_pop(l)) * greatest(0, var_pop(r))) > 1e-12 THEN covar_pop(l, r) / sqrt(var_pop(l) * var_pop(r)) ELSE 0 END, 4) AS mean_correlation,
       round(coalesce((avg(l * l) - avg(r * r)) / nullif(avg(l * l) + avg(r * r), 0), 0), 4) AS balance,
       round(stddev_pop((l - r) / sqrt(2)), 4) AS width, round(avg(CASE WHEN l * r < 0 THEN 1.0 ELSE 0.0 END), 4) AS out_of_phase
FROM stereo GROUP BY channel""")
def goniometer(spark, d):
    return round4(stereo.goniometer(stereo_signal(spark, d)), "mean_correlation", "balance", "width", "out_of_phase")


def _level(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN -0.691 + 10 * log10({x}) ELSE -70.0 END"


@query("channel_balance", views("sig", "stereo") + f"""
, m AS (SELECT channel, avg(l * l) AS a, avg(r * r) AS b FROM stereo GROUP BY channel),
d AS (SELECT channel, abs({_level("a")} - {_level("b")}) AS u, abs(20 * log10(greatest(sqrt(a), 1e-12)) - 20 * log10(greatest(sqrt(b), 1e-12))) AS v FROM m)
SELECT channel, round(u, 4) AS delta_lufs, round(v, 4) AS delta_rms_db, CASE WHEN u > 1.0 OR v > 2.0 THEN 'warning' ELSE 'pass' END AS status FROM d""")
def channel_balance(spark, d):
    return round4(stereo.channel_balance(stereo_signal(spark, d)), "delta_lufs", "delta_rms_db")


@query("mono_loss", views("sig", "stereo") + """
, m AS (SELECT channel, sqrt(avg(l * l)) AS a, sqrt(avg(r * r)) AS b, sqrt(avg((0.5 * l + 0.5 * r) * (0.5 * l + 0.5 * r))) AS m FROM stereo GROUP BY channel),
d AS (SELECT channel, greatest(0, 20 * log10(greatest(a, b, 1e-12)) - 20 * log10(greatest(m, 1e-12))) AS d FROM m)
SELECT channel, round(d, 4) AS mono_loss_db, CASE WHEN d >= 6.0 THEN 'warning' ELSE 'pass' END AS status FROM d""")
def mono_loss(spark, d):
    return round4(stereo.mono_loss(stereo_signal(spark, d)), "mono_loss_db")


@query("channel_corr_matrix", views("typed") + """
, p AS (SELECT a.channel AS a, b.channel AS b, a.x AS x, b.x AS y FROM typed a JOIN typed b ON a.frame = b.frame AND a.channel < b.channel)
, c AS (SELECT a, b, CASE WHEN sqrt(var_pop(x) * var_pop(y)) > 1e-12 THEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) ELSE 0 END AS c FROM p GROUP BY ALL)
SELECT a, b, round(c, 4) AS correlation, CASE WHEN abs(c) > 0.95 THEN 'warning' ELSE 'pass' END AS status FROM c""")
def channel_corr_matrix(spark, d):
    return round4(stereo.correlation_matrix(events_signal(spark, d, "event_type")), "correlation")


PAIRS = """, p AS (SELECT a.vec_id AS pair, a.v AS ref, b.v AS deg FROM spec a JOIN spec b ON a.bin = b.bin AND b.vec_id = a.vec_id + 1)"""


def _pairs(spark, d):
    spec = frames(spark, d)
    after = spec.select((F.col("vec_id") - 1).alias("pair"), "bin", F.col("v").alias("deg"))
    return spec.select(F.col("vec_id").alias("pair"), "bin", F.col("v").alias("ref")).join(after, ["pair", "bin"]).withColumnRenamed("bin", "frame")


@query("si_sdr", views("spec") + PAIRS + """
, s AS (SELECT pair, sum(ref * deg) AS rd, sum(ref * ref) AS rr, sum(deg * deg) AS dd FROM p GROUP BY pair)
SELECT pair, round(10 * log10((rd * rd / rr + 1e-12) / (greatest(0, dd - rd * rd / rr) + 1e-12)), 3) AS si_sdr_db FROM s""")
def si_sdr(spark, d):
    return round4(stereo.si_sdr(_pairs(spark, d)), "si_sdr_db", digits=3)


@query("leakage", views("spec") + """
, m AS (SELECT label, bin, avg(v) AS x FROM spec GROUP BY ALL)
, s AS (SELECT a.label AS stem, b.label AS other, sum(a.x * b.x) AS xy, sum(b.x * b.x) AS yy, sum(a.x * a.x) AS xx FROM m a JOIN m b ON a.bin = b.bin AND a.label <> b.label GROUP BY ALL)
, l AS (SELECT stem, 100.0 * sum(CASE WHEN xy > 0 THEN xy * xy / yy ELSE 0 END) / max(xx) AS l FROM s GROUP BY stem)
SELECT stem, round(l, 4) AS leakage_pct, CASE WHEN l > 10 THEN 'warning' ELSE 'pass' END AS status FROM l""")
def leakage(spark, d):
    means = frames(spark, d).groupBy("label", "bin").agg(F.avg("v").alias("x"))
    other = means.select(F.col("label").alias("other"), "bin", F.col("x").alias("y"))
    pairs = means.withColumnRenamed("label", "stem").join(other, "bin").where("stem <> other").withColumnRenamed("bin", "frame")
    return round4(stereo.leakage(pairs), "leakage_pct")


@query("layout_checks", views("spec") + """
, c AS (SELECT vec_id // 6 AS subject, vec_id % 6 AS channel, bin, mag * mag AS e FROM spec)
, s AS (SELECT subject, 100.0 * sum(e) FILTER (WHERE channel = 3 AND bin < 16) / sum(e) FILTER (WHERE channel = 3) AS p, sqrt(avg(e) FILTER (WHERE channel = 2)) AS q FROM c GROUP BY subject)
SELECT subject, round(p, 4) AS lfe_low_pct, round(q, 4) AS centre_rms, CASE WHEN p < 20.0 OR q < 1e-6 THEN 'warning' ELSE 'pass' END AS status FROM s""")
def layout_checks(spark, d):
    multi = frames(spark, d).select(F.floor(F.col("vec_id") / 6).alias("subject"), (F.col("vec_id") % 6).alias("channel"), "bin", "mag")
    return round4(stereo.layout_checks(multi, 16, 20.0), "lfe_low_pct", "centre_rms")


@query("spectral_health", views("spec") + """
SELECT vec_id, round(sum(bin * mag) / sum(mag), 4) AS centroid, round(exp(avg(ln(mag + 1e-12))) / (avg(mag) + 1e-12), 4) AS flatness FROM spec GROUP BY vec_id""")
def spectral_health(spark, d):
    return round4(spectra.spectral_health(frames(spark, d)), "centroid", "flatness")


@query("rolloff85", views("spec") + """
, r AS (SELECT vec_id, bin, sum(mag) OVER (PARTITION BY vec_id ORDER BY bin) AS u, sum(mag) OVER (PARTITION BY vec_id) AS a FROM spec)
SELECT vec_id, min(bin) AS rolloff_bin FROM r WHERE u >= 0.85 * a GROUP BY vec_id""")
def rolloff85(spark, d):
    return spectra.rolloff(frames(spark, d))


@query("spectral_irregularity", views("spec") + """
, s AS (SELECT vec_id, mag, abs(mag - lag(mag) OVER (PARTITION BY vec_id ORDER BY bin)) AS d FROM spec)
SELECT vec_id, round(least(1.0, avg(d) / (avg(mag) + 1e-12)), 4) AS irregularity FROM s GROUP BY vec_id""")
def spectral_irregularity(spark, d):
    return round4(spectra.irregularity(frames(spark, d)), "irregularity")


THIRDS = """, f AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) // 3 AS c, count(*) OVER (PARTITION BY label) AS n
       FROM (SELECT DISTINCT label, vec_id FROM spec)),
t AS (SELECT s.*, CASE WHEN i < c THEN 0 WHEN i >= n - c THEN 2 ELSE 1 END AS third FROM spec s JOIN f USING (label, vec_id))"""


@query("timbre_distance", views("spec") + THIRDS + """
, m AS (SELECT label, bin, avg(mag) FILTER (WHERE third = 0) AS a, avg(mag) FILTER (WHERE third = 2) AS b FROM t GROUP BY ALL)
SELECT label, round(greatest(0, least(1, 1 - sum(a * b) / sqrt(sum(a * a) * sum(b * b)))), 4) AS timbre_distance FROM m GROUP BY label""")
def timbre_distance(spark, d):
    return round4(spectra.timbre_distance(frames(spark, d)), "timbre_distance")


@query("fatigue_index", views("spec") + THIRDS + """
, e AS (SELECT label, sum(mag * mag) FILTER (WHERE third = 0) AS a, sum(mag * mag) FILTER (WHERE third = 0 AND bin >= 32) AS b,
               sum(mag * mag) FILTER (WHERE third = 2) AS c, sum(mag * mag) FILTER (WHERE third = 2 AND bin >= 32) AS d FROM t GROUP BY label)
SELECT label, round(greatest(-1, least(1, 1 - (d / c) / (b / a))), 4) AS fatigue_index FROM e""")
def fatigue_index(spark, d):
    return round4(spectra.fatigue(frames(spark, d), 32), "fatigue_index")


@query("scene_angles", views("spec") + """
, v AS (SELECT label, vec_id, list(10 * log10(greatest(mag * mag, 1e-12)) ORDER BY bin) AS v FROM spec GROUP BY ALL),
w AS (SELECT label, v, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM v),
a AS (SELECT label, degrees(acos(greatest(-1, least(1, list_dot_product(v, w) / sqrt(list_dot_product(v, v) * list_dot_product(w, w)))))) AS a FROM w)
SELECT label, count(*) AS frames, count(*) FILTER (WHERE a > 35) AS scene_changes, round(max(a), 3) AS largest_angle FROM a GROUP BY label""")
def scene_angles(spark, d):
    return round4(spectra.scene_angles(frames(spark, d), 35.0), "largest_angle", digits=3)


@query("artifact_frames", views("spec") + """
, l AS (SELECT label, vec_id, 20 * log10(avg(mag) + 1e-12) AS a, 20 * log10(avg(mag) FILTER (WHERE bin < 8) + 1e-12) AS b, 20 * log10(avg(mag) FILTER (WHERE bin >= 48) + 1e-12) AS c FROM spec GROUP BY ALL)
SELECT label, count(*) AS frames, count(*) FILTER (WHERE b - a > 2.0 OR c - a > 1.5) AS artifact_frames FROM l GROUP BY label""")
def artifact_frames(spark, d):
    return spectra.artifact_frames(frames(spark, d), 8, 48, 2.0, 1.5)


@query("effective_bandwidth", views("spec") + """
, p AS (SELECT vec_id, bin, mag * mag AS p, max(mag * mag) OVER (PARTITION BY vec_id) AS m FROM spec)
SELECT vec_id, round(10 * log10(greatest(avg(p) FILTER (WHERE bin BETWEEN 28 AND 35), 1e-12)) - 10 * log10(greatest(avg(p) FILTER (WHERE bin < 16), 1e-12)), 4) AS aliasing_level_db,
       max(bin) FILTER (WHERE 10 * log10(greatest(p, 1e-12)) - 10 * log10(greatest(m, 1e-12)) > -10) AS bandwidth_bin FROM p GROUP BY vec_id""")
def effective_bandwidth(spark, d):
    return round4(spectra.bandwidth(frames(spark, d), 32, -10.0), "aliasing_level_db")


STRONGEST = """, h AS (SELECT vec_id, bin, mag, first_value(bin) OVER (PARTITION BY vec_id ORDER BY mag DESC, bin) AS f0 FROM spec WHERE bin > 0)"""


@query("harmonic_tension", views("spec") + STRONGEST + """
SELECT vec_id, f0 AS f0_bin, round(1 - coalesce(sum(mag * mag) FILTER (WHERE abs(bin - round(bin / f0) * f0) <= 1 AND round(bin / f0) BETWEEN 1 AND 9), 0) / sum(mag * mag), 4) AS harmonic_tension FROM h GROUP BY ALL""")
def harmonic_tension(spark, d):
    return round4(spectra.harmonic_tension(frames(spark, d)), "harmonic_tension")


@query("inharmonicity", views("spec") + STRONGEST + """
, n AS (SELECT vec_id, f0, k, first(bin ORDER BY mag DESC, bin) AS peak FROM h, range(2, 8) AS r(k) WHERE abs(bin - k * f0) <= 2 GROUP BY ALL)
SELECT vec_id, round(avg(abs(peak / (k * f0) - 1)), 4) AS inharmonicity FROM n GROUP BY vec_id""")
def inharmonicity(spark, d):
    return round4(spectra.inharmonicity(frames(spark, d)), "inharmonicity")


@query("acoustic_fingerprint", views("spec") + """
, m AS (SELECT label, vec_id, bin, mag * mag > avg(mag * mag) OVER (PARTITION BY vec_id) AS b FROM spec)
SELECT label, count(*) AS bits, sha256(string_agg(CASE WHEN b THEN '1' ELSE '0' END, '' ORDER BY vec_id, bin)) AS fingerprint_sha256 FROM m WHERE bin % 2 = 0 GROUP BY label""")
def acoustic_fingerprint(spark, d):
    return spectra.fingerprint(frames(spark, d))


@query("dft_bin", views("sig") + """
, s AS (SELECT channel, count(*) AS n, sum(x * cos(2 * pi() * 0.125 * frame)) AS re, sum(-x * sin(2 * pi() * 0.125 * frame)) AS im FROM sig GROUP BY channel)
SELECT channel, round(2 * sqrt(re * re + im * im) / n, 4) AS amplitude, round(atan2(im, re), 4) AS phase FROM s""")
def dft_bin(spark, d):
    return round4(spectra.dft_bin(events_signal(spark, d), 0.125), "amplitude", "phase")


@query("peak_level", views("sig") + """
SELECT channel, round(20 * log10(greatest(max(abs(x)) / 400.0, 1e-12)), 4) AS peak_db, round(max(abs(x)) / nullif(sqrt(avg(x * x)), 0), 4) AS crest FROM sig GROUP BY channel""")
def peak_level(spark, d):
    s = levels.channel_summary(events_signal(spark, d), RATE)
    return round4(s.select("channel", db(F.col("peak") / 400.0).alias("peak_db"), F.try_divide("peak", "rms").alias("crest")), "peak_db", "crest")

"""Audio analysis by profile: chunk rows to findings, every selected analyzer a DataFrame, their union one plan.

An analyzer is a function of (chunks, parameters) to (file_id, value, status, and what else it says). Which
files it applies to is an expression on their headers; other files get a row that says so, and files that
it applies to but finds nothing in are not applicable as well: none is left out silently.

An analyzer that fails on a file, or takes too long over one of its chunks, gives that file an error row; its
other files and all other analyzers stay as they are.
"""

from __future__ import annotations

import runpy
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.functions.columns import db, lufs
from tonegrid.operators import alignment, envelopes, events, kernels, layouts, levels, policy, spectra, voices
from tonegrid.sources.audio import audio_headers, scan_audio
from tonegrid.sources.wav import channels_of, mono, subjects


class Analyzer(NamedTuple):
    """What an analyzer measures; ``parameters`` are names with their defaults, None for a number without one."""

    run: Callable[[DataFrame, dict], DataFrame]
    check_id: str
    metric: str
    unit: str
    method: str
    applicable: str
    parameters: dict


ANALYZERS: dict[str, Analyzer] = {}
#: How sure each analyzer's findings are. pitch_f0 says so by itself.
CONFIDENCE = {
    "inspect": 1.0, "loudness": 0.95, "lra": 0.9, "true_peak": 0.97, "clipping": 0.99, "mono_compat": 0.9, "channel_balance": 0.92, "goniometer": 0.9, "binaural_compat": 0.75, "drn": 0.85,
    "acoustic_context": 0.75, "glitch": 0.85, "loop": 0.95, "transient": 0.75, "resampling": 0.7, "voice_artifacts": 0.65, "speech_rate": 0.6, "rhythmic_grid_alignment": 0.55, "pitch_stab": 0.7, "speech_intelligibility": 0.7, "deepfake": 0.3, "acoustic_fingerprint": 0.9, "spectral_health": 0.9, "spectral_irregularity": 0.85, "timbre_distance": 0.8, "harmonic_tension": 0.6, "inharmonicity": 0.65, "fatigue_index": 0.6, "melodic_contour": 0.6,
    "codec_conf": 0.85, "spatial_coherence": 0.8, "ref_quality": 0.8, "enf_phase": 0.5,
}
#: Analyzers added by plugins: functions of (good chunks, parameters) to findings, with the parameters they take.
REGISTRY: dict[str, tuple[Callable[[DataFrame, dict], DataFrame], tuple[str, ...]]] = {}


def analyzer(name: str, check_id: str, metric: str, unit: str, method: str, applicable: str = "frames > 0", **parameters):
    def add(run):
        ANALYZERS[name] = Analyzer(run, check_id, metric, unit, method, applicable, parameters)
        return run

    return add


def register(name: str, *parameters: str):
    """Decorator: makes a function of (chunks, params) an analyzer; its findings join all others."""
    if not name or name in ANALYZERS or name in REGISTRY:
        raise ValueError(f"no name, or one that is taken: {name!r}")

    def add(run):
        REGISTRY[name] = (run, parameters)
        return run

    return add


def load_plugin(path: str) -> None:
    """Runs a Python file, whose functions register themselves. Plugins build plans on the driver; nothing of them runs unasked."""
    runpy.run_path(path)


def known_parameters() -> dict[str, dict]:
    """The parameters of each analyzer and their defaults."""
    return {name: a.parameters for name, a in ANALYZERS.items()} | {name: dict.fromkeys(parameters) for name, (_, parameters) in REGISTRY.items()}


def warn(bad: Column) -> Column:
    return F.when(bad, "warning").otherwise("pass")


def passes() -> Column:
    return F.lit("pass")


@analyzer("inspect", "inspect.metadata", "metadata", "s", "WAV header")
def inspect(chunks: DataFrame, params: dict) -> DataFrame:
    return subjects(chunks).select("file_id", F.col("duration_s").alias("value"), passes().alias("status"))


@analyzer("loudness", "loudness.integrated", "integrated_loudness", "LUFS", "gated K-weighted blocks", min_lufs=-24.0, max_lufs=-16.0)
def loudness(chunks: DataFrame, params: dict) -> DataFrame:
    loud = kernels.integrated_loudness(kernels.block_loudness(chunks))
    return loud.select("file_id", F.col("lufs").alias("value"), warn(~F.col("lufs").between(params["min_lufs"], params["max_lufs"])).alias("status"))


@analyzer("lra", "lra.range", "loudness_range", "LU", "percentiles of gated 3 s blocks", min_lu=None, max_lu=None)
def loudness_range(chunks: DataFrame, params: dict) -> DataFrame:
    blocks = kernels.block_loudness(chunks, 3.0, 1.0).select(F.col("file_id").alias("channel"), F.col("lufs").alias("l"))
    spread = levels.range_of_levels(blocks).withColumnRenamed("channel", "file_id")
    spread = subjects(chunks).select("file_id").join(spread, "file_id", "left").select("file_id", F.coalesce("lra", F.lit(0.0)).alias("value"))
    out = reduce(lambda a, b: a | b, [F.lit(False), *([F.col("value") < params["min_lu"]] if params["min_lu"] is not None else []), *([F.col("value") > params["max_lu"]] if params["max_lu"] is not None else [])])
    return spread.withColumn("status", warn(out))


@analyzer("true_peak", "true_peak.measurement", "true_peak", "dBTP", "four times oversampled", max_dbtp=-1.0)
def true_peak(chunks: DataFrame, params: dict) -> DataFrame:
    peak = kernels.true_peak(chunks)
    return peak.select("file_id", F.col("dbtp").alias("value"), F.when(F.col("dbtp") > params["max_dbtp"], "fail").otherwise("pass").alias("status"))


@analyzer("clipping", "clipping.samples", "clipped_sample_pct", "%", "share of frames at the threshold", threshold=0.99, max_clipped_pct=0.01)
def clipping(chunks: DataFrame, params: dict) -> DataFrame:
    """Only the frames at the threshold become rows; a frame counts once, in however many channels it is."""
    at = F.array_compact(F.transform("samples", lambda v, i: F.when(F.abs(v).cast("double") >= params["threshold"], F.col("start") + i)))
    over = channels_of(chunks).select("file_id", F.explode(at).alias("frame")).distinct().groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    share = subjects(chunks).join(over, "file_id", "left").select("file_id", (100.0 * F.coalesce("n", F.lit(0)) / F.col("frames")).alias("value"))
    return share.withColumn("status", F.when(F.col("value") > params["max_clipped_pct"], "fail").otherwise(warn(F.col("value") > 0)))


#: The bands of mono compatibility, in hertz.
MONO_BANDS = ((20, 120), (120, 400), (400, 1200), (1200, 4000), (4000, 12000), (12000, 20000))


@analyzer("mono_compat", "mono_compat.band_loss", "max_band_loss", "dB", "loss of the mono sum against the louder channel, by Butterworth bands", "channels = 2", max_loss_db=6.0)
def mono_compat(chunks: DataFrame, params: dict) -> DataFrame:
    squares = kernels.band_squares(chunks.where("channels = 2"), MONO_BANDS)
    level = lambda mine: F.max(F.when(mine, 20 * F.log10(F.sqrt("ms") + 1e-12)))
    per = squares.groupBy("file_id", "band").agg((level(F.col("channel") >= 0) - level(F.col("channel") < 0)).alias("loss"))
    worst = per.groupBy("file_id").agg(F.greatest(F.lit(0.0), F.max("loss")).alias("value"))
    return worst.withColumn("status", warn(F.col("value") >= params["max_loss_db"]))


@analyzer("channel_balance", "channel_balance.lr", "delta_lufs", "LU", "K-weighted level of left against right", "channels = 2", max_delta_lufs=1.0, max_delta_rms_db=2.0)
def channel_balance(chunks: DataFrame, params: dict) -> DataFrame:
    weighted = kernels.band_squares(channels_of(chunks).where("channels = 2"), (kernels.K_BAND,)).groupBy("file_id")
    weighted = weighted.agg(*[F.max(F.when(F.col("channel") == c, F.col("ms"))).alias(n) for c, n in ((0, "kl"), (1, "kr"))])
    both = weighted.join(kernels.stereo_moments(chunks), "file_id")
    loud, rms = F.abs(lufs(F.col("kl")) - lufs(F.col("kr"))), F.abs(db(F.sqrt("ll")) - db(F.sqrt("rr")))
    return both.select("file_id", loud.alias("value"), warn((loud > params["max_delta_lufs"]) | (rms > params["max_delta_rms_db"])).alias("status"))


@analyzer("goniometer", "goniometer.statistics", "mean_correlation", "", "correlation of left and right", "channels = 2")
def goniometer(chunks: DataFrame, params: dict) -> DataFrame:
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("ll") - F.col("ml") * F.col("ml")) * F.greatest(F.lit(0.0), F.col("rr") - F.col("mr") * F.col("mr")))
    value = F.coalesce(F.try_divide(F.col("lr") - F.col("ml") * F.col("mr"), F.when(spread > 1e-12, spread)), F.lit(0.0))
    return kernels.stereo_moments(chunks).select("file_id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)).alias("value"), passes().alias("status"))


@analyzer("binaural_compat", "binaural_compat.lateral_low", "lateral_low_energy_db", "dB", "side against mid under 200 Hz", "channels = 2", max_lateral_low_db=-20.0)
def binaural_compat(chunks: DataFrame, params: dict) -> DataFrame:
    low = kernels.band_squares(chunks.where("channels = 2"), ((None, 200.0),))
    per = low.groupBy("file_id").agg(F.sum(F.when(F.col("channel") >= 0, F.col("ms"))).alias("both"), F.max(F.when(F.col("channel") < 0, F.col("ms"))).alias("mid"))
    side = F.sqrt(F.greatest(F.lit(0.0), F.col("both") / 2 - F.col("mid")))
    value = 20 * F.log10((side + 1e-12) / (F.sqrt("mid") + 1e-12))
    return per.select("file_id", value.alias("value"), warn(value > params["max_lateral_low_db"]).alias("status"))


@analyzer("drn", "drn.measurement", "dr14_db", "dB", "peak over RMS of the loudest fifth of 3 s blocks", "frames >= 3 * sample_rate", dr_min_db=None)
def dynamic_range(chunks: DataFrame, params: dict) -> DataFrame:
    size, hop = kernels.seconds(3.0), lambda rate: int(3.0 * rate) // 2
    blocks = [kernels.per_frame(mono(chunks), size, hop, of, 16).select("file_id", "frame", F.col("value").alias(n)) for n, of in (("rms", lambda x, rate: (x * x).mean(1) ** 0.5), ("peak", lambda x, rate: abs(x).max(1)))]
    heard = blocks[0].join(blocks[1], ["file_id", "frame"]).where("rms > 1e-12")
    of_file = Window.partitionBy("file_id")
    ranked = heard.withColumn("rank", F.row_number().over(of_file.orderBy(F.col("rms").desc(), "frame"))).withColumn("n", F.count(F.lit(1)).over(of_file))
    top = ranked.where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") / 5)))
    out = top.groupBy("file_id").agg(F.greatest(F.lit(0.0), 20 * F.log10(F.avg("peak") / F.avg("rms"))).alias("value"))
    return out.withColumn("status", passes() if params["dr_min_db"] is None else warn(F.col("value") < params["dr_min_db"]))


def angles(x: np.ndarray, rate: int) -> np.ndarray:
    """Degrees between the level spectra of each frame and of the next one, which lies a hop further on in the same row."""
    def shape(frames: np.ndarray) -> np.ndarray:
        level = 20 * np.log10(np.abs(np.fft.rfft(frames * kernels.periodic_hann(SCENE[0]), axis=1)) + 1e-12)
        return level / (np.linalg.norm(level, axis=1, keepdims=True) + 1e-12)

    near = shape(np.concatenate((x[:, : SCENE[0]], x[-1:, SCENE[1] :])))
    return np.degrees(np.arccos(np.clip((near[1:] * near[:-1]).sum(1), -1.0, 1.0)))


#: Frame and hop of scenes.
SCENE = (2048, 512)


@analyzer("acoustic_context", "acoustic_context.noise_floor", "noise_floor_db", "dB", "spectral angle, backward integration, 10th percentile of 50 ms RMS", "frames >= 4096", scene_change_threshold_deg=30.0, max_rt60_s=2.0)
def acoustic_context(chunks: DataFrame, params: dict) -> DataFrame:
    """Three findings a file: scene changes, reverberation and noise floor."""
    signals, files = mono(chunks), subjects(chunks).select("file_id", "frames", "sample_rate")
    changes = kernels.per_frame(signals, lambda rate: sum(SCENE), lambda rate: SCENE[1], angles).groupBy("file_id").agg(F.count_if(F.col("value") > params["scene_change_threshold_deg"]).cast("double").alias("value"))
    scenes = files.join(changes, "file_id", "left").select("file_id", F.coalesce("value", F.lit(0.0)).alias("value"))
    decay = files.join(events.decay_time(signals), "file_id", "left").select("file_id", F.when(F.col("frames") >= F.col("sample_rate"), F.coalesce("rt60", F.lit(0.0))).otherwise(0.0).alias("value"))
    rms = kernels.per_frame(signals, kernels.seconds(0.05), kernels.seconds(0.05), lambda x, rate: (x * x).mean(1) ** 0.5).where("value > 1e-12")
    floor = files.join(rms.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), (20 * F.log10(F.percentile("value", 0.1) + 1e-12)).alias("floor")), "file_id", "left")
    floor = floor.select("file_id", F.coalesce("floor", F.lit(-120.0)).alias("value"))
    said = (
        (scenes, "acoustic_context.scene_changes", "scene_change_count", "events", warn(F.col("value") > 0), 0.7),
        (decay, "acoustic_context.rt60", "reverberation_time", "s", warn(F.col("value") > params["max_rt60_s"]), 0.6),
        (floor, "acoustic_context.noise_floor", "noise_floor_db", "dB", passes(), 0.75),
    )
    return reduce(DataFrame.unionByName, [df.select("file_id", "value", status.alias("status"), *[F.lit(v).alias(n) for n, v in (("check_id", check), ("metric", metric), ("unit", unit), ("confidence", sure))]) for df, check, metric, unit, status, sure in said])


@analyzer("glitch", "glitch.summary", "glitch_event_count", "events", "second differences, silent runs in loud surroundings, repeated blocks", click_sensitivity=6.0, dropout_min_ms=10.0, dropout_threshold=0.001, repeat_min_samples=32, min_events_for_warning=1)
def glitch(chunks: DataFrame, params: dict) -> DataFrame:
    """A warning for each channel with events; a file without any passes."""
    channels = channels_of(chunks)
    found = events.clicks(channels, params["click_sensitivity"]).select("file_id", "channel", F.lit(1).alias("n"))
    found = found.union(events.dropouts(channels, params["dropout_threshold"], params["dropout_min_ms"]).select("file_id", "channel", F.lit(1).alias("n")))
    found = found.union(events.repetitions(channels, params["repeat_min_samples"]).select("file_id", "channel", "n"))
    per = found.groupBy("file_id", "channel").agg(F.sum("n").alias("n"))
    both = subjects(chunks).select("file_id").join(per, "file_id", "left")
    some = F.col("n").isNotNull()
    return both.select(
        "file_id", F.coalesce("n", F.lit(0)).cast("double").alias("value"), warn(some).alias("status"), F.when(some, F.concat(F.lit("glitch.channel_"), F.col("channel"))).otherwise("glitch.summary").alias("check_id"),
        F.when(some, F.concat(F.col("n"), F.lit(" glitch events on channel "), F.col("channel"))).otherwise("no glitches detected").alias("message"), F.when(some, 0.85).otherwise(0.95).alias("confidence"),
    )


@analyzer("loop", "loop.point", "loop_amplitude_jump", "amplitude", "step and slope from the loop's end to its beginning", amplitude_threshold=0.05, derivative_threshold=0.1, loop_point_ms=None, loop_point_samples=None)
def loop(chunks: DataFrame, params: dict) -> DataFrame:
    """A row for each channel; without a loop point, or with one outside of the file, there is none."""
    ms, point = params["loop_point_ms"], params["loop_point_samples"]
    at = F.lit(point).cast("long") if point is not None else F.floor(F.col("sample_rate") * F.lit(ms).cast("double") / 1000.0)
    of = lambda frame: F.max(F.when((frame >= F.col("start")) & (frame < F.col("start") + F.size("samples")), F.try_element_at("samples", (frame - F.col("start") + 1).cast("int")).cast("double")))
    places = {"last": at - 1, "before": at - 2, "first": F.lit(0), "second": F.lit(1)}
    asked = channels_of(chunks).where((at > 1) & (at <= F.col("frames")))
    ends = asked.groupBy("file_id", "channel").agg(*[of(p).alias(n) for n, p in places.items()])
    jump, turn = F.abs(F.col("last") - F.col("first")), F.abs((F.col("last") - F.col("before")) - (F.col("second") - F.col("first")))
    bad = (jump > params["amplitude_threshold"]) | (turn > params["derivative_threshold"])
    return ends.select("file_id", F.round(jump, 5).alias("value"), F.when(bad, "fail").otherwise("pass").alias("status"), F.concat(F.lit("loop.channel_"), F.col("channel")).alias("check_id"))


@analyzer("transient", "transient.smearing", "attack_time_ms", "ms", "onsets of the envelope, time from 10 to 90 % of the peak", "frames >= 1024", max_attack_ms=5.0)
def transient(chunks: DataFrame, params: dict) -> DataFrame:
    attacks = events.onset_attacks(mono(chunks))
    none = F.when(F.col("worst").isNull(), "onsets found but attack time undetermined")
    return attacks.select("file_id", F.round("worst", 3).alias("value"), F.when(F.col("worst").isNull(), "not_applicable").otherwise(warn(F.col("worst") > params["max_attack_ms"])).alias("status"), none.alias("message"))


@analyzer("resampling", "resampling.artifacts", "aliasing_level_db", "dB", "level about a quarter of the rate against that well below it", "frames >= 1024", aliasing_threshold_db=-60.0, bandwidth_drop_db=-30.0)
def resampling(chunks: DataFrame, params: dict) -> DataFrame:
    rates = subjects(chunks).select("file_id", (F.col("sample_rate") / 4.0).alias("quarter"))
    power = kernels.segment_power(chunks, 4096, padded=True).join(rates, "file_id")
    mean = lambda inside: F.avg(F.when(inside, F.col("power")))
    level = 10 * F.log10((mean((F.col("hz") > 0.9 * F.col("quarter")) & (F.col("hz") < 1.1 * F.col("quarter"))) + 1e-12) / (mean(F.col("hz") < 0.5 * F.col("quarter")) + 1e-12))
    width = F.max(F.when(10 * F.log10(F.col("power") + 1e-12) > params["bandwidth_drop_db"], F.col("hz")).otherwise(0.0))
    per = power.groupBy("file_id").agg(F.round(level, 2).alias("value"), width.alias("width"), F.first("quarter").alias("quarter"))
    bad = F.col("value") > params["aliasing_threshold_db"]
    said = F.when(bad, F.format_string("possible aliasing at %.0f Hz", "quarter")).otherwise(F.format_string("no significant aliasing, effective bandwidth %.0f Hz", "width"))
    return per.select("file_id", "value", warn(bad).alias("status"), said.alias("message"))


def bursts(x: np.ndarray, rate: int, sibilance_db: float, plosive_db: float) -> np.ndarray:
    """How many of the two kinds of bursts each frame of 1024 samples is: sibilance at 5 to 10 kHz, a plosive at 80 to 300 Hz."""
    hz, mag = np.fft.rfftfreq(1024, 1 / rate), np.abs(np.fft.rfft(x * kernels.periodic_hann(1024), axis=1))
    total, out = mag.mean(1) + 1e-12, np.zeros(len(x))
    for low, high, limit in ((5000, 10_000, sibilance_db), (80, 300, plosive_db)):
        band = mag[:, (hz >= low) & (hz <= high)]
        out += 10 * np.log10(((band.mean(1) if band.shape[1] else 0.0) + 1e-12) / total) > limit
    return out


@analyzer("voice_artifacts", "voice_artifacts.objective", "artifact_frame_count", "frames", "bursts in the bands of sibilants and plosives", "frames >= 2048", sibilance_threshold_db=6.0, plosive_threshold_db=10.0)
def voice_artifacts(chunks: DataFrame, params: dict) -> DataFrame:
    sibilance, plosive = params["sibilance_threshold_db"], params["plosive_threshold_db"]
    frames = kernels.per_frame(mono(chunks), lambda rate: 1024, lambda rate: 256, lambda x, rate: bursts(x, rate, sibilance, plosive))
    return frames.groupBy("file_id").agg(F.sum("value").alias("value")).withColumn("status", warn(F.col("value") > 0))


@analyzer("speech_rate", "speech_rate.syllables", "syllables_per_second", "syl/s", "fluctuation of the analytic envelope at 2 to 7 Hz", "frames >= sample_rate", max_syllables_per_sec=7.0)
def speech_rate(chunks: DataFrame, params: dict) -> DataFrame:
    rate = envelopes.syllable_rate(mono(chunks))
    return rate.select("file_id", F.round("value", 2).alias("value"), warn(F.col("value") > params["max_syllables_per_sec"]).alias("status"))


@analyzer("rhythmic_grid_alignment", "rhythmic_grid.descriptor", "rhythmic_grid_alignment", "0-1", "variation of the intervals between rises of the analytic envelope", "frames >= 2 * sample_rate")
def rhythmic_grid(chunks: DataFrame, params: dict) -> DataFrame:
    return envelopes.grid_alignment(mono(chunks)).select("file_id", F.round("value", 4).alias("value"), passes().alias("status"))


@analyzer("spectral_health", "spectral_health.descriptors", "spectral_centroid", "Hz", "mean magnitude spectrum", "frames >= 256", n_fft=2048, hop=512)
def spectral_health(chunks: DataFrame, params: dict) -> DataFrame:
    spectrum = kernels.mean_spectrum(chunks, params["n_fft"], params["hop"])
    rates = spectrum.groupBy(F.col("file_id").alias("vec_id")).agg(F.max("sample_rate").alias("rate"))
    health = spectra.spectral_health(spectrum.withColumnRenamed("file_id", "vec_id")).join(rates, "vec_id")
    return health.select(F.col("vec_id").alias("file_id"), (F.coalesce("centroid", F.lit(0.0)) * F.col("rate") / params["n_fft"]).alias("value"), passes().alias("status"))


@analyzer("timbre_distance", "timbre_distance.descriptor", "timbre_distance", "0-1", "cosine of the mean spectra of the first and the last third", "frames >= 8192")
def timbre_distance(chunks: DataFrame, params: dict) -> DataFrame:
    of = lambda part: F.max(F.when(F.col("part") == part, F.col("mag")))
    bins = kernels.spectrum_sums(mono(chunks), parts=("first", "last")).groupBy("file_id", "bin").agg(of("first").alias("a"), of("last").alias("b"))
    norm = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c))) + 1e-12
    distance = 1 - F.sum(F.col("a") * F.col("b")) / (norm("a") * norm("b"))
    return bins.groupBy("file_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), distance)).alias("value")).withColumn("status", passes())


@analyzer("spectral_irregularity", "spectral_irregularity.descriptor", "spectral_irregularity", "0-1", "mean step between bins over mean magnitude", "frames >= 2048")
def irregularity(chunks: DataFrame, params: dict) -> DataFrame:
    out = spectra.irregularity(kernels.mean_spectrum(chunks).withColumnRenamed("file_id", "vec_id"))
    return out.select(F.col("vec_id").alias("file_id"), F.col("irregularity").alias("value"), passes().alias("status"))


def median_pitch(chunks: DataFrame, least: int = 4) -> DataFrame:
    """(file_id, f0) of files with enough voiced frames."""
    voiced = kernels.tracked(chunks).where(~F.isnan("f0")).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.percentile("f0", 0.5).alias("f0"))
    return voiced.where(F.col("n") >= least).drop("n")


@analyzer("harmonic_tension", "harmonic_tension.descriptor", "harmonic_tension", "0-1", "energy beside the harmonics of the median pitch", "frames >= 4096")
def harmonic_tension(chunks: DataFrame, params: dict) -> DataFrame:
    spectrum = kernels.mean_spectrum(chunks).join(median_pitch(chunks), "file_id")
    width = F.col("sample_rate") / 2048
    beside = F.exists(F.sequence(F.lit(1), F.lit(9)), lambda h: (h * F.col("f0") <= F.col("sample_rate") / 2) & (F.abs(F.col("bin") - F.ceil(h * F.col("f0") / width - 0.5)) <= 1))
    e = F.col("mag") * F.col("mag")
    value = 1 - F.sum(F.when(beside, e).otherwise(0.0)) / (F.sum(e) + 1e-12)
    return spectrum.groupBy("file_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("value")).withColumn("status", passes())


@analyzer("inharmonicity", "inharmonicity.descriptor", "inharmonicity", "0-1", "distance of the partials from the multiples of the median pitch", "frames >= 4096")
def inharmonicity(chunks: DataFrame, params: dict) -> DataFrame:
    asked = median_pitch(chunks).select("file_id", F.explode(F.transform(F.sequence(F.lit(2), F.lit(7)), lambda h: h * F.col("f0"))).alias("at"))
    near = kernels.segment_power(chunks, 8192).join(asked, "file_id").where(F.abs(F.col("hz") - F.col("at")) <= 5.0)
    partials = near.groupBy("file_id", "at").agg(F.max_by("hz", F.struct("power", -F.col("hz"))).alias("peak"))
    value = F.avg(F.abs(F.col("peak") - F.col("at")) / F.col("at"))
    return partials.groupBy("file_id").agg(F.least(F.lit(1.0), value).alias("value")).withColumn("status", passes())


@analyzer("fatigue_index", "fatigue_index.descriptor", "fatigue_index", "0-1", "loss of energy from 4 kHz on, last third against first", "frames >= 8192")
def fatigue(chunks: DataFrame, params: dict) -> DataFrame:
    of = lambda part: F.sum(F.when((F.col("part") == part) & (F.col("hz") >= 4000), F.col("power")))
    per = kernels.segment_power(chunks, 2048, ("first", "last")).groupBy("file_id").agg(of("first").alias("a"), of("last").alias("b"))
    return per.where("a > 0").select("file_id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.col("b") / F.col("a"))).alias("value"), passes().alias("status"))


@analyzer("melodic_contour", "melodic_contour.descriptor", "melodic_contour_direction", "enum", "slope and range of the pitch track", "frames >= sample_rate")
def melodic_contour(chunks: DataFrame, params: dict) -> DataFrame:
    voiced = kernels.tracked(chunks).where(~F.isnan("f0")).withColumn("t", F.row_number().over(Window.partitionBy("file_id").orderBy("frame")).cast("double"))
    per = voiced.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("f0", "t").alias("slope"), (12 * F.log2(F.max("f0") / F.min("f0"))).alias("range"))
    direction = F.when(F.col("slope") > 5, "rising").when(F.col("slope") < -5, "falling").otherwise("static")
    said = F.concat(F.lit("melodic contour: "), direction, F.lit(", range "), F.format_string("%.1f", "range"), F.lit(" semitones"))
    return per.where("n >= 8").select("file_id", F.lit(None).cast("double").alias("value"), passes().alias("status"), said.alias("message"))


@analyzer("pitch_f0", "pitch_f0.median", "f0_median_hz", "Hz", "YIN", "4 * frames >= sample_rate", fmin=60.0, fmax=500.0)
def pitch(chunks: DataFrame, params: dict) -> DataFrame:
    f0 = kernels.fundamental(chunks, params["fmin"], params["fmax"])
    return f0.select("file_id", F.col("median_hz").alias("value"), "status", F.round("voiced_share", 3).alias("confidence"))


@analyzer("pitch_stab", "pitch_stab.drift", "pitch_drift_cents", "cents", "range and modulation spectrum of the pitch track", "frames >= sample_rate", max_drift_cents=50.0)
def pitch_stability(chunks: DataFrame, params: dict) -> DataFrame:
    per = voices.pitch_stability(mono(chunks))
    said = F.format_string("pitch drift %.1f cents, wow %.3f dB, flutter %.3f dB", "drift_cents", "wow_db", "flutter_db")
    return per.select("file_id", F.round("drift_cents", 2).alias("value"), warn(F.col("drift_cents") > params["max_drift_cents"]).alias("status"), said.alias("message"))


@analyzer("speech_intelligibility", "speech_intelligibility.proxy", "stoi_proxy_no_ref", "0-1", "level of speech over silence, and the share of the speech band", "frames >= 2048", min_score=0.6)
def speech_intelligibility(chunks: DataFrame, params: dict) -> DataFrame:
    score = voices.intelligibility(chunks, mono(chunks))
    return score.select("file_id", F.round("score", 4).alias("value"), F.when(F.isnan("score"), "indeterminate").otherwise(warn(F.col("score") < params["min_score"])).alias("status"))


@analyzer("deepfake", "deepfake.features", "synthetic_likeness_score", "0-1", "regularity of pitch, coherence of phases, flatness from 4 to 8 kHz; no model", "frames >= 2 * sample_rate", enabled=False, model_name="", model_version="", corpus="")
def synthetic_likeness(chunks: DataFrame, params: dict) -> DataFrame:
    """Only where a profile enables it and names a model; always for a person to review."""
    if not params["enabled"] or not params["model_name"]:
        return subjects(chunks).where("false").select("file_id", F.lit(None).cast("double").alias("value"), passes().alias("status"))
    score = voices.synthetic_likeness(chunks, mono(chunks))
    said = F.format_string("synthetic-likeness %.3f: needs a person's review; a heuristic feature, no classification", "score")
    return score.select("file_id", F.round("score", 4).alias("value"), F.lit("needs_review").alias("status"), said.alias("message"))


@analyzer("acoustic_fingerprint", "acoustic_fingerprint.hash", "fingerprint_sha256", "hex", "bits of spectral power over its mean, hashed in order", "frames >= 4096")
def acoustic_fingerprint(chunks: DataFrame, params: dict) -> DataFrame:
    prints = voices.fingerprint(mono(chunks))
    said = F.concat(F.lit("acoustic fingerprint: "), F.col("sha256"))
    return prints.select("file_id", F.lit(None).cast("double").alias("value"), passes().alias("status"), said.alias("message"))


def no_value() -> Column:
    return F.lit(None).cast("double")


@analyzer("codec_conf", "codec_conf.check", "compliance_status", "enum", "declared frames against decoded ones", "frames IS NOT NULL", frame_tolerance_pct=1.0)
def codec_conformance(chunks: DataFrame, params: dict) -> DataFrame:
    decoded = channels_of(chunks).where("channel = 0").groupBy("file_id").agg(F.sum(F.size("samples")).alias("decoded"))
    both = subjects(chunks).join(decoded, "file_id", "left").withColumn("off", F.coalesce(100.0 * F.abs(F.col("frames") - F.coalesce("decoded", F.lit(0))) / F.when(F.col("frames") > 0, F.col("frames")), F.lit(0.0)))
    count = F.when(F.col("off") > params["frame_tolerance_pct"], F.format_string("declared %d frames against %d decoded (%.2f%%)", "frames", F.coalesce("decoded", F.lit(0)), "off"))
    depth = F.when(F.coalesce("bit_depth", F.lit(0)) == 0, "unknown bit depth")
    said = F.concat_ws("; ", count, depth)
    return both.select("file_id", no_value().alias("value"), warn(said != "").alias("status"), F.when(said != "", said).otherwise("what the file declares is what it holds").alias("message"))


@analyzer("spatial_coherence", "spatial_coherence.correlation", "max_off_diag_correlation", "0-1", "correlation of all pairs of channels", "channels >= 2", max_off_diag_corr=0.95)
def spatial_coherence(chunks: DataFrame, params: dict) -> DataFrame:
    best = layouts.most_alike(layouts.channel_moments(chunks.where("channels >= 2")))
    said = F.format_string("channels %d and %d correlate most, at %.3f", "a", "b", "value")
    return best.select("file_id", F.round("value", 4).alias("value"), warn(F.col("value") > params["max_off_diag_corr"]).alias("status"), said.alias("message"))


@analyzer("multichannel_layout", "multichannel_layout.lfe", "lfe_low_freq_energy_pct", "%", "low-frequency channel, sum of left and right, centre", "channels IN (6, 8)")
def multichannel_layout(chunks: DataFrame, params: dict) -> DataFrame:
    """Three findings a file: what its low-frequency channel holds, and whether left with right, and the centre, are silent."""
    multi = chunks.where("channels IN (6, 8)")
    moments = events.kept(layouts.channel_moments(multi).where("(a = 0 AND b = 1) OR (a = 2 AND b = 2)"))
    low = layouts.low_share(multi).select("file_id", F.round("low_pct", 2).alias("value"), warn(F.col("low_pct") < 80.0).alias("status"), F.lit("multichannel_layout.lfe").alias("check_id"), F.lit("lfe_low_freq_energy_pct").alias("metric"), F.lit("%").alias("unit"))
    out = low
    for check, metric, place, squares, least, digits in (
        ("stereo_compat", "stereo_downmix_energy", "a = 0", F.col("saa") + F.col("sbb") + 2 * F.col("sab"), 1e-8, 4),
        ("center", "center_channel_energy", "a = 2", F.col("saa"), 1e-6, 6),
    ):
        rms = layouts.root_mean(squares, F.col("n"))
        silent = rms <= least if check == "stereo_compat" else rms < least
        out = out.unionByName(moments.where(place).select("file_id", F.round(rms, digits).alias("value"), warn(silent).alias("status"), F.lit(f"multichannel_layout.{check}").alias("check_id"), F.lit(metric).alias("metric"), F.lit("rms").alias("unit")))
    return out


#: Metric, unit and least score of each mode of reference quality, and the column of :func:`alignment.scores` that it reports.
REFERENCE_MODES = {"speech-full-ref": ("stoi_proxy", "0-1", 0.6, "envelope"), "audio-full-ref": ("visqol_proxy", "MOS", 3.5, "spectral"), "source-sep-ref": ("si_sdr_db", "dB", 5.0, "ratio_db")}


def same(chunks: DataFrame, status: str, message: str | Column, check_id: str, metric: str, unit: str) -> DataFrame:
    """One finding without a value for every file."""
    said = F.lit(message) if isinstance(message, str) else message
    return subjects(chunks).select("file_id", no_value().alias("value"), F.lit(status).alias("status"), said.alias("message"), F.lit(check_id).alias("check_id"), F.lit(metric).alias("metric"), F.lit(unit).alias("unit"))


def unreadable(spark, path: str, sha256: str = "") -> tuple[str, str] | None:
    """(check, message) if a reference can't be read, or isn't the one that was declared: one row of its header comes to the driver."""
    try:
        head = audio_headers(spark, path).select("error", "file_sha256").head()
    except Exception as error:  # a path that isn't there
        return "decode_error", f"could not decode reference: {type(error).__name__}"
    if sha256 and head is not None and head["file_sha256"] != sha256:
        return "hash_mismatch", f"reference hash mismatch: declared {sha256[:12]}, found {head['file_sha256'][:12]}"
    if head is None or head["error"]:
        return "decode_error", f"could not decode reference: {head['error'] if head else 'no such file'}"
    return None


def compared(chunks: DataFrame, paths: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(signals, chunks of the pairs of each signal and each reference), references at the files' sample rates."""
    spark, signals = chunks.sparkSession, mono(chunks).where("frames > 0")
    rates = [r[0] for r in signals.select("sample_rate").distinct().collect()]  # as many as there are sample rates
    references = alignment.references_at(lambda path, rate: scan_audio(spark, path, resample=rate), paths, rates or [1])
    return signals, alignment.paired(signals, references)


@analyzer("ref_quality", "ref_quality.indeterminate", "quality_score", "score", "similarity with a reference aligned by cross-correlation", "frames IS NOT NULL", mode="no-reference", reference_path="", reference_sha256="", min_score=None)
def reference_quality(chunks: DataFrame, params: dict) -> DataFrame:
    """Against one reference, in one of three modes; without it there is nothing to tell."""
    mode, path = params["mode"], params["reference_path"]
    if mode == "no-reference" or not path:
        return same(chunks, "indeterminate", "without a reference there is no metric against one", "ref_quality.indeterminate", "quality_score", "score")
    if wrong := unreadable(chunks.sparkSession, path, params["reference_sha256"]):
        return same(chunks, "error", wrong[1], f"ref_quality.{wrong[0]}", "quality_score", "score")
    if mode not in REFERENCE_MODES:
        return same(chunks, "not_applicable", f"unknown mode: {mode}", "ref_quality.unknown_mode", "quality_score", "score")
    metric, unit, least, column = REFERENCE_MODES[mode]
    least = least if params["min_score"] is None else params["min_score"]
    pairs = compared(chunks, {"reference": path})[1]
    found = alignment.scores(alignment.aligned(pairs, alignment.lags(pairs)))
    value = F.col(column)
    return found.select("file_id", F.round(value, 4).alias("value"), warn(value < least).alias("status"), F.lit(f"ref_quality.{mode}").alias("check_id"), F.lit(metric).alias("metric"), F.lit(unit).alias("unit"))


@analyzer("stem_sep", "stem_sep.si_sdr", "si_sdr_db", "dB", "distortion against the own stem, projections on the others", "frames IS NOT NULL", references={}, stem_name="unknown", min_si_sdr_db=5.0, max_leakage_pct=10.0)
def stem_separation(chunks: DataFrame, params: dict) -> DataFrame:
    """Two findings a file: its distortion against the reference of its own stem, and what leaks in from the others."""
    paths = {name: p.get("path") if isinstance(p, dict) else p for name, p in params["references"].items()}
    paths = {name: path for name, path in paths.items() if path}
    if not params["references"]:
        return same(chunks, "indeterminate", "without reference stems there is no metric against them", "stem_sep.indeterminate", "si_sdr_db", "dB")
    for name, path in paths.items():
        if wrong := unreadable(chunks.sparkSession, path):
            return same(chunks, "error", f"{name}: {wrong[1]}", "stem_sep.decode_error", "si_sdr_db", "dB")
    own = params["stem_name"]
    if own not in paths:
        return same(chunks, "not_applicable", f"own stem {own!r} not found in references", "stem_sep.no_own_ref", "si_sdr_db", "dB")
    signals, pairs = compared(chunks, paths)
    mine = pairs.where(F.col("reference") == own)
    ratio = F.col("ratio_db")
    distortion = alignment.scores(alignment.aligned(mine, alignment.lags(mine))).select("file_id", F.round(ratio, 2).alias("value"), warn(ratio < params["min_si_sdr_db"]).alias("status"), F.lit("stem_sep.si_sdr").alias("check_id"), F.lit("si_sdr_db").alias("metric"), F.lit("dB").alias("unit"), F.lit(0.85).alias("confidence"))
    leaked = F.col("leakage_pct")
    return distortion.unionByName(alignment.leakage(signals, pairs, own).select("file_id", F.round(leaked, 2).alias("value"), warn(leaked > params["max_leakage_pct"]).alias("status"), F.lit("stem_sep.leakage").alias("check_id"), F.lit("leakage_pct").alias("metric"), F.lit("%").alias("unit"), F.lit(0.7).alias("confidence")))


@analyzer("enf_phase", "enf_phase.continuity", "phase_discontinuity_count", "events", "phase of mains hum in frames of a second", "frames >= sample_rate", enabled=False, min_duration_s=60.0, min_snr_db=10.0, phase_threshold_rad=1.0)
def mains_phase(chunks: DataFrame, params: dict) -> DataFrame:
    """Only where a profile enables it; always for a person to review."""
    if not params["enabled"]:
        return subjects(chunks).where("false").select("file_id", no_value().alias("value"), passes().alias("status"))
    long = F.col("frames") / F.col("sample_rate") >= params["min_duration_s"]
    signals = mono(chunks).where("frames >= sample_rate")
    found = events.kept(layouts.hum(signals.where(long)))
    heard = F.col("snr_db") >= params["min_snr_db"]
    jumps = layouts.phase_jumps(signals.where(long), found, params["phase_threshold_rad"])
    each = subjects(chunks).select("file_id", long.alias("long"), "duration_s").join(found, "file_id", "left").join(jumps, "file_id", "left")
    pick = lambda short, faint, told: F.when(~F.col("long"), short).when(~heard, faint).otherwise(told)
    return each.select(
        "file_id", pick(no_value(), F.round("snr_db", 2), F.coalesce("jumps", F.lit(0)).cast("double")).alias("value"), F.lit("needs_review").alias("status"),
        pick(F.lit("enf_phase.applicability"), F.lit("enf_phase.snr"), F.lit("enf_phase.continuity")).alias("check_id"),
        pick(F.lit("enf_status"), F.lit("enf_snr_db"), F.lit("phase_discontinuity_count")).alias("metric"), pick(F.lit("enum"), F.lit("dB"), F.lit("events")).alias("unit"),
        pick(F.format_string("too short (%.1f s) to tell", "duration_s"), F.format_string("no reliable mains hum (%.1f dB)", "snr_db"), F.format_string("%d jumps of phase at %.2f Hz: possible edits, no proof; needs a person's review", F.coalesce("jumps", F.lit(0)), "hz")).alias("message"),
    )


def finding(df: DataFrame, analyzer: str, check_id: Column, metric: Column, value: Column, unit: str | Column, status: Column, method: str, message: Column | None = None, confidence: Column | None = None) -> DataFrame:
    """Findings in the common columns; what isn't finite is null, and says so."""
    number = value.cast("double")
    finite = ~F.isnan(number) & (F.abs(number) < float("inf"))
    shown, unit = F.when(finite, number), F.lit(unit)
    said = F.coalesce(*([message] if message is not None else []), F.when(shown.isNotNull(), F.concat_ws(" ", metric, F.lit("is"), F.format_string("%.3f", shown), unit)), F.concat(metric, F.lit(" has no value")))
    limits = F.when(number.isNotNull() & ~finite, F.array(F.lit("non-finite value nulled"))).when(status == "error", F.array(F.lit("the analyzer failed; its result is unreliable"))).otherwise(F.array().cast("array<string>"))
    return df.select(
        "file_id", F.lit(analyzer).alias("analyzer"), check_id.alias("check_id"), metric.alias("metric"), shown.alias("value"), unit.alias("unit"), status.alias("status"),
        F.lit(method).alias("method"), said.alias("message"), limits.alias("limitations"), (F.lit(None).cast("double") if confidence is None else confidence).alias("confidence"),
    )


#: Seconds that an analyzer may take over one chunk of a file.
LIMIT_S = 60.0
#: Kernel outputs and small tables kept for findings, until :func:`release`.
HELD: list[DataFrame] = []


def release() -> None:
    """Lets go of what :func:`analyze` has kept; call it when the findings are written."""
    while HELD:
        HELD.pop().unpersist()


def failures(files: DataFrame, name: str, method: str, errors: DataFrame) -> DataFrame:
    """Error findings from (file_id, error): one a file."""
    per = errors.groupBy("file_id").agg(F.min("error").alias("error"))
    late = F.col("error").startswith("TimeoutError")
    check = F.when(late, f"{name}.timeout").otherwise(f"{name}.error")
    return finding(files.select("file_id").join(per, "file_id"), name, check, F.lit("error"), F.lit(None).cast("double"), "enum", F.lit("error"), method, F.col("error"))


def measured(good: DataFrame, files: DataFrame, name: str, params: dict, limit_s: float | None = LIMIT_S) -> DataFrame:
    """The findings of one analyzer: one row or more of every readable file."""
    a = ANALYZERS[name]
    with kernels.isolated(limit_s, persist=True) as isolation:
        try:
            found = a.run(good, a.parameters | params)
        except Exception as error:  # a plan that can't be built: no file of this analyzer can be judged, all others can
            return failures(files, name, a.method, files.select("file_id", F.lit(f"{type(error).__name__}: {error}").alias("error")))
        finally:
            HELD.extend(isolation.outputs + isolation.small)
    for column, kind, value in (("message", "string", None), ("check_id", "string", a.check_id), ("metric", "string", a.metric), ("unit", "string", a.unit), ("confidence", "double", CONFIDENCE.get(name))):
        if column not in found.columns:
            found = found.withColumn(column, F.lit(value).cast(kind))
    all_files = files.select("file_id", F.expr(a.applicable).alias("applies")).join(found, "file_id", "left")
    applies, given = F.col("applies"), F.col("status").isNotNull()
    status = F.when(applies, F.coalesce("status", F.lit("not_applicable"))).otherwise("not_applicable")
    said = F.when(applies, F.col("message")).otherwise(f"analyzer '{name}' not applicable to this input")
    check, metric = (F.when(applies, F.coalesce(F.when(given, F.col(c)), F.lit(one))).otherwise(other) for c, one, other in (("check_id", a.check_id, f"{name}.applicability"), ("metric", a.metric, "applicability")))
    sure = F.when(applies, F.coalesce("confidence", F.lit(CONFIDENCE.get(name)).cast("double")))
    out = finding(all_files, name, check, metric, F.when(applies, F.col("value")), F.coalesce("unit", F.lit(a.unit)), status, a.method, said, sure)
    # where an analyzer doesn't apply it says so once
    out = out.where(F.col("metric") != "applicability").unionByName(out.where(F.col("metric") == "applicability").dropDuplicates(["file_id"]))
    if not isolation.outputs:
        return out
    errors = reduce(DataFrame.union, [o.where("error IS NOT NULL").select("file_id", "error") for o in isolation.outputs])
    failed = failures(files.where(a.applicable), name, a.method, errors).persist()
    HELD.append(failed)
    return out.join(failed.select("file_id"), "file_id", "left_anti").unionByName(failed)


def analyze(chunks: DataFrame, profile: dict, only: tuple | None = None, skip: tuple = (), limit_s: float | None = LIMIT_S) -> DataFrame:
    """Findings of all readable files, policy applied, rules and severities joined; unreadable files give error findings.

    Analyzers that aren't selected add nothing to the plan. Each reads ``chunks`` again: persist them, and call
    :func:`release` when the findings are written.
    """
    chosen = {a: p for a, p in profile["analyzers"].items() if (only is None or a in only) and a not in skip}
    good, files = chunks.where("error IS NULL"), subjects(chunks).persist()
    HELD.append(files)
    broken = files.where("error IS NOT NULL")
    found = [finding(broken, "decode", F.lit("decode.error"), F.lit("decode"), F.lit(None).cast("double"), "", F.lit("error"), "scan", F.concat(F.lit("the file can't be read: "), F.col("error")))]
    readable = files.where("error IS NULL")
    for name, params in chosen.items():
        if name not in REGISTRY:
            found.append(measured(good, readable, name, params or {}, limit_s))
            continue
        try:
            found.append(REGISTRY[name][0](good, params))
        except Exception as error:  # as in :func:`measured`
            found.append(failures(readable, name, "plugin", readable.select("file_id", F.lit(f"{type(error).__name__}: {error}").alias("error"))))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    return policy.enrich(policy.escalate(every, profile.get("strict_overlay") or {}))

"""Queries of the audio kernels on users' events as sounds of 40 samples a second.

Recursive filters and difference functions are beyond SQL; the kernels are tested on published values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tonegrid.functions.columns import round4
from tonegrid.operators import kernels, spectra
from tonegrid.sources.signals import events_signal
from tonegrid.sources.wav import chunks_of

RATE = 40


#: The same as short sounds, long enough for a pitch frame.
PITCH_RATE = 500


def _chunks(spark, d, rate=RATE):
    signal = events_signal(spark, d).withColumn("x", F.col("x") / 400.0)
    return chunks_of(signal, rate)


def kernel_loudness(spark, d):
    return round4(kernels.integrated_loudness(kernels.block_loudness(_chunks(spark, d))), "lufs")


def kernel_true_peak(spark, d):
    return round4(kernels.true_peak(_chunks(spark, d)), "dbtp", "dbfs")


def kernel_pitch(spark, d):
    return round4(kernels.fundamental(_chunks(spark, d, PITCH_RATE), low=60.0, high=150.0), "voiced_share", "median_hz", "p10_hz", "p25_hz", "p75_hz", "p90_hz")


def kernel_spectrum(spark, d):
    spectrum = kernels.mean_spectrum(_chunks(spark, d), 32, 8).withColumnRenamed("file_id", "vec_id")
    return round4(spectra.spectral_health(spectrum).join(spectra.rolloff(spectrum), "vec_id"), "centroid", "flatness")


QUERIES = {"kernel_loudness": kernel_loudness, "kernel_true_peak": kernel_true_peak, "kernel_pitch": kernel_pitch, "kernel_spectrum": kernel_spectrum}

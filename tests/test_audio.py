"""The audio path on synthesised signals, against published values of the same signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.operators import kernels, spectra
from tonegrid.operators.analysis import analyze, known_parameters
from tonegrid.sources import wav
from tonegrid.sources.profiles import ProfileError, load_profile

RATE, N = 44_100, 132_300
T = np.arange(N) / RATE


def sine(f, amplitude=0.5):
    return amplitude * np.sin(2 * np.pi * f * T).astype(np.float32)


SIGNALS = {
    "sine_1k": [sine(1000)], "stereo": [sine(1000)] * 2, "sine_440": [sine(440)], "clipped": [np.clip(1.5 * np.sin(2 * np.pi * 440 * T), -1, 1)],
    "noise": [0.3 * np.random.Generator(np.random.PCG64(42)).standard_normal(N)], "silence": [np.zeros(N)],
}
#: Loudness, true peak and centroid of each signal.
EXPECTED = {
    "sine_1k": (-8.81, -6.015, 1002.70), "stereo": (-5.80, -6.015, 1002.70), "sine_440": (-9.69, -6.015, 444.03),
    "clipped": (-2.14, 0.054, 900.53), "noise": (-7.29, 1.850, 11027.48), "silence": (-70.0, -240.0, 0.0),
}


@pytest.fixture(scope="module")
def audio(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("wav")
    for name, x in SIGNALS.items():
        (folder / f"{name}.wav").write_bytes(wav.encode(np.array(x), RATE))
    (folder / "broken.wav").write_bytes(b"RIFF0000WAVE")
    (folder / "empty.wav").write_bytes(b"")
    (folder / "notes.txt").write_bytes(b"not audio")
    rows = wav.read_audio(spark, str(folder)).withColumn("file_id", F.regexp_extract("source_path", r"([^/]+)\.\w+$", 1)).cache()
    return rows


def test_scan(audio):
    rows = {r.file_id: r for r in wav.subjects(audio).collect()}
    assert {k for k, r in rows.items() if r.error} == {"broken", "notes"}  # Spark lists no file without bytes
    assert (rows["stereo"].channels, rows["stereo"].channel_layout, rows["stereo"].frames, rows["stereo"].duration_s, rows["stereo"].bit_depth) == (2, "stereo", N, 3.0, 16)


def test_published_values(audio):
    good = audio.where("error IS NULL")
    loud = {r.file_id: r.lufs for r in kernels.integrated_loudness(kernels.block_loudness(good)).collect()}
    peak = {r.file_id: r.dbtp for r in kernels.true_peak(good).collect()}
    spectrum = kernels.mean_spectrum(good).select(F.col("file_id").alias("vec_id"), "bin", "mag")
    centre = {r.vec_id: (r.centroid or 0.0) * RATE / 2048 for r in spectra.spectral_health(spectrum).collect()}
    for name, (lufs, dbtp, centroid) in EXPECTED.items():
        assert loud[name] == pytest.approx(lufs, abs=0.01)
        assert peak[name] == pytest.approx(dbtp, abs=0.002)
        assert centre[name] == pytest.approx(centroid, abs=0.02)


#: What further analyzers give for the same signals; None where they don't apply, and their tolerances.
NAMES = ("sine_1k", "stereo", "sine_440", "clipped", "noise", "silence")
GOLDEN = {
    "clipping": ((0.0, 0.0, 0.0, 54.1497, 0.1073, 0.0), 0.001),
    "fatigue_index": ((0.0, 0.0, 0.0, 0.0, 0.0401, None), 0.001),
    "harmonic_tension": ((0.0139, 0.0139, 0.0133, 0.0133, 0.9744, None), 0.001),
    "inharmonicity": ((0.000723, 0.000723, 0.001472, 0.001426, 0.003069, None), 0.001),
    "lra": ((0.0, 0.0, 0.0, 0.0, 0.0, 0.0), 0.001),
    "mono_compat": ((None, 0.0, None, None, None, None), 0.001),
    "spectral_irregularity": ((0.8321, 0.8321, 0.8352, 0.8494, 0.0364, 0.0), 0.001),
    "timbre_distance": ((0.0, 0.0, 0.0, 0.0, 0.0065, 1.0), 0.001),
}
STATUSES = {"loudness": ("warning",) * 6, "true_peak": ("pass", "pass", "pass", "fail", "fail", "pass"), "clipping": ("pass", "pass", "pass", "fail", "fail", "pass"), "melodic_contour": ("pass",) * 5 + ("not_applicable",)}


def test_all_analyzers_of_the_default_profile(audio):
    rows = analyze(audio, load_profile("default", known=known_parameters())).collect()
    rows = [r for r in rows if r.check_id not in ("acoustic_context.scene_changes", "acoustic_context.rt60")]
    got = {(r.analyzer, r.file_id): r for r in rows}
    readable = set(SIGNALS)
    assert {r.file_id for r in rows if r.analyzer == "decode"} == {"broken", "notes"}
    assert all({f for a, f in got if a == name} == readable for name in known_parameters())  # a row for every file, never a silent skip
    assert len(got) == len(rows)
    for name, (values, near) in GOLDEN.items():
        for file, value in zip(NAMES, values, strict=True):
            assert got[name, file].value == (None if value is None else pytest.approx(value, abs=near)), (name, file)
    for name, statuses in STATUSES.items():
        assert tuple(got[name, f].status for f in NAMES) == statuses
    assert got["mono_compat", "noise"].check_id == "mono_compat.applicability" and got["goniometer", "stereo"].value == pytest.approx(1.0, abs=1e-4)
    assert got["channel_balance", "stereo"].value == pytest.approx(0.0, abs=1e-6) and got["drn", "sine_1k"].value == pytest.approx(3.01, abs=0.01)
    assert got["acoustic_context", "sine_1k"].value == pytest.approx(20 * np.log10(0.5 / np.sqrt(2)), abs=0.05)
    assert all(r.value is None or np.isfinite(r.value) for r in rows)


@pytest.mark.parametrize("rate", [44_100, 96_000, 192_000])
def test_blocks_do_not_depend_on_chunks_at_any_rate(spark, tmp_path, rate):
    t = np.arange(24 * rate if rate < 96_000 else 8 * rate) / rate
    quiet = 10 ** (-8 / 20)
    x = 0.5 * np.sin(2 * np.pi * 1000 * t) * np.where(t < t[-1] / 2, 1.0, quiet)
    (tmp_path / "two.wav").write_bytes(wav.encode(np.array([x]), rate))
    chunks = wav.read_audio(spark, str(tmp_path))
    assert chunks.count() == -(-len(x) // wav.CHUNK) > 5
    whole = wav.parse((tmp_path / "two.wav").read_bytes())[2][0].astype(np.float64)
    for size_s, hop_s in ((0.4, 0.1), (3.0, 1.0)):
        size, hop = int(rate * size_s), int(rate * hop_s)
        starts = np.arange(0, len(whole) - size + 1, hop)
        blocks = kernels.block_power(chunks, size_s, hop_s).orderBy("frame").collect()
        assert [b.frame for b in blocks] == list(range(len(starts)))
        assert [b.value for b in blocks] == pytest.approx(kernels.k_weighted_power(whole, 0, starts, size), rel=1e-6)
    if rate == 44_100:
        spread = [r.value for r in analyze(chunks, {"analyzers": {"lra": {"max_lu": 5.0}}}).collect()]
        assert spread == [pytest.approx(8.0, abs=0.01)]  # half of the blocks at either level, both above the gates


def test_a_frame_beyond_the_halo_is_an_error(spark, tmp_path):
    (tmp_path / "long.wav").write_bytes(wav.encode(np.zeros((1, 3 * wav.CHUNK)), 44_100))
    chunks = wav.read_audio(spark, str(tmp_path), after_s=0.1)
    with pytest.raises(Exception, match="longer after_s"):
        kernels.block_power(chunks, 3.0, 1.0).count()


def test_k_weighting_from_rest_equals_the_recursion():
    x = np.random.default_rng(3).normal(size=12_000)
    starts = np.array([0, 700, 5000, 9000])

    def recursion(block):
        for b, a in kernels.K_WEIGHTING:
            s = t = 0.0
            out = np.empty_like(block)
            for i, v in enumerate(block):
                y = b[0] * v + s
                s, t = b[1] * v - a[1] * y + t, b[2] * v - a[2] * y
                out[i] = y
            block = out
        return (block**2).mean()

    expected = [recursion(x[1000 + i : 1000 + i + 1500]) for i in starts]
    assert kernels.k_weighted_power(x, 1000, starts, 1500) == pytest.approx(expected, rel=1e-9)


def test_butterworth_edges_are_three_decibels_down():
    n = 1 << 20
    for low, high in ((20, 120), (1200, 4000), (12_000, 20_000), (None, 200)):
        response = np.abs(kernels.butterworth(low, high, RATE, n))
        at = [20 * np.log10(np.interp(f, np.fft.rfftfreq(n, 1 / RATE), response)) for f in (low, high) if f]
        assert at == pytest.approx([-3.0103] * len(at), abs=0.01) and response.max() == pytest.approx(1.0, abs=1e-6)


def test_differences_equal_their_definition():
    x = np.random.default_rng(4).normal(size=(3, 90))
    expected = [[((f[:50] - f[lag : lag + 50]) ** 2).sum() for lag in range(41)] for f in x]
    assert kernels.differences(x, 50, 40) == pytest.approx(np.array(expected))


def test_parameters_of_the_wrong_kind_are_refused(tmp_path):
    for params in ("{min_lufs: loud}", "{min_lufs: true}", "{loudest: 1}"):
        (tmp_path / "p.yaml").write_text(f"name: p\nversion: '1'\nanalyzers:\n  loudness: {params}\n")
        with pytest.raises(ProfileError):
            load_profile(str(tmp_path / "p.yaml"), known=known_parameters())


def test_pitch(audio):
    f0 = {r.file_id: r for r in kernels.fundamental(audio.where("error IS NULL")).collect()}
    assert f0["sine_440"].median_hz == pytest.approx(440, abs=0.5)
    assert f0["silence"].status == "not_applicable" and f0["noise"].voiced < f0["sine_440"].voiced / 2


def test_results_do_not_depend_on_chunks(spark):
    rng = np.random.default_rng(1)
    rows = [(c, i, float(v)) for c in (1, 2) for i, v in enumerate(rng.normal(size=900) * 0.1)]
    signal = spark.createDataFrame(rows, "channel long, frame long, x double")
    for measure in (lambda c: kernels.integrated_loudness(kernels.block_loudness(c)), kernels.true_peak, lambda c: kernels.mean_spectrum(c, 64, 16).agg(F.sum("mag")), lambda c: kernels.band_squares(c, ((5.0, 30.0), kernels.K_BAND)).orderBy("file_id", "band").select("file_id", "channel", "ms")):
        small, large = (sorted(map(tuple, measure(wav.chunks_of(signal, 200, n)).collect())) for n in (300, 1000))
        assert [x[:-1] for x in small] == [x[:-1] for x in large]
        assert [x[-1] for x in small] == pytest.approx([x[-1] for x in large])


@pytest.mark.parametrize("depth", [8, 16, 24, 32])
def test_pcm_depths(depth):
    import struct

    values = [0, 1, -1, 2 ** (depth - 1) - 1, -(2 ** (depth - 1))]
    raw = bytes(v + 128 for v in values) if depth == 8 else b"".join((v & (1 << depth) - 1).to_bytes(depth // 8, "little") for v in values)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(raw), b"WAVE", b"fmt ", 16, 1, 1, 8000, 0, depth // 8, depth, b"data", len(raw))
    rate, bits, x = wav.parse(head + raw)
    assert (rate, bits) == (8000, depth) and x[0] == pytest.approx(np.array(values) / 2.0 ** (depth - 1))


def test_resampled_tones_keep_their_pitch_whatever_the_chunks(spark):
    x = 0.5 * np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)
    signal = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "channel long, frame long, x double")
    for rate in (12_000, 5_000):
        got = []
        for chunk in (8000, 1500):
            rows = kernels.resample(wav.chunks_of(signal, 8000, chunk), rate).orderBy("start").collect()
            got.append(np.concatenate([r.samples for r in rows]))
        assert len(got[0]) == len(got[1]) == rate
        expected = 0.5 * np.sin(2 * np.pi * 440 * np.arange(rate) / rate)
        assert got[0] == pytest.approx(got[1], abs=1e-6)
        assert got[0][200:-200] == pytest.approx(expected[200:-200], abs=0.01)

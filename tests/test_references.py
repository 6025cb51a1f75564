"""Signals against references, channels against each other and mains hum, on written files, against definitions in numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.operators import alignment, layouts
from tonegrid.operators.analysis import analyze, known_parameters, release
from tonegrid.sources import wav
from tonegrid.sources.audio import scan_audio
from tonegrid.sources.profiles import ProfileError, load_profile

RATE = 16_000


def write(folder, **signals):
    """Writes the signals as WAVE files and gives them back as they are read."""
    folder.mkdir(exist_ok=True)
    out = {}
    for name, x in signals.items():
        raw = wav.encode(np.asarray(x, np.float32), RATE)
        (folder / f"{name}.wav").write_bytes(raw)
        out[name] = wav.parse(raw)[2].astype(np.float32)
    return out


def findings(spark, folder, name, params, **options):
    rows = analyze(scan_audio(spark, str(folder), **options), {"analyzers": {name: params}}, None, ()).withColumn("name", F.regexp_extract("file_id", r"([^/]+)\.wav$", 1)).collect()
    release()
    return {(r["name"], r["metric"]): r for r in rows}


def shifted(ref, deg):
    """The pair aligned by definition; numpy's own correlation for short ones, a single transform for others."""
    n = min(len(ref), len(deg))
    ref, deg = ref[:n].astype(np.float64), deg[:n].astype(np.float64)
    if n <= 20_000:
        corr = np.correlate(ref, deg, "full")
    else:
        size = 1 << int(np.ceil(np.log2(2 * n)))
        corr = np.roll(np.fft.irfft(np.fft.rfft(ref, size) * np.fft.rfft(deg, size).conj(), size), n - 1)[: 2 * n - 1]
    lag = int(np.argmax(np.abs(corr))) - (n - 1)
    return lag, ref[max(lag, 0) : n - max(-lag, 0)], deg[max(-lag, 0) : n - max(lag, 0)]


def expected(ref, deg):
    _, r, d = shifted(ref, deg)
    a, b = r / (np.linalg.norm(r) + 1e-12), d / (np.linalg.norm(d) + 1e-12)
    each = [a[i : i + 256] @ b[i : i + 256] / (np.linalg.norm(a[i : i + 256]) * np.linalg.norm(b[i : i + 256]) + 1e-12) for i in range(0, len(a) - 256, 128)]
    envelope = float(np.clip(np.mean(each), -1, 1)) if each else 0.0
    spectral = 1.0
    if len(r) >= 1024:
        rm, dm = (np.abs(np.fft.rfft(v[:1024] * np.hanning(1024))) + 1e-12 for v in (r, d))
        spectral = 1 + 4 * float(np.mean(2 * rm * dm / (rm**2 + dm**2)))
    alpha = r @ d / (r @ r + 1e-12)
    ratio = 10 * np.log10((np.sum((alpha * r) ** 2) + 1e-12) / (np.sum((d - alpha * r) ** 2) + 1e-12))
    return envelope, spectral, float(ratio)


@pytest.fixture(scope="module")
def pairs(tmp_path_factory):
    rng = np.random.default_rng(5)
    folder, ref = tmp_path_factory.mktemp("refs"), rng.standard_normal(12_000) * 0.1
    noise = rng.standard_normal(12_000) * 0.01
    signals = write(
        folder / "files", late=np.concatenate((np.zeros(700), ref))[:12_000] + noise, early=ref[431:] + noise[431:], turned=-0.5 * ref + noise, other=rng.standard_normal(9_000) * 0.1,
        short=ref[:200], stub=ref[:600], silent=np.zeros(5_000), longer=np.concatenate((ref, ref[:3_000])) * 0.7,
    )
    return folder, signals, write(folder / "reference", ref=ref)["ref"]


@pytest.mark.parametrize("mode, metric, column", [("speech-full-ref", "stoi_proxy", 0), ("audio-full-ref", "visqol_proxy", 1), ("source-sep-ref", "si_sdr_db", 2)])
def test_reference_quality_by_definition(spark, pairs, mode, metric, column):
    folder, signals, ref = pairs
    path = str(folder / "reference" / "ref.wav")
    for options in ({}, {"chunk": 4096, "split": 5000}):
        found = findings(spark, folder / "files", "ref_quality", {"mode": mode, "reference_path": path}, **options)
        assert len(found) == len(signals)
        for name, x in signals.items():
            r, want = found[(name, metric)], expected(ref[0], x[0])[column]
            assert r["value"] == pytest.approx(want, abs=2e-4), (name, options)
            assert r["status"] == ("pass" if want >= (0.6, 3.5, 5.0)[column] else "warning")
            assert r["check_id"] == f"ref_quality.{mode}"


def test_lags_of_long_signals(spark, tmp_path):
    """Transforms of several blocks of rows and columns; a lag of either sign, near none and near all of the length."""
    rng = np.random.default_rng(9)
    ref = rng.standard_normal(600_000).astype(np.float32) * 0.1
    assert all(b < 64 for b in alignment.shape(600_000)[2:]) and alignment.shape(600_000)[0] == 64
    signals = write(tmp_path / "files", near=np.roll(ref, 3), far=np.concatenate((rng.standard_normal(450_000) * 0.1, ref[:150_000])), ahead=np.concatenate((ref[333_333:], rng.standard_normal(333_333) * 0.05)))
    given = write(tmp_path / "reference", ref=ref)["ref"][0]
    references = alignment.references_at(lambda path, rate: scan_audio(spark, path, resample=rate), {"r": str(tmp_path / "reference")}, [RATE])
    found = alignment.lags(alignment.paired(wav.mono(scan_audio(spark, str(tmp_path / "files"))), references)).collect()
    lags = {r["file_id"].rsplit("/", 1)[-1][:-4]: r["lag"] for r in found}
    assert lags == {name: shifted(given, x[0])[0] for name, x in signals.items()} == {"near": -3, "far": -450_000, "ahead": 333_333}


def test_reference_at_another_rate_and_what_stops_a_comparison(spark, pairs, tmp_path):
    folder, signals, _ = pairs
    path = str(folder / "reference" / "ref.wav")
    tone = 0.3 * np.sin(2 * np.pi * 440 * np.arange(24_000) / 24_000) * np.exp(-np.arange(24_000) / 9_000)
    (tmp_path / "fine.wav").write_bytes(wav.encode(tone.astype(np.float32), 24_000))
    half = 0.3 * np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000) * np.exp(-np.arange(16_000) / 6_000)
    write(tmp_path / "files", tone=half)
    same = findings(spark, tmp_path / "files", "ref_quality", {"mode": "speech-full-ref", "reference_path": str(tmp_path / "fine.wav")})
    assert same[("tone", "stoi_proxy")]["value"] > 0.99
    for params, status, check in (
        ({}, "indeterminate", "indeterminate"),
        ({"mode": "speech-full-ref"}, "indeterminate", "indeterminate"),
        ({"mode": "speech-full-ref", "reference_path": path, "reference_sha256": "0" * 64}, "error", "hash_mismatch"),
        ({"mode": "speech-full-ref", "reference_path": str(tmp_path / "none.wav")}, "error", "decode_error"),
        ({"mode": "by-ear", "reference_path": path}, "not_applicable", "unknown_mode"),
    ):
        found = findings(spark, folder / "files", "ref_quality", params)
        assert {(r["status"], r["check_id"], r["value"]) for r in found.values()} == {(status, f"ref_quality.{check}", None)}
        assert len(found) == len(signals)
    right = hashlib.sha256((folder / "reference" / "ref.wav").read_bytes()).hexdigest()
    found = findings(spark, folder / "files", "ref_quality", {"mode": "source-sep-ref", "reference_path": path, "reference_sha256": right, "min_score": 60.0})
    assert {n for (n, _), r in found.items() if r["status"] == "pass"} == {"short", "stub", "longer"}  # its beginning, and all of it at another level


def test_stems(spark, tmp_path):
    rng = np.random.default_rng(2)
    voice, drums, bass = rng.standard_normal((3, 9_000)) * 0.1
    stems = write(tmp_path / "stems", voice=voice, drums=drums, bass=bass[:7_000])
    files = write(tmp_path / "files", clean=voice, mixed=voice + 0.8 * drums, against=voice - 0.5 * drums)
    paths = {n: str(tmp_path / "stems" / f"{n}.wav") for n in stems}
    found = findings(spark, tmp_path / "files", "stem_sep", {"references": {**paths, "drums": {"path": paths["drums"]}}, "stem_name": "voice"}, chunk=2048)
    for name, x in files.items():
        est, leaked = x[0].astype(np.float64), 0.0
        for other in ("drums", "bass"):
            n = min(len(est), stems[other].shape[1])
            b = stems[other][0, :n].astype(np.float64)
            alpha = est[:n] @ b / (b @ b + 1e-12)
            leaked += float(np.sum((alpha * b) ** 2)) if alpha > 0 else 0.0
        assert found[(name, "leakage_pct")]["value"] == pytest.approx(100 * leaked / (est @ est + 1e-12), abs=0.006)
        assert found[(name, "si_sdr_db")]["value"] == pytest.approx(expected(stems["voice"][0], x[0])[2], abs=0.006)
    assert found[("mixed", "leakage_pct")]["status"] == found[("mixed", "si_sdr_db")]["status"] == "warning"
    assert found[("clean", "leakage_pct")]["status"] == found[("clean", "si_sdr_db")]["status"] == "pass"
    for params, status in (({}, "indeterminate"), ({"references": paths, "stem_name": "flute"}, "not_applicable"), ({"references": {"voice": str(tmp_path / "no.wav")}, "stem_name": "voice"}, "error")):
        assert {r["status"] for r in findings(spark, tmp_path / "files", "stem_sep", params).values()} == {status}


def test_channels_by_definition(spark, tmp_path):
    rng = np.random.default_rng(4)
    t = np.arange(10_000) / RATE
    film = rng.standard_normal((6, 10_000)) * 0.1
    film[3] = 0.3 * np.sin(2 * np.pi * 50 * t)
    film[5] = 0.99 * film[1] + 0.001 * film[0]
    hollow = rng.standard_normal((8, 10_000)) * 0.1
    hollow[:3] = 0
    files = write(tmp_path / "files", film=film, hollow=hollow, stereo=rng.standard_normal((2, 7_000)) * 0.1, still=np.zeros((2, 5_000)), mono=film[0], brief=film[:, :200])
    for options in ({}, {"chunk": 1024}):
        found = findings(spark, tmp_path / "files", "spatial_coherence", {}, **options)
        for name in ("film", "hollow", "stereo", "brief"):
            with np.errstate(invalid="ignore"):
                corr = np.abs(np.nan_to_num(np.corrcoef(files[name].astype(np.float64))))
            np.fill_diagonal(corr, 0)
            r = found[(name, "max_off_diag_correlation")]
            a, b = np.unravel_index(np.triu(corr).argmax(), corr.shape)
            assert r["value"] == pytest.approx(corr.max(), abs=1e-4) and r["message"].startswith(f"channels {a} and {b} ")
            assert r["status"] == ("warning" if corr.max() > 0.95 else "pass")
        assert found[("still", "max_off_diag_correlation")]["value"] == 0.0
        assert found[("mono", "applicability")]["status"] == "not_applicable"
        found = findings(spark, tmp_path / "files", "multichannel_layout", {}, **options)
        for name, low, sides, centre in (("film", "pass", "pass", "pass"), ("hollow", "warning", "warning", "warning"), ("brief", "pass", "pass", "pass")):
            x, n = files[name].astype(np.float64), min(2048, files[name].shape[1])
            power = np.abs(np.fft.rfft(x[3, :n] * np.hanning(n))) ** 2
            share = 100 * power[np.fft.rfftfreq(n, 1 / RATE) <= 120].sum() / power.sum() if n >= 256 else 100
            for metric, want, status in (("lfe_low_freq_energy_pct", share, low), ("stereo_downmix_energy", np.sqrt(np.mean((x[0] + x[1]) ** 2)), sides), ("center_channel_energy", np.sqrt(np.mean(x[2] ** 2)), centre)):
                assert found[(name, metric)]["value"] == pytest.approx(want, abs=6e-3 if "pct" in metric else 6e-5)
                assert found[(name, metric)]["status"] == status
        assert found[("stereo", "applicability")]["status"] == "not_applicable"


def test_codec_conformance(spark, tmp_path):
    files = write(tmp_path / "files", whole=np.ones(4_000) * 0.1)
    found = findings(spark, tmp_path / "files", "codec_conf", {})
    assert len(files) == 1 and found[("whole", "compliance_status")]["status"] == "pass"
    chunks = scan_audio(spark, str(tmp_path / "files")).withColumns({"frames": F.lit(4_100).cast("long"), "bit_depth": F.lit(0)})
    row = analyze(chunks, {"analyzers": {"codec_conf": {}}}).collect()[0]
    release()
    assert row["status"] == "warning" and "4100 frames against 4000" in row["message"] and "unknown bit depth" in row["message"]


def test_mains_phase_by_definition(spark, tmp_path):
    rng = np.random.default_rng(8)
    t = np.arange(65 * RATE) / RATE
    steady = 0.2 * np.sin(2 * np.pi * 50 * t) + rng.standard_normal(len(t)) * 0.01
    cut = np.where(t < 30, steady, 0.2 * np.sin(2 * np.pi * 50 * t + 2.5)).astype(np.float32)
    files = write(tmp_path / "files", steady=steady, cut=cut, faint=np.zeros(62 * RATE), brief=steady[: 5 * RATE])
    on = {"enabled": True}
    for options in ({}, {"chunk": 70_000}):
        found = findings(spark, tmp_path / "files", "enf_phase", on, **options)
        for name in ("steady", "cut"):
            x = files[name][0].astype(np.float64)
            power, hz = np.abs(np.fft.rfft(x[:65_536] * np.hanning(65_536))) ** 2, np.fft.rfftfreq(65_536, 1 / RATE)
            f = hz[(hz >= 45) & (hz <= 65)][power[(hz >= 45) & (hz <= 65)].argmax()]
            phases = [np.angle(np.sum(x[i : i + RATE] * np.exp(-2j * np.pi * f * np.arange(RATE) / RATE))) for i in range(0, len(x) - RATE + 1, RATE // 2)]
            r = found[(name, "phase_discontinuity_count")]
            assert r["value"] == float((np.abs(np.diff(np.unwrap(phases))) > 1).sum()) and r["status"] == "needs_review"
        assert found[("cut", "phase_discontinuity_count")]["value"] >= 1 > found[("steady", "phase_discontinuity_count")]["value"]
        assert found[("faint", "enf_snr_db")]["value"] == 0.0 and found[("brief", "enf_status")]["value"] is None
        assert {r["status"] for r in found.values()} == {"needs_review"}
    assert {r["status"] for r in findings(spark, tmp_path / "files", "enf_phase", {}).values()} == {"not_applicable"}


def test_choices_of_profiles(tmp_path):
    path = tmp_path / "p.yaml"
    path.write_text("name: p\nversion: '1'\nanalyzers:\n  ref_quality: {mode: by-ear}\n")
    with pytest.raises(ProfileError, match="out of range: mode"):
        load_profile(str(path), known=known_parameters())
    path.write_text("name: p\nversion: '1'\nanalyzers:\n  ref_quality: {mode: audio-full-ref, min_score: 4.0}\n  spatial_coherence: {max_off_diag_corr: 0.9}\n")
    assert load_profile(str(path), known=known_parameters())["analyzers"]["ref_quality"]["mode"] == "audio-full-ref"


def test_no_pairs(spark, tmp_path):
    write(tmp_path / "files", one=np.ones(100) * 0.1)
    none = wav.mono(scan_audio(spark, str(tmp_path / "files"))).where("false")
    pairs = alignment.paired(none, none.withColumn("reference", F.lit("r")))
    assert alignment.scores(alignment.aligned(pairs, alignment.lags(pairs))).count() == 0
    assert layouts.most_alike(layouts.channel_moments(none)).count() == 0

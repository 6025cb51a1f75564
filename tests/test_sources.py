"""The audio source: byte ranges, filters, headers, hashes and formats."""

import hashlib
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.sources import audio, formats, wav

RATE = 8000


def noise(seed, n, channels=1):
    return np.random.default_rng(seed).uniform(-1, 1, (channels, n)).astype(np.float32)


def aiff(x, rate, depth=16, packing=None):
    """A 16 or 24-bit AIFF, or AIFF-C with a packing, of samples by channel."""
    order = "<" if packing == b"sowt" else ">"
    q = np.clip(np.rint(x.T * 2 ** (depth - 1)), -(2 ** (depth - 1)), 2 ** (depth - 1) - 1).astype(np.int64)
    raw = q.astype(f"{order}i2").tobytes() if depth == 16 else b"".join(int(v & 0xFFFFFF).to_bytes(3, "big") for v in q.ravel())
    shift = rate.bit_length() - 1
    extended = struct.pack(">HQ", 16383 + shift, rate << (63 - shift))
    comm = struct.pack(">hIh", len(x), x.shape[1], depth) + extended + (packing + b"\0\0" if packing else b"")
    body = b"COMM" + struct.pack(">I", len(comm)) + comm + b"SSND" + struct.pack(">III", len(raw) + 8, 0, 0) + raw
    kind = b"AIFC" if packing else b"AIFF"
    return b"FORM" + struct.pack(">I", len(body) + 4) + kind + body


def rows_of(chunks):
    return sorted((r.source_path.rsplit("/", 1)[-1], r.channel, r.start, r.channels, r.sample_rate, r.frames, r.bit_depth, r.samples, r.left, r.right, r.error) for r in chunks.collect() if r.error is None)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("audio")
    for name, n, channels in (("long", 50_000, 2), ("mono", 9_001, 1), ("short", 10, 1)):
        (at / f"{name}.wav").write_bytes(wav.encode(noise(n, n, channels), RATE))
    (at / "sub").mkdir()
    (at / "sub" / "deep.wav").write_bytes(wav.encode(noise(5, 3000), RATE))
    (at / "broken.wav").write_bytes(b"RIFF0000WAVE")
    (at / "empty.wav").write_bytes(b"")
    (at / "notes.txt").write_bytes(b"not audio")
    (at / "song.mp3").write_bytes(b"ID3")
    (at / "_hidden.wav").write_bytes(b"x")
    return at


@pytest.mark.parametrize("split", [1 << 30, 20_000, 999])
def test_byte_ranges_give_the_chunks_of_whole_files(spark, folder, monkeypatch, split):
    monkeypatch.setattr(wav, "CHUNK", 4096)
    monkeypatch.setattr(wav, "BEFORE", 1500)
    monkeypatch.setattr(audio, "OPEN_COST", 0)
    options = {"chunk": 4096, "before": 1500, "after_s": 0.25, "split": split}
    got = audio.scan_audio(spark, str(folder), **options)
    one = lambda name, c: noise(*{"long": (50_000, 50_000, 2), "mono": (9_001, 9_001), "short": (10, 10), "deep": (5, 3000)}[name])[c]
    rows = rows_of(got)
    assert len(rows) == 3 * 13 + 3 + 1 + 1 and len({r[:3] for r in rows}) == len(rows)
    for name, c, start, channels, rate, frames, depth, samples, left, right, _ in rows:
        whole = one(name.split(".")[0], c) if c >= 0 else None
        if whole is not None:
            end = start + 4096
            for found, expected in ((samples, whole[start:end]), (left, whole[max(0, start - 1500) : start]), (right, whole[end : end + 2001])):
                assert found == pytest.approx(expected, abs=1e-4)
        assert (rate, depth) == (RATE, 16) and frames == {"long.wav": 50_000, "mono.wav": 9_001, "short.wav": 10, "deep.wav": 3000}[name]
    old = [tuple(r) for r in rows_of(wav.read_audio(spark, str(folder), "*.wav", 0.25))]
    assert [r for r in rows if r[0] != "deep.wav"] == old  # the older scan doesn't descend
    bad = {r.source_path.rsplit("/", 1)[-1]: r.error for r in got.where("error IS NOT NULL").collect()}
    assert bad == {"broken.wav": "no format or no data chunk", "empty.wav": "the file is empty", "notes.txt": "unsupported file type", "song.mp3": "no decoder for this file type"}
    assert split > 20_000 or got.rdd.getNumPartitions() > 5


def test_pieces_cover_every_file_once():
    files = [("a", 0), ("b", 10), ("c", 1000), ("d", 3)]
    for split in (7, 100, 5000):
        dealt = audio.deal(files, split)
        pieces = [p for task in dealt for p in task]
        for path, size in files:
            own = sorted(p[2:] for p in pieces if p[0] == path)
            assert own[0][0] == 0 and own[-1][1] == max(size, 1) and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
    assert len(audio.deal([("x", 10)] * 100, 10 * (10 + audio.OPEN_COST))) == 10 and len(audio.deal(files, 7, whole=True)) == 4


def test_files_and_channels_by_option(spark, folder):
    path = f"file://{folder}/long.wav"
    one = audio.scan_audio(spark, str(folder), chunk=4096, files=json.dumps([path]), channels=json.dumps([1]))
    assert {(r.source_path, r.channel) for r in one.collect()} == {(path, 1)}
    assert [r.start for r in one.where("start < 8000").orderBy("start").collect()] == [0, 4096]
    assert audio.scan_audio(spark, str(folder), chunk=4096, files=json.dumps([path]), channels=json.dumps([0, 1])).count() == 26
    reader = audio.AudioReader({"path": f"file://{folder}", "files": json.dumps([path])})
    assert {piece[0] for p in reader.partitions() for piece in p.pieces} == {path}


def test_filters_of_one_scan_do_not_reach_another(spark, folder):
    chunks = audio.scan_audio(spark, str(folder), chunk=4096).where(F.col("source_path").endswith("long.wav"))
    counts = {r["channel"]: r["n"] for r in chunks.groupBy("channel").agg(F.count("*").alias("n")).collect()}
    assert counts == {-1: 13, 0: 13, 1: 13}
    for first, second in (("channel = 0", "channel = 1"), ("channel = 1", "channel <> -1"), ("channel <> -1", "channel = 0")):
        sides = [chunks.where(c).select("channel", "start", F.lit(n).alias("side")) for n, c in enumerate((first, second))]
        found = {(r["side"], r["channel"]): r["n"] for r in sides[0].union(sides[1]).groupBy("side", "channel").agg(F.count("*").alias("n")).collect()}
        want = {(n, c): 13 for n, rule in enumerate((first, second)) for c in counts if eval(rule.replace("<>", "!=").replace(" = ", " == "), {"channel": c})}
        assert found == want
    path = f"file://{folder}/long.wav"
    both = audio.scan_audio(spark, str(folder))
    kept = both.where(F.col("source_path") == path).select("source_path").union(both.where(F.col("source_path") != path).select("source_path")).distinct()
    assert kept.count() == both.select("source_path").distinct().count()


def test_headers_and_hashes_read_no_samples(spark, folder):
    found = {r.source_path.rsplit("/", 1)[-1]: r for r in audio.audio_headers(spark, str(folder)).collect()}
    assert (found["long.wav"].channels, found["long.wav"].channel_layout, found["long.wav"].frames, found["long.wav"].duration_s) == (2, "stereo", 50_000, 6.25)
    assert found["empty.wav"].error == "the file is empty" and found["deep.wav"].frames == 3000
    for name, row in found.items():
        (at,) = folder.rglob(name)
        assert row.file_sha256 == hashlib.sha256(at.read_bytes()).hexdigest()
    with pytest.raises(Exception, match="what is"):
        spark.read.format("audio").option("what", "else").load(str(folder))


@pytest.mark.parametrize(("depth", "packing"), [(16, None), (24, None), (16, b"sowt"), (16, b"NONE")])
def test_aiff(spark, tmp_path, depth, packing):
    x = noise(9, 5000, 2) * 0.9
    (tmp_path / "a.aiff").write_bytes(aiff(x, 44_100, depth, packing))
    rows = {r.channel: r for r in audio.scan_audio(spark, str(tmp_path)).collect()}
    assert set(rows) == {-1, 0, 1} and (rows[0].sample_rate, rows[0].bit_depth, rows[0].frames) == (44_100, depth, 5000)
    assert rows[1].samples == pytest.approx(x[1], abs=2.0 ** (1 - depth))


def test_other_headers(tmp_path):
    def read(raw):
        return formats.layout(lambda at, n: raw[at : at + n], len(raw))

    plain = wav.encode(noise(1, 100), RATE)
    assert read(plain) == formats.Layout(RATE, 16, 1, 100, 44, "<i2")
    long = b"RF64\xff\xff\xff\xffWAVEds64" + struct.pack("<IQQQI", 28, 0, 200, 100, 0) + plain[12:36] + b"data\xff\xff\xff\xff" + plain[44:]
    assert read(long)[:4] == (RATE, 16, 1, 100) and formats.samples(long[read(long).data :], read(long)).tolist() == wav.parse(plain)[2].tolist()
    extensible = plain[:16] + struct.pack("<IHHIIHH", 40, 0xFFFE, 1, RATE, 4 * RATE, 4, 32) + struct.pack("<HHIH", 22, 32, 4, 3) + bytes(14) + b"data" + struct.pack("<I", 8) + struct.pack("<ff", 0.5, -0.25)
    assert read(extensible).kind == "<f4" and wav.parse(extensible)[2].tolist() == [[0.5, -0.25]]
    for bad in (b"", b"RIFF0000WAVE", plain[:44], b"FORM\0\0\0\4AIFF", aiff(noise(1, 4), RATE, 16, b"ulaw"), plain[:20] + b"\7\0" + plain[22:]):
        with pytest.raises(formats.AudioError):
            read(bad)
    assert read(plain[:-50]).frames == 75  # a truncated file gives the frames it has


def test_a_long_file_is_shared_by_tasks(spark, tmp_path):
    """3 GB of which only 4 MB are written: the rest is a hole in the file."""
    frames, at = 1_500_000_000, tmp_path / "long.wav"
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + 2 * frames, b"WAVE", b"fmt ", 16, 1, 1, 48_000, 96_000, 2, 16, b"data", 2 * frames)
    marks = noise(3, 1 << 20)[0]
    with open(at, "wb") as f:
        f.write(head)
        for n, k in enumerate((0, 700_000_000, frames - (1 << 20))):
            f.seek(44 + 2 * k)
            f.write(wav.encode(marks * (n + 1) / 3, 48_000)[44:])
        f.truncate(44 + 2 * frames)
    chunks = audio.scan_audio(spark, str(tmp_path), after_s=0.1, before=64)
    assert chunks.rdd.getNumPartitions() == -(-(44 + 2 * frames) // audio.SPLIT) > 20
    k = 700_000_000 // wav.CHUNK
    row = chunks.where((F.col("start") >= k * wav.CHUNK) & (F.col("start") < (k + 1) * wav.CHUNK)).drop("left", "right")
    per = chunks.select("start", F.size("samples").alias("n"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + F.abs(x)).alias("sum")).groupBy().agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.countDistinct("start").alias("chunks")).first()
    assert (per.n, per.chunks) == (frames, -(-frames // wav.CHUNK)) and per.sum == pytest.approx(2 * np.abs(marks).sum(), rel=1e-3)
    assert row.first().samples[700_000_000 - k * wav.CHUNK :][:5] == pytest.approx(marks[:5] * 2 / 3, abs=1e-4)


@pytest.mark.parametrize("rate", [48_000, 16_000, 44_100])
def test_resampled_chunks_are_the_same_at_any_split(spark, tmp_path, rate):
    t = np.arange(30_000) / 44_100
    (tmp_path / "t.wav").write_bytes(wav.encode(np.array([0.5 * np.sin(2 * np.pi * 440 * t), 0.3 * np.sin(2 * np.pi * 1000 * t)]), 44_100))
    sides = []
    for chunk, split in ((1 << 17, 1 << 30), (3000, 9000)):
        rows = audio.scan_audio(spark, str(tmp_path), chunk=chunk, split=split, before=200, after_s=0.02, resample=rate).orderBy("channel", "start").collect()
        assert {(r.sample_rate, r.frames) for r in rows} == {(rate, -(-30_000 * rate // 44_100))}
        whole = {}
        for r in rows:
            assert len(whole.setdefault(r.channel, [])) == r.start
            assert r.left == whole[r.channel][max(0, r.start - 200) :]
            whole[r.channel].extend(r.samples)
        sides.append(whole)
    assert sides[0] == sides[1] and set(sides[0]) == {-1, 0, 1}
    out = np.arange(len(sides[0][0])) / rate
    expected = 0.5 * np.sin(2 * np.pi * 440 * out)
    assert np.array(sides[0][0])[200:-200] == pytest.approx(expected[200:-200], abs=0.01)
    assert audio.audio_headers(spark, str(tmp_path)).first().sample_rate == 44_100

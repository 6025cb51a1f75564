"""Policy, comparison, evidence, profiles, sinks, command line and streams on small findings."""

import csv
import glob
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.__main__ import main
from tonegrid.operators import comparison, evidence, levels, policy, runs
from tonegrid.operators.analysis import known_parameters
from tonegrid.sources import profiles, sinks, wav
from tonegrid.streaming import gates


def findings(spark, *rows):
    return spark.createDataFrame(list(rows), "file_id string, analyzer string, metric string, value double, status string")


def test_escalation_only_raises_flagged_findings(spark):
    df = findings(spark, ("f", "clipping", "p", 1.0, "warning"), ("f", "clipping", "p", 0.0, "pass"), ("f", "glitch", "n", 2.0, "needs_review"), ("f", "loop", "j", 1.0, "fail"), ("f", "lra", "r", 1.0, "warning"))
    raised = policy.escalate(df, {"clipping": {"p": "fail"}, "glitch": {"*": "error"}, "loop": {"j": "pass"}, "lra": {"r": "nonsense"}})
    assert [r.status for r in raised.orderBy("analyzer", "value").collect()] == ["pass", "fail", "error", "fail", "warning"]
    verdict = policy.aggregate_status(raised, "file_id").first()
    assert (verdict.aggregate_status, verdict.findings, verdict.flagged) == ("error", 5, 4)


def test_golden_diff_names_every_kind(spark):
    golden = lambda *rows: spark.createDataFrame(list(rows), "fixture string, analyzer string, metric string, value double, status string")
    old = golden(("f", "a", "m", 1.0, "pass"), ("f", "b", "m", 1.0, "pass"), ("f", "c", "m", 1.0, "pass"), ("f", "d", "m", None, "pass"))
    new = golden(("f", "a", "m", 1.4, "pass"), ("f", "b", "m", 2.0, "fail"), ("f", "e", "m", 1.0, "pass"), ("f", "d", "m", 1.0, "pass"))
    got = {(r.analyzer, r.kind) for r in comparison.golden_diff(old, new, F.lit(0.5)).collect()}
    assert got == {("b", "value_drift"), ("b", "status_change"), ("c", "missing"), ("e", "extra"), ("d", "value_drift")}


def test_field_diff_masks_prefixes(spark):
    doc = lambda *rows: spark.createDataFrame(list(rows), "subject string, path string, value string")
    got = comparison.field_diff(doc(("s", "a", "1"), ("s", "b.c", "1"), ("s", "x", "1")), doc(("s", "a", "2"), ("s", "b.c", "9"), ("s", "y", None)), masked=("b",))
    assert {(r.path, r.kind) for r in got.collect()} == {("a", "changed"), ("x", "missing"), ("y", "added")}


def test_detector_scores_are_null_where_nothing_divides(spark):
    cases = spark.createDataFrame([("d", True, True), ("d", False, True), ("e", False, False)], "detector string, expected boolean, flagged boolean")
    got = {r.detector: r for r in comparison.detector_scores(cases, "detector").collect()}
    assert (got["d"].precision, got["d"].recall, got["e"].precision, got["e"].recall) == (0.5, 1.0, None, None)


def test_redaction_and_fingerprint(spark):
    df = spark.createDataFrame([("mail a.b@c.org or 4111-111111111111 in /home/ann/x",)], "t string")
    assert df.select(evidence.redact(F.col("t"))).first()[0] == "mail [REDACTED:email] or [REDACTED:card] in [REDACTED:userpath]/x"
    one = findings(spark, ("f", "a", "m", 1.0, "pass"), ("f", "b", "m", 2.0, "pass"))
    two = findings(spark, ("f", "b", "m", 2.0, "pass"), ("f", "a", "m", 1.0, "pass"))
    assert evidence.fingerprints(one, "file_id").first() == evidence.fingerprints(two, "file_id").first()


def test_a_changed_line_breaks_a_chain(spark):
    import hashlib

    rows, previous = [], ""
    for i in range(5):
        h = hashlib.sha256(f"p{i}|{previous}".encode()).hexdigest()
        rows.append(("log", i, f"p{i}", previous, h))
        previous = h
    schema = "log string, line int, payload string, prev_hash string, entry_hash string"
    check = lambda lines: evidence.verify_chain(spark.createDataFrame(lines, schema), F.col("payload")).first()
    assert check(rows).valid
    rows[2] = ("log", 2, "other", *rows[2][3:])
    assert (check(rows).bad_hashes, check(rows).broken_links) == (1, 0)
    assert check(rows[:1] + rows[2:]).broken_links == 1


def test_dropouts_and_louder_signals(spark):
    x = 0.3 * np.sin(2 * np.pi * 440 * np.arange(4000) / 44_100)
    x[2000:2600] = 0
    signal = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "channel long, frame long, x double")
    assert [(r.start, r.length) for r in runs.dropouts(signal, 0.001, 441, 10.0).collect()] == [(2000, 600)]
    level = lambda s: levels.gated_loudness(s, 400, 100).first().lufs
    assert level(signal.withColumn("x", F.col("x") * 2)) - level(signal) == pytest.approx(20 * np.log10(2))


def test_profiles_extend_and_refuse(tmp_path):
    broadcast = profiles.load_profile("broadcast", strict=True, known=known_parameters())
    assert broadcast["analyzers"]["loudness"]["min_lufs"] == -23.5 and broadcast["analyzers"]["clipping"]["threshold"] == 0.99
    assert broadcast["strict_overlay"] and not profiles.load_profile("broadcast")["strict_overlay"]
    for text in ("name: x", "name: x\nversion: '1'\nanalyzers: {nothing: {}}", "name: x\nversion: '1'\nanalyzers: {lra: {odd: 1}}", "name: x\nversion: '1'\ndata_classification: odd", "extends: odd"):
        (tmp_path / "p.yaml").write_text(text)
        with pytest.raises(profiles.ProfileError):
            profiles.load_profile(str(tmp_path / "p.yaml"), known=known_parameters())


def test_sinks(spark, tmp_path):
    df = findings(spark, ("f<1>", "clipping", "p", 1.5, "fail"), ("f<1>", "clipping", "p", 2.5, "warning"), ("g", "loop", "j", None, "pass"))
    sinks.write_csv(df, f"{tmp_path}/csv")
    rows = [r for f in glob.glob(f"{tmp_path}/csv/*.csv") for r in csv.DictReader(open(f, newline=""))]
    assert tuple(rows[0]) == sinks.CSV_COLUMNS and len(rows) == 3
    sarif = {r.file_id: json.loads(r.sarif) for r in sinks.sarif_documents(df).collect()}["f<1>"]
    assert sarif["version"] == "2.1.0" and [r["id"] for r in sarif["runs"][0]["tool"]["driver"]["rules"]] == ["clipping/p"]
    assert sorted(r["level"] for r in sarif["runs"][0]["results"]) == ["error", "warning"]
    html = {r.file_id: r.html for r in sinks.html_documents(df).collect()}["f<1>"]
    assert "f&lt;1&gt;" in html and "<1>" not in html


@pytest.mark.parametrize("form", ["json", "csv", "sarif", "html", "bundle"])
def test_command_line(spark, tmp_path, form):
    tone = (0.5 * np.sin(2 * np.pi * 1000 * np.arange(44_100) / 44_100)).astype(np.float32)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes(wav.encode(np.array([tone]), 44_100))
    args = ["analyze", str(tmp_path / "in"), "--format", form, "--output", str(tmp_path / "out"), "--only", "loudness,true_peak,clipping,inspect"]
    assert main(args, spark) == 0
    assert main([*args[:-4], "--output", str(tmp_path / "strict"), "--strict", "--only", "loudness"], spark) == 1
    if form == "json":
        got = {r.metric: r for r in spark.read.json(str(tmp_path / "out")).collect()}
        assert got["integrated_loudness"].value == pytest.approx(-8.81, abs=0.01) and got["integrated_loudness"].status == "warning"
        assert got["integrated_loudness"].confidence == 0.95 and got["integrated_loudness"].check_id == "loudness.integrated"
        assert main(["inspect", args[1], "--output", str(tmp_path / "subjects")], spark) == 0
        assert main(["validate", "broadcast"], spark) == 0 and main(["validate", "no such profile"], spark) == 2
        assert main(["compliance", args[1], "--output", str(tmp_path / "targets")], spark) == 1


    if form == "bundle":
        assert main([*args[:-4], "--output", str(tmp_path / "other"), "--only", "true_peak", "--resample", "48000"], spark) == 0
        other = json.loads(spark.read.text(str(tmp_path / "other")).first().value)
        assert other["subject"]["sample_rate_hz"] == 48_000 and other["subject"]["provenance"] == {"frames": 44_100, "resampled_to_hz": 48_000, "sample_rate_hz": 44_100}
        assert other["findings"][0]["value"] == pytest.approx(20 * np.log10(0.5), abs=0.02)
        (row,) = spark.read.text(str(tmp_path / "out")).collect()
        bundle = json.loads(row.value)
        assert list(bundle) == sorted(bundle) and bundle["aggregate_status"] == "warning" and bundle["profile"]["name"] == "default"
        assert [f["analyzer"] for f in bundle["findings"]] == ["clipping", "inspect", "loudness", "true_peak"] and bundle["subject"]["frames"] == 44_100
        assert len(bundle["measurement_fingerprint"]) == 64


def test_golden_kinds_and_detector_report(spark):
    from tonegrid.operators import comparison

    schema = "fixture string, analyzer string, metric string, value double, status string, rule_id string"
    old = [("f", "a", "gone", 1.0, "pass", None), ("f", "a", "many", 1.0, "pass", None), ("f", "a", "many", 2.0, "pass", None), ("f", "a", "moved", 1.0, "pass", "R1"), ("f", "a", "same", 1.0, "pass", "R1"), ("f", "a", "void", None, "pass", None)]
    new = [("f", "a", "many", 1.0, "pass", None), ("f", "a", "moved", 1.5, "fail", "R2"), ("f", "a", "new", 1.0, "pass", None), ("f", "a", "new", 3.0, "pass", None), ("f", "a", "same", 1.05, "pass", "R1"), ("f", "a", "void", 0.0, "pass", None)]
    got = {(r.metric, r.kind) for r in comparison.golden_diff(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), F.lit(0.1)).collect()}
    assert got == {("gone", "missing"), ("many", "value_drift"), ("moved", "value_drift"), ("moved", "status_change"), ("moved", "rule_id_change"), ("new", "extra"), ("void", "value_drift")}
    scores = comparison.detector_scores(spark.createDataFrame([("x", True, True), ("x", True, False), ("y", False, False)], "rule string, expected boolean, flagged boolean"), "rule")
    assert [r.line for r in comparison.detector_report(scores, "rule").collect()][2:] == ["| x | 1 | 0 | 1 | 1.00 | 0.50 |", "| y | 0 | 0 | 0 | n/a | n/a |"]


def test_streams_equal_batches(spark, tmp_path):
    rows = [("a", f"2024-01-01 {h:02d}:{m:02d}:00", float(h + m)) for h in range(5) for m in (0, 7, 41)]
    events = spark.createDataFrame(rows, "channel string, ts string, x double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    for name, run in (("levels", lambda e: gates.windowed_levels(e, 30.0)), ("runs", gates.sessions)):
        query = run(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name == "levels" else "append").start()
        query.processAllAvailable()
        query.stop()
        batch = {tuple(r) for r in run(events).collect()}
        got = {tuple(r) for r in spark.table(name).collect()}
        assert got == batch if name == "levels" else got <= batch and got


def tones(folder, **amplitudes):
    folder.mkdir()
    for name, a in amplitudes.items():
        tone = (a * np.sin(2 * np.pi * 1000 * np.arange(44_100) / 44_100)).astype(np.float32)
        (folder / f"{name}.wav").write_bytes(wav.encode(np.array([tone]), 44_100))
    return str(folder)


def test_compare_freeze_and_verify(spark, tmp_path):
    soft, loud = tones(tmp_path / "soft", x=0.1, y=0.1), tones(tmp_path / "loud", x=0.1, y=1.0)
    only = ["--only", "loudness,true_peak,clipping"]
    run = lambda n, command, path, *more: main([command, path, *only, *more, "--output", f"{tmp_path}/o{n}"], spark)
    assert run(1, "compare", soft, "--other", loud) == 1 and run(2, "compare", soft, "--other", soft) == 0
    got = {r.file_id: r for r in spark.read.json(f"{tmp_path}/o1").collect()}
    assert got["y"].regression and not got["x"].regression and got["y"].only_in_b.split(",") == ["AS-LOUD-001", "AS-PEAK-001", "AS-PEAK-002"]
    assert {d.metric: d.delta for d in got["y"].deltas}["true_peak"] == pytest.approx(20, abs=0.01) and "AS-PEAK-001" in got["y"].reasons[0] and got["x"].reasons == []
    assert run(3, "freeze", soft, "--golden", f"{tmp_path}/golden") == 0
    assert run(4, "verify", soft, "--golden", f"{tmp_path}/golden") == 0 and run(5, "verify", loud, "--golden", f"{tmp_path}/golden") == 1


def test_only_rules_of_objective_analyzers_regress(spark):
    a = findings(spark, ("f", "loudness", "integrated_loudness", -20.0, "pass"), ("f", "clipping", "clipped_sample_pct", 1.0, "fail"), ("f", "glitch", "glitch_event_count", 1.0, "warning"), ("g", "lra", "loudness_range", 3.0, "pass"))
    b = findings(
        spark, ("f", "loudness", "integrated_loudness", -12.0, "needs_review"), ("f", "clipping", "error", None, "error"), ("f", "glitch", "glitch_event_count", 2.0, "fail"), ("f", "glitch", "odd", 2.0, "fail"),
        ("g", "lra", "loudness_range", 9.0, "warning"), ("g", "timbre_distance", "timbre_distance", 0.12345678, "needs_review"), ("h", "true_peak", "true_peak", 1.0, "fail"),
    )
    got = {r.file_id: r for r in comparison.comparison(a, b, "file_id").collect()}
    assert (got["f"].only_in_a, got["f"].only_in_b, got["f"].unchanged, got["f"].regression) == ("AS-PEAK-002", "AS-LOUD-001", "AS-DEF-001", True)
    assert [(d.metric, d.delta) for d in got["f"].deltas] == [("integrated_loudness", 8.0)] and got["f"].reasons == ["new objective defects: AS-LOUD-001"]
    assert not got["g"].regression and [(o.rule_id, o.value, o.status) for o in got["g"].observations] == [("AS-DESC-001", 0.123457, "needs_review"), ("AS-DESC-007", 9.0, "warning")]
    assert got["h"].only_in_b == "AS-PEAK-001" and got["h"].deltas is None


def test_audit_logs(spark, tmp_path):
    from tonegrid.operators import audit

    (tmp_path / "logs").mkdir()
    lines, previous = [], ""
    for i in range(4):
        lines.append(audit.entry("me", "analyze", f"f{i}", {"b": 1, "a": [1.5, None]}, previous, "2024-01-01T00:00:00Z"))
        previous = lines[-1]["entry_hash"]
    (tmp_path / "logs" / "good.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    assert main(["audit", str(tmp_path / "logs"), "--output", f"{tmp_path}/good"], spark) == 0
    lines[1]["subject"] = "other"
    (tmp_path / "logs" / "bad.jsonl").write_text("\n".join([json.dumps(lines[0]), json.dumps(lines[1]), "{", json.dumps(lines[3])]))
    assert main(["audit", str(tmp_path / "logs"), "--output", f"{tmp_path}/bad"], spark) == 1
    assert {(r.line, r.problem) for r in spark.read.json(f"{tmp_path}/bad").collect()} == {(1, "hash mismatch"), (2, "invalid JSON"), (3, "chain broken")}


def test_two_writers_cannot_fork_a_log(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from tonegrid.operators import audit

    log = str(tmp_path / "log")
    say = lambda who, n: audit.append(spark, log, [{"actor": who, "action": "analyze", "subject": f"{who}{n}.{i}", "details": {"n": n}} for i in range(2)])
    with ThreadPoolExecutor(4) as pool:
        paths = list(pool.map(lambda job: say(*job), [(who, n) for n in range(6) for who in "abcd"]))
    assert len(set(paths)) == 24 and sorted(p.rsplit("/", 1)[-1] for p in paths) == [f"{i:08d}.jsonl" for i in range(1, 25)]
    lines = audit.read_segments(spark, log).orderBy("line").collect()
    assert len(lines) == 48 and len({json.loads(x.text)["prev_hash"] for x in lines}) == 48
    assert audit.verify_logs(audit.read_segments(spark, log)).count() == 0
    assert main(["audit", log, "--append", json.dumps({"actor": "me", "action": "a", "subject": "s"})], spark) == 0
    assert main(["audit", log, "--segments", "--output", f"{tmp_path}/good"], spark) == 0
    (tmp_path / "log" / "00000007.jsonl").write_text((tmp_path / "log" / "00000006.jsonl").read_text())
    assert main(["audit", log, "--segments", "--output", f"{tmp_path}/bad"], spark) == 1
    assert {r.line >> 32 for r in spark.read.json(f"{tmp_path}/bad").collect()} == {7, 8}


def test_parameters_out_of_range_are_refused(tmp_path):
    for name, params in (("clipping", "{threshold: 1.5}"), ("glitch", "{dropout_threshold: 0.2}"), ("glitch", "{repeat_min_samples: 3}"), ("pitch_f0", "{fmin: 0}"), ("loop", "{loop_point_samples: 0}")):
        (tmp_path / "p.yaml").write_text(f"name: p\nversion: '1'\nanalyzers:\n  {name}: {params}\n")
        with pytest.raises(profiles.ProfileError):
            profiles.load_profile(str(tmp_path / "p.yaml"), known=known_parameters())
    (tmp_path / "p.yaml").write_text("name: p\nversion: '1'\nanalyzers:\n  glitch: {dropout_threshold: 0.1}\n  loop: {loop_point_ms: 12.5}\n")
    assert profiles.load_profile(str(tmp_path / "p.yaml"), known=known_parameters())["analyzers"]["loop"] == {"loop_point_ms": 12.5}


def test_plugins_add_analyzers(spark, tmp_path):
    from tonegrid.operators import analysis

    (tmp_path / "plugin.py").write_text(
        "from pyspark.sql import functions as F\nfrom tonegrid.operators.analysis import finding, register\n\n\n"
        "@register('length', 'most_s')\ndef length(chunks, params):\n"
        "    per = chunks.groupBy('file_id').agg(F.max(F.col('frames') / F.col('sample_rate')).alias('s'))\n"
        "    return finding(per, 'length', F.lit('length.s'), F.lit('length'), F.col('s'), 's', F.when(F.col('s') > params.get('most_s', 9), 'fail').otherwise('pass'), 'header')\n"
    )
    (tmp_path / "p.yaml").write_text("name: p\nversion: '1'\nanalyzers: {length: {most_s: 0.5}}")
    folder = tones(tmp_path / "in", x=0.1)
    try:
        assert main(["analyze", folder, "--profile", str(tmp_path / "p.yaml"), "--plugin", str(tmp_path / "plugin.py"), "--output", f"{tmp_path}/out"], spark) == 1
        assert [r.metric for r in spark.read.json(f"{tmp_path}/out").collect()] == ["length"]
        with pytest.raises(ValueError):
            analysis.register("length")
    finally:
        analysis.REGISTRY.clear()

"""Policy on findings (file_id, analyzer, metric, value, status): selection, escalation, verdicts, rules, compliance.

Dimensions (statuses, rules, remediation, targets) are literal maps and small arrays in the plan:
fixed sizes, no joins to shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses from least to most severe.
STATUSES = ("not_applicable", "pass", "indeterminate", "needs_review", "warning", "fail", "error")
ESCALATABLE = ("warning", "needs_review")
SEVERITY = {
    "pass": "info", "warning": "warning", "fail": "error", "error": "critical",
    "needs_review": "warning", "indeterminate": "info", "not_applicable": "info",
}
#: Rule identifiers by analyzer and metric.
RULES = {
    "loudness": {"integrated_loudness": "AS-LOUD-001"},
    "true_peak": {"true_peak": "AS-PEAK-001"},
    "clipping": {"clipped_sample_pct": "AS-PEAK-002"},
    "glitch": {"glitch_event_count": "AS-DEF-001"},
    "loop": {"loop_amplitude_jump": "AS-DEF-002"},
    "mono_compat": {"max_band_loss": "AS-CHAN-001"},
    "channel_balance": {"delta_lufs": "AS-CHAN-002"},
    "spatial_coherence": {"max_off_diag_correlation": "AS-CHAN-003"},
    "binaural_compat": {"lateral_low_energy_db": "AS-CHAN-004"},
    "goniometer": {"mean_correlation": "AS-CHAN-005"},
    "multichannel_layout": {"lfe_low_freq_energy_pct": "AS-CHAN-006"},
    "spectral_health": {"spectral_centroid": "AS-SPEC-001"},
    "spectral_irregularity": {"spectral_irregularity": "AS-SPEC-002"},
    "resampling": {"aliasing_level_db": "AS-SPEC-003"},
    "ref_quality": {"stoi_proxy": "AS-REF-001", "visqol_proxy": "AS-REF-002", "si_sdr_db": "AS-REF-003"},
    "stem_sep": {"si_sdr_db": "AS-REF-004", "leakage_pct": "AS-REF-005"},
    "voice_artifacts": {"artifact_frame_count": "AS-VOX-001"},
    "speech_intelligibility": {"stoi_proxy_no_ref": "AS-VOX-002"},
    "speech_rate": {"syllables_per_second": "AS-VOX-003"},
    "pitch_stab": {"pitch_drift_cents": "AS-VOX-004"},
    "transient": {"attack_time_ms": "AS-VOX-005"},
    "acoustic_context": {"scene_change_count": "AS-VOX-006", "reverberation_time": "AS-VOX-007", "noise_floor_db": "AS-VOX-008"},
    "enf_phase": {"phase_discontinuity_count": "AS-FORE-001"},
    "deepfake": {"synthetic_likeness_score": "AS-FORE-002"},
    "codec_conf": {"compliance_status": "AS-META-001"},
    "inspect": {"metadata": "AS-META-002"},
    "acoustic_fingerprint": {"fingerprint_sha256": "AS-META-003"},
    "metadata_schema_validator": {"schema_completeness": "AS-META-004"},
    "timbre_distance": {"timbre_distance": "AS-DESC-001"},
    "harmonic_tension": {"harmonic_tension": "AS-DESC-002"},
    "fatigue_index": {"fatigue_index": "AS-DESC-003"},
    "rhythmic_grid_alignment": {"rhythmic_grid_alignment": "AS-DESC-004"},
    "melodic_contour": {"melodic_contour_direction": "AS-DESC-005"},
    "inharmonicity": {"inharmonicity": "AS-DESC-006"},
    "lra": {"loudness_range": "AS-DESC-007"},
    "pitch_f0": {"f0_median_hz": "AS-DESC-008"},
}
#: What to do about an analyzer's errors, and why they matter.
REMEDIATION = {
    "clipping": ("Reduce input gain before the ADC or apply a brickwall limiter at -1 dBTP.", "Clipping introduces irreversible harmonic distortion."),
    "glitch": ("Re-export from the source project, checking for buffer underruns.", "Digital glitches indicate transport or processing errors."),
    "true_peak": ("Apply a true-peak limiter with ceiling at -1.0 dBTP.", "Inter-sample peaks above -1 dBTP can cause DAC clipping."),
    "mono_compat": ("Check for phase issues. Use a correlation meter and fix polarity.", "Mono compatibility loss degrades mono playback systems."),
    "channel_balance": ("Verify channel routing and gain staging. Re-pan or adjust gains.", "Channel imbalance sounds off-center on stereo playback."),
    "loop": ("Apply a crossfade at the loop boundary or align to zero crossing.", "Loop discontinuity causes audible clicks at the loop boundary."),
}
#: Delivery targets, with their loudness, its tolerance and the highest true peak.
TARGETS = {"ebu": (-23.0, 0.5, -1.0), "spotify": (-14.0, 1.0, -1.0), "podcast": (-16.0, 1.0, -1.0), "atsc": (-24.0, 2.0, -2.0), "cine": (-27.0, 2.0, -2.0)}


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def rank(status: Column) -> Column:
    """Place of a status in the order of severity, from 0; null for an unknown one."""
    return F.nullif(F.array_position(F.array(*[F.lit(s) for s in STATUSES]), status), F.lit(0)) - 1


def escalate(findings: DataFrame, overlay: dict[str, dict[str, str]]) -> DataFrame:
    """``findings`` with statuses raised by an overlay {analyzer: {metric or *: status}}.

    Only warnings and reviews are raised, never lowered; unknown statuses of the overlay do nothing.
    """
    rows = {f"{a}\x1f{m}": s for a, by in overlay.items() for m, s in by.items()}
    if not rows:
        return findings
    found = literal_map(rows)
    of = lambda metric: F.try_element_at(found, F.concat_ws("\x1f", F.col("analyzer"), metric))
    wanted = F.coalesce(of(F.col("metric")), of(F.lit("*")))
    raised = F.col("status").isin(*ESCALATABLE) & (rank(wanted) > rank(F.col("status")))
    return findings.withColumn("status", F.when(raised, wanted).otherwise(F.col("status")))


def aggregate_status(findings: DataFrame, *keys: str) -> DataFrame:
    """The severest status of each key, and counts of the flagged ones."""
    return findings.groupBy(*keys).agg(
        F.coalesce(F.max_by("status", rank(F.col("status"))), F.lit("pass")).alias("aggregate_status"), F.count(F.lit(1)).alias("findings"),
        F.count_if(rank(F.col("status")) >= STATUSES.index("warning")).alias("flagged"),
    )


def select_analyzers(findings: DataFrame, only: tuple | None = None, skip: tuple = ()) -> DataFrame:
    """Findings of the analyzers that are asked for and not skipped: plain filters, which reach the scan."""
    kept = findings if only is None else findings.where(F.col("analyzer").isin(*only))
    return kept.where(~F.col("analyzer").isin(*skip)) if skip else kept


#: Findings less sure than this say whether a person has to look.
SURE = 0.9


def enrich(findings: DataFrame) -> DataFrame:
    """``findings`` with rule_id, rule_class, severity, recommendation and why_it_matters; where they have a confidence, requires_human_review too."""
    rules = literal_map({f"{a}\x1f{m}": r for a, by in RULES.items() for m, r in by.items()})
    advice = lambda i: literal_map({a: texts[i] for a, texts in REMEDIATION.items()})
    rule, name = F.try_element_at(rules, F.concat_ws("\x1f", "analyzer", "metric")), F.col("analyzer")
    out = findings.withColumn("rule_id", rule).withColumn("severity", F.coalesce(F.try_element_at(literal_map(SEVERITY), F.col("status")), F.lit("info")))
    serious = F.col("severity").isin("error", "critical")
    kind = F.when(F.col("rule_id").startswith("AS-DESC-"), "descriptive").when(F.col("rule_id").startswith("AS-FORE-"), "forensic").when(F.col("rule_id").isNotNull(), "objective")
    if "confidence" in findings.columns:
        out = out.withColumn("requires_human_review", F.when(F.col("confidence") < SURE, F.col("status").isin("needs_review", "indeterminate")))
    return out.withColumns({
        "rule_class": kind,
        "recommendation": F.when(serious, F.coalesce(F.try_element_at(advice(0), name), F.concat(F.lit("Review the "), name, F.lit(" finding and consult documentation.")))),
        "why_it_matters": F.when(serious, F.coalesce(F.try_element_at(advice(1), name), F.concat(F.lit("The "), name, F.lit(" analyzer detected a potential quality issue.")))),
    })


def compliance(measured: DataFrame) -> DataFrame:
    """(file_id, target, lufs_delta, true_peak_margin, overall) of (file_id, lufs, dbtp), for each of the five targets."""
    targets = F.array(*[F.struct(F.lit(t).alias("target"), *[F.lit(v).alias(n) for n, v in zip(("lufs_target", "tolerance", "most"), values, strict=True)]) for t, values in TARGETS.items()])
    each = measured.select("file_id", "lufs", "dbtp", F.inline(targets))
    good = (F.abs(F.col("lufs") - F.col("lufs_target")) <= F.col("tolerance")) & (F.col("dbtp") <= F.col("most"))
    return each.select(
        "file_id", "target", F.round(F.col("lufs") - F.col("lufs_target"), 2).alias("lufs_delta"),
        F.round(F.col("most") - F.col("dbtp"), 3).alias("true_peak_margin"), F.when(good, "pass").otherwise("fail").alias("overall"),
    )


def rule_violations(findings: DataFrame) -> DataFrame:
    """Findings whose rule is descriptive or forensic, yet fail: there must be none."""
    return enrich(findings).where(F.col("rule_class").isin("descriptive", "forensic") & F.col("status").isin("fail", "error"))

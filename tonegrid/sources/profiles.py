"""Profiles: YAML files that say which analyzers run, with which thresholds, and what a strict run raises."""

from __future__ import annotations

from pathlib import Path

import yaml

CLASSIFICATIONS = ("public", "internal", "confidential", "restricted")
#: The least and the greatest value of parameters, None where there is no bound; those in ABOVE must exceed the least.
RANGES = {
    "acoustic_context": {"scene_change_threshold_deg": (0.0, None), "max_rt60_s": (0.0, None)},
    "clipping": {"threshold": (0.0, 1.0), "max_clipped_pct": (0.0, None)},
    "codec_conf": {"frame_tolerance_pct": (0.0, None)},
    "enf_phase": {"min_duration_s": (1.0, None), "phase_threshold_rad": (0.1, None)},
    "glitch": {"click_sensitivity": (1.0, None), "dropout_min_ms": (1.0, None), "dropout_threshold": (0.0, 0.1), "repeat_min_samples": (4, None), "min_events_for_warning": (1, None)},
    "loop": {"loop_point_ms": (0, None), "loop_point_samples": (1, None), "amplitude_threshold": (0.0, None), "derivative_threshold": (0.0, None)},
    "pitch_f0": {"fmin": (0, None), "fmax": (0, None)},
    "pitch_stab": {"max_drift_cents": (0.0, None)},
    "spectral_health": {"n_fft": (64, None), "hop": (16, None)},
    "spatial_coherence": {"max_off_diag_corr": (0.0, 1.0)},
    "speech_intelligibility": {"min_score": (0.0, 1.0)},
    "speech_rate": {"max_syllables_per_sec": (1.0, None)},
    "transient": {"max_attack_ms": (0.1, None)},
}
#: What parameters may be that are words.
CHOICES = {"ref_quality": {"mode": ("no-reference", "speech-full-ref", "audio-full-ref", "source-sep-ref")}}
ABOVE = {("pitch_f0", "fmin"), ("pitch_f0", "fmax")}
FOLDER = Path(__file__).resolve().parent.parent / "profiles"


class ProfileError(ValueError):
    """A profile that can't be used."""


def merged(base: dict, over: dict) -> dict:
    """``base`` with ``over``: analyzers merge key by key, any other block is replaced as a whole."""
    analyzers = {a: dict(p or {}) for a, p in (base.get("analyzers") or {}).items()}
    for a, params in (over.get("analyzers") or {}).items():
        analyzers[a] = analyzers.get(a, {}) | (params or {})
    return base | over | {"analyzers": analyzers}


def _read(path: Path, seen: tuple) -> dict:
    if path in seen:
        raise ProfileError(f"profiles extend each other: {path}")
    raw = yaml.safe_load(path.read_text()) or {}
    if not isinstance(raw, dict):
        raise ProfileError(f"not a profile: {path}")
    parent = raw.pop("extends", None)
    return merged(_read(_find(str(parent), path.parent), (*seen, path)), raw) if parent else raw


def _find(name: str, near: Path) -> Path:
    for path in (near / f"{name}.yaml", near / name, FOLDER / f"{name}.yaml"):
        if path.is_file():
            return path
    raise ProfileError(f"no profile {name}")


def _fits(value: object, default: object) -> bool:
    """Whether a parameter is of its default's kind; one without default is a number."""
    if isinstance(value, bool) or isinstance(default, bool):
        return isinstance(value, bool) and isinstance(default, bool)
    if isinstance(default, int):
        return isinstance(value, int) and value > 0
    return isinstance(value, int | float) if default is None or isinstance(default, float) else isinstance(value, type(default))


def _within(analyzer: str, name: str, value: object) -> bool:
    """Whether a parameter lies in its range, or is among its choices."""
    if name in CHOICES.get(analyzer, {}):
        return value in CHOICES[analyzer][name]
    low, high = RANGES.get(analyzer, {}).get(name, (None, None))
    return (low is None or (value > low if (analyzer, name) in ABOVE else value >= low)) and (high is None or value <= high)


def load_profile(name: str, strict: bool = False, known: dict[str, dict] | None = None) -> dict:
    """The resolved profile of a path or a name; ``known`` has the parameters of each analyzer with their defaults."""
    path = Path(name) if Path(name).is_file() else _find(name, Path("."))
    profile = _read(path, ())
    for field in ("name", "version"):
        if not profile.get(field):
            raise ProfileError(f"a profile needs a {field}")
    if profile.get("data_classification", "internal") not in CLASSIFICATIONS:
        raise ProfileError(f"unknown classification {profile['data_classification']}")
    for analyzer, params in profile["analyzers"].items() if known is not None else ():
        if analyzer not in known:
            raise ProfileError(f"unknown analyzer {analyzer}")
        if odd := sorted(set(params) - set(known[analyzer])):
            raise ProfileError(f"unknown parameters of {analyzer}: {', '.join(odd)}")
        if odd := sorted(p for p, v in params.items() if not _fits(v, known[analyzer][p])):
            raise ProfileError(f"parameters of {analyzer} of the wrong kind: {', '.join(odd)}")
        if odd := sorted(p for p, v in params.items() if v is not None and not _within(analyzer, p, v)):
            raise ProfileError(f"parameters of {analyzer} out of range: {', '.join(odd)}")
    return profile | {"strict_overlay": (profile.get("strict_overlay") or {}) if strict else {}}

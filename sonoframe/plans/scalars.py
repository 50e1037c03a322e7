"""Measures of single frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from sonoframe.functions import acoustics as A
from sonoframe.plans.cases import case
from sonoframe.plans.vowels import CAVITY, DELTA, LARYNX, TONGUE
from sonoframe.sources.bindings import FRAMES, frames

C = F.col


def formants() -> list:
    return [C(f) for f in ("f1", "f2", "f3", "f4")]


def delta():
    return A.delta_f(*formants())


def scalar(name: str, columns: Callable[[], dict], sql: str, doubles: str = "") -> None:
    case(name, lambda spark, d: frames(spark, d).select("seq", *(x.alias(n) for n, x in columns().items())), f"WITH {FRAMES}, delta AS (SELECT *, {DELTA} AS delta_f FROM frames) SELECT seq, {sql} FROM delta", doubles)


scalar("delta_f", lambda: {"delta_f": delta()}, "delta_f", "delta_f")
scalar(
    "vocal_tract_length",
    lambda: {"vtl": A.vocal_tract_length(*formants())},
    "CASE WHEN len(list_filter([f1, f2, f3, f4], lambda f: f > 0)) >= 3 THEN list_avg(list_transform(list_filter([f1, f2, f3, f4], lambda f: f > 0), lambda f, i: (2 * i - 1) * 34300 / (4 * f))) ELSE 0 END AS vtl",
    "vtl",
)


def _spacing() -> dict:
    s21, s32 = A.spacing(C("f1"), C("f2")), A.spacing(C("f2"), C("f3"))
    return {"f2_f1": s21, "f3_f2": s32, "mean": F.when((s21 != 0) & (s32 != 0), (s21 + s32) / 2).otherwise(0.0)}


def _interference() -> dict:
    return dict(zip(("flag", "severity"), A.pitch_interference(C("f0"), C("f1")), strict=True))


def _bars() -> dict:
    return dict(zip(("larynx", "cavity", "tongue"), A.gesture_bars(delta(), C("f1"), C("f2")), strict=True))


def _warnings():
    found = F.when(C("hnr") < 7, F.lit("vocal_strain")), F.when(C("h1_h2") > 8, F.lit("breathiness_masking")), F.when(C("jitter") > 2.5, F.lit("jitter_high"))
    return F.array_compact(F.array(*found))


scalar(
    "formant_spacing",
    _spacing,
    "CASE WHEN f1 <> 0 AND f2 <> 0 THEN f2 - f1 ELSE 0 END AS f2_f1, CASE WHEN f2 <> 0 AND f3 <> 0 THEN f3 - f2 ELSE 0 END AS f3_f2, CASE WHEN f1 <> 0 AND f2 <> 0 AND f3 <> 0 AND f2 <> f1 AND f3 <> f2 THEN (f3 - f1) / 2 ELSE 0 END AS mean",
    "f2_f1 f3_f2 mean",
)
LEVEL = "CASE WHEN {c} > 0 AND {b} > 0 THEN 10 * log10(greatest(pow({c} * {c} + {b} * {b}, 2) / (pow(f0 * f0 - {c} * {c}, 2) + pow(f0 * {b}, 2)), 1e-10)) - 10 * log10(greatest(pow({c} * {c} + {b} * {b}, 2) / ({b} * {b} * {c} * {c}), 1e-10)) ELSE 0 END"
scalar(
    "iseli_correction",
    lambda: {"correction": A.formant_correction(C("f0"), formants()[:3], [C("bw1"), C("bw2"), C("bw3")])},
    " + ".join(LEVEL.format(c=f"f{i}", b=f"bw{i}") for i in (1, 2, 3)) + " AS correction",
    "correction",
)
scalar(
    "f0_interference",
    _interference,
    "CASE WHEN f1 > 0 THEN f0 / f1 ELSE 0 END > 0.5 AS flag, greatest(0, least(1, (CASE WHEN f1 > 0 THEN f0 / f1 ELSE 0 END - 0.3) / 0.4)) AS severity",
    "severity",
)
scalar("coupling_index", lambda: {"coupling": C("a1") - C("a4")}, "a1 - a4 AS coupling", "coupling")
scalar(
    "fullness_residual",
    lambda: {"residual": A.fullness_residual(C("tilt"), delta())},
    "CASE WHEN delta_f > 0 AND tilt <> 0 THEN tilt - (-0.015 * delta_f + 11) END AS residual",
    "residual",
)
scalar("constriction_flag", lambda: {"flag": A.amplitude_constriction(F.round(delta(), 6), C("a1"), C("a4"), C("prominence"))}, "round(delta_f, 6) > 1200 AND a4 - a1 < -15 AND prominence > 25 AS flag")
scalar("gesture_bars", _bars, f"{LARYNX} AS larynx, {CAVITY} AS cavity, {TONGUE} AS tongue", "larynx cavity tongue")
scalar("weight_factors", lambda: {"closure": A.weight_factor(C("h1_h2")), "thickness": A.weight_factor(C("h1_h2"))}, "greatest(0, least(1, (h1_h2 + 10) / 20)) AS closure, greatest(0, least(1, (h1_h2 + 10) / 20)) AS thickness", "closure thickness")
scalar("stability_pct", lambda: {"stability": A.stability_percent(C("jitter") / 40.0)}, "greatest(0, least(100, (1 - jitter / 40 / 0.10) * 100)) AS stability", "stability")
scalar("f1_delta_f_ratio", lambda: {"ratio": F.when(delta() > 0, C("f1") / delta()).otherwise(0.0)}, "CASE WHEN delta_f > 0 THEN f1 / delta_f ELSE 0 END AS ratio", "ratio")
scalar("level_db", lambda: {"db": A.decibels(C("conf"))}, "20 * log10(greatest(conf, 1e-10)) AS db", "db")
scalar(
    "contact_quotient",
    lambda: {"cq": A.contact_quotient(C("a1"), C("a4"), C("h1_h2"))},
    "greatest(0.2, least(0.8, 0.45 + 0.15 * (2 / (1 + exp(-((a4 + h1_h2) / 2 - a1) / 3)) - 1))) AS cq",
    "cq",
)
scalar(
    "level_zone",
    lambda: {"zone": A.level_zone(C("rms")), "pct": A.gauge_percent(C("rms"), -60, 0), "badge": A.score_badge(C("conf") * 100)},
    "CASE WHEN rms < -40 THEN 'too quiet' WHEN rms < -30 THEN 'quiet' WHEN rms <= -6 THEN 'good' ELSE 'hot' END AS zone, greatest(0, least(100, (rms + 60) / 60 * 100)) AS pct, CASE WHEN conf * 100 >= 70 THEN 'good' WHEN conf * 100 >= 40 THEN 'mid' ELSE 'low' END AS badge",
    "pct",
)
ZONES = [(0.0, "low"), (120.0, "middle"), (180.0, "high"), (260.0, "top")]
scalar("zone_lookup", lambda: {"zone": A.zone_of(C("f0"), ZONES)}, "CASE WHEN f0 >= 260 THEN 'top' WHEN f0 >= 180 THEN 'high' WHEN f0 >= 120 THEN 'middle' ELSE 'low' END AS zone")
scalar(
    "score_suppression",
    lambda: {"reason": A.suppressed(C("conf"), _warnings(), F.array(F.lit("breathiness_masking"), F.lit("false_fold_constriction"), F.lit("vocal_strain")))},
    "CASE WHEN conf < 0.5 THEN 'low_confidence' ELSE nullif(concat_ws(',', CASE WHEN h1_h2 > 8 THEN 'breathiness_masking' END, CASE WHEN hnr < 7 THEN 'vocal_strain' END), '') END AS reason",
)

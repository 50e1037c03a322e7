"""Operations on short series: edits of spectra, geometry and envelopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonoframe.functions import acoustics as A
from sonoframe.plans.cases import case
from sonoframe.sources.bindings import SPECTRA, spectra

C = F.col


def edited(name: str, column, sql: str) -> None:
    """A query that edits each series and returns its sum, extremes and a middle value."""

    def run(spark, d):
        y = spectra(spark, d).select("id", column().alias("y"))
        total = F.aggregate("y", F.lit(0.0), lambda s, v: s + v)
        return y.select("id", total.alias("total"), F.array_min("y").alias("low"), F.array_max("y").alias("high"), F.element_at("y", 32).alias("middle"))

    case(name, run, f"WITH {SPECTRA}, e AS (SELECT id, {sql} AS y FROM spectra) SELECT id, list_sum(y) AS total, list_min(y) AS low, list_max(y) AS high, y[32] AS middle FROM e", "total low high middle")


edited("pitch_shift", lambda: A.pitch_shifted(C("x"), 3.0), "list_transform(x, lambda v: CASE WHEN v > 0 THEN v * pow(2, 3 / 12.0) ELSE v END)")
edited("pitch_move", lambda: A.pitch_moved(F.transform("x", lambda v: v * 400), 20.0), "list_transform(x, lambda v: CASE WHEN v > 0 THEN greatest(50, v * 400 + 20) ELSE v * 400 END)")
edited("tilt_edit", lambda: A.tilted(C("x"), 125.0, 3.0), "list_transform(x, lambda v, i: CASE WHEN i = 1 THEN v ELSE v * pow(10, 3 * log2((i - 1) * 125 / 1000.0) / 10) END)")
edited(
    "aperiodicity_edit",
    lambda: A.aperiodicity_shifted(C("x"), 125.0, 0.2, 4000.0),
    "list_transform(x, lambda v, i: greatest(0, least(1, v + 0.2 * exp(-0.5 * pow(((i - 1) * 125 - 4000) / 2000.0, 2)))))",
)
edited("peak_normalise", lambda: A.peak_normalised(C("x")), "list_transform(x, lambda v: v * (pow(10, -3 / 20.0) / list_max(list_transform(x, lambda w: abs(w)))))")
case(
    "valley_depth",
    lambda spark, d: spectra(spark, d).select("id", A.valley_depth(C("x"), F.lit(5), F.lit(20)).alias("v1"), A.valley_depth(C("x"), F.lit(20), F.lit(40)).alias("v2"), A.valley_depth(C("x"), F.lit(50), F.lit(40)).alias("v3")),
    f"WITH {SPECTRA} SELECT id, greatest(0, (x[6] + x[21]) / 2 - list_min(x[6:21])) AS v1, greatest(0, (x[21] + x[41]) / 2 - list_min(x[21:41])) AS v2, CAST(0 AS DOUBLE) AS v3 FROM spectra",
    "v1 v2 v3",
)


def _point(i: int):
    return F.struct(F.element_at("x", i).alias("x"), F.element_at("x", i + 1).alias("y"))


def _middle(a, b):
    return F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))


def _pose(spark, d):
    left, right, ear_l, ear_r, hip_l, hip_r = (_point(i) for i in (1, 3, 5, 7, 9, 11))
    shoulder, ear = _middle(left, right), _middle(ear_l, ear_r)
    torso = A.distance(shoulder, _middle(hip_l, hip_r))
    elevation = (0.1 - shoulder["y"]) / torso
    asymmetry = F.abs(left["y"] - right["y"]) / torso
    forward = (ear["x"] - shoulder["x"] - 0.05) / torso
    tension = A.clamp(F.abs(elevation) * 0.5 + asymmetry * 0.2 + F.abs(forward) * 0.3, 0, 1)
    rows = spectra(spark, d).where(torso >= 0.01)
    return rows.select("id", elevation.alias("elevation"), asymmetry.alias("asymmetry"), forward.alias("forward"), tension.alias("tension"))


case(
    "pose_geometry",
    _pose,
    f"""WITH {SPECTRA}, p AS (SELECT id, x, sqrt(pow((x[1] + x[3]) / 2 - (x[9] + x[11]) / 2, 2) + pow((x[2] + x[4]) / 2 - (x[10] + x[12]) / 2, 2)) AS torso FROM spectra),
    g AS (SELECT id, (0.1 - (x[2] + x[4]) / 2) / torso AS elevation, abs(x[2] - x[4]) / torso AS asymmetry, ((x[5] + x[7]) / 2 - (x[1] + x[3]) / 2 - 0.05) / torso AS forward FROM p WHERE torso >= 0.01)
    SELECT *, greatest(0, least(1, abs(elevation) * 0.5 + asymmetry * 0.2 + abs(forward) * 0.3)) AS tension FROM g""",
    "elevation asymmetry forward tension",
)


def _face(spark, d):
    eye_l, eye_r, lip_l, lip_r, lip_u, lip_d, chin, nose, brow, inner_l, inner_r = (_point(i) for i in range(1, 23, 2))
    eyes = A.distance(eye_l, eye_r)
    width, aperture = A.distance(lip_l, lip_r), A.distance(lip_u, lip_d)
    tall = A.distance(nose, brow)
    jaw = F.abs((chin["x"] - nose["x"]) * (nose["x"] - brow["x"]) / tall + (chin["y"] - nose["y"]) * (nose["y"] - brow["y"]) / tall) / eyes
    pitch = F.degrees(F.atan2(nose["x"] - brow["x"], nose["y"] - brow["y"]))
    furrow = A.clamp(1.0 - A.distance(inner_l, inner_r) / eyes / 0.5, 0, 1)
    rows = spectra(spark, d).where((eyes >= 0.001) & (tall > 0.001))
    return rows.select("id", (width / F.greatest(aperture, F.lit(0.001))).alias("spread"), (width / eyes).alias("width"), (aperture / eyes).alias("aperture"), jaw.alias("jaw"), pitch.alias("pitch"), furrow.alias("furrow"))


DIST = "sqrt(pow(x[{a}] - x[{b}], 2) + pow(x[{a} + 1] - x[{b} + 1], 2))"
case(
    "face_geometry",
    _face,
    f"""WITH {SPECTRA}, f AS (SELECT *, {DIST.format(a=1, b=3)} AS eyes, {DIST.format(a=5, b=7)} AS w, {DIST.format(a=9, b=11)} AS h, {DIST.format(a=15, b=17)} AS tall, {DIST.format(a=19, b=21)} AS inner_brow FROM spectra)
    SELECT id, w / greatest(h, 0.001) AS spread, w / eyes AS width, h / eyes AS aperture, abs((x[13] - x[15]) * (x[15] - x[17]) / tall + (x[14] - x[16]) * (x[16] - x[18]) / tall) / eyes AS jaw,
      degrees(atan2(x[15] - x[17], x[16] - x[18])) AS pitch, greatest(0, least(1, 1 - inner_brow / eyes / 0.5)) AS furrow FROM f WHERE eyes >= 0.001 AND tall > 0.001""",
    "spread width aperture jaw pitch furrow",
)

"""Single values worked out by hand or known from the definitions."""

import pytest
from pyspark.sql import functions as F

from sonoframe.functions import acoustics as A
from sonoframe.functions import spanish as S
from sonoframe.operators import folds
from sonoframe.operators import frames as O


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lits(*xs):
    return [F.lit(float(x)) for x in xs]


@pytest.mark.parametrize(("formants", "want"), [((500, 1500, 2500, 3500), 1000.0), ((500, 1500, 2500, 0), 1000.0), ((500, 1500, 0, 0), 0.0)])
def test_delta_f(spark, formants, want):
    assert value(spark, A.delta_f(*lits(*formants))) == pytest.approx(want)


def test_tract_and_bars(spark):
    assert value(spark, A.vocal_tract_length(*lits(500, 1500, 2500, 3500))) == pytest.approx(17.15)
    assert [value(spark, b) for b in A.gesture_bars(*lits(1207, 0, 2200))] == [100, 0, 100]
    assert value(spark, A.stability_percent(F.lit(0.05))) == pytest.approx(50)


def test_nearest_vowel(spark):
    assert value(spark, A.nearest_vowel(*lits(450, 1200))) == "OW"
    assert value(spark, A.nearest_vowel(*lits(600, 4500))) is None


SYLLABLES = "ha·blás a·que·lla i·gle·sia po·e·ta o·í·do lin·güís·ti·ca ver·güen·za ciu·dad pa·ís muy".split()


@pytest.mark.parametrize("word", SYLLABLES)
def test_syllables(word):
    assert S.syllables(word.replace("·", "")) == word.split("·")


STRESS = {"hablás": 1, "hablas": 0, "teléfono": 1, "ciudad": 1, "hola": 0, "café": 1, "árbol": 0, "sol": 0, "rápido": 0, "canción": 1, "examen": 1, "reloj": 1, "día": 0, "país": 1, "mujer": 1}


def test_stress(spark):
    df = spark.createDataFrame([(w,) for w in STRESS], "word string").select("word", S.expected_stress(S.syllabify("word")).alias("s"))
    assert {r.word: r.s for r in df.collect()} == STRESS
    assert {w: S.stressed(S.syllables(w)) for w in STRESS} == STRESS


def test_vos(spark):
    yes, no = ["hablás", "tenés", "vivís", "sos", "decís", "querés"], ["más", "habla", "es", "sabes", ""]
    df = spark.createDataFrame([(w,) for w in yes + no], "w string").where(S.vos_form(F.col("w")))
    assert {r.w for r in df.collect()} == set(yes)


def test_cooldown(spark):
    rows = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate([0, 3, 10, 12, 19, 20, 40])], "session_id bigint, seq bigint, t double")
    kept = folds.cooled_down(rows, ["session_id"], 10.0, "session_id bigint, seq bigint, t double").collect()
    assert [r.t for r in kept] == [0, 10, 20, 40]


def test_slip_is_strict(spark):
    rows = [(1, 0, 0.0, 200.0, 3500.0, -20.0), (1, 1, 1.0, 300.0, 3300.0, -20.0), (2, 0, 0.0, 200.0, 3500.0, -20.0), (2, 1, 1.0, 300.1, 3299.9, -20.0), (3, 0, 0.0, 200.0, 3500.0, -80.0), (3, 1, 1.0, 320.0, 3250.0, -20.0)]
    df = spark.createDataFrame(rows, "session_id bigint, seq bigint, t double, f0 double, f4 double, rms double")
    assert [r.session_id for r in O.slips(df).collect()] == [2]

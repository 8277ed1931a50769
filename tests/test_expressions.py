"""Scalar expressions against plain Python."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from orrery.functions import exprs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_separation_is_exact_near_poles_and_the_wrap(spark):
    sep = lambda *p: one(spark, exprs.angular_separation(*p))
    assert sep(359.9999, 0.0, 0.0001, 0.0) == pytest.approx(0.72, abs=1e-6)
    assert sep(0.0, 89.9999, 180.0, 89.9999) == pytest.approx(0.72, abs=1e-6)
    assert sep(10.0, 20.0, 10.0, 20.0) == 0


def test_match_score(spark):
    score = lambda s, e: one(spark, exprs.match_score(F.lit(s), F.lit(e).cast("double")))
    assert score(0.0, 0.01) == 1.0 and score(-1.0, 1.0) == 0.0
    assert score(1.0, 1.0) == round(math.exp(-0.5), 6)
    assert score(6.0, None) == 0.8 and score(6.0, float("nan")) == 0.8


def test_positions(spark):
    valid = lambda r, d, e=None: one(spark, exprs.valid_position(F.lit(r).cast("double"), F.lit(d).cast("double"), None if e is None else F.lit(e)))
    assert valid(400.0, 90.0) and not valid(1.0, 90.1) and not valid(float("nan"), 0.0) and not valid(None, 0.0)
    assert valid(1.0, 1.0, 2000.0) and not valid(1.0, 1.0, 1700.0)
    assert one(spark, exprs.normalized_ra(F.lit(-10.0))) == 350.0


def test_proper_motion_moves_a_star(spark):
    ra, dec = exprs.propagated(F.lit(10.0), F.lit(60.0), F.lit(1000.0), F.lit(-2000.0), F.lit(2000.0), F.lit(2016.0))
    assert one(spark, ra) == pytest.approx(10 + 16 / 3600 / math.cos(math.radians(60)), abs=5e-6)
    assert one(spark, dec) == pytest.approx(60 - 32 / 3600, abs=1e-6)
    ra, _ = exprs.propagated(F.lit(10.0), F.lit(60.0), F.lit(1000.0), F.lit(1.0), F.lit(None).cast("double"), F.lit(2016.0))
    assert one(spark, ra) == 10.0


def test_polygons_across_the_wrap_and_with_level_edges(spark):
    square = [(359.0, -1.0), (1.0, -1.0), (1.0, 1.0), (359.0, 1.0)]
    inside = lambda r, d: one(spark, exprs.inside_polygon(F.lit(r), F.lit(d), square))
    assert inside(0.0, 0.0) and inside(359.5, 0.9) and not inside(358.5, 0.0) and not inside(0.0, 1.5)


def test_texts(spark):
    year = lambda x: one(spark, exprs.year_of(F.lit(x)))
    assert year("2020.5") == 2020.5 and year("2020-06-01") == 2020.0 and year("soon") is None
    assert one(spark, exprs.canonical_type(F.lit(" QSO "))) == "quasar" and one(spark, exprs.canonical_type(F.lit("Cl*"))) == "star_cluster"
    assert one(spark, exprs.tic_number(F.lit("tic 42"))) == "42" and one(spark, exprs.tic_number(F.lit("HD 42"))) is None
    assert one(spark, exprs.safe_filename(F.lit("mast:/a b/c d.fits"))) == "c_d.fits"
    assert one(spark, exprs.entity_id("host", F.lit(" HD 1 "))) == "host:HD%201"
    assert one(spark, exprs.provider_of(F.lit("https://gea.esac.esa.int/tap"))) == "gaia"
    assert one(spark, exprs.object_id(F.lit("c"), F.lit("1"))) == hashlib.sha256(b'["c", "1"]').hexdigest()[:32]


def test_cosine_distance(spark):
    d = lambda a, b: one(spark, exprs.cosine_distance(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert d([1.0, 0.0], [0.0, 2.0]) == 1.0 and d([1.0], [-3.0]) == 2.0 and d([0.0], [1.0]) is None


@pytest.mark.parametrize(
    ("supported", "candidates", "comparable", "nearest", "good", "status"),
    [(1, 1, 1, 0.1, 1.0, "matched"), (2, 2, 2, 0.1, 1.0, "ambiguous"), (0, 1, 0, None, 1.0, "position_only_review"), (0, 0, 0, None, 1.0, "insufficient_reference_coverage"), (0, 0, 3, 0.6, 0.9, "novelty_review_candidate"), (0, 0, 3, 0.6, 0.5, "unmatched"), (0, 0, 3, 0.3, 0.9, "unmatched")],
)
def test_triage(spark, supported, candidates, comparable, nearest, good, status):
    assert one(spark, exprs.triage_status(*(F.lit(x) for x in (supported, candidates, comparable)), F.lit(nearest).cast("double"), F.lit(good))) == status

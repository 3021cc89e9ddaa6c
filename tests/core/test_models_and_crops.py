"""Stored classifiers, crops of small and large photos, limits of uploads, changed tables."""

import json
import math

import pytest

from packlens.operators import classify, reread, validation
from packlens.sources import changes

MODEL = {"format": 1, "classes": ["mrp", "net_qty"], "vocab": ["mrp", "rs.", " ne"], "idf": [1.5, 1.2, 2.0], "coef": [[[0, 2.0], [1, 0.5]], [[2, 1.5]]], "intercept": [0.1, 0.0]}


def test_a_stored_model_scores_lines(spark, tmp_path):
    (tmp_path / "model.json").write_text(json.dumps(MODEL, indent=1))
    idf, weights, bias = classify.loaded(spark, str(tmp_path / "model.json"))
    lines = spark.createDataFrame([(1, "MRP"), (2, "NET"), (3, "zzz"), (4, "mrp mrp rs."), (5, None)], "id long, text string")
    got = {r.id: (r.vote_class, r.vote_prob) for r in classify.scored(lines, idf, weights, bias, "id").collect()}
    soft = lambda a, b: math.exp(a) / (math.exp(a) + math.exp(b))
    both = (3.0 * 2.0 + 1.2 * 0.5) / math.hypot(3.0, 1.2) + 0.1
    want = {1: ("mrp", soft(2.1, 0)), 2: ("net_qty", soft(1.5, 0.1)), 3: ("mrp", soft(0.1, 0)), 4: ("mrp", soft(both, 0)), 5: ("mrp", soft(0.1, 0))}
    assert {i: (c, pytest.approx(p, abs=1e-9)) for i, (c, p) in want.items()} == got


@pytest.mark.parametrize("change", [{"format": 2}, {"format": None}, {"classes": ["mrp"]}, {"idf": [1.0]}, {"vocab": ["mrp", "mrp", " ne"]}, {"intercept": None}])
def test_other_models_are_refused(spark, tmp_path, change):
    (tmp_path / "model.json").write_text(json.dumps(MODEL | change))
    with pytest.raises(ValueError):
        classify.loaded(spark, str(tmp_path / "model.json"))


def test_crops_shrink_their_scale(spark):
    box = "scan_id long, rx1 double, ry1 double, rx2 double, ry2 double, img_w long, img_h long"
    rows = [(1, 0.1, 0.1, 0.3, 0.2, 1000, 1000), (2, 0.0, 0.5, 1.0, 1.0, 4000, 3000), (3, 0.1, 0.1, 0.3, 0.2, 30, 1000), (4, 0.0, 0.0, 0.4, 0.4, 1000, 1000), (5, None, 0.0, 1.0, 1.0, 100, 100)]
    got = {(r.scan_id, r.variant): r for r in reread.crops(spark.createDataFrame(rows, box)).collect()}
    assert {i for i, _ in got} == {1, 2, 4}
    first = got[1, 2]
    assert (first.left, first.top, first.width, first.height, first.scale, first.prepared) == (100, 100, 200, 100, 4, "highContrast")
    assert [(got[2, v].scale, got[2, v].prepared) for v in range(3)] == [(1, "plain"), (1, "contrast"), (1, "plain")]
    assert [(got[4, v].scale, got[4, v].prepared) for v in range(3)] == [(3, "plain"), (3, "contrast"), (3, "highContrast")]


def test_uploads_keep_to_limits(spark):
    most = 12 * 1024 * 1024
    rows = [(1, "image/png", most)] * 8 + [(2, "image/png", 1)] * 9 + [(3, "image/png", most + 1)] + [(4, None, 1)] + [(5, "image/jpeg", None)]
    files = spark.createDataFrame(rows, "scan_id long, mime string, bytes long")
    assert {r.scan_id: r.reason for r in validation.uploads(files).collect()} == {1: None, 2: "too_many", 3: "too_large", 4: "not_image", 5: None}
    assert validation.uploads(files.limit(0)).count() == 0


def test_tables_change(spark):
    table = spark.createDataFrame([(1, "a", True), (2, "b", False), (None, "c", None)], "id long, name string, synced boolean")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    new = spark.createDataFrame([(2, None), (9, "z")], "id long, name string")
    assert rows(changes.updated(table, new, "id")) == [(1, "a", True), (2, None, False), (None, "c", None)]
    assert rows(changes.removed(table, new, "id")) == [(1, "a", True), (None, "c", None)]
    assert rows(changes.upserted(table, new, "id")) == [(1, "a", True), (2, None, None), (9, "z", None), (None, "c", None)]
    assert rows(changes.upserted(table, new.limit(0), "id")) == rows(table) and changes.removed(table.limit(0), new, "id").count() == 0

"""Photo files of several formats, a recogniser run over them, crops read again, and what fails on the way."""

import struct
import time

import pytest
from pyspark.sql import functions as F

from packlens.operators import layout, merge, recognise, reread
from packlens.operators import extract as E
from packlens.sources import photos
from tests.core.test_panels import CHIPS


def jpeg(w, h, *before, frame=0xC0):
    return b"\xff\xd8" + b"".join(before) + b"\xff" + bytes([frame]) + struct.pack(">HBHHB", 17, 8, h, w, 3) + b"\x01\x22\x00" * 3 + b"\xff\xda" + b"\0" * 50


def segment(marker, data):
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(data) + 2) + data


def exif(orientation, order="<", at=8, entries=2):
    mark = b"II" if order == "<" else b"MM"
    table = struct.pack(order + "H", entries) + b"".join(struct.pack(order + "HHI", 0x0100 + i, 3, 1) + struct.pack(order + "HH", 9, 0) for i in range(entries - 1)) + struct.pack(order + "HHI", 0x0112, 3, 1) + struct.pack(order + "HH", orientation, 0)
    return segment(0xE1, b"Exif\0\0" + mark + struct.pack(order + "HI", 42, at) + b"\0" * (at - 8) + table + b"\0" * 4)


PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIB", 13, b"IHDR", 640, 480, 8)
CASES = {
    "a.png": (PNG, "png", 640, 480, 1),
    "b.jpg": (jpeg(1200, 800, segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")), "jpeg", 1200, 800, 1),
    "c.jpg": (jpeg(70, 65000, exif(6), frame=0xC2), "jpeg", 70, 65000, 6),
    "d.jpg": (jpeg(7, 9, exif(3, ">", 20, 5), segment(0xE1, b"other")), "jpeg", 7, 9, 3),
    "e.jpg": (jpeg(5, 6, *[segment(0xFE, b"x" * i) for i in range(60)]), "jpeg", 5, 6, 1),
    "f.jpg": (jpeg(5, 6, b"\xff\xff", b"\xff\xd0\xff\x01", segment(0xC4, b"table")), "jpeg", 5, 6, 1),
    "g.jpg": (jpeg(5, 6)[:10], "jpeg", 0, 0, 1),
    "h.jpg": (b"\xff\xd8\xff\xda\0\0", "jpeg", 0, 0, 1),
    "i.jpg": (jpeg(50, 60, exif(42)), "jpeg", 50, 60, 1),
    "j.gif": (b"GIF89a" + struct.pack("<HH", 300, 2), "gif", 300, 2, 1),
    "k.bmp": (b"BM" + b"\0" * 16 + struct.pack("<ii", 11, -22), "bmp", 11, 22, 1),
    "l.webp": (b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 33, 44), "webp", 33, 44, 1),
    "m.webp": (b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + struct.pack("<I", 998 | 16383 << 14), "webp", 999, 16384, 1),
    "n.webp": (b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + struct.pack("<I", 70000)[:3] + struct.pack("<I", 2)[:3], "webp", 70001, 3, 1),
    "o.txt": (b"not an image", None, 0, 0, 1),
    "p.txt": (b"", None, 0, 0, 1),
    "q.png": (b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 1 << 31, 5), "png", 0, 0, 1),
    "r.jpg": (b"\xff\xd8" + segment(0xE1, b"Exif\0\0II*\0\xff\xff\xff\xff") + jpeg(8, 9)[2:], "jpeg", 8, 9, 1),
}


def test_bounds_of_files(spark, tmp_path):
    for name, (data, *_) in CASES.items():
        (tmp_path / name).write_bytes(data)
    found = photos.with_bounds(photos.photo_files(spark, str(tmp_path)))
    got = {r.path.rpartition("/")[2]: (r.format, r.width, r.height, r.orientation) for r in found.collect()}
    assert got == {n: tuple(x[1:]) for n, x in CASES.items() if x[0]}  # Spark lists no empty files
    assert photos.photo_files(spark, str(tmp_path), glob="*.gif").count() == 1


def test_null_content_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, PNG, "y")], "id int, content binary, width string")
    got = photos.with_bounds(df).select("id", "format", "width").collect()
    assert sorted(map(tuple, got)) == [(1, None, 0), (2, "png", 640)]
    assert photos.with_bounds(df.limit(0)).collect() == []


@pytest.mark.parametrize("w,h,turn,want", [(600, 400, 1, (1200, 800)), (1500, 1000, 1, (3000, 2000)), (4000, 3000, 1, (3200, 2400)), (2400, 100, 1, (2400, 100)), (2399, 2399, 6, (3199, 3199)), (2300, 2300, 1, (3200, 3200)), (100, 50, 8, (100, 200)), (0, 0, 1, (0, 0)), (3200, 1, 1, (3200, 1)), (3201, 3, 5, (3, 3200))])
def test_prepared_sizes(spark, w, h, turn, want):
    r = photos.with_prepared_size(spark.createDataFrame([(w, h, turn)], "width int, height int, orientation int")).first()
    scale = 12e6**0.5
    if (w, h) in ((2399, 2399), (2300, 2300)):  # the side's limit, then pixels
        want = (min(3200, round(scale)),) * 2
    assert (r.prepared_width, r.prepared_height) == want


TEXTS = {b"1": CHIPS, b"2": [("MRP Rs. 42.00", 0.4, 10, 10, 100, 20)], b"4": []}


def fake(content, side):
    if content[24:25] == b"3":
        raise OSError("no engine")
    for text, conf, x, y, w, h in TEXTS.get(content[24:25], []):
        yield text, conf, [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def image(label):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 1600, 1500) + label


@pytest.fixture(scope="module")
def scans(spark):
    rows = [(1, 0, image(b"1")), (1, 1, image(b"3")), (2, 0, None), (2, 1, b"junk"), (3, 0, image(b"2")), (4, 0, image(b"4"))]
    return spark.createDataFrame(rows, "scan_id int, photo int, content binary").repartition(3)


def test_photos_to_fields(spark, scans):
    tokens, outcomes = recognise.scanned(scans, fake)
    lines = layout.blocks(layout.lines(tokens))
    best = {r.field: r.value for r in merge.merged(E.product(lines).withColumn("photo_index", F.col("photo"))).where("scan_id = 1 and status = 'found'").collect()}
    assert (best["brand"], best["productName"], best["fssai"]) == ("Lay's", "Potato Chips", "10012083000110")
    got = {r.scan_id: r for r in outcomes.collect()}
    assert (got[1].n_photos, got[1].n_readable, got[1].n_failed, got[1].region_count, got[1].error) == (2, 1, 1, 13, None)
    assert got[1].mean_confidence == pytest.approx(sum(c for _, c, *_ in CHIPS) / 13 / 2)
    assert got[2].error == "No readable photos — all 2 image(s) failed to load or decode." and (got[2].n_readable, got[2].n_failed) == (0, 1)
    assert (got[3].mean_confidence, got[3].region_count, got[3].error) == (0, 0, None)  # unsure regions are dropped
    assert (got[4].n_readable, got[4].n_failed, got[4].region_count) == (1, 0, 0)


def test_failures_are_rows(scans):
    got = {(r.scan_id, r.photo): r.error for r in recognise.recognised(scans, fake, "scan_id", "photo").where("text is null").collect()}
    assert got == {(1, 1): "OSError: no engine", (2, 0): "ValueError: unreadable", (2, 1): None, (4, 0): None}


def test_all_broken_is_an_error(spark, scans):
    sized = photos.with_prepared_size(photos.with_bounds(scans)).withColumn("there", F.col("content").isNotNull())
    read = recognise.recognised(scans, fake, *layout.KEYS)
    with pytest.raises(Exception, match="all 2 image"):
        recognise.scan_outcomes(sized.where("scan_id = 2"), read, strict=True).collect()
    assert recognise.scan_outcomes(sized.where("scan_id = 1"), read, strict=True).count() == 1


def slow(content, side):
    if content == b"slow":
        time.sleep(3)
    return [("ok", 0.9, [(0, 0), (30, 0), (30, 20), (0, 20)])]


def test_late_answers(spark):
    df = spark.createDataFrame([(1, b"slow"), (2, b"x")], "id int, content binary").coalesce(1)
    got = {r.id: (r.text, r.error) for r in recognise.recognised(df, slow, "id", seconds=0.3).collect()}
    assert got == {1: (None, "TimeoutError: no answer after 0.3 s"), 2: ("ok", None)}


def cut(content, crop):
    if crop["prepared"] == "contrast":
        raise ValueError("cannot cut")
    return b"" if crop["field"] == "batch" else f"{crop['field']} {crop['prepared']} {crop['scale']}".encode()


def read_crop(content, side):
    assert side == recognise.CROP_SIDE
    field, prepared, scale = content.decode().split()
    text = {"mrp": "Rs. 1,250.50", "exp": "12/05/2027"}[field]
    return [(text, 0.6 if prepared == "plain" else 0.9, [(0, 0), (9, 9)]), (" ", 0.1, [(0, 0), (9, 9)])]


def test_crops_are_read_again(spark):
    box = (0.1, 0.2, 0.3, 0.25)
    columns = "scan_id int, photo int, field string, status string, value string, confidence double, relationship string, x1 double, y1 double, x2 double, y2 double"
    observed = spark.createDataFrame([(1, 0, f, "unverified", None, 0.4, "label_only", *box) for f in ("mrp", "exp", "batch")] + [(1, 0, "netQty", "found", "80 g", 0.9, "same_line", *box)], columns)
    one = photos.with_bounds(spark.createDataFrame([(1, 0, image(b"1"))], "scan_id int, photo int, content binary"))
    got = {r.field: (r.status, r.value, r.relationship) for r in recognise.second_reading(observed, one, cut, read_crop).collect()}
    assert got == {"mrp": ("found", "1250.50", "variable_crop"), "exp": ("found", "12/05/2027", "variable_crop"), "batch": ("unverified", None, "label_only"), "netQty": ("found", "80 g", "same_line")}
    sizes = one.select("scan_id", "photo", F.col("width").alias("img_w"), F.col("height").alias("img_h"))
    crops = reread.crops(reread.job_plan(reread.search_rect(reread.targets(observed)).join(sizes, ["scan_id", "photo"])))
    read = recognise.recognised_crops(crops, one, cut, read_crop).collect()
    assert len(read) == 9 and {r.error for r in read if r.variant == 1} == {"ValueError: cannot cut"} and all(r.text is None for r in read if r.field == "batch")

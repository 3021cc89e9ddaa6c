"""Text of recognised regions, sheets as files, word pieces and small aggregates."""

from pyspark.sql import functions as F

from packlens.functions import wordpiece
from packlens.operators import cleantext, quality, reporting

REGION = "scan_id long, photo int, token_id int, text string, conf double, x1 double, y1 double, x2 double, y2 double"


def regions(spark, *boxes):
    return spark.createDataFrame([(1, 0, i, t, c, float(x), float(y), float(x + w), float(y + h)) for i, (t, c, x, y, w, h) in enumerate(boxes)], REGION)


def text(spark, *boxes, lexicon=True):
    row = cleantext.clean_text(regions(spark, *boxes), lexicon).first()
    return row and row.text


def test_lines_of_regions(spark):
    table = [("SERVE SIZE 20g", 0.9, 0, 100, 150, 20), ("NUTRITIONAL INFORMATION", 0.9, 0, 50, 200, 20), ("537 kcal", 0.9, 100, 150, 80, 20), ("Energy", 0.9, 0, 150, 80, 20), ("'", 0.9, 300, 150, 10, 14)]
    assert text(spark, *table) == "NUTRITIONAL INFORMATION\nSERVE SIZE 20 g\nEnergy 537 kcal"
    assert [r.text for r in cleantext.reading_order(regions(spark, *table)).orderBy("pos").collect()] == ["NUTRITIONAL INFORMATION", "SERVE SIZE 20g", "Energy", "537 kcal"]
    assert text(spark, ("Energy", 0.9, 0, 0, 80, 20), ("5", 0.8, 100, 0, 12, 20), ("3", 0.8, 113, 0, 12, 20), ("7", 0.8, 126, 0, 12, 20)) == "Energy 537"
    assert text(spark, ("Energy", 0.6, 4, 1, 80, 20), ("Energy", 0.9, 0, 0, 80, 20), ("537 kcal", 0.9, 100, 0, 80, 20)) == "Energy 537 kcal"
    assert text(spark, ("Energy", 0.49, 0, 0, 80, 20), ("Protein", 0.5, 0, 30, 80, 20)) == "Protein"


def test_words_and_wraps(spark):
    assert text(spark, ("Maltodex-", 0.9, 0, 0, 100, 20), ("trin", 0.85, 0, 30, 50, 20), ("Energy", 0.9, 0, 60, 80, 20)) == "Maltodextrin\nEnergy"
    assert len(text(spark, ("TOTAL-", 0.9, 0, 0, 80, 20), ("Energy", 0.9, 0, 30, 80, 20)).split("\n")) == 2
    assert text(spark, ("Sodum", 0.7, 0, 0, 80, 20), ("643 mg", 0.9, 100, 0, 60, 20), ("Protoin", 0.7, 0, 30, 80, 20), ("Enengy", 0.7, 0, 60, 80, 20)) == "Sodium 643 mg\nProtein\nEnergy"
    assert text(spark, ("Sodum", 0.9, 0, 0, 80, 20), lexicon=False) == "Sodum"
    assert text(spark, ("ALLERGENADVICE:ContainsSoy Mak", 0.9, 0, 0, 250, 20), ("Oil(Palm)", 0.9, 0, 30, 100, 20)) == "ALLERGEN ADVICE: Contains Soy Milk\nOil (Palm)"


def test_no_regions(spark):
    none = regions(spark, ("'", 0.9, 0, 0, 20, 20), (None, 0.9, 0, 40, 20, 20))
    assert cleantext.clean_text(none).count() == 0 and cleantext.clean_text(none.limit(0)).count() == 0
    assert cleantext.mean_confidence(none, cleantext.reading_order(none)).first().mean_confidence == 0


def test_sheet_file(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'a "b", c'), ("2", "two\nlines"), ("3", None), ("4", " # ")], "id string, name string")
    reporting.write_csv(rows.coalesce(1), f"{tmp_path}/out")
    files = list((tmp_path / "out").glob("part-*"))
    assert len(files) == 1 and files[0].read_text() == 'id,name\n1,"a ""b"", c"\n2,"two\nlines"\n3,\n4, # \n'
    name = lambda s, i: spark.range(1).select(reporting.export_name(F.lit(s).cast("string"), F.lit(i).cast("long"))).first()[0]
    assert [name("Tomato Ketchup (1 kg)!", 7), name("***", 8), name(None, None)] == ["tomato_ketchup_1_kg_7.csv", "product_8.csv", "product_scan.csv"]


def test_word_pieces(spark):
    vocabulary = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "net", "##to", "qty", ":", "cafe", "##s", "500", "g", "strasse"]
    encode = wordpiece.encoder(vocabulary, 6)
    df = spark.createDataFrame([(1, "NETTO Qty:"), (2, "Cafés \x07Straße"), (3, "zzz " + "g" * 101), (4, None), (5, "g g g g g g g")], "id int, text string")
    rows = df.withColumn("ids", encode(F.col("text"))).withColumn("words", wordpiece.words(F.col("text")))
    got = {r.id: r.ids for r in rows.collect()}
    assert got == {1: [2, 4, 5, 6, 7, 3], 2: [2, 8, 9, 12, 3], 3: [2, 1, 1, 3], 4: [2, 3], 5: [2, 11, 11, 11, 11, 3]}
    row = rows.where("id = 4").select(*[c.alias(n) for c, n in zip(wordpiece.padded(F.col("ids"), F.lit(4)), ("ids", "mask"), strict=True)]).first()
    assert (row.ids, row.mask) == ([2, 3, 0, 0], [1, 1, 0, 0])


def test_small_aggregates(spark):
    photos = spark.createDataFrame([(1, 0, 0.8, 100, 5), (1, 1, None, None, None)], "scan_id long, photo int, mean_conf double, chars long, regions long")
    assert tuple(quality.capture_quality(photos).first()) == (1, 0.4, 100, 5, 2)
    lines = spark.createDataFrame([(1, 0, 0), (1, 0, 1)], "scan_id long, photo int, line_no int")
    assert {(r.vote_class, r.vote_prob) for r in quality.votes_or_none(lines, None, []).collect()} == {("other", 0.0)}

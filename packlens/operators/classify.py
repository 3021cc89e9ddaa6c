"""Line classification by character n-grams: features, scores, votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packlens.functions import garble, grams


def ngrams(text: Column, least: int = 3, most: int = 5) -> Column:
    """Substrings of each lower-case word with a space on both sides, of least to most characters."""
    words = F.array_remove(F.split(F.lower(text), r"\s+"), "")

    def of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))

        def sized(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1)))
            return F.when(F.length(padded) >= n, F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

        return F.concat(*map(sized, range(least, most + 1)))

    return F.flatten(F.transform(words, of))


def counted(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, gram, n): how often each n-gram of ngrams() comes in a line.

    A line's n-grams are counted where the line is, many lines at once, before they become rows; a line (the rows of its
    keys) bounds them.
    """
    text = F.regexp_replace(F.concat(F.lit(" "), F.lower(F.array_join(F.collect_list("text"), " ")), F.lit(" ")), r"\s+", " ")
    own = lines.groupBy(*keys).agg(text.alias("text"))
    schema = T.StructType([*own.drop("text").schema, T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])
    return own.mapInArrow(grams.counter(list(keys), 3, 5), schema)


def vectors(lines: DataFrame, idf: DataFrame, *keys: str) -> DataFrame:
    """(keys, gram, v): tf-idf vectors of length one, over the known n-grams."""
    # a model is small, its driver held it
    v = counted(lines, *keys).join(F.broadcast(idf), "gram").withColumn("v", F.col("n") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(*keys)))
    return v.select(*keys, "gram", (F.col("v") / F.when(norm > 0, norm).otherwise(1.0)).alias("v"))


def with_classes(lines: DataFrame, bias: DataFrame) -> DataFrame:
    """lines with a row for every class: class_no, class, bias. The classes are a scalar subquery, one small array when the query runs."""
    classes = bias.agg(F.sort_array(F.collect_list(F.struct("class_no", "class", F.col("bias").cast("double").alias("bias")))).alias("cs"))
    return lines.withColumn("__c", F.explode(classes.scalar())).select(*lines.columns, "__c.*")


def scored(lines: DataFrame, idf: DataFrame, weights: DataFrame, bias: DataFrame, *keys: str) -> DataFrame:
    """(keys, vote_class, vote_prob): softmax over linear scores of tf-idf vectors of length one.

    idf: gram, idf; weights: class_no, gram, weight; bias: class_no, class, bias. The first class wins ties;
    a line without known n-grams is scored by the biases.
    """
    sums = vectors(lines, idf, *keys).join(F.broadcast(weights), "gram").groupBy(*keys, "class_no").agg(F.sum(F.col("v") * F.col("weight")).alias("s"))
    # sums grow with the lines, which Spark's estimate takes for few where they are exploded
    z = with_classes(lines.select(*keys), bias).join(sums.hint("merge"), [*keys, "class_no"], "left").withColumn("z", F.col("bias") + F.coalesce("s", F.lit(0.0)))
    w = Window.partitionBy(*keys)
    z = z.withColumn("e", F.exp(F.col("z") - F.max("z").over(w))).withColumn("p", F.col("e") / F.sum("e").over(w))
    z = z.withColumn("rn", F.row_number().over(w.orderBy(F.desc("p"), "class_no"))).where("rn = 1")
    return z.select(*keys, F.col("class").alias("vote_class"), F.col("p").alias("vote_prob"))


def loaded(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(idf, weights, bias) of a stored model: a JSON file with format 1, classes, vocab, idf, coef (pairs of index and weight a class), intercept.

    ValueError for another format or for parts whose sizes don't fit.
    """
    schema = "format int, classes array<string>, vocab array<string>, idf array<double>, coef array<array<array<double>>>, intercept array<double>"
    model = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("m")).select("m.*")
    size = lambda c: F.coalesce(F.size(c), F.lit(-1))
    n = model.select("format", size("classes").alias("classes"), size("coef").alias("coef"), size("intercept").alias("intercept"), size("idf").alias("idf"), size(F.array_distinct("vocab")).alias("vocab")).first()
    if n is None or n.format != 1:
        raise ValueError(f"a model of unknown format: {n and n.format}")
    if n.classes < 0 or n.vocab < 0 or not n.classes == n.coef == n.intercept or n.idf != n.vocab:
        raise ValueError("a model whose parts don't fit")
    grams = model.select(F.posexplode(F.arrays_zip("vocab", "idf")).alias("j", "g")).select("j", F.col("g.vocab").alias("gram"), "g.idf")
    weights = model.select(F.posexplode("coef").alias("class_no", "row")).select("class_no", F.explode("row").alias("p")).select("class_no", F.col("p")[0].cast("int").alias("j"), F.col("p")[1].alias("weight"))
    bias = model.select(F.posexplode(F.arrays_zip("classes", "intercept")).alias("class_no", "c")).select("class_no", F.col("c.classes").alias("class"), F.col("c.intercept").alias("bias"))
    return grams.select("gram", "idf"), weights.join(grams, "j").select("class_no", "gram", "weight"), bias


def trained(lines: DataFrame, classes: Sequence[str], c: float = 4.0, bank: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(idf, weights, bias) of a multinomial logistic regression on labelled lines (id, text, label).

    The n-grams, and how common they are, are those of the bank (id, text), the lines themselves if none is given.
    A model has a weight for each of its n-grams and classes, which the driver holds; a bank is small, as
    people write it, however many copies are learnt from.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    spark = lines.sparkSession
    with_grams = lambda df: df.withColumn("grams", ngrams(F.col("text")))
    rows = with_grams(lines).select("id", "grams", (F.array_position(F.array(*map(F.lit, classes)), F.col("label")) - 1).cast("double").alias("label"))
    own = with_grams(lines if bank is None else bank).select("grams")
    known = own.select(F.explode("grams").alias("gram")).agg(F.count_distinct("gram")).first()[0]
    counts = CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=max(1, known)).fit(own)
    common = IDF(inputCol="tf", outputCol="x").fit(counts.transform(own)).idf.toArray() + 1
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(common), inputCol="tf", outputCol="tfidf").transform(counts.transform(rows))
    unit = Normalizer(inputCol="tfidf", outputCol="features").transform(scaled)
    model = LogisticRegression(family="multinomial", regParam=1 / (c * rows.count()), elasticNetParam=0, standardization=False, maxIter=200).fit(unit)
    matrix = model.coefficientMatrix.toArray()
    weights = [(k, g, float(w)) for k, row in enumerate(matrix) for g, w in zip(counts.vocabulary, row, strict=True) if w]
    bias = [(k, classes[k], float(x)) for k, x in enumerate(model.interceptVector)]
    idf = spark.createDataFrame([(g, float(x)) for g, x in zip(counts.vocabulary, common, strict=True)], "gram string, idf double")
    return idf, spark.createDataFrame(weights, "class_no int, gram string, weight double"), spark.createDataFrame(bias, "class_no int, class string, bias double")


#: Thresholds below which a weight may go, the strongest first (fixed values).
THRESHOLDS = (0.10, 0.05, 0.03, 0.02, 0.01, 0.005, 0.0)


def ladder(lines: DataFrame, idf: DataFrame, weights: DataFrame, bias: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """(set, threshold, n, accuracy): how many of each set's lines keep their class with weights under the threshold gone.

    lines: id (unique), set, text, gold. All thresholds are measured in one pass over the lines; 0 is the whole model.
    """
    sums = [F.sum(F.when(F.abs("weight") >= t, F.col("v") * F.col("weight")).otherwise(0.0)).alias(f"s{i}") for i, t in enumerate(thresholds)]
    s = vectors(lines, idf, "id").join(F.broadcast(weights), "gram").groupBy("id", "class_no").agg(*sums)
    z = with_classes(lines.select("id", "set", "gold"), bias).join(s.hint("merge"), ["id", "class_no"], "left")
    best = [F.max(F.struct((F.col("bias") + F.coalesce(f"s{i}", F.lit(0.0))).alias("z"), (-F.col("class_no")).alias("first"), "class"))["class"].eqNullSafe(F.first("gold")).cast("int").alias(f"r{i}") for i in range(len(thresholds))]
    right = z.groupBy("id", "set").agg(*best)
    found = right.groupBy("set").agg(F.count("*").alias("n"), *[F.avg(f"r{i}").alias(f"a{i}") for i in range(len(thresholds))])
    steps = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"a{i}").alias("accuracy")) for i, t in enumerate(thresholds)]))
    return found.select("set", "n", steps.alias("x")).select("set", "x.threshold", "n", "x.accuracy")


def kept_threshold(measured: DataFrame) -> float:
    """The strongest threshold at which no set's accuracy differs from the whole model's."""
    whole = Window.partitionBy("set").orderBy("threshold").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = measured.withColumn("same", F.abs(F.col("accuracy") - F.first("accuracy").over(whole)) < 1e-12)
    found = same.groupBy("threshold").agg(F.min(F.col("same").cast("int")).alias("same")).where("same = 1").agg(F.max("threshold")).first()[0]
    return found or 0.0


def retrained(bank: DataFrame, classes: Sequence[str], held_out: DataFrame, copies: int = garble.COPIES, seed: int = garble.SEED) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """(idf, weights, bias, threshold): a model of the bank (id, text, label) and garbled copies, its weights pruned as far as the held-out sets allow.

    held_out: set, text, gold. A set `synth` of other copies of the bank is held out beside them.
    """
    idf, weights, bias = trained(garble.copies(bank, n=copies, seed=seed), classes, bank=bank)
    synth = garble.copies(bank, n=3, seed=seed + 1, level=1.0).where("copy > 0").select(F.lit("synth").alias("set"), "text", F.col("label").alias("gold"))
    lines = held_out.select("set", "text", "gold").unionByName(synth)
    lines = lines.withColumn("id", F.monotonically_increasing_id())
    threshold = kept_threshold(ladder(lines, idf, weights, bias))
    return idf, weights.where(F.abs("weight") >= threshold), bias, threshold

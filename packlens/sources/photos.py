"""Photo files as rows, and what their headers say, by expressions over their bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides and pixels that preparing a photo aims at, the most it is enlarged by, and the least worth enlarging (fixed values).
LONGEST, SHORT_OF, MOST_PIXELS, GROWTH, WORTH = 3200, 2400, 12_000_000, 2.0, 1.05
#: Segments before a JPEG's frame that are read at first; photos with more are read to their end.
SEGMENTS = 24


def photo_files(spark: SparkSession, *paths: str, glob: str = "*") -> DataFrame:
    """path, length and content of the files below the paths, in any store that Spark reads.

    Files that vanish or can't be read while the scan runs are skipped, as are empty ones. Content is read only where a
    query uses it.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(list(paths)).select("path", "length", "content")


def _hex(content: Column, at: Column | int, n: int) -> Column:
    if isinstance(at, int):
        return F.hex(F.substring(content, at + 1, n))
    return F.when(at < (1 << 31) - 1, F.hex(F.substring(content, (at + 1).try_cast("int"), F.lit(n))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _number(x: Column) -> Column:
    """What hex digits say; null for none."""
    return F.when(x != "", F.conv(x, 16, 10).cast("long"))


def _turned(x: Column) -> Column:
    """Hex digits with their bytes in reverse order."""
    return F.array_join(F.reverse(F.regexp_extract_all(x, F.lit("(..)"))), "")


def _big(content: Column, at: int, n: int) -> Column:
    """A big-endian number of n bytes at a place (from 0); null past the end."""
    return _let(_hex(content, at, n), lambda x: F.when(F.length(x) == 2 * n, _number(x)))


def _little(content: Column, at: int, n: int) -> Column:
    return _let(_hex(content, at, n), lambda x: F.when(F.length(x) == 2 * n, _number(_turned(x))))


def _jpeg(content: Column, steps: Column) -> Column:
    """Walks a JPEG's segments: struct of the place, whether it has ended, width, height, and where the EXIF block begins (0: none)."""
    none = F.lit(0).cast("long")
    state = lambda at, over, w, h, exif: F.struct(at.alias("at"), over.alias("over"), w.alias("w"), h.alias("h"), exif.alias("exif"))

    def step(s: Column, _: Column) -> Column:
        at = s["at"]

        def read(x: Column) -> Column:  # marker, kind and length as hex
            kind, size = F.substring(x, 3, 2), _number(F.substring(x, 5, 4))
            frame = kind.rlike("^C[0-35-79-BD-F]$")
            size_of = lambda y: state(at, F.lit(True), F.coalesce(_number(F.substring(y, 5, 4)), none), F.coalesce(_number(F.substring(y, 1, 4)), none), s["exif"])
            is_exif = (kind == "E1") & (s["exif"] == 0) & (_hex(content, at + 4, 6) == "457869660000")
            return (
                F.when(x.rlike("^FFFF"), state(at + 1, F.lit(False), none, none, s["exif"])).when(x.rlike("^FF(01|D[0-7])"), state(at + 2, F.lit(False), none, none, s["exif"]))
                .when(x.rlike("^FF(?!D[A9])......"), F.when(frame, _let(_hex(content, at + 5, 4), size_of)).when(size >= 2, state(at + 2 + size, F.lit(False), none, none, F.when(is_exif, at + 10).otherwise(s["exif"]))).otherwise(state(at, F.lit(True), none, none, s["exif"])))
                .otherwise(state(at, F.lit(True), none, none, s["exif"]))
            )

        return F.when(s["over"], s).otherwise(_let(F.coalesce(_hex(content, at, 4), F.lit("")), read))

    return F.aggregate(F.sequence(F.lit(1).cast("long"), steps), state(F.lit(2).cast("long"), F.lit(False), none, none, none), step)


def _orientation(content: Column, tiff: Column) -> Column:
    """The EXIF orientation (1 to 8) of a TIFF block; 1 where there is none."""

    def read(x: Column) -> Column:  # byte order, mark and the table's place as hex
        little = x.startswith("4949")
        number = lambda y: _number(F.when(little, _turned(y)).otherwise(y))
        entry = lambda y: F.when(number(F.substring(y, 1, 4)) == 0x0112, number(F.substring(y, 17, 4)))

        def values(table: Column) -> Column:
            count = F.coalesce(number(_hex(content, table, 2)), F.lit(0).cast("long"))
            places = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1))
            return F.get(F.filter(F.transform(places, lambda i: _let(_hex(content, table + 2 + 12 * i, 12), entry)), lambda v: v.isNotNull()), 0)

        return _let(tiff + number(F.substring(x, 9, 8)), values)

    return _let(_let(_hex(content, tiff, 8), read), lambda v: F.when(v.between(1, 8), v).otherwise(1).cast("int"))


def bounds_of(c: Column) -> Column:
    """Struct of format, width, height and orientation of an image's bytes; see with_bounds."""
    none = F.lit(0).cast("long")
    head = F.hex(F.substring(c, F.lit(1), F.lit(16)))
    kind = _let(head, lambda x: (
        F.when(x.startswith("FFD8FF"), "jpeg").when(x.startswith("89504E470D0A1A0A") & x.endswith("49484452"), "png").when(x.rlike("^474946383[79]61"), "gif").when(x.startswith("424D"), "bmp")
        .when(x.rlike("^52494646.{8}57454250565038(20|4C|58)$"), F.concat(F.lit("webp"), F.substring(x, 31, 2)))
    ))
    every = F.greatest(F.lit(1).cast("long"), F.floor(F.length(c) / 2))
    walked = _let(_jpeg(c, F.lit(SEGMENTS).cast("long")), lambda s: F.when(s["over"], s).otherwise(_jpeg(c, every)))
    side = lambda x: F.when(x < 1 << 31, x).otherwise(none).cast("int")
    size = lambda w, h, tiff=none: F.struct(side(w).alias("w"), side(h).alias("h"), tiff.alias("exif"))
    upright = lambda x: F.when(x < 1 << 31, x).otherwise((1 << 32) - x)  # noqa: E731  a BMP's height is negative where its rows go downwards

    def sized(k: Column) -> Column:
        return (
            F.when(k == "jpeg", _let(walked, lambda j: size(j["w"], j["h"], j["exif"]))).when(k == "png", size(_big(c, 16, 4), _big(c, 20, 4))).when(k == "gif", size(_little(c, 6, 2), _little(c, 8, 2)))
            .when(k == "bmp", size(_little(c, 18, 4), _let(_little(c, 22, 4), upright)))
            .when(k == "webp20", size(_little(c, 26, 2) % 16384, _little(c, 28, 2) % 16384)).when(k == "webp58", size(_little(c, 24, 3) + 1, _little(c, 27, 3) + 1))
            .when(k == "webp4C", _let(_little(c, 21, 4), lambda x: size(x % 16384 + 1, F.shiftright(x, 14) % 16384 + 1))).otherwise(size(none, none))
        )

    def result(k: Column, s: Column) -> Column:
        known = (s["w"] > 0) & (s["h"] > 0)
        turned = F.when(known & (s["exif"] > 0), _orientation(c, s["exif"])).otherwise(1)
        return F.struct(F.regexp_replace(k, "^(webp).*", "$1").alias("format"), F.when(known, s["w"]).otherwise(0).alias("width"), F.when(known, s["h"]).otherwise(0).alias("height"), turned.alias("orientation"))

    return _let(kind, lambda k: _let(sized(k), lambda s: result(k, s)))


def with_bounds(photos: DataFrame, content: str = "content") -> DataFrame:
    """photos with format, width, height (0, 0 where no header can be read) and orientation.

    Knows JPEG, PNG, GIF, BMP and WebP. Only headers are read: a file that breaks off later has its bounds.
    A null or empty content has no format.
    """
    names = ("format", "width", "height", "orientation")
    return photos.withColumn("__bounds", bounds_of(F.col(content))).withColumns({n: F.col(f"__bounds.{n}") for n in names}).drop("__bounds")


def with_prepared_size(bounds: DataFrame) -> DataFrame:
    """bounds (width, height, orientation) with prepared_width, prepared_height: upright, shrunk to the longest side, small ones enlarged.

    (0, 0) stays as it is.
    """
    across = F.col("orientation") >= 5
    df = bounds.withColumns({"__w": F.when(across, F.col("height")).otherwise(F.col("width")), "__h": F.when(across, F.col("width")).otherwise(F.col("height"))})
    side, area = F.greatest("__w", "__h"), F.col("__w").cast("double") * F.col("__h")
    larger = F.least(F.lit(GROWTH), LONGEST / side, F.sqrt(MOST_PIXELS / area))
    scale = F.when(side <= 0, 1.0).when(side > LONGEST, LONGEST / side).when((side < SHORT_OF) & (larger > WORTH), larger).otherwise(1.0)
    df = df.withColumn("__scale", scale)
    sized = lambda n: F.round(F.col(n) * F.col("__scale")).cast("int")
    return df.withColumns({"prepared_width": sized("__w"), "prepared_height": sized("__h")}).drop("__w", "__h", "__scale")

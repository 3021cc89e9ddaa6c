"""A recogniser given by the caller, run over photos and crops, and what its tokens say of a scan.

A recogniser is a function of an image's bytes and a longest side that returns (text, confidence, quad)
for each region, a quad being points (x, y). It runs in Python workers; what it raises becomes a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TooLate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packlens.functions import text as Text
from packlens.operators import layout, reread
from packlens.sources import photos as P
from packlens.sources import scratch

Region = tuple[str, float, list[tuple[float, float]]]
Recogniser = Callable[[bytes, int], Iterable[Region]]
#: Longest sides handed to a recogniser for photos and crops, the largest crop in bytes, and seconds for one (fixed values).
PHOTO_SIDE, CROP_SIDE, CROP_BYTES, CROP_SECONDS = 2560, 1200, 3_500_000, 15.0
#: Tokens in one batch that a worker hands back.
BATCH = 4096
TOKEN = {"token_id": "int", "text": "string", "conf": "double", "x1": "double", "y1": "double", "x2": "double", "y2": "double", "error": "string"}
READING = {"field": "string", "job_no": "int", "variant": "int", "rx1": "double", "ry1": "double", "text": "string", "conf": "double", "error": "string"}
ARROW = {"int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def with_columns(df: DataFrame, keys: Iterable[str], more: dict[str, str]) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + T.DataType.fromDDL(", ".join(f"{n} {t}" for n, t in more.items())).fields)


def batch_of(out: list[tuple], like: pa.Schema, keys: Iterable[str], more: dict[str, str]) -> pa.RecordBatch:
    """Rows of keys, typed as in like, and more columns."""
    schema = pa.schema([like.field(k) for k in keys] + [pa.field(n, ARROW[t]) for n, t in more.items()])
    return pa.record_batch([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)


class Timed:
    """Calls with a time limit; a call that is too late is left behind with its thread."""

    def __init__(self, seconds: float | None):
        self.seconds, self.pool = seconds, None

    def __call__(self, f: Callable, *args):
        if self.seconds is None:
            return f(*args)
        self.pool = self.pool or ThreadPoolExecutor(1)
        try:
            return self.pool.submit(f, *args).result(self.seconds)
        except TooLate:
            self.pool.shutdown(wait=False)
            self.pool = None
            raise TimeoutError(f"no answer after {self.seconds:g} s") from None


def tokens_of(regions: Iterable[Region]) -> list[tuple]:
    """Rows of TOKEN (without error) of the regions that have text; a quad becomes the box around it."""
    out = []
    for i, (text, conf, quad) in enumerate(regions):
        if text and text.strip():
            xs, ys = zip(*quad, strict=True)
            out.append((i, text, float(conf), float(min(xs)), float(min(ys)), float(max(xs)), float(max(ys))))
    return out


def recognised(photos: DataFrame, recognise: Recogniser, *keys: str, side: int = PHOTO_SIDE, seconds: float | None = None) -> DataFrame:
    """(keys, token_id, text, conf, x1, y1, x2, y2, error): the regions of each photo (keys, content) as they are read.

    A photo without text has a row of nulls, and so has one that fails, with the error beside it; a null
    content was not readable. Photos go through one at a time, so memory is bounded by a photo and its regions.
    """
    empty, more = (None,) * len(TOKEN), pa.schema([pa.field(n, ARROW[t]) for n, t in TOKEN.items()])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        timed = Timed(seconds)
        for batch in batches:
            own, out, at = batch.select(list(keys)), [], []

            def rows() -> pa.RecordBatch:
                made = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), more, strict=True)]
                return pa.record_batch([*own.take(pa.array(at)).columns, *made], schema=pa.schema([*own.schema, *more]))

            for i, content in enumerate(batch.column("content")):
                try:
                    if not content.is_valid:
                        raise ValueError("unreadable")
                    found = timed(lambda c=content.as_py(): tokens_of(recognise(c, side)))
                    found = [(*t, None) for t in found] or [empty]
                except Exception as e:  # a failed photo is a row, not the end of the job
                    found = [(*empty[1:], f"{type(e).__name__}: {e}")]
                out += found
                at += [i] * len(found)
                if len(out) >= BATCH:
                    yield rows()
                    out, at = [], []
            if out:
                yield rows()

    return photos.select(*keys, "content").mapInArrow(of, with_columns(photos, keys, TOKEN))


#: What scanned() knows of a photo beside its regions.
ABOUT = ["there", "format", "width", "height", "orientation", "prepared_width", "prepared_height"]


def kept_region() -> Column:
    return Text.keep_token(F.col("text"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("conf"))


def page_tokens(read: DataFrame) -> DataFrame:
    """Tokens for layout: kept regions of photos whose size is known, with img_w and img_h.

    read: regions with what is known of their photo: width, height, orientation and, if preparing made another image,
    prepared_width and prepared_height, in whose pixels the regions are.
    """
    w, h = ("prepared_width", "prepared_height") if "prepared_width" in read.columns else ("width", "height")
    df = read.where((F.col(w) > 0) & (F.col(h) > 0)).where(F.col("text").isNotNull() & kept_region())
    return df.withColumns({"img_w": F.col(w).cast("double"), "img_h": F.col(h).cast("double")}).drop("error", *ABOUT)


def scan_outcomes(photos: DataFrame, read: DataFrame, strict: bool = False) -> DataFrame:
    """outcomes_of the regions read, of every photo (scan_id, photo, there, width)."""
    return outcomes_of(photos.select(*layout.KEYS, "there", "width").join(read, layout.KEYS, "left"), strict)


def outcomes_of(read: DataFrame, strict: bool = False) -> DataFrame:
    """(scan_id, n_photos, n_readable, n_failed, mean_confidence, region_count, error) of every scan.

    read: a row or more for each photo, with there (whether it could be read) and width of the photo. A photo that can't be
    read is skipped but counts in the mean of the photos' confidences; one that was read counts where its size is known. A
    scan without such a photo has an error; strict raises it instead.
    """
    conf = F.when(F.col("text").isNotNull() & kept_region(), F.struct("conf"))
    df = read.select(*layout.KEYS, (F.col("there") & (F.col("width") > 0)).alias("sized"), F.col("error").isNotNull().alias("bad"), conf.alias("kept"))
    # a photo's rows lie together, so most of this is done before the shuffle
    df = df.groupBy(*layout.KEYS).agg(F.first("sized").alias("sized"), F.max("bad").alias("failed"), F.count("kept").alias("regions"), F.coalesce(F.avg("kept.conf"), F.lit(0.0)).alias("mean_confidence"))
    good = F.col("sized") & ~F.col("failed")
    df = df.groupBy("scan_id").agg(F.count("*").alias("n_photos"), F.count_if(good).alias("n_readable"), F.count_if("failed").alias("n_failed"), (F.sum("mean_confidence") / F.count("*")).alias("mean_confidence"), F.sum("regions").alias("region_count"))
    error = F.concat(F.lit("No readable photos — all "), F.col("n_photos").cast("string"), F.lit(" image(s) failed to load or decode."))
    return df.withColumn("error", F.when(F.col("n_readable") == 0, F.raise_error(error) if strict else error).cast("string"))


def scanned(photos: DataFrame, recognise: Recogniser, seconds: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(tokens for layout, outcomes) of photos (scan_id, photo, content), from one pass over them.

    A photo's header is read as its regions are, and what it says is kept beside each of them, so that nothing is
    joined. The regions are written to the shared folder, without the photos, as both results use them.
    """
    sized = P.with_prepared_size(P.with_bounds(photos)).withColumn("there", F.col("content").isNotNull())
    read = scratch.kept(recognised(sized, recognise, *layout.KEYS, *ABOUT, seconds=seconds), "regions")
    return page_tokens(read), outcomes_of(read)


def recognised_crops(crops: DataFrame, photos: DataFrame, prepare: Callable[[bytes, dict], bytes], recognise: Recogniser, seconds: float | None = CROP_SECONDS) -> DataFrame:
    """(scan_id, photo, field, job_no, variant, rx1, ry1, text, conf, error): the second reading of each crop, for reread.winners.

    crops as from reread.crops; prepare makes the crop's image of a photo's bytes and the crop's row.
    A photo travels once, with all its crops (a scan's jobs are few). Crops without text, empty or too
    large ones have a row without text; what fails, or is late, has an error.
    """
    names = ["field", "job_no", "variant", "wanted", "prepared", "left", "top", "width", "height", "scale", "rx1", "ry1"]
    of_photo = crops.groupBy(*layout.KEYS).agg(F.sort_array(F.collect_list(F.struct("job_no", "variant", *[n for n in names if n not in ("job_no", "variant")]))).alias("crops"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        timed = Timed(seconds)

        def once(content: bytes, crop: dict) -> tuple[str | None, float | None]:
            image = prepare(content, crop)
            found = tokens_of(recognise(image, CROP_SIDE)) if image and len(image) <= CROP_BYTES else []
            return (" ".join(t[1] for t in found), sum(t[2] for t in found) / len(found)) if found else (None, None)

        for batch in batches:
            for *key, content, own in zip(*(batch.column(k).to_pylist() for k in layout.KEYS), batch.column("content"), batch.column("crops"), strict=True):
                out = []
                for crop in own.as_py():
                    try:
                        text, conf, error = *timed(once, content.as_py(), crop), None
                    except Exception as e:  # the variant is skipped, with its reason
                        text, conf, error = None, None, f"{type(e).__name__}: {e}"
                    out.append((*key, crop["field"], crop["job_no"], crop["variant"], crop["rx1"], crop["ry1"], text, conf, error))
                yield batch_of(out, batch.schema, layout.KEYS, READING)

    return photos.select(*layout.KEYS, "content").where("content is not null").join(of_photo, layout.KEYS).mapInArrow(of, with_columns(photos, layout.KEYS, READING))


def second_reading(observed: DataFrame, photos: DataFrame, prepare: Callable[[bytes, dict], bytes], recognise: Recogniser) -> DataFrame:
    """observed with what a second reading of its variable print found better. photos: scan_id, photo, content, width, height."""
    sizes = photos.select(*layout.KEYS, F.col("width").alias("img_w"), F.col("height").alias("img_h")).where("width > 0 and height > 0")
    jobs = reread.job_plan(reread.search_rect(reread.targets(observed)).join(sizes, layout.KEYS))
    read = recognised_crops(reread.crops(jobs), photos, prepare, recognise).where("text is not null")
    return reread.improved(observed, reread.winners(read))

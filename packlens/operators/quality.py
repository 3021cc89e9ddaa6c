"""Quality of captures, officers' edits and accuracy of predictions: small aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Tables that grow with the lines are sorted and merged: Spark's estimate of exploded rows is far too small, and would broadcast them.
LARGE = "merge"


def capture_quality(photos: DataFrame) -> DataFrame:
    """A row a scan: mean_confidence, total_chars, region_count and photo_count.

    photos: scan_id, photo, mean_conf, chars, regions; a photo that couldn't be read has nulls and
    counts as confidence 0, so that unread photos lower the mean. Confidences are summed to twelve places
    in decimals, so that the mean doesn't depend on the order of rows; one that isn't finite counts as 0.
    """
    sure = F.coalesce(F.col("mean_conf").try_cast("decimal(38,12)"), F.lit(0).cast("decimal(38,12)"))
    mean = F.sum(sure).cast("double") / F.count("*")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return photos.groupBy("scan_id").agg(mean.alias("mean_confidence"), total("chars").alias("total_chars"), total("regions").alias("region_count"), F.count("*").alias("photo_count"))


def edits(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(scan_id, n, n_changed): rows an officer saw and those whose trimmed text differs; rows without an answer stay as they were."""
    both = before.select(*keys, F.col("text").alias("was")).join(after.select(*keys, F.col("text").alias("now")).hint(LARGE), keys, "left")
    same = F.trim(F.coalesce("now", "was")).eqNullSafe(F.trim("was"))
    return both.groupBy("scan_id").agg(F.count("*").alias("n"), F.count_if(~same).alias("n_changed"))


def accuracy(predicted: DataFrame, *sets: str) -> DataFrame:
    """Share of rows of each evaluation set whose `predicted` is `gold`; null-safe."""
    right = F.col("predicted").eqNullSafe(F.col("gold"))
    return predicted.groupBy(*sets).agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("accuracy"))


def votes_or_none(lines: DataFrame, votes: DataFrame | None, keys: list[str]) -> DataFrame:
    """lines with vote_class and vote_prob; `other` and 0 for lines without a vote, or for all where there is no model."""
    if votes is None:
        return lines.withColumns({"vote_class": F.lit("other"), "vote_prob": F.lit(0.0)})
    v = votes.select(*keys, "vote_class", "vote_prob")
    return lines.join(v.hint(LARGE), keys, "left").withColumns({"vote_class": F.coalesce("vote_class", F.lit("other")), "vote_prob": F.coalesce("vote_prob", F.lit(0.0))})


def chosen_votes(lines: DataFrame, tiers: list[tuple[str, DataFrame | None]], keys: list[str], fall_back: bool = False) -> DataFrame:
    """lines with vote_class, vote_prob and engine: a scan's votes are those of its first model whose votes fit its lines.

    tiers: models' names and votes (keys, vote_class, vote_prob), the best first, None for one that isn't
    ready. Votes fit a scan if they are as many as its lines. Without fall_back only the first ready
    model counts, and a scan that it doesn't fit has no votes (engine null, class `other`, 0).
    keys begin with the scan's.
    """
    scan, ready = keys[0], [(n, v) for n, v in tiers if v is not None]
    counts = lines.groupBy(scan).agg(F.count("*").alias("__lines"))
    engine = F.lit(None).cast("string")
    for i, (name, votes) in reversed(list(enumerate(ready if fall_back else ready[:1]))):
        counts = counts.join(votes.groupBy(scan).agg(F.count("*").alias(f"__n{i}")).hint(LARGE), scan, "left")
        engine = F.when(F.col(f"__n{i}") == F.col("__lines"), name).otherwise(engine)
    df = lines.join(counts.select(scan, engine.alias("engine")).hint(LARGE), scan)
    if ready:
        both = reduce(DataFrame.unionByName, [v.select(*keys, F.lit(n).alias("engine"), "vote_class", "vote_prob") for n, v in ready])
        df = df.join(both.hint(LARGE), [*keys, "engine"], "left")
    else:
        df = df.withColumns({"vote_class": F.lit(None).cast("string"), "vote_prob": F.lit(None).cast("double")})
    return df.withColumns({"vote_class": F.coalesce("vote_class", F.lit("other")), "vote_prob": F.coalesce("vote_prob", F.lit(0.0))})


#: What is said of how fields were read: by mode and, where there were votes, their engine (fixed values).
MODES = {
    "regex": "Regex-only path (smart assist not used).",
    "assisted": {None: "Smart assist unavailable on this device — fell back to regex-only.", "transformer": "Smart-assist (on-device transformer) votes fused with regex validators.", "": "Smart-assist (keyword model) votes fused with regex validators."},
    "ensemble": {None: "Smart assist unavailable — ensemble degraded to regex-only.", "transformer": "Ensemble: best-per-field of regex-only ∪ transformer-assist runs.", "": "Ensemble: best-per-field of regex-only ∪ smart-assist runs."},
}


def mode_note(mode: str, engine: Column) -> Column:
    """The note of a scan read in a mode with an engine's votes (null: none)."""
    notes = MODES[mode]
    if isinstance(notes, str):
        return F.lit(notes)
    return F.when(engine.isNull(), notes[None]).when(engine == "transformer", notes["transformer"]).otherwise(notes[""])

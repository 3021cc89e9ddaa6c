"""Word pieces of label lines: words by column expressions, greedy longest match in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that lose their accents, and those that become two (fixed values).
PLAIN = {
    "a": "àáâãäåāăą", "c": "çćč", "d": "đ", "e": "èéêëēęě", "g": "ğ", "i": "ìíîïīı", "l": "ł", "n": "ñń",
    "o": "òóôõöøō", "s": "šś", "u": "ùúûüū", "y": "ýÿ", "z": "žźż",
}
PAIRS = {"ß": "ss", "œ": "oe", "æ": "ae"}
SPACES = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
LONGEST_WORD = 100


def words(text: Column) -> Column:
    """Lower-case words without accents or control characters, each ASCII punctuation mark a word of its own."""
    text = F.regexp_replace(F.lower(text), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffd}]", "")
    text = F.translate(text, "".join(PLAIN.values()), "".join(k * len(v) for k, v in PLAIN.items()))
    for letter, pair in PAIRS.items():
        text = F.replace(text, F.lit(letter), F.lit(pair))
    text = F.regexp_replace(text, r"([!-/:-@\[-`{-~])", " $1 ")
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def matched(word: str, known: dict[str, int], unknown: int) -> list[int]:
    """Ids of the longest known pieces from the left; a word that can't be covered, or a very long one, is unknown."""
    ids, at = [], 0
    while at < len(word) <= LONGEST_WORD:
        lead = "##" if at else ""
        end = next((e for e in range(len(word), at, -1) if lead + word[at:e] in known), None)
        if end is None:
            return [unknown]
        ids.append(known[lead + word[at:end]])
        at = end
    return ids or [unknown]


def encoder(vocabulary: list[str], max_len: int = 48) -> Callable[[Column], Column]:
    """A function from a text column to ids between [CLS] and [SEP], at most max_len; null texts are empty."""
    known = {w: i for i, w in enumerate(vocabulary)}
    cls, sep, unknown = known.get("[CLS]", 101), known.get("[SEP]", 102), known.get("[UNK]", 100)

    @F.pandas_udf("array<int>")
    def ids(lists: pd.Series) -> pd.Series:
        seen: dict[str, list[int]] = {}
        out = []
        for ws in lists:
            row = [cls]
            for w in ws:
                if len(row) >= max_len - 1:
                    break
                if w not in seen:
                    seen[w] = matched(w, known, unknown)
                row += seen[w]
            out.append([*row[: max_len - 1], sep])
        return pd.Series(out)

    return lambda text: ids(words(F.coalesce(text, F.lit(""))))


def padded(ids: Column, width: Column, pad: int = 0) -> tuple[Column, Column]:
    """(ids, mask) of a row, filled up to the batch's width."""
    fill = lambda x: F.array_repeat(F.lit(x), (width - F.size(ids)).cast("int"))
    return F.concat(ids, fill(pad)), F.concat(F.transform(ids, lambda _: F.lit(1)), fill(0))

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from packlens.llm import scans, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, x string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        built[c] = tuple(own.get(first, [])[:h] + v[h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    out = []
    for k, cs in members.items():
        inside = [u for u in members if u[: len(k)] == k]
        saved = sum((len(members[u]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", u[-1][1])) for u in inside if u)
        ends = ",".join(str(c) for c in cs if len(built[c]) == len(k))
        out.append((cs[0], len(k), members[k[:-1]][0] if k else None, len(cs), len(children[k]), sum(not children[u] for u in inside), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    assert sorted(map(tuple, trie.prefix_trie(df, **options).collect()), key=str) == brute(rows)


def conversations(seed, n, turns=4, vocabulary=3):
    r = random.Random(seed)
    return [(c, t if r.random() > 0.1 else None, r.choice(["user", "bot"]), r.choice(["a b", "c", "d\te f", "", None][:vocabulary])) for c in range(n) for t in range(r.randrange(turns + 1))]


def test_edge_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "hi there"), (1, 0, "user", "hi there"), (None, 0, "user", "lost"), (40, 1, "u", "x " * 100_000), (41, 1, "u", "x " * 100_000), (41, 0, "u", "x"), (-3, 0, "u", "é\xa0é"), (-25, 2, "u", "q"), (-20, 2, "u", "q"), (60, 0, "a", "bc"), (61, 0, "ab", "c")]
    check(spark, rows)


def test_empty_tables(spark):
    check(spark, [])
    check(spark, [(None, 1, "a", "b")])


def test_turnless_conversations_only(spark):
    """h is 3 or so for some ids without a base; all their turns go."""
    only = [c for c in range(21, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:5]
    check(spark, [(c, 0, "u", "gone") for c in only])


@pytest.mark.parametrize("seed,n,turns", [(1, 60, 4), (2, 200, 3), (3, 30, 40)])
def test_random(spark, seed, n, turns):
    check(spark, conversations(seed, n, turns))


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_collisions_are_split(spark, bits):
    check(spark, conversations(4, 60, 4, 5), bits=bits)


def test_hot_conversation_over_many_partitions(spark):
    """One conversation with most turns is scanned in several tasks; rows repeated in full are turns."""
    rows = [(0, i, "u", f"t{i % 7}") for i in range(150)] + [(3, 0, "u", "same")] * 60 + [(20 + i, 0, "u", "common") for i in range(40)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
        assert df.repartitionByRange("conv_id", "turn").rdd.getNumPartitions() > 1
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_long_list_of_ends(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    check(spark, [(20 * i, 0, "u", "all the same") for i in range(50)])


def test_lanes_fit_longs():
    assert (scans.PRIME - 1) ** 2 + scans.PRIME < 1 << 63 and all(1 < b < scans.PRIME for b in scans.BASES)
    assert [int(x) for x in scans.power(0, scans.np.arange(5))] == [pow(scans.BASES[0], e, scans.PRIME) for e in range(5)]

"""Quality rules with hosts of all kinds, one of them suspect, against plain Python and the SQL."""

import functools
import random

import duckdb
import pytest

from packlens.llm import quality
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string, kept string, rate double"


@functools.lru_cache(None)
def counts(text):
    """The five counts, and whether the base, strict and advisory rules fail."""
    text = text or ""
    w = brute.WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen, twice = set(), set()
    for g in grams:
        (twice if g in seen else seen).add(g)
    n, repeat = len(w), len({i + j for i, g in enumerate(grams) if g in twice for j in range(5)})
    chars, symbols = sum(map(len, w)), sum(c in "#*$%&|<>" for c in text)
    lines = [x for x in text.split("\n") if brute.WORD.search(x)]
    upper, dup = sum("A" <= c <= "Z" for c in text), len(lines) - len(set(lines))
    failed = n < 10 or 100 * repeat > 20 * n, 100 * symbols > 10 * n or 100 * upper > 50 * chars, chars < 3 * n or chars > 10 * n or 100 * dup > 30 * len(lines)
    return (n, chars, symbols, dup, repeat), failed


def host_rates(rows):
    """Each host's rate under the beta prior of all hosts' moments."""
    hosts = {}
    for _, t, s, *_ in rows:
        n, k = hosts.get(s, (0, 0))
        hosts[s] = n + 1, k + any(counts(t)[1])
    total, bad = sum(n for n, _ in hosts.values()), sum(k for _, k in hosts.values())
    m = bad / total
    between = max(sum(n * (k / n) ** 2 for n, k in hosts.values()) / total - m * m - len(hosts) * m * (1 - m) / total, 1e-6)
    size = min(max(m * (1 - m) / between - 1, 1), 1e6)
    return {s: (k + m * size) / (n + size) for s, (n, k) in hosts.items()}


def verdicts(rows):
    rates = host_rates(rows)
    out = []
    for d, t, s, *_ in rows:
        own, (base, strict, advisory) = counts(t)
        out.append((d, *own, base, not base and not strict and not (rates[s] >= quality.SUSPECT_RATE and advisory)))
    return out


def corpus(seed=2):
    """Host `bad` mostly fails, `fair` sometimes, `small` has one failing document of five."""
    r = random.Random(seed)
    word = lambda a=3, b=8: "".join(r.choices("abcdefghijklmnop", k=r.randrange(a, b)))
    good = lambda: " ".join(word() for _ in range(r.randrange(12, 60)))
    short = lambda: " ".join(word(1, 3) for _ in range(30))  # noqa: E731  advisory only
    rows = [(i, good(), f"host{i % 7}") for i in range(140)]
    rows += [(1000 + i, short() if i % 4 else good(), "bad") for i in range(40)]
    rows += [(2000 + i, r.choice([short, good, good])(), "fair") for i in range(40)]
    rows += [(3000, short(), "small"), (3001, "\n".join(["the same line here again"] * 9), None), (3002, None, None), (3003, "", "fair"), (3004, good().upper(), "host1"), (3005, good() + " ###" * 20, "host2"), (None, good(), None)]
    rows += [(4000, (good() + "\n") * 300, "host3"), (4001, " ".join(word() for _ in range(60_000)), "host3"), rows[3], rows[3]]
    rows += [(5000 + i, good(), "small" if i < 4 else None) for i in range(16)]
    return [(d, t, s, "x", 0.0) for d, t, s in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_a_suspect_host_loses_what_others_keep(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = quality.quality_rules(df).collect()
    assert sorted(((r.doc_id, *(r[c] for c in quality.COUNTS), r.base_failed, r.kept) for r in got), key=str) == sorted(verdicts(rows), key=str)
    rates = {r.host: r.rate for r in quality.host_verdicts(quality.rule_counts(df)).collect()}
    want = host_rates(rows)
    assert rates == {s: pytest.approx(x) for s, x in want.items()}
    assert want["bad"] >= quality.SUSPECT_RATE and all(x < quality.SUSPECT_RATE for s, x in want.items() if s != "bad")
    of = lambda s: [k for (d, t, h, *_), (*_, k) in zip(rows, verdicts(rows), strict=True) if h == s and counts(t)[1] == (False, False, True)]
    assert of("bad") == [False] * 30 and of("fair") and all(of("fair")) and of("small") == [True]
    kept = sorted(((r.doc_id, r.text, r.source) for r in quality.good_documents(df).collect()), key=str)
    assert kept == sorted(((d, t, s) for (d, t, s, *_), (*_, k) in zip(rows, verdicts(rows), strict=True) if k), key=str)


def test_a_suspect_host_against_sql(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(quality.OP7_SQL).fetchall()
    got = [tuple(r) for r in quality.op7(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[0] and 1000 <= r[0] < 2000 and not r[-1] for r in got)

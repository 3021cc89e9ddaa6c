import random
import re

from packlens.llm import pii

SCHEMA = "doc_id long, text string, rid string, spans int"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_against_regexes():
    r = random.Random(4)
    parts = ["a.b@", "c-d.ef", "@", "é", " ", ".", "1.2.3.4", "256.1.1.1", "+1 (555) 010-", "4111 1111 1111 1111", "4111-1111", "007.8.9.10", "x%+", "12", "+", "-", "\n", "٣"]
    for _ in range(3000):
        text = "".join(r.choices(parts, k=r.randrange(12)))
        assert pii.base_spans(text) == brute(text), text


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    return sorted(((r.doc_id, tuple((x.start, x.rank, x.end) for x in r.spans)) for r in pii.personal_data(df).collect()), key=str)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "me@x.org and me@x.org"), (3, "me@x.org and me@x.org"), (None, "+44 20 7946 0018"), (4, "no data: here = 1"), (5, "9" * 200_000 + " a" * 10 + "@" * 5000), (6, "=:" * 5000)]
    assert run(spark, rows) == sorted(((d, tuple(brute(t) if d != 5 else ())) for d, t in rows), key=str)
    assert run(spark, []) == []


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    rows = [(i, f"text before, contact: user{i}@mail.org and order no: word{i}") for i in range(12)]
    rows += [(20, "write to contact: AB-99-1234 soon"), (21, "order no: AB-99-1234"), (22, "contact: nobody"), (23, "the id AB-77-5678 stays")]
    got = dict(run(spark, rows))
    assert got[20] == ((18, 4, 28),)
    # the same identifier elsewhere is trusted, but one instance does not make its context a pattern
    assert got[21] == got[22] == got[23] == ()
    assert got[3] == tuple(brute(rows[3][1]))


def test_contexts_in_running_text_and_over_many_hops(spark):
    rows = [(1000 + i, f"please call number +44 20 7946 00{i:02d} today") for i in range(10, 50)]
    rows += [(30, "please call number AB123456 today"), (31, "my mail is x, call number soon")]
    # each hop's context is only reached by identifiers of the one before, which outnumber its own
    hops = [20, 11, 6, 2]
    for k, n in enumerate(hops):
        before = "call number" if k == 0 else f"hop{chr(97 + k)} kind{chr(97 + k)}"
        after = f"hop{chr(98 + k)} kind{chr(98 + k)}"
        rows += [(100 + 50 * k + j, f"{before} QQ{k}{j:02d}777 ; {after} QQ{k}{j:02d}777") for j in range(n)]
    got = dict(run(spark, rows))
    assert (19, 4, 27) in got[30]
    assert got[31] == ()
    assert all((11, 4, 19) in got[100 + 50 * k + j] or (12, 4, 20) in got[100 + 50 * k + j] for k, n in enumerate(hops) for j in range(n))

import random

from packlens.llm.components import components


def brute(edges):
    root = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return sorted((n, r) for n, r in root.items() if n != r)


def test_shapes(spark):
    r = random.Random(0)
    chain = [(i, i + 1) for i in range(-20, 20)]
    shapes = [[], [(1, 1)], [(2, 1), (1, 2)], chain, [(0, i) for i in range(50)], [(100 - i, 99 - i) for i in range(30)], [(r.randrange(200), r.randrange(200)) for _ in range(150)]]
    for edges in shapes:
        got = components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert sorted((x.node, x.root) for x in got) == brute(edges)

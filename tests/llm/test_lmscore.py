import hashlib
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from packlens.llm import lmscore
from tests.llm import brute

SCHEMA = "doc_id long, text string, rid string, score int"
pytestmark = pytest.mark.skipif(not Path(lmscore.TOKENIZER).exists(), reason="no tokenizer file")


def words(text):
    return brute.WORD.findall((text or "").translate(brute.A_Z))


def is_held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def base_rows(rows):
    counts, n_train = Counter(), 0
    for d, t in rows:
        if not is_held_out(d):
            counts.update(words(t))
            n_train += 1
    total, v = sum(counts.values()) + n_train, len(counts) + (n_train > 0)
    out = []
    for d, t in rows:
        c = [counts[w] for w in words(t)] + [n_train]
        out.append((d, is_held_out(d), len(c), sum(x > 0 for x in c), total, round(sum(math.log10((x + 1) / (total + v + 1)) for x in c), 6)))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3)
    return lmscore.lm_scores(df, **more).collect()


def texts(n, seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("aeioubcd", k=r.randrange(1, 8))) for _ in range(300)]
    return [(i, " ".join(r.choices(vocabulary, k=r.randrange(0, 200))) + r.choice(["", "\nÉa Z", " rare%d" % i])) for i in range(n)]


def test_base_scores_with_and_without_a_head(spark):
    rows = [*texts(40), (None, "no id"), (None, None), (100, ""), (101, None), (7, "twice"), (7, "twice"), (8, " \n "), (9, "once " * 9000)]
    want = base_rows(rows)
    for most in (1 << 21, 50, 1):
        got = run(spark, rows, head_words=most, steps=5)
        assert sorted(((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got), key=str) == want
        assert all(x.score < 0 and math.isfinite(x.score) for x in got)


def test_empty_and_held_out_only(spark):
    assert run(spark, []) == []
    alone = next(i for i in range(100) if is_held_out(i))
    assert [x.n_known for x in run(spark, [(alone, "some words")])] == [0]


def model_and_windows():
    subwords = lmscore.Subwords(Path(lmscore.TOKENIZER).read_bytes())
    counts = np.zeros(subwords.size)
    sample = [t for _, t in texts(60, seed=3)]
    for t in sample:
        _, ids = subwords.ids([w.encode() for w in words(t)])
        np.add.at(counts, ids.astype(int), 1)
    counts[subwords.end] = 60
    model = lmscore.Attention(counts)
    return subwords, model, sample


def test_probabilities_add_up_and_gradients_are_right():
    subwords, model, sample = model_and_windows()
    rows, seen, goals, scored = (x[:3] for x in lmscore.sample_windows(sample[:3], subwords, model))
    every = [model.log10(rows, seen, np.full_like(goals, c), model.tables()) for c in range(lmscore.CLASSES)]
    assert np.allclose(sum(10.0**x for x in every), 1, atol=1e-3)
    assert np.allclose(np.bincount(model.of_class, 10.0**model.within, lmscore.CLASSES), 1, atol=1e-3)
    model.p = {k: x.astype(np.float64) for k, x in model.p.items()}
    _, g = model.gradients(rows, seen, goals, scored)
    r = np.random.default_rng(0)
    for k, x in model.p.items():
        i = tuple(r.integers(0, n) for n in x.shape) if k != "e" else (int(rows[0, -2]), 1)
        old = x[i]
        x[i] = old + 1e-4
        up = model.gradients(rows, seen, goals, scored)[0]
        x[i] = old - 1e-4
        down = model.gradients(rows, seen, goals, scored)[0]
        x[i] = old
        assert abs((up - down) / 2e-4 - g[k][i]) < 1e-3, k


def test_each_id_is_scored_once_and_only_from_those_before():
    subwords, model, _ = model_and_windows()
    ids = np.random.default_rng(1).integers(0, 5000, 200)
    lengths = np.array([1, 50, 24, 25, 100])
    text, _, _, goals, scored = model.windows(lengths, ids, subwords.end)
    assert goals[scored].tolist() == ids.tolist() and np.bincount(text, scored.sum(axis=1)).tolist() == lengths.tolist()
    changed = ids.copy()
    changed[-1] = 77
    a, b = (lmscore.model_scores(model, model.tables(), lengths, x, subwords.end) for x in (ids, changed))
    assert np.allclose(a[:-1], b[:-1])
    last = lambda x: model.within[x[-1]]
    prefix = [lmscore.model_scores(model, model.tables(), np.array([99]), x[100:199], subwords.end)[0] for x in (ids, changed)]
    assert np.isclose(*prefix) and last(ids) < 0


def test_training_helps_on_held_out_text():
    subwords, model, sample = model_and_windows()
    held = lmscore.sample_windows(sample[45:], subwords, model)
    before = model.gradients(*held)[0]
    model.fit(*lmscore.sample_windows(sample[:45], subwords, model), steps=150)
    assert model.gradients(*held)[0] < before - 0.2


def test_pieces_give_the_windows_of_whole_texts():
    subwords, model, _ = model_and_windows()
    ids = np.random.default_rng(2).integers(0, 5000, 400)
    lengths = np.array([1, 24, 25, 150, 200])
    _, rows, seen, goals, scored = model.windows(lengths, ids, subwords.end)
    ends = np.cumsum(lengths)
    pieces = [x for a, b in zip(ends - lengths, ends, strict=True) for x in lmscore.cut(ids[a:b], subwords.end, 3)]
    got = lmscore.piece_windows(pieces, model)
    assert len(pieces) == 1 + 1 + 1 + 3 + 3 and (got[1] == seen).all() and (got[3] == scored).all()
    assert (got[2] == model.of_class[goals])[scored].all()
    before = np.concatenate([np.ones((len(rows), lmscore.CONTEXT + 1), bool), scored[:, :-1]], axis=1)  # what is read for a scored id
    assert (got[0] == rows)[before].all()


def test_every_training_document_is_learnt_from(spark):
    """Long documents alone train the model, a text past the first 400 documents changes it, and the order of rows doesn't."""
    train = [i for i in range(3000) if not is_held_out(i)]
    held = next(i for i in range(3000) if is_held_out(i))
    long = [(i, "alpha beta gamma delta " * 2000) for i in train[:3]]
    probe = (held, "alpha beta gamma delta " * 50)
    score = lambda rows, **more: {x.doc_id: x.score for x in run(spark, rows, **more)}[held]
    assert score([*long, probe], steps=200) > score([*long, probe], steps=1) * 0.8
    few = [(i, "one two three four five six") for i in train[:800]]
    plain = score([*few, probe], steps=20, shard_windows=64)
    assert plain == score([probe, *few[::-1]], steps=20, shard_windows=64)
    by_hash = sorted(train[:800], key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    last = by_hash[-1]
    swapped = [(i, "six five four three two one" if i == last else t) for i, t in few]
    assert plain != score([*swapped, probe], steps=20, shard_windows=64)


def test_score_against_a_loop_over_ids():
    """The model's score of a text, id by id: attention over the window's ids so far, group, class, share of the class."""
    subwords, model, sample = model_and_windows()
    model.fit(*lmscore.sample_windows(sample, subwords, model), steps=20)
    p, ids = {k: x.astype(np.float64) for k, x in model.p.items()}, np.random.default_rng(5).integers(0, 3000, 60)
    ids[-1] = subwords.end
    step, want = lmscore.WINDOW - lmscore.CONTEXT, 0.0
    before = [subwords.end, *ids[:-1].tolist()]
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for i, goal in enumerate(ids.tolist()):
        low = max(0, i // step * step - lmscore.CONTEXT)
        x = p["e"][model.row[before[low : i + 1]]]
        a = softmax(np.array([x[-1] @ p["q"] @ (y @ p["k"]) / math.sqrt(lmscore.WIDTH) + p["r"][i - low - j] for j, y in enumerate(x)]))
        h = x[-1] + sum(w * (y @ p["v"]) for w, y in zip(a, x, strict=True))
        z = np.maximum(h @ p["w1"] + p["b1"], 0)
        group, own = divmod(int(model.of_class[goal]), lmscore.EACH)
        want += math.log10(softmax(z @ p["u1"] + p["c1"])[group] * softmax(z @ p["u2"][group] + p["c2"][group])[own]) + float(model.within[goal])
    got = lmscore.model_scores(model, model.tables(), np.array([len(ids)]), ids, subwords.end)[0]
    assert abs(got - want) < 1e-3 * abs(want)


def test_the_model_beats_a_unigram_on_held_out_text(spark):
    """On the test tables' documents, over the same ids: log10 a token of held-out text against add-one counts of training ids."""
    pd = pytest.importorskip("pandas")
    path = Path("/root/testdata/sf0.001/documents.parquet")
    if not path.exists():
        pytest.skip("no test tables")
    rows = [(int(d), t) for d, t in pd.read_parquet(path)[["doc_id", "text"]].itertuples(index=False)]
    score = {r.doc_id: r.score for r in run(spark, rows)}
    subwords = lmscore.Subwords(Path(lmscore.TOKENIZER).read_bytes())
    ids = {}
    for d, t in rows:
        _, own = subwords.ids([w.encode() for w in words(t)]) if words(t) else (None, np.zeros(0, int))
        ids[d] = [*own.tolist(), subwords.end]
    counts = Counter(i for d in ids if not is_held_out(d) for i in ids[d])
    total = sum(counts.values()) + subwords.size
    held = [d for d in ids if is_held_out(d)]
    n = sum(len(words(t)) + 1 for d, t in rows if is_held_out(d))
    model, unigram = sum(score[d] for d in held) / n, sum(math.log10((counts[i] + 1) / total) for d in held for i in ids[d]) / n
    print(f"log10 a token of held-out text: model {model:.3f}, unigram {unigram:.3f}")
    assert len(held) > 15 and model > unigram + 0.2


def test_words_of_a_chunk_are_told_apart_without_a_sort():
    text = "B a\tb É a  A\nwürde É".encode()
    data = np.frombuffer(text, np.uint8)
    _, starts, ends = lmscore.npwords.words(np.array([0, len(data)]), data)
    first, inverse = lmscore.distinct(lmscore.npwords.hashes(data, starts, ends))
    assert first.tolist() == [0, 1, 3, 6] and inverse.tolist() == [0, 1, 0, 2, 1, 1, 3, 2]
    assert lmscore.lowered_array(data, starts, ends, first).to_pylist() == [b"b", b"a", "É".encode(), "würde".encode()]
    none = np.zeros(0, np.int64)
    assert [x.tolist() for x in lmscore.distinct(none.astype(np.uint64))] == [[], []] and lmscore.lowered_array(data[:0], none, none, none).to_pylist() == []


def test_no_memory_is_given_back_between_steps():
    """Steps of a fit use the memory of those before them: few new pages a step."""
    resource = pytest.importorskip("resource")
    subwords, model, _ = model_and_windows()
    ids = np.random.default_rng(3).integers(0, 5000, 24 * lmscore.BATCH)
    _, rows, seen, goals, scored = model.windows(np.array([len(ids)]), ids, subwords.end)
    data = rows, seen, model.of_class[goals], scored.astype(np.float32)
    lmscore.hold_memory()
    model.fit(*data, steps=3)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    model.fit(*data, steps=20)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 20 * 500


def test_the_dealt_pieces_are_gone_once_the_model_is_fitted(spark):
    before = len(lmscore.base._written)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in texts(20)], SCHEMA)
    lmscore.lm_scores(df, steps=2)
    assert {p.rpartition("/")[2] for _, p in lmscore.base._written[before:]} == {"word_counts", "ids"}

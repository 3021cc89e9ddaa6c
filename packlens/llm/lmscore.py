"""Language-model scores of documents (operator 10).

Words of all training documents are counted. The model is causal self-attention over subword ids of a
given tokenizer, trained in numpy on all training documents: it predicts the next id's group, then its
class within the group, both from the context; the most frequent ids are classes of their own, and an id
within a shared class follows the subword counts of all training documents. Texts are cut into pieces
of windows, which are dealt by hash to shards of about SHARD windows: the first shard is fitted from the
drawn weights, every other one from what that gave, and their weights are averaged by windows. A
document is scored in overlapping windows, so that each id is scored once, with CONTEXT ids before it
at least, in batches with masked attention.
"""

from __future__ import annotations

import base64
import copy
import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.llm import base, npwords

#: A public tokenizer's ranks, one "base64 rank" a line.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Held-out documents: crc32 of the id as text modulo FOLDS is HELD_OUT.
FOLDS, HELD_OUT = 7, 2
#: Words sent to executors; rarer ones are joined.
HEAD_WORDS = 1 << 18
#: Windows of a shard that is fitted in one task, on average, and of a piece of a text at most.
SHARD, PIECE = 1 << 16, 256
#: Ids of texts that are scored together, one text at least.
AT_ONCE = 1 << 19
#: The largest steps on the first shard and on the others, and a weight's unit where weights are added up.
RATE, LATER_RATE, UNIT = 0.02, 0.005, 2.0**-24
#: Window, ids of it that are context only, ids with an embedding of their own.
WINDOW, CONTEXT, EMBEDDED = 32, 8, 4096
#: Groups of classes, classes of a group, ids with a class of their own; the last is whole groups.
GROUPS, EACH, SINGLE = 16, 16, 128
CLASSES = GROUPS * EACH
WIDTH, HIDDEN, STEPS, BATCH = 8, 16, 400, 512


# --- tokenizer


class Subwords:
    """Ids of words, each with the space before it; the end of a text is one more id."""

    def __init__(self, ranks: bytes):
        self.ranks, self._encoding = ranks, None
        self.end = ranks.count(b"\n") + (not ranks.endswith(b"\n"))
        self.size = self.end + 1

    def __getstate__(self):
        return {"ranks": self.ranks, "_encoding": None, "end": self.end, "size": self.size}

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(first id of each word and one past the last, ids)."""
        if self._encoding is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
            self._encoding = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        encode = self._encoding._encode_single_piece
        found = [encode(b" " + w) for w in words]
        firsts = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(x) for x in found], out=firsts[1:])
        return firsts, np.fromiter((i for x in found for i in x), np.uint16 if self.size <= 65536 else np.uint32, int(firsts[-1]))


def ragged(firsts: np.ndarray, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length of each, values one after another) of these rows of a ragged table."""
    lengths = firsts[rows + 1] - firsts[rows]
    ends = np.cumsum(lengths)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(firsts[rows] - (ends - lengths), lengths)
    return lengths, values[at]


# --- model


class Attention:
    """One layer of causal self-attention and one hidden layer, over classes of ids."""

    def __init__(self, counts: np.ndarray, seed: int = 7):
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        # the most frequent ids have their own classes, the others share the rest in equal weight
        mass = np.cumsum((counts + 1.0)[order][SINGLE:])
        shared = SINGLE + np.minimum((mass - 1e-9) / mass[-1] * (CLASSES - SINGLE), CLASSES - SINGLE - 1).astype(np.int64)
        self.of_class = np.concatenate([np.arange(SINGLE), shared])[rank].astype(np.int32)
        self.row = np.where(rank < EMBEDDED, rank, EMBEDDED + self.of_class).astype(np.int32)
        total = np.bincount(self.of_class, counts + 1.0, CLASSES)
        self.within = (np.log10(counts + 1.0) - np.log10(total[self.of_class])).astype(np.float32)
        r = np.random.Generator(np.random.PCG64(seed))
        draw = lambda *shape: (r.standard_normal(shape) / math.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "e": (r.standard_normal((EMBEDDED + CLASSES, WIDTH)) * 0.3).astype(np.float32),
            "q": draw(WIDTH, WIDTH), "k": draw(WIDTH, WIDTH), "v": draw(WIDTH, WIDTH),
            "r": np.zeros(WINDOW, np.float32),
            "w1": draw(WIDTH, HIDDEN), "b1": np.zeros(HIDDEN, np.float32),
            "u1": draw(HIDDEN, GROUPS), "c1": np.log(total.reshape(GROUPS, EACH).sum(1) / total.sum()).astype(np.float32),
            "u2": draw(HIDDEN, GROUPS, EACH).transpose(1, 0, 2).copy(), "c2": np.log(np.maximum(total, 0.5)).reshape(GROUPS, EACH).astype(np.float32),
        }
        self.p["c2"] -= self.p["c2"].max(axis=1, keepdims=True)
        i, j = np.arange(CONTEXT, WINDOW)[:, None], np.arange(WINDOW)[None, :]
        self.distance, self.causal = np.clip(i - j, 0, None), (j <= i).astype(np.float32)

    def attend(self, rows: np.ndarray, seen: np.ndarray, tables: tuple) -> tuple[np.ndarray, ...]:
        """(hidden state and a one, attention's part of them, weights before they are divided by their sums, sums, queries, keys, values and a one) of the ids after the context in windows of embedding rows; seen masks the text's start."""
        e, q, k, v = (np.take(t, r, axis=0) for t, r in zip(tables, (rows[:, CONTEXT:], rows[:, CONTEXT:], rows, rows), strict=True))
        a = np.matmul(q, k.transpose(0, 2, 1))
        np.clip(a, -30, 30, out=a)
        np.exp(a, out=a)
        a *= np.exp(np.clip(self.p["r"], -30, 30))[self.distance] * self.causal
        opens = np.flatnonzero(seen[:, 0] == 0)  # what a window doesn't see is its first ids
        a[opens] *= seen[opens, None, :]
        out = np.matmul(a, v)
        total = out[:, :, WIDTH:].copy()
        out /= total
        return e + out, out, a, total, q, k, v

    def tables(self) -> tuple:
        """Of each embedding row itself and a nought, query, key, value and a one: the ones add up weights and carry the biases."""
        p, last = self.p, np.ones((len(self.p["e"]), 1), self.p["e"].dtype)
        return np.hstack([p["e"], 0 * last]), p["e"] @ p["q"] / np.float32(math.sqrt(WIDTH)), p["e"] @ p["k"], np.hstack([p["e"] @ p["v"], last])

    def layers(self) -> tuple[np.ndarray, np.ndarray]:
        """(hidden layer, of each group the logits of groups and of its classes) as matrices with the biases as last row; the hidden layer keeps the one."""
        p = self.p
        w = np.zeros((WIDTH + 1, HIDDEN + 1), p["w1"].dtype)
        w[:-1, :-1], w[-1, :-1], w[-1, -1] = p["w1"], p["b1"], 1
        u = np.empty((GROUPS, HIDDEN + 1, GROUPS + EACH), p["u1"].dtype)
        u[:, :-1, :GROUPS], u[:, -1, :GROUPS], u[:, :-1, GROUPS:], u[:, -1, GROUPS:] = p["u1"], p["c1"], p["u2"], p["c2"]
        return w, u

    def predict(self, h: np.ndarray, goals: np.ndarray, layers: tuple) -> tuple:
        """Softmax over groups and over the classes of the goal's group, of hidden states put in order of the goals' groups.

        (order, parts, states, hidden layer, exponentials, their sums, places of the goals' group and class, natural log probabilities).
        """
        w, u = layers
        order, parts = self.by_group(goals)
        h, goals = np.take(h, order, axis=0), goals[order]
        z = h @ w
        np.maximum(z, 0, out=z)
        x = np.empty((len(z), GROUPS + EACH), z.dtype)
        for k, a, b in parts:
            np.matmul(z[a:b], u[k], out=x[a:b])
        np.clip(x, -60, 60, out=x)
        first = np.arange(0, x.size, GROUPS + EACH)
        group, own = first + goals // EACH, first + GROUPS + goals % EACH
        flat = x.reshape(-1)
        logs = flat[group] + flat[own]
        np.exp(x, out=x)
        total = (x.reshape(-1, EACH) @ np.ones(EACH, x.dtype)).reshape(-1, 2)
        logs -= np.log(total) @ np.ones(2, x.dtype)
        return order, parts, h, z, x, total, group, own, logs

    def by_group(self, goals: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """(order of goals by their groups, (group, first and last place in that order) of groups that come)."""
        group = (goals // EACH).astype(np.uint8)
        ends = np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()
        return np.argsort(group, kind="stable"), [(k, a, b) for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if b > a]

    def log10(self, rows: np.ndarray, seen: np.ndarray, goals: np.ndarray, tables: tuple) -> np.ndarray:
        """log10 probability of the goals' classes, (windows, WINDOW - CONTEXT)."""
        h = self.attend(rows, seen, tables)[0]
        order, *_, logs = self.predict(h.reshape(-1, WIDTH + 1), goals.ravel(), self.layers())
        out = np.empty_like(logs)
        out[order] = logs / np.float32(math.log(10))
        return out.reshape(goals.shape)

    def gradients(self, rows: np.ndarray, seen: np.ndarray, goals: np.ndarray, scored: np.ndarray) -> tuple[float, dict]:
        """(mean loss of the scored goals, its slope by each weight)."""
        p, scale, (w, u) = self.p, np.float32(1 / math.sqrt(WIDTH)), self.layers()
        h, out, a, sums, q, k, v = self.attend(rows, seen, self.tables())
        order, parts, h, z, d, total, group, own, logs = self.predict(h.reshape(-1, WIDTH + 1), goals.ravel(), (w, u))
        weight = (scored.ravel() / max(1.0, float(scored.sum()))).astype(z.dtype)[order]
        # an exponential over its sum, less one at the goal, is the loss's slope by a logit
        flat, by_softmax = d.reshape(-1), d.reshape(-1, 2, EACH)
        by_softmax *= (weight[:, None] / total)[:, :, None]
        flat[group] -= weight
        flat[own] -= weight
        du, dz = np.zeros_like(u), np.empty_like(z)
        for n, x, y in parts:
            du[n] = z[x:y].T @ d[x:y]
            np.matmul(d[x:y], u[n].T, out=dz[x:y])
        dz *= z > 0
        dw = h.T @ dz
        g = {"u1": du[:, :-1, :GROUPS].sum(0), "c1": du[:, -1, :GROUPS].sum(0), "u2": du[:, :-1, GROUPS:], "c2": du[:, -1, GROUPS:], "w1": dw[:-1, :-1], "b1": dw[-1, :-1]}
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        # slopes by attention's part over its sums, and what the sums themselves take off
        by_out = np.take(dz @ w.T, back, axis=0).reshape(out.shape)
        dh = by_out[:, :, :WIDTH].copy()
        by_out[:, :, WIDTH] = ((dh * out[:, :, :WIDTH]).reshape(-1, WIDTH) @ np.full(WIDTH, -1, dh.dtype)).reshape(dh.shape[:2])
        by_out /= sums
        da = np.matmul(by_out, v.transpose(0, 2, 1))
        da *= a
        g["r"] = np.bincount(self.distance.ravel(), da.sum(axis=0).ravel(), WINDOW)
        # slopes by queries, keys and values side by side; context has no queries
        dqkv = np.empty((*rows.shape, 3 * WIDTH), da.dtype)
        dqkv[:, :CONTEXT, :WIDTH] = 0
        np.matmul(da, k, out=dqkv[:, CONTEXT:, :WIDTH])
        np.matmul(da.transpose(0, 2, 1), q, out=dqkv[:, :, WIDTH : 2 * WIDTH])
        np.matmul(a.transpose(0, 2, 1), by_out[:, :, :WIDTH], out=dqkv[:, :, 2 * WIDTH :])
        dqkv = dqkv.reshape(-1, 3 * WIDTH)
        at = rows.ravel().astype(np.intp)
        all_three = np.take(p["e"], at, axis=0).T @ dqkv
        g |= {"q": all_three[:, :WIDTH] * scale, "k": all_three[:, WIDTH : 2 * WIDTH], "v": all_three[:, 2 * WIDTH :]}
        dx = (dqkv @ np.concatenate([p["q"].T * scale, p["k"].T, p["v"].T])).reshape(*rows.shape, WIDTH)
        dx[:, CONTEXT:] += dh
        dx = dx.reshape(-1, WIDTH)
        g["e"] = np.stack([np.bincount(at, dx[:, c], len(p["e"])) for c in range(WIDTH)], axis=1)
        return -float(weight @ logs), g

    def fit(self, rows: np.ndarray, seen: np.ndarray, goals: np.ndarray, scored: np.ndarray, steps: int = STEPS, seed: int = 11, most: float = RATE) -> list[float]:
        """Adam steps on batches of windows in random order; all windows come once before any comes again."""
        r = np.random.Generator(np.random.PCG64(seed))
        m, s, losses = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, []
        order = np.concatenate([r.permutation(len(rows)) for _ in range(-(-steps * BATCH // len(rows)))]) if len(rows) and steps else np.zeros(0, np.int64)
        for t in range(1, steps + 1 if len(rows) else 1):
            i = order[(t - 1) * BATCH : t * BATCH]
            loss, g = self.gradients(rows[i], seen[i], goals[i], scored[i])
            rate = most * min(1, t / 20) * (1 - t / (steps + 1))
            for k, x in g.items():
                x = x.astype(np.float32)
                m[k] *= np.float32(0.9)
                m[k] += np.float32(0.1) * x
                x *= x
                x *= np.float32(0.01)
                s[k] *= np.float32(0.99)
                s[k] += x
                np.multiply(s[k], np.float32(1 / (1 - 0.99**t)), out=x)
                np.sqrt(x, out=x)
                x += np.float32(1e-7)
                np.divide(m[k], x, out=x)
                x *= np.float32(rate / (1 - 0.9**t))
                self.p[k] -= x
            losses.append(loss)
        return losses

    def windows(self, lengths: np.ndarray, ids: np.ndarray, end: int) -> tuple[np.ndarray, ...]:
        """(text of each window, embedding rows, seen, goal ids, scored) of texts that are `lengths` ids long, end included.

        An id is predicted from those before it; the end id stands before the first.
        """
        text, at, seen, scored = self.places(lengths)
        padded = self.padded(lengths, ids, end)
        own = np.lib.stride_tricks.sliding_window_view(padded, WINDOW + 1)[at] if len(at) else np.zeros((0, WINDOW + 1), padded.dtype)
        return text, self.row[own[:, :-1]], seen, own[:, CONTEXT + 1 :], scored

    def padded(self, lengths: np.ndarray, values: np.ndarray, fill: int) -> np.ndarray:
        """The texts' values one after another, CONTEXT + 1 fills before each and after it what its last window lacks."""
        step = WINDOW - CONTEXT
        room = -(-lengths // step) * step + CONTEXT + 1
        out = np.full(int(room.sum()), fill, values.dtype)
        out[np.arange(len(values)) + np.repeat(np.cumsum(room) - room + CONTEXT + 1 - (np.cumsum(lengths) - lengths), lengths)] = values
        return out

    def places(self, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text of each window, its first place in padded(), seen, scored)."""
        step = WINDOW - CONTEXT
        per = -(-lengths // step)
        text = np.repeat(np.arange(len(lengths)), per)
        number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        at = np.arange(len(text)) * step + text * (CONTEXT + 1)
        seen = np.ones((len(text), WINDOW), np.float32)
        seen[number == 0, :CONTEXT] = 0
        return text, at, seen, np.arange(step) < (lengths[text] - number * step)[:, None]


# --- words and counts


def lowered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    view = memoryview(data)
    return [bytes(view[a:b]).lower() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def lowered_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: np.ndarray) -> pa.Array:
    """These words of a chunk as an Arrow column, taken from one of words and gaps by turns."""
    low = data | ((data >= 65) & (data <= 90)).astype(np.uint8) << 5
    bounds = np.empty(2 * len(starts) + 1, np.int32)
    bounds[:-1:2], bounds[1::2], bounds[-1] = starts, ends, len(data)
    return pa.Array.from_buffers(pa.binary(), 2 * len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(low)]).take(pa.array(2 * which))


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each different hash, rising; for each hash which of these it is), without a sort."""
    inverse = pa.array(hashes).dictionary_encode().indices.to_numpy()
    return np.flatnonzero(np.diff(np.maximum.accumulate(inverse), prepend=-1)), inverse


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): words of the texts and how often they come; combined in each batch and again by Spark before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = npwords.text_bytes(batch.column("text"))
            for i, j in npwords.chunks(offsets, 4 * npwords.CHUNK_BYTES):
                part = data[offsets[i] : offsets[j]]
                _, starts, ends = npwords.words(offsets[i : j + 1] - offsets[i], part)
                first, inverse = distinct(npwords.hashes(part, starts, ends))
                yield pa.record_batch([lowered_array(part, starts, ends, first), pa.array(np.bincount(inverse, minlength=len(first)))], names=["word", "n"])

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def subword_counts(words: DataFrame, subwords: Subwords) -> np.ndarray:
    """How often each id comes in all words counted; as many rows as the tokenizer has ids at most reach the driver."""

    shared = words.sparkSession.sparkContext.broadcast(subwords)  # its tables are made once in a process, not in each task

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = shared.value
        total = np.zeros(subwords.size)
        for batch in batches:
            firsts, ids = subwords.ids(batch.column("word").to_pylist())
            total += np.bincount(ids, np.repeat(batch.column("c").to_numpy(), np.diff(firsts)), subwords.size)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used].astype(np.int64))], names=["id", "n"])

    rows = words.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(subwords.size)
    counts[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return counts


def head_of(words: DataFrame, most: int) -> tuple[int, list[bytes], np.ndarray]:
    """(least count, words, counts) of the words that come at least as often as a power of two that leaves `most` of them."""
    sizes = words.groupBy(F.floor(F.log2("c")).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()  # a row for each power of two
    least, n = 64, 0
    for k, x in sorted(((r.k, r.n) for r in sizes), reverse=True):
        if n + x > most:
            break
        least, n = k, n + x
    if not n:
        return 1 << 62, [], np.zeros(0, np.int64)
    head = words.where(F.col("c") >= F.lit(2**least)).toArrow()
    return 2**least, head["word"].to_pylist(), head["c"].to_numpy()


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def sample_windows(texts: list[str], subwords: Subwords, model: Attention) -> tuple[np.ndarray, ...]:
    lengths, all_ids = [], [np.zeros(0, np.int64)]
    for t in texts:
        b = np.frombuffer(t.encode(), np.uint8)
        _, starts, ends = npwords.words(np.array([0, len(b)]), b)
        _, ids = subwords.ids(lowered(b, starts, ends))
        all_ids.append(np.append(ids, subwords.end))
        lengths.append(len(ids) + 1)
    _, rows, seen, goals, scored = model.windows(np.array(lengths, np.int64), np.concatenate(all_ids).astype(np.int64), subwords.end)
    return rows, seen, model.of_class[goals], scored.astype(np.float32)


# --- training on all documents


def chunk_ids(part: np.ndarray, offsets: np.ndarray, head: tuple) -> tuple:
    """Subword ids of a chunk of texts, each with the end after it, and what the base score needs of its words."""
    hashes, _, head_firsts, head_ids, subwords = head
    firsts, starts, ends = npwords.words(offsets, part)
    h = npwords.hashes(part, starts, ends)
    first, inverse = distinct(h)
    h = h[first]
    order, at = np.argsort(h), np.empty(len(h), np.int64)
    at[order] = np.minimum(np.searchsorted(hashes, h[order]), max(0, len(hashes) - 1))
    known = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
    rare = np.flatnonzero(~known)
    rare_words = lowered(part, starts[first[rare]], ends[first[rare]])
    rare_firsts, rare_ids = subwords.ids(rare_words)
    # one ragged table of this chunk's words
    lengths, ids = ragged(head_firsts, head_ids, at[known])
    table = np.concatenate([ids.astype(np.int64), rare_ids.astype(np.int64)])
    slot = np.empty(len(h), np.int64)
    slot[known], slot[rare] = np.arange(len(lengths)), len(lengths) + np.arange(len(rare))
    table_firsts = np.concatenate([[0], np.cumsum(np.concatenate([lengths, np.diff(rare_firsts)]))])
    slots = slot[inverse]
    n_ids = table_firsts[slots + 1] - table_firsts[slots]
    before = np.concatenate([[0], np.cumsum(n_ids)])[firsts]
    _, flat = ragged(table_firsts, table, slots)
    return firsts, inverse, at, known, rare, rare_words, np.diff(before) + 1, np.insert(flat, before[1:], subwords.end)


def cut(ids: np.ndarray, end: int, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray]]:
    """(number, windows, ids) of the pieces of a text; a piece's ids begin CONTEXT + 1 before the first that it predicts."""
    step, lead = WINDOW - CONTEXT, CONTEXT + 1
    padded = np.concatenate([np.full(lead, end, ids.dtype), ids])
    for k, a in enumerate(range(0, len(ids), step * most)):
        part = padded[a : a + lead + step * most]
        yield k, -(-(len(part) - lead) // step), part


def piece_windows(pieces: list[tuple[int, int, np.ndarray]], model: Attention) -> tuple[np.ndarray, ...]:
    """What fit() takes, of pieces; the same windows as of whole texts."""
    step, lead = WINDOW - CONTEXT, CONTEXT + 1
    per = np.array([n for _, n, _ in pieces], np.int64)
    sizes = np.array([len(x) for _, _, x in pieces], np.int64)
    ids = np.concatenate([x for _, _, x in pieces]).astype(np.int64)
    text = np.repeat(np.arange(len(per)), per)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    at, ends = (np.cumsum(sizes) - sizes)[text] + number * step, np.cumsum(sizes)[text]
    inputs, goals = at[:, None] + np.arange(WINDOW), at[:, None] + lead + np.arange(step)
    scored = goals < ends[:, None]
    seen = np.ones(inputs.shape, np.float32)
    opens = (number == 0) & (np.array([k for k, _, _ in pieces])[text] == 0)
    seen[opens, :CONTEXT] = 0
    last = ends[:, None] - 1
    return model.row[ids[np.minimum(inputs, last)]], seen, model.of_class[ids[np.minimum(goals, last)]], scored.astype(np.float32)


def pieces_of(ids: DataFrame, end: int, kind: type) -> DataFrame:
    """piece (whether it opens its text: 0), n (windows) and ids of the pieces of all training documents, whole."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(min(k, 1), n, x.tobytes()) for own in batch.column("ids") for k, n, x in cut(np.frombuffer(own.as_buffer(), kind), end)]
            yield pa.record_batch([pa.array([x[c] for x in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["piece", "n", "ids"])

    return ids.where("not held_out").select("ids").mapInArrow(pieces, "piece int, n int, ids binary")


def hold_memory() -> None:
    """glibc gives memory back as arrays end and gets it page by page again for the next, until it has seen a large one go."""
    np.empty(30 << 20, np.uint8)


def fitter(shared, kind: type, steps: int, most: float):
    """Of a shard: the weights after fitting, in UNIT and times its windows, and its windows under -1. shared: the broadcast model."""

    def fit(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("piece", "ascending"), ("ids", "ascending")])
        hold_memory()
        model = copy.copy(shared.value)
        model.p = {k: x.copy() for k, x in model.p.items()}
        rows, seen, goals, scored = piece_windows([(k, n, np.frombuffer(x, kind)) for k, n, x in zip(*(shard[c].to_pylist() for c in ("piece", "n", "ids")), strict=True)], model)
        scored *= np.repeat(shard["copies"].to_numpy(), shard["n"].to_numpy())[:, None].astype(np.float32)
        data, n = (rows, seen, goals, scored), len(rows)
        model.fit(*data, steps=max(steps, -(-n // BATCH)), most=most)
        flat = np.concatenate([model.p[k].ravel() for k in sorted(model.p)]).astype(float)
        added = np.concatenate([[n], np.rint(flat / UNIT).astype(np.int64) * n])
        return pa.table({"at": pa.array(np.arange(len(added)) - 1, pa.int64()), "sum": pa.array(added, pa.int64())})

    return fit


def fitted(pieces: DataFrame, model: Attention, kind: type, steps: int, shard_windows: int = SHARD) -> Attention:
    """The model fitted on all pieces. The driver gets one row a weight; sums of whole numbers don't depend on their order."""
    spark = pieces.sparkSession
    # equal pieces, of copies, are learnt once with their number as weight
    pieces = base.keep(pieces.groupBy("piece", "n", "ids").agg(F.count("*").alias("copies")), "pieces")
    n = pieces.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-n // shard_windows))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("piece", "ids"), F.lit(shards)))
    for where, least, most in (("shard = 0", steps, RATE), ("shard > 0", 0, LATER_RATE)):
        if n and (shards > 1 or where == "shard = 0"):
            shared = spark.sparkContext.broadcast(model)
            with base.conf(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):  # the pieces as dealt go as this ends
                sums = dealt.where(where).groupBy("shard").applyInArrow(fitter(shared, kind, least, most), "at long, sum long")
                # a shard's sums fit longs; those of all shards, which the input sizes, are kept in 38 digits
                sums = sums.groupBy("at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).toArrow().sort_by("at")["sum"].to_pylist()
            if sums:
                model, flat, used = copy.copy(model), np.array([float(x) for x in sums[1:]]) / float(sums[0]) * UNIT, 0
                p = {}
                for k in sorted(model.p):
                    x = model.p[k]
                    p[k], used = flat[used : used + x.size].reshape(x.shape).astype(np.float32), used + x.size
                model.p = p
    base.forget(pieces)
    return model


# --- scores


def reader(head, n_train: int, total: int, distinct: int, kind: type):
    """Per document: counts, base score without rare words, those words, and its ids with the end. head: broadcast tables."""
    divisor = math.log10(total + distinct + 1)
    end_score = math.log10(n_train + 1) - divisor

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, base_score, *_ = head.value
        for batch in batches:
            offsets, data = npwords.text_bytes(batch.column("text"))
            for i, j in npwords.chunks(offsets, npwords.CHUNK_BYTES // 2):
                firsts, inverse, at, known, rare, rare_words, n_ids, flat = chunk_ids(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], head.value)
                of_word = np.where(known, base_score[at] if len(hashes) else 0.0, 0.0)[inverse]
                sums, ends = np.concatenate([[0.0], np.cumsum(of_word)]), np.concatenate([[0], np.cumsum(n_ids)])
                place = np.full(len(known), -1)
                place[rare] = np.arange(len(rare))
                place = place[inverse]
                found = np.flatnonzero(place >= 0)
                bounds = np.searchsorted(found, firsts)
                flat = flat.astype(kind)
                part = batch.slice(i, j - i)
                yield pa.record_batch(
                    [
                        *(part.column(c) for c in ("doc_id", "rid", "held_out")),
                        pa.array(np.diff(firsts) + 1),
                        pa.array(np.diff(np.concatenate([[0], np.cumsum(known[inverse])])[firsts]) + (1 if n_train else 0)),
                        pa.array(np.diff(sums[firsts]) + end_score),
                        pa.array([[rare_words[x] for x in place[found[a:b]]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.list_(pa.binary())),
                        pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "rid", "held_out", "n_tokens", "n_known", "base_score", "rare", "ids"],
                )

    return read


def scorer(fit, end: int, kind: type):
    """Per document the model's score. fit: the broadcast model."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memory()
        model = fit.value
        tables = model.tables()
        for batch in batches:
            ids, out = batch.column("ids"), []
            sizes = pc.binary_length(ids).to_numpy() // kind().itemsize
            for i, j in npwords.chunks(np.concatenate([[0], np.cumsum(sizes)]), AT_ONCE):
                flat = np.frombuffer(b"".join(ids.slice(i, j - i).to_pylist()), kind).astype(np.int64)
                out.append(model_scores(model, tables, sizes[i:j], flat, end))
            names = ["doc_id", "rid", "held_out", "n_tokens", "n_known", "base_score"]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(np.concatenate([*out, np.zeros(0)]))], names=[*names, "score"])

    return score


def model_scores(model: Attention, tables: tuple, lengths: np.ndarray, ids: np.ndarray, end: int, at_once: int = 256) -> np.ndarray:
    text, at, seen, scored = model.places(lengths)
    logs = np.zeros(len(text))
    if len(text):
        padded = model.padded(lengths, ids, end)
        rows, classes, within = (np.lib.stride_tricks.sliding_window_view(t[padded], WINDOW + 1) for t in (model.row, model.of_class, model.within))
        for a in range(0, len(text), at_once):
            part = slice(a, a + at_once)
            own = at[part]
            found = model.log10(rows[own, :-1], seen[part], classes[own, CONTEXT + 1 :], tables) + within[own, CONTEXT + 1 :]
            logs[part] = (found * scored[part]).sum(axis=1, dtype=float)
    return np.bincount(text, logs, len(lengths))


def lm_scores(docs: DataFrame, tokenizer: str = TOKENIZER, head_words: int = HEAD_WORDS, steps: int = STEPS, shard_windows: int = SHARD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs.

    A text's tokens are its words, lower-cased (A-Z), and one end. A null or empty text has the end only. A
    null doc_id counts as an empty id text (which trains). Repeated rows count each. Without
    training documents all tokens are unknown and the model keeps its first weights. steps is the least
    number of steps on the first shard; small inputs are passed over more than once for it. An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = base.text_of()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), base.row_key(text).alias("rid"), held_out(F.col("doc_id")).alias("held_out"), text.alias("text"))
    train = docs.where("not held_out")
    words = base.keep(word_counts(train), "word_counts")
    n_train = train.count()
    sums = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = (sums.n or 0) + n_train, sums.v + (1 if n_train else 0)
    subwords = Subwords(Path(tokenizer).read_bytes())
    counts = subword_counts(words, subwords)
    counts[subwords.end] = n_train
    model = Attention(counts)
    least, head, head_counts = head_of(words, head_words)
    firsts, ids = subwords.ids(head)
    joined = np.frombuffer(b"".join(head), np.uint8)
    ends = np.cumsum([len(x) for x in head], dtype=np.int64)
    hashes = npwords.hashes(joined, ends - [len(x) for x in head], ends) if head else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    lengths, ids = ragged(firsts, ids, order)
    base_score = np.log10(head_counts[order] + 1.0) - math.log10(total + distinct + 1)
    tables = (hashes[order], base_score, np.concatenate([[0], np.cumsum(lengths)]), ids, subwords)
    shared = spark.sparkContext.broadcast(tables)  # at most head_words words and a tokenizer
    kind = np.uint16 if subwords.size <= 65536 else np.uint32
    schema = "doc_id long, rid long, held_out boolean, n_tokens long, n_known long, base_score double, rare array<binary>, ids binary"
    read = base.keep(docs.mapInArrow(reader(shared, n_train, total, distinct, kind), schema), "ids")
    fit = fitted(pieces_of(read, subwords.end, kind), model, kind, steps, shard_windows)
    schema = "doc_id long, rid long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = read.drop("rare").mapInArrow(scorer(spark.sparkContext.broadcast(fit), subwords.end, kind), schema)
    few = words.where(F.col("c") < F.lit(least)).select("word", "c")
    # one row a document (equal rows have equal words), and one for each of its rare words
    rare = read.select("rid", "rare").where(F.size("rare") > 0).dropDuplicates(["rid"]).select("rid", F.explode("rare").alias("word")).groupBy("rid", "word").agg(F.count("*").alias("n")).join(few, "word", "left")
    c = F.coalesce("c", F.lit(0))
    rest = rare.groupBy("rid").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * (F.log10(c + 1) - math.log10(total + distinct + 1))).alias("part"))
    df = scored.join(rest, "rid", "left")
    return df.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("part", F.lit(0.0))).alias("base_score"), "score"
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(base.documents(spark, sf_dir))

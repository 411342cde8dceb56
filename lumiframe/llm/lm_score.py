"""Language-model scoring: a causal self-attention model over subword ids, trained and run in numpy.

The tokens of a text are its words (A-Z lower-cased) and one end; a word is spelled by its subwords (of a public
tokenizer, never trained here). The model predicts the next subword: its group (runs of subwords in order of frequency, short where
they are frequent), then the subword within the group, both by a softmax over what attention finds in the context. A
subword that the training texts don't hold shares the place of one that is kept for all of these, and every probability
is mixed with a little of an even one. So the probabilities of all ids sum to 1, and a text's score is the product of its
subwords' probabilities by the chain rule; nothing else enters it.

Each text is cut into windows of WINDOW subwords of which the last STRIDE are scored, the ones before are context: every
token is scored once.

Training takes every subword of every training text once (of a small corpus several times). A hash deals the texts to ROUNDS
rounds; in each of them every task trains on its texts of that round from the same start, and the results are averaged by the
number of windows: neither texts nor gradients meet in one place."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiframe.llm import words as W
from lumiframe.llm.storage import Scratch

WINDOW, STRIDE, WIDTH, INNER = 24, 20, 32, 64
#: The weights are fitted on all training texts once, on those of a small corpus more often, so that LEAST subwords are
#: seen, but none more than EPOCHS times.
LEAST, EPOCHS = 3_000_000, 8
#: Places on the circle by which texts are dealt to the rounds.
PLACES = 1 << 30
ROUNDS, BATCH, RATE = 4, 96, 0.01
#: For each so many subwords of the training texts a batch has BATCH windows, but no more than MOST times BATCH; the rate grows by
#: the power 0.8 of that. A window costs a quarter less in a large batch, and a large corpus has steps enough.
STEADY, MOST = 12_000_000, 4
#: Runs of at most so many rows are summed all at once, a place after the other; longer ones each by a product with ones.
SHORT = 8
#: Weight of the even distribution over all ids.
EVEN = 1e-4
#: Values of a parameter vector that travel as one row.
CHUNK = 1 << 16
#: Words whose counts are sent to the executors, at most; the counts of all others come by a join.
COMMON = 1 << 19
#: Words whose subwords a worker remembers, at most.
REMEMBERED = 600_000
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


class Subwords:
    """Subword ids of words, remembered per process; id `size` is the end."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.own.get_piece_size()
        self.forget()

    def forget(self) -> None:
        #: (sorted word hashes, start and number of their ids in flat); a level is at least twice the next one.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.flat = np.zeros(0, dtype=np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cuts, ids) of words; a word without any subword is the unknown one."""
        found = [x or [0] for x in self.own.encode(texts, num_threads=1)]
        return np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64), np.array([i for x in found for i in x], dtype=np.int32)

    def of(self, words: W.Words, unique: np.ndarray, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, number, ids): where the subwords of each unique word lie in ids. sample: a place of each in words."""
        if sum(len(k) for k, _, _ in self.levels) + len(unique) > REMEMBERED:
            self.forget()
        start, number = np.zeros(len(unique), dtype=np.int64), np.zeros(len(unique), dtype=np.int64)
        for keys, first, size in self.levels:
            at = np.minimum(np.searchsorted(keys, unique), len(keys) - 1)
            has = keys[at] == unique
            start[has], number[has] = first[at[has]], size[at[has]]
        new = np.flatnonzero(number == 0)
        if len(new):
            cuts, ids = self.encode([words.text(i).lower().decode("utf-8", "replace") for i in sample[new]])
            start[new], number[new] = len(self.flat) + cuts[:-1], np.diff(cuts)
            self.flat = np.concatenate([self.flat, ids])
            level = unique[new], start[new], number[new]
            while self.levels and len(self.levels[-1][0]) < 2 * len(level[0]):
                level = tuple(np.concatenate(x) for x in zip(self.levels.pop(), level, strict=True))
                order = np.argsort(level[0])
                level = tuple(x[order] for x in level)
            self.levels.append(level)
        return start, number, self.flat


def _exponentials(h: np.ndarray, w: np.ndarray, b: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exponentials of the logits h @ w + b, their sum in each row, each row's own logit). In rows whose sum leaves the range of
    float32, all three are of the logits less the largest; a largest logit of each row would take longer than the rest."""
    z = h @ w
    z += b
    mine = z[np.arange(len(z)), own]
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
        total = z @ np.ones(z.shape[1], z.dtype)
    far = np.flatnonzero(~((total > 1e-25) & (total < 1e25)))
    if len(far):
        some = h[far] @ w + b
        most = some.max(axis=1)
        z[far] = np.exp(some - most[:, None])
        total[far] = z[far].sum(axis=1)
        mine[far] = some[np.arange(len(far)), own[far]] - most
    return z, total, mine


def _run_sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of each run of rows; a run goes from one of starts to the next. np.add.reduceat takes more than twice as long."""
    size = np.diff(starts, append=len(rows))
    out, ones = rows[starts], np.ones(size.max(), rows.dtype)
    for at in range(1, SHORT):
        more = np.flatnonzero((size > at) & (size <= SHORT))
        out[more] += rows[starts[more] + at]
    for i in np.flatnonzero(size > SHORT):
        out[i] = ones[: size[i]] @ rows[starts[i] : starts[i] + size[i]]
    return out


class AttentionModel:
    """One causal attention layer with weights by distance, one hidden layer, two softmaxes; parameters are float32 arrays."""

    def __init__(self, counts: np.ndarray, seed: int = 3):
        """counts: of each subword id in the training documents, the last being the end."""
        rng, n = np.random.default_rng(seed), len(counts)
        order = np.lexsort((np.arange(n), -counts))
        used = order[counts[order] > 0]
        self.kinds = len(used) + 1
        #: integers of 16 bits, which most vocabularies fit in, are sorted in linear time
        self.narrow = np.min_scalar_type(self.kinds)
        #: place of an id among the kinds; the last kind stands for all ids without a count
        self.index = np.full(n, self.kinds - 1, dtype=np.int32)
        self.index[used] = np.arange(len(used))
        self.ids, self.unseen = n, n - len(used)
        mass = np.append(counts[used], 0.5).astype(np.float64)
        mass /= mass.sum()
        # a group ends once its size times its share reaches 1: then more or fewer groups would cost more multiplications
        starts, held = [0], 0.0
        for i, x in enumerate(mass):
            held += x
            if (i + 1 - starts[-1]) * held >= 1 and i + 1 < self.kinds:
                starts.append(i + 1)
                held = 0.0
        #: the first kind of each group, and the number of kinds
        self.starts = np.array([*starts, self.kinds])
        self.groups = len(starts)
        self.group = np.repeat(np.arange(self.groups), np.diff(self.starts))
        share = np.add.reduceat(mass, self.starts[:-1])
        d, h = WIDTH, WIDTH + INNER
        normal = lambda *shape, scale=WIDTH**-0.5: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "E": normal(self.kinds, d), "r": np.linspace(1, -1, WINDOW, dtype=np.float32), "q": normal(d, d), "k": normal(d, d), "v": normal(d, d), "m": normal(d, INNER),
            "g": normal(h, self.groups, scale=0.05), "bg": np.log(share).astype(np.float32), "o": normal(self.kinds, h, scale=0.05), "bo": np.log(mass / share[self.group]).astype(np.float32),
        }
        place = np.arange(WINDOW)
        self.mask, self.distance = np.tril(np.ones((WINDOW, WINDOW), dtype=np.float32)), np.abs(place[:, None] - place[None, :])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}

    def vector(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def set_vector(self, v: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            size = self.p[k].size
            self.p[k] = v[at : at + size].astype(np.float32).reshape(self.p[k].shape)
            at += size
        self.__dict__.pop("_tables", None)

    def _hidden(self, context: np.ndarray, low: int) -> np.ndarray:
        """What the model makes of each place from `low` on of windows of kinds: (windows * places, WIDTH + INNER)."""
        p = self.p
        if not hasattr(self, "_tables"):
            self._tables = (p["E"] @ p["q"]) * np.float32(WIDTH**-0.5), p["E"] @ p["k"], p["E"] @ p["v"], np.exp(p["r"][self.distance]) * self.mask
        query, key, value, near = self._tables
        late = context[:, low:]
        e = np.matmul(np.take(query, late, axis=0), np.take(key, context, axis=0).transpose(0, 2, 1))
        np.clip(e, -20, 20, out=e)
        np.exp(e, out=e)
        e *= near[low:]
        a = np.matmul(e, np.take(value, context, axis=0))
        # sums over short rows are products with ones, which is several times as fast as sum()
        a /= (e.reshape(-1, WINDOW) @ np.ones(WINDOW, e.dtype)).reshape(*e.shape[:2], 1)
        a += np.take(p["E"], late, axis=0)
        h = np.empty((a.shape[0] * a.shape[1], WIDTH + INNER), dtype=a.dtype)
        h[:, :WIDTH] = a.reshape(-1, WIDTH)
        np.maximum(h[:, :WIDTH] @ p["m"], 0, out=h[:, WIDTH:])
        return h

    def score(self, context: np.ndarray, low: int, targets: np.ndarray) -> np.ndarray:
        """Natural log probabilities. context: (windows, WINDOW) kinds; targets: (windows, places from low on) kinds."""
        h, p, kinds = self._hidden(context, low), self.p, targets.ravel()
        # in the order of the targets, so that each group's rows are a slice
        order = np.argsort(kinds.astype(self.narrow), kind="stable")
        h, sorted_kinds = np.take(h, order, axis=0), kinds[order]
        group = self.group[sorted_kinds]
        _, total, cost = _exponentials(h, p["g"], p["bg"], group)
        cost -= np.log(total)
        cuts = np.searchsorted(sorted_kinds, self.starts)
        for i in np.flatnonzero(np.diff(cuts)):
            lo, hi, a, b = cuts[i], cuts[i + 1], self.starts[i], self.starts[i + 1]
            _, total, own = _exponentials(h[lo:hi], p["o"][a:b].T, p["bo"][a:b], sorted_kinds[lo:hi] - a)
            cost[lo:hi] += own - np.log(total)
        out = np.empty_like(cost)
        out[order] = cost
        share = np.exp(out)
        if self.unseen > 1:
            share[kinds == self.kinds - 1] /= self.unseen
        return np.log(share * (1 - EVEN) + EVEN / self.ids).reshape(targets.shape)

    def gradients(self, ids: np.ndarray) -> tuple[float, dict]:
        """Mean loss (before the even share) and its gradients over windows of WINDOW + 1 kinds; all places count."""
        p, s, d = self.p, np.float32(WIDTH**-0.5), WIDTH
        context, targets = ids[:, :-1], ids[:, 1:].ravel()
        n = len(targets)
        # what depends on a place's kind alone is worked out once for each kind that the batch holds
        turned = np.argsort(context.ravel().astype(self.narrow), kind="stable")
        met = context.ravel()[turned]
        starts = np.concatenate([[True], met[1:] != met[:-1]])
        place, met, starts = np.cumsum(starts) - 1, met[starts], np.flatnonzero(starts)
        place[turned] = place.copy()
        qkv = np.concatenate([p["q"] * s, p["k"], p["v"]], axis=1)
        table = p["E"][met]
        own = np.take(np.concatenate([table @ qkv, table], axis=1), place, axis=0)
        x, own = own[:, 3 * d :], own.reshape(*context.shape, 4 * d)
        q, k, v = own[..., :d], own[..., d : 2 * d], own[..., 2 * d : 3 * d]
        w = np.matmul(q, k.transpose(0, 2, 1))
        np.clip(w, -20, 20, out=w)
        np.exp(w, out=w)
        w *= np.exp(p["r"][self.distance]) * self.mask
        w /= (w.reshape(n, WINDOW) @ np.ones(WINDOW, w.dtype)).reshape(*context.shape, 1)
        flat = np.matmul(w, v).reshape(n, d)
        flat += x
        # in the order of the targets, so that each group's rows are a slice
        order = np.argsort(targets.astype(self.narrow), kind="stable")
        kinds = targets[order]
        h = np.empty((n, d + INNER), dtype=flat.dtype)
        np.take(flat, order, axis=0, out=h[:, :d])
        up = np.maximum(h[:, :d] @ p["m"], 0, out=h[:, d:])

        def softmax(h: np.ndarray, w: np.ndarray, b: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(loss of the own entries, its gradient by the logits)."""
            z, total, mine = _exponentials(h, w, b, own)
            z *= (1 / (total * n))[:, None]
            z[np.arange(len(z)), own] -= z.dtype.type(1 / n)
            return np.log(total) - mine, z

        loss, z = softmax(h, p["g"], p["bg"], self.group[kinds])
        g = {"g": h.T @ z, "bg": np.ones(n, z.dtype) @ z, "o": np.zeros_like(p["o"]), "bo": np.zeros_like(p["bo"])}
        dh = z @ p["g"].T
        cuts = np.searchsorted(kinds, self.starts)
        for i in np.flatnonzero(np.diff(cuts)):
            rows, a, b = slice(cuts[i], cuts[i + 1]), self.starts[i], self.starts[i + 1]
            cost, z = softmax(h[rows], p["o"][a:b].T, p["bo"][a:b], kinds[rows] - a)
            loss[rows] += cost
            g["o"][a:b], g["bo"][a:b] = z.T @ h[rows], np.ones(len(z), z.dtype) @ z
            dh[rows] += z @ p["o"][a:b]
        dup = dh[:, d:]
        dup *= up > 0
        g["m"] = h[:, :d].T @ dup
        dh[:, :d] += dup @ p["m"].T
        down = np.empty_like(own)
        dx = down.reshape(n, 4 * d)[:, 3 * d :]
        dx[order] = dh[:, :d]
        dy = down[..., 3 * d :]
        np.matmul(w.transpose(0, 2, 1), dy, out=down[..., 2 * d : 3 * d])
        de = np.matmul(dy, v.transpose(0, 2, 1))
        # the sum of weights times their gradients is what was attended times its gradient
        de -= np.einsum("ij,ij->i", flat - x, dx).reshape(*context.shape, 1)
        de *= w
        g["r"] = np.bincount(self.distance.ravel(), (de.sum(axis=0) * self.mask).ravel(), minlength=WINDOW).astype(de.dtype)
        np.matmul(de, k, out=down[..., :d])
        np.matmul(de.transpose(0, 2, 1), q, out=down[..., d : 2 * d])
        by_kind = _run_sums(np.take(down.reshape(n, 4 * d), turned, axis=0), starts)
        dqkv = table.T @ by_kind[:, : 3 * d]
        g["q"], g["k"], g["v"] = dqkv[:, :d] * s, dqkv[:, d : 2 * d], dqkv[:, 2 * d :]
        g["E"] = np.zeros_like(p["E"])
        g["E"][met] = by_kind[:, 3 * d :] + by_kind[:, : 3 * d] @ qkv.T
        return float(loss.mean()), g

    def fit(self, batches: Iterator[np.ndarray], rate: float = RATE) -> list[float]:
        """Adam over batches of windows of WINDOW + 1 kinds, with a rising rate at first."""
        one, two = (np.zeros(sum(v.size for v in self.p.values()), dtype=np.float32) for _ in range(2))
        whole, cuts = self.vector(), np.cumsum([0, *(self.p[k].size for k in sorted(self.p))])
        # the parameters are views of one vector, which is worked on in parts that stay in the processor's cache
        self.p = {k: whole[a:b].reshape(self.p[k].shape) for k, a, b in zip(sorted(self.p), cuts, cuts[1:])}
        losses = []
        for step, ids in enumerate(batches, 1):
            loss, found = self.gradients(ids)
            losses.append(loss)
            lr = rate * min(1.0, step / 30)
            scale, root = np.float32(lr / (1 - 0.9**step)), np.float32((1 - 0.99**step) ** -0.5)
            change = np.concatenate([found[k].ravel() for k in sorted(found)])
            for at in range(0, len(whole), 1 << 14):
                part = slice(at, at + (1 << 14))
                g, m, v = change[part], one[part], two[part]
                z = g - m
                z *= np.float32(0.1)
                m += z
                np.multiply(g, g, out=z)
                z -= v
                z *= np.float32(0.01)
                v += z
                np.sqrt(v, out=z)
                z *= root
                z += np.float32(1e-8)
                np.divide(m, z, out=z)
                z *= scale
                whole[part] -= z
        self.__dict__.pop("_tables", None)
        return losses

    def logs(self, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of every subword; text d is flat[first[d]:first[d + 1]], the end being the last of them."""
        kinds, end = self.index[flat], self.index[-1]
        out = np.full(len(flat), np.nan, dtype=np.float32)
        lengths = np.diff(first)
        # text d as the model reads it: the end, then its subwords but the last
        windows = np.where(lengths > WINDOW, 1 + -(-(lengths - WINDOW) // STRIDE), 1)
        doc = np.repeat(np.arange(len(lengths)), windows)
        turn = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
        begin = np.minimum(turn * STRIDE, np.maximum(lengths[doc] - WINDOW, 0))
        done = np.where(turn == 0, 0, (turn - 1) * STRIDE + WINDOW)
        # the input of a place is the token before it; what a window holds after its text's end is never looked back at
        shifted = np.zeros(len(flat) + WINDOW, dtype=np.int32)
        shifted[1 : len(flat) + 1] = kinds
        shifted[first[:-1]] = end
        contexts = np.lib.stride_tricks.sliding_window_view(shifted, WINDOW)
        targets = np.lib.stride_tricks.sliding_window_view(np.append(kinds, np.zeros(WINDOW, dtype=np.int32)), WINDOW)
        place = first[doc] + begin
        low, high = (done - begin).astype(np.int32), np.minimum(lengths[doc] - begin, WINDOW).astype(np.int32)
        for chosen, at in ((np.flatnonzero(turn == 0), 0), (np.flatnonzero(turn > 0), WINDOW - STRIDE)):
            places = np.arange(at, WINDOW, dtype=np.int32)
            for k in range(0, len(chosen), 512):  # few enough to stay in the processor's cache
                w = chosen[k : k + 512]
                logs = self.score(contexts[place[w]], at, targets[place[w]][:, at:])
                inside = (places >= low[w][:, None]) & (places < high[w][:, None])
                out[(place[w][:, None] + places)[inside]] = logs[inside]
        return out / np.float32(np.log(10))


def _windows(texts: Iterator[pa.Array], model: AttentionModel, sub: Subwords, times: float, rng: np.random.Generator, batch: int = BATCH) -> Iterator[np.ndarray]:
    """Batches of windows of WINDOW + 1 kinds from texts parted by the end; each window comes `times` times on average."""
    end, rest, ready = model.index[-1:], model.index[-1:], np.zeros((0, WINDOW + 1), dtype=np.int32)
    for column in texts:
        for _, words in W.slices(column):
            stream = np.concatenate([rest, model.index[_stream(words, sub)[0]]])
            n = (len(stream) - 1) // WINDOW
            rest = stream[n * WINDOW :] if n else stream
            if n:
                rows = np.lib.stride_tricks.sliding_window_view(stream[: n * WINDOW + 1], WINDOW + 1)[::WINDOW]
                ready = np.concatenate([ready, np.repeat(rows, np.floor(times + rng.random(n)).astype(np.int64), axis=0)])
            if len(ready) >= 32 * batch:
                ready = rng.permutation(ready)
                while len(ready) >= 16 * batch:
                    yield ready[:batch]
                    ready = ready[batch:]
    if len(rest) > 1:
        padded = np.concatenate([rest, np.repeat(end, WINDOW)])[: WINDOW + 1]
        ready = np.concatenate([ready, np.repeat(padded[None], int(times + rng.random()), axis=0)])
    ready = rng.permutation(ready)
    for at in range(0, len(ready), batch):
        yield ready[at : at + batch]


def _train(learned: DataFrame, model: AttentionModel, sent_model, subwords: float) -> int:
    """Fits the model on all learned (text, h: hash of the row from 0 to PLACES - 1) in rounds of averaged local training.
    Returns the number of windows it was fitted on."""
    spark, total, fitted = learned.sparkSession, min(EPOCHS, max(1.0, LEAST / max(subwords, 1.0))), 0
    # arcs of at least 1 / ROUNDS of the circle, one after the other: together they hold every place
    share = min(PLACES, math.ceil(total / ROUNDS * PLACES))
    larger = int(min(MOST, max(1, subwords // STEADY)))
    for turn in range(ROUNDS):
        low = turn * share % PLACES
        sent = spark.sparkContext.broadcast(pickle.dumps(model))
        rate = RATE * larger**0.8 * (1 - 0.85 * turn / (ROUNDS - 1))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn, rate=rate) -> Iterator[pa.RecordBatch]:
            own, sub = pickle.loads(sent.value), _subwords(sent_model)
            rng, seen = np.random.default_rng([turn, TaskContext.get().partitionId()]), 0

            def counted() -> Iterator[np.ndarray]:
                nonlocal seen
                for ids in _windows((b.column(0) for b in batches), own, sub, max(1.0, total / ROUNDS), rng, larger * BATCH):
                    seen += len(ids)
                    yield ids

            own.fit(counted(), rate)
            if seen:
                v = own.vector() * np.float32(1.0)
                parts = range(0, len(v), CHUNK)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([at // CHUNK for at in parts], pa.int32()), "n": pa.array([seen] * len(parts), pa.int64()), "v": pa.array([v[at : at + CHUNK].tobytes() for at in parts], pa.binary())})

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for chunk, n, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    now = sums.setdefault(chunk, [0, 0.0])
                    now[0] += n
                    now[1] = now[1] + n * np.frombuffer(v, dtype=np.float32).astype(np.float64)
            for chunk, (n, v) in sums.items():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "n": pa.array([n], pa.int64()), "v": pa.array([(v / n).astype(np.float32).tobytes()], pa.binary())})

        part = learned.filter(F.pmod(F.col("h") - low, F.lit(PLACES)) < share).select("text")
        kind = "chunk int, n bigint, v binary"
        found = part.mapInArrow(run, kind).repartition("chunk").mapInArrow(mean, kind).collect()
        if found:
            model.set_vector(np.concatenate([np.frombuffer(r["v"], dtype=np.float32) for r in sorted(found, key=lambda r: r["chunk"])]))
            if not np.isfinite(model.vector()).all():
                raise ArithmeticError(f"round {turn} of the training left weights that aren't finite")
            fitted += found[0]["n"]
        sent.destroy()
    return fitted


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word hash, one spelling, count) of a task's training texts, merged within the task up to a bounded number."""
    keys, counts, spelled = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)

    def out():
        for at in range(0, len(keys), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_pydict({"h": pa.array(keys[part].view(np.int64)), "w": pa.array(spelled[part].tolist(), pa.binary()), "c": pa.array(counts[part])})

    for batch in batches:
        for _, words in W.slices(batch.column(0)):
            u, first, n = np.unique(words.hash, return_index=True, return_counts=True)
            at = np.minimum(np.searchsorted(keys, u), max(len(keys) - 1, 0))
            old = keys[at] == u if len(keys) else np.zeros(len(u), bool)
            counts[at[old]] += n[old]
            new = np.flatnonzero(~old)
            if len(new):
                texts = np.empty(len(new), dtype=object)
                texts[:] = [words.text(i) for i in first[new]]
                place = np.searchsorted(keys, u[new])
                keys, counts, spelled = np.insert(keys, place, u[new]), np.insert(counts, place, n[new]), np.insert(spelled, place, texts)
            if len(keys) > REMEMBERED:
                yield from out()
                keys, counts, spelled = keys[:0], counts[:0], spelled[:0]
    yield from out()


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, common: int = COMMON, scratch: Scratch | None = None) -> DataFrame:
    """docs without text_col and with n_tokens, n_known, train_tokens, base_score, score, n_subwords (input columns of these
    names are replaced; any other name may be used). train (a null counts as false) says which rows are learned from.

    Tokens are lower-cased (A-Z) words and one end a text; null is empty. base_score: sum of
    log10((c + 0.1) / (N + 0.1 (V + 1))), c a token's count, N the number and V the distinct tokens in training rows;
    n_known: tokens with c > 0. score: the attention model's log10 probability of the text. Rows of one id are scored
    each by itself. Words are counted under 64-bit hashes. The counts of at most `common` words of the highest counts go to
    the executors; a text's other words meet their counts by a join, so the result is the same whatever `common` is."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lm")
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "n_subwords"]
    carried = [c for c in docs.columns if c not in (*new, text_col)]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("kept"), F.col(f"`{text_col}`").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    learned = base.filter("train")
    counted = learned.select("text").mapInArrow(_count_words, "h bigint, w binary, c bigint")
    counts = scratch.save(counted.groupBy("h").agg(F.sum("c").alias("c"), F.min("w").alias("w")), "counts")
    ends = learned.count()
    words_n, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, kinds = words_n + ends, distinct + (1 if ends else 0)
    floor = total + 0.1 * (kinds + 1)

    rows = spark.read.format("binaryFile").load(vocabulary).select("content").first() if "://" in vocabulary else None
    model_bytes = bytes(rows[0]) if rows else open(vocabulary, "rb").read()
    sent_model = spark.sparkContext.broadcast(model_bytes)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = _subwords(sent_model)
        totals = np.zeros(sub.size, dtype=np.int64)
        for batch in batches:
            texts = [w.lower().decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            if texts:
                cuts, ids = sub.encode(texts)
                totals += np.bincount(ids, np.repeat(batch.column(1).to_numpy(), np.diff(cuts)), minlength=sub.size).astype(np.int64)
        held = np.flatnonzero(totals)
        yield pa.RecordBatch.from_pydict({"i": pa.array(held), "c": pa.array(totals[held])})

    pieces = counts.select("w", "c").mapInArrow(spell, "i bigint, c bigint").groupBy("i").agg(F.sum("c").alias("c")).collect()
    shares = np.zeros(Subwords(model_bytes).size + 1)
    for r in pieces:
        shares[r["i"]] = r["c"]
    shares[-1] = max(ends, 1)
    model = AttentionModel(shares)
    place = F.pmod(F.xxhash64(F.col("kept")[id_col], F.col("text"), F.lit(1)), F.lit(PLACES)).cast("bigint").alias("h")
    _train(learned.select("text", place), model, sent_model, float(shares.sum()))
    sent = spark.sparkContext.broadcast(pickle.dumps(model))

    band = F.floor(F.log2("c") * 8)  # at most 512 values
    steps = counts.groupBy(band.alias("b")).count().orderBy(F.desc("b")).collect()
    least, held = 512, 0
    for r in steps:
        if held + r["count"] > common:
            break
        least, held = r["b"], held + r["count"]
    top = counts.filter(band >= least).select("h", "c").toArrow()
    top_h = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(top_h)
    sent_top = spark.sparkContext.broadcast((top_h[order], top.column("c").to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sub = pickle.loads(sent.value), _subwords(sent_model)
        keys, known = sent_top.value
        for batch in batches:
            for at, words in W.slices(batch.column(1)):
                n = words.docs
                flat, first, _ = _stream(words, sub)
                score = np.add.reduceat(own.logs(flat, first).astype(np.float64), first[:-1])
                where = np.minimum(np.searchsorted(keys, words.hash), max(len(keys) - 1, 0))
                has = keys[where] == words.hash if len(keys) else np.zeros(len(words.hash), bool)
                c = known[where[has]] if len(keys) else np.zeros(0)
                sums = np.bincount(words.doc[has], np.log10((c + 0.1) / floor), minlength=n) + np.log10((ends + 0.1) / floor)
                rare_doc, rare = words.doc[~has], words.hash[~has]
                cuts = np.concatenate([[0], np.cumsum(np.bincount(rare_doc, minlength=n))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, n),
                        pa.array((np.diff(words.first) + 1).astype(np.int64)),
                        pa.array(np.bincount(words.doc[has], minlength=n) + (1 if ends else 0)),
                        pa.array(sums),
                        pa.array(score),
                        pa.array(np.diff(first).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(rare.view(np.int64))),
                    ],
                    names=["kept", "n_tokens", "n_known", "base_score", "score", "n_subwords", "rare"],
                )

    kept = base.schema["kept"].dataType.simpleString()
    scored = base.select("kept", "text").mapInArrow(run, f"kept {kept}, n_tokens bigint, n_known bigint, base_score double, score double, n_subwords bigint, rare array<bigint>")
    scored = scratch.save(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    for b in (sent, sent_top, sent_model):
        b.destroy()
    rare = scored.select("row", F.explode("rare").alias("h"))
    share = (F.coalesce("c", F.lit(0)) + 0.1) / F.lit(floor)
    found = rare.join(counts.select("h", "c"), "h", "left").groupBy("row").agg(F.count("c").alias("k"), F.sum(F.log10(share)).alias("s"))
    out = scored.join(found, "row", "left")
    return out.select(
        *[F.col("kept")[c].alias(c) for c in carried], "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"), (F.col("base_score") + F.coalesce("s", F.lit(0.0))).alias("base_score"), "score", "n_subwords"
    )


_own: dict[int, Subwords] = {}


def _subwords(sent) -> Subwords:
    """One per process; a worker keeps it from task to task."""
    data = sent.value
    key = hash(data)
    if key not in _own:
        _own.clear()
        _own[key] = Subwords(data)
    return _own[key]


def _stream(words: W.Words, sub: Subwords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(subwords of all texts, each followed by the end; first of each text; subwords of each word)."""
    unique, sample, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    start, number, ids = sub.of(words, unique, sample)
    per_word = number[inverse]
    per_text = np.bincount(words.doc, per_word, minlength=words.docs).astype(np.int64) + 1
    first = np.concatenate([[0], np.cumsum(per_text)])
    flat = np.full(first[-1], sub.size, dtype=np.int32)
    total = int(per_word.sum())
    inner = np.arange(total) - np.repeat(np.cumsum(per_word) - per_word, per_word)
    # a word's subwords come after those before it and one end for each text before
    flat[np.arange(total) + np.repeat(words.doc, per_word)] = ids[np.repeat(start[inverse], per_word) + inner]
    return flat, first, per_word

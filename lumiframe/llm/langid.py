"""Language identification by interpolated Kneser-Ney character language models.

One model per label is fitted on a bounded sample of labelled texts. Texts are lower-cased; a run of characters other
than letters is one space; letters beyond the alphabet share one symbol. N-grams of all labels lie in sorted arrays of
64-bit keys, with one row of log probabilities (a column per label), so scoring is a binary search. A text goes to
the label of least cross-entropy per symbol. It is rejected if that exceeds what held-back sample texts of its length
reach: the limit is calibrated on every eighth text of the sample."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumiframe.llm.sampling import below, bounded_sample, fit_on, place, threshold
from lumiframe.llm.storage import small_batches

ORDER = 4
#: Characters of text that are worked on at once.
SLICE = 1 << 20
_EDGE, _SPACE, _OTHER, _FIRST = 255, 0, 1, 2


def _points(texts: list[str]) -> np.ndarray:
    joined = "\0" * (ORDER - 1) + ("\0" * (ORDER - 1)).join(t.replace("\0", " ") for t in texts)
    return np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Alphabet:
    """Letters with a symbol of their own: the most frequent 250 of the sample."""

    def __init__(self, letters: str):
        self.letters = letters

    def table(self) -> np.ndarray:
        if not hasattr(self, "_table"):
            out = np.zeros(0x110000, dtype=np.uint8)
            out[[i for i in range(0x110000) if chr(i).isalpha()]] = _OTHER
            for k, c in enumerate(self.letters):
                out[ord(c)] = _FIRST + k
            out[0] = _EDGE
            self._table = out
        return self._table

    def __getstate__(self):
        return {"letters": self.letters}

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, text of each) with ORDER - 1 edges before every text; spaces come singly and never after an edge."""
        sym = self.table()[_points(texts)]
        edge = sym == _EDGE
        doc = (np.cumsum(edge) - 1) // (ORDER - 1)
        gap = edge | (sym == _SPACE)
        keep = edge | ~gap
        keep[1:] |= gap[1:] & ~gap[:-1]
        return sym[keep], doc[keep]


def grams(sym: np.ndarray, order: int) -> np.ndarray:
    """Keys of the n-grams that end at each symbol from ORDER - 1 on; edges count as spaces."""
    s = np.where(sym == _EDGE, _SPACE, sym).astype(np.uint64)
    n = len(s) - (ORDER - 1)
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(order):
        back = order - 1 - j
        out = (out << np.uint64(8)) | s[ORDER - 1 - back : ORDER - 1 - back + n]
    return out


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), dtype=bool)


class _Counts:
    """Kneser-Ney counts of one label: raw at the highest order, numbers of different left neighbours below."""

    def __init__(self, sym: np.ndarray):
        real = sym[ORDER - 1 :] != _EDGE
        top, n = np.unique(grams(sym, ORDER)[real], return_counts=True)
        self.gram, self.discount, self.context = {ORDER: (top, n.astype(np.float64))}, {}, {}
        for o in range(ORDER - 1, 0, -1):
            low = self.gram[o + 1][0] & np.uint64((1 << (8 * o)) - 1)
            keys, left = np.unique(low, return_counts=True)
            self.gram[o] = (keys, left.astype(np.float64))
        for o in range(1, ORDER + 1):
            keys, c = self.gram[o]
            once, twice = (c == 1).sum(), (c == 2).sum()
            d = once / (once + 2 * twice) if once else 0.5
            self.discount[o] = min(max(d, 0.05), 0.95)
            ctx, where = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(where, c), np.bincount(where)
            self.context[o] = (ctx, total, self.discount[o] * kinds / total)

    def prob(self, keys: np.ndarray, o: int, symbols: int) -> np.ndarray:
        if o == 0:
            return np.full(len(keys), 1.0 / symbols)
        lower = self.prob(keys & np.uint64((1 << (8 * (o - 1))) - 1), o - 1, symbols)
        at, has = _lookup(self.gram[o][0], keys)
        ctx, seen = _lookup(self.context[o][0], keys >> np.uint64(8))
        c = np.where(has, np.maximum(self.gram[o][1][at] - self.discount[o], 0), 0)
        return np.where(seen, c / self.context[o][1][ctx] + self.context[o][2][ctx] * lower, lower)


class LanguageModel:
    """Models of all labels; fit() builds them and calibrates the rejection."""

    def __init__(self, labels: list[str], alphabet: Alphabet):
        self.labels, self.alphabet = labels, alphabet
        self.gram: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.back: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.limit = (np.inf, 0.0)

    @classmethod
    def fit(cls, sample: dict[str, list[str]]) -> LanguageModel:
        letters = Counter()
        for texts in sample.values():
            for t in texts:
                letters.update(t.lower())
        alphabet = Alphabet("".join(c for c, _ in sorted(((c, n) for c, n in letters.items() if c.isalpha()), key=lambda x: (-x[1], x[0]))[:250]))
        labels = sorted(sample)
        model = cls(labels, alphabet)
        symbols = _FIRST + len(alphabet.letters)
        kept = {x: [t for i, t in enumerate(sample[x]) if i % 8 != 7] for x in labels}
        counts = [_Counts(alphabet.symbols(kept[x])[0]) for x in labels]
        for o in range(1, ORDER + 1):
            every = [c.gram[o][0] for c in counts]
            keys = np.unique(np.concatenate(every + ([np.arange(symbols, dtype=np.uint64)] if o == 1 else [])))
            model.gram[o] = (keys, np.log(np.stack([c.prob(keys, o, symbols) for c in counts], axis=1)).astype(np.float32))
            if o > 1:
                ctx = np.unique(np.concatenate([c.context[o][0] for c in counts]))
                gamma = np.zeros((len(ctx), len(labels)), dtype=np.float32)
                for j, c in enumerate(counts):
                    at, has = _lookup(c.context[o][0], ctx)
                    gamma[:, j] = np.where(has, np.log(c.context[o][2][at]), 0.0)
                model.back[o] = (ctx, gamma)
        aside = [(x, t) for x in labels for i, t in enumerate(sample[x]) if i % 8 == 7]
        model.calibrate([t for _, t in aside])
        return model

    def calibrate(self, texts: list[str]) -> None:
        """The limit is a + b / sqrt(symbols): a robust centre plus 8 robust deviations for long texts, and a b that
        admits all but the worst 1 % of the others."""
        total, n, _ = self.totals(texts) if texts else (np.zeros((0, len(self.labels))), np.zeros(0, int), None)
        own = n > 0
        if own.sum() < 20:
            return
        cost, n = -total[own].max(axis=1) / n[own], n[own]
        long_ = cost[n >= np.median(n)]
        a = np.median(long_) + 8 * 1.4826 * np.median(np.abs(long_ - np.median(long_))) + 0.02 * np.median(long_)
        over = (cost - a) * np.sqrt(n)
        self.limit = (float(a), float(max(2.0, np.quantile(over, 0.99))))

    def _log_prob(self, keys: np.ndarray, o: int = ORDER) -> np.ndarray:
        at, has = _lookup(self.gram[o][0], keys)
        out = self.gram[o][1][at]
        miss = np.flatnonzero(~has)
        if len(miss):
            ctx, seen = _lookup(self.back[o][0], keys[miss] >> np.uint64(8))
            back = np.where(seen[:, None], self.back[o][1][ctx], np.float32(0))
            out[miss] = back + self._log_prob(keys[miss] & np.uint64((1 << (8 * (o - 1))) - 1), o - 1)
        return out

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log probability of each text under each label, symbols, whether it has a letter)."""
        sym, doc = self.alphabet.symbols(texts)
        real = sym[ORDER - 1 :] != _EDGE
        where = doc[ORDER - 1 :][real].astype(np.uint64)
        joint = np.sort((where << np.uint64(8 * ORDER)) | grams(sym, ORDER)[real])
        n = np.bincount(where.astype(np.int64), minlength=len(texts))
        letter = np.bincount(doc[(sym != _EDGE) & (sym != _SPACE)], minlength=len(texts)) > 0
        total = np.zeros((len(texts), len(self.labels)))
        if len(joint):
            first = np.flatnonzero(np.concatenate([[True], joint[1:] != joint[:-1]]))
            times = np.diff(np.append(first, len(joint))).astype(np.float32)
            cost = self._log_prob(joint[first] & np.uint64((1 << (8 * ORDER)) - 1)) * times[:, None]
            owner = (joint[first] >> np.uint64(8 * ORDER)).astype(np.int64)
            edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            total[owner[edge]] = np.add.reduceat(cost.astype(np.float64), edge, axis=0)
        return total, n, letter

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(label, score, cross-entropy in nats a symbol, rejected). The score is the label's posterior with equal priors and evidence
        counted for at most 64 symbols; a text without letters is `und` with score 0 and rejected."""
        total, n, letter = self.totals(texts)
        mean = total / np.maximum(n, 1)[:, None]
        best = mean.argmax(axis=1)
        odds = np.exp((mean - mean.max(axis=1, keepdims=True)) * np.minimum(n, 64)[:, None])
        score = np.where(letter, 1 / odds.sum(axis=1), 0.0)
        cost = np.where(letter, -mean.max(axis=1), np.nan)
        rejected = ~letter | (cost > self.limit[0] + self.limit[1] / np.sqrt(np.maximum(n, 1)))
        return [self.labels[b] if ok else "und" for b, ok in zip(best, letter, strict=True)], score, cost, rejected


def sample_texts(docs: DataFrame, label: Column, text_col: str, id_col: str, per_label_docs: int, per_label_chars: int) -> DataFrame:
    """(label, n, text): at most per_label_docs whole texts of each label, and no more once they pass per_label_chars, in the order of a hash
    of id and text. One pass counts labels, one picks rows; only rows below their label's threshold are shuffled."""
    rows = docs.select(label.alias("label"), F.col(f"`{text_col}`").alias("text"), place(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.lit(7)).alias("h")).filter("label is not null")
    limits = {r["label"]: threshold(per_label_docs, r["count"]) for r in rows.groupBy("label").count().collect()}
    return bounded_sample(rows.filter("text <> ''").filter(below(F.col("label"), limits, F.col("h"))), per_label_docs, per_label_chars)


def detect_language(
    docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label_docs: int = 800, per_label_chars: int = 3_000_000
) -> DataFrame:
    """docs with lang_pred, score (0 to 1), cross_entropy and rejected; input columns of these names are replaced.

    The models learn from rows where `train` holds and lang isn't null: at most per_label_docs whole texts of each label
    (and no further text after per_label_chars characters). Rows of one id are rows of their own, each with its own
    label. Every row is scored on its whole text. A null text or one
    without letters gets `und`, score 0 and rejected true. Without any labelled row every text is `und`."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.drop("lang_pred", "score", "cross_entropy", "rejected")
    sample = sample_texts(base.filter(train) if train is not None else base, F.col(f"`{lang_col}`"), text_col, id_col, per_label_docs, per_label_chars)
    sent = spark.sparkContext.broadcast(fit_on(sample, LanguageModel.fit) or pickle.dumps(None))
    names, at = base.columns, base.columns.index(text_col)
    schema = StructType([*base.schema.fields, *StructType.fromDDL("lang_pred string, score double, cross_entropy double, rejected boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)
        for batch in batches:
            column = batch.column(at)
            sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                base_size = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, base_size + SLICE, side="right")))
                part = batch.slice(start, stop - start)
                texts = [t or "" for t in part.column(at).to_pylist()]
                if own is None:
                    got = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), dtype=bool)
                else:
                    got = own.predict(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got[0], pa.string()), *(pa.array(x, from_pandas=True) for x in got[1:])], names=[*names, "lang_pred", "score", "cross_entropy", "rejected"])
                start = stop

    return base.mapInArrow(run, schema)

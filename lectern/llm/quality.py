"""Quality rules: exact base counts, then gradient-boosted trees over document statistics.

The trees are trained here on ``labels`` (quality 0/1), on at most ``MAX_TRAIN`` labelled documents chosen by hash; that
bound is the only place where rows are sampled, and it touches nothing but the fit.  Trees are histogram trees on the
logistic loss with monotonic constraints: more junk symbols, repeated windows, repeated lines or capitals can only lower
a score.  They are flattened into numpy node arrays (feature, threshold, left child, value); scoring walks all rows of a
batch down all trees at once.

A document is kept unless a base rule fails it (fewer than 10 words, or more than 20 words in a hundred repeated) or
its score is below ``KEEP``.  Everything per document happens in one scan, without a shuffle; the model is some KB.

Defined cases: null text counts as no words and fails the base rule; null doc_id and repeated rows are scored like any
other; a doc_id labelled twice counts with its lower label, one that repeats in documents counts once in the fit; ties of a
split go to the first feature and edge; very long texts are read whole, one at a time; with no labels, or labels of one
class only, the base rules alone decide; an empty table gives an empty result; other columns are ignored or, in the
filter, kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import mix64, portions, table, trim

MAX_TRAIN = 20_000
TREES, DEPTH, RATE, BINS = 60, 3, 0.15, 64
KEEP = 0.5
MIN_WORDS = 10
FEATURES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "letter_share", "distinct_share", "words_per_line", "digit_share")
#: -1: the score may only fall as the feature grows.
MONOTONE = (0, 0, -1, -1, -1, -1, 0, 0, 0, 0)
WINDOW = 5
_SYMBOLS = np.array([c in b"#*$%&|<>" for c in range(256)])
_STARTS = np.array([not 0x80 <= c < 0xC0 for c in range(256)])
_SPACE = np.array([c == 0x20 or 0x09 <= c <= 0x0D for c in range(256)])
_UPPER = np.array([0x41 <= c <= 0x5A for c in range(256)])
_LOWER = np.array([0x61 <= c <= 0x7A for c in range(256)])
_DIGIT = np.array([0x30 <= c <= 0x39 for c in range(256)])
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], np.uint64)


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more, its first place included."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h += ids[k : k + n] * _POWERS[k]
    _, inverse, counts = np.unique(mix64(h), return_inverse=True, return_counts=True)
    edges = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(counts[inverse] > 1)
    edges[starts] += 1
    np.subtract.at(edges, starts + width, 1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def statistics(text: bytes) -> tuple[tuple[int, ...], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), features."""
    words = text.split()
    n = len(words)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(count[_STARTS & ~_SPACE].sum())
    symbols = int(count[_SYMBOLS].sum())
    seen: set[bytes] = set()
    lines = dups = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dups += line in seen
            seen.add(line)
    ids: dict[bytes, int] = {}
    codes = [ids.setdefault(w, len(ids)) for w in words]
    repeats = repeated_words(np.array(codes, np.uint64)) if len(ids) < n else 0
    per_char, per_word = 1 / max(chars, 1), 1 / max(n, 1)
    upper, lower = int(count[_UPPER].sum()), int(count[_LOWER].sum())
    feats = [
        float(np.log1p(n)), chars * per_word, symbols * per_char, dups / max(lines, 1), repeats * per_word, upper / max(upper + lower, 1),
        (upper + lower + int(count[0xC0:].sum())) * per_char, len(ids) * per_word, n / max(lines, 1), int(count[_DIGIT].sum()) * per_char,
    ]
    return (n, chars, symbols, dups, repeats), feats


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > 20 * n_words


@dataclass
class Forest:
    """Trees as node arrays; node 0 of each is its root, children of i are left[i] and left[i] + 1, leaves have feature -1."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, left, v in zip(self.feature, self.threshold, self.left, self.value, strict=True):
            at = np.zeros(len(x), np.int32)
            for _ in range(DEPTH):
                feat = f[at]
                right = x[rows, np.maximum(feat, 0)] > t[at]
                at = np.where(feat < 0, at, left[at] + right)
            total += v[at]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, monotone=MONOTONE, trees: int = TREES) -> Forest | None:
    """Histogram gradient boosting on the logistic loss; None where there is nothing to learn."""
    if len(y) == 0 or y.min() == y.max():
        return None
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    codes = np.column_stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(d)])
    base = float(np.log(y.mean() / (1 - y.mean())))
    raw, size = np.full(n, base), 2 ** (DEPTH + 1) - 1
    shape = (trees, size)
    out = Forest(base, np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape, np.int32), np.zeros(shape))
    lam, least = 1.0, 5.0
    for k in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        used = 1
        todo = [(0, np.arange(n), 0, -np.inf, np.inf)]
        while todo:
            node, idx, depth, low, high = todo.pop()
            gs, hs = g[idx].sum(), h[idx].sum()
            value = float(np.clip(gs / (hs + lam), low, high))
            best = (1e-6, None, None, None, None)
            for j in range(d if depth < DEPTH else 0):
                m = len(edges[j]) + 1
                gl = np.cumsum(np.bincount(codes[idx, j], g[idx], m))[:-1]
                hl = np.cumsum(np.bincount(codes[idx, j], h[idx], m))[:-1]
                if not len(gl):
                    continue
                gr, hr = gs - gl, hs - hl
                vl, vr = np.clip(gl / (hl + lam), low, high), np.clip(gr / (hr + lam), low, high)
                gain = gl * vl - 0.5 * (hl + lam) * vl**2 + gr * vr - 0.5 * (hr + lam) * vr**2 - (gs * value - 0.5 * (hs + lam) * value**2)
                bad = (hl < least) | (hr < least)
                if monotone[j]:
                    bad |= (vr - vl) * monotone[j] < 0
                gain[bad] = -1
                b = int(np.argmax(gain))
                if gain[b] > best[0]:
                    best = (gain[b], j, b, vl[b], vr[b])
            _, j, b, vl, vr = best
            if j is None:
                out.value[k, node] = RATE * value
                raw[idx] += RATE * value
                continue
            out.feature[k, node], out.threshold[k, node], out.left[k, node] = j, edges[j][b], used
            goes_left = codes[idx, j] <= b
            mid = (vl + vr) / 2
            lo, hi = ((low, mid), (mid, high)) if monotone[j] > 0 else ((mid, high), (low, mid)) if monotone[j] < 0 else ((low, high), (low, high))
            todo.append((used, idx[goes_left], depth + 1, *lo))
            todo.append((used + 1, idx[~goes_left], depth + 1, *hi))
            used += 2
    return out


def _stats(batches):
    for b in batches:
        feats = [statistics(t.as_py() or b"")[1] for t in b["text"].cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["quality"], pa.array(feats, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])
    trim()


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Forest | None:
    """Fit on at most ``max_train`` labelled documents, chosen by the hash of their id."""
    chosen = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")
    # One row a document: where a doc_id repeats, the least features count, so no label weighs more than another.
    data = rows.mapInArrow(_stats, "doc_id long, quality int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("r"))
    data = sorted(data.select("r.quality", "r.x").collect())
    if not data:
        return None
    return train(np.array([r["x"] for r in data]), np.array([float(r["quality"] > 0) for r in data]))


def _verdicts(texts, forest: Forest | None):
    """(counts, base_failed, kept) of a batch of UTF-8 texts."""
    counts, feats = [], []
    for t in texts:
        c, x = statistics(t or b"")
        counts.append(c)
        feats.append(x)
    failed = np.array([base_failed(c[0], c[4]) for c in counts], bool)
    good = np.ones(len(counts), bool) if forest is None or not feats else forest.score(np.array(feats)) >= KEEP
    return counts, failed, good & ~failed


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def judge(docs: DataFrame, forest: Forest | None) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            counts, failed, kept = _verdicts((t.as_py() for t in b["text"].cast(pa.binary())), model.value)
            cols = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *cols, pa.array(failed), pa.array(kept)], [f.split()[0] for f in _OUT.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, _OUT)


def keep_good(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The documents that pass, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(forest)

    @F.arrow_udf("boolean")
    def passes(text: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([text], ["text"])
        kept = [_verdicts(texts, model.value)[2] for _, texts in portions([rows])]
        trim()
        return pa.array(np.concatenate(kept) if kept else [], pa.bool_())

    return docs.where(passes(F.col("text")))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))

"""Quality by a linear-chain conditional random field over the lines of a document.

Each line has a label, good or bad. A line's score comes from bucketed shape features of itself and of the lines before and
after it; transitions tie neighbours. Forward-backward gives every line's probability of being good, and
the mean of these weighted by line length, calibrated on the training rows, is the document's quality.

Only documents are labelled. Training starts with every line labelled like its document and relabels the lines of bad documents
once by their marginals: a line of a bad document may be good, but its worst line stays bad. The fit uses a bounded sample
of labelled rows (``max_rows``) of at most ``MAX_LINES`` lines each; scoring reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import append_columns, blocks, free_name, utf8
from auditlake.llm.toxicity import fold, sample_rows

MAX_ROWS = 5000
MAX_LINES = 2000
THRESHOLD = 0.3

_UPPER, _LETTER, _DIGIT, _SYMBOL, _PIPE, _BANG = range(6)
#: Two tables of packed counters, three of 21 bits each.
_CLASSES = np.zeros((2, 256), np.uint64)
for _b in range(256):
    _ch = chr(_b)
    if _b >= 0x80 or _ch.isalpha():
        _CLASSES[0, _b] += np.uint64(1 << 21)
        if _ch.isascii() and _ch.isupper():
            _CLASSES[0, _b] += np.uint64(1)
    elif _ch.isdigit():
        _CLASSES[0, _b] += np.uint64(1 << 42)
    elif _ch not in " \t\r\n\x0b\x0c.,;:?'\"-()!|":
        _CLASSES[1, _b] += np.uint64(1)
    if _ch == "|":
        _CLASSES[1, _b] += np.uint64(1 << 21)
    if _ch == "!":
        _CLASSES[1, _b] += np.uint64(1 << 42)

#: Buckets per feature; the last of each is "no such line" for neighbours.
EDGES = (
    (0.5, 15.5, 40.5, 100.5, 250.5, 600.5),  # length
    (1e-9, 0.05, 0.2, 0.5),  # upper case among letters
    (1e-9, 0.02, 0.08, 0.2),  # symbols
    (1e-9, 0.02, 0.1, 0.3),  # digits
    (1e-9, 0.1, 0.5),  # bars per word
    (1e-9, 0.1, 0.5),  # exclamation marks per word
    (1e-9, 0.05, 0.2, 0.5),  # words equal to the one before
    (1e-9, 3, 4.5, 6, 9),  # letters per word
    (0.5, 1.5, 2.5),  # last byte: none, sentence end, letter or digit, other
    (0.5, 1.5),  # first byte: other, upper case, lower case
    (0.5,),  # equal to the line before
    (0.5, 1.5, 5.5, 20.5),  # words
)
SIZES = np.array([len(e) + 2 for e in EDGES])
STARTS = np.cumsum(SIZES) - SIZES
WIDTH = int(SIZES.sum())


def line_features(at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of texts: first line of every text (and the end), feature buckets (lines x features), line lengths.

    Every text has at least one line; an empty text has an empty one.
    """
    breaks = np.flatnonzero(raw == 10)
    # Line starts: of every text, and after every break.
    text_of_break = np.searchsorted(at, breaks, side="right") - 1
    n_lines = 1 + np.bincount(text_of_break, minlength=len(at) - 1)
    first = np.concatenate([[0], np.cumsum(n_lines)])
    start, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    heads = first[:-1]
    is_head = np.zeros(first[-1], bool)
    is_head[heads] = True
    start[heads], start[~is_head] = at[:-1], breaks + 1
    is_tail = np.zeros(first[-1], bool)
    is_tail[first[1:] - 1] = True
    end[is_tail], end[~is_tail] = at[1:], breaks
    length = end - start
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(c[raw])]) for c in _CLASSES]
    low = np.uint64((1 << 21) - 1)
    counts = [((s[end] - s[start]) >> np.uint64(21 * k) & low).astype(float) for s in sums for k in range(3)]
    padded = np.concatenate([raw, np.full(8, 32, np.uint8)])
    blank = np.isin(padded, np.array([32, 9, 10, 11, 12, 13], np.uint8))
    edge = np.zeros(len(raw) + 1, bool)
    edge[at[at < len(raw)]] = True  # texts follow each other without a blank
    word_start = np.flatnonzero(~blank[: len(raw)] & (np.append(True, blank[: len(raw)])[:-1] | edge[:-1]))
    size = np.diff(np.append(word_start, len(raw)))
    code = np.ndarray((len(word_start),), "<u8", b"", 0, (8,)) if not len(word_start) else np.ndarray((len(raw),), "<u8", padded.data, 0, (1,))[word_start]
    cut = np.minimum(size, 8).astype(np.uint64)
    code = code & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - cut * np.uint64(8))) if len(code) else code
    again = np.append(False, (code[1:] == code[:-1]) & (size[1:] == size[:-1])) if len(code) else np.zeros(0, bool)
    again_sum = np.concatenate([[0], np.cumsum(again)])
    w0, w1 = np.searchsorted(word_start, start), np.searchsorted(word_start, end)
    words = (w1 - w0).astype(float)
    repeats = np.where(words > 1, again_sum[w1] - again_sum[np.minimum(w0 + 1, w1)], 0)
    letters, some = counts[_LETTER], np.maximum(length, 1)
    last = np.where(length > 0, padded[np.maximum(end - 1, 0)], 0)
    head = np.where(length > 0, padded[start], 0)
    ending = np.where(length == 0, 0, np.where(np.isin(last, [46, 33, 63, 58]), 1, np.where((_CLASSES[0][last] > 0), 2, 3)))
    opening = np.where((head >= 65) & (head <= 90), 1, np.where((head >= 97) & (head <= 122), 2, 0))
    total = sums[0] * np.uint64(3) + sums[1] * np.uint64(5)
    shape = (total[end] - total[start]) ^ length.astype(np.uint64)
    same = np.append(False, (shape[1:] == shape[:-1]) & (length[1:] == length[:-1]) & (length[1:] > 0)) & ~is_head
    values = (
        length, counts[_UPPER] / np.maximum(letters, 1), counts[_SYMBOL] / some, counts[_DIGIT] / some,
        counts[_PIPE] / np.maximum(words, 1), counts[_BANG] / np.maximum(words, 1), repeats / np.maximum(words, 1),
        letters / np.maximum(words, 1), ending, opening, same, words,
    )
    own = np.stack([np.searchsorted(e, v, side="right") for e, v in zip(EDGES, values, strict=True)], axis=1)
    return first, own, length


def with_neighbours(first: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Active feature numbers per line: own, previous and next line's buckets, each in a range of its own."""
    none = SIZES - 1
    before, after = np.empty_like(own), np.empty_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1]], after[first[1:] - 1] = none, none
    return np.concatenate([own + STARTS, before + STARTS + WIDTH, after + STARTS + 2 * WIDTH], axis=1)


@dataclass(frozen=True)
class Model:
    emission: np.ndarray  # 3 * WIDTH scores for "good"
    bias: float
    transition: np.ndarray  # 2 x 2, from and to; 1 is good
    slope: float
    offset: float


def marginals(score: np.ndarray, transition: np.ndarray, first: np.ndarray, pairs: bool = False):
    """Probability of good per line by forward-backward; with ``pairs`` also the summed probabilities of transitions, and log Z.

    All texts of the block advance together, one line per step.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, n = first[:-1][order], n[order]
    shift = np.maximum(score, 0)
    local = np.stack([np.exp(-shift), np.exp(score - shift)], axis=1)
    move = np.exp(transition)
    alpha, scale = np.empty_like(local), np.ones(len(score))
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(longest), side="left")  # texts with more than t lines
    state = None
    for t in range(longest):
        k = active[t]
        rows = begin[:k] + t
        state = local[rows] if t == 0 else (state[:k, 0:1] * move[0] + state[:k, 1:2] * move[1]) * local[rows]
        total = state.sum(axis=1)
        state = state / total[:, None]
        alpha[rows], scale[rows] = state, total
    good = np.empty(len(score))
    moved = np.zeros((2, 2))
    back = np.ones((len(n), 2))
    for t in range(longest - 1, -1, -1):
        k = active[t]
        rows = begin[:k] + t
        both = alpha[rows] * back[:k]
        good[rows] = both[:, 1] / both.sum(axis=1)
        if t:
            ahead = local[rows] * back[:k] / scale[rows][:, None]
            if pairs:
                joint = alpha[rows - 1][:, :, None] * move * ahead[:, None, :]
                moved += (joint / joint.sum(axis=(1, 2))[:, None, None]).sum(axis=0)
            back[:k] = ahead[:, 0:1] * move[:, 0] + ahead[:, 1:2] * move[:, 1]
    return (good, moved, float(np.log(scale).sum() + shift.sum())) if pairs else good


def fit_chain(active: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int, start=None, penalty: float = 1.0):
    """Emission weights, bias and transitions by penalised maximum likelihood (Adam on the whole sample)."""
    n_lines, width = len(active), 3 * WIDTH
    theta = np.zeros(width + 5) if start is None else start.copy()
    inner = np.ones(n_lines, bool)
    inner[first[:-1]] = False
    here = np.flatnonzero(inner)
    seen = np.bincount(y[here - 1] * 2 + y[here], minlength=4).astype(float)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    flat = active.ravel()
    for t in range(1, steps + 1):
        score = theta[:width][active].sum(axis=1) + theta[width]
        good, moved, _ = marginals(score, theta[width + 1 :].reshape(2, 2), first, pairs=True)
        gap = good - y
        grad = np.empty_like(theta)
        grad[:width] = np.bincount(flat, np.repeat(gap, active.shape[1]), width) + penalty * theta[:width]
        grad[width] = gap.sum()
        grad[width + 1 :] = moved.ravel() - seen + penalty * theta[width + 1 :]
        m, v = 0.9 * m + 0.1 * grad, 0.98 * v + 0.02 * grad**2
        theta -= 0.1 * (1 - t / (steps + 30)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-8)
    return theta


def weighted(good: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean probability per text, weighted by line length (an empty line weighs like one byte)."""
    weight = np.maximum(length, 1).astype(float)
    return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]) if len(first) > 1 else np.empty(0)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def fit(sample: DataFrame) -> Model:
    """Trains on rows (text, y), y the quality. Without both labels the model scores every text by the base rate."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                first, own, length = line_features(*utf8(batch.column(0)))
                n = np.diff(first)
                rows = np.flatnonzero(n <= MAX_LINES)
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).take(pa.array(rows)),
                    pa.array([own[first[r] : first[r + 1]].astype(np.uint8).tobytes() for r in rows], pa.binary()),
                    pa.array([length[first[r] : first[r + 1]].tobytes() for r in rows], pa.binary()),
                ], names=["y", "own", "length"])

    kind = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("own", T.BinaryType()), T.StructField("length", T.BinaryType())])
    got = sample.select("text", "y").mapInArrow(features, kind).collect()  # at most max_rows rows of MAX_LINES lines
    labels = np.array([r[0] for r in got], np.int64)
    if not len(got) or labels.min() == labels.max():
        base = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model(np.zeros(3 * WIDTH), 0.0, np.zeros((2, 2)), 0.0, float(logit(np.array([base]))[0]))
    own = [np.frombuffer(bytes(r[1]), np.uint8).reshape(-1, len(EDGES)).astype(np.int64) for r in got]
    length = np.concatenate([np.frombuffer(bytes(r[2]), np.int64) for r in got])
    first = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    active = with_neighbours(first, np.concatenate(own))
    y = np.repeat(labels, np.diff(first))
    theta = fit_chain(active, first, y, 60)
    width = 3 * WIDTH

    def lines(theta):
        return marginals(theta[:width][active].sum(axis=1) + theta[width], theta[width + 1 :].reshape(2, 2), first)

    good = lines(theta)
    worst = np.minimum.reduceat(good, first[:-1])
    relabelled = np.where(y == 1, 1, (good >= 0.5) & (good > np.repeat(worst, np.diff(first)))).astype(np.int64)
    theta = fit_chain(active, first, relabelled, 60, start=theta)
    x = logit(weighted(lines(theta), length, first))
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton's method on two parameters
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -35, 35)))
        w, g = p * (1 - p) + 1e-9, p - labels
        a, b, c = (w * x * x).sum() + 1e-3, (w * x).sum(), w.sum() + 1e-3
        ga, gb = (g * x).sum() + 1e-3 * (slope - 1), g.sum()
        det = a * c - b * b
        step = np.array([(c * ga - b * gb) / det, (a * gb - b * ga) / det])
        slope, offset = slope - np.clip(step[0], -1, 1), offset - np.clip(step[1], -1, 1)
    return Model(theta[:width], float(theta[width]), theta[width + 1 :].reshape(2, 2), float(slope), float(offset))


def score_texts(docs: DataFrame, model: Model, text: str = "text", name: str = "quality") -> DataFrame:
    """Rows with the quality (0 to 1) appended; null and empty texts count as one empty line."""

    def score(at, raw):
        first, own, length = line_features(at, raw)
        active = with_neighbours(first, own)
        good = marginals(model.emission[active].sum(axis=1) + model.bias, model.transition, first)
        z = model.slope * logit(weighted(good, length, first)) + model.offset
        return [pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))]

    return append_columns(docs, text, [(free_name(docs, name), T.DoubleType())], score)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """The model from rows of ``labels`` outside the held-out fold (crc32 of the id mod 5 is 0)."""
    return fit(sample_rows(docs, labels, "quality", fold(F.col("doc_id"), 5) != 0, max_rows))

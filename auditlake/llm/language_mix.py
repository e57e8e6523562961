"""Language ID by multilingual mixture inference.

A document is a mixture of languages. Its words (runs of letters, cut every 24 bytes for scripts without
spaces) are drawn each from one language, and a word's likelihood in a language comes from its byte n-grams. Expectation-
maximisation estimates the document's proportions over all learned languages. The language set is chosen by penalised
likelihood: a language stays only while leaving it out costs more than the penalty, which grows with the logarithm of the
number of words. If a single language is within one penalty of the full mixture no larger set can win, so
most documents need no further fit; the others lose their weakest language, are fitted again, and so on.

The n-gram counts come from all rows to learn from, in one pass: every task counts into one fixed-size table per
language, and the tables are summed by a shuffle. What reaches the driver and the tasks is ``len(ORDERS) * 2**BITS`` numbers a
language, whatever the input's size. Predicting is one more pass without a shuffle.

Null, empty and letterless texts get ``und`` and score 0; so does every text if nothing was learned. Rows with a null id, language
or text are not learned from, but predicted. Repeated rows count as often as they occur. Ties go to
the language that comes first in code-point order. Columns of the input stay; names that clash get underscores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import append_columns, blocks, by_name, free_name, spans, utf8

ORDERS = (2, 3, 4)
BITS = 16
#: Added to every count.
SMOOTHING = 0.2
#: Steps of expectation-maximisation per fit.
STEPS = 12
#: A further language must add this many times ``log(words)`` to the log-likelihood.
PENALTY = 3.0
#: Longest word, in bytes; longer runs of letters are cut.
LONGEST = 24
#: Languages that a task counts at once.
TABLES = 32

_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)
_CELLS = len(ORDERS) << BITS
_LETTERS = np.random.default_rng(11).integers(0, 2**64, 256, np.uint64)
_POWERS = np.cumprod(np.full(LONGEST, 0x9E3779B97F4A7C15, np.uint64))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    logs: np.ndarray  # [language, cell], log-likelihood of an n-gram divided by the number of orders


def words_of(at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, length, text) of every word; the bytes are folded letters with blanks for all else."""
    low = _FOLD[raw]
    # Capitals of Latin-1 in UTF-8: the byte after 0xC3.
    capital = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
    low[capital] += 0x20
    data = np.append(np.insert(low, at[:-1], 32), np.uint8(32))  # a blank before every text
    letter = data != 32
    start = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    length = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1 - start
    if len(length) and length.max() > LONGEST:
        pieces = -(-length // LONGEST)
        place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(LONGEST, np.repeat(length, pieces) - place * LONGEST)
        start = np.repeat(start, pieces) + place * LONGEST
    return data, start, length, np.searchsorted(at + np.arange(len(at)), start, side="right") - 1


def distinct_words(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start of every distinct word in them, number of the distinct word of every word); words stand between blanks."""
    if not len(start):
        return np.full(16, 32, np.uint8), start, start
    begin = np.cumsum(length) - length
    inside = np.arange(int(length.sum())) - np.repeat(begin, length)
    letters = data[np.repeat(start, length) + inside]
    code = np.add.reduceat(_LETTERS[letters] * _POWERS[inside], begin)
    _, first, same = np.unique(code, return_index=True, return_inverse=True)
    size = length[first]
    if (size[same] != length).any() or (letters[np.repeat(begin[first][same], length) + inside] != letters).any():
        first = same = np.arange(len(start))  # two words share a hash: keep all of them
        size = length
    own = np.cumsum(size + 1) - size
    out = np.full(int(own[-1] + size[-1]) + 16, 32, np.uint8)
    out[spans(own, size)] = letters[spans(begin[first], size)]
    return out, own, same


def cells(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, word) of every n-gram, from the blank before a word to the blank after it; two-byte ones end within the word."""
    word_no = np.cumsum(np.bincount(start, minlength=len(data))) - 1
    word = np.ndarray((len(data) - 8,), "<u8", np.ascontiguousarray(data).data, 0, (1,))
    cell, owner = [], []
    for k, order in enumerate(ORDERS):
        code = word & np.uint64((1 << 8 * order) - 1)
        # An n-gram belongs to the word that holds its second byte; n-grams that cross an inner blank are left out.
        inner = data[1 : len(word) + 1] != 32
        for j in range(2, order - 1):
            inner &= data[j : len(word) + j] != 32
        here = np.flatnonzero(inner)
        mixed = code[here] * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        cell.append((mixed >> np.uint64(64 - BITS)).astype(np.int64) + (k << BITS))
        owner.append(word_no[here + 1])
    return np.concatenate(cell), np.concatenate(owner)


def count_ngrams(rows: DataFrame) -> DataFrame:
    """(lang, cell, n) over rows (lang, text): counts per task, then their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in tables.items():
                cell = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell), pa.string()), pa.array(cell), pa.array(counts[cell])], names=["lang", "cell", "n"])
            tables.clear()

        for whole in batches:
            for batch in blocks(whole, "text"):
                langs = np.array(batch.column(0).to_pylist(), object)
                at, raw = utf8(batch.column(1))
                data, start, length, owner = words_of(at, raw)
                data, start, same = distinct_words(data, start, length)
                cell, word = cells(data, start)
                for lang in sorted(set(langs)):
                    if lang not in tables and len(tables) >= TABLES:
                        yield from flush()
                    counts = tables.setdefault(lang, np.zeros(_CELLS, np.int64))
                    times = np.bincount(same[(langs == lang)[owner]], minlength=len(start))
                    counts += np.bincount(cell, times[word], _CELLS).astype(np.int64)
        yield from flush()

    return rows.select("lang", "text").mapInArrow(run, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, learn: Column, lang: str = "lang", text: str = "text") -> Model:
    """Learns every language that occurs in rows where ``learn`` holds and language and text are not null."""
    rows = docs.where(learn & by_name(docs, lang).isNotNull() & by_name(docs, text).isNotNull())
    rows = rows.select(by_name(docs, lang).cast("string").alias("lang"), by_name(docs, text).cast("string").alias("text"))
    got = count_ngrams(rows).toArrow()  # a fixed number of cells per language
    names = np.array(got.column("lang").to_pylist(), object)
    languages = sorted(set(names))
    counts = np.zeros((len(ORDERS), 1 << BITS, len(languages)))
    cell, n = (got.column(c).to_numpy() for c in ("cell", "n"))
    for j, language in enumerate(languages):
        own = names == language
        counts[cell[own] >> BITS, cell[own] & ((1 << BITS) - 1), j] = n[own]
    counts += SMOOTHING
    logs = np.log(counts / counts.sum(axis=1, keepdims=True)) / len(ORDERS)
    return Model(languages, np.ascontiguousarray(logs.reshape(_CELLS, len(languages)).T).astype(np.float32))


def word_likelihoods(at: np.ndarray, raw: np.ndarray, model: Model, piece: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood [language, word], text of every word); words are walked in pieces, so temporaries stay small."""
    data, start, length, owner = words_of(at, raw)
    out = np.empty((len(model.languages), len(start)))
    for i in range(0, len(start), piece):
        here = slice(i, i + piece)
        some, own, same = distinct_words(data, start[here], length[here])
        cell, word = cells(some, own)
        for k in range(len(model.languages)):
            out[k, here] = np.bincount(word, model.logs[k, cell], len(own))[same]
    return out, owner


def fit(p: np.ndarray, size: np.ndarray, active: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(proportions [language, text], log-likelihood) of mixtures of the active languages.

    ``p`` holds word likelihoods [language, word] grouped by text, ``size`` > 0 the words per text.
    """
    first = np.cumsum(size) - size
    share = active / active.sum(axis=0)
    for step in range(steps + 1):
        r = p * np.repeat(share, size, axis=1)
        total = r.sum(axis=0)
        if step == steps:
            return share, np.add.reduceat(np.log(total), first)
        share = np.add.reduceat(r / total, first, axis=1) / size


def infer(logs: np.ndarray, size: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Proportions [language, text] with zeros for languages outside the chosen set; ``size`` > 0."""
    kinds, n = logs.shape[0], len(size)
    first = np.cumsum(size) - size
    top = logs.max(axis=0)
    p = np.maximum(np.exp(logs - top), 1e-30)
    base = np.add.reduceat(top, first)
    alone = np.add.reduceat(np.log(p), first, axis=1)  # of every single language, as base + this
    best = alone.argmax(axis=0)
    share = np.zeros((kinds, n))
    share[best, np.arange(n)] = 1
    cost = penalty * np.log(np.maximum(size, 2))
    assert base.shape == cost.shape
    everything = np.ones((kinds, n), bool)
    full, likely = fit(p, size, everything)
    # One language within a penalty of all of them: no set of two or more can be better.
    open_ = np.flatnonzero(likely - alone[best, np.arange(n)] > cost)
    active, now, value = everything[:, open_], full[:, open_], likely[open_]
    while len(open_):
        words = np.repeat(np.isin(np.arange(n), open_), size)
        share[:, open_] = now
        weakest = np.where(active, now, np.inf).argmin(axis=0)
        fewer = active.copy()
        fewer[weakest, np.arange(len(open_))] = False
        next_, less = fit(p[:, words], size[open_], fewer)
        drop = value - less <= cost[open_]
        share[:, open_[drop]] = next_[:, drop]
        go = drop & (fewer.sum(axis=0) > 1)
        open_, active, now, value = open_[go], fewer[:, go], next_[:, go], less[go]
    return share


def has_letter(at: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Which texts hold a letter of any script."""
    ascii_letter = (_FOLD[raw] >= ord("a")) & (_FOLD[raw] <= ord("z"))
    count = np.concatenate([[0], np.cumsum(ascii_letter)])
    found = count[at[1:]] > count[at[:-1]]
    high = np.concatenate([[0], np.cumsum(raw >= 0x80)])
    for i in np.flatnonzero(~found & (high[at[1:]] > high[at[:-1]])):
        found[i] = any(c.isalpha() for c in raw[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


MIX = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))


def predict(docs: DataFrame, model: Model, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """Rows with ``lang_pred``, ``score`` and ``languages`` (the chosen set with its shares of the words, largest first) appended.

    The score is the share of the predicted language, shrunk towards equal shares by half a word per learned language.
    """
    languages = model.languages

    def score(at, raw):
        n = len(at) - 1
        pred, value, mix = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
        if languages and len(raw):
            logs, owner = word_likelihoods(at, raw, model)
            size = np.bincount(owner, minlength=n)
            asked = np.flatnonzero(has_letter(at, raw) & (size > 0))
            mine = np.isin(owner, asked)
            if len(asked):
                share = infer(logs[:, mine], size[asked], penalty)
                best = share.argmax(axis=0)
                top = share[best, np.arange(len(asked))]
                value[asked] = (top * size[asked] + 0.5) / (size[asked] + 0.5 * len(languages))
                order = np.argsort(-share, axis=0, kind="stable")
                for k, i in enumerate(asked.tolist()):
                    pred[i] = languages[best[k]]
                    mix[i] = [{"lang": languages[j], "share": float(share[j, k])} for j in order[:, k] if share[j, k] > 0]
        return [pred, value, mix]

    names = []
    for wanted in ("lang_pred", "score", "languages"):
        names.append(free_name(docs, wanted))
    kinds = (T.StringType(), T.DoubleType(), MIX)
    return append_columns(docs, text, list(zip(names, kinds, strict=True)), score)

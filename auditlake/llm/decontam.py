"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are normalised to bytes: A-Z lower-cased, every run of other ASCII characters than letters and digits to one
blank, other bytes kept. An item of m bytes that occurs in a text with at most e edits shares at least
T = m - q + 1 - e * q of its q-grams with it, and these lie on diagonals (position in the text less position in the item) that
span at most e. Bands of 2 (e + 1) diagonals that overlap by half therefore hold all of them: a band with
fewer than T shared q-grams is dropped, and the region of any other is verified by an alignment that is banded too.
The budget e is ``rate`` of m, and at most what leaves T positive. Items of fewer than q bytes are never
found: they are too short to be evidence.

A document may hold a part of an item only; line dedup leaves such parts behind. So an item's lines of at least ``LEAST_LINE``
bytes and its overlapping stretches of ``STRETCH`` bytes, one every ``STEP`` bytes, are patterns too, each with its own m, T and
e. Any part of STRETCH + STEP bytes holds a whole stretch. Shorter lines also occur by chance and are no evidence alone.

The items travel to the tasks in blocks of at most ``MAX_INDEX_BYTES``; a larger benchmark takes several passes, one per block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import append_columns, by_name, char_starts, free_name, spans

Q = 12
RATE = 0.06
LEAST_LINE = 24
STRETCH = 100
STEP = 50
MAX_INDEX_BYTES = 8 << 20
_FILTER_BITS = 20

LEAK = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType()),
    T.StructField("whole", T.BooleanType()),
]))

_NORM = np.full(256, 32, np.uint8)
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isalnum() or _c >= 0x80:
        _NORM[_c] = _c
_NORM[ord("A") : ord("Z") + 1] += 32


def normalise(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes and the place of each in the input."""
    x = _NORM[raw]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    place = np.flatnonzero(keep)
    return x[place], place


def grams(x: np.ndarray) -> np.ndarray:
    """64-bit codes of all q-grams."""
    n = len(x) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    whole = np.ascontiguousarray(x)
    a = np.ndarray((n,), "<u8", whole.data, 0, (1,)) * np.uint64(0x9E3779B97F4A7C15)
    b = np.ndarray((n,), "<u4", whole.data, 8, (1,)).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    a ^= a >> np.uint64(31)
    a += b
    a ^= a >> np.uint64(29)
    return a * np.uint64(0xD6E8FEB86659FD93)


def pieces(text: str, whole: bytes) -> list[bytes]:
    """The lines and stretches of an item, normalised; stretches begin and end between code points."""
    found = [_bytes(line) for line in text.split("\n")]
    found = [x for x in found if LEAST_LINE <= len(x) < len(whole)]
    last = len(whole) - STRETCH
    for a in [*range(0, last, STEP), last] if last > 0 else []:
        z = a + STRETCH
        while a and whole[a] & 0xC0 == 0x80:
            a -= 1
        while z < len(whole) and whole[z] & 0xC0 == 0x80:
            z += 1
        found.append(whole[a:z])
    return found


def _bytes(text: str) -> bytes:
    return normalise(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))[0].tobytes().strip()


@dataclass(frozen=True)
class Index:
    """Patterns are the ``n_whole`` whole items, then the pieces."""

    ids: list  # of the item, by pattern
    texts: list  # normalised bytes by pattern
    n_whole: int
    budget: np.ndarray
    least: np.ndarray  # shared q-grams a band must have
    codes: np.ndarray  # ascending, one per different q-gram
    first: np.ndarray  # of its postings
    many: np.ndarray
    item: np.ndarray  # postings
    place: np.ndarray
    sieve: np.ndarray


def build_index(items: list[tuple[int, str]], rate: float = RATE) -> Index:
    """The index over (item_id, text) rows; equal normalised texts are kept once, under the smallest id, and so are equal pieces."""
    seen: dict[bytes, int] = {}
    parts: dict[bytes, int] = {}
    for item_id, text in items:
        if item_id is None or text is None:
            continue
        x = _bytes(text)
        if len(x) >= Q:
            seen[x] = min(item_id, seen.get(x, item_id))
            for part in pieces(text, x):
                parts[part] = min(item_id, parts.get(part, item_id))
    texts = sorted(seen, key=lambda x: (seen[x], x))
    n_whole = len(texts)
    texts += sorted(parts.keys() - seen.keys(), key=lambda x: (parts[x], x))
    ids = [seen[x] if k < n_whole else parts[x] for k, x in enumerate(texts)]
    m = np.array([len(x) for x in texts], np.int64)
    budget = np.minimum((m * rate).astype(np.int64), (m - Q) // Q)
    codes, item, place = [], [], []
    for k, x in enumerate(texts):
        g = grams(np.frombuffer(x, np.uint8))
        codes.append(g)
        item.append(np.full(len(g), k))
        place.append(np.arange(len(g)))
    if texts:
        code, item, place = np.concatenate(codes), np.concatenate(item), np.concatenate(place)
    else:
        code, item, place = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(code, kind="stable")
    code, item, place = code[order], item[order], place[order]
    unique, first, many = np.unique(code, return_index=True, return_counts=True)
    sieve = np.zeros(1 << _FILTER_BITS, bool)
    sieve[(unique >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return Index(ids, texts, n_whole, budget, m - Q + 1 - budget * Q, unique, first, many, item, place, sieve)


def align(item: bytes, region: bytes, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of the item in the region with at most ``budget`` edits.

    Edit distance of the item to any stretch of the region, one row per byte of the item. Only cells of
    the band can count: a cell is left out once it exceeds the budget. Fewest edits win, then the first end.
    """
    found = region.find(item)
    if found >= 0:
        return 0, found, found + len(item)
    if not budget:
        return None
    text = np.frombuffer(region, np.uint8)
    n, far = len(text), 1 << 20
    cost, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1)
    lo, hi = 0, n  # columns of the band
    for k, c in enumerate(item):
        lo_new, hi_new = lo, min(n, hi + 1)
        # Cells hold cost and start of the stretch as one number, so one minimum settles both.
        packed = cost * far + begin
        diagonal = np.full(n + 1, far * far)
        diagonal[lo_new + 1 : hi_new + 1] = packed[lo_new:hi_new] + (text[lo_new:hi_new] != c) * far
        best = np.minimum(diagonal, packed + far)
        run = np.minimum.accumulate(best - steps * far) + steps * far
        cost, begin = run // far, run % far
        live = np.flatnonzero(cost <= budget)
        if not len(live):
            return None
        lo, hi = int(live[0]), int(live[-1])
        cost[:lo] = far
        cost[hi + 1 :] = far
    end = int(cost.argmin())
    return (int(cost[end]), int(begin[end]), end) if cost[end] <= budget else None


def find(index: Index, at: np.ndarray, raw: np.ndarray) -> list[list[dict]]:
    """Per text the items found: id, start and end in code points, edits, whole or in part; at most one entry per whole item.

    An item that is not found whole gets one entry if pieces of it are found outside of all whole items: the longest stretch
    that they cover, with the most edits that one of them takes.
    """
    out: list[list[dict]] = [[] for _ in range(len(at) - 1)]
    if not index.texts or not len(raw):
        return out
    x, origin = normalise(raw)
    bounds = np.searchsorted(origin, at)  # a blank may be shared by two texts; it belongs to the first
    code = grams(x)
    here = np.flatnonzero(index.sieve[(code >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    slot = np.searchsorted(index.codes, code[here])
    slot[slot == len(index.codes)] = 0
    real = index.codes[slot] == code[here]
    here, slot = here[real], slot[real]
    row = np.searchsorted(bounds, here, side="right") - 1
    inside = here + Q <= bounds[row + 1]
    here, slot, row = here[inside], slot[inside], row[inside]
    if not len(here):
        return out
    many = index.many[slot]
    post = spans(index.first[slot], many)
    item, place = index.item[post], index.place[post]
    row = np.repeat(row, many)
    diagonal = np.repeat(here, many) - bounds[row] - place
    width = index.budget[item] + 1
    band = diagonal // width
    pair = row * len(index.texts) + item
    # Every hit counts for the band that begins at its stripe of diagonals and for the one before.
    pair, band = np.concatenate([pair, pair]), np.concatenate([band, band - 1])
    order = np.lexsort((band, pair))
    pair, band = pair[order], band[order]
    new = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])))
    count = np.diff(np.append(new, len(pair)))
    pair, band = pair[new], band[new]
    enough = count >= index.least[pair % len(index.texts)]
    best: dict[int, tuple] = {}
    complete = set()  # (text, item id) found whole
    picked = np.flatnonzero(enough)
    picked = picked[np.argsort(pair[picked] % len(index.texts) >= index.n_whole, kind="stable")]  # whole items first
    for p, b in zip(pair[picked].tolist(), band[picked].tolist(), strict=True):
        r, k = divmod(p, len(index.texts))
        if p in best and best[p][0] == 0 or k >= index.n_whole and (r, index.ids[k]) in complete:
            continue
        e, m = int(index.budget[k]), len(index.texts[k])
        lo = max(0, b * (e + 1) - e)
        hi = min(int(bounds[r + 1] - bounds[r]), (b + 2) * (e + 1) + m + e)
        got = align(index.texts[k], x[bounds[r] + lo : bounds[r] + hi].tobytes(), e)
        if got and (p not in best or (got[0], got[1] + lo) < best[p][:2]):
            best[p] = (got[0], got[1] + lo, got[2] + lo)
            if k < index.n_whole:
                complete.add((r, index.ids[k]))
    entries: list[tuple] = []  # text, item id, start, end, edits, whole
    taken: dict[int, list] = {}
    loose: dict[tuple, list] = {}
    for p, (edits, start, end) in best.items():
        r, k = divmod(p, len(index.texts))
        if k < index.n_whole:
            entries.append((r, index.ids[k], start, end, edits, True))
            taken.setdefault(r, []).append((start, end))
        else:
            loose.setdefault((r, index.ids[k]), []).append((start, end, edits))
    for (r, item_id), found in loose.items():
        joined: list[tuple] = []
        for start, end, edits in sorted(found):
            if any(s <= start and end <= t for s, t in taken.get(r, [])):
                continue
            if joined and start <= joined[-1][1] + 1:
                s, t, most = joined[-1]
                joined[-1] = (s, max(t, end), max(most, edits))
            else:
                joined.append((start, end, edits))
        if joined:
            start, end, edits = max(joined, key=lambda j: (j[1] - j[0], -j[0]))
            entries.append((r, item_id, start, end, edits, False))
    for r, item_id, start, end, edits, whole in sorted(entries):
        text = raw[at[r] : at[r + 1]]
        a, z = origin[bounds[r] + start] - at[r], origin[bounds[r] + end - 1] - at[r] + 1
        # The end may fall inside a code point only after an edit there; count the ones begun before it.
        starts = char_starts(text)
        begun = int(starts[:a].sum())
        out[r].append({"item_id": int(item_id), "start": begun, "end": begun + int(starts[a:z].sum()), "edits": edits, "whole": whole})
    return out


def mark_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", name: str = "leaks", rate: float = RATE) -> DataFrame:
    """Rows with the list of benchmark items found in the text appended: item_id, start, end (code points), edits, and
    whether the item was found whole or in part.

    Null and empty texts have none, nor has any text if the benchmark is empty. Repeated rows are marked each.
    """
    name = free_name(docs, name)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    copies = 2 + -(-STRETCH // STEP)  # whole, by lines, by stretches
    n_blocks = max(1, -(-int(total) * 2 * copies // MAX_INDEX_BYTES))
    out = docs
    for k in range(n_blocks):
        block = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        index = build_index([tuple(r) for r in block.collect()], rate)  # about half of MAX_INDEX_BYTES
        part = name if n_blocks == 1 else free_name(out, f"{name}_{k}")
        out = append_columns(out, text, [(part, LEAK)], lambda at, raw, index=index: [find(index, at, raw)])
    if n_blocks > 1:
        parts = [by_name(out, c) for c in out.columns[len(docs.columns) :]]
        # A piece inside a whole item of another block goes, as within a block.
        found = F.flatten(F.array(*parts))
        whole = F.filter(found, lambda x: x["whole"])
        inside = lambda x: F.exists(whole, lambda w: (w["item_id"] == x["item_id"]) | (w["start"] <= x["start"]) & (x["end"] <= w["end"]))
        found = F.filter(found, lambda x: x["whole"] | ~inside(x))
        out = out.select(*(by_name(out, c) for c in docs.columns), found.alias(name))
    return out

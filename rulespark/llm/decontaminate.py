"""Benchmark decontamination under edit distance.

Texts and items are sequences of lower-cased words. A document is contaminated by an item of L words if some stretch of it is within
``floor(rate * L)`` word edits of the item.

1. Where an item could start: with so few edits, an item keeps a run of g words unchanged (g follows from L and the rate), so a window
   of the item's size, placed where one of the item's g-grams meets the same g-gram of the document, is a candidate. No match within
   the bound has no such window.
2. CGK embedding: a random walk copies a window into three times as many places, staying on a word or going on as a hash of the place and
   the word says; few edits become few differing places. ``WALKS`` walks each have ``DRAWS`` bit samples of ``PLACES`` places; a window
   passes if all places of some sample hold the same words as in the item's embedding. Repetition brings the recall at the full number of
   edits to 0.97 at least (asserted in the tests over 300 items).
3. Exact edit distance between the item and the best stretch about the window.

Embedding all windows of each item's size, without step 1, was measured and given up: one walk over the windows of one length of 40 words
takes 11 microseconds of CPU a window, so 43 lengths and 12 walks over 266 million words a GB would take 1.5 million CPU seconds a GB.

Result: one row for each input row and item that match, with the least distance and where it is. Null and empty texts and items match
nothing; items without words are none; an item of one word matches each document that holds it. Repeated rows and repeated items give
their own rows, equally good places the first one. Ids keep their types; other columns are ignored. Items are sent to all tasks, ``PASS``
at a time; more items mean more passes, each stored before the next.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, pick, schema_of, stored

WORD = re.compile(r"\w+")
WALKS, DRAWS, PLACES = 12, 8, 2
PASS = 20_000
_K = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str) -> np.ndarray:
    words = WORD.findall(text.lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def edits_allowed(length: int, rate: float) -> int:
    return int(rate * length)


def kept_run(length: int, rate: float) -> int:
    """Words in a row that some part of an item keeps, whatever the allowed edits."""
    e = edits_allowed(length, rate)
    return max(1, -(-(length - e) // (e + 1)))


def gram_hashes(h: np.ndarray, g: int) -> np.ndarray:
    n = len(h) - g + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(g):
        out = (out ^ h[i : i + n]) * _K
        out ^= out >> np.uint64(32)
    return out


def embed(windows: np.ndarray, walk: int) -> np.ndarray:
    """CGK embeddings of windows of one length, a row each; word 0 is the padding."""
    n, length = windows.shape
    padded = np.hstack([windows, np.zeros((n, 1), np.uint64)])
    at, rows = np.zeros(n, np.int64), np.arange(n)
    out = np.zeros((n, 3 * length), np.uint64)
    salts = np.random.default_rng(walk).integers(1, 1 << 63, 3 * length, dtype=np.uint64)
    for j in range(3 * length):
        word = padded[rows, at]
        out[:, j] = word
        mixed = (word ^ salts[j]) * _K
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _K
        at = np.minimum(at + (mixed >> np.uint64(63)).astype(np.int64), length)
    return out


def draws(length: int, walk: int) -> np.ndarray:
    """The places of each sample of a walk; of the part that most walks fill."""
    return np.random.default_rng(1000 + walk).integers(0, max(1, 2 * length), (DRAWS, PLACES))


def passes(windows: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Which windows share a sample with the item."""
    found = np.zeros(len(windows), bool)
    for walk in range(WALKS):
        rest = np.flatnonzero(~found)
        if not len(rest):
            break
        own, other = embed(item[None], walk)[0], embed(windows[rest], walk)
        for places in draws(len(item), walk):
            found[rest] |= (other[:, places] == own[places]).all(1)
    return found


def least_edits(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int]:
    """Edit distance between the item and the best part of the stretch, and where that part ends."""
    steps = np.arange(len(stretch) + 1)
    row = np.zeros(len(stretch) + 1, np.int64)
    for i, word in enumerate(item):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (stretch != word))
        row = np.minimum.accumulate(new - steps) + steps  # words of the stretch that the item lacks
    end = int(row.argmin())
    return int(row[end]), end


class Items:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.rate = rate
        self.items = [(i, h) for i, t in items if len(h := word_hashes(t or ""))]
        self.grams: dict[int, tuple[np.ndarray, dict[int, list[tuple[int, int]]]]] = {}
        where: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, h) in enumerate(self.items):
            g = kept_run(len(h), rate)
            for p, x in enumerate(gram_hashes(h, g).tolist()):
                where[g][x].append((k, p))
        for g, w in where.items():
            self.grams[g] = np.array(sorted(w), np.uint64), dict(w)

    def starts(self, h: np.ndarray) -> set[tuple[int, int]]:
        """Candidate windows: item and first word."""
        out = set()
        for g, (known, where) in self.grams.items():
            grams = gram_hashes(h, g)
            at = np.searchsorted(known, grams)
            at[at == len(known)] = 0
            for p in np.flatnonzero(known[at] == grams).tolist():
                for item, q in where[int(grams[p])]:
                    out.add((item, p - q))
        return out

    def matches(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """Text number, item number, least edits, first word of the match's window."""
        by_item: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, h in enumerate(texts):
            for k, s in self.starts(h):
                by_item[k].append((i, s))
        out = []
        for k, found in by_item.items():
            item = self.items[k][1]
            e = edits_allowed(len(item), self.rate)
            best: dict[int, tuple[int, int]] = {}
            for part in (found[i : i + 4096] for i in range(0, len(found), 4096)):
                windows = np.zeros((len(part), len(item)), np.uint64)
                for r, (i, s) in enumerate(part):
                    w = texts[i][max(0, s) : max(0, s + len(item))]
                    windows[r, : len(w)] = w
                for (i, s), ok in zip(part, passes(windows, item)):
                    if ok:
                        a = max(0, s - e)
                        d, end = least_edits(item, texts[i][a : s + len(item) + e])
                        if d <= e:
                            best[i] = min(best.get(i, (d, a + end - len(item))), (d, a + end - len(item)))
            out += [(i, k, d, max(0, s)) for i, (d, s) in best.items()]
        return out


def _passes(benchmark: DataFrame, item_col: str, item_text: str) -> Iterator[tuple[list[tuple], bool]]:
    """The items, ``PASS`` at a time, and whether there are more passes than one; one empty pass without items. The driver holds one pass."""
    items = benchmark.select(F.col(f"`{item_col}`").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t"))
    first = items.limit(PASS + 1).collect()
    if len(first) <= PASS:
        yield [tuple(r) for r in first], False
        return
    numbered = stored(items.withColumn("n", F.monotonically_increasing_id()), "benchmark")
    blocks = -(-numbered.count() // PASS)
    for k in range(blocks):  # ids of a partition count up, so blocks are even but for one row for each partition
        yield [(r["i"], r["t"]) for r in numbered.filter(F.pmod("n", F.lit(blocks)) == k).collect()], True


def clean_rows(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = 0.2) -> DataFrame:
    """The rows themselves that no item matches, each judged by its own text whatever its id."""
    at = df.columns.index(text_col)
    out = df
    for own, more in _passes(benchmark, item_col, item_text):
        known = Items(own, rate)

        def run(batches: Iterator[list[list]], known=known):
            for cols in batches:
                texts = cols[at]
                for a in range(0, len(texts), 500):
                    bad = {m[0] for m in known.matches([word_hashes(t or "") for t in texts[a : a + 500]])}
                    good = [a + i for i in range(len(texts[a : a + 500])) if i not in bad]
                    if good:
                        yield [[c[i] for i in good] for c in cols]

        out = map_batches(out, run, df.schema)
        out = stored(out, "uncontaminated") if more else out
    return out


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = 0.2) -> DataFrame:
    """``id``, ``item_id``, ``edits``, ``item_words``, ``first_word``: the matches."""
    docs = pick(df, id_col, text_col)
    out = None
    out_schema = schema_of(f"id {df.schema[id_col].dataType.simpleString()}, item_id {benchmark.schema[item_col].dataType.simpleString()}, edits int, item_words int, first_word long")
    for own, more in _passes(benchmark, item_col, item_text):
        known = Items(own, rate)

        def run(batches: Iterator[list[list]], known=known):
            for ids, texts in batches:
                for a in range(0, len(ids), 500):
                    found = known.matches([word_hashes(t) for t in texts[a : a + 500]])
                    rows = [(ids[a + i], known.items[k][0], d, len(known.items[k][1]), s) for i, k, d, s in sorted(found)]
                    if rows:
                        yield list(zip(*rows))

        part = map_batches(docs, run, out_schema)
        part = stored(part, "contaminated") if more else part
        out = part if out is None else out.unionByName(part)
    return out

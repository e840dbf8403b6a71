"""Phrase collocations by language: n-grams as rows, exact counts, scores in decimals, anti-join of phrases that a longer one explains.

A text's A-Z are lower-cased; it is split at ``.,;:!?`` and line ends into pieces, those at spaces and tabs into words. Everything is per language (null:
``und``): n counts all words, f(phrase) all contiguous occurrences within pieces, overlaps included. Candidates are phrases of 2 to ``max_words`` words with
a = f >= ``least``. A cut into a first part and the rest has l and r occurrences and the score floor(1000000 a a / (l r)); a candidate's is that of its
lowest cut, among equals the earliest. A candidate goes if some longer candidate around it has ``100 f >= percent a``.

1. n-grams are exploded into rows (language, phrase, count), length by length, and added up by hash, in each task first. A phrase is as rare as its rarest part, so
   one of k words is exploded only where both its parts of k - 1 words may be candidates themselves, by a Bloom filter (of ``MOST_BITS`` at most,
   whatever the corpus; a full one only lets more rows through). Counts of all that is kept are exact, and nothing is sampled.
2. Cuts are joined to the counts of both their parts. Products are taken in decimals of 38 digits (counts up to 10**15), so floors are exact.
3. Of the longer phrases around a candidate those with one more word suffice: between it and any longer one there is one of them with no fewer
   occurrences. An anti-join drops what they explain.
4. Each language's first ``top`` are found in two windows, over parts of a language and then over what those leave, so no task sorts a whole language.

Null and empty texts have no words. Repeated rows count again. A language without phrases has no rows; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from . import bloom
from .common import stored

BREAKS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + BREAKS + SPACES, bytes(range(97, 123)) + b"\n" * len(BREAKS) + b" " * len(SPACES))
#: Of a filter of frequent phrases: 32 MB.
MOST_BITS = 28
#: Rows that a task adds up, and words that it remembers, before it hands them on; code points that it takes at a time.
HELD, REMEMBERED, TAKEN = 1 << 17, 1 << 18, 1 << 20
PARTS = 64

ROWS = "lang string, phrase string, n long"


def tokens(text: str) -> list[bytes]:
    """The words, with a line end between pieces and empty strings at spaces."""
    return text.encode().translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")


def phrase_hashes(lang: str, words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the phrases of k words that begin at the given places of a row of word hashes."""
    out = np.full(len(at), xxhash.xxh3_64_intdigest(lang) | 1, np.uint64)
    for j in range(k):
        out = (out ^ words[at + j]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(31)
    return out


def text_hashes(lang: str, phrases: list[str], k: int) -> np.ndarray:
    flat = np.fromiter((xxhash.xxh3_64_intdigest(w) for p in phrases for w in p.encode().split(b" ")), np.uint64, len(phrases) * k)
    return phrase_hashes(lang, flat, np.arange(len(phrases)) * k, k)


def _frames(lang: str, phrases: list[bytes], counts: list[int], size: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(phrases), size):
        own = pa.array(phrases[k : k + size], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), own, pa.array(counts[k : k + size], pa.int64())], names=["lang", "phrase", "n"])


def in_turns(langs: list[str], texts: list[str]) -> Iterator[tuple[str, list[str]]]:
    """Texts by language, some at a time."""
    waiting: dict[str, list[str]] = {}
    held = 0
    for lang, text in zip(langs, texts):
        waiting.setdefault(lang, []).append(text)
        held += len(text)
        if held >= TAKEN:
            yield from waiting.items()
            waiting, held = {}, 0
    yield from waiting.items()


def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts, and under the empty phrase the count of all words."""
    found: dict[str, Counter] = {}

    def made():
        for lang, own in found.items():
            own.pop(b"", None)
            own.pop(b"\n", None)
            if own:
                yield from _frames(lang, [b"", *own], [sum(own.values()), *own.values()])
        found.clear()

    for batch in batches:
        for lang, texts in in_turns(*(c.to_pylist() for c in batch.columns)):
            found.setdefault(lang, Counter()).update(tokens("\n".join(texts)))
            if sum(map(len, found.values())) >= HELD:
                yield from made()
    yield from made()


class Exploder:
    """Phrases of k words of one language whose parts may be frequent."""

    def __init__(self, lang: str, k: int, words: bloom.Bits, parts: bloom.Bits):
        self.lang, self.k, self.frequent, self.parts = lang, k, words, parts
        self.start()

    def start(self) -> None:
        self.number: dict[bytes, int] = {b"\n": -1, b"": -2}
        self.names: list[bytes] = []
        self.hashes = np.zeros(0, np.uint64)
        self.found: list[np.ndarray] = []
        self.held = 0

    def learn(self, words: list[bytes]) -> None:
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        keep = self.frequent.holds(phrase_hashes(self.lang, own, np.arange(len(own)), 1))
        for w, ok in zip(words, keep.tolist()):
            self.number[w] = len(self.names) if ok else -1
            if ok:
                self.names.append(w)
        self.hashes = np.concatenate([self.hashes, own[keep]])

    def add(self, texts: list[str]) -> None:
        flat = tokens("\n".join(texts))  # a line end parts texts as it parts pieces
        if new := set(flat).difference(self.number):
            self.learn(list(new))
        ids = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        ids = ids[ids != -2]
        k = self.k
        if len(ids) < k:
            return
        fine = ids >= 0
        whole = fine[: len(ids) - k + 1].copy()
        for j in range(1, k):
            whole &= fine[j : len(ids) - k + 1 + j]
        at = np.flatnonzero(whole)
        if k > 2:  # both parts of k - 1 words
            words = self.hashes[np.maximum(ids, 0)] if len(self.hashes) else np.zeros(len(ids), np.uint64)
            may = lambda p: self.parts.holds(phrase_hashes(self.lang, words, p, k - 1))
            at = at[may(at)]
            at = at[may(at + 1)]
        self.found.append(ids[at[:, None] + np.arange(k)])
        self.held += len(at)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            grams = np.concatenate(self.found)
            code = grams[:, 0]
            for j in range(1, self.k):  # equal codes: equal phrases so far
                code = code << 32 | grams[:, j]
                if j < self.k - 1:
                    code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            _, first, counts = np.unique(code, return_index=True, return_counts=True)
            names = self.names
            phrases = [b" ".join([names[i] for i in gram]) for gram in grams[first].tolist()]
            yield from _frames(self.lang, phrases, counts.tolist())
        self.found, self.held = [], 0


def phrase_rows(k: int, shapes: list[bloom.Shape], sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [bloom.Bits(shape, rows) for shape, rows in zip(shapes, sent.value)]
        by_lang: dict[str, Exploder] = {}
        for batch in batches:
            for lang, own in in_turns(*(c.to_pylist() for c in batch.columns)):
                if lang not in by_lang:
                    by_lang[lang] = Exploder(lang, k, filters[0], filters[-1])
                by_lang[lang].add(own)
                forget = sum(len(x.number) for x in by_lang.values()) >= REMEMBERED
                if forget or sum(x.held for x in by_lang.values()) >= HELD:
                    for x in by_lang.values():
                        yield from x.rows()
                if forget:
                    by_lang.clear()
        for one in by_lang.values():
            yield from one.rows()

    return run


def frequent_filter(frequent: DataFrame, k: int) -> tuple[bloom.Shape, list[tuple[int, bytes]]]:
    """A filter of the phrases of k words, of ``MOST_BITS`` at most."""
    shape = bloom.Shape(frequent.count(), MOST_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, phrase in zip(*(c.to_pylist() for c in batch.columns)):
                by_lang.setdefault(lang, []).append(phrase)
            own = [text_hashes(lang, phrases, k) for lang, phrases in by_lang.items()]
            if own:
                yield bloom.frame(bloom.packed(np.concatenate(own), shape))

    filled = bloom.merged(frequent.select("lang", "phrase").mapInArrow(run, bloom.SCHEMA), shape)
    return shape, [(r["shard"], bytes(r["once"])) for r in filled.select("shard", "once").collect()]  # at most 32 MB


def phrase_counts(df: DataFrame, max_words: int, least: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang``, ``k``, ``phrase``, ``f`` of all phrases of up to ``max_words`` words with ``least`` occurrences; under k = 0 the count of a language's words."""
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    total = lambda made: made.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    words = total(rows.mapInArrow(word_rows, ROWS)).filter((F.col("f") >= least) | (F.col("phrase") == ""))
    found = [stored(words.select("lang", F.when(F.col("phrase") == "", 0).otherwise(1).alias("k"), "phrase", "f"), "phrases-1")]
    filters = []
    for k in range(2, max_words + 1):
        shape, bits = frequent_filter(found[-1].filter(F.col("k") == k - 1), k - 1)
        filters = [*filters[:1], (shape, bits)]
        if not bits:
            break
        sent = spark.sparkContext.broadcast([b for _, b in filters])  # at most 64 MB
        made = total(rows.mapInArrow(phrase_rows(k, [s for s, _ in filters], sent), ROWS)).filter(F.col("f") >= least)
        found.append(stored(made.select("lang", F.lit(k).alias("k"), "phrase", "f"), f"phrases-{k}"))
        sent.unpersist()
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def scored(counts: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``k``, ``a``, ``l``, ``r``, ``score`` of each candidate, by its lowest cut."""
    parts = F.split("phrase", " ", -1)
    cut = lambda a, b: F.array_join(F.slice("words", a, b), " ")
    cuts = counts.filter("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), parts.alias("words"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", cut(F.lit(1), F.col("cut")).alias("first"), cut(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    known = counts.filter("k >= 1")
    both = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = lambda c: f"cast({c} as decimal(18, 0))"
    score = F.expr(f"(cast(1000000 as decimal(7, 0)) * ({wide('a')} * {wide('a')})) div ({wide('l')} * {wide('r')})")
    best = both.select("lang", "phrase", "k", "a", F.struct(score.alias("score"), "cut", "l", "r").alias("c")).groupBy("lang", "phrase", "k", "a").agg(F.min("c").alias("c"))
    return best.select("lang", "phrase", "k", "a", "c.l", "c.r", "c.score")


def unexplained(candidates: DataFrame, percent: int) -> DataFrame:
    """Without those that a phrase of one more word explains."""
    words = F.split("phrase", " ", -1)
    inner = F.array(F.array_join(F.slice(words, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("k") - 1), " "))
    longer = candidates.filter("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    short, long = candidates.alias("short"), longer.alias("long")
    explained = (F.col("short.lang") == F.col("long.lang")) & (F.col("short.phrase") == F.col("long.phrase")) & (100 * F.col("long.longer") >= percent * F.col("short.a"))
    return short.join(long, explained, "left_anti")


def first_ranked(rows: DataFrame, top: int) -> DataFrame:
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    few = rows.withColumn("_k", F.row_number().over(part)).filter(F.col("_k") <= top).drop("_k")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(df: DataFrame, max_words: int = 3, least: int = 10, percent: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``."""
    if max_words < 2 or least < 1:
        raise ValueError("phrases have two words and one occurrence at least")
    counts = phrase_counts(df, max_words, least, text_col, lang_col)
    kept = first_ranked(unexplained(stored(scored(counts), "scored"), percent), top)
    words = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    return kept.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

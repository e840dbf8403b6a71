"""Repeated lines across documents, by two Bloom filters and exact confirmation.

A text is split at ``\\n``. A line's key is the line without the ASCII blanks at both its ends, A-Z lower-cased. Keys of ``least_chars`` code points or more
that ``least_documents`` documents have lose all their lines, except in the largest (``keep="first"``: the smallest) id that has them.

1. Two filters for all keys: what one document or more fills, and what two or more fill. Tasks emit the bits of their documents, and bits merge by
   shard (:mod:`.bloom`), so a filter grows with the number of lines and nothing but bits moves.
2. Lines whose key isn't in the twice-seen filter are kept without moving. The others are suspects: their 128-bit key digest and the id are shuffled
   and counted exactly. A task hands on a key's three (``least_documents``) most distant ids alone for the count, which neither the test nor the choice can
   tell from all, so a line that all documents have is no hot key.
3. Digests that are confirmed take their lines out of the other documents. Only documents with such lines get a list of them.

A filter of up to ``broadcast_bytes`` is sent to all tasks; for a larger one digests travel to the shard's task instead, with the same result. Confirmed keys are
treated alike: sent if they are few, else joined to the suspects, and the lists to the documents.

Rows: one per input row, repeated rows too. A null or empty text is one empty line. Rows that share an id count as one document, each with its own lines; null
ids are one document, lower than all others. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import bloom
from .common import forget, map_batches, pick, schema_of, stored

BLANKS = " \t\n\x0b\x0c\r"
#: The largest filter, and the most confirmed keys (of 16 bytes and an id), that are sent to all tasks.
BROADCAST_BYTES, BROADCAST_KEYS = 64 << 20, 1 << 20
#: Keys that a task holds before it hands them on.
HELD = 1 << 18


def line_keys(text: str, least_chars: int) -> list[bytes | None]:
    """The key of each line, None for one that is too short."""
    short = [line.strip(BLANKS) for line in text.split("\n")]
    return [line.encode().lower() if len(line) >= least_chars else None for line in short]


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def hashes(keys: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64)


def filters(rows: DataFrame, shape: bloom.Shape, least_chars: int) -> DataFrame:
    """The merged once- and twice-seen filters; a document counts once for each of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for text in batch.column(1).to_pylist():
                own = hashes(set(line_keys(text, least_chars)) - {None})
                found.append(own)
                held += len(own)
                if held >= HELD:
                    yield bloom.frame(bloom.packed(np.concatenate(found), shape))
                    found, held = [], 0
        if held:
            yield bloom.frame(bloom.packed(np.concatenate(found), shape))

    return bloom.merged(rows.mapInArrow(run, bloom.SCHEMA), shape)


def line_count(rows: DataFrame) -> int:
    return rows.agg(F.coalesce(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1), F.lit(0))).first()[0]


def suspects(rows: DataFrame, shape: bloom.Shape, twice: DataFrame, least_chars: int, broadcast_bytes: int) -> DataFrame:
    """``id``, ``digest``: each document's distinct keys in the twice-seen filter."""
    kind = rows.schema["id"].dataType.simpleString()
    if shape.n_bytes <= broadcast_bytes:
        sent = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in twice.select("shard", "twice").collect()])  # at most broadcast_bytes

        def run(batches):
            bits = bloom.Bits(shape, sent.value)
            for ids, texts in batches:
                owned = [sorted(set(line_keys(t, least_chars)) - {None}) for t in texts]
                hit = bits.holds(hashes(k for own in owned for k in own)).tolist()
                flat = [(i, k) for i, own in zip(ids, owned) for k in own]
                found = [(i, digest(k)) for (i, k), h in zip(flat, hit) if h]
                yield list(zip(*found)) if found else [[], []]

        return map_batches(rows, run, schema_of(f"id {kind}, digest binary"))

    def lines(batches):
        for ids, texts in batches:
            flat = [(i, k) for i, t in zip(ids, texts) for k in set(line_keys(t, least_chars)) - {None}]
            own = hashes(k for _, k in flat)
            yield [[i for i, _ in flat], [digest(k) for _, k in flat], own.view(np.int64).tolist(), shape.places(own)[0].tolist(), [None] * len(flat)]

    def test(batches):
        shard, bits = None, b""
        for ids, digests, own, shards, filled in batches:
            kept = [], []
            start = 0
            while start < len(ids):
                if filled[start] is not None:
                    shard, bits, start = shards[start], filled[start], start + 1
                    continue
                end = start
                while end < len(ids) and filled[end] is None and shards[end] == shards[start]:
                    end += 1
                if shards[start] == shard:
                    for k in np.flatnonzero(bloom.holds_in_shard(bits, shape, np.array(own[start:end], np.int64).view(np.uint64))).tolist():
                        kept[0].append(ids[start + k])
                        kept[1].append(digests[start + k])
                start = end
            yield kept

    probes = map_batches(rows, lines, schema_of(f"id {kind}, digest binary, h long, shard int, bits binary"))
    bits = twice.select(F.lit(None).cast(kind).alias("id"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("h"), "shard", F.col("twice").alias("bits"))
    dealt = probes.unionAll(bits).repartition("shard").sortWithinPartitions("shard", F.col("bits").isNull())
    return map_batches(dealt, test, schema_of(f"id {kind}, digest binary"))


def confirmed(found: DataFrame, least_documents: int, keep: str) -> DataFrame:
    """``digest``, ``keeper``: keys that enough documents have, and the id that keeps them."""
    kind = found.schema["id"].dataType.simpleString()
    last = keep == "last"
    order = lambda i: (i is not None, i) if i is not None else (False, 0)

    def thinned(batches):
        own: dict[bytes, list] = {}
        for ids, digests in batches:
            for i, d in zip(ids, digests):
                have = own.setdefault(d, [])
                if i not in have:
                    have.append(i)
                    if len(have) > least_documents:
                        have.remove((min if last else max)(have, key=order))
            if len(own) >= HELD:
                yield [[i for have in own.values() for i in have], [d for d, have in own.items() for _ in have]]
                own = {}
        yield [[i for have in own.values() for i in have], [d for d, have in own.items() for _ in have]]

    rows = map_batches(found, thinned, schema_of(f"id {kind}, digest binary"))
    some, none = F.count_distinct("id"), F.max(F.col("id").isNull())
    keeper = F.max("id") if last else F.when(~none, F.min("id"))
    counts = rows.groupBy("digest").agg((some + none.cast("int")).alias("n"), keeper.alias("keeper"))
    return counts.filter(F.col("n") >= least_documents).select("digest", "keeper")


def dedup_lines(df: DataFrame, least_chars: int = 20, least_documents: int = 3, keep: str = "last", id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``id``, ``text`` (without the dropped lines), ``n_lines`` (before), ``n_dropped``."""
    if least_documents < 2 or keep not in ("first", "last"):
        raise ValueError("a repeated line is in two documents at least, and the first or the last one keeps it")
    rows = pick(df, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    shape = bloom.Shape(line_count(rows))
    twice = stored(filters(rows, shape, least_chars).select("shard", "twice"), "twice-seen")
    found = stored(suspects(rows, shape, twice, least_chars, broadcast_bytes), "suspects")
    sure = stored(confirmed(found, least_documents, keep), "confirmed")
    forget(twice)
    made = schema_of(f"id {kind}, text string, n_lines long, n_dropped long")

    def without(text: str, gone) -> tuple[str, int, int]:
        lines = text.split("\n")
        if not gone:
            return text, len(lines), 0
        kept = [line for line, key in zip(lines, line_keys(text, least_chars)) if key is None or not gone(digest(key))]
        return "\n".join(kept), len(lines), len(lines) - len(kept)

    if sure.count() <= broadcast_keys:
        sent = df.sparkSession.sparkContext.broadcast({bytes(r["digest"]): r["keeper"] for r in sure.collect()})  # at most broadcast_keys rows

        def run(batches):
            keepers, missing = sent.value, object()
            for ids, texts in batches:
                out = [without(t, lambda d, i=i: keepers.get(d, missing) not in (missing, i)) for i, t in zip(ids, texts)]
                yield [ids, *([list(c) for c in zip(*out)] or [[], [], []])]

        forget(found)
        forget(sure)
        return map_batches(rows, run, made)
    gone = found.join(sure, "digest").filter(~F.col("id").eqNullSafe(F.col("keeper"))).select(F.col("id").alias("of"), "digest")
    lists = gone.groupBy("of").agg(F.collect_set("digest").alias("gone"))  # no more than the document's lines

    def cut(batches):
        for ids, texts, lists in batches:
            out = [without(t, set(g).__contains__ if g else None) for t, g in zip(texts, lists)]
            yield [ids, *([list(c) for c in zip(*out)] or [[], [], []])]

    joined = rows.join(lists, F.col("id").eqNullSafe(F.col("of")), "left").select("id", "text", "gone")
    return map_batches(joined, cut, made)

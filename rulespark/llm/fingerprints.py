"""Document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes, over a window of 16. A chunk ends where its top bits are zero: eight bits before the normal
size is reached, four after it (normalised chunking), and at the maximum size at the latest. Since a boundary depends only on the
bytes just before it, text that moves keeps its chunks. A fingerprint is the set of chunk digests, each weighted with the bytes it
covers; likeness is weighted containment: the share of the first text's bytes whose chunks the second also has.

Two empty texts are alike (1), an empty and another text are not (0). A null text is empty. The next document is the one with the
next lower id (null ids come last), among equal ids the one with the next lower text; after the last comes the first. One row per
input row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import map_batches, map_rows, pick, schema_of

LEAST, NORMAL, MOST = 16, 64, 256


def gear_table() -> np.ndarray:
    """256 mixed 16-bit values, by the splitmix rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(48)).astype(np.uint16)


GEAR = gear_table()


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks end; the last is the length."""
    size = len(data)
    h = GEAR[np.frombuffer(data, np.uint8)]
    for s in (1, 2, 4, 8):
        if size > s:
            h[s:] += h[:-s] << np.uint16(s)  # the right side is made before it is added
    easy = np.flatnonzero(h < 1 << 12)
    hard = easy[h[easy] < 1 << 8].tolist()
    easy = easy.tolist()
    ends, start = [], 0
    while size - start > LEAST:
        i = bisect_left(hard, start + LEAST - 1)
        if i < len(hard) and hard[i] < start + NORMAL - 1:
            end = hard[i] + 1
        else:
            i = bisect_left(easy, start + NORMAL - 1)
            end = easy[i] + 1 if i < len(easy) and easy[i] < start + MOST - 1 else start + MOST
        if end >= size:
            break
        ends.append(end)
        start = end
    if size:
        ends.append(size)
    return ends


def chunk_weights(text: str) -> dict[int, int]:
    data = text.encode()
    found: dict[int, int] = {}
    start, digest = 0, xxhash.xxh3_64_intdigest
    for end in chunk_ends(data):
        d = digest(data[start:end])
        found[d] = found.get(d, 0) + end - start
        start = end
    return found


#: Code points of a range of ids, on average.
BUCKET = 64_000_000
#: Rows looked at for each range, where ids are no numbers.
SAMPLED = 50
ENTRY = np.dtype([("digest", ">u8"), ("weight", ">u4")])


def to_string(weights: dict[int, int]) -> str:
    return base64.b64encode(np.array(sorted(weights.items()), ENTRY).tobytes()).decode() if weights else ""


def from_string(fingerprint: str) -> dict[int, int]:
    return {int(d): int(w) for d, w in np.frombuffer(base64.b64decode(fingerprint), ENTRY)}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    if not a or not b:
        return float(not a and not b)
    small, other = (a, b) if len(a) <= len(b) else (b, a)
    return sum(min(w, other.get(d, 0)) for d, w in small.items()) / sum(a.values())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_chars``, ``fingerprint`` of every whole text."""
    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(pick(df, id_col, text_col), lambda i, t: (i, len(t), to_string(chunk_weights(t))), schema_of(f"id {kind}, n_chars long, fingerprint string"))


def range_bounds(docs: DataFrame, n: int) -> list:
    """Up to n - 1 ids that cut all rows into parts of about one size. Numbers' quantiles; of other types quantiles of the ``SAMPLED * n`` rows
    that come first by a hash. They say where ranges end, not what is in them."""
    if isinstance(docs.schema["id"].dataType, T.NumericType):
        found = docs.select(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n).alias("b")).head()["b"] or ()
    else:
        rows = docs.filter("id is not null").select("id", F.xxhash64("id", "text").alias("h")).orderBy("h", "id").limit(SAMPLED * n).collect()
        ids = sorted(bytes(r["id"]) if isinstance(r["id"], bytearray) else r["id"] for r in rows)
        found = [ids[i * len(ids) // n] for i in range(1, n)] if ids else ()
    return sorted(set(found))


def in_order(docs: DataFrame) -> DataFrame:
    """``bucket``, ``stop``, ``id``, ``text``: whole ranges of ids in each partition, falling; behind each bucket's rows a stop row with
    the text of the first row after them. Bucket bounds are quantiles of the ids, so no bucket is large; only they are collected."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.length("text").cast("long")).alias("n")).head()["n"] or 0
    n = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))
    bounds = range_bounds(docs, n)
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("id"))) if bounds else F.lit(0)
    docs = docs.withColumn("bucket", bucket).select("bucket", "id", "text")
    heads = docs.groupBy("bucket").agg(F.max("id").alias("id")).collect()
    order = sorted(heads, key=lambda r: -r["bucket"])
    before = {r["bucket"]: order[k - 1]["bucket"] for k, r in enumerate(order)}  # the first follows the last
    if not heads:
        return docs.select("bucket", F.lit(0).alias("stop"), "id", "text")
    names = spark.createDataFrame([(r["bucket"], r["id"], before[r["bucket"]]) for r in heads], f"head_bucket int, head_id {docs.schema['id'].dataType.simpleString()}, target int")
    # one row per bucket
    first = docs.join(F.broadcast(names), (F.col("bucket") == F.col("head_bucket")) & F.col("id").eqNullSafe(F.col("head_id")))
    stops = first.groupBy("target").agg(F.max("text").alias("text")).select(F.col("target").alias("bucket"), F.lit(1).alias("stop"), F.lit(None).cast(docs.schema["id"].dataType).alias("id"), "text")
    rows = docs.select("bucket", F.lit(0).alias("stop"), "id", "text").unionByName(stops)
    return rows.repartition(n, "bucket").sortWithinPartitions(F.col("bucket").desc(), "stop", F.desc_nulls_last("id"), F.desc("text"))


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``."""

    def row(key, text, own, following, next_own):
        changed = edited(text, following)
        theirs = chunk_weights(changed)
        return (key, len(text), hashlib.sha256(changed.encode()).hexdigest(), to_string(own), to_string(theirs), containment(own, theirs), containment(own, next_own))

    def run(batches: Iterator[list[list]]):
        waiting = None
        for _, stops, ids, texts in batches:
            out = []
            for stop, key, text in zip(stops, ids, texts):
                own = chunk_weights(text)
                if waiting is not None:
                    out.append(row(*waiting, text, own))
                waiting = None if stop else (key, text, own)
            if out:
                yield list(zip(*out))

    kind = df.schema[id_col].dataType.simpleString()
    out = schema_of(f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return map_batches(in_order(pick(df, id_col, text_col)), run, out)

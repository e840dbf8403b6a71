"""Near-duplicate documents by HyperMinHash.

A document's set holds the distinct shingles of ``words`` words of its A-Z lower-cased text; with fewer words, the whole sequence is one
shingle; without words the set is empty and linked with nothing. Documents are linked if 100 * intersection >= ``percent`` * union.

1. Documents with equal sets fall into one class by a 128-bit digest of the set; all further steps see a class once.
2. A class gets ``BANDS * ROWS`` registers. A register is, for one of as many hash functions (a bucket with its own permutation, so
   that small sets fill all of them), the leading-zero count of the least hash and the ten mantissa bits after its leading one.
3. Bands of compressed registers put classes into buckets. At a similarity of 0.8 a pair shares no bucket with a probability of 7e-7.
4. In each bucket, all members are held against one hub: first by the share of equal registers, corrected for those equal by chance,
   then those within six deviations of the threshold on their full sets. Hubs with many members are split over tasks, which stream.
   This is done twice, first with the member that meets most others in all its buckets, then with the one that meets fewest. It
   gives most links; large groups of near copies become one component here.
5. Buckets whose members still lie in different components are cut into blocks, and block is held against block within a task. A first
   pass by registers puts out the members that may be similar to one of another component, a second pass on full sets the links
   between those. A pair is looked at in the first band that it shares alone. So no link between components is lost, no pair
   within a component is needed, no bucket is dropped or capped, and what is written are members and links, never all pairs.

Rows: one per input row, repeated ones included. Null text: empty. A row with a null id gets the links of the rows with ids in its class, and a null id is never a
component name unless there is no other. Rows that share an id are rows of their own. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import forget, map_batches, pick, schema_of, stored
from .components import connected_components

ROWS, BANDS = 5, 36
MANTISSA = 10
#: Members, and shingles, of a block at most, on average.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
MEMBERS = 256

_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _odd(n: int, start: int) -> np.ndarray:
    x = np.arange(start, start + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


_PERMUTE = _odd(ROWS * BANDS, 1)
_PLACE = _odd(64, 1000)
_BAND = _odd(ROWS + 1, 2000)


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    parts = text.encode().lower().split()  # of bytes: A-Z alone, and only the six ASCII blanks
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    k = min(words, len(parts))
    n = len(parts) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * _PLACE[i % 64]
        out ^= out >> np.uint64(29)
    return np.unique(out * _MIX)


def registers(s: np.ndarray) -> np.ndarray:
    """Leading-zero count and mantissa bits of the least hash under each function."""
    least = np.full(len(_PERMUTE), np.iinfo(np.uint64).max)
    for i in range(0, len(s), 256):
        np.minimum(least, (s[i : i + 256, None] * _PERMUTE).min(0), out=least)
    mantissa, exponent = np.frexp(least.astype(np.float64) + 1)
    return ((65 - exponent).astype(np.uint16) << np.uint16(MANTISSA)) | ((mantissa - 0.5) * (2 << MANTISSA)).astype(np.uint16)


def band_keys(r: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _BAND[ROWS]
    for i in range(ROWS):
        out = (out ^ r[i::ROWS]) * _BAND[i]
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard from the number of equal registers; registers of unrelated sets are equal with a probability of ``by_chance``."""
    by_chance = 0.7 / (1 << MANTISSA) * n * m / (n + m) ** 2.0
    return (equal / (ROWS * BANDS) - by_chance) / (1 - by_chance)


def _least_estimate(percent: int) -> float:
    p = percent / 100
    return p - 6 * (p * (1 - p) / (ROWS * BANDS)) ** 0.5


def _sketch(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[list[list]]):
        for ids, texts, rows in batches:
            n, digest, regs, bands = [], [], [], []
            for t in texts:
                s = shingle_set(t, words)
                n.append(len(s))
                if len(s):
                    r = registers(s)
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                    regs.append(r.tobytes())
                    bands.append(band_keys(r))
                else:
                    digest.append(None)
                    regs.append(None)
                    bands.append(None)
            yield [ids, rows, n, digest, regs, bands]

    kind = docs.schema["id"].dataType.simpleString()
    return map_batches(docs, run, schema_of(f"id {kind}, row long, n long, class binary, registers binary, bands array<long>"))


def _against_hubs(pairs: DataFrame, data: DataFrame, keep) -> DataFrame:
    """The pairs (``a``: hub, ``b``) that ``keep(hub's n and data, member's n and data)`` holds for. ``data``: ``class``, ``n``, ``data``.
    A hub's data come first in its part of the pairs, then its members stream by."""
    many = pairs.groupBy("a").count().filter(F.col("count") > MEMBERS)
    salted = pairs.join(many, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce(F.ceil(F.col("count") / MEMBERS), F.lit(1))))
    salted = salted.select("a", "salt", "b")
    members = salted.join(data.withColumnRenamed("class", "b"), "b").select("a", "salt", "b", "n", "data")
    hubs = salted.select("a", "salt").distinct().join(data.withColumnRenamed("class", "a"), "a").select("a", "salt", F.lit(None).cast("binary").alias("b"), "n", "data")
    rows = hubs.unionByName(members).repartition(F.col("a"), F.col("salt")).sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))

    def run(batches: Iterator[list[list]]):
        hub = None
        for a, _, b, n, d in batches:
            out: list[list] = [[], []]
            for x, y, size, blob in zip(a, b, n, d):
                if y is None:
                    hub = size, blob
                elif keep(*hub, size, blob):
                    out[0].append(x)
                    out[1].append(y)
            yield out

    return map_batches(rows, run, schema_of("a binary, b binary"))


def _registers_agree(percent: int):
    least = _least_estimate(percent)

    def keep(n, r, m, q):
        equal = np.count_nonzero(np.frombuffer(r, np.uint16) == np.frombuffer(q, np.uint16))
        return 100 * min(n, m) >= percent * max(n, m) and estimate(equal, n, m) >= least

    return keep


def _sets_agree(percent: int):
    def keep(n, s, m, q):
        both = len(np.intersect1d(np.frombuffer(s, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True))
        return 100 * both >= percent * (n + m - both)

    return keep


class _Linker:
    def __init__(self, docs: DataFrame, classes: DataFrame, words: int, percent: int):
        self.docs, self.classes, self.words, self.percent = docs, classes, words, percent
        self.links: list[DataFrame] = []

    def sets(self, wanted: DataFrame) -> DataFrame:
        """``class``, ``n``, ``data``: full sets, made again from the texts with the row key of one document for each class; texts of other
        classes that bear it too are left out by their digest."""
        wanted = stored(wanted, "wanted")
        one = self.classes.join(wanted, "class", "left_semi").select("row")
        words = self.words

        def run(batches: Iterator[list[list]]):
            for _, texts, _ in batches:
                sets = [shingle_set(t, words) for t in texts]
                yield [[xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [len(s) for s in sets], [s.tobytes() for s in sets]]

        sets = map_batches(self.docs.join(one, "row", "left_semi").select("id", "text", "row"), run, schema_of("class binary, n long, data binary"))
        sets = stored(sets.join(wanted, "class", "left_semi").dropDuplicates(["class"]), "sets")
        forget(wanted)
        return sets

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of the pairs, on full sets."""
        pairs = stored(pairs, "candidates")
        sets = self.sets(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct())
        found = stored(_against_hubs(pairs, sets, _sets_agree(self.percent)), "links")
        forget(pairs)
        forget(sets)
        return found

    def components(self) -> DataFrame:
        """``class``, ``component`` of the linked classes."""
        edges = self.links[0]
        for more in self.links[1:]:
            edges = edges.union(more)
        return connected_components(edges).withColumnRenamed("node", "class")

    def labelled(self, buckets: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components."""
        rows = buckets.withColumn("component", F.col("class"))
        if self.links:
            rows = buckets.join(self.components(), "class", "left").withColumn("component", F.coalesce("component", "class"))
        several = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
        return stored(rows.select(*buckets.columns, "component").join(several, "key", "left_semi"), "open")

    def registers(self) -> DataFrame:
        return self.classes.select("class", "n", F.col("registers").alias("data"))

    def with_hubs(self, members: DataFrame, pick_hub) -> None:
        hubs = members.groupBy("key").agg(pick_hub(F.struct("met", "class", "component")).alias("h"))
        pairs = members.join(hubs, "key").filter("h.component <> component").select(F.col("h.class").alias("a"), F.col("class").alias("b")).distinct()
        self.links.append(self.verified(_against_hubs(pairs, self.registers(), _registers_agree(self.percent))))

    def between_blocks(self, members: DataFrame) -> None:
        sizes = members.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
        rows = members.join(self.registers().drop("n"), "class").join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "band", "class", "component", "n", F.col("data").alias("registers"))
        may = stored(_block_by_block(rows, _may_link(self.percent), rows.schema), "maybe")
        sets = self.sets(may.select("class").distinct())
        links = _block_by_block(may.join(sets.select("class", "data"), "class").select(*may.columns, "data"), _links(self.percent), schema_of("a binary, b binary"))
        self.links.append(stored(links.distinct(), "links"))
        forget(may)
        forget(sets)


def _block_by_block(rows: DataFrame, of_group, schema) -> DataFrame:
    """``of_group`` turns the rows of a block, or of two blocks, of a bucket into output rows."""
    names = rows.columns
    rows = rows.repartition(F.col("key"), F.col("lo"), F.col("hi")).sortWithinPartitions("key", "lo", "hi").select(*names)

    def run(batches: Iterator[list[list]]):
        group: list[tuple] = []
        for cols in batches:
            out = []
            for row in zip(*cols):
                if group and row[:3] != group[0][:3]:
                    out += of_group(group)
                    group = []
                group.append(row)
            if out:
                yield list(zip(*out))
        if group and (out := list(of_group(group))):
            yield list(zip(*out))

    return map_batches(rows, run, schema)


def _maybe_pairs(group: list[tuple], percent: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Each left member with the right members of other components that may be similar and that meet it in this band first. Rows: key, lo,
    hi, block, band, class, component, n, registers, ..."""
    _, lo, hi, _, band = group[0][:5]
    least = _least_estimate(percent)
    left = [g for g in group if g[3] == lo]
    right = [g for g in group if g[3] == hi] if hi != lo else left
    if not right:
        return
    regs = np.array([np.frombuffer(g[8], np.uint16) for g in right])
    n = np.array([g[7] for g in right])
    names = {c: i for i, c in enumerate(dict.fromkeys(g[6] for g in group))}
    component = np.array([names[g[6]] for g in right])
    for i, g in enumerate(left):
        at = component != names[g[6]]
        if hi == lo:
            at[: i + 1] = False
        at = np.flatnonzero(at & (100 * np.minimum(n, g[7]) >= percent * np.maximum(n, g[7])))
        if not len(at):
            continue
        equal = regs[at] == np.frombuffer(g[8], np.uint16)
        near = estimate(equal.sum(1), g[7], n[at]) >= least
        at, equal = at[near], equal[near]
        if len(at):
            bands = equal.reshape(len(at), BANDS, ROWS).all(2)
            at = at[bands[:, band] & (bands.argmax(1) == band)]
            if len(at):
                yield g, [right[j] for j in at]


def _may_link(percent: int):
    def of_group(group):
        found: dict[bytes, tuple] = {}
        for g, others in _maybe_pairs(group, percent):
            found[g[5]] = g
            found |= {o[5]: o for o in others}
        return found.values()

    return of_group


def _links(percent: int):
    agree = _sets_agree(percent)

    def of_group(group):
        for g, others in _maybe_pairs(group, percent):
            for o in others:
                if agree(g[7], g[9], o[7], o[9]):
                    yield min(g[5], o[5]), max(g[5], o[5])

    return of_group


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id`` (least id reachable), ``kept`` (the row bears that id)."""
    docs = pick(df, id_col, text_col).withColumn("row", F.xxhash64("id", "text"))  # never null, as ids may be
    sketched = stored(_sketch(docs, words), "sketches")
    classes = stored(sketched.filter("class is not null").groupBy("class").agg(F.min("id").alias("id"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("registers").alias("registers"), F.first("bands").alias("bands")), "classes")
    banded = classes.select(F.posexplode("bands").alias("band", "key"), "class", "n")
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = stored(banded.join(shared, "key"), "buckets")
    met = buckets.groupBy("class").agg(F.sum("size").alias("met"))
    buckets = buckets.drop("size").join(met, "class")
    link = _Linker(docs, classes, words, percent)
    for pick_hub in (F.max, F.min):
        members = link.labelled(buckets)
        link.with_hubs(members, pick_hub)
        forget(members)
    members = link.labelled(buckets)
    link.between_blocks(members)
    components = link.components()
    forget(members)
    named = classes.select("class", "id").join(components, "class", "left").select("class", "id", F.coalesce("component", "class").alias("component"))
    names = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = stored(named.join(names, "component").select("class", "component_id"), "components")
    rows = sketched.select("id", F.col("n").alias("n_shingles"), "class").join(named, "class", "left")
    rows = rows.select("id", "n_shingles", F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return rows.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))

"""Alignment of two tokenizers' tokens in each text: groups, links, and corpus-wide counts of linked ids.

A is a byte-level BPE vocabulary of ``tokenizers`` (it gets a space and the text), B a sentence-piece model (which adds the space itself). A token ends
at a byte; where A and B both end, a group ends. A link is a pair of occurrences whose bytes overlap.

1. Event tables: each text is encoded by both sides without special tokens (their strings are plain text), and the token ends become events: rows (document,
   offset, side, ids) that hold a run of ``BLOCK`` tokens in offset order, whose ends follow from the ids. Runs keep what is shuffled near two bytes an event.
2. The union of both sides' events is repartitioned by document, sorted within partitions by offset and streamed through a state machine. Its state is one
   open group and the run it is in, on either side, however long the document. It emits each document's counts, digest of groups and links.
3. Links of all documents are counted by id pair, in each task first. Pairs are bounded by the vocabularies and few in practice: up to ``broadcast_pairs`` go to all
   tasks; beyond that documents' distinct pairs are joined to the counts instead, with the same result.

Encoders see words once: a text is cut at single spaces that stand between a word's end and a next word's beginning, where neither side has a token across (this is
checked against the vocabulary of B; otherwise texts are encoded whole), and the ids of recent words are remembered.

Rows: one per input row, repeated rows too, whatever their ids; a document is a row. Null and empty texts, and those whose tokens' bytes on either
side don't join to the text with its space, have no tokens: zeros and an empty digest. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, pick, schema_of, shipped, stored
from .token_counts import byte_letters

#: Tokens in a row of events, and words whose ids a worker remembers (twice).
BLOCK, REMEMBERED = 1 << 14, 150_000
#: Characters that a task encodes at a time.
TAKEN = 1 << 20
BROADCAST_PAIRS = 1 << 22
HELD_PAIRS = 1 << 20


def default_a() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def default_b() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


#: A space that no word follows, or a text that doesn't begin with a word.
_ODD = re.compile(r"(?:\A| )(?:\s|\Z)")
#: The pre-tokenizer of byte-level BPE, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def words_of(text: str) -> list[str]:
    """The text cut at single spaces that a word's first character follows and no space goes before; the cuts' spaces are left out."""
    parts = text.split(" ")
    if not _ODD.search(text):
        return parts
    out, before = parts[:1], parts[0]
    for p in parts[1:]:
        if p and before and not p[0].isspace():
            out.append(p)
        else:
            out[-1] += " " + p
        before = p
    return out


class Encoders:
    """Both sides' ids of texts, as little-endian 16- or 32-bit numbers."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        byte = {c: i for i, c in enumerate(byte_letters())}
        self.a_bytes = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)
        self.quick = self.ranked(a)
        self.kind = np.dtype("<u2" if max(max(self.a_bytes), max(self.b_bytes)) < 1 << 16 else "<u4")
        self.sizes = self.lengths()
        self.known: dict[str, tuple[bytes, bytes, bool]] = {}
        self.older: dict[str, tuple[bytes, bytes, bool]] = {}

    def ranked(self, path: str):
        """The same vocabulary for a faster encoder, if it is plain byte-level BPE whose merges are in the order of their ids; else None."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        merged = [model["vocab"].get(x + y, -1) for x, y in pairs]
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec["normalizer"]
        if not plain or merged != sorted(set(merged)) or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        ranks = {self.a_bytes[i]: i for t, i in model["vocab"].items() if t not in special}
        if len(ranks) != len(merged) + 256 or min(merged) <= max(i for t, i in model["vocab"].items() if t not in special and len(t) == 1):
            return None
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for own in (self.a_bytes, self.b_bytes):
            sizes = np.zeros(max(own) + 1, np.int64)
            sizes[list(own)] = [len(v) for v in own.values()]
            out.append(sizes)
        return tuple(out)

    def learn(self, words: list[str]) -> dict[str, tuple[bytes, bytes, bool]]:
        """Ids of words, and whether their bytes are the words'. Ordinary words of old scripts, on which all versions of Unicode agree, are encoded as
        one text and cut apart by their bytes; others one by one."""
        made = {}
        usual = [w for w in words if w and not w[0].isspace() and w[-1] != " " and max(w) < "\u0250"] if self.quick and self.by_word else []
        if usual:
            line = " " + " ".join(usual)
            ends = np.cumsum([len(w.encode()) + 1 for w in usual])
            sides = []
            for side, ids in enumerate((self.quick.encode_ordinary(line), self.b.encode(line[1:], num_threads=1))):
                at = np.cumsum(self.sizes[side][ids])
                cut = np.searchsorted(at, ends)
                if not (at[-1] == ends[-1] and (at[np.minimum(cut, len(at) - 1)] == ends).all()):
                    sides = []
                    break
                blob, width = np.array(ids, self.kind).tobytes(), self.kind.itemsize
                cut = ((cut + 1) * width).tolist()
                sides.append([blob[x:y] for x, y in zip([0, *cut], cut)])
            if sides:
                whole = line.encode()
                byte = [b"".join(map(own.__getitem__, np.frombuffer(b"".join(side), self.kind).tolist())) for own, side in zip((self.a_bytes, self.b_bytes), sides)]
                if byte[0] == byte[1] == whole:
                    made = {w: (x, y, True) for w, x, y in zip(usual, *sides)}
        rest = [w for w in words if w not in made]
        both = zip(rest, self.a.encode_batch([" " + w for w in rest], add_special_tokens=False), self.b.encode(rest, num_threads=1)) if rest else ()
        for w, a, b in both:
            whole = (" " + w).encode()
            fits = b"".join(map(self.a_bytes.__getitem__, a.ids)) == whole == b"".join(map(self.b_bytes.__getitem__, b))
            made[w] = np.array(a.ids, self.kind).tobytes(), np.array(b, self.kind).tobytes(), fits
        return made

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """None: the tokens' bytes aren't the text's, or the text is empty."""
        cut = [words_of(t) if self.by_word else [t] for t in texts]
        known, older, new = self.known, self.older, []
        for w in set(chain.from_iterable(cut)).difference(known):
            if (seen := older.get(w)) is None:
                new.append(w)
            else:
                known[w] = seen
        if new:
            known.update(self.learn(new))
        out = []
        for text, own in zip(texts, cut):
            a, b, fit = zip(*map(known.__getitem__, own))
            a, b = b"".join(a), b"".join(b)
            out.append((a, b) if text and (all(fit) or self.joined(a, b, text)) else None)
        for w in new:
            if len(w) > 64:
                del known[w]
        if len(known) > REMEMBERED:
            self.known, self.older = {}, known
        return out

    def joined(self, a: bytes, b: bytes, text: str) -> bool:
        whole = (" " + text).encode()
        return all(b"".join(map(own.__getitem__, np.frombuffer(ids, self.kind).tolist())) == whole for own, ids in ((self.a_bytes, a), (self.b_bytes, b)))


@cache
def encoders(a: str, b: str) -> Encoders:
    return Encoders(a, b)


def in_turns(batches: Iterator[list[list]]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, about a million characters at a time."""
    for ids, texts in batches:
        at = 0
        ends = np.cumsum([len(t) for t in texts])
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TAKEN, "right")))
            yield ids[at:end], texts[at:end]
            at = end


EVENTS = "doc long, offset long, side int, ids binary, id {0}"


def events(rows: DataFrame, a, b) -> DataFrame:
    """Both sides' events of all documents; a row of offset -1 for each document has its id."""

    def run(batches: Iterator[list[list]]):
        own = encoders(a(), b())
        lengths = own.sizes
        shrink = zstandard.ZstdCompressor(level=3).compress
        doc = TaskContext.get().partitionId() << 40
        for ids, texts in in_turns(batches):
            out = []
            for i, got in zip(ids, own.encode(texts)):
                doc += 1
                out.append((doc, -1, 0, None, i))
                for side, blob in enumerate(got or ()):
                    tokens = np.frombuffer(blob, own.kind)
                    ends = lengths[side][tokens].cumsum()
                    for k in range(0, len(tokens), BLOCK):
                        out.append((doc, int(ends[k - 1]) if k else 0, side, shrink(tokens[k : k + BLOCK].tobytes()), None))
            yield list(zip(*out)) if out else [[] for _ in range(5)]

    return map_batches(rows, run, schema_of(EVENTS.format(rows.schema["id"].dataType.simpleString())))


class Sweep:
    """One document's events in order of their offsets. Tokens wait until both sides have ended at the same byte."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray], kind: np.dtype):
        self.lengths, self.kind = lengths, kind
        n_a, n_b = map(len, lengths)
        spell = lambda n, mark: [b"%d%s" % (i, mark) for i in range(n)]
        self.spelt = spell(n_a, b",") + spell(n_a, b"|") + spell(n_b, b",") + spell(n_b, b";")

    def start(self, i) -> None:
        self.id = i
        self.ids = [np.zeros(0, np.int64)] * 2
        self.ends = [np.zeros(0, np.int64)] * 2
        self.at = [0, 0]
        self.counts = np.zeros(4, np.int64)
        self.sha, self.open = hashlib.sha256(), b""
        self.links: list[np.ndarray] = []

    def add(self, side: int, ids: np.ndarray) -> None:
        ids = ids.astype(np.int64)
        ends = self.at[side] + self.lengths[side][ids].cumsum()
        self.at[side] = int(ends[-1])
        self.ids[side] = np.concatenate([self.ids[side], ids])
        self.ends[side] = np.concatenate([self.ends[side], ends])
        ea, eb = self.ends
        if len(ea) and len(eb):
            common = ea[eb[np.minimum(np.searchsorted(eb, ea), len(eb) - 1)] == ea]
            if len(common):
                self.close(common[np.append(True, common[1:] != common[:-1])])

    def close(self, common: np.ndarray) -> None:
        n = [int(np.searchsorted(e, common[-1], "right")) for e in self.ends]
        (a, b), (ea, eb) = [x[:k] for x, k in zip(self.ids, n)], [x[:k] for x, k in zip(self.ends, n)]
        self.ids, self.ends = [x[k:] for x, k in zip(self.ids, n)], [x[k:] for x, k in zip(self.ends, n)]
        sa, sb = ea - self.lengths[0][a], eb - self.lengths[1][b]
        low, high = np.searchsorted(eb, sa, "right"), np.searchsorted(sb, ea, "left")
        each = high - low  # a token overlaps a run of the other side's
        i = np.repeat(np.arange(len(a)), each)
        j = np.arange(len(i)) - np.repeat(each.cumsum() - each, each) + np.repeat(low, each)
        self.links.append(np.stack([a[i], b[j]], 1).astype(self.kind))
        self.counts += (len(a), len(b), len(common), len(i))
        ga, gb = np.searchsorted(common, ea), np.searchsorted(common, eb)
        last = lambda g: np.append(g[1:] != g[:-1], True)
        n_a, n_b = map(len, self.lengths)
        order = np.zeros(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.searchsorted(gb, ga)] = a + n_a * last(ga)
        order[np.arange(len(b)) + np.searchsorted(ga, gb, "right")] = 2 * n_a + b + n_b * last(gb)
        text = b"".join(map(self.spelt.__getitem__, order.tolist()))
        self.sha.update(self.open + text[:-1])
        self.open = b";"

    def row(self) -> tuple:
        if len(self.ids[0]) or len(self.ids[1]):
            raise ValueError("a document's sides end apart")
        blob = zstandard.compress(np.concatenate(self.links).tobytes(), 3) if self.links else None
        return (self.id, *self.counts.tolist(), self.sha.hexdigest() if self.counts[2] else "", blob)


DOCUMENTS = "id {0}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def swept(found: DataFrame, a, b) -> DataFrame:
    """One row per document: counts, digest of groups, and the links as pairs of ids (:func:`links_of`)."""
    kind = found.schema["id"].dataType.simpleString()

    def run(batches: Iterator[list[list]]):
        own = encoders(a(), b())
        machine, begun = Sweep(own.sizes, own.kind), False
        grow = zstandard.ZstdDecompressor().decompress
        for _, offsets, sides, blobs, ids in batches:
            out = []
            for offset, side, blob, i in zip(offsets, sides, blobs, ids):
                if offset < 0:
                    if begun:
                        out.append(machine.row())
                    machine.start(i)
                    begun = True
                else:
                    machine.add(side, np.frombuffer(grow(blob), own.kind))
            yield list(zip(*out)) if out else [[] for _ in range(7)]
        if begun:
            yield [[v] for v in machine.row()]

    dealt = found.repartition("doc").sortWithinPartitions("doc", "offset", "side")
    return map_batches(dealt, run, schema_of(DOCUMENTS.format(kind)))


def links_of(blob: bytes | None, kind: np.dtype) -> np.ndarray:
    """The id pairs of a document's links as numbers, A's id in the upper 32 bits."""
    if blob is None:
        return np.zeros(0, np.int64)
    pairs = np.frombuffer(zstandard.decompress(blob), kind).reshape(-1, 2).astype(np.int64)
    return pairs[:, 0] << 32 | pairs[:, 1]


def pair_counts(documents: DataFrame, kind: np.dtype) -> DataFrame:
    """``pair``, ``n``: how many links of the corpus hold each id pair."""

    def run(batches: Iterator[list[list]]):
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for (blobs,) in batches:
            codes = np.concatenate([links_of(x, kind) for x in blobs] or [pairs[:0]])
            new, n = np.unique(codes, return_counts=True)
            pairs, at = np.unique(np.concatenate([pairs, new]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(pairs)).astype(np.int64)  # exact below 2**53
            if len(pairs) > HELD_PAIRS:
                yield [pairs.tolist(), counts.tolist()]
                pairs, counts = pairs[:0], counts[:0]
        yield [pairs.tolist(), counts.tolist()]

    return map_batches(documents.select("links"), run, schema_of("pair long, n long")).groupBy("pair").agg(F.sum("n").alias("n"))


def align(df: DataFrame, a: str | None = None, b: str | None = None, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair is the most frequent of their B id, ties included), ``count_sum`` (of the
    pairs' counts over links), ``groups_sha256``, ``links``."""
    spark = df.sparkSession
    a, b = shipped(spark, a, default_a), shipped(spark, b, default_b)
    kind = encoders(a(), b()).kind
    documents = stored(swept(events(pick(df, id_col, text_col), a, b), a, b), "aligned")
    spark.sparkContext._jvm.System.gc()  # Spark deletes the events' shuffle files once the driver's collector has found them unused
    counts = stored(pair_counts(documents, kind), "pairs")
    best = counts.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("n").alias("best"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)).join(best, "b").select("pair", "n", (F.col("n") == F.col("best")).alias("best"))
    own = [c for c in documents.columns if c != "links"]
    made = schema_of(f"{DOCUMENTS.format(documents.schema['id'].dataType.simpleString())}, n_best long, count_sum long")
    if counts.count() <= broadcast_pairs:
        rows = counts.orderBy("pair").collect()  # at most broadcast_pairs
        sent = spark.sparkContext.broadcast(tuple(np.array([r[k] for r in rows], np.int64) for k in range(3)))

        def run(batches):
            pairs, n, best = sent.value
            for *cols, blobs in batches:
                sums, bests = [], []
                for blob in blobs:
                    at = np.searchsorted(pairs, links_of(blob, kind))
                    sums.append(int(n[at].sum()))
                    bests.append(int(best[at].sum()))
                yield [*cols, blobs, bests, sums]

        return map_batches(documents, run, made)

    def distinct(batches):
        for docs, blobs in batches:
            out = []
            for d, blob in zip(docs, blobs):
                out += [(d, p, k) for p, k in zip(*(x.tolist() for x in np.unique(links_of(blob, kind), return_counts=True)))]
            yield list(zip(*out)) if out else [[], [], []]

    numbered = stored(documents.withColumn("doc", F.monotonically_increasing_id()), "numbered")
    held = map_batches(numbered.select("doc", "links"), distinct, schema_of("doc long, pair long, k long")).join(counts, "pair")
    sums = held.groupBy("doc").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
    return numbered.join(sums, "doc", "left").select(*own, "links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"))

"""Exact token counts at every prefix of a text, by dynamic programming, for a lower-casing word-end BPE vocabulary.

A token sequence is what BPE makes of a string exactly if each adjacent pair of its tokens is what BPE makes of that pair's own
string. So the last token of each prefix of a word is found from the last tokens of shorter prefixes: among the vocabulary tokens
that end the prefix, it is the one compatible with the last token before it; and the count is that prefix's plus one. A text's
prefix counts are its pieces' counts in a row, since the pre-tokenizer cuts from the left and a cut later in the text changes no
earlier piece.

The counts are held as steps: one signed byte per code point, whose running sum is the count at that prefix (:func:`counts_at`).
With them :func:`longest_prefix` answers how much of the text fits a budget, without encoding again.

Rows: one per input row. A null text is empty and has 0 tokens. Control strings of the vocabulary inside a text count as one token,
the library's default. Repeated rows stay repeated; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_batches, pick, schema_of, shipped

#: Words, and chunks between white space, whose steps a worker remembers; beyond that it keeps as many older ones and starts anew.
REMEMBERED = 250_000
#: White space other than the plain space, one code point at a time.
SPACE = regex.compile(r"[\p{White_Space}--\x20]", regex.V1)
LETTERS, SIGNS = regex.compile(r"\p{L}+"), regex.compile(r"[^\p{White_Space}\p{L}\p{N}]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def byte_letters() -> list[str]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 bytes stand for themselves, the others for 256 onward."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@cache
def joining() -> frozenset[str]:
    """Code points of combining class 0 that may compose with one before them: second parts of canonical decompositions, and Hangul vowels and finals."""
    found = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split(" ")
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


def segments(part: str) -> list[str]:
    """The text cut before each code point that no normal form joins with what is before it."""
    may = joining()
    cuts = [i for i, ch in enumerate(part) if i == 0 or ch < "\u0300" or not (ch in may or unicodedata.combining(ch))]
    return [part[a:b] for a, b in zip(cuts, [*cuts[1:], len(part)])]


def prefixes(segment: str, normal) -> Iterator[tuple[int, str | None]]:
    """(length of the normal form, None) of each prefix of a segment whose normal form is a prefix of the segment's, and (0, normal form) of others. A
    mark of the class of the last one there is only put behind; so only runs of marks of mixed classes are normalised again for each prefix."""
    whole = normal(segment)
    own, fits = "", True
    for k, ch in enumerate(segment, 1):
        c = unicodedata.combining(ch)
        if own and c and c == unicodedata.combining(own[-1]) and unicodedata.is_normalized("NFC", ch):
            more = normal(ch)
            fits = fits and whole.startswith(more, len(own))
            own += more
        else:
            own = normal(segment[:k])
            fits = whole.startswith(own)
        yield (len(own), None) if fits else (0, own)


class PrefixCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab = model["vocab"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        words = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        words = words.replace("\\s", r"\p{White_Space}")
        self.split = regex.compile(words)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.letters = byte_letters()
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocab)
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {"": b""}
        self.older: list[dict[str, bytes]] = [{}, {}]
        self.pair_ok: dict[tuple[str, str], bool] = {}
        self.states: dict[tuple[str, bool], tuple] = {}
        self.made = {t: self.last_merge(t) for t in self.vocab}
        #: Ends of tokens: a longer end of a text can only be a token if this end of it is the end of one.
        self.suffixes = {t[i:] for t in self.vocab for i in range(len(t.removesuffix(self.end)))}

    def symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            own = list(token[: -len(self.end)])
            return [*own[:-1], own[-1] + self.end]
        return list(token)

    def last_merge(self, token: str) -> tuple | None:
        """The last merge (left, right, rank) with which BPE makes this token of its own string; rank -1 for a single symbol; None if it doesn't."""
        rank, symbols, step = self.rank, self.symbols(token), ("", "", -1)
        while len(symbols) > 1:
            ranks = [rank.get(p, 1 << 60) for p in zip(symbols, symbols[1:])]
            low = min(ranks)
            if low == 1 << 60:
                return None
            i = ranks.index(low)
            step = symbols[i], symbols[i + 1], low
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return step

    def fits(self, left: str, right: str) -> bool:
        """Whether BPE leaves these two standing tokens side by side. Undoes their merges from the last one on: none of the symbols that
        met at the border on the way may have had a merge of their own that was due earlier than the one that took them away."""
        rank, made = self.rank, self.made
        if (left, right) in rank:
            return False
        a, b = made[left], made[right]
        while a[2] >= 0 or b[2] >= 0:
            if b[2] >= a[2]:  # of equal merges the left one comes first, so the right one is undone first
                right, due = b[0], b[2]
                if rank.get((left, right), 1 << 60) <= due:
                    return False
                b = made[right]
            else:
                left, due = a[1], a[2]
                if rank.get((left, right), 1 << 60) < due:
                    return False
                a = made[left]
        return True

    def word_steps(self, word: str) -> bytes:
        """Steps between the token counts of a piece's first 0, 1, 2, ... code points, each cut taken as a word of its own."""
        return Walk(self).go_on(word)

    def piece_steps(self, piece: str) -> bytes:
        """A cut inside a contraction leaves other pieces; those are counted anew."""
        found = self.words.get(piece) or self.older[0].get(piece)
        if found is not None:
            return found
        if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():
            counts = [0] + [sum(sum(self.word_steps(x)) for x in self.split.findall(piece[:k])) for k in range(1, len(piece) + 1)]
            found = bytes((b - a) & 255 for a, b in zip(counts, counts[1:]))
        else:
            found = self.word_steps(piece)
        if len(piece) <= 64:
            if len(self.words) >= REMEMBERED:
                self.older[0], self.words = self.words, {}
            self.words[piece] = found
        return found

    def steps(self, chunk: str) -> bytes:
        """The steps of a normal form's chunk between white space, without control strings."""
        found = self.older[1].get(chunk)
        if found is None:
            found = self.piece_steps(chunk) if chunk.isalpha() else b"".join(map(self.piece_steps, self.split.findall(chunk)))
        if len(chunk) <= 64:
            if len(self.chunks) >= REMEMBERED:
                self.older[1], self.chunks = self.chunks, {"": b""}
            self.chunks[chunk] = found
        return found

    def text_steps(self, text: str) -> np.ndarray:
        """One step per code point of the text."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        out = []
        for i, part in enumerate(self.cut.split(text)):
            if i % 2 == 0:
                out.append(self._plain(part))
            else:  # cut short, a control string is ordinary text
                counts = [int(self._plain(part[:k]).sum(dtype=np.int64)) for k in range(len(part))] + [1]
                out.append(np.diff(counts).astype(np.int8))
        return np.concatenate(out)

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(map(str.lower, text))

    def _plain(self, text: str) -> np.ndarray:
        low = self.normal(text)
        if text.isascii() or len(low) == len(text) and unicodedata.is_normalized("NFC", text):
            return self._normal_steps(low)
        return self._source_steps(text)

    def _normal_steps(self, low: str) -> np.ndarray:
        chunks = SPACE.sub(" ", low).split(" ")
        got = list(map(self.chunks.get, chunks))
        if None in got:
            got = [self.steps(c) if g is None else g for c, g in zip(chunks, got)]
        return np.frombuffer(b"\0".join(got), np.int8)

    def _source_steps(self, text: str) -> np.ndarray:
        """Of a text whose normal form has other code points: cut at white space, so each part is normalised alone."""
        out = []
        for part in regex.findall(r"\p{White_Space}+|\P{White_Space}+", text):
            low = self.normal(part)
            if len(low) == len(part) and unicodedata.is_normalized("NFC", part):
                out.append(self._normal_steps(low))
            else:
                out.append(np.diff(self._part_counts(part, low)).astype(np.int8))
        return np.concatenate(out) if out else np.zeros(0, np.int8)

    def _part_counts(self, part: str, low: str) -> list[int]:
        """Counts at the prefixes of a part between white space. The normal form of most prefixes is a prefix of the normal form, whose counts
        are read off; one that ends inside a sequence of combining marks differs from it in its last letters alone, and only those are walked anew."""
        at = np.concatenate([[0], np.cumsum(self._normal_steps(low), dtype=np.int64)])
        counts, done, ends = [0], 0, []
        for segment in segments(part):
            for n, own in prefixes(segment, self.normal):
                if own is not None:
                    ends.append((len(counts), done, own))
                counts.append(int(at[done + n]))
            done += n
        if ends:
            pieces = [m.span() for m in self.split.finditer(low)]
            p, walk, walked = 0, None, -1
            for k, done, own in ends:  # in order
                while p < len(pieces) and pieces[p][1] < done:
                    p += 1
                start = pieces[p][0] if done and p < len(pieces) else done
                if 0 < p < len(pieces) and done - start <= 2 and low[slice(*pieces[p - 1])] == "'":
                    start -= 1  # it may become a contraction
                if done - start <= 64:
                    counts[k] = int(at[start]) + sum(sum(self._signed(self.piece_steps(x))) for x in self.split.findall(low[start:done] + own))
                else:  # a long run of letters, or of signs; what goes on with it and what doesn't
                    if walked != p:
                        walk, walked = Walk(self), p
                        walk.go_on(low[pieces[p][0] : pieces[p][1]])
                    kind = LETTERS if LETTERS.match(low[done - 1]) else SIGNS
                    joined = m[0] if (m := kind.match(own)) else ""
                    rest = sum(sum(self._signed(self.piece_steps(x))) for x in self.split.findall(own[len(joined) :]))
                    counts[k] = int(at[start]) + walk.count_with(done - start, joined) + rest
        return counts

    @staticmethod
    def _signed(steps: bytes) -> list[int]:
        return np.frombuffer(steps, np.int8).tolist()


class Walk:
    """The dynamic program along one piece: behind each letter the last token and the count."""

    def __init__(self, counter: PrefixCounter):
        self.own = counter
        self.tokens, self.counts = [""], [0]
        self.raw, self.from_start, self.last = "", True, 0
        self.finals, self.letters = [0], [0]  # by code point: the count of the piece cut there, and its letters

    def go_on(self, word: str) -> bytes:
        """Walks on over more code points; gives their steps."""
        own = self.own
        made, end, ok, states, suffixes = own.made, own.end, own.pair_ok, own.states, own.suffixes
        raw = "".join([own.letters[b] for b in word.encode()]) if not (word.isascii() and word.isprintable()) else word
        ends = None
        base = len(self.raw)
        if len(raw) != len(word):
            ends, n = set(), base
            for ch in word:
                n += len(ch.encode())
                ends.add(n)
        tokens, counts = self.tokens, self.counts
        line = self.raw = self.raw + raw
        steps, before = bytearray(), self.finals[-1]
        for n in range(base + 1, len(line) + 1):
            whole = ends is None or n in ends
            key = (line[:n], whole) if self.from_start and n <= 64 else None
            if key is None or (last := states.get(key)) is None:
                found = []
                for suffix in ("", end) if whole else ("",):
                    for start in range(n - 1, max(-1, n - own.longest - 1), -1):
                        token = line[start:n] + suffix
                        if token not in suffixes:
                            start = -1
                            break
                        if made.get(token):
                            if start == 0 and self.from_start:
                                break
                            pair = tokens[start], token
                            if (fit := ok.get(pair)) is None:
                                if len(ok) > 500_000:
                                    ok.clear()
                                fit = ok[pair] = own.fits(*pair)
                            if fit:
                                break
                    else:
                        start = -1
                    if start < 0:
                        raise ValueError(f"no token ends {line[max(0, n - 64) : n]!r}")
                    found.append((token, counts[start] + 1))
                last = *found[0], found[-1][1]  # token and count inside the word, count at its end
                if key is not None:
                    if len(states) > 2 * REMEMBERED:
                        states.clear()
                    states[key] = last
            if whole:
                steps.append((last[2] - before) & 255)
                before = self.last = last[2]
                self.finals.append(before)
                self.letters.append(n)
            tokens.append(last[0])
            counts.append(last[1])
        return bytes(steps)

    def count_with(self, n: int, more: str) -> int:
        """The count of the piece's first n code points with others behind them, walked on from a copy of what is less than a token before."""
        if not more:
            return self.finals[n]
        base = self.letters[n]
        low = max(0, base - self.own.longest - 1)
        part = Walk(self.own)
        part.tokens, part.counts = self.tokens[low : base + 1], self.counts[low : base + 1]
        part.raw, part.from_start = self.raw[low:base], low == 0
        part.go_on(more)
        return part.last


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def pack(steps: np.ndarray) -> bytes:
    return zlib.compress(steps.astype(np.int8).tobytes(), 1)


@lru_cache(8)
def counts_at(packed: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2, ... code points."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(zlib.decompress(packed), np.int8), dtype=np.int64)])


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix with at most ``budget`` tokens; counts can fall again, so all are looked at."""
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


def prefix_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``id``, ``n_tokens``, ``steps`` (see :func:`counts_at`): the count at every prefix of every text."""
    path = shipped(df.sparkSession, vocabulary, default_vocabulary)

    def run(batches: Iterator[list[list]]):
        count = counter(path())
        for ids, texts in batches:
            made = [count.text_steps(t) for t in texts]
            yield [ids, [int(m.sum(dtype=np.int64)) for m in made], [pack(m) for m in made]]

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(pick(df, id_col, text_col), run, schema_of(f"id {kind}, n_tokens long, steps binary"))


def token_budget(df: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``id``, ``n_bytes``, ``n_tokens``, ``over_limit``, ``fits_chars`` (the longest prefix within the limit), all read off the prefix counts."""
    path = shipped(df.sparkSession, vocabulary, default_vocabulary)

    def run(batches: Iterator[list[list]]):
        count = counter(path())
        for ids, texts in batches:
            sizes, totals, fits = [], [], []
            for text in texts:
                counts = np.concatenate([[0], np.cumsum(count.text_steps(text), dtype=np.int64)])
                sizes.append(len(text.encode()))
                totals.append(int(counts[-1]))
                fits.append(longest_prefix(counts, limit))
            yield [ids, sizes, totals, [n > limit for n in totals], fits]

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(pick(df, id_col, text_col), run, schema_of(f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, fits_chars long"))

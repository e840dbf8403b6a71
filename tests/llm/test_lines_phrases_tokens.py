"""Line dedup, collocations and token alignment against brute-force versions, on odd rows, and on all their paths."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from rulespark.llm import alignment, bloom, collocations, line_dedup

ODD = ["", " ", "a", "a  b", " lead", "trail ", "x\n\n y", "a \n b", "a\tb \x00c", "été ﬁ ａ 日本語 😀😀", "don't ''s 'll 12ab!?", "<|endoftext|> <s> </s> <0x41> ▁x", "a b  c", "z" * 300, "x\x1cy\x85 z", "  ", "\n", "it 's  'tis", "é́", "a" * 20 + " " + "b" * 70]


# --- lines


def brute_lines(rows, least_chars, least_documents, last):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower() if len(line.strip(" \t\n\x0b\x0c\r")) >= least_chars else None
    order = lambda i: (i is not None, i or 0)
    have = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            have[key(line)].add(i)
    keeper = {k: (max if last else min)(v, key=order) for k, v in have.items() if k is not None and len(v) >= least_documents}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(1)
    pool = [f"shared line number {k} of the pool" for k in range(30)] + ["SHORT", "  Shared LINE number 3 of the pool\t", "", "é" * 20, "É" * 20, "x" * 19]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    return [*rows, (7, "shared line number 1 of the pool"), (7, "shared line number 1 of the pool"), (None, "shared line number 2 of the pool\nown"), (None, None), (61, ""), (62, "\n".join(pool * 400)), (63, "in one text only, twice\n" * 5)]


@pytest.mark.parametrize("keep", ["last", "first"])
@pytest.mark.parametrize("sent", [(1 << 30, 1 << 20), (0, 0)])
def test_line_dedup(spark, keep, sent):
    rows = line_rows()
    df = spark.createDataFrame([(i, t, "digest", 1) for i, t in rows], "doc_id long, text string, digest string, shard int")
    got = line_dedup.dedup_lines(df, 20, 3, keep, broadcast_bytes=sent[0], broadcast_keys=sent[1])
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_lines(rows, 20, 3, keep == "last")
    assert line_dedup.dedup_lines(df.limit(0), broadcast_bytes=sent[0], broadcast_keys=sent[1]).count() == 0


def test_line_dedup_other_ids_and_tables(spark):
    df = spark.createDataFrame([("a", "one line that is long enough"), ("b", "one line that is long enough"), ("c", "ONE line that is long enough ")], "name string, body string")
    got = {r["id"]: (r["text"], r["n_dropped"]) for r in line_dedup.dedup_lines(df, id_col="name", text_col="body").collect()}
    assert got == {"a": ("", 1), "b": ("", 1), "c": ("ONE line that is long enough ", 0)}
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(df, least_documents=1)


def test_bloom_merges_in_any_order():
    rng = np.random.default_rng(0)
    shape = bloom.Shape(100_000)
    own = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    parts = [np.concatenate([own[:1000], own[:10]]), own[500:2000], own[2000:]]

    def merge(parts):
        bits = {}
        for part in parts:
            for shard, once, twice in bloom.packed(part, shape):
                one, two = bits.setdefault(shard, (np.zeros(1 << shape.place_bits, bool), np.zeros(1 << shape.place_bits, bool)))
                place = np.frombuffer(once, np.uint32)
                two[place] |= one[place]
                one[place] = True
                two[np.frombuffer(twice, np.uint32)] = True
        return [bloom.Bits(shape, [(k, np.packbits(v[n], bitorder="little").tobytes()) for k, v in bits.items()]) for n in range(2)]

    once, twice = merge(parts)
    assert once.holds(own).all() and twice.holds(own[500:1000]).all() and twice.holds(own[:10]).all()
    assert not twice.holds(own[1000:]).any()
    assert (merge(parts[::-1])[1].bits == twice.bits).all()
    assert once.holds(rng.integers(0, 1 << 63, 100_000, dtype=np.uint64)).mean() < 0.01


# --- phrases


def brute_phrases(rows, max_words, least, percent, top):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        text = (text or "").translate(lower)
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    out = defaultdict(list)
    some = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    for (lang, p), a in some.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(l2 == lang and len(q) > len(p) and 100 * b >= percent * a and inside(q) for (l2, q), b in some.items()):
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:c]] * f[lang, p[c:]]), c) for c in range(1, len(p))]
        score, c = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:c]], f[lang, p[c:]]))
    return sorted((lang, k, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for k, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1))


def phrase_texts():
    rng = random.Random(2)
    words = ["a", "b", "C", "dé", "É", "x y", "e", "f"]
    rows = []
    for i in range(250):
        made = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r"]) for _ in range(rng.randint(0, 30)))
        rows.append((made + rng.choice(["New York City", "new york", "in the long run", ""]), rng.choice(["en", "fr", None])))
    return [*rows, (None, "en"), ("", None), ("only one text", "xx"), ("same words " * 5000, "zz"), ("und too", "und")]


@pytest.mark.parametrize("max_words,least,percent,top", [(3, 10, 50, 2000), (4, 3, 80, 7), (2, 1, 50, 50)])
def test_collocations(spark, max_words, least, percent, top):
    rows = phrase_texts()
    df = spark.createDataFrame([(t, lang, "p", 1) for t, lang in rows], "text string, lang string, phrase string, n int")
    got = collocations.collocations(df, max_words, least, percent, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, max_words, least, percent, top)
    assert collocations.collocations(df.limit(0), max_words, least, percent, top).count() == 0


def test_scores_are_exact(spark):
    big = 10**15 - 7
    rows = [("en", 0, "", big), ("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 2)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, k int, phrase string, f long")).first()
    assert got["score"] == 10**6 * (big - 2) ** 2 // (big * (big - 1))


def test_phrases_are_added_up_in_parts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "TAKEN", 50)
    rows = phrase_texts()[:200]
    made = collocations.Exploder("en", 2, *[bloom.Bits(bloom.Shape(0), [(k, b"\xff" * (1 << 13)) for k in range(128)])] * 2)
    found = Counter()
    for _, own in collocations.in_turns(["en"] * len(rows), [t for t, _ in rows]):
        made.add(own)
        for batch in made.rows():
            for p, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found[p] += n
    want = Counter()
    for text, _ in rows:
        words = [w.decode() for w in collocations.tokens(text) if w]
        want.update(f"{a} {b}" for a, b in zip(words, words[1:]) if "\n" not in (a, b))
    assert found == want


# --- tokens


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(alignment.default_a())
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=alignment.default_b())
    byte = {c: i for i, c in enumerate(alignment.byte_letters())}
    rows, counts = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = [(i, bytes(byte[c] for c in a_side.id_to_token(i))) for i in a_side.encode(whole.decode(), add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(b_side.id_to_piece(i)[1:-1], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()) for i in b_side.encode(text)] if text else []
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            rows.append(([], [], []))
            continue

        def spans(tokens):
            out, at = [], 0
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            return out

        sa, sb = spans(a), spans(b)
        links = [(x[0], y[0]) for x in sa for y in sb if max(x[1], y[1]) < min(x[2], y[2])]
        counts.update(links)
        common = sorted({x[2] for x in sa} & {y[2] for y in sb})
        groups = [([x[0] for x in sa if low < x[2] <= c], [y[0] for y in sb if low < y[2] <= c]) for low, c in zip([0, *common], common)]
        rows.append((sa, sb, (links, groups)))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for sa, sb, more in rows:
        if not more:
            out.append((0, 0, 0, 0, "", 0, 0))
            continue
        links, groups = more
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(sa), len(sb), len(groups), len(links), hashlib.sha256(text.encode()).hexdigest(), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links)))
    return out


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_alignment(spark, monkeypatch, most):
    rng = random.Random(3)
    words = ["hello", "World's", "unbelievable", "été", "12345", "naïve-té", "foo.bar", "日本", "x\ny"]
    texts = [*ODD, None, *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(30)), "long text " * 300, "same", "same"]
    df = spark.createDataFrame([(i % 50, t, 1, "b", "k") for i, t in enumerate(texts)], "doc_id int, text string, doc int, side string, pair string")
    got = alignment.align(df, broadcast_pairs=most)
    cols = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    want = sorted((i % 50, *row) for i, row in enumerate(brute_alignment(texts)))
    assert sorted(tuple(r) for r in got.select("id", *cols).collect()) == want
    assert alignment.align(df.limit(0), broadcast_pairs=most).count() == 0


def test_words_change_no_ids():
    own = alignment.Encoders(alignment.default_a(), alignment.default_b())
    rng = random.Random(4)
    alphabet = ["a", "B", "'s", "1", ".", " ", "  ", "\n", "\t", "é", " ", " ", "\x1c", "日", "\r"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    for text, got in zip(texts, own.encode(texts)):
        if got is not None:
            a, b = (np.frombuffer(x, own.kind).tolist() for x in got)
            assert a == own.a.encode(" " + text, add_special_tokens=False).ids, text
            assert b == own.b.encode(text), text


def test_sweep_in_blocks_equals_the_whole():
    own = alignment.Encoders(alignment.default_a(), alignment.default_b())
    text = "unbelievable étéété foo-bar 123456 日本語 " * 20
    a, b = (np.frombuffer(x, own.kind) for x in own.encode([text])[0])
    rows = []
    for size in (1, 3, 10_000):
        machine = alignment.Sweep(own.lengths(), own.kind)
        machine.start(1)
        ends = [n[x].cumsum() for n, x in zip(own.lengths(), (a, b))]
        blocks = [(int(e[k - 1]) if k else 0, side, x[k : k + size]) for side, (x, e) in enumerate(zip((a, b), ends)) for k in range(0, len(x), size)]
        for _, side, ids in sorted(blocks, key=lambda r: r[:2]):
            machine.add(side, ids)
        rows.append(machine.row())
    assert rows[0] == rows[2] and rows[1] == rows[2]


def test_very_long_texts():
    own = alignment.Encoders(alignment.default_a(), alignment.default_b())
    text = "abcdefghij" * 30_000 + " end"
    a, b = own.encode([text])[0]
    assert len(a) and len(b)


def test_texts_are_taken_apart_together(monkeypatch):
    """Texts of a turn are split in one go, and no phrase goes over the end of a text."""
    from rulespark.llm import bloom, collocations

    calls, tokens = [], collocations.tokens
    monkeypatch.setattr(collocations, "tokens", lambda text: calls.append(text) or tokens(text))
    shape = bloom.Shape(4, 28)
    bits = bloom.Bits(shape, [])
    monkeypatch.setattr(bits, "holds", lambda hashes: np.ones(len(hashes), bool), raising=False)
    one = collocations.Exploder("en", 2, bits, bits)
    one.add(["A b", "", "b a.b a", "a"])
    got = {r["phrase"]: r["n"] for batch in one.rows() for r in batch.to_pylist()}
    assert got == {"a b": 1, "b a": 2} and len(calls) == 1

"""The operators' parts that need no Spark, against brute force and the libraries."""

import random
import re

import numpy as np
import pytest

from rulespark.llm import chat_format, decontaminate, fingerprints, licenses, near_dup, pii, token_counts, toxicity, url_filter

ODD = ["", " ", "a", "Hello World's 1234 <|endoftext|> x <|EndOfText|>", "É́ éx ÀΣ", "don't ''s 12a 'll 're", "İstanbul éa̐́ Å", "ﬁ … ½ ² 日本語 😀😀   x", "a" * 300, "!?" * 100, "x\x1cy\x85z​", " a  b\n\tc "]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_vocabulary())


@pytest.mark.parametrize("text", ODD)
def test_every_prefix_count_is_the_library_s(tokenizer, text):
    counts = token_counts.counts_at(token_counts.pack(token_counts.counter(token_counts.default_vocabulary()).text_steps(text)))
    assert counts.tolist() == [len(tokenizer.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]


def test_random_words_counts(tokenizer):
    rng = random.Random(5)
    count = token_counts.counter(token_counts.default_vocabulary())
    for _ in range(200):
        text = "".join(rng.choice("aeiotnshrdlé' .,0#") for _ in range(rng.randrange(1, 40)))
        assert int(count.text_steps(text).sum()) == len(tokenizer.encode(text, add_special_tokens=False).ids), text


def test_longest_prefix():
    counts = np.array([0, 1, 2, 1, 2, 3])
    assert token_counts.longest_prefix(counts, 1) == 3
    assert token_counts.longest_prefix(counts, 0) == 0
    assert token_counts.longest_prefix(counts, 9) == 5


def test_chat_round_trip_and_mask():
    enc = chat_format.encoding(chat_format.default_vocabulary())
    rng = random.Random(3)
    marks = ["<|im_end|>", "<|im_start|>", "<\\|", "<\\\\|", "|>", "\\", "<", "é", "\n", "assistant"]
    for _ in range(100):
        turns = [(rng.choice(["user", "assistant", "system", ""]), "".join(rng.choice(marks) for _ in range(rng.randrange(6)))) for _ in range(rng.randrange(1, 5))]
        ids, mask = chat_format.assemble(enc, turns)
        back, under, shown = chat_format.read_back(enc, ids, mask)
        assert back == turns
        assert under == "".join(t for r, t in turns if r == "assistant")
        assert shown.count("<|im_start|>") == shown.count("<|im_end|>") == len(turns)


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_are_the_patterns():
    rng = random.Random(1)
    for _ in range(5000):
        t = "".join(rng.choice("ab@.-+ 0123 4()1") for _ in range(rng.randrange(30)))
        assert pii.in_listed_order(pii.base_spans(t)) == pii.in_listed_order(brute_spans(t)), t
    assert len(pii.base_spans("9" * 200_000 + "a" * 200_000 + "@")) == 0  # linear in long runs


def test_skip_chain_spreads_a_label():
    rows = []
    for text in ["call +1 (017) 555-7713 now", "card 4539578763621486 is", "mail a.b@x.org ok", "page 7 of 12", "host 10.0.0.1 up"] * 30 + ["call +1 (017) 555-7713 or +1 (017) 555-7713 now"] * 30:
        rows += [(*e, 1) for e in pii.examples(text)]
    p = pii.fit(rows)
    base, spans = pii.find("call +1 (017) 555-7713 and page 9", p)
    assert base == [("phone", 5, 22)] == [s for s in spans if s in base]
    assert p.skip[4, 4] > p.skip[4, 0]
    assert pii.redact("call +1 (017) 555-7713 and page 9", base) == "call [PHONE] and page 9"


def exact_marginals(g, p):
    from itertools import product

    weights = np.zeros((len(g.spans), len(pii.CLASSES)))
    for y in product(range(len(pii.CLASSES)), repeat=len(g.spans)):
        if any(o >= 0 and o != k for o, k in zip(g.observed, y)):
            continue
        w = sum(p.node[f, k] for k, own in zip(y, g.features) for f in own)
        w += sum(p.chain[y[a], y[b]] for a, b in g.chain) + sum(p.skip[y[a], y[b]] for a, b in g.skip)
        for i, k in enumerate(y):
            weights[i, k] += np.exp(w)
    return weights / weights.sum(1, keepdims=True)


@pytest.mark.parametrize("chain, skip, near", [([(0, 1), (1, 2), (2, 3)], [], 1e-6), ([(0, 1)], [(0, 2), (2, 3)], 1e-6), ([(0, 1), (1, 2), (2, 3)], [(0, 3)], 0.05), ([(0, 1), (1, 2)], [(0, 2), (1, 3)], 0.05)])
def test_beliefs_are_marginals(chain, skip, near):
    """Exact on trees, close on small loops."""
    rng = np.random.default_rng(8)
    pair = lambda: (lambda m: m + m.T)(rng.normal(0, 0.4, (5, 5)))
    p = pii.Potentials(rng.normal(0, 0.7, (pii.N_FEATURES, 5)), pair(), pair())
    g = pii.Graph([(i, i + 1) for i in range(4)], np.array([4, -1, -1, -1]), [[0, 3], [0, 5], [0, 9], [0, 2]], chain, skip)
    assert np.abs(pii.beliefs(g, p, rounds=60) - exact_marginals(g, p)).max() < near


def test_crf_finds_variants_of_base_spans():
    """Trained on texts with repeats and with numbers of other uses, it finds held-back variants, and little else."""
    rng = random.Random(6)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))

    def text(variant):
        d, name = number(10), word()
        kind = rng.randrange(3)
        if kind == 0:
            base, other = f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}", rng.choice([f"{d[:3]} {d[3:6]} {d[6:]}", d, f"{d[:3]}.{d[3:6]}.{d[6:]}"])
        elif kind == 1:
            base, other = f"{name}@site.org", rng.choice([f"{name} [at] site [dot] org", f"{name}(at)site.org"])
        else:
            c = next(x for x in iter(lambda: number(16), None) if pii.luhn(x))
            base, other = c, f"{c[:4]}.{c[4:8]}/{c[8:12]}.{c[12:]}"
        said = [base, other if variant else base] + ([f"order {number(10)}", f"page {rng.randrange(99)}", f"id {number(16)}"] if rng.random() < 0.5 else [])
        if variant:
            rng.shuffle(said)
        return " and then some words here of no number ".join(said), other if variant else None

    counts = {}
    for _ in range(300):
        for e in pii.examples(text(rng.random() < 0.3)[0]):
            key = (e[0], *map(tuple, e[1:]))
            counts[key] = counts.get(key, 0) + 1
    p = pii.fit([(*k, n) for k, n in counts.items()])
    right = wrong = missed = 0
    for _ in range(300):
        t, other = text(True)
        base, spans = pii.find(t, p)
        more = [t[a:b] for k, a, b in spans if (k, a, b) not in base]
        right += other in more
        missed += other not in more
        wrong += sum(x != other for x in more)
    assert right > 0.9 * (right + missed) and wrong < 0.05 * right


def test_fingerprints_move_with_the_text():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij klmnop") for _ in range(5000))
    a, b, c = (fingerprints.chunk_weights(t) for t in (text, "new start " + text, text[::-1]))
    assert fingerprints.containment(a, b) > 0.95
    assert fingerprints.containment(a, c) < 0.1
    assert fingerprints.from_string(fingerprints.to_string(a)) == a
    assert fingerprints.containment({}, {}) == 1 and fingerprints.containment(a, {}) == 0
    data = text.encode()
    ends = fingerprints.chunk_ends(data)
    assert ends[-1] == len(data) and all(y - x <= fingerprints.MOST for x, y in zip([0, *ends], ends)) and sum(a.values()) == len(data)


def test_register_estimate_is_near_jaccard():
    rng = np.random.default_rng(4)
    for share in (0.0, 0.5, 0.8, 1.0):
        both, own = int(1000 * share), 1000 - int(1000 * share)
        base, x, y = rng.integers(0, 1 << 63, both, dtype=np.uint64), rng.integers(0, 1 << 63, own, dtype=np.uint64), rng.integers(0, 1 << 63, own, dtype=np.uint64)
        a, b = np.unique(np.concatenate([base, x])), np.unique(np.concatenate([base, y]))
        equal = np.count_nonzero(near_dup.registers(a) == near_dup.registers(b))
        want = both / (2000 - both)
        assert abs(float(near_dup.estimate(equal, len(a), len(b))) - want) < 0.15


def test_least_edits_is_the_edit_distance():
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(6)
    for _ in range(200):
        a, b = [rng.randrange(4) for _ in range(rng.randrange(1, 7))], [rng.randrange(4) for _ in range(rng.randrange(8))]
        best = min(slow(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert decontaminate.least_edits(np.array(a, np.uint64), np.array(b, np.uint64))[0] == best


def test_recall_at_the_full_number_of_edits():
    rng = random.Random(7)
    items = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(12, 60)))) for i in range(300)]
    known = decontaminate.Items(items, 0.2)
    found = 0
    for k, (_, h) in enumerate(known.items):
        w = h.tolist()
        for _ in range(decontaminate.edits_allowed(len(h), 0.2)):
            p = rng.randrange(len(w))
            if rng.random() < 0.5:
                w[p] = rng.getrandbits(63)
            elif rng.random() < 0.5:
                w.insert(p, rng.getrandbits(63))
            else:
                del w[p]
        pad = [rng.getrandbits(63) for _ in range(30)]
        found += any(m[1] == k for m in known.matches([np.array(pad + w + pad, np.uint64)]))
    assert found / len(items) >= 0.97
    assert known.matches([np.array([rng.getrandbits(63) for _ in range(500)], np.uint64)]) == []


def test_url_parts_and_rules():
    assert url_filter.split_url("HTTP://A.Example.ORG/es/x?q#f") == ("a.example.org", "/es/x")
    assert url_filter.split_url(None) == url_filter.split_url("no scheme") == ("", "")
    assert url_filter.split_url("http://host?x") == ("host", "")
    by_token, rest = url_filter.index_rules(url_filter.PATTERN_RULES, {"free": 9, "bets": 1})
    assert any(url_filter.PATTERN_RULES[i].name == "free bets" for i in by_token["bets"]) and not rest


def test_site_index_is_a_scan_of_all_rules():
    rng = random.Random(11)
    hosts = ["org", "a.org", "b.a.org", "com", "a.com", ""]
    for _ in range(300):
        rules = tuple(url_filter.SiteRule(rng.choice(["allow", "block"]), h, p) for h, p in {(rng.choice(hosts), rng.choice(["/", "/x", "/x/y", ""])) for _ in range(5)})
        host, path = rng.choice([*hosts, "z.b.a.org", "borg"]), rng.choice(["", "/", "/x", "/x/y/z", "/w"])
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        want = max(fits, key=lambda r: (len(r.name), len(r.host)), default=None)
        assert url_filter.site_rule(url_filter.index_sites(rules), host, path) == want


COMMON = {w: 900 for w in ("the", "of", "to", "in", "and", "this", "is", "by", "or", "a", "for", "any", "be", "with", "that", "it")}


def test_license_notices():
    known = licenses.scanner(COMMON, 1000)
    for name, text in licenses.HEADERS:
        assert known.notices("some prose here\n" + text + "\nmore prose")[0] == name, text
        inside = known.notices("some prose here of no such kind and " + text + " and then more of the same prose " * 30)
        assert inside[0] == name and not inside[2], text
    assert known.notices("the license of the house and a free public version of it is in this very long line of prose")[0] is None
    assert known.notices("") == (None, 0.0, False)


def test_license_files():
    known = licenses.scanner(COMMON, 1000)
    for name, text in licenses.TEXTS:
        words = text.split()
        lines = "Copyright (c) 2020 Some One\n\n" + "\n".join(" ".join(words[i : i + 11]) for i in range(0, len(words), 11))
        assert known.notices(lines)[::2] == (name, True), name
        assert known.notices(lines + "\n" + "and the terms go on with many further words of their own " * 200)[::2] == (name, True), name


def test_licenses_against_plain_cosines():
    """All windows of all templates' sizes, by plain TF-IDF; ties, repeated notices, one changed word."""
    known = licenses.scanner(COMMON, 1000)
    vocabulary = {w for _, t in licenses.HEADERS for w in licenses.words_of(t)} | {w for _, t in licenses.TEXTS for w in licenses.words_of(t)}
    idf = {w: np.log(1001 / (1 + COMMON.get(w, 0))) + 0.1 for w in vocabulary}
    middling = sorted(idf.values())[len(idf) // 2]

    def vector(words):
        out = {}
        for w in words:
            out[w] = out.get(w, 0) + 1
        square = sum((n * idf[w]) ** 2 if w in idf else n * middling**2 for w, n in out.items())
        return {w: n * idf[w] / square**0.5 for w, n in out.items() if w in idf}

    rng = random.Random(12)
    templates = [(n, licenses.words_of(t)) for n, t in licenses.HEADERS[:23]]
    for _ in range(12):
        own = rng.choice(templates)[1] * rng.choice([1, 2])
        if len(own) > 8 and rng.random() < 0.5:
            own[rng.randrange(len(own))] = "changed"
        words = [f"p{rng.randrange(99)}" for _ in range(15)] + own + [f"p{rng.randrange(99)}" for _ in range(15)]
        scores = {}
        for name, t in templates:
            v = vector(t)
            best = max(sum(x * v.get(w, 0) for w, x in vector(words[i : i + len(t)]).items()) for i in range(max(1, len(words) - len(t) + 1)))
            scores[name] = max(scores.get(name, 0), best)
        name, score, _ = known.notices(" ".join(words))
        top = max(scores.values())
        assert (name is None) == (top < 0.8) and (name is None or scores[name] > top - 0.05 and abs(score - top) < 0.05)


def all_asked(votes):
    return np.ones(votes.shape, bool)


def test_label_model_trusts_voters_that_agree():
    rng = np.random.default_rng(1)
    y = rng.random(2000) < 0.2
    votes = np.stack([np.where(y & (rng.random(2000) < a), 1, np.where(rng.random(2000) < 0.5, -1, 0) * ~y) for a in (0.9, 0.8, 0.7, 0.7)], 1).astype(float)
    post, discount = toxicity.label_model(votes, all_asked(votes), y.astype(float), 0.2)
    assert ((post > 0.5) == y).mean() > 0.95
    doubled = np.hstack([votes, votes[:, :1]])
    _, less = toxicity.label_model(doubled, all_asked(doubled), y.astype(float), 0.2)
    assert less[0] < discount[0] + 1e-9


def test_label_model_gives_each_pattern_its_posterior():
    """Three independent voters of known accuracies: the posterior of each of the 27 patterns by Bayes' rule over both labels."""
    table = np.array([[[0.1, 0.2, 0.7], [0.2, 0.3, 0.5], [0.1, 0.5, 0.4]], [[0.7, 0.25, 0.05], [0.6, 0.3, 0.1], [0.5, 0.45, 0.05]]])
    rng, n, prior = np.random.default_rng(2), 60_000, 0.3
    y = rng.random(n) < prior
    votes = np.stack([np.where(y, rng.choice([-1, 0, 1], n, p=table[0, k]), rng.choice([-1, 0, 1], n, p=table[1, k])) for k in range(3)], 1).astype(float)
    flipped = np.where(rng.random(n) < 0.02, ~y, y).astype(float)  # marks with mistakes
    post, _ = toxicity.label_model(votes, all_asked(votes), flipped, prior)
    for pattern in np.ndindex(3, 3, 3):
        rows = (votes == np.array(pattern) - 1).all(1)
        weight = [q * np.prod([table[k, m, v] for m, v in enumerate(pattern)]) for k, q in ((0, prior), (1, 1 - prior))]
        if rows.any():
            assert abs(post[rows].mean() - weight[0] / sum(weight)) < 0.06


def test_label_model_does_not_drift_with_the_rows():
    rng = np.random.default_rng(3)
    y = rng.random(1000) < 0.1
    votes = np.stack([np.where(rng.random(1000) < 0.02, 1, np.where(y & (rng.random(1000) < 0.8), 1, 0)) for _ in range(4)], 1).astype(float)
    few, _ = toxicity.label_model(votes, all_asked(votes), y.astype(float), 0.1)
    many = np.repeat(votes, 40, 0)
    post, _ = toxicity.label_model(many, all_asked(many), np.repeat(y, 40).astype(float), 0.1)
    assert np.abs(post[::40] - few).max() < 0.05  # the smoothing of the few rows alone


@pytest.mark.parametrize("n", [0, 3_000, 20_000, 40_000])
def test_classifier_converges_at_every_size(n):
    rng = np.random.default_rng(4)
    x = (rng.random((n, 30)) < 0.1).astype(np.int8)
    soft = x[:, 0].astype(float)  # separable: plain Newton steps run away
    expected = np.zeros(31)
    w = toxicity.logistic(x, soft, expected)
    ones = np.hstack([x, np.ones((n, 1))])
    gradient = ones.T @ (1 / (1 + np.exp(-ones @ w)) - soft) + (w - expected)
    assert np.abs(gradient).max() <= 1e-5 * (n + 1)
    assert n == 0 or (((ones @ w) > 0) == (soft > 0.5)).all()


def test_cover_takes_the_telling_terms():
    rows = [(1, ["=bad", "^noisy"])] * 40 + [(0, ["^noisy"])] * 50 + [(1, ["^worse"])] * 20 + [(0, ["^worse", "=x"])] * 2
    assert toxicity.cover(rows, 60, 1000, 10.0, 40) == ["=bad", "^worse"]
    assert toxicity.cover([], 0, 0, 10.0, 40) == []
    assert toxicity.telling(0, 5, 10, 100) == toxicity.telling(1, 20, 10, 100) == 0

"""Toxicity by weak supervision.

Many voters, word lists and patterns, each vote toxic, clean or abstain on a document. A generative label model (votes depend on a
hidden label) estimates by EM how often each voter votes how under either label, and how votes correlate beyond what the label
explains; a voter's evidence is divided by one plus its correlations, so voters that repeat one another don't count twice. A logistic
classifier over words and votes is trained on the model's posterior labels and scores whole texts.

Some lists are found from labelled training rows, by sequential covering: the sample is cut into folds by a hash of the text, and outside
each fold the word or stem (the first 4 to 7 letters of longer words) that tells most is taken, the rows it covers are set aside, and so on
while it is more telling than chance among that many features. Such a list is a voter, which for training is asked about its fold alone,
never about a row it came from.
Words of the fixed lists that these rows show to be ordinary words of the corpus leave their lists.
The sample is bounded by ``sample`` rows (those with the lowest hash of the id), equal texts among them count once; votes and telling
features of the sample are what the driver gets. Voters' accuracies start at those on the labelled rows and are drawn to them.

Rows: one per input row. Null and empty texts are scored by what no votes say. Without training rows the
classifier has its expected weights, from the fixed lists. Labels that are null don't count, of several for an id the highest does. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import filter_rows, forget, map_rows, pick, schema_of, stored

# Insults and abuse, by language and kind.
LEXICONS = {
    "wits": "idiot idiots idiotic stupid stupidity moron morons moronic dumb dumbass fool fools imbecile cretin halfwit dimwit braindead retard retarded",
    "worth": "loser losers worthless pathetic useless failure nobody reject wretch lowlife scumbag scum trash garbage filth vermin parasite",
    "disgust": "disgusting disgrace disgraceful gross repulsive revolting vile sickening creep creepy pig pigs",
    "mockery": "clown clowns joke laughable ridiculous buffoon weirdo freak freaks crybaby snowflake",
    "swearing": "fuck fucking fucker fucked shit shitty bullshit asshole bastard bitch bitches dick prick cunt crap damn hell piss",
    "threat": "kill killing murder destroy shoot stab rape",
    "spanish": "idiota idiotas estúpido estúpida imbécil tonto tonta basura asqueroso asquerosa inútil perdedor payaso escoria mierda puta puto cabrón gilipollas pendejo",
    "french": "idiot idiote stupide imbécile crétin abruti débile minable pathétique dégoûtant déchet ordure clown merde connard connasse salope putain enculé",
    "german": "idiot dumm dummkopf blödmann trottel depp versager wertlos erbärmlich ekelhaft abschaum müll clown scheiße arschloch hurensohn wichser schlampe",
}
WORD = re.compile(r"[^\W\d_]+")
SECOND_PERSON = {"you", "your", "youre", "u", "du", "dich", "dein", "tu", "te", "toi", "vous", "usted", "eres"}
SHOUT = re.compile(r"!{2,}|[?!]{3,}")
DISGUISED = re.compile(r"\b(?:f[\W_]?[u*@]c?k|sh[i1!*]t|b[i1!*]tch|[a@][s$]{2}h[o0]le|1d[i1]ot|[i1]d[1!]ot|st[u*]p[1!]d|m[0o]r[0o]n)\b", re.I)


@dataclass(frozen=True)
class Voters:
    """``lists``: names and their terms, ``=word`` or ``^stem``."""

    lists: tuple[tuple[str, frozenset], ...]

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.lists] + ["address", "dense", "shout", "disguised", "none"]

    @property
    def vocabulary(self) -> list[str]:
        return sorted(set().union(*(w for _, w in self.lists)))


def voters(found: dict[int, list[str]] = {}, dropped: frozenset = frozenset()) -> Voters:
    own = [(n, frozenset("=" + x for x in w.split()) - dropped) for n, w in LEXICONS.items()]
    return Voters(tuple(own + [(f"found{k}", frozenset(w)) for k, w in sorted(found.items()) if w]))


STEMS = range(4, 8)


def terms_of(words) -> set[str]:
    """All terms that could be listed: the words, and the stems of longer ones."""
    return {f"={w}" for w in words} | {f"^{w[:k]}" for w in words for k in STEMS if len(w) > k}


class Looker:
    """What voters see of a text."""

    def __init__(self, who: Voters):
        self.lists = [w for _, w in who.lists]
        self.words = frozenset(t[1:] for w in self.lists for t in w if t[0] == "=")
        self.stems = frozenset(t[1:] for w in self.lists for t in w if t[0] == "^")
        self.lengths = sorted({len(t) for t in self.stems})

    def __call__(self, text: str, only: int | None = None, among: range = range(0)) -> tuple[list[int], set[str]]:
        """The votes on a text (1 toxic, -1 clean, 0 abstain) and the listed terms it holds; of the lists ``among`` those numbers, only one
        if ``only`` is given."""
        words = WORD.findall(text.lower())
        times: dict[str, int] = {}
        for w in words:
            times[w] = times.get(w, 0) + 1
        by_term = {f"={w}": n for w, n in times.items() if w in self.words}
        for k in self.lengths:
            for w, n in times.items():
                if len(w) > k and w[:k] in self.stems:
                    by_term[f"^{w[:k]}"] = by_term.get(f"^{w[:k]}", 0) + n
        lists = self.lists
        if only is not None:
            lists = [frozenset() if i in among and i != only else w for i, w in enumerate(lists)]
            left = set().union(*lists)
            by_term = {t: n for t, n in by_term.items() if t in left}
        held = set(by_term)
        hits = sum(by_term.values())
        votes = [0 if held.isdisjoint(w) else 1 for w in lists]
        votes.append(1 if held and not SECOND_PERSON.isdisjoint(times) else 0)
        votes.append((1 if hits * 50 >= len(words) else -1) if held else 0)
        votes.append(0 if SHOUT.search(text) else -1)
        votes.append(1 if DISGUISED.search(text) else 0)
        votes.append(0 if held else -1)
        return votes, held


def telling(bad: float, n: float, all_bad: int, total: int) -> float:
    """The log-likelihood ratio of a feature with ``bad`` toxic rows of ``n``, where ``all_bad`` of all ``total`` are toxic; 0 if it speaks
    for clean."""
    if not bad or bad * total <= all_bad * n:
        return 0.0
    return bad * math.log(bad * total / (n * all_bad)) + ((n - bad) * math.log((n - bad) * total / (n * (total - all_bad))) if n > bad else 0.0)


def cover(rows: list[tuple[int, list[str]]], all_bad: int, total: int, least: float, most: int) -> list[str]:
    """Sequential covering: ``rows`` are (label, terms) of those of ``total`` rows that hold any term. At ties whole words go before stems,
    longer stems before shorter."""
    chosen: list[str] = []
    while len(chosen) < most:
        n, bad = Counter(), Counter()
        for label, terms in rows:
            n.update(terms)
            if label:
                bad.update(terms)
        best = max(((telling(b, n[t], all_bad, total), t[0] == "=", len(t), t) for t, b in bad.items() if 2 * b > n[t]), default=None)
        if best is None or best[0] < least:
            break
        term = best[-1]
        chosen.append(term)
        total, all_bad = total - n[term], all_bad - bad[term]
        rows = [r for r in rows if term not in r[1]]
        if not all_bad or all_bad == total:
            break
    return chosen


def label_model(votes: np.ndarray, asked: np.ndarray, marks: np.ndarray, prior: float, rounds: int = 30, drawn: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of toxic for each row, and each voter's discount. ``asked`` tells which voter was asked about which row. Correlations are
    those within rows marked toxic and within rows marked clean. A voter's accuracies start at those on marked rows; EM re-estimates them
    from posteriors, and the marks keep a weight of ``drawn`` times the rows, the same share at every number of rows."""
    n, m = votes.shape
    onehot = np.stack([(votes == v) & asked for v in (-1, 0, 1)], 2).astype(float)
    base = (onehot.sum(0) + 1) / (onehot.sum((0, 2))[:, None] + 3)
    marked = [np.einsum("n,nmv->mv", w, onehot) for w in (marks, 1.0 - marks)]
    first = [(k + 2 * base) / (k.sum(1, keepdims=True) + 2) for k in marked]
    table = np.stack(first)
    values = votes - np.stack([t @ [-1, 0, 1] for t in first])[np.where(marks > 0.5, 0, 1)]  # what the mark doesn't explain
    values = np.where(asked, values, 0)
    values -= values.mean(0) if n else 0
    values /= (values.std(0) if n else 0) + 0.01  # a voter that doesn't vary correlates with none
    rho = np.abs(values.T @ values / max(n, 1))
    np.fill_diagonal(rho, 0)
    discount = 1 / (1 + np.where(rho > max(0.1, 3 / math.sqrt(max(n, 1))), rho, 0).sum(1))

    def posterior(table):
        odds = np.log(prior / (1 - prior)) + np.einsum("nmv,mv->n", onehot, (np.log(table[0]) - np.log(table[1])) * discount[:, None])
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    post = posterior(table)
    for _ in range(rounds):
        for k, w in ((0, post), (1, 1 - post)):
            table[k] = np.einsum("n,nmv->mv", w, onehot) + 2 * base + drawn * marked[k]
            table[k] /= table[k].sum(1, keepdims=True)
        post = posterior(table)
    return post, discount


def expected_weights(who: Voters) -> np.ndarray:
    """What the classifier's weights are drawn to where the sample says nothing: a fixed list's word speaks for toxic, a threat's less."""
    fixed = dict(who.lists)
    strong = set().union(*(fixed[k] for k in LEXICONS if k != "threat"))
    words = [1.5 if w in strong else 0.5 if w in fixed["threat"] else 0.0 for w in who.vocabulary]
    votes = [{"dense": 1.0, "none": 1.0}.get(n, 0.0) for n in who.names]
    return np.array([*words, *votes, -2.5])


def logistic(x: np.ndarray, soft: np.ndarray, expected: np.ndarray, ridge: float = 1.0, rounds: int = 200) -> np.ndarray:
    """A linear classifier on soft labels, its weights drawn to the expected ones; the last is the intercept. Newton's method, each step
    halved until the loss falls; the loss is strictly convex, and the end is tested by its gradient."""
    tolerance = 1e-6 * (len(x) + 1)

    def parts():
        for i in range(0, len(x), 1000):  # a part at a time, to keep the driver's memory small
            yield np.hstack([x[i : i + 1000], np.ones((len(x[i : i + 1000]), 1))]), soft[i : i + 1000]

    def loss(w):
        return 0.5 * ridge * float((w - expected) @ (w - expected)) + sum(float((np.logaddexp(0, part @ w) - y * (part @ w)).sum()) for part, y in parts())

    w, now = expected.copy(), loss(expected)
    for _ in range(rounds):
        h, g = ridge * np.eye(len(w)), ridge * (w - expected)
        for part, y in parts():
            p = 1 / (1 + np.exp(-np.clip(part @ w, -500, 500)))
            h += (part * (p * (1 - p))[:, None]).T @ part
            g += part.T @ (p - y)
        if np.abs(g).max() <= tolerance:
            return w
        step, size = np.linalg.solve(h, g), 1.0
        while (new := loss(w - size * step)) > now - 1e-4 * size * float(g @ step) and size > 1e-10:
            size /= 2
        w, now = w - size * step, min(new, now)
    raise ArithmeticError(f"the classifier did not converge: gradient {np.abs(g).max()} after {rounds} steps")


@dataclass(frozen=True)
class Model:
    who: Voters
    weights: np.ndarray
    discount: np.ndarray


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, folds: int = 4, most: int = 40) -> Model:
    """``docs``: ``id``, ``text``; ``labels``: ``id``, ``label``, training rows alone. ``most`` bounds a found list's terms."""
    known = labels.filter("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    own = docs.join(F.broadcast(known), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))  # one text an id, so bounded by sample
    own = own.groupBy("text").agg(F.max("label").alias("label"))
    texts = stored(own.select("text", "label", F.pmod(F.xxhash64("text"), F.lit(folds)).cast("int").alias("fold")), "toxicity-sample")

    terms = map_rows(texts, lambda text, label, fold: (fold, label, sorted(terms_of(set(WORD.findall(text.lower()))))), schema_of("fold int, label int, terms array<string>"))
    terms = stored(terms, "toxicity-terms")
    sizes = {r["fold"]: (r["n"], r["bad"]) for r in terms.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("bad")).collect()}
    total, bad = (sum(s[k] for s in sizes.values()) for k in (0, 1))
    per_fold = [F.sum(F.when(F.col("fold") == k, x).otherwise(0)).alias(f"{name}{k}") for k in range(folds) for name, x in (("n", F.lit(1)), ("bad", F.col("label")))]
    counts = terms.select("fold", "label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("bad"), *per_fold)
    counts = stored(counts, "toxicity-counts")
    listed = counts.filter(F.col("term").isin(*voters().vocabulary)).select("term", "n", "bad").collect()
    # a listed word that the labelled rows know as an ordinary one here
    dropped = frozenset(r["term"] for r in listed if r["n"] >= 5 and r["bad"] / r["n"] < min(0.5, 3 * bad / total))
    least = math.log(counts.count() + 1) + 3
    candidates: dict[int, set[str]] = {k: set() for k in sizes}
    for r in counts.filter("bad >= 5 and 2 * bad > n").toLocalIterator():
        for k, (n, b) in sizes.items():
            if telling(r["bad"] - r[f"bad{k}"], r["n"] - r[f"n{k}"], bad - b, total - n) >= least:
                candidates[k].add(r["term"])
    wanted = frozenset().union(*candidates.values())
    held = map_rows(terms, lambda fold, label, terms: (fold, label, [t for t in terms if t in wanted]), terms.schema)
    rows = held.filter(F.size("terms") > 0).collect() if wanted else []
    found = {}
    for k, own in sorted(candidates.items()):
        outside = [(r["label"], [t for t in r["terms"] if t in own]) for r in rows if r["fold"] != k]
        found[k] = cover([r for r in outside if r[1]], bad - sizes[k][1], total - sizes[k][0], least, most)
    for t in (terms, counts):
        forget(t)

    who = voters(found, dropped)
    index = {w: i for i, w in enumerate(who.vocabulary)}
    number = {n: i for i, n in enumerate(who.names)}
    cross = range(len(LEXICONS), len(who.lists))  # the found lists
    look = Looker(who)

    def votes_of(text, label, fold):
        own = number.get(f"found{fold}", -1)
        votes, held = look(text)
        return votes, look(text, own, cross)[0], sorted(index[w] for w in held), label, own

    rows = map_rows(texts, votes_of, schema_of("votes array<int>, apart array<int>, held array<int>, label int, own int")).collect()
    forget(texts)
    rows.sort(key=lambda r: (r["label"], r["own"], r["apart"], r["held"]))  # sums do not depend on the order of tasks
    votes = np.array([r["apart"] for r in rows], float).reshape(len(rows), len(who.names))
    asked = np.ones(votes.shape, bool)
    x = np.zeros((len(rows), len(index) + len(who.names)), np.int8)
    for i, r in enumerate(rows):
        x[i, r["held"]] = 1
        x[i, len(index) :] = r["votes"]
        asked[i, [k for k in cross if k != r["own"]]] = False
    prior = min(0.5, max(0.01, (bad + 1) / (total + 10)))
    post, discount = label_model(votes, asked, np.array([float(r["label"]) for r in rows]), prior)
    return Model(who, logistic(x, post, expected_weights(who)), discount)


def scorer(model: Model):
    """A function from a text to its score."""
    look = Looker(model.who)
    index = {w: i for i, w in enumerate(model.who.vocabulary)}
    weights, tail, bias = model.weights, model.weights[len(index) : -1], model.weights[-1]

    def one(text: str | None) -> float:
        votes, held = look(text or "")
        z = bias + float(np.dot(votes, tail)) + sum(weights[index[w]] for w in sorted(held))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return one


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``id``, ``score``: of every whole text."""
    one = scorer(model)
    return map_rows(docs, lambda key, text: (key, one(text)), schema_of(f"id {docs.schema['id'].dataType.simpleString()}, score double"))


def clean_rows(docs: DataFrame, model: Model, text_col: str = "text", below: float = 0.5) -> DataFrame:
    """The rows, all columns as they are, whose score is below ``below``."""
    one = scorer(model)
    return filter_rows(docs, lambda text: one(text) < below, text_col)


def held_out(id_col) -> F.Column:
    return F.crc32(id_col.cast("string")) % 5 == 0


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000) -> DataFrame:
    """``id``, ``held_out``, ``score``, ``predicted``; learns only from labels of ids that aren't held out."""
    docs = pick(df, id_col, text_col)
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    model = train(docs, known.filter(~held_out(F.col("id"))), sample)
    scored = score(docs, model)
    return scored.select("id", F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

"""Atoms, rules and what can be said of them without data. Pure Python on the driver; nothing here grows with the facts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import combinations, permutations, product

DIFFERENT, EQUALS = "differentFrom", "equals"
EXISTS, EXISTS_INV, NOT_EXISTS, NOT_EXISTS_INV = "exists", "existsInv", "~exists", "~existsInv"
EXISTENCE = (EXISTS, EXISTS_INV, NOT_EXISTS, NOT_EXISTS_INV)
TYPE = "rdf:type"

_CARDINALITY = re.compile(r"<?hasNumberOfValues(Equals|GreaterThan|SmallerThan)(Inv)?([0-9]+)>?")


def is_variable(term: str) -> bool:
    return term.startswith("?")


def plain(relation: str) -> str:
    """A special relation's name without angle brackets."""
    return relation[1:-1] if relation.startswith("<") and relation.endswith(">") else relation


@dataclass(frozen=True)
class Cardinality:
    """``kind``: Equals, GreaterThan or SmallerThan; ``inverse``: counts subjects of an object."""

    kind: str
    inverse: bool
    n: int


def cardinality(relation: str) -> Cardinality | None:
    m = _CARDINALITY.fullmatch(relation)
    if not m:
        return None
    found = Cardinality(m[1], bool(m[2]), int(m[3]))
    if found.kind == "SmallerThan" and found.n == 0:
        raise ValueError("no count is smaller than 0")
    return found


@dataclass(frozen=True, order=True)
class Atom:
    s: str
    r: str
    o: str

    @property
    def terms(self) -> tuple[str, str, str]:
        return self.s, self.r, self.o

    @property
    def variables(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(t for t in self.terms if is_variable(t)))

    @property
    def special(self) -> bool:
        name = plain(self.r)
        return name in (DIFFERENT, EQUALS, *EXISTENCE) or cardinality(self.r) is not None

    def replace(self, mapping: dict[str, str]) -> Atom:
        return Atom(*(mapping.get(t, t) for t in self.terms))

    def position(self, variable: str) -> int:
        """0, 1 or 2; -1 where the variable isn't in it."""
        return self.terms.index(variable) if variable in self.terms else -1


def number_of_variables(atom: Atom) -> int:
    return sum(map(is_variable, atom.terms))


def variables_in_common(a: Atom, b: Atom) -> list[str]:
    return [v for v in a.variables if v in b.variables]


def variables_of(atoms: Iterable[Atom]) -> list[str]:
    return list(dict.fromkeys(v for a in atoms for v in a.variables))


def connected(a: Atom, b: Atom) -> bool:
    return bool(set(a.variables) & set(b.variables))


@dataclass(frozen=True)
class Rule:
    """``body => head``. ``counted``: the head position (0 or 2) whose variable PCA confidence keeps."""

    head: Atom
    body: tuple[Atom, ...] = ()
    support: float = 0.0
    head_size: int = 0
    body_size: int | None = None
    pca_body_size: int | None = None
    counted: int = 0
    parents: tuple[Rule, ...] = field(default=(), compare=False, repr=False)
    std_bound: float | None = field(default=None, compare=False)  # no confidence is higher than its bound
    pca_bound: float | None = field(default=None, compare=False)
    pca_estimate: float | None = field(default=None, compare=False)

    @property
    def atoms(self) -> tuple[Atom, ...]:
        return self.head, *self.body

    @property
    def length(self) -> int:
        return len(self.atoms)

    @property
    def real_length(self) -> int:
        """Atoms without inequalities."""
        return sum(plain(a.r) != DIFFERENT for a in self.atoms)

    @property
    def length_without_types(self) -> int:
        return sum(plain(a.r) not in (DIFFERENT, TYPE) for a in self.atoms)

    @property
    def variables(self) -> list[str]:
        return variables_of(a for a in self.atoms if plain(a.r) != DIFFERENT)

    @property
    def counts(self) -> Counter:
        """In how many atoms each variable is; r(x,x) is one."""
        return Counter(v for a in self.atoms if plain(a.r) != DIFFERENT for v in (a.s, a.o) if is_variable(v) and (v == a.s or a.s != a.o))

    @property
    def open_variables(self) -> list[str]:
        n = self.counts
        return [v for v in self.variables if n[v] < 2]

    @property
    def closed(self) -> bool:
        return bool(self.body) and not self.open_variables

    @property
    def head_coverage(self) -> float | None:
        return self.support / self.head_size if self.head_size else None

    @property
    def std_confidence(self) -> float | None:
        return self.support / self.body_size if self.body_size else None

    @property
    def pca_confidence(self) -> float | None:
        return self.support / self.pca_body_size if self.pca_body_size else None

    @property
    def perfect(self) -> bool:
        return self.pca_confidence == 1.0

    @property
    def counted_variable(self) -> str:
        return self.head.o if self.counted == 2 else self.head.s

    def relation_count(self, relation: str) -> int:
        return sum(a.r == relation for a in self.atoms)

    def add(self, *atoms: Atom, support: float | None = None) -> Rule:
        return replace(self, body=(*self.body, *atoms), support=self.support if support is None else support, body_size=None, pca_body_size=None, parents=(self,))

    def replace_last(self, atom: Atom) -> Rule:
        return replace(self, body=(*self.body[:-1], atom))

    def bind(self, variable: str, constant: str) -> Rule:
        return replace(self, head=self.head.replace({variable: constant}), body=tuple(a.replace({variable: constant}) for a in self.body))

    def fresh(self) -> str:
        return next(v for v in fresh_variables() if v not in self.variables)

    @property
    def key(self) -> str:
        return canonical_key(self.atoms)

    @property
    def ancestors(self) -> list[Rule]:
        out: dict[str, Rule] = {}
        todo = list(self.parents)
        while todo:
            p = todo.pop()
            if p.key not in out:
                out[p.key] = p
                todo += p.parents
        return list(out.values())


def fresh_variables() -> Iterator[str]:
    """?a ... ?z, ?a1 ... ?z1, ..."""
    n = 0
    while True:
        for c in "abcdefghijklmnopqrstuvwxyz":
            yield f"?{c}{n or ''}"
        n += 1


def canonical_key(atoms: tuple[Atom, ...]) -> str:
    """The same for two rules exactly if a renaming of variables makes heads equal and bodies equal as sets. The head's variables
    are named by their place, the others by the renaming that gives the least text."""
    head, body = atoms[0], set(atoms[1:])
    names = {v: f"?h{i}" for i, v in enumerate(head.variables)}
    free = [v for v in variables_of(sorted(body)) if v not in names]
    best = None
    for order in permutations(range(len(free))):
        mapping = names | {v: f"?v{i}" for v, i in zip(free, order)}
        text = ";".join(sorted("|".join(a.replace(mapping).terms) for a in body))
        if best is None or text < best:
            best = text
    return "|".join(head.replace(names).terms) + "<=" + (best or "")


def equivalent(a: Iterable[Atom], b: Iterable[Atom]) -> bool:
    """Structural equivalence of two queries, the first atom of each being its head."""
    a, b = tuple(a), tuple(b)
    return len(set(a[1:])) == len(set(b[1:])) and canonical_key(a) == canonical_key(b)


def unifies(a: Atom, b: Atom) -> bool:
    """Whether b could be an instance of a: equal terms, or a variable in a."""
    return all(x == y or is_variable(x) for x, y in zip(a.terms, b.terms))


def redundant_atoms(rule: Rule) -> list[Atom]:
    """Earlier atoms of the last atom's relation that the last atom unifies with."""
    last = rule.body[-1]
    return [a for a in rule.atoms[:-1] if a.r == last.r and (unifies(last, a) or unifies(a, last))]


def redundant_recursive(rule: Rule) -> bool:
    """The last atom repeats an earlier one."""
    return rule.body[-1] in rule.atoms[:-1]


def subsumes(general: Rule, special: Rule) -> bool:
    """Some part of the special rule's body of the general one's size, with its head, is the general rule."""
    if len(general.body) >= len(special.body):
        return False
    key = general.key
    return any(canonical_key((special.head, *part)) == key for part in combinations(special.body, len(general.body)))


def without_redundant(atoms: Iterable[Atom], kept: Iterable[str]) -> list[Atom]:
    """The atoms without those that say nothing: of r(x,z) and r(y,z), or r(z,x) and r(z,y), one goes if its own variable is in no other atom
    and isn't kept. Counts and bindings of the kept variables stay the same."""
    atoms, kept = list(atoms), set(kept)
    again = True
    while again:
        again = False
        times = Counter(v for a in atoms for v in a.variables)
        for a, b in permutations(atoms, 2):
            if a.special or a.r != b.r or a == b and len(atoms) == 1:
                continue
            for own, other, shared, same in ((a.s, b.s, a.o, b.o), (a.o, b.o, a.s, b.s)):
                if shared == same and is_variable(own) and own != shared and (times[own] == 1 or own == other) and (own not in kept or own == other):
                    atoms.remove(a)
                    again = True
                    break
            if again:
                break
    return atoms


def redundant_subgraph(rule: Rule) -> bool:
    """A closed rule of four or more atoms, an even number, with each relation exactly twice."""
    atoms = [a for a in rule.atoms if plain(a.r) != DIFFERENT]
    return rule.closed and len(atoms) >= 4 and len(atoms) % 2 == 0 and set(Counter(a.r for a in atoms).values()) == {2}


def disallowed_diamond(atoms: Iterable[Atom]) -> bool:
    """Whether the query is one pattern of two relations said twice or more: closed, an even number of atoms of just two relations, which fall
    into pairs that are alike up to a renaming of their variables."""
    atoms = list(atoms)
    by = Counter(a.r for a in atoms)
    if len(atoms) < 4 or len(atoms) % 2 or len(by) != 2 or len(set(by.values())) != 1 or not Rule(atoms[0], tuple(atoms[1:])).closed:
        return False
    return _splits_alike(atoms)


def _splits_alike(atoms: list[Atom]) -> bool:
    relations = sorted({a.r for a in atoms})
    groups = [[a for a in atoms if a.r == r] for r in relations]
    times = len(groups[0])
    for orders in product(*(permutations(g) for g in groups[1:])):
        parts = [tuple([groups[0][i], *(o[i] for o in orders)]) for i in range(times)]
        if all(_shape(p) == _shape(parts[0]) and _keeps_shared(p, parts[0]) for p in parts) and all(len(set(p)) == len(p) and _joined(p) for p in parts):
            return True
    return False


def _keeps_shared(a: tuple[Atom, ...], b: tuple[Atom, ...]) -> bool:
    """The renaming from one part to the other leaves the variables that both have alone."""
    shared = set(variables_of(a)) & set(variables_of(b))
    return all(x == y for p, q in zip(a, b) for x, y in zip((p.s, p.o), (q.s, q.o)) if x in shared or y in shared)


def _joined(part: tuple[Atom, ...]) -> bool:
    seen, rest = set(part[0].variables), list(part[1:])
    while rest:
        near = next((a for a in rest if seen & set(a.variables)), None)
        if near is None:
            return False
        seen |= set(near.variables)
        rest.remove(near)
    return True


def _shape(part: tuple[Atom, ...]) -> tuple:
    names: dict[str, int] = {}
    return tuple((a.r, names.setdefault(a.s, len(names)), names.setdefault(a.o, len(names))) for a in part)


def ground(atom: Atom) -> bool:
    return not atom.variables


def reflexive(atom: Atom) -> bool:
    """Both places have one variable."""
    return is_variable(atom.s) and atom.s == atom.o


def join_positions(a: Atom, b: Atom) -> list[tuple[int, int]]:
    """The places (0 or 2) at which two atoms have a variable in common."""
    return [(i, j) for i in (0, 2) for j in (0, 2) if is_variable(a.terms[i]) and a.terms[i] == b.terms[j]]


def rule_difference(a: Iterable[Rule], b: Iterable[Rule]) -> list[Rule]:
    """Rules of a that no rule of b is equivalent to."""
    known = {r.key for r in b}
    return [r for r in a if r.key not in known]


def single_path(rule: Rule) -> bool:
    return canonical_path(rule) is not None


def canonical_path(rule: Rule) -> list[Atom] | None:
    """The body in the order in which it leads from the head's subject to its object; None if it isn't one path."""
    if not (is_variable(rule.head.s) and is_variable(rule.head.o)):
        return None
    at, rest, out = rule.head.s, list(rule.body), []
    while rest:
        near = [a for a in rest if at in (a.s, a.o)]
        if len(near) != 1 or near[0].s == near[0].o:
            return None
        out.append(near[0])
        rest.remove(near[0])
        at = near[0].o if near[0].s == at else near[0].s
    return out if at == rule.head.o else None


def combine(rules: list[Rule]) -> Rule:
    """The joint rule: the most specific head, heads unified, other variables renamed apart, repeated atoms once."""
    head = min((r.head for r in rules), key=lambda h: number_of_variables(h))
    body: dict[Atom, None] = {}
    n = 0
    for r in rules:
        mapping = {v: t for v, t in zip((r.head.s, r.head.o), (head.s, head.o)) if is_variable(v)}
        for v in variables_of(r.body):
            if v not in mapping:
                mapping[v] = f"?v{n}"
                n += 1
        body |= dict.fromkeys(a.replace(mapping) for a in r.body)
    return Rule(head, tuple(body))


def pca_query(rule: Rule) -> list[Atom]:
    """The body and the head with a fresh variable on the side that isn't counted."""
    other = "?x" if "?x" not in rule.variables else rule.fresh()
    head = Atom(rule.head.s, rule.head.r, other) if rule.counted == 0 else Atom(other, rule.head.r, rule.head.o)
    return [*rule.body, head]


def hard_pair(atoms: list[Atom]) -> tuple[int, int] | None:
    """Two atoms of one relation that share exactly one side, looked for among pairs in order as long as relations are the same."""
    for i, a in enumerate(atoms):
        for j in range(i + 1, len(atoms)):
            b = atoms[j]
            if a.r != b.r or number_of_variables(a) != 2 or number_of_variables(b) != 2:
                return None
            if (a.s == b.s) != (a.o == b.o):
                return i, j
    return None


def leads_to_hard_case(rule: Rule, new: Atom) -> bool:
    """The rule has a hard pair already, and the new atom makes another with one of its two atoms."""
    pair = hard_pair(list(rule.atoms))
    return pair is not None and any(hard_pair([new, rule.atoms[i]]) is not None for i in pair)


# --- text forms

_DATALOG = re.compile(r"(<?[\w:.\-~/]+>?)\s*\(\s*([^\s,()]+)\s*,\s*([^\s,()]+)\s*\)")
_NATIVE = re.compile(r"(\?[\w]+|<[^>]*>|\"[^\"]*\"\S*|[^\s?<=\"]+)\s+(\?[\w]+|<[^>]*>|[^\s?<=\"]+)\s+(\?[\w]+|<[^>]*>|\"[^\"]*\"\S*|[^\s?<=\"]+)")


def parse_atoms(text: str) -> list[Atom]:
    """Atoms ``r(x,y)`` or, where there are none, ``s r o`` one after another."""
    if found := _DATALOG.findall(text):
        return [Atom(s, r, o) for r, s, o in found]
    return [Atom(*m) for m in _NATIVE.findall(text)]


def parse_rule(text: str) -> Rule | None:
    """``body => head`` or ``head :- body``; None where there are fewer than two atoms."""
    if ":-" in text:
        left, _, right = text.partition(":-")
        head, body = parse_atoms(left), parse_atoms(right)
        if len(head) != 1 or not body:
            return None
        return Rule(head[0], tuple(body))
    left, arrow, right = text.partition("=>")
    atoms = [*parse_atoms(left), *parse_atoms(right)] if arrow else parse_atoms(text)
    return Rule(atoms[-1], tuple(atoms[:-1])) if len(atoms) >= 2 else None


def normalise(rule: Rule) -> Rule:
    """Variables renamed ?a, ?b, ... in order of appearance, the body first."""
    names = fresh_variables()
    mapping: dict[str, str] = {}
    for v in variables_of([*rule.body, rule.head]):
        mapping[v] = next(names)
    return replace(rule, head=rule.head.replace(mapping), body=tuple(a.replace(mapping) for a in rule.body))


def _sorted_body(rule: Rule) -> list[Atom]:
    return sorted(set(rule.body), key=lambda a: (a.r, a.o, a.s))


def native_text(rule: Rule, ordered: bool = True) -> str:
    body = _sorted_body(rule) if ordered else rule.body
    parts = [f"{a.s}!={a.o} " if plain(a.r) == DIFFERENT else f"{a.s}  {a.r}  {a.o}  " for a in body]
    return "".join(parts) + f" => {rule.head.s}  {rule.head.r}  {rule.head.o}"


def datalog_text(rule: Rule) -> str:
    def one(a: Atom) -> str:
        return f"{plain(a.r)}({a.s},{a.o})"

    return " ".join(one(a) for a in _sorted_body(rule)) + " => " + one(rule.head)


def without_constants_repeated(rule: Rule) -> Rule:
    """Inequalities dropped whose variable is in no other atom."""
    used = variables_of(a for a in rule.atoms if plain(a.r) != DIFFERENT)
    return replace(rule, body=tuple(a for a in rule.body if plain(a.r) != DIFFERENT or a.s in used))

"""Conjunctive queries over facts, compiled to DataFrame joins.

Each ordinary atom is a projection of the facts on its variables; atoms are joined along shared variables, smaller relations first where
sizes are given, and columns that nothing later needs are dropped with duplicates at once, so existential parts stay small. Special
atoms become filters or semi and anti joins once their variables are bound, and generators otherwise:

``[x, differentFrom, y]``, ``[x, equals, y]``; ``[R, exists, x]`` (x is a subject of R), ``existsInv`` (an object), ``~exists``,
``~existsInv``; ``[x, hasNumberOfValues{Equals,GreaterThan,SmallerThan}{,Inv}N, R]``.

A bound entity passes ``~exists`` if it is no subject of R, whether known or not. Enumerated, ``~exists`` ranges over known subjects,
``~existsInv`` over known objects, and counts that 0 satisfies likewise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .terms import DIFFERENT, EQUALS, EXISTENCE, EXISTS, EXISTS_INV, NOT_EXISTS, NOT_EXISTS_INV, Atom, cardinality, is_variable, plain, variables_of


def name(variable: str) -> str:
    return variable.removeprefix("?")


def atom_frame(kb: DataFrame, atom: Atom) -> DataFrame:
    """The atom's bindings, a column for each variable. Distinct, as facts are, where all its places are fixed or kept."""
    conditions: list[Column] = []
    columns: dict[str, str] = {}
    for c, term in zip("sro", atom.terms):
        if not is_variable(term):
            conditions.append(F.col(c) == F.lit(term))
        elif term in columns:
            conditions.append(F.col(c) == F.col(columns[term]))
        else:
            columns[term] = c
    rows = kb.filter(reduce(Column.__and__, conditions)) if conditions else kb
    return rows.select(*[F.col(c).alias(name(v)) for v, c in columns.items()])


def universe(kb: DataFrame, column: str) -> DataFrame:
    return kb.select(F.col(column).alias("e")).distinct()


def existence_pairs(kb: DataFrame, kind: str) -> DataFrame:
    """``r``, ``e``: entities that are (or, negated, are not) on the relation's side."""
    c = "s" if kind in (EXISTS, NOT_EXISTS) else "o"
    pairs = kb.select("r", F.col(c).alias("e")).distinct()
    if kind in (EXISTS, EXISTS_INV):
        return pairs
    relations = kb.select("r").distinct()
    # "which relations does which entity lack" is a product by nature; ask with a constant on either side and there is none
    return universe(kb, c).join(relations, F.lit(True)).join(pairs, ["r", "e"], "left_anti")


def existence_frame(kb: DataFrame, atom: Atom) -> DataFrame:
    kind, relation, entity = plain(atom.r), atom.s, atom.o
    c = "s" if kind in (EXISTS, NOT_EXISTS) else "o"
    if not is_variable(relation):  # no product needed
        held = kb.filter(F.col("r") == relation).select(F.col(c).alias("e")).distinct()
        rows = held if kind in (EXISTS, EXISTS_INV) else universe(kb, c).join(held, "e", "left_anti")
        rows = rows.withColumn("r", F.lit(relation))
    elif not is_variable(entity) and kind in (NOT_EXISTS, NOT_EXISTS_INV):
        rows = kb.select("r").distinct().join(kb.filter(F.col(c) == entity).select("r"), "r", "left_anti").withColumn("e", F.lit(entity))
    else:
        rows = existence_pairs(kb, kind)
    if not is_variable(entity):
        rows = rows.filter(F.col("e") == entity)
    return rows.select(*[F.col(x).alias(name(v)) for x, v in (("r", relation), ("e", entity)) if is_variable(v)])


def cardinality_counts(kb: DataFrame, relation: str, inverse: bool) -> DataFrame:
    """``e``, ``n`` for all of the universe, 0 included."""
    c = "o" if inverse else "s"
    counts = kb.filter(F.col("r") == relation).groupBy(F.col(c).alias("e")).agg(F.count("*").alias("n"))
    return universe(kb, c).join(counts, "e", "left").select("e", F.coalesce("n", F.lit(0)).alias("n"))


def cardinality_frame(kb: DataFrame, atom: Atom) -> DataFrame:
    spec = cardinality(atom.r)
    if is_variable(atom.o):
        raise ValueError(f"the relation of {atom} must be a constant")
    rows = cardinality_counts(kb, atom.o, spec.inverse).filter({"Equals": F.col("n") == spec.n, "GreaterThan": F.col("n") > spec.n, "SmallerThan": F.col("n") < spec.n}[spec.kind])
    if not is_variable(atom.s):
        rows = rows.filter(F.col("e") == atom.s)
    return rows.select(*([F.col("e").alias(name(atom.s))] if is_variable(atom.s) else []))


def _join_special(kb: DataFrame, rows: DataFrame, atom: Atom, product: bool = False) -> DataFrame:
    bound = set(rows.columns)
    kind = plain(atom.r)
    value = lambda t: F.col(name(t)) if is_variable(t) else F.lit(t)
    if kind in (DIFFERENT, EQUALS):
        for v in atom.variables:
            if name(v) not in bound:
                if kind == DIFFERENT:
                    raise ValueError(f"{v} of an inequality is bound by no other atom")
                other = atom.o if v == atom.s else atom.s
                return rows.withColumn(name(v), value(other))
        return rows.filter(value(atom.s) != value(atom.o) if kind == DIFFERENT else value(atom.s) == value(atom.o))
    if kind in EXISTENCE:
        fixed = all(not is_variable(t) or name(t) in bound for t in (atom.s, atom.o))
        if fixed:
            c = "s" if kind in (EXISTS, NOT_EXISTS) else "o"
            pairs = kb.select(F.col("r").alias("_r"), F.col(c).alias("_e")).distinct()
            return rows.join(pairs, (pairs["_r"] == value(atom.s)) & (pairs["_e"] == value(atom.o)), "left_semi" if kind in (EXISTS, EXISTS_INV) else "left_anti")
        frame = existence_frame(kb, atom)
    else:
        frame = cardinality_frame(kb, atom)
    on = [c for c in frame.columns if c in bound]
    if frame.columns == on and on:
        return rows.join(frame, on, "left_semi")
    if not on and not product and rows.columns != ["_one"]:
        raise ValueError(f"{atom} shares no variable with the atoms before it: a product, to be asked for by product=True")
    return rows.join(frame, on) if on else rows.join(frame, F.lit(True))


def order_atoms(atoms: Sequence[Atom], sizes: dict[str, int] | None = None) -> list[Atom]:
    """Smallest relation first, then always an atom that shares a variable with those before, if there is one."""
    weight = lambda a: ((sizes or {}).get(a.r, 1 << 60) // (100 ** sum(not is_variable(t) for t in (a.s, a.o))), a)
    rest, out, seen = sorted(atoms, key=weight), [], set()
    while rest:
        nxt = next((a for a in rest if not out or not a.variables or seen & set(a.variables)), rest[0])
        rest.remove(nxt)
        out.append(nxt)
        seen |= set(nxt.variables)
    return out


def compile_query(kb: DataFrame, atoms: Sequence[Atom], outputs: Sequence[str], sizes: dict[str, int] | None = None, product: bool = False) -> DataFrame:
    """Distinct bindings of the output variables. Without outputs: one row if there is a binding, else none. Parts of a query that share no
    variable make a product, which ``product`` must allow."""
    ordinary = order_atoms([a for a in atoms if not a.special], sizes)
    special = [a for a in atoms if a.special]
    missing = [v for v in outputs if v not in variables_of(atoms)]
    if missing or not atoms:
        raise ValueError(f"no atom binds {missing or 'anything'}")
    generators = [a for a in special if plain(a.r) not in (DIFFERENT,)]
    rows: DataFrame | None = None
    # where no variable goes, bindings are as distinct as the atoms': these are made so where they meet, and the bindings, which are many more, aren't shuffled for it
    whole = len(ordinary) > 1 and not special and all(a.variables for a in ordinary) and set(variables_of(ordinary)) <= set(outputs)
    single = lambda frame, on: frame.repartition(*on).distinct() if on else frame.distinct()
    for i, atom in enumerate(ordinary):
        frame = atom_frame(kb, atom)
        later = set(map(name, variables_of([*ordinary[i + 1 :], *special]))) | set(map(name, outputs))
        if rows is None:
            rows = single(frame, [c for c in map(name, ordinary[1].variables) if c in frame.columns]) if whole else frame
        else:
            on = [c for c in frame.columns if c in rows.columns]
            frame = single(frame, on) if whole else frame
            new = [c for c in frame.columns if c not in on]
            if not any(c in later for c in new):
                rows = rows.join(frame.select(*on).distinct() if on else frame.limit(1), on or F.lit(True), "left_semi")
            else:
                needed = [c for c in frame.columns if c in on or c in later]
                frame = frame.select(*needed).distinct() if len(needed) < len(frame.columns) else frame
                if not on and not product and rows.columns != ["_one"]:
                    raise ValueError(f"{atom} shares no variable with the atoms before it: a product, to be asked for by product=True")
                rows = rows.join(frame, on) if on else rows.join(frame, F.lit(True))
        kept = [c for c in rows.columns if c in later]
        if len(kept) < len(rows.columns):
            rows = rows.select(*kept).distinct() if kept else rows.select(F.lit(1).alias("_one")).limit(1)
    if rows is None:
        if not generators:
            raise ValueError("inequalities alone bind nothing")
        first = next((a for a in generators if plain(a.r) != EQUALS), generators[0])
        if plain(first.r) == EQUALS:
            subjects = universe(kb, "s")
            values = [F.col("e").alias(name(v)) for v in first.variables]
            rows = subjects.select(*values) if values else subjects.limit(1)
            rows = rows.filter(F.col(rows.columns[0]) == F.lit(first.s if not is_variable(first.s) else first.o)) if len(values) == 1 else rows
        else:
            rows = existence_frame(kb, first) if plain(first.r) in EXISTENCE else cardinality_frame(kb, first)
        special.remove(first)
    for atom in sorted(special, key=lambda a: (plain(a.r) == DIFFERENT, not all(name(v) in rows.columns for v in a.variables))):
        rows = _join_special(kb, rows, atom, product)
    if not outputs:
        return rows.select(F.lit(1).alias("one")).limit(1)
    rows = rows.select(*map(name, outputs))
    return rows if whole else rows.distinct()


#: Values in one list of :func:`packed`; an entity with more has several lists.
LIST = 1024


def packed(kb: DataFrame, atoms: Sequence[Atom], x: str, y: str) -> DataFrame:
    """``x``, ``ys``: bindings of two variables, with lists of y's; a pair may be in several lists. Over a path x - z - y an x gets the lists of its z's, which are a
    fraction of the pairs in bytes. To be taken apart by :func:`tagged`."""
    ends = [set(a.variables) for a in atoms]
    if len(atoms) != 2 or any(a.special or is_variable(a.r) for a in atoms) or any(len(e) != 2 for e in ends) or len(middle := ends[0] & ends[1]) != 1 or ends[0] ^ ends[1] != {x, y}:
        return compile_query(kb, atoms, [x, y]).select(F.col(name(x)).alias("x"), F.array(F.col(name(y))).alias("ys"))
    one, two = atoms if x in ends[0] else atoms[::-1]
    z = name(middle.pop())
    first = atom_frame(kb, one).select(F.col(z).alias("z"), F.col(name(x)).alias("x"))
    second = atom_frame(kb, two).select(F.col(z).alias("z"), F.col(name(y)).alias("y"))
    part = F.floor((F.row_number().over(Window.partitionBy("z").orderBy("y")) - 1) / LIST)
    null = F.when(F.count("*") > F.count("y"), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))  # lists are made without nulls
    lists = second.withColumn("part", part).groupBy("z", "part").agg(F.concat(F.collect_list("y"), null).alias("ys"))
    return first.join(lists, "z").select("x", "ys")


def tagged(frames: Sequence[DataFrame]) -> DataFrame:
    """``x``, ``y``, ``tags``: the pairs of all frames (``x``, ``ys``), once each, with a bit for each frame that has them. All go to x once; what follows by x, or by x and y,
    needs no more shuffling."""
    rows = reduce(DataFrame.unionAll, [f.select("x", "ys", F.lit(1 << i).cast("long").alias("tag")) for i, f in enumerate(frames)])
    return rows.repartition("x").select("x", F.explode("ys").alias("y"), "tag").groupBy("x", "y").agg(F.bit_or("tag").alias("tags"))


def facts_packed(kb: DataFrame, relation: str) -> DataFrame:
    return kb.filter(F.col("r") == relation).select(F.col("s").alias("x"), F.array("o").alias("ys"))


def exists(kb: DataFrame, atoms: Sequence[Atom]) -> bool:
    """Whether there is a binding; of an empty query there is none."""
    return bool(atoms) and not compile_query(kb, atoms, []).isEmpty()


def contains(kb: DataFrame, atom: Atom) -> bool:
    """A fact, or a special atom without variables."""
    if atom.variables:
        raise ValueError(f"{atom} has variables")
    if not atom.special:
        return not atom_frame(kb, atom).isEmpty()
    kind = plain(atom.r)
    if kind == DIFFERENT:
        return atom.s != atom.o
    if kind == EQUALS:
        return atom.s == atom.o
    if kind in EXISTENCE:
        c = "s" if kind in (EXISTS, NOT_EXISTS) else "o"
        found = not kb.filter((F.col("r") == atom.s) & (F.col(c) == atom.o)).isEmpty()
        return found == (kind in (EXISTS, EXISTS_INV))
    return not cardinality_frame(kb, atom).isEmpty()


def select_distinct(kb: DataFrame, variables: Sequence[str], atoms: Sequence[Atom]) -> DataFrame:
    return compile_query(kb, atoms, variables)


def count(kb: DataFrame, atom: Atom) -> int:
    """Bindings of one atom; 0 or 1 without variables."""
    if not atom.variables:
        return int(contains(kb, atom))
    return compile_query(kb, [atom], atom.variables).count()


def count_distinct(kb: DataFrame, variables: Sequence[str], atoms: Sequence[Atom]) -> int:
    return compile_query(kb, atoms, variables).count()


def frequent_bindings(kb: DataFrame, variable: str, projected: str, atoms: Sequence[Atom]) -> DataFrame:
    """For each binding of the variable the number of distinct bindings of the projected one."""
    rows = compile_query(kb, atoms, [variable, projected])
    return rows.groupBy(name(variable)).agg(F.count("*").alias("n"))


def count_bindings(kb: DataFrame, variable: str, atom: Atom) -> DataFrame:
    if atom.position(variable) < 0:
        raise ValueError(f"{variable} isn't in {atom}")
    return atom_frame(kb, atom).groupBy(name(variable)).agg(F.count("*").alias("n"))


def count_projection(kb: DataFrame, head: Atom, others: Sequence[Atom]) -> DataFrame:
    """One row ``n``: bindings of the head's variables that the others can be satisfied with."""
    return compile_query(kb, [head, *others], head.variables).agg(F.count("*").alias("n"))


def count_projection_bindings(kb: DataFrame, head: Atom, others: Sequence[Atom], variable: str) -> DataFrame:
    """For each binding of the variable the number of distinct bindings of the head's variables. Where the head is a plain atom and the variable not its own, the others are reduced to
    their bindings of the variable and of what they share with the head, and the head to counts by that; their product is never made."""
    shared = [v for v in head.variables if v in variables_of(others)]
    if shared and not head.special and variable not in head.variables and variable in variables_of(others) and all(not a.special for a in others):
        on = list(map(name, shared))
        counts = compile_query(kb, [head], head.variables).groupBy(*on).agg(F.count("*").alias("n"))
        return compile_query(kb, others, [variable, *shared]).join(counts, on).groupBy(name(variable)).agg(F.sum("n").alias("n"))
    rows = compile_query(kb, [head, *others], list(dict.fromkeys([variable, *head.variables])))
    return rows.groupBy(name(variable)).agg(F.count("*").alias("n"))


def difference(kb: DataFrame, variables: Sequence[str], atoms: Sequence[Atom], without: Sequence[Atom]) -> DataFrame:
    """Bindings of the first query that the second, joined in the same variables, hasn't. Constants of the second stand as they are."""
    shared = [v for v in variables if v in variables_of(without)]
    if not shared:
        raise ValueError("the queries share no variable")
    return lacking(kb, variables, atoms, compile_query(kb, without, shared), shared)


def difference_no_vars_in_common(kb: DataFrame, variables: Sequence[str], atoms: Sequence[Atom], head: Atom) -> DataFrame:
    """Bindings of the query with which the query and the head together have no match."""
    shared = [v for v in head.variables if v in variables_of(atoms)]
    if shared and not head.special and set(shared) <= set(variables):
        return lacking(kb, variables, atoms, compile_query(kb, [head], shared), shared)
    have = compile_query(kb, atoms, variables)
    return have.join(compile_query(kb, [*atoms, head], variables), [name(v) for v in variables], "left_anti")


def lacking(kb: DataFrame, variables: Sequence[str], atoms: Sequence[Atom], gone: DataFrame, shared: Sequence[str]) -> DataFrame:
    """Bindings of a query whose values for the shared variables aren't in ``gone``. If all variables are asked for and an atom (x, y) hangs on the others by y alone, x being shared,
    the others' bindings go to x as lists, in a fraction of the bytes of all bindings, and are taken apart and looked up there. What one atom has all variables for is taken
    out of its facts."""
    on = list(map(name, shared))
    plain_ones = all(not a.special and not is_variable(a.r) and is_variable(a.s) and is_variable(a.o) and a.s != a.o for a in atoms)
    if len(atoms) > 1 and plain_ones and set(variables_of(atoms)) == set(variables):
        for i, atom in enumerate(atoms):
            rest = [*atoms[:i], *atoms[i + 1 :]]
            met = [v for v in atom.variables if v in variables_of(rest)]
            x = next((v for v in atom.variables if v not in met), None)
            if len(met) != 1 or x not in shared or not set(variables_of(rest)) <= set(variables):
                continue
            y, x = name(met[0]), name(x)
            first = atom_frame(kb, atom).repartition(y).distinct()
            if set(shared) <= set(atom.variables):
                own = compile_query(kb, rest, variables_of(rest))
                return first.join(gone, on, "left_anti").join(own, y).select(*map(name, variables))
            more = [name(v) for v in variables_of(rest) if name(v) != y]
            own = compile_query(kb, rest, variables_of(rest)).repartition(y)
            part = F.floor((F.row_number().over(Window.partitionBy(y).orderBy(*more)) - 1) / LIST)
            lists = own.withColumn("_part", part).groupBy(y, "_part").agg(F.collect_list(F.struct(*more)).alias("_own")).drop("_part")
            known = gone.dropna("any", subset=on)  # null is equal to nothing
            empty = lambda c: F.col(c) if c in on else F.lit(None).cast("string").alias(c)
            rows = first.join(lists, y).select(x, y, "_own", F.lit(False).alias("_gone"))
            rows = rows.unionAll(known.select(x, empty(y), F.array(F.struct(*map(empty, more))).alias("_own"), F.lit(True)))
            rows = rows.repartition(x).select(x, y, F.explode("_own").alias("_one"), "_gone").select(x, y, *[F.col(f"_one.{c}").alias(c) for c in more], "_gone")
            rows = rows.withColumn("_any", F.max("_gone").over(Window.partitionBy(*on)))
            return rows.filter("NOT _any").select(*map(name, variables))
    return compile_query(kb, atoms, variables).join(gone, on, "left_anti")


def query(kb: DataFrame, variables: str, text: str) -> DataFrame:
    """``query(kb, "?a,?b", "livesIn(?a,?b) bornIn(?a,?c)")``."""
    from .terms import parse_atoms

    return compile_query(kb, parse_atoms(text), [v.strip() for v in variables.split(",")])

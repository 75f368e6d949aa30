"""Line notations of small graphs (atoms and bonds) and what Spark computes from them.

A small reader turns a text into two arrays, atoms and directed bonds; all else is
column expressions over these: canonical form by iterated refinement of atom
classes, and descriptors. No row is exploded and nothing is shuffled.

Read are atoms of the organic subset, bracket atoms with isotope, hydrogens and charge, bonds, branches, ring
closures and parts; marks of stereo are read over. Texts that are not such a notation,
and atoms with more bonds than they can have, are invalid. Aromatic atoms are taken
as written: rings are not tested for aromaticity.

The canonical form names the classes of atoms and the bonds between them. Refinement
goes on as many rounds as there are atoms, starting from element, charge,
hydrogens, aromaticity and the size of the smallest ring of each bond. Texts of one graph have one form; different graphs that refinement cannot
tell apart (none of the small molecules it was tried on) would share one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

GRAPH = "struct<atoms:array<struct<el:string,aromatic:boolean,isotope:int,charge:int,h:int>>,bonds:array<struct<a:int,b:int,kind:int,ring:int>>>"
#: Bonds that an atom of the organic subset can have, and mean masses.
VALENCES = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1,)}
MASSES = {"H": 1.008, "B": 10.812, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "P": 30.974, "S": 32.067, "Cl": 35.453, "Br": 79.904, "I": 126.904, "Si": 28.086, "Se": 78.96, "Na": 22.99, "K": 39.098}
#: Polar area of an atom by element, aromaticity, hydrogens and its highest bond.
POLAR = {
    ("N", False, 0, 1): 3.24, ("N", False, 1, 1): 12.03, ("N", False, 2, 1): 26.02, ("N", False, 0, 2): 12.36, ("N", False, 1, 2): 23.85, ("N", False, 0, 3): 23.79,
    ("N", True, 0, 4): 12.89, ("N", True, 1, 4): 15.79, ("O", False, 0, 1): 9.23, ("O", False, 1, 1): 20.23, ("O", False, 0, 2): 17.07, ("O", True, 0, 4): 13.14,
}
AROMATIC = 4
_TOKEN = re.compile(r"(?P<bracket>\[(?P<iso>\d+)?(?P<el>[A-Z][a-z]?|[bcnops]|se)(?P<chir>@{0,2})(?P<h>H\d?)?(?P<q>\+{1,3}|-{1,3}|[+-]\d)?(?::\d+)?\])|(?P<atom>Cl|Br|[BCNOPSFI]|[bcnops])|(?P<bond>[-=#:/\\])|(?P<ring>\d|%\d\d)|(?P<mark>[().])")
_KINDS = {"-": 1, "/": 1, "\\": 1, "=": 2, "#": 3, ":": AROMATIC}


def read_graph(text: str | None) -> dict | None:
    """Atoms and bonds of a text; None where it is no notation of a graph."""
    atoms, bonds, branches, rings, last, kind, at = [], [], [], {}, None, None, 0
    text = (text or "").strip()

    def join(a: int, b: int, kind: int | None) -> None:
        both = atoms[a]["aromatic"] and atoms[b]["aromatic"]
        bonds.append((a, b, kind or (AROMATIC if both else 1)))

    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            return None
        at = m.end()
        if m["bracket"] or m["atom"]:
            name = m["el"] or m["atom"]
            if name.capitalize() not in MASSES:
                return None
            q = m["q"] or ""
            charge = int(q) if q[1:].isdigit() else q.count("+") - q.count("-")
            h = (int(m["h"][1:] or 1) if m["h"] else 0) if m["bracket"] else -1
            atoms.append({"el": name.capitalize(), "aromatic": name.islower(), "isotope": int(m["iso"] or 0), "charge": charge, "h": h})
            if last is not None:
                join(last, len(atoms) - 1, kind)
            elif kind is not None:
                return None
            last, kind = len(atoms) - 1, None
        elif m["bond"]:
            if kind is not None or last is None:
                return None
            kind = _KINDS[m["bond"]]
        elif m["ring"]:
            if last is None:
                return None
            name = m["ring"].lstrip("%").lstrip("0") or "0"
            if name in rings:
                other, other_kind = rings.pop(name)
                if other == last or any({a, b} == {other, last} for a, b, _ in bonds) or (kind and other_kind and kind != other_kind):
                    return None
                join(other, last, kind or other_kind)
            else:
                rings[name] = last, kind
            kind = None
        elif m["mark"] == "(":
            if last is None or kind is not None:
                return None
            branches.append(last)
        elif m["mark"] == ")":
            if not branches or kind is not None or text[m.start() - 1] == "(":
                return None
            last = branches.pop()
        else:
            if branches or kind is not None or last is None:
                return None
            last = None
    if rings or branches or kind is not None or not atoms or last is None:
        return None
    for k, atom in enumerate(atoms):
        kinds = [o for a, b, o in bonds if k in (a, b)]
        used = sum(1 if o == AROMATIC else o for o in kinds) + (AROMATIC in kinds and atom["el"] in "BCNP" and not (atom["el"] == "N" and (atom["h"] > 0 or len(kinds) > 2)))
        room = VALENCES.get(atom["el"])
        if atom["h"] < 0:
            atom["h"] = 0 if atom["aromatic"] and atom["el"] != "C" else next((v - used for v in room if v >= used), -1)
            if atom["h"] < 0:
                return None
        elif room and used + atom["h"] > max(room) + abs(atom["charge"]):
            return None
    own = _ring_sizes(len(atoms), bonds)
    return {"atoms": atoms, "bonds": [{"a": x, "b": y, "kind": o, "ring": r} for (a, b, o), r in zip(bonds, own) for x, y in ((a, b), (b, a))]}


def _ring_sizes(n: int, bonds: list[tuple]) -> list[int]:
    """For each bond the size of the smallest ring that it is in, 0 for none."""
    near = [[] for _ in range(n)]
    for k, (a, b, _) in enumerate(bonds):
        near[a].append((b, k))
        near[b].append((a, k))
    out = []
    for k, (a, b, _) in enumerate(bonds):
        steps, layer = {a: 1}, [a]
        while layer and b not in steps:
            layer = [other for x in layer for other, bond in near[x] if bond != k and steps.setdefault(other, steps[x] + 1) == steps[x] + 1]
        out.append(steps.get(b, 0))
    return out


def parsed(text: Column) -> Column:
    """The graph of a text, or null: the only Python here."""
    @F.pandas_udf(GRAPH)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [read_graph(t) or {"atoms": None, "bonds": None} for t in batch]
            yield pd.DataFrame({"atoms": [g["atoms"] for g in found], "bonds": [g["bonds"] for g in found]})

    return read(text)


def _classes(graph: Column) -> Column:
    """A class for each atom, refined by its neighbours' classes as many rounds as there are atoms."""
    atoms, bonds = graph["atoms"], graph["bonds"]
    start = F.transform(atoms, lambda a: F.xxhash64(a["el"], a["aromatic"], a["isotope"], a["charge"], a["h"]))

    def refine(classes: Column, _: Column) -> Column:
        seen = lambda i: F.array_sort(F.transform(F.filter(bonds, lambda b: b["a"] == i), lambda b: F.xxhash64(b["kind"], b["ring"], F.get(classes, b["b"]))))
        return F.transform(classes, lambda c, i: F.xxhash64(c, F.array_join(F.transform(seen(i), lambda x: x.cast("string")), ",")))

    return F.aggregate(F.sequence(F.lit(1), F.size(atoms)), start, refine)


def canonical(graph: Column, classes: Column) -> Column:
    """The form of a graph with its ``refined`` classes; the empty string for null."""
    atoms, bonds = graph["atoms"], graph["bonds"]
    order = F.array_sort(F.array_distinct(classes))
    rank = lambda c: F.array_position(order, c)
    name = lambda a: F.concat(F.when(a["isotope"] > 0, a["isotope"].cast("string")).otherwise(""), F.when(a["aromatic"], F.lower(a["el"])).otherwise(a["el"]), F.lit("H"), a["h"].cast("string"), F.when(a["charge"] != 0, F.format_string("%+d", a["charge"])).otherwise(""))
    nodes = F.array_sort(F.transform(atoms, lambda a, i: F.concat(F.lpad(rank(F.get(classes, i)).cast("string"), 4, "0"), F.lit(":"), name(a))))
    edges = F.array_sort(F.transform(F.filter(bonds, lambda b: b["a"] < b["b"]), lambda b: F.concat(
        F.least(rank(F.get(classes, b["a"])), rank(F.get(classes, b["b"]))).cast("string"), F.element_at(F.array(*map(F.lit, "-=#:")), b["kind"]), F.greatest(rank(F.get(classes, b["a"])), rank(F.get(classes, b["b"]))).cast("string"), F.when(b["ring"] > 0, F.concat(F.lit("@"), b["ring"].cast("string"))).otherwise(""))))
    return F.coalesce(F.concat(F.array_join(nodes, "."), F.lit("|"), F.array_join(edges, ",")), F.lit(""))


def descriptors(graph: Column) -> Column:
    """``struct<weight, donors, acceptors, rotatable, polar_area, rings, heavy_atoms>``; null fields for no graph.

    Donors are N and O with hydrogens. Acceptors are O and S but for those of acids, N that
    no neighbour's double bond outside rings to O, N, P or S takes up, and aromatic n, o and s without hydrogens. Rotatable are single bonds outside rings
    between atoms with further neighbours, less amide bonds and those at a triple bond.
    """
    atoms, bonds = graph["atoms"], graph["bonds"]
    of = lambda i: F.filter(bonds, lambda b: b["a"] == i)
    el = lambda i: F.get(atoms, i)["el"]
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda n, x: n + x)
    count = lambda xs: F.size(F.filter(xs, lambda x: x)).cast("long")
    mass = F.create_map(*(F.lit(x) for k, v in MASSES.items() for x in (k, v)))
    polar = F.create_map(*(F.lit(x) for (e, a, h, o), v in POLAR.items() for x in (f"{e}{a}{h}{o}".lower(), v)))
    to_hetero = lambda i, ring_too: F.exists(of(i), lambda b: (b["kind"] == 2) & el(b["b"]).isin("O", "N", "P", "S") & (F.lit(ring_too) | (b["ring"] == 0)))
    taken = lambda i, ring_too: F.exists(of(i), lambda b: to_hetero(b["b"], ring_too))
    order = lambda i: total(F.transform(of(i), lambda b: b["kind"].cast("double")))

    def accepts(a: Column, i: Column) -> Column:
        chalcogen, valence = a["el"].isin("O", "S") & ~a["aromatic"], order(i) + a["h"]
        plain = chalcogen & (valence == 2) & ((a["h"] == 0) | ((a["h"] == 1) & ~taken(i, True)))
        amine = (a["el"] == "N") & ~a["aromatic"] & (valence == 3) & ~F.exists(of(i), lambda b: (b["kind"] == 1) & to_hetero(b["b"], False))
        return plain | (chalcogen & (a["charge"] < 0)) | amine | (a["aromatic"] & a["el"].isin("N", "O", "S") & (a["h"] == 0) & (a["charge"] == 0))

    def turns(b: Column) -> Column:
        inner = lambda i: F.size(of(i)) > 1
        triple = lambda i: F.exists(of(i), lambda x: x["kind"] == 3)
        amide = lambda c, n: (el(c) == "C") & (el(n) == "N") & F.exists(of(c), lambda x: (x["kind"] == 2) & (el(x["b"]) == "O"))
        x, y = b["a"], b["b"]
        return (x < y) & (b["kind"] == 1) & (b["ring"] == 0) & inner(x) & inner(y) & ~triple(x) & ~triple(y) & ~amide(x, y) & ~amide(y, x)

    highest = lambda i: F.coalesce(F.array_max(F.transform(of(i), lambda b: b["kind"])), F.lit(1))
    area = lambda a, i: F.coalesce(F.try_element_at(polar, F.lower(F.concat(a["el"], a["aromatic"].cast("string"), a["h"].cast("string"), highest(i).cast("string")))), F.lit(0.0))
    # rings: bonds less atoms plus parts; parts are counted by the classes that spread along bonds
    spread = F.aggregate(F.sequence(F.lit(1), F.size(atoms)), F.transform(atoms, lambda a, i: i), lambda own, _: F.transform(own, lambda c, i: F.least(c, F.coalesce(F.array_min(F.transform(of(i), lambda b: F.get(own, b["b"]))), c))))
    parts = F.size(F.array_distinct(spread))
    return F.struct(
        F.round(total(F.transform(atoms, lambda a: F.try_element_at(mass, a["el"]) + a["h"] * MASSES["H"])), 3).alias("weight"),
        F.when(atoms.isNotNull(), count(F.transform(atoms, lambda a: a["el"].isin("N", "O") & (a["h"] > 0)))).alias("donors"),
        F.when(atoms.isNotNull(), count(F.transform(atoms, accepts))).alias("acceptors"),
        F.when(atoms.isNotNull(), count(F.transform(bonds, turns))).alias("rotatable"),
        F.round(total(F.transform(atoms, area)), 2).alias("polar_area"),
        F.when(atoms.isNotNull(), (F.size(bonds) / 2 - F.size(atoms) + parts).cast("long")).alias("rings"),
        F.when(atoms.isNotNull(), F.size(atoms).cast("long")).alias("heavy_atoms"),
    )


def forms(rows, text: str, name: str = "form"):
    """The table with each text's canonical form and descriptors; each distinct text is read once."""
    distinct = rows.select(text).distinct()
    read = distinct.withColumn("_graph", parsed(F.col(text)))
    classed = read.withColumn("_classes", _classes(F.col("_graph")))
    done = classed.select(F.col(text).alias("_text"), canonical(F.col("_graph"), F.col("_classes")).alias(name), descriptors(F.col("_graph")).alias("descriptors"))
    return rows.join(done, F.col(text).eqNullSafe(F.col("_text")), "left").drop("_text")

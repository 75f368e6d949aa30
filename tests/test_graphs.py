"""Graph texts: one form for each graph however it is written, invalid texts, descriptors of known cases."""

import random

import pytest
from pyspark.sql import functions as F

from sieveworks.functions import graphs

SAME = [
    ("CCO", "OCC", "C(O)C", "[CH3][CH2][OH]", "C-C-O"), ("c1ccccc1C", "Cc1ccccc1", "c1cc(C)ccc1"), ("CC(=O)O", "OC(C)=O", "O=C(O)C"), ("C1CC2CCC1CC2", "C1CC2CCC1CC2", "C2CC1CCC2CC1"),
    ("CCN(C)C(=O)NCCO", "OCCNC(=O)N(C)CC", "O=C(NCCO)N(CC)C"), ("[Na+].[O-]C", "C[O-].[Na+]"), ("F/C=C\\F", "FC=CF"), ("C%12CCCC%12", "C1CCCC1"), ("[nH]1cccc1", "c1cc[nH]c1"), ("[13CH4]",), ("CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "Cn1c(=O)c2c(ncn2C)n(C)c1=O"[:0] or "CN1C(=O)N(C)C(=O)C2=C1N=CN2C"),
    ("C1CCC2CCCCC2C1",), ("C1CCC(C1)C1CCCC1",), ("CO",), ("CS",), ("C#N",), ("C=N",), ("CCCl",), ("CCBr",), ("C1CCCCC1.C1CCCCC1",), ("C1CCCCCCCCCCC1",),
]
INVALID = ["", " ", None, "C(", "C)", "C1CC", "CX", "C==C", "(C)", "C()C", "=C", "C=", ".C", "C.", "C(=)C", "F(C)C", "C(C)(C)(C)(C)C", "C11", "C1C1", "[C", "[Xx]", "N(C)(C)(C)(C)(C)C", "1CC", "C-1CCC=1", "[CH5]"]


def test_texts_of_one_graph_have_one_form(spark):
    rows = [(k, t) for k, texts in enumerate(SAME) for t in texts] + [(-1, t) for t in INVALID]
    got = graphs.forms(spark.createDataFrame(rows, "k int, t string"), "t").collect()
    by = {}
    for r in got:
        by.setdefault(r.k, set()).add(r.form)
    assert by.pop(-1) == {""} and all(len(f) == 1 for f in by.values()), by
    assert len({f for fs in by.values() for f in fs}) == len(SAME) and len(got) == len(rows)
    assert {r.descriptors.weight for r in got if r.k == -1} == {None} and {r.descriptors.donors for r in got if r.k == -1} == {None}


def written(atoms, bonds, rng):
    """A random tree's text, from a random atom and in random order."""
    near = {k: [] for k in range(len(atoms))}
    for a, b, mark in bonds:
        near[a].append((b, mark))
        near[b].append((a, mark))

    def walk(k, seen):
        seen.add(k)
        rest = [x for x in near[k] if x[0] not in seen]
        rng.shuffle(rest)
        parts = [mark + walk(n, seen) for n, mark in rest]
        return atoms[k] + "".join(f"({p})" for p in parts[:-1]) + "".join(parts[-1:])

    return walk(rng.randrange(len(atoms)), set())


def test_random_trees_written_in_any_order(spark):
    rng = random.Random(4)
    rows = []
    for k in range(25):
        n = rng.randint(2, 14)
        parent = [rng.randrange(max(0, i - 3), i) for i in range(1, n)]
        degree = [parent.count(i) + (i > 0) for i in range(n)]
        atoms = [rng.choice(["C", "N", "O"][:5 - d] if d < 4 else ["C"]) if d < 3 else rng.choice(["C", "N"]) if d == 3 else "C" if d == 4 else "[Si]" for d in degree]
        atoms = [a if d <= {"C": 4, "N": 3, "O": 2}.get(a, 9) else "C" for a, d in zip(atoms, degree)]
        bonds = [(i + 1, p, "") for i, p in enumerate(parent)]
        rows += [(k, written(atoms, bonds, rng)) for _ in range(4)]
    forms = {}
    for r in graphs.forms(spark.createDataFrame(rows, "k int, t string"), "t").collect():
        forms.setdefault(r.k, set()).add(r.form)
    assert all(len(f) == 1 and f != {""} for f in forms.values())


def test_descriptors_of_known_cases(spark):
    known = {  # weight, donors, acceptors, rotatable, polar area, rings, heavy atoms
        "CCN(C)C(=O)NCCO": (146.19, 2, 2, 3, 52.57, 0, 10), "CCO": (46.069, 1, 1, 0, 20.23, 0, 3), "CC(=O)O": (60.052, 1, 1, 0, 37.3, 0, 4), "c1ccccc1": (78.114, 0, 0, 0, 0.0, 1, 6),
        "c1ccncc1": (79.102, 0, 1, 0, 12.89, 1, 6), "CC(=O)Oc1ccccc1C(=O)O": (180.159, 1, 3, 3, 63.6, 1, 13), "CCCCC": (72.151, 0, 0, 2, 0.0, 0, 5), "C1CCC2CCCCC2C1": (138.254, 0, 0, 0, 0.0, 2, 10),
    }
    df = spark.createDataFrame([(t,) for t in known], "t string")
    for r in graphs.forms(df, "t").collect():
        want = known[r.t]
        assert tuple(r.descriptors)[1:4] == want[1:4] and tuple(r.descriptors)[5:] == want[5:], (r.t, r.descriptors)
        assert r.descriptors.weight == pytest.approx(want[0], abs=0.02) and r.descriptors.polar_area == pytest.approx(want[4], abs=0.02), (r.t, r.descriptors)

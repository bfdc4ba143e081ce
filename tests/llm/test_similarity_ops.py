"""Jaccard join and lattice near-dedup against brute force, with ties, copies, nulls and groups."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np

from factweave.llm import components, jaccard, lattice


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    random.seed(1)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({n for x in links for n in x}, links)
    assert all(got.get(n, n) == r for n, r in want.items())


def plain_join(rows, gram=4):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = frozenset(tuple(words[k : k + gram]) for k in range(max(1, len(words) - gram + 1))) if words else frozenset()
    links = []
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    links.append((a, b))
    return sets, roots(ids, links)


def test_jaccard_equals_brute_force(spark):
    random.seed(7)
    word = lambda: "w" + str(random.randrange(4000))
    texts = [None, "", " \n ", "one", "ONE", "one two three", "É é", "é É"]
    for _ in range(25):
        base = [word() for _ in range(random.choice([5, 30, 120]))]
        for _ in range(random.choice([1, 2, 14])):
            copy = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 4])):
                copy[random.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    common = " ".join(word() for _ in range(60))
    texts += [common + " " + " ".join(word() for _ in range(random.choice([2, 8, 40]))) for _ in range(40)]
    texts += [texts[-1]] * 5 + ["long " + " ".join(word() for _ in range(30_000))]
    rows = list(enumerate(texts))
    sets, want = plain_join(rows)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, size string")
    got = {r.doc_id: r for r in jaccard.join(df).collect()}
    assert len(got) == len(rows)
    for i, _ in rows:
        assert got[i].n_shingles == len(sets[i]) and got[i].component_id == want[i], i
    assert jaccard.join(df.limit(0)).count() == 0


def test_jaccard_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (None, "")], "doc_id long, text string")
    assert sorted((r.n_shingles, r.component_id or -1) for r in jaccard.join(df).collect()) == [(0, -1), (2, 3), (2, 3)]


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)) * 2
    point = lattice.decode(x)
    twice = np.rint(2 * point)
    assert np.allclose(twice, 2 * point) and (np.ptp(twice % 2, axis=1) == 0).all() and (point.sum(1) % 2 == 0).all()
    near = ((x - point) ** 2).sum(1)
    for v in lattice.neighbours():
        assert (((x - point - v) ** 2).sum(1) >= near - 1e-9).all()
    assert len(lattice.neighbours()) == 240 and np.allclose((lattice.neighbours() ** 2).sum(1), 2)


def vectors():
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=64).tolist(), k % 3) for k in range(150)]
    for c in range(6):
        base = rng.normal(size=64)
        for _ in range(25):
            rows.append((len(rows), (base + rng.normal(size=64) * rng.choice([0.05, 0.2, 0.27])).tolist(), c % 3))
    rows += [(len(rows) + k, rows[10][1], rows[10][2]) for k in range(7)]
    return rows


def test_lattice_equals_brute_force(spark):
    rows = vectors()
    n = len(rows)
    odd = [(n, None, 1), (n + 1, [0.0] * 64, 1), (n + 2, [None] + [1.0] * 63, 1), (n + 3, [float("nan")] * 64, 1), (n + 4, rows[0][1], None), (n + 5, [1.0, 2.0], 1), (n + 6, [2.0, 4.0], 1), (n + 7, [], 1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows + odd], "vec_id long, embedding array<double>, label int, links string")
    got = {r.vec_id: r for r in lattice.near_duplicates(df, chunk=16).collect()}
    unit = np.asarray([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.asarray([r[2] for r in rows])
    ok = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(ok, False)
    found, true = sum(got[k].n_links for k in range(n)), int(ok.sum())
    assert true > 500 and 0.97 * true <= found <= true
    for k in range(n):
        assert got[k].n_links <= ok[k].sum() and got[k].kept == (got[k].component_id == k)
    want = roots(range(n), [(int(a), int(b)) for a, b in np.argwhere(ok) if a < b])
    assert np.mean([got[k].component_id == want[k] for k in range(n)]) >= 0.97
    for k in (n, n + 1, n + 2, n + 3, n + 4, n + 7):
        assert got[k].n_links == 0 and got[k].component_id == k and got[k].kept
    assert got[n + 5].n_links == got[n + 6].n_links == 1 and got[n + 6].component_id == n + 5
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_lattice_recall_at_the_threshold():
    """Pairs at cosine 0.93 exactly: at least nine in ten must meet (0.999 expected)."""
    rng = np.random.default_rng(8)
    u = rng.normal(size=(2000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=(2000, 64))
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = 0.93 * u + np.sqrt(1 - 0.93**2) * w
    group = np.zeros(2000, dtype=np.int64)
    a, b = (lattice.cells(x, group, lattice.TABLES, lattice.PROBES, lattice.SCALE) for x in (u, v))
    met = ((a == b[:, :, :1]).any(2) | (b == a[:, :, :1]).any(2)).any(1)
    assert met.mean() >= 0.99


def test_counts_are_not_repeated_across_tables():
    rng = np.random.default_rng(1)
    x = rng.normal(size=64) + rng.normal(size=(60, 64)) * 0.15
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    group, ids, total = np.zeros(60, np.int64), np.arange(60), np.zeros(60, int)
    cells, keys = defaultdict(list), lattice.cells(unit, group, 4, 8, 2.0)
    for i, t, p in np.ndindex(60, 4, 9):
        cells[keys[i, t, p]].append((i, p == 0))
    for key, members in cells.items():
        i = np.asarray([m for m, _ in members])
        home = np.asarray([h for _, h in members])
        got = lattice._meet(int(key), ids[i], np.ones(len(i), int), group[i], unit[i], home, np.zeros(len(i), int), False, (0.93, 4, 8, 2.0))
        if got is not None:
            np.add.at(total, got[0], got[1])
    assert (total == (unit @ unit.T >= 0.93).sum(1) - 1).all()



def test_rows_that_share_an_id_have_links_of_their_own(spark):
    v = lambda *x: [float(y) for y in x] + [0.0] * 6
    rows = [(5, v(1, 0), 1), (5, v(0, 1), 1), (7, v(1, 0.01), 1), (6, v(0.01, 1), 1), (5, v(-1, -1), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in lattice.near_duplicates(df).collect())
    assert got == [(5, 0, 5), (5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 1, 5)]

"""Conversation repair, exact centroids and the forest of links against brute force, and awkward tables."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.llm import audit, centroids, forest

CONV = "conv_id long, turn long, role string, text string"
VEC = "vec_id long, embedding array<float>, label int"


def cheapest(codes):
    """All edit strings of a few rows by plain recursion: the least (cost, edits) that gives a legal conversation."""
    found = []

    def legal(roles):
        body = roles[1:] if roles[:1] == "s" else roles
        return roles == "" or len(body) >= 2 and len(body) % 2 == 0 and all(r == "ua"[i % 2] for i, r in enumerate(body))

    def go(at, roles, edits, cost, inserted):
        if at == len(codes):
            if legal(roles):
                found.append((cost, edits))
        else:
            c = codes[at]
            go(at + 1, roles, edits + "D", cost + 3, inserted)
            if c != "D":
                extra = c.isupper()
                go(at + 1, roles + c.lower(), edits + "K", cost + extra, inserted)
                for r in "ua":
                    go(at + 1, roles + r, edits + "R", cost + extra + 2, inserted)
        if inserted < 3:
            for r in "ua":
                go(at, roles + r, edits + "I", cost + 2, inserted + 1)

    go(0, "", "", 0, 0)
    return min(found)


def plain(codes):
    """The same by strings, for long conversations."""

    def insert(best):
        for s in (0, 1, 3, 2):
            if s in best:
                n, new = audit.NEXT[s], (best[s][0] + 2, best[s][1] + "I")
                best[n] = min(best.get(n, new), new)
        return best

    best = insert({0: (0, "")})
    for c in codes:
        new = {}
        for s, (cost, edits) in best.items():
            offers = [(s, cost + 3, "D")]
            if c != "D":
                n, extra = audit.NEXT[s], c.isupper()
                offers.append((n, cost + 2 + extra, "R"))
                if c.lower() == ("u" if n == 2 else "a"):
                    offers.append((n, cost + extra, "K"))
                if c.lower() == "s" and s == 0:
                    offers.append((1, cost + extra, "K"))
            for to, price, edit in offers:
                new[to] = min(new.get(to, (price, edits + edit)), (price, edits + edit))
        best = insert(new)
    return min(best[s] for s in (0, 3) if s in best)


def solved(codes, settle=0):
    a, done = audit.Audit(), ""
    for i, c in enumerate(codes):
        a.row(c)
        if settle and i % settle == 0:
            done += a.settled()
    rest, cost = a.end()
    return cost, done + rest


def test_audit_against_all_edit_strings():
    for n in range(4):
        for codes in itertools.product("DsuaUAo", repeat=n):
            assert solved(codes) == cheapest(codes), codes


def test_long_audits_and_settling():
    rng = random.Random(3)
    for n in (50, 300, 1500):
        codes = rng.choices("DsuaUASo", k=n)
        assert solved(codes) == solved(codes, 7) == plain(codes)
    codes = "u" * 700 + "a" * 700 + "D" * 100
    assert solved(codes, 64) == plain(codes)


def test_prefix_order_survives_collisions():
    """With a hash that tells nothing, verification alone orders the prefixes."""
    rng = random.Random(5)
    for modulus in (1, 2, audit.MODULUS):
        tree, strings = audit.Prefixes(), {0: ""}
        was, audit.MODULUS = audit.MODULUS, modulus
        try:
            for _ in range(300):
                node, c = rng.choice(list(strings)), rng.choice("DIKR")
                strings[tree.add(node, c)] = strings[node] + c
        finally:
            audit.MODULUS = was
        for _ in range(2000):
            a, b = rng.choices(list(strings), k=2)
            if strings[a] != strings[b]:
                assert tree.before(a, b) == (strings[a] < strings[b])


def by_hand(rows):
    """(codes, faults) of rows (turn, role, text) in order."""
    seen, codes, faults = set(), "", []
    for _, role, text in rows:
        left = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else ""
        seen.add((role, text))
        code = role[:1] if role[:1] in ("s", "u", "a") else "o"
        codes += "D" if fault in ("blank", "duplicate") else code.upper() if fault else code
        faults.append(fault)
    return codes, faults


def test_repaired_rows(spark):
    rng, rows = random.Random(9), []
    for conv in range(60):
        for turn in range(rng.randrange(1, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "No", " ", "Why?", "x" * 40 + "!"])))
    rows += [(70, i, "user", f"{i}.") for i in range(audit.SHORT + 9)]
    got = {}
    for r in audit.repaired(spark.createDataFrame(rows, CONV)).collect():
        got.setdefault(r.conv, []).append(r)
    for conv, own in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[1])), key=lambda r: r[0]):
        own = [r[1:] for r in own]
        codes, faults = by_hand(own)
        out = sorted(got[conv], key=lambda r: r.place)
        assert (sum(r.cost for r in out), "".join(r.edit for r in out)) == plain(codes)
        assert [r.fault for r in out if r.edit != "I"] == faults
        assert [(r.turn, r.was, r.text) for r in out if r.edit != "I"] == own
        roles = "".join(r.role[:1] for r in out if r.edit != "D")
        body = roles.removeprefix("s")
        assert body == "ua" * (len(body) // 2) and (body or not roles)


def test_audit_report_of_awkward_rows(spark):
    empty = audit.audit_report(spark.createDataFrame([], CONV))
    assert empty.count() == 0 and len(empty.columns) == 9
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (5, None, "user", "Ho."), (5, None, "user", "Ho."), (5, 9, "assistant", "Long. " * 50_000)]
    df = spark.createDataFrame(rows, CONV).withColumn("CODE", F.lit(1)).withColumn("fault", F.lit("x")).withColumn("conv", F.lit(2))
    got = {r.conv_id: r for r in audit.audit_report(df).collect()}
    assert set(got) == {None, 5}
    again = {r.conv_id: r for r in audit.audit_report(df.repartition(3)).collect()}
    assert got == again
    whole = audit.digests(audit.repaired(spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 3, "user", "a."), (1, 3, "user", "a."), (1, 7, "assistant", "b.")], CONV))).head()
    assert (whole.gaps, whole.duplicate, whole.illegal, whole.cost, whole.audit) == (5, 1, 1, 3, "KKDK")
    assert whole.repaired_sha256 == hashlib.sha256(b"system:Be kind.\nuser:a.\nassistant:b.").hexdigest()


def test_audit_report_of_a_lost_conversation(spark):
    """A conversation whose rows are all dropped has zeros."""
    rows = [(c, 0, "user", "Hi.") for c in range(200)]
    got = audit.audit_report(spark.createDataFrame(rows, CONV)).collect()
    lost = [r for r in got if r.audit == ""]
    assert len(got) == 200 and lost
    assert {(r.gaps, r.cost, r.repaired_sha256) for r in lost} == {(0, 0, hashlib.sha256(b"").hexdigest())}


def brute_kmeans(ids, q, k, rounds):
    first = sorted((i for i in range(len(ids)) if ids[i] is not None), key=lambda i: (hashlib.sha256(f"2:{ids[i]}".encode()).hexdigest(), q[i].tolist()))[:k]
    centers = q[first].copy()
    for _ in range(rounds):
        a = ((q[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        for c in range(len(centers)):
            if (a == c).any():
                centers[c] = q[a == c].sum(0) // (a == c).sum()
    d = ((q[:, None] - centers[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1), centers


@pytest.mark.parametrize("spread", [1.0, 0.004, 0.0])
def test_centroids(spark, spread):
    """Plain, nearly tied and wholly tied vectors."""
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((400, 64)) * spread + 0.5 * rng.integers(0, 3, (400, 1)) * (spread > 0)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    found, centers = centroids.kmeans(spark.createDataFrame(rows, VEC).repartition(3), k=12, rounds=4)
    cluster, distance, want = brute_kmeans(list(range(400)), np.floor(256 * x.astype(np.float64)).astype(np.int64), 12, 4)
    assert (centers == want).all()
    got = sorted(centroids.cluster_report(found, centers).collect())
    assert [(r.cluster, r.distance) for r in got] == list(zip(cluster, distance, strict=True))
    assert all(r.inertia == distance.sum() and r.cluster_inertia == distance[cluster == r.cluster].sum() for r in got)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(str(v) for v in want[r.cluster]).encode()).hexdigest() for r in got)


def test_the_bound_rules_centroids_out():
    rng = np.random.default_rng(1)
    centers = rng.integers(-400, 400, (40, 64))
    q = centers[rng.integers(0, 40, 500)] + rng.integers(-20, 20, (500, 64))
    cov = np.cov(q.T)
    rotation = centroids.Rotation(q.mean(0), np.linalg.eigh(cov)[1][:, ::-1][:, :16])
    lead, rest = rotation(q.astype(float))
    cluster, distance, seen = centroids.nearest(q, lead, rest, centers, rotation)
    d = ((q[:, None] - centers[None]) ** 2).sum(2)
    assert (cluster == d.argmin(1)).all() and (distance == d.min(1)).all() and seen < 3 * len(q)


def test_centroids_of_awkward_vectors(spark):
    ok = [0.25] * 64
    rows = [(1, ok, 0), (1, ok, 0), (None, ok, None), (2, None, 0), (3, [], 0), (4, ok[:-1], 0), (5, [None, *ok[1:]], 0), (6, [float("nan"), *ok[1:]], 0), (7, [float("inf"), *ok[1:]], 0), (8, [1e30, *ok[1:]], 0), (9, [-0.1] * 64, 1)]
    df = spark.createDataFrame(rows, VEC).withColumn("q", F.lit(1)).withColumn("ID", F.lit("x")).withColumn("cluster", F.lit(7))
    found, centers = centroids.kmeans(df)
    got = centroids.cluster_report(found, centers).collect()
    assert sorted((r.vec_id is not None, r.vec_id or 0) for r in got) == [(False, 0), (True, 1), (True, 1), (True, 9)]
    assert len(centers) == 3 and {r.distance for r in got} == {0}
    found, centers = centroids.kmeans(spark.createDataFrame([], VEC))
    assert centroids.cluster_report(found, centers).count() == 0


def brute_links(rows, least=0.93):
    n, reach = len(rows), list(range(len(rows)))
    x = [None if v is None or not len(v) or any(c is None or not np.isfinite(c) for c in v) or not any(v) else np.float64(np.array(v, np.float32)) for _, v, _ in rows]
    links = [[] for _ in rows]
    for i, j in itertools.combinations(range(n), 2):
        if rows[i][2] is not None and rows[i][2] == rows[j][2] and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]):
            a, b = x[i] / np.abs(x[i]).max(), x[j] / np.abs(x[j]).max()
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                links[i].append(j)
                links[j].append(i)
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([reach[i], *(reach[j] for j in links[i])])
            changed |= low != reach[i]
            reach[i] = low
    ids = {}
    for i, r in enumerate(reach):
        if rows[i][0] is not None:
            ids[r] = min(ids.get(r, rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], len(links[i]), ids.get(reach[i]), rows[i][0] == ids.get(reach[i])) for i in range(n)), key=str)


def linked(spark, rows, **more):
    got = forest.link_vectors(spark.createDataFrame(rows, VEC).repartition(3), **more).collect()
    return sorted((tuple(r) for r in got), key=str)


def groups(rng, sizes, dim=24, noise=0.05):
    """Groups of vectors around random directions, and as many lone ones; ids shuffled."""
    x = []
    for n in sizes:
        centre = rng.standard_normal(dim)
        x += list(centre / np.linalg.norm(centre) + noise * rng.standard_normal((n, dim)))
    x += list(rng.standard_normal((sum(sizes), dim)))
    ids = rng.permutation(len(x))
    return [(int(i), v.tolist(), int(rng.integers(0, 2))) for i, v in zip(ids, x, strict=True)]


def test_links_through_many_leaves(spark, monkeypatch):
    """Small leaves, blocks and balls, so that every road is taken: spills, overfull leaves, pure blocks and groups wider than a ball."""
    monkeypatch.setattr(forest, "LEAF", 40)
    monkeypatch.setattr(forest, "BLOCK", 32)
    rng = np.random.default_rng(2)
    rows = groups(rng, [150, 60, 9, 3, 2, 2]) + [(1000 + i, (np.eye(24)[0] + 0.32 * rng.standard_normal(24) / 5).tolist(), 1) for i in range(80)]
    rows += [(2000 + i, rows[i][1], rows[i][2]) for i in range(30)]
    assert linked(spark, rows) == brute_links(rows)


def test_recall_of_a_deep_forest():
    """Of pairs barely above the threshold, how many share a leaf of some tree, at a depth that the tests' tables don't reach."""
    rng, angle = np.random.default_rng(8), float(np.arccos(0.93))
    x = rng.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    other = rng.standard_normal((300, 64))
    other -= (other * x[:300]).sum(1)[:, None] * x[:300]
    x[300:600] = np.cos(angle) * x[:300] + np.sin(angle) * other / np.linalg.norm(other, axis=1)[:, None]
    depth, together, copies = 7, np.zeros(300, bool), 0
    for seed in range(forest.TREES + depth):
        row, node = forest.grow(x, depth, angle, seed).leaves(x, np.full(len(x), depth))
        copies += len(row)
        held = [set() for _ in x]
        for r, n in zip(row, node, strict=True):
            held[r].add(n)
        together |= np.array([bool(held[i] & held[i + 300]) for i in range(300)])
    assert together.mean() >= 0.99 and copies / len(x) / (forest.TREES + depth) < 2.2


def test_links_of_awkward_rows(spark):
    a, b = [1.0, 0.0, 0.5], [1.0, 0.01, 0.5]
    nan, inf = float("nan"), float("inf")
    rows = [(1, a, 0), (2, b, 0), (2, b, 0), (None, a, 0), (3, a, None), (4, None, 0), (5, [0.0, 0.0, 0.0], 0), (6, [1.0, None, 0.5], 0), (7, [1.0, nan, 0.5], 0), (8, [inf, 0.0, 0.0], 0), (9, [], 0), (10, a, 1), (11, [1.0, 0.0], 0), (12, [2.0, 0.0, 1.0], 0), (13, [-0.0, 1.0, 0.0], 3), (14, [0.0, 1.0, 0.0], 3), (15, [1e-30, 0.0, 5e-31], 0), (None, [0.0, 7.0], 5)]
    assert linked(spark, rows) == brute_links(rows)
    assert linked(spark, [(1, a, 0)]) == [(1, 0, 1, True)]
    df = spark.createDataFrame(rows, VEC)
    clash = df.select("*", F.lit(1).alias("KEY"), F.lit(2).alias("v"), F.lit(3).alias("code"))
    assert sorted(map(str, forest.link_vectors(clash).collect())) == sorted(map(str, forest.link_vectors(df).collect()))
    assert forest.link_vectors(spark.createDataFrame([], VEC)).count() == 0


def test_balls_link_for_certain():
    rng, half = np.random.default_rng(6), float(np.cos(np.arccos(0.93) / 2)) + 1e-9
    centre = np.eye(32)[0]
    x = centre + 0.02 * rng.standard_normal((300, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    balls = forest.find_balls(x, half)
    assert len(balls) == 1
    own = x[x @ balls[0] >= half]
    assert len(own) > 250 and (own @ own.T).min() >= 0.93
    batch = pa.RecordBatch.from_arrays([pa.array(x.tolist())], names=["v"])
    assert np.allclose(forest.unit(batch), x)

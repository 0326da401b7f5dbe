import numpy as np

from stratiform.llm.components import components
from stratiform.llm.nearjoin import Shingler, near_classes, one_of_each, runs_for


def brute(rows, threshold=0.8):
    sets = Shingler().sets([t for _, t in rows])
    n = len(rows)
    links, up = [0] * n, list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i + 1, n):
            both = len(np.intersect1d(sets[i], sets[j]))
            union = len(sets[i]) + len(sets[j]) - both
            if not union or both >= threshold * union - 1e-9:
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    ids = [d for d, _ in rows]
    least = {}
    for i in range(n):
        if ids[i] is not None:
            r = root(i)
            least[r] = min(least.get(r, ids[i]), ids[i])
    return sorted(((ids[i], least.get(root(i)), links[i]) for i in range(n)), key=str)


def cases(prose):
    rows = []
    for k in range(12):
        base = prose(k, 80).split(" ")
        for c in range(k % 4 + 1):
            w = list(base)
            for j in range(c):
                w[7 + 13 * j] = f"edit{c}x{j}"
            rows.append((100 * k + c, " ".join(w)))
    rows += [(900, None), (901, ""), (902, " ?! "), (903, "one two"), (904, "One two."), (905, "one three"), (906, prose(99, 9000)), (907, prose(99, 9000) + " more"), (908, prose(5, 80)), (None, "lonely words of a row without id here")]
    return rows


def test_matches_brute_force(docs_of, prose):
    rows = cases(prose)
    got = near_classes(docs_of(rows)).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(rows)


def test_large_bucket_of_near_copies(docs_of, prose, monkeypatch):
    from stratiform.llm import nearjoin

    monkeypatch.setattr(nearjoin, "SMALL", 8)
    monkeypatch.setattr(nearjoin, "CHUNK", 16)
    monkeypatch.setattr(nearjoin, "PIVOTS", 4)
    monkeypatch.setattr(nearjoin, "BLOCK", 1500)
    base = prose(1, 120).split(" ")
    rows = [(i, " ".join(base[:3] + [f"v{i}"] + base[4:])) for i in range(60)] + [(1000 + i, prose(1000 + i, 60)) for i in range(20)]
    got = near_classes(docs_of(rows)).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(rows)


def test_near_pairs_among_strangers_of_one_bucket(spark, monkeypatch):
    from stratiform.llm import nearjoin

    monkeypatch.setattr(nearjoin, "SMALL", 4)
    monkeypatch.setattr(nearjoin, "CHUNK", 16)
    monkeypatch.setattr(nearjoin, "PIVOTS", 2)
    rng, rows = np.random.default_rng(3), []
    for i in range(60):
        set_ = np.unique(rng.integers(0, 1 << 64, 400, dtype=np.uint64))
        for k, s in enumerate((set_, set_[np.arange(len(set_)) % 10 > 0])):
            rows.append((2 * i + k, 0, f"{2 * i + k:03d}".encode(), len(s), nearjoin.sketch(s), [11], [11, 12], [12, 13]))
    sig = spark.createDataFrame(rows, nearjoin.SIGNATURES)
    edges = nearjoin.candidate_edges(nearjoin.leaf_buckets(sig), sig.select("sid", "n", "sketch"), 0.8).collect()
    assert {(int(bytes(r.a)), int(bytes(r.b))) for r in edges} == {(2 * i, 2 * i + 1) for i in range(60)}


def test_empty_and_one_of_each(docs_of, spark):
    none = docs_of([(1, "x")]).limit(0)
    assert near_classes(none).count() == 0
    df = docs_of([(2, "a b c d e f"), (1, "a b c d e f"), (3, "other words stand here now")])
    kept = one_of_each(df, near_classes(df))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns == df.columns
    same = "a b c d e f"
    df = docs_of([(5, same), (5, same), (5, "A b c d e f"), (5, "quite other words are in here"), (2, "quite other words are in here"), (None, same), (None, "on my own without any id"), (7, None), (8, "")])
    got = one_of_each(df, near_classes(df)).collect()
    assert sorted(((r.doc_id, r.text.lower() if r.text else r.text) for r in got), key=str) == sorted([(2, "quite other words are in here"), (5, same), (None, "on my own without any id"), (7, None)], key=str)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (3, 1), (5, 5)] + [(i, i + 1) for i in range(20, 60)], "u long, v long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {i: 20 for i in range(20, 61)}
    assert components(e.limit(0)).count() == 0


def test_runs():
    assert runs_for(0.99, 0.8) < runs_for(0.9999, 0.8)


def test_runs_hold_for_sets_of_unequal_size():
    # One set holds the other: 1.6 common picks at 0.8, of which a path to depth 3 is missed with 0.316 a run.
    p = 1.0
    for _ in range(3):
        p = 1 - np.exp(-1.6 * p)
    assert (1 - p) ** runs_for(0.998, 0.8) < 0.002


def test_recall_at_the_threshold(docs_of, prose):
    """Of pairs with a similarity of 0.80 to 0.85, at least 98 in 100 are linked."""
    def runs(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    rows, pairs = [], 0
    for k in range(1200):
        words = prose(k, 60 + k % 140).split()
        other = words[: max(5, round(len(words) * (0.8 + 0.001 * (k % 50))) )] if k % 2 else [*words[:-9], *prose(k + 5000, 9).split()]
        a, b = " ".join(words), " ".join(other)
        x, y = runs(a.lower()), runs(b.lower())
        if 0.8 <= len(x & y) / len(x | y) < 0.85:
            rows += [(2 * k, a), (2 * k + 1, b)]
            pairs += 1
    got = near_classes(docs_of(rows)).where("n_links > 0").count()
    assert pairs > 300 and got >= 2 * 0.98 * pairs


def test_documents_without_ids(docs_of, prose):
    rows = [(None, prose(k % 40, 60)) for k in range(120)] + [(None, prose(k, 60) + " x") for k in range(40)] + [(1, prose(3, 60))]
    got = near_classes(docs_of(rows)).collect()
    assert len(got) == len(rows) and sum(r.class_id == 1 for r in got) == 5
    assert all(r.n_near == 1 and r.n_links in (3, 4) for r in got)

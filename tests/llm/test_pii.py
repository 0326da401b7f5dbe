import random
import re

import pytest

from stratiform.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k in PLAIN for m in re.finditer(PLAIN[k], text or "") if valid(k, m[0]))


TEXTS = [
    None, "", "no data", "mail a.b@c-d.ex.org, x@y, @z.w a@b.c_d@e.f.g", "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.255 9999999999999.1.1.1",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 12 34", "+1 (414) 555-7134 +12 +44.20.7946.0958- é😀 +49 170 1234567 x@ü.de",
    "é" * 50 + " mix 4111111111111111 +1 (414) 555-7134 4111111111111111 a@b.co 10.0.0.1", "1" * 30_000, "a" * 30_000 + "@" + ".b" * 20_000, "a.b@" * 5000, "1-2 " * 20_000, "+1" * 5000,
]


def test_base_spans(docs_of):
    got = pii.private_spans(docs_of(list(enumerate(TEXTS)))).select("doc_id", pii.span_text(pii.F.col("base")).alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_bootstrap_finds_unseen(docs_of, prose):
    rows = [(i, f"{prose(i, 5)} reach me at user{i}@mail.example.org now {prose(i + 1, 5)}") for i in range(30)]
    rows += [(100, f"{prose(7, 4)} reach me at bob77-at-mail now"), (101, f"{prose(8, 4)} build number r2d2x33 of it")]
    out = {r.doc_id: r for r in pii.private_spans(docs_of(rows)).collect()}
    text = rows[30][1]
    assert [text[x.s : x.e] for x in out[100].added] == ["bob77-at-mail"]
    assert out[101].added == [] and len(out[5].base) == 1
    assert pii.private_spans(docs_of(rows), support=1000).where("size(added) > 0").count() == 0


def slow_patterns(edges, rounds, support, confidence, doubt):
    """The scores of the graph, one edge after another."""
    seeds = {v for _, v, known in edges if known}
    score, high = dict.fromkeys(seeds, 1.0), {}
    for _ in range(rounds):
        high = {}
        for p in {p for p, _, _ in edges}:
            of = [score.get(v, 0.0) for q, v, _ in edges if q == p]
            rate = sum(of) / (len(of) + doubt)
            if sum(x >= 0.9 for x in of) >= support and rate >= confidence:
                high[p] = rate
        score = dict.fromkeys(seeds, 1.0)
        for v in {v for _, v, _ in edges} - seeds:
            miss = 1.0
            for p, w, _ in edges:
                if w == v and p in high:
                    miss *= 1 - high[p]
            if miss < 1:
                score[v] = 1 - miss
    return high


@pytest.mark.parametrize("seed", range(3))
def test_scores_of_the_graph(spark, seed):
    rng = random.Random(seed)
    edges = {(f"p{p}", f"v{v}"): int(v % 3 < 2) for p in range(12) for v in rng.sample(range(60), rng.randint(4, 40)) if v % 3 < 2 or rng.random() < p / 11}
    edges = [(p, v, known) for (p, v), known in edges.items()]
    got = {r.p: r.confidence for r in pii.learn_patterns(spark.createDataFrame(edges, "p string, v string, known int"), 3, 5, 0.75, 2.0).collect()}
    want = slow_patterns(edges, 3, 5, 0.75, 2.0)
    assert set(got) == set(want) and want and all(got[p] == pytest.approx(want[p]) for p in got)


def test_secrets_by_their_context(docs_of, prose):
    """Digests seed the pattern ``api_key: '``; what stands there is found, the like elsewhere isn't."""
    rng = random.Random(4)
    digest = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(38)) + "a1"
    rows = [(i, f"{prose(i, 30)} API_KEY: '{digest()}' {prose(i + 50, 30)}") for i in range(12)]
    long = "k9" * 60
    rows += [(50, f"x api_key:   'Zx81-qq_{1}7' y"), (51, f"api_key: '{long}'"), (52, f"commit {digest()} of it"), (53, prose(9, 50) + " 1234567"), (54, f"api_key: '{'a' * 9}'")]
    text = dict(rows)
    found = {r.doc_id: [text[r.doc_id][x.s : x.e] for x in r.added] for r in pii.private_spans(docs_of(rows)).collect()}
    assert all(found[i] == [re.search("'(.*)'", text[i])[1]] for i in range(12))
    assert (found[50], found[51], found[52], found[53], found[54]) == (["Zx81-qq_17"], [long], [], [], [])


def test_redact(docs_of):
    df = docs_of([(1, "é to a@b.co and 10.0.0.1."), (2, None), (3, "plain"), (3, "plain"), (None, "x 4111111111111111 y")])
    got = pii.redact(df)
    assert got.columns == df.columns
    assert sorted((str(r.text) for r in got.collect())) == sorted(["é to <email> and <ip>.", "None", "plain", "plain", "x <card> y"])
    assert pii.redact(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", pii.KINDS)
def test_no_python_on_the_path(docs_of, kind):
    plan = pii.extract(docs_of([(1, "a@b.co")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

import re

from stratiform.llm.decontam import contamination, without_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        if w and i is not None:
            n = min(13, len(w))
            for s in range(len(w) - n + 1):
                wins.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit.update(range(s, s + n))
                    found |= wins[tuple(w[s : s + n])]
        out.append((d, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_matches_brute_force(spark, docs_of, prose):
    items = [(i, prose(i, 20)) for i in range(8)] + [(20, prose(20, 13)), (21, "Short one, É"), (22, "word"), (23, ""), (24, None), (None, prose(3, 20)), (1, prose(77, 15)), (30, prose(2, 20))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i, prose(100 + i, 60)) for i in range(6)]
    docs += [(10, prose(50, 30) + " " + prose(3, 20).upper() + ", " + prose(51, 400)), (11, prose(4, 20)), (12, prose(5, 20)[5:] + " x " + prose(5, 20)), (13, "a SHORT one é word É"), (14, "Short-one; É!"), (15, None), (16, ""), (17, prose(20, 13)), (17, prose(20, 13)), (18, prose(52, 3000) + " " + prose(2, 20)), (None, prose(77, 15))]
    got = contamination(docs_of(docs), bench).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.items, r.contaminated) for r in got), key=str) == brute(docs, items)
    left = without_contaminated(docs_of(docs), bench)
    assert sorted(str((r.doc_id, r.text)) for r in left.collect()) == sorted(str(d) for d in docs if not next(x for x in brute([d], items))[4])
    for df, b in ((docs_of(docs).limit(0), bench), (docs_of(docs), bench.limit(0))):
        assert contamination(df, b).where("n_hit > 0").count() == 0


def test_without_broadcast(spark, docs_of, prose):
    bench = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    docs = docs_of([(1, prose(1, 30)), (2, prose(2, 30))])
    got = {r.doc_id: r.contaminated for r in contamination(docs, bench, broadcast_rows=0).collect()}
    assert got == {1: True, 2: False}

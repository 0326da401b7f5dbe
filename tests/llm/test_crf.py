import zlib

import numpy as np

from stratiform.llm.crf import Model, held_out, score_documents, spans_of, train


def test_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    m = Model(steps=rng.normal(size=(2, 2)))
    docs = [rng.normal(size=n) for n in (5, 0, 1, 3, 5)]
    for e, p in zip(docs, m.marginals(docs), strict=True):
        n = len(e)
        want, total = np.zeros(n), 0.0
        for code in range(1 << n if n else 0):
            y = [(code >> t) & 1 for t in range(n)]
            w = np.exp(sum(e[t] * y[t] for t in range(n)) + sum(m.steps[y[t], y[t + 1]] for t in range(n - 1)))
            total += w
            want += w * np.array(y)
        assert np.allclose(p, want / total if n else want)


def test_learns_and_holds_out(spark, docs_of, prose):
    rows, labels = [], []
    for i in range(500):
        w = prose(i, 60).split(" ")
        bad = i % 3 == 0
        if bad:
            for k in range(3):
                w[10 * k + 5] = f"vilex{'abcdefgh'[(i + k) % 8]}"
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (902, "vilexa"), (903, prose(1, 20_000))]
    lab = spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, toxic int")
    docs = docs_of(rows)
    model = train(docs, lab)
    got = {r.doc_id: r for r in score_documents(docs, model).collect()}
    truth = dict(labels)
    kept = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {r.doc_id for r in docs.where(held_out()).collect()} >= set(kept)
    right = sum((got[i].score >= 0.3) == bool(truth[i]) for i in kept) / len(kept)
    assert right > 0.97
    text = rows[0][1]
    assert {text[s.start : s.end][:5] for s in got[0].spans} == {"vilex"}
    assert got[900].score == got[901].score < 0.3 and 0 <= got[903].score < 0.3
    assert score_documents(docs.limit(0), model).count() == 0
    one = train(docs, lab.where("toxic = 0"))
    assert {r.score for r in score_documents(docs, one).collect()} == {0.0}
    carried = score_documents(docs, model, extra=docs.columns)
    assert carried.columns == ["_result", *docs.columns]


def test_spans():
    assert spans_of("É Bad,bad x bad", np.array([0.1, 0.9, 0.8, 0.1, 0.7])) == [(2, 9), (12, 15)]

import numpy as np
import pytest

from stratiform.llm.sharding import FeistelPermutation, crc32_of, shard_documents


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    p = FeistelPermutation(n)
    ranks = p.forward(np.arange(n))
    assert sorted(ranks.tolist()) == list(range(n)) and (p.inverse(ranks) == np.arange(n)).all()
    shard, slot = p.place(np.arange(n), 16)
    assert (p.row_at(shard, slot, 16) == np.arange(n)).all()


def test_documents(docs_of):
    rows = [(i * 7 % 101, f"text {i}" if i % 5 else None) for i in range(101)] + [(None, "é"), (3, "again"), (3, "again")]
    got = shard_documents(docs_of(rows)).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"rows"}
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    p = FeistelPermutation(len(rows))
    for r in got:
        assert (r.shard, r.slot) == tuple(int(x[0]) for x in p.place([r.row_no], 16))
    by = {r.doc_id: r for r in got}
    assert by[None].row_no == 0 and by[None].size == 3 and by[None].text_crc32 == crc32_of("é")
    assert by[0].size == 1 and by[0].text_crc32 == 0
    again = shard_documents(docs_of(rows)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert shard_documents(docs_of(rows).limit(0)).count() == 0

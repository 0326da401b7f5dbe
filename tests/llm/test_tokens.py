import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratiform.llm.eliasfano import EliasFano, Rising, TokenFile, TokenFileWriter

P = pytest.importorskip("public_tokenizers")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62), max_size=60), st.integers(0, 5))
def test_elias_fano(values, repeat):
    v = sorted(values * (repeat + 1))
    ef = EliasFano.build(v)
    head, blob = ef.parts()
    back = EliasFano.load(head, blob)
    assert [back[i] for i in range(len(v))] == v


def test_near_minimal_space():
    v = np.cumsum(np.random.default_rng(1).integers(1, 1000, 100_000)).tolist()
    ef, rising = EliasFano.build(v), Rising()
    assert len(ef.parts()[1]) < len(v) * 1.7
    for x in v:
        rising.add(x)
    assert rising.packed().parts() == ef.parts() and len(rising.raw) < len(v) * 2
    assert [ef[i] for i in range(0, len(v), 997)] == v[::997]


def test_values_must_not_decrease():
    with pytest.raises(ValueError):
        EliasFano.build([1, 5, 4])


def test_token_file():
    f = io.BytesIO()
    f.close = lambda: None
    w = TokenFileWriter(f)
    docs = [(None, [1, 2]), (-5, []), (7, [65535] * 300), (7, [3])]
    for d, ids in docs:
        w.add(d, np.array(ids, "<u2").tobytes())
    w.close()
    t = TokenFile(f)
    assert [(t.doc_id(i), t.read(i).tolist()) for i in range(len(t))] == docs
    assert [(d, a, x.tolist()) for d, a, x in t.scan()] == [(None, 0, [1, 2]), (-5, 2, []), (7, 2, [65535] * 300), (7, 302, [3])]


TEXTS = [None, "", " ", "Hello, world's  end.\n\n New", "İstanbul É é á 10,000 don't", "<|endoftext|> and <|startoftext|>x", "日本語 テスト 😀", "x" * 5000, "\x1c odd\x85space end", "..., ,.", "a,b. c,. d.\n"]


def test_word_files_equal_the_library(docs_of, prose):
    from tokenizers import Tokenizer

    from stratiform.llm.tokenfiles import read_token_files, write_token_files

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = list(enumerate(TEXTS)) + [(50 + i, prose(i, 200)) for i in range(10)] + [(None, "no id")]
    got = sorted(read_token_files(write_token_files(docs_of(rows), P.path("word_bpe_49k.json"))).collect(), key=lambda r: r.start)
    start = 0
    for (doc, text), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0])), got, strict=True):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert read_token_files(write_token_files(docs_of(rows).limit(0), P.path("word_bpe_49k.json"))).count() == 0


def test_repeated_doc_ids_have_one_order(docs_of, prose):
    from stratiform.llm.tokenfiles import read_token_files, write_token_files

    rows = [(3, prose(i % 4, 30)) for i in range(40)] + [(None, prose(i, 5)) for i in range(9)]
    read = lambda n, back: sorted((tuple(r[:4]) for r in read_token_files(write_token_files(docs_of(rows[::back]).repartition(n), P.path("word_bpe_49k.json"))).collect()), key=lambda r: r[1])
    one = read(1, 1)
    assert len(one) == 49 and one == read(7, -1)


def test_byte_bpe_equals_the_library(docs_of, prose):
    import tiktoken

    from stratiform.llm.bpe import encode_decode, read_ranks

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    texts = TEXTS + ["a  b", "a   b \n c", "a \n \n b", " lead", "trail ", "trail  ", "\n\n x", "x\t y", "x \n ", prose(1, 500), prose(3, 4000).replace(" ", ""), "é" * 9000, " " * 5000 + "x", "1234567890" * 700]
    got = encode_decode(docs_of(list(enumerate(texts))), path, P.PATTERN, extra=["doc_id", "result"]).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id] or ""
        assert r[0].ids == np.array(enc.encode_ordinary(t), "<u4").tobytes() and bytes(r[0].decoded).decode() == t and r.result == "x"

from __future__ import annotations

import zlib

import numpy as np
from tokenizers import Tokenizer

from patchwell.llm import packing as p
from patchwell.llm.common import table
from tests.llm.conftest import SF

ODD = [
    "Don't I'll x́é É<|endoftext|> a\x0bb\x0cc\x85d e 12 3.5%%% İSTANBUL ΣΑΣ ŸÿÑ ñ²½ ª", "", "   ", "école É́ naïve's",
    "日本語 テスト 𝒳", "''s 's't", "a'b'c-d_e", "ﬁx   ẞ", "×÷ á", "<|startoftext|>x",
]


def test_words_through_the_cache_equal_the_tokenizer(spark):
    texts = [r.text for r in table(spark, SF, "documents").collect()] + ODD
    full = Tokenizer.from_file(p.tokenizer_path())
    want = [x.ids for x in full.encode_batch(texts, add_special_tokens=False)]
    own = p.WordTokenizer(p.tokenizer_path(), cache_words=500)
    got = [x for k in range(0, len(texts), 7) for x in own.encode(texts[k : k + 7])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def test_no_limit_is_passed_and_room_is_used():
    rng = np.random.default_rng(0)
    needs = np.stack([rng.integers(1, 900, 3000), np.ones(3000, int), rng.integers(0, 400, 3000)], axis=1)
    room = np.array([1000, 4, 700])
    bins = p.pack_group(needs, room)
    for k in range(3):
        assert (np.bincount(bins, needs[:, k]) <= room[k]).all()
    least = max(-(-needs[:, k].sum() // room[k]) for k in range(3))
    assert least <= bins.max() + 1 <= 1.15 * least
    assert set(bins.tolist()) == set(range(bins.max() + 1))


def _whole(rows: list, docs: dict) -> float:
    """Checks what must hold; share of padding."""
    full = Tokenizer.from_file(p.tokenizer_path())
    by_doc: dict = {}
    by_sequence: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for key, own in by_doc.items():
        ids = [*full.encode(docs[key] or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : at], "<u4").tobytes())
        assert at == len(ids)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert set(by_sequence) == set(range(len(by_sequence)))
    return padding / (2048 * len(by_sequence))


def test_given_documents(spark):
    docs = table(spark, SF, "documents")
    padding = _whole(p.pack_documents(docs).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert padding < 0.02


def test_odd_rows_and_groups(docs, odd_rows):
    rows = p.pack_documents(docs(odd_rows)).collect()
    once = {k: t for k, t in odd_rows if k not in (None, 6)}
    _whole_ids = [r for r in rows if r.doc_id in once]
    assert {r.doc_id for r in rows} == {k for k, _ in odd_rows}
    assert sum(r.start == 0 for r in rows) == len(odd_rows)
    assert all(r.offset + r.length <= 2048 for r in _whole_ids)
    assert p.pack_documents(docs([])).count() == 0
    made = p.pieces(docs(odd_rows)).selectExpr("*", "length as loss_tokens")
    many = p.pack(made, p.Limits(2048, 2, 2048), group_pieces=3).collect()
    assert {r.sequence_id for r in many} == set(range(1 + max(r.sequence_id for r in many)))
    assert max(sum(x.sequence_id == r.sequence_id for x in many) for r in many) <= 2


def test_ids_are_the_same_whatever_the_cache_has_forgotten():
    path = p.tokenizer_path()
    small, large = p.WordTokenizer(path, cache_words=40), p.WordTokenizer(path)
    texts = [" ".join(f"word{i * j % 97} Mixed{j} éa{i}-b" for j in range(30)) for i in range(40)]
    for text in texts + texts[:5]:
        assert small.encode([text]) == large.encode([text])
    want = [large.full.encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(memoryview(x).cast("I")) for x in large.encode(texts)] == want
    assert len(small.words) + len(small.older) < 500

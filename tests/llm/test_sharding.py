from __future__ import annotations

import zlib

import numpy as np
import pytest

from patchwell.llm import sharding as s


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 65_537])
def test_permutation_and_its_inverse(n):
    rows = np.arange(n)
    for seed in (0, 9):
        at = s.permute(rows, n, seed)
        assert sorted(at.tolist()) == rows.tolist()
        assert (s.unpermute(at, n, seed) == rows).all()
    assert n < 1000 or (s.permute(rows, n, 0) != s.permute(rows, n, 1)).any()


def test_shards_and_slots(docs, odd_rows):
    rows = [*odd_rows, *((100 + k, f"text {k}") for k in range(200))]
    for bucket_rows in (50_000, 7):
        out = s.shard(docs(rows), 24, bucket_rows=bucket_rows).collect()
        again = s.shard(docs(rows).repartition(5), 24, bucket_rows=bucket_rows).collect()
        key = lambda r: (str(r.doc_id), r.size, r.row_number)
        assert sorted(out, key=key) == sorted(again, key=key)
        by_shard: dict = {}
        for r in out:
            by_shard.setdefault(r.shard, []).append(r.slot)
        sizes = [len(v) for v in by_shard.values()]
        assert len(out) == len(rows) and max(sizes) - min(sizes) <= 1 and set(by_shard) <= set(range(24))
        assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
        assert {r.row_number for r in out} == set(range(len(rows)))
    found = {(r.doc_id, r.size, r.text_crc32) for r in out}
    assert found == {(k, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for k, t in rows}
    assert s.shard(docs([]), 24).count() == 0

import hashlib

import pytest

from pixelloom.llm import block_names

from .conftest import TEXTS


@pytest.mark.parametrize("block_bytes, local_bytes", [(8192, 48 << 20), (64, 1000), (3, 100)])
def test_groups_equal_brute_force(docs, block_bytes, local_bytes):
    if block_bytes == 3:
        docs = docs.where("n_chars < 10000 or doc_id is null")
    out = block_names.dedup(docs, block_bytes=block_bytes, local_bytes=local_bytes).collect()
    texts = [(i, t or "") for i, t in TEXTS if block_bytes != 3 or len(t or "") < 10000]
    norm = [(i, t, t.translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r")))) for i, t in texts]
    want = []
    for i, t, n in norm:
        same = [(-len(u), j is None, j) for j, u, m in norm if m == n]
        want.append((i, min(same)[2], len(same), hashlib.sha256(n.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted(((r.id, r.keep_id, r.group_size, r.sha) for r in out), key=key) == sorted(want, key=key)
    assert sum(r.kept for r in out) == len({n for _, _, n in norm})
    assert all(r.kept == (r.row == r.keep_row) for r in out)


def test_empty_table(no_docs):
    assert block_names.dedup(no_docs).count() == 0

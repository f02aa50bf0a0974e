import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from . import cases


@pytest.mark.parametrize(("d", "level"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_keys_step_between_neighbours(d, level):
    from verdigris.llm.packing import hilbert_key

    grid = np.stack(np.meshgrid(*[np.arange(1 << level)] * d), axis=-1).reshape(-1, d)
    keys = hilbert_key(grid, level)
    assert sorted(keys.tolist()) == list(range(len(grid)))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("length", [2048, 64])
def test_pieces_hold_every_id_once(spark, length):
    from verdigris.llm.packing import pack

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = Counter((r[0], tuple(t.encode(r[1] or "", add_special_tokens=False).ids) + (1,)) for r in cases.rows())
    got = pack(cases.clashing(cases.table(spark)), length=length).collect()
    total = sum(len(ids) * n for (_, ids), n in want.items())
    sequences = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        sequences[r.sequence_id].append((r.offset, r, ids))
    assert sorted(sequences) == list(range(-(-total // length)))
    stream = []
    for k in sorted(sequences):
        at = 0
        for offset, r, ids in sorted(sequences[k], key=lambda x: x[0]):
            assert offset == at
            at += len(ids)
            stream.append((r, ids))
        assert at == (length if k + 1 < len(sequences) else total - length * k)
    whole, part = Counter(), []
    for r, ids in stream:
        assert r.start == len(part)
        part += ids
        if len(part) == r.doc_tokens:
            whole[r.doc_id, tuple(part)] += 1
            part = []
    assert whole == want
    assert pack(cases.table(spark, [])).collect() == []
    assert zlib.crc32(b"") == 0


def test_neighbours_share_words(spark):
    from verdigris.llm.packing import pack

    data = [(i, (("alpha beta gamma " if i % 2 else "omega sigma kappa ") * 30).strip(), "en", "s", 1) for i in range(80)]
    order = [r.doc_id % 2 for r in sorted(pack(cases.table(spark, data)).collect(), key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    assert sum(a != b for a, b in zip(order, order[1:])) == 1

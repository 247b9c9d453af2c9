"""What the near-dedup and the decontamination need in a Python worker doesn't follow the size of a batch or a block."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from polescale.llm import decontam, minhash
from polescale.llm.textnp import U


def peak(run) -> float:
    """MB that ``run`` allocates at most."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


class Mask:
    class value:
        @staticmethod
        def hit(keys):
            return (keys & 1023) == 7


@pytest.mark.parametrize("name", ["signatures", "sets", "seeds", "windows"])
def test_batch_of_texts(name):
    rng = np.random.default_rng(1)
    texts = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 5000, 400).tolist()) for _ in range(1800)])
    ids = pa.array(np.arange(len(texts)))
    run, columns = {
        "signatures": (minhash._signatures, [ids, ids, texts]),
        "sets": (minhash._sets, [ids, texts, pa.array([False] * len(texts))]),
        "seeds": (decontam._seeds, [ids, texts]),
        "windows": (decontam._windows([5], Mask), [ids, texts]),
    }[name]
    batch = pa.RecordBatch.from_arrays(columns, names=list("abc")[: len(columns)])
    assert peak(lambda: [None for _ in run(iter([batch]))]) < 30


def block(n, size, apart):
    """Sorted sets of ``size`` words, of which each has ``apart`` of its own."""
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 64, size, dtype=U))
    sets = [np.unique(np.concatenate([base[apart:], rng.integers(0, 1 << 64, apart, dtype=U)])) for _ in range(n)]
    return pd.DataFrame({"cid": np.arange(n), "comp": np.arange(n), "words": [x.view(np.int64) for x in sets]})


def test_block_of_long_texts():
    pdf = block(500, 4000, 1000)
    out = []
    assert peak(lambda: out.append(minhash._links(55)(pdf))) < 50
    assert len(out[0]) == 499  # 3000 of 5000 words: all alike


def test_parts_leave_links_as_they_are(monkeypatch):
    """Similarities on both sides of the limit, in one part and in many."""
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 64, 90, dtype=U))
    sets = [np.unique(np.concatenate([base[rng.random(90) < 0.95], rng.integers(0, 1 << 64, rng.integers(0, 4), dtype=U)])) for _ in range(60)]
    pdf = pd.DataFrame({"cid": np.arange(60), "comp": np.arange(60), "words": [x.view(np.int64) for x in sets]})
    linked = {frozenset((a, b)) for a in range(60) for b in range(a) if 100 * (k := len(np.intersect1d(sets[a], sets[b]))) >= 92 * (len(sets[a]) + len(sets[b]) - k)}

    def groups(pairs):
        comp = list(range(60))
        for a, b in pairs:
            comp = [comp[a] if c == comp[b] else c for c in comp]
        return {frozenset(i for i in range(60) if comp[i] == c) for c in comp}

    for words in (1 << 18, 50, 1):
        monkeypatch.setattr(minhash, "PART_WORDS", words)
        got = [(int(a), int(b)) for a, b in minhash._links(92)(pdf).to_numpy()]
        assert {frozenset(x) for x in got} <= linked
        assert groups(got) == groups(linked)
    assert 1 < len(groups(linked)) < 60

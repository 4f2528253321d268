"""Memory that a task's Python worker needs beside its batch does not follow the batch."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import ngram_join as N
from quire.llm import quality as Q


def _batch(texts: int, words: int) -> pa.RecordBatch:
    rng = np.random.Generator(np.random.PCG64(5))
    values = [" ".join(f"w{x}" for x in rng.integers(0, 50_000, words)) for _ in range(texts)]
    return pa.RecordBatch.from_arrays([pa.array(range(texts), pa.int64()), pa.array(values)], ["_id", "_text"])


def _peak(rows) -> float:
    """MB of arrays held at once while ``rows`` are made."""
    tracemalloc.start()
    try:
        for _ in rows:
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("step, most", [
    (lambda b: N._describe(b, 5), 24), (lambda b: N._ship(b, 5, 6), 45), (Q._statistics, 16)])
def test_worker_arrays_are_small(step, most):
    batch = _batch(1600, 1000)
    step(iter([batch.slice(0, 10)]))
    assert _peak(step(iter([batch]))) < most


def test_probe_counts_do_not_depend_on_blocks(monkeypatch):
    batch = _batch(120, 60)
    texts = batch.column(1).to_pylist()
    texts += [texts[0], texts[1] + " tail of its own", "", None, "three words only", texts[2]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["_id", "_text"])
    sets = [set(zip(*[t.split()[i:] for i in range(5)])) or {tuple(t.split())} - {()} for t in (x or "" for x in texts)]

    def held():
        table = pa.Table.from_batches(list(N._ship(iter([batch]), 5, 6)))
        counts = {}
        for f in range(64):
            out = N._count_fragment(table.filter(pa.array(np.asarray(table["frag"]) == f)))
            for i, n in zip(out["_id"].to_pylist(), out["held"].to_pylist()):
                counts[i] = counts.get(i, 0) + n
        return counts
    described = pa.Table.from_batches(list(N._describe(iter([batch]), 5))).to_pydict()
    assert described["n"] == [len(s) for s in sets]
    best = []
    for size in (1, 4000, 8 << 20):
        monkeypatch.setattr(N, "BLOCK_BYTES", size)
        counts = held()
        of_class = {}
        for i, c in zip(described["_id"], described["cls"]):
            of_class[c] = max(of_class.get(c, 0), counts.get(i, 0))
        best.append(of_class)
    assert best[0] == best[1] == best[2]
    assert best[0][described["cls"][1]] > 0 and best[0][described["cls"][50]] == 0

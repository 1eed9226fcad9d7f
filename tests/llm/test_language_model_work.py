"""A round touches its own documents only, and what makes a step cheap doesn't change its sums."""

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("glossweave.llm.queries")

from glossweave.llm import kernels as K  # noqa: E402
from glossweave.llm import maxent_lm  # noqa: E402


def test_each_document_is_in_one_part_with_its_own_words():
    r = np.random.Generator(np.random.PCG64(7))
    sizes = r.integers(1, 30, 200)
    codes = r.integers(0, 500, sizes.sum()).astype("<i4")
    hashes = K.signed(K.mix(np.arange(500, dtype=np.uint64) + np.uint64(3)))
    known = r.permutation(500)[:400]
    held = r.random(200) < 0.1
    one = lambda x, kind: pa.array([x], pa.list_(kind))
    row = {
        "doc_ids": one(list(range(200)), pa.int64()), "held": one(held, pa.bool_()), "sizes": one(sizes, pa.int32()), "codes": pa.array([codes.tobytes()], pa.binary()), "hashes": one(hashes, pa.int64()),
        "positions": one(known, pa.int32()), "counts": one(known + 1, pa.int64()), "places": one(known * 7, pa.int64()),
    }
    batch = pa.RecordBatch.from_arrays(list(row.values()), list(row))
    first = np.cumsum(sizes) - sizes
    seen = []
    for part in maxent_lm._rows(x for x in maxent_lm._part(3)(iter([batch]))):
        own = np.frombuffer(part["codes"], "<i4")
        assert len(own) == part["sizes"].sum() and set(own.tolist()) == set(range(len(part["hashes"])))
        ends = np.cumsum(part["sizes"])
        for k, i in enumerate(part["doc_ids"]):
            assert part["part"] == (3 if held[i] else i % 3)
            code = codes[first[i] : first[i] + sizes[i]]
            mine = own[ends[k] - sizes[i] : ends[k]]
            assert (part["hashes"][mine] == hashes[code]).all()
            assert (part["counts"][mine] == np.where(np.isin(code, known), code + 1, 0)).all()
            assert (part["places"][mine] == np.where(np.isin(code, known), code * 7, 0)).all()
        seen += part["doc_ids"]
    assert sorted(seen) == list(range(200))


@pytest.mark.parametrize("values", [3, 100, 30_000])
def test_sums_of_rows(values):
    r = np.random.Generator(np.random.PCG64(values))
    f = (r.integers(0, values, 9000) * r.integers(0, 2, 9000)).astype(np.int64)
    p = r.normal(size=(9000, 5)).astype(np.float32)
    want = np.zeros((values, 5))
    np.add.at(want, f, p)
    rows, got = maxent_lm._sums(p, f)
    assert sorted(rows.tolist()) == np.unique(f).tolist()
    assert np.allclose(got, want[rows], atol=2e-3)


@pytest.mark.parametrize("far", [0.0, 500.0, -500.0])
def test_logits_far_from_zero(far):
    z = np.array([[0.0, 1.0, 2.0], [far, far + 1, -np.inf]], np.float32)
    shifted, e, total = maxent_lm._exp(z.copy())
    assert np.allclose(e / total[:, None], [[0.0900306, 0.2447285, 0.6652410], [0.2689414, 0.7310586, 0]], atol=1e-6)
    assert np.allclose(np.exp(shifted) / total[:, None], e / total[:, None])

"""Products of two blocks of features, dense and sparse, against plain arithmetic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from specmatch.operators import structure


@pytest.mark.parametrize("share", [0.03, 0.9])
@pytest.mark.parametrize("k", [None, 3])
@pytest.mark.parametrize("cells", [1, 300, 1_000_000])
def test_products_of_blocks(share, k, cells, monkeypatch):
    monkeypatch.setattr(structure, "_CELLS", cells)
    monkeypatch.setattr(structure, "_CHUNK", 7)
    rng = np.random.default_rng(1)
    z = np.where(rng.random((70, 400)) < share, rng.integers(-9, 10, (70, 400)), np.nan)

    def block(features, names):
        f, s = np.nonzero(~np.isnan(z[features]))
        order = rng.permutation(len(f))
        return pa.table(dict(zip(names, (features[f][order] * 10, s[order] * 3, z[features][f, s][order]), strict=True)))

    left, right = np.arange(0, 50), np.arange(20, 70)
    got = structure._products(block(left, ("feature_id", "sample_id", "z")), block(right, ("f2", "s2", "z2")), k)
    found = {(i // 10, j // 10): s for i, j, s in zip(*(got[c].to_pylist() for c in "ijs"), strict=True)}
    want = {}
    for i in left:
        row = {j: np.nansum(z[i] * z[j]) for j in right if i != j and (~np.isnan(z[i] * z[j])).any()}
        for j in sorted(row, key=lambda j: (-abs(row[j]), j))[:k]:
            want[i, j] = row[j]
    assert len(want) > 20 and found == want and len(got) == len(want)


def test_sparse_products_make_no_dense_slices(monkeypatch):
    """20,000 samples and few values: dense slices of all samples took 400 MB a block."""
    rng = np.random.default_rng(2)
    f, s = rng.integers(0, 2000, 20_000), rng.integers(0, 20_000, 20_000)
    f, s = np.unique(np.stack([f, s]), axis=1)
    z = rng.random(len(f))
    made = []
    zeros = np.zeros
    monkeypatch.setattr(structure.np, "zeros", lambda shape, *a: made.append(np.prod(shape)) or zeros(shape, *a))
    got = structure._products(pa.table({"feature_id": f, "sample_id": s, "z": z}), pa.table({"f2": f, "s2": s, "z2": z}), 5)
    assert got.num_rows and max(made) <= structure._CELLS and len(made) <= 4

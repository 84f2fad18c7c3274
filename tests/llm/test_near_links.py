"""Links of near pairs: every pair that meets, not a forest of them."""

from __future__ import annotations

import numpy as np

from specmatch.llm import fingerprint


def test_near_pairs_gives_every_link_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 16, fingerprint.SLOTS, np.uint8)

    def off(n):
        out = base.copy()
        out[rng.choice(len(out), n, replace=False)] ^= 5
        return out

    prints = [off(8) for _ in range(30)]  # all alike: 435 links
    rows = [(i, 9, h) for i, h in enumerate(fingerprint.to_hex(np.array(prints)))]
    monkeypatch.setattr(fingerprint, "fingerprints", lambda docs: spark.createDataFrame(rows, "doc_id long, n_chars long, fingerprint string"))
    links = [(r.doc_id, r.near_id) for r in fingerprint.near_pairs(spark.createDataFrame([(1,)], "doc_id long")).collect()]
    assert sorted(links) == [(a, b) for a in range(30) for b in range(a)]

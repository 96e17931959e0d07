"""near_groups on drifting chains, against brute force over fingerprints."""

import numpy as np

from prooflake.llm import edit_embedding


def test_drifting_chains(spark, monkeypatch):
    rng = np.random.default_rng(3)
    fps = []

    def changed(fp, slots):
        out = np.array(fp)
        out[slots] = (out[slots] + rng.integers(1, 256, len(slots))) % 256
        return out

    b = rng.integers(1, 256, 128)
    first, third = np.arange(8, 128, 8), np.arange(9, 128, 8)  # a slot of each band of 8 but the first
    a = changed(b, [*first, 10, 18])
    a[8] = 0  # the least of its bucket
    fps += [a, b, changed(b, [*third, 27, 35, 43, 51])]
    far = rng.integers(0, 256, 128)
    fps += [far, changed(far, [*np.arange(0, 128, 8), *np.arange(1, 72, 8)])]  # 25 unequal slots, one or more in each band of 8
    for _ in range(20):
        fp = rng.integers(0, 256, 128)
        for _ in range(15):
            fps.append(fp)
            fp = changed(fp, rng.choice(128, rng.integers(15, 32), replace=False))
    fps = [fps[i] for i in rng.permutation(len(fps))]
    comp = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] == fps[j]).mean() >= 0.8:
                low, high = sorted((comp[i], comp[j]))
                comp = [low if c == high else c for c in comp]
    table = spark.createDataFrame([(i, bytearray(fp.astype(np.uint8).tobytes())) for i, fp in enumerate(fps)], "doc_id long, fp binary")
    monkeypatch.setattr(edit_embedding, "fingerprints", lambda *_: table)
    assert sorted((r.doc_id, r.group_id) for r in edit_embedding.near_groups(table).collect()) == list(enumerate(comp))

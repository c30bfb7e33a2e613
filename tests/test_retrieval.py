"""The exact search by tiles."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from palimpsest.operators import retrieval


def test_a_task_passes_on_k_rows_a_query(monkeypatch):
    """Not k rows a batch; equal scores go by the smallest id, whatever the tiles."""
    rng = np.random.default_rng(5)
    data = rng.integers(-2, 3, size=(300, 3)).astype(np.float32) + np.float32(0.5)  # many equal scores
    vec = rng.permutation(300)
    units = retrieval._unit(data[:40].astype(np.float64))
    batches = [pa.RecordBatch.from_arrays([pa.array(vec[i : i + 25]), pa.array(np.zeros(25, np.int32)), pa.array(data[i : i + 25].tolist(), pa.list_(pa.float32()))], names=["vec_id", "label", "embedding"]) for i in range(0, 300, 25)]
    scores = np.round(retrieval._unit(data.astype(np.float64)) @ units.T, 4) + 0.0
    want = sorted((q, int(vec[r])) for q in range(40) for r in np.lexsort((vec, -scores[:, q]))[:4])
    for rows, queries in ((4096, 256), (7, 11), (3, 1)):
        monkeypatch.setattr(retrieval, "ROW_TILE", rows)
        monkeypatch.setattr(retrieval, "QUERY_TILE", queries)
        out = list(retrieval._scan(SimpleNamespace(value=(np.arange(40), units)), 4)(iter(batches)))
        got = [(q, v) for b in out for q, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        assert len(got) == 160 and sorted(got) == want

import random

import pyarrow as pa

from quillmesh.operators import hierarchy as H


def _ends(rows):
    """What every event's pointers add up to: (last event, count, open)."""
    out = {}
    for e in rows:
        at, count, open_, tail = e, 0, 0, e
        while at is not None:
            nxt, c, o, t = rows[at]
            count, open_, tail, at = count + c, open_ + o, t, nxt
        out[e] = (tail, count, open_)
    return out


def test_contraction_keeps_what_pointers_add_up_to(monkeypatch):
    rng = random.Random(6)
    for part in (1, 4, 1_000):
        monkeypatch.setattr(H, "PART", part)
        ids = rng.sample(range(1_000), 120)
        rows = {e: (ids[i + 1] if i + 1 < len(ids) and rng.random() < 0.95 else None, 1, rng.choice((1, -1)), e) for i, e in enumerate(ids)}
        shuffled = rng.sample(ids, len(ids))
        columns = list(zip(*((e, *rows[e]) for e in shuffled)))
        names = ["e", "next", "count", "open", "tail"]
        batches = pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names).to_batches(max_chunksize=7)
        got = {r["e"]: (r["next"], r["count"], r["open"], r["tail"]) for b in H._contract(iter(batches)) for r in b.to_pylist()}
        assert _ends(got) == _ends(rows)
        if part == 1_000:
            assert all(r[0] is None for r in got.values())
    assert list(H._contract(iter([]))) == []

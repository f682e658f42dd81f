"""Mixing against the target weights themselves, not weights rounded to thousandths."""

from bisect import bisect_left
from math import sqrt

import pytest

from beliefmesh.llm import mixing


def test_slots_follow_the_target_weights():
    """A hot source with a third of the rows and 19 others: less than one block off at every slot (before: one block off
    after some 900 slots)."""
    rows = [950_000] + [100_000] * 19
    w = [sqrt(r) for r in rows]
    share = [x / sum(w) for x in w]
    slots = mixing.earliest_deadlines(mixing.fine_units(w), [-(-r // 32) for r in rows])
    assert len({s for own in slots for s in own}) == sum(-(-r // 32) for r in rows)
    lasting = min(s[-1] for s in slots)
    assert lasting > 50_000
    for t in range(1, lasting, 97):
        assert all(abs(bisect_left(own, t) - t * p) < 1 + 1e-4 for own, p in zip(slots, share, strict=True))


def test_many_small_sources_are_not_raised():
    w = [sqrt(15_000_000)] + [sqrt(3_000)] * 10_000
    units = mixing.fine_units(w)
    assert units[0] / sum(units) == pytest.approx(w[0] / sum(w), rel=1e-6)


def test_schedule_keeps_windows_of_the_target_weights(spark):
    rows = {"a": 3000, "b": 701, "c": 53, None: 11}
    d = spark.createDataFrame([(i, "t", s) for i, s in enumerate(k for k, n in rows.items() for _ in range(n))], "doc_id long, text string, source string")
    got = mixing.schedule(d, block_rows=2, splits=64).toPandas()
    total = sum(sqrt(n) for n in rows.values())
    assert len(got) == sum(rows.values()) and got.slot.notna().all()
    blocks = got.assign(source=got.source.fillna("")).groupby(["source", "block"]).agg(slot=("slot", "first"), n=("slot", "nunique"), rel=("release", "first"), due=("deadline", "first")).reset_index()
    assert (blocks.n == 1).all() and blocks.slot.is_unique
    assert ((blocks.slot >= blocks.rel) & (blocks.slot < blocks.due)).all()
    for s, n in rows.items():
        own, w = blocks[blocks.source == (s or "")].sort_values("block"), sqrt(n) / total
        assert list(own.block) == list(range(-(-n // 2)))
        assert (own.slot - own.block / w > -1 - 1e-6).all() and (own.slot < (own.block + 1) / w + 1).all()

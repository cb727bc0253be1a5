"""Totals of the whole market."""

import pytest


def test_segments_add_up_to_the_packs(packs, seven_packs):
    total = sum(r["value_t2"] for r in packs.select("value_t2").collect())
    by_level = {}
    for r in seven_packs.space_facts.collect():
        by_level[r["level"]] = by_level.get(r["level"], 0) + r["value_t2"]
    assert by_level["segment"] == by_level["treatment_archetype"] == pytest.approx(total)
    assert by_level["anchor_molecule"] >= total

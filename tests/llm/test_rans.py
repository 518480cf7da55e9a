"""The coder: exact round trips, segments on their own, damage noticed."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flightlag.llm.rans import SCALE, Block, CorruptBlock, Table, encode


def table_of(ids) -> Table:
    symbols, counts = np.unique(ids, return_counts=True)
    return Table.from_counts(symbols, counts)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=400), st.integers(1, 9), st.integers(1, 5))
def test_round_trip(ids, lanes, every):
    ids = np.array(ids, np.uint32)
    table = table_of(ids)
    block = Block(encode(ids, table, lanes, every), table)
    assert (block.decode() == ids).all()


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000, 200_000])
def test_sizes_and_segments(n):
    rnd = np.random.default_rng(n)
    ids = np.minimum(rnd.geometric(0.01, n), 5000).astype(np.uint16)
    table = table_of(np.append(ids, 7))
    packed = encode(ids, table, every=16)
    block = Block(packed, table)
    assert (block.decode() == ids).all()
    if n >= 200_000:
        assert block.segments > 5
        for k in (block.segments - 1, 3):  # in any order, without those before
            a = k * 16 * block.lanes
            assert (block.segment(k) == ids[a : a + len(block.segment(k))]).all()
        probability = np.bincount(ids) / n
        entropy = -(probability[probability > 0] * np.log2(probability[probability > 0])).sum()
        assert len(encode(ids, table)) * 8 < n * entropy * 1.11


def test_rare_symbols_get_a_slot_and_slots_add_up():
    table = Table.from_counts(np.arange(50_000), np.concatenate([[10**12], np.ones(49_999)]))
    assert table.slots.min() == 1 and table.slots.sum() == 1 << SCALE


@pytest.mark.parametrize("at", [0, 20, 40, 500, -1])
def test_damage_is_noticed(at):
    ids = np.arange(3000) % 50
    table = table_of(ids)
    packed = bytearray(encode(ids, table))
    packed[at] ^= 1
    with pytest.raises(CorruptBlock):
        Block(bytes(packed), table).decode()
    with pytest.raises(CorruptBlock):
        Block(encode(ids, table), table_of(ids + 1))

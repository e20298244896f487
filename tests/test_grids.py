import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hashloom.functions import grids

GRID = st.integers(2, 9).flatmap(lambda n: st.lists(st.lists(st.integers(0, 255), min_size=n, max_size=n), min_size=n, max_size=n))


@settings(max_examples=40, deadline=None)
@given(GRID)
def test_rotations(rows):
    px = np.array([rows], dtype=np.int64)
    turned = px
    for _ in range(4):
        turned = grids.rotate(turned, 90)
    assert (turned == px).all()
    assert (grids.rotate(grids.rotate(px, 90), 270) == px).all()
    assert (grids.rotate(px, 180)[0].ravel() == px[0].ravel()[::-1]).all()
    n = len(rows)
    assert grids.rotate(px, 90)[0, 0, 0] == rows[n - 1][0]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40))
def test_resize_weights_are_whole(n, to):
    table = grids.resize_table(n, to)
    assert table.shape == (to, n)
    assert (table.sum(axis=1) == grids.ONE).all()
    assert (table >= 0).all()


def test_constant_grid_stays():
    px = np.full((1, 8, 8), 77)
    assert (grids.blur(px, 0.9) == 77).all()
    assert (grids.resize(px, 5, 13) == 77).all()


def test_bits_by_hand():
    px = np.arange(64).reshape(1, 8, 8) * 4
    assert grids.average_bits(px, 8)[0].tolist() == [False] * 32 + [True] * 32
    assert grids.vert_gradient_bits(px, 8).all()
    assert grids.gradient_bits(px, 8).all()
    assert not grids.gradient_bits(grids.rotate(px, 180), 8).any()
    flat = np.full((1, 8, 8), 3)
    assert grids.average_bits(flat, 8).all() and not grids.gradient_bits(flat, 8).any()


def test_packing():
    bits = np.zeros((1, 72), bool)
    bits[0, 0] = bits[0, 71] = True
    data = grids.packed(bits)
    assert data.tolist() == [[128, 0, 0, 0, 0, 0, 0, 0, 1]]
    assert grids.to_words(data).tolist() == [[-(1 << 63), 1 << 56]]


def test_large_sizes():
    px = np.random.default_rng(1).integers(0, 256, (2, 20, 30))
    for size in (64, 256):
        assert grids.average_bits(px, size).shape == (2, size * size)
        assert grids.to_words(grids.packed(grids.vert_gradient_bits(px, size))).shape == (2, size * size // 64)

"""Hashes of byte ranges: equal ranges agree wherever they stand, different ones do not, also those made to collide."""

import random

import numpy as np
import pytest
from pairs import complement, thue_morse

from salesflow.llm import textops
from salesflow.llm.textops import range_hash


def plain(piece):
    """The polynomial of a byte string modulo the prime."""
    value = 0
    for b in reversed(piece):
        value = (value * textops._ROOT + b + 1) % textops._PRIME
    return int(textops.mixed(np.array([value], np.uint64))[0])


@pytest.mark.parametrize("exact", [1 << 23, 64])
def test_any_range_has_the_hash_of_its_bytes(monkeypatch, exact):
    monkeypatch.setattr(textops, "_EXACT_BYTES", exact)
    rng = random.Random(1)
    data = bytes(rng.choice([0, 7, 255, 97]) for _ in range(700))
    start = np.array([rng.randrange(701) for _ in range(400)])
    end = np.array([rng.randint(a, 700) for a in start])
    got = range_hash(np.frombuffer(data, np.uint8))(start, end)
    assert got.tolist() == [plain(data[a:b]) for a, b in zip(start, end)]


def test_sums_of_a_long_text_do_not_overflow():
    data = np.full((1 << 23) + 5000, 255, np.uint8)
    at = np.array([0, 17, (1 << 23) - 3000, (1 << 23) + 900])
    got = range_hash(data)(at, at + 4000)
    assert len(set(got.tolist())) == 1 and got[0] == plain(bytes([255]) * 4000)


def test_constructed_words_do_not_collide():
    for n in (10, 11, 14):
        a, b = thue_morse(n), complement(n)
        data = np.frombuffer((a + b).encode(), np.uint8)
        x, y = range_hash(data)(np.array([0, len(a)]), np.array([len(a), 2 * len(a)]))
        assert a != b and x != y

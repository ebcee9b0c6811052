import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import induced


def check(t, depth, scratch=None):
    blocks = list(induced.suffixes(np.array(t, dtype=np.uint16), depth, scratch))
    pos = np.concatenate([p for p, _ in blocks]).tolist()
    lcp = np.concatenate([x for _, x in blocks]).tolist()
    assert sorted(pos) == list(range(len(t)))
    cut = [t[p : p + depth] for p in pos]
    assert all(a >= b for a, b in zip(cut, cut[1:]))
    for i in range(1, len(pos)):
        a, b = t[pos[i - 1] :], t[pos[i] :]
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        assert min(lcp[i], depth) == min(k, depth), (t, pos, lcp, i)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 12))
def test_small_alphabets(t, depth):
    check(t + [1, 0], depth)


@pytest.mark.parametrize("t", [[0], [1, 0], [1] * 50 + [0], [1, 2] * 40 + [0], [2, 1] * 40 + [0], list(range(1, 257)) + [0], list(range(256, 0, -1)) + [0]])
def test_runs(t):
    check(t, 20)


def test_queues_on_disk(tmp_path):
    from pyarrow import fs

    t = np.random.default_rng(0).integers(1, 5, 3000).tolist() + [0]
    check(t, 30, induced.Scratch((fs.LocalFileSystem(), str(tmp_path / "s")), memory=2000))
    assert not (tmp_path / "s").exists()

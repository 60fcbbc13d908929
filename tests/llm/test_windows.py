"""Properties that hold for any input."""

from hypothesis import given, settings
from hypothesis import strategies as st

from broadsheet.llm import packing
from broadsheet.llm.common import fresh, release, staged


@given(st.lists(st.integers(1, 64), max_size=60), st.integers(1, 5), st.integers(0, 8))
@settings(max_examples=300, deadline=None)
def test_windows_hold_every_id_once(sizes, most, min_cut):
    windows, at = packing.Windows(64, most, min_cut), 0
    for i, n in enumerate(sizes):
        windows.add(i, 0, b"".join((at + k).to_bytes(4, "little") for k in range(n)), n)
        at += n
        assert len(windows.held) <= most
    pieces = [p for _, w in [*windows.done, *windows.held.items()] for p in w]
    ids = sorted(int.from_bytes(p[2][k : k + 4], "little") for p in pieces for k in range(0, len(p[2]), 4))
    assert ids == list(range(at))
    for _, held in windows.done:
        assert 64 - max(min_cut, 1) < sum(len(p[2]) // 4 for p in held) <= 64
    numbers = [n for n, _ in windows.done] + list(windows.held)
    assert len(numbers) == len(set(numbers))


def test_staged_tables_are_released(spark):
    release(spark)
    df = staged(spark.range(3), "probe")
    assert df.count() == 3 and fresh(df, "ID") == "ID_" and release(spark) == 1 and release(spark) == 0

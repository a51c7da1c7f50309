import random

from hypothesis import given
from hypothesis import strategies as st

from cinderlog.model import MICRO, MINUTE
from cinderlog.plans.sections import FOREVER, Section, sections

TIMES = st.integers(min_value=-3 * MINUTE, max_value=6 * MINUTE)


@given(TIMES, st.integers(min_value=1, max_value=4 * MINUTE), st.sampled_from([-FOREVER, 0, MINUTE, 3 * MINUTE, FOREVER]))
def test_parts_make_up_the_range(since, width, second_from):
    parts = sorted(sections(since, since + width, second_from), key=lambda s: s.start)
    assert parts[0].start == since and parts[-1].end == since + width
    assert all(a.end == b.start for a, b in zip(parts, parts[1:], strict=False))
    for p in parts:
        grain = {"minute": MINUTE, "second": MICRO, "raw": 1}[p.grain]
        assert p.start % grain == 0 and p.end % grain == 0 and p.start < p.end
        assert p.grain != "second" or p.start >= second_from


def test_short_range_over_a_second_keeps_both_sides():
    since, until = 10_500_000, 11_200_000
    assert sections(since, until, 0) == [Section("raw", since, until)]
    assert sections(10_500_000, 13_200_000, 0) == [Section("raw", 10_500_000, 11_000_000), Section("second", 11_000_000, 13_000_000), Section("raw", 13_000_000, 13_200_000)]


def test_counts_agree_with_brute_force():
    r = random.Random(1)
    rows = [r.randrange(0, 5 * MINUTE, 1000) for _ in range(2000)]
    per_second, per_minute = {}, {}
    for t in rows:
        per_second[t // MICRO] = per_second.get(t // MICRO, 0) + 1
        per_minute[t // MINUTE] = per_minute.get(t // MINUTE, 0) + 1
    for _ in range(3000):
        since = r.randrange(0, 5 * MINUTE, 1000)
        until = since + r.choice([1000, 700_000, 1_600_000, MINUTE, 3 * MINUTE]) + r.randrange(0, 10_000, 1000)
        total = 0
        for s in sections(since, until, r.choice([0, 2 * MINUTE])):
            if s.grain == "raw":
                total += sum(s.start <= t < s.end for t in rows)
            else:
                stored, width = (per_second, MICRO) if s.grain == "second" else (per_minute, MINUTE)
                total += sum(stored.get(k, 0) for k in range(s.start // width, s.end // width))
        assert total == sum(since <= t < until for t in rows)

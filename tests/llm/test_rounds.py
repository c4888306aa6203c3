from collections import defaultdict

import numpy as np
import pytest

from quarry.llm import rounds


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for n in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def check(found, rows, capacity):
    size = dict(rows)
    fill = defaultdict(list)
    assert sorted(r.id for r in found) == sorted(size)
    for r in found:
        fill[r.sequence_id].append((r.offset, size[r.id] or 0.0))
    for parts in fill.values():
        at = 0.0
        for offset, n in sorted(parts):
            assert offset == pytest.approx(at)
            at += n
        assert at <= capacity + 1e-9
    return len(fill)


@pytest.mark.parametrize("kind", ["whole", "fractions", "equal"])
def test_about_as_good_as_one_document_at_a_time(spark, kind):
    rng = np.random.default_rng(8)
    sizes = {"whole": rng.integers(15, 65, 400).astype(float), "fractions": rng.uniform(12.0, 60.0, 300), "equal": np.full(120, 20.0)}[kind]
    rows = [(k, float(x)) for k, x in enumerate(sizes)]
    found = rounds.pack_in_rounds(spark.createDataFrame(rows, "id bigint, size double").repartition(5), 64.0).collect()
    assert check(found, rows, 64.0) <= 1.03 * best_fit_decreasing(sizes.tolist(), 64.0) + 1


def test_depths_between_ranges():
    """Ranges that leave (documents, gaps): 1 finds none and leaves 2, of which 3 takes one and 4 the other, and a third goes without."""
    assert rounds._depths({0: (1, 0), 1: (0, 2), 2: (0, 0), 3: (1, 1), 4: (3, 0)}) == [(0, 0, 0), (1, 0, 0), (2, 2, 2), (3, 2, 1), (4, 2, 0)]


def test_odd_rows(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id bigint, size double").selectExpr("*", "1 as key", "2 as gap")
    assert rounds.pack_in_rounds(frame([]), 10).count() == 0
    rows = [(1, None), (2, 0.0), (3, 10.0), (4, 10.0), (5, 3.0)]
    assert check(rounds.pack_in_rounds(frame(rows), 10).collect(), rows, 10) == 3
    with pytest.raises(ValueError, match="over the capacity"):
        rounds.pack_in_rounds(frame([(1, 11.0)]), 10)

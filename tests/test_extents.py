import pytest

from tessera.operators import extents as X


@pytest.mark.parametrize(
    ("extent", "expected"),
    [
        (X.at(3), (3, 1)), (3, (3, 1)), (X.since(4), (4, 6)), (X.between(2, 5), (2, 3)), (X.between(5, 2), (5, 0)), (X.through(2, 5), (2, 4)),
        (X.until(4), (0, 4)), (X.until_inclusive(4), (0, 5)), (X.FULL, (0, 10)), (X.run(6, 3), (6, 3)), (range(1, 4), (1, 3)), (slice(2, None), (2, 8)),
    ],
)
def test_each_form(extent, expected):
    start, count = X.resolve([extent], [10])
    assert (start[0], count[0]) == expected


def test_whole_array_and_scalar():
    assert X.resolve(X.ALL, [4, 5]) == ([0, 0], [4, 5])
    assert X.resolve((), []) == ([], [])


def test_tuple_of_ints_is_two_indices_and_pair_is_start_and_count():
    assert X.resolve((1, 2), [4, 5]) == ([1, 2], [1, 1])
    assert X.resolve(((1, 2), X.FULL), [4, 5]) == ([1, 0], [2, 5])


def test_errors():
    with pytest.raises(ValueError, match="1 extents for 2 dimensions"):
        X.resolve([X.FULL], [4, 5])
    with pytest.raises(IndexError):
        X.resolve([X.run(3, 2)], [4])
    with pytest.raises(IndexError):
        X.resolve([X.at(-1)], [4])
    with pytest.raises(ValueError, match="strides"):
        X.resolve([slice(0, 4, 2)], [4])
    with pytest.raises(ValueError, match="2 starts and 1 counts"):
        X.from_vectors([1, 2], [3])
    assert X.resolve([X.run(9, 0)], [4]) == ([9], [0])  # empty selections may lie anywhere


def test_subscripts_follow_numpy():
    assert X.normalize_key(-1, [10]) == ([9], [1], [True])
    assert X.normalize_key((slice(5, 100), Ellipsis), [10, 4, 3]) == ([5, 0, 0], [5, 4, 3], [False] * 3)
    assert X.normalize_key((Ellipsis, 2), [10, 4, 3]) == ([0, 0, 2], [10, 4, 1], [False, False, True])
    with pytest.raises(IndexError):
        X.normalize_key(10, [10])
    with pytest.raises(ValueError, match="strides"):
        X.normalize_key(slice(None, None, -1), [10])

"""Operators run where the workers don't hold the package."""

from tests.test_workers import rows_from_elsewhere


def test_operators_without_the_package(tmp_path):
    names = [f"op{k}" for k in range(1, 14)]
    import __spark_entry__ as e

    queries = [q for q in e.queries() if q.split("_")[0] in names]
    got = rows_from_elsewhere(tmp_path, queries)
    assert len(queries) == len(names) and set(got) == set(queries) and all(got.values())

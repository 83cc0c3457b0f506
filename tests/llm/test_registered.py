"""The driver's entry with the subpackage: all ten queries and the pipeline."""

import __spark_entry__ as e


def test_entry_with_everything():
    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in e.queries() and set(e.oracle_sql()) <= set(e.queries())

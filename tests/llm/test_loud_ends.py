import os
import subprocess
import sys

import pytest

from larkspur.llm import shared
from larkspur.llm.components import components


def test_components_that_do_not_settle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.comp for r in components(edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(edges, max_rounds=1)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


class Elsewhere:
    """A session on a cluster without a shared folder."""

    class conf:
        get = staticmethod(lambda name, default=None: default)

    class sparkContext:
        master = "spark://somewhere:7077"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError):
        shared.shared_dir(Elsewhere)


def test_tables_are_dropped(spark):
    t = shared.staged(spark.range(3), "loud")
    assert t.count() == 3
    shared.unstage(t, spark.range(2))
    with pytest.raises(Exception):
        t.count()


def entry_without(module):
    """The driver's entry points in a process in which a module is missing."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"import sys; sys.modules[{module!r}] = None; import __spark_entry__ as e; print(*e.queries())"
    return subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("module", ["corpus_pipeline", "larkspur.llm"])
def test_the_rest_works_without_the_corpus_modules(module):
    names = entry_without(module).stdout.split()
    assert "top_customers" in names and "pipeline" not in names and not any(n.startswith("op") for n in names)


def test_errors_inside_the_corpus_modules_are_seen():
    assert "larkspur.llm.components" in entry_without("larkspur.llm.components").stderr

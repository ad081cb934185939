"""The driver's entry with and without the corpus subpackage."""

import importlib
import sys

import pytest

import __spark_entry__ as entry
from parchline.workloads import ORACLES, QUERIES


class Absent:
    """Finds nothing under the given name, as if its files were deleted."""

    def __init__(self, name):
        self.name = name

    def find_spec(self, name, path=None, target=None):
        if name == self.name:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)


@pytest.mark.parametrize("absent", ["corpus_pipeline", "parchline.llm"])
def test_other_queries_stay_without_the_corpus_subpackage(monkeypatch, absent):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("parchline.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Absent(absent), *sys.meta_path])
    bare = importlib.reload(entry)
    assert set(bare.queries()) == set(QUERIES) and set(bare.oracle_sql()) == set(ORACLES)


def test_a_broken_import_is_not_swallowed(monkeypatch, tmp_path):
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module_at_all\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    with pytest.raises(ModuleNotFoundError, match="no_such_module_at_all"):
        importlib.reload(entry)


def test_the_library_does_not_need_the_subpackage():
    from pathlib import Path

    root = Path(entry.__file__).parent / "parchline"
    users = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "llm" in p.read_text(encoding="utf-8")]
    assert users == []

import importlib
import re
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture
def entry():
    import __spark_entry__

    return __spark_entry__


def test_core_stands_without_the_text_operators(entry, monkeypatch):
    for name in [m for m in sys.modules if m.startswith("quire.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "quire.llm", None)
    alone = importlib.reload(entry)
    assert "p5_found" in alone.queries() and "p1_found" not in alone.queries() and set(alone.oracle_sql()) <= set(alone.queries())
    monkeypatch.undo()
    importlib.reload(entry)


def test_a_fault_inside_the_text_operators_is_no_absence(entry, monkeypatch):
    for name in [m for m in sys.modules if m.startswith("quire.llm")]:
        monkeypatch.delitem(sys.modules, name)
    real = __import__

    def broken(name, *args, **kwargs):
        if name.startswith("quire.llm"):
            raise ModuleNotFoundError("No module named 'tiktoken'", name="tiktoken")
        return real(name, *args, **kwargs)

    monkeypatch.setattr("builtins.__import__", broken)
    with pytest.raises(ModuleNotFoundError):
        importlib.reload(entry)
    monkeypatch.undo()
    importlib.reload(entry)


def test_nothing_else_imports_the_text_operators():
    for path in (ROOT / "quire").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(from|import)\s+quire\.llm", path.read_text(), re.M), path


def test_every_sql_twin_has_a_query(entry):
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_local_checkpoint_and_no_inference():
    for path in (ROOT / "quire").rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text and "inferSchema" not in text, path

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_the_core_does_not_import_the_training_part():
    for p in (ROOT / "corpusloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(?:from|import)\s+[\w.]*\bllm\b", p.read_text(), re.M), p


def test_no_local_checkpoints():
    for p in (ROOT / "corpusloom").rglob("*.py"):
        assert "localCheckpoint" not in p.read_text(), p

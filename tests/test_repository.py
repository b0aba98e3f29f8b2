"""Rules of the repository itself."""

import re
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent


def test_nothing_imports_the_training_data_operators():
    for p in (ROOT / "indexflow").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(?:from|import)\s+(?:indexflow\.llm|corpus_pipeline)", p.read_text(), re.M), p


@pytest.mark.parametrize("pipeline", [True, False])
@pytest.mark.parametrize("left", ["nothing", "caches"])
def test_the_entry_imports_without_them(tmp_path, pipeline, left):
    """With the subpackage gone, and the pipeline there or not, the entry still has the other queries."""
    (tmp_path / "indexflow").mkdir()
    for p in (ROOT / "indexflow").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            to = tmp_path / p.relative_to(ROOT)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(p.read_text())
    if left == "caches":
        (tmp_path / "indexflow" / "llm" / "__pycache__").mkdir(parents=True)
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (ROOT / "corpus_pipeline.py").exists() else [])):
        (tmp_path / name).write_text((ROOT / name).read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)})


def test_every_oracle_has_its_query():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

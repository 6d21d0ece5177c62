"""Everything but the corpus operators works where they are absent."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_entry_without_corpus_operators():
    code = (
        "import sys; sys.modules['gridweave.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e, bench\n"
        "names = e.queries(); assert 'axes_pivot' in names and 'pipeline' not in names and not any(n.startswith('op1') for n in names)\n"
        "assert set(e.oracle_sql()) <= set(names)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_library_does_not_import_corpus_operators():
    own = [p for p in (ROOT / "gridweave").rglob("*.py") if "llm" not in p.parts]
    assert own and not any("llm" in p.read_text() for p in own)

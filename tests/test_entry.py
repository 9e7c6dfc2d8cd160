"""The entry module without the optional part."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("absent", ["ahocorasick", "public_tokenizers", "hearthflow.llm", "corpus_pipeline"])
def test_an_absent_package_leaves_the_other_queries(absent):
    code = (
        f"import sys; sys.modules['{absent}'] = None; import __spark_entry__ as e; "
        "from hearthflow.catalog import QUERIES; assert set(QUERIES) <= set(e.queries()); "
        "assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    )
    ran = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert ran.returncode == 0, ran.stderr
    assert int(ran.stdout) >= 117

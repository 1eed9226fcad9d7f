"""The driver's entry module, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

BLOCK = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("glossweave.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "fixture_mentions" in e.queries() and not [n for n in e.queries() if n.startswith("op") or n == "pipeline"]
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_without_the_optional_subpackage():
    subprocess.run([sys.executable, "-c", BLOCK], cwd=ROOT, check=True)


WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "xxhash":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "fixture_mentions" in e.queries() and "op5_covering_simhash" not in e.queries()
"""


def test_without_a_package_that_the_subpackage_needs():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True)


def test_oracles_belong_to_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())

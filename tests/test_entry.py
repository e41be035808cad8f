"""The driver's contract, with and without the llm subpackage."""

import subprocess
import sys

import __spark_entry__ as entry

BLOCK = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("tiermark.llm") or name == "corpus_pipeline":
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 140 and "pipeline" not in e.queries() and not any(n.startswith("op1") for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_flagship(spark):
    made = entry.entry(spark)
    assert made.columns == ["client", "plan", "total"] and made.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_llm():
    subprocess.run([sys.executable, "-c", BLOCK], check=True, timeout=120)

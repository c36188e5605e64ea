"""The driver's entry must import without the training-data subpackage or what it needs."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCK = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {blocked!r} or name in {blocked!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as entry
names = entry.queries()
assert "doc_batch_plan" in names and not any(n.startswith("op") or n == "pipeline" for n in names), sorted(names)
assert set(entry.oracle_sql()) <= set(names)
"""


@pytest.mark.parametrize("blocked", [["xxhash"], ["public_tokenizers"], ["pagemill.llm", "corpus_pipeline"]])
def test_entry_without_the_subpackage(blocked):
    done = subprocess.run([sys.executable, "-c", BLOCK.format(blocked=blocked)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr

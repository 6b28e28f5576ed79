"""The entry without the training-data part, or without a library that only it needs."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
COUNT = """
import sys
for name in sys.argv[1:]:
    sys.modules[name] = None
import __spark_entry__ as contract
names = contract.queries()
assert not [n for n in contract.oracle_sql() if n not in names]
print(len([n for n in names if not n.startswith("op") and n != "pipeline"]), len(contract.LLM))
"""


def counted(*hidden):
    done = subprocess.run([sys.executable, "-c", COUNT, *hidden], cwd=ROOT, text=True, check=True,
                          capture_output=True, env=os.environ | {"PYTHONPATH": str(ROOT)})
    return [*map(int, done.stdout.split())], done.stderr


@pytest.mark.parametrize("hidden", [
    "brindle.llm", "corpus_pipeline", "public_tokenizers", "tiktoken", "xxhash", "pandas"])
def test_the_other_queries_stay(hidden):
    (own, training), said = counted(hidden)
    assert own == 47
    if not training:
        assert "without the training-data queries" in said


def test_nothing_is_said_where_all_is_there():
    (own, training), said = counted()
    assert own == 47 and (not training) == ("without the training-data queries" in said)

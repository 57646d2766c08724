"""The entry without the training-data operators, and without packages that only those need."""

import subprocess
import sys
from pathlib import Path

import pytest

from evidence.plans.queries import ORACLE_SQL, QUERIES

ROOT = Path(__file__).resolve().parents[1]
BLOCK = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {missing!r} or name in {missing!r}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), "lexeme_stats" in e.queries(), any(q.startswith("op") for q in e.queries()))
"""


def entry(*missing):
    done = subprocess.run([sys.executable, "-c", BLOCK.format(missing=missing)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, sql, core, ops = done.stdout.split()[-4:]
    return int(n), int(sql), core == "True", ops == "True"


@pytest.mark.parametrize("missing", ["evidence.llm", "corpus_pipeline", "xxhash", "zstandard", "duckdb", "tokenizers", "public_tokenizers"])
def test_core_queries_stay(missing):
    n, sql, core, _ = entry(missing)
    assert core and n >= len(QUERIES) and sql >= len(ORACLE_SQL)

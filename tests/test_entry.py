"""The queries outside of the optional part do not depend on it."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["textlab.llm", "corpus_pipeline", "xxhash", "public_tokenizers", "tokenizers"])
def test_queries_without_the_optional_part(missing):
    code = (f"import sys; sys.modules[{missing!r}] = None\n"
            "import __spark_entry__ as e\n"
            "names = list(e.queries())\n"
            "assert len(names) > 90 and set(e.oracle_sql()) <= set(names)\n"
            "assert not [n for n in names if n == 'pipeline' or n[:2] == 'op' and n[2:3].isdigit()], names\n")
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]

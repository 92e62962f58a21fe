"""The driver contract holds without the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_a_missing_module_of_theirs_leaves_only_them_out():
    code = (
        "import sys; sys.modules['public_tokenizers'] = None\n"
        "import __spark_entry__ as e\n"
        "q = e.queries(); assert 'top_apps' in q and not any(k.startswith('op1_') for k in q)\n"
        "assert 'top_apps' in e.oracle_sql()\n"
    )
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr

"""The entry point without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in e.queries()))"


def test_entry_without_the_corpus_operators(tmp_path):
    for gone in (["sparkloom/llm", "tests/llm", "corpus_pipeline.py"], ["sparkloom/llm", "tests/llm"]):
        at = tmp_path / str(len(gone))
        shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__"))
        for name in gone:
            path = at / name
            if path.is_dir():
                shutil.rmtree(path)
            elif path.exists():
                path.unlink()
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        said = subprocess.run([sys.executable, "-c", SAY], cwd=at, env=env, capture_output=True, text=True, timeout=120)
        assert said.returncode == 0, said.stderr[-2000:]
        queries, oracles, corpus = map(int, said.stdout.split())
        assert queries > 200 and oracles > 200 and corpus == 0

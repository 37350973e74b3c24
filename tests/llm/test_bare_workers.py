"""Task functions run on workers that cannot import the package."""

import os
import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).resolve().parents[2])
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from lumenfield.session import local_session
spark = local_session(4, "bare")

def importable(batches):
    import importlib.util
    for _ in batches:
        pass
    assert importlib.util.find_spec("lumenfield") is None, "the workers know the package"
    yield from ()

spark.range(1).mapInPandas(importable, "id long").collect()
import __spark_entry__ as entry
from lumenfield.llm import pieces
for key in ("op3_pieces", "op4_embedding_caps", "op11_divergence", "op12_phrases"):
    print(key, entry.queries()[key](spark, "/root/testdata/sf0.001").count())
docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
print("stage", pieces.stage(spark, docs, "/root/testdata/sf0.001").count())
"""


def test_workers_need_no_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT, REPO], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    counts = dict(line.split() for line in run.stdout.splitlines() if line.startswith(("op", "stage")))
    assert set(counts) == {"op3_pieces", "op4_embedding_caps", "op11_divergence", "op12_phrases", "stage"} and all(int(n) > 0 for n in counts.values())

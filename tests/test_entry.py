"""The entry module without the corpus operators, which may be deleted."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("gone", [["loomgraph/llm", "tests/llm"], ["loomgraph/llm", "tests/llm", "corpus_pipeline.py"]])
def test_queries_are_there_without_the_corpus_operators(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for x in gone:
        place = tmp_path / "copy" / x
        if place.is_dir():
            shutil.rmtree(place)
        elif place.exists():
            place.unlink()
    env = {"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "copy"), "PYTHONDONTWRITEBYTECODE": "1"}
    out = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, corpus = out.stdout.split()
    assert int(n) > 100 and corpus == "False"


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from loomgraph import scratch

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.shared_dir(Session)


def test_work_tables_go_when_dropped(spark):
    import glob

    from loomgraph import scratch

    with scratch.work() as made:
        flat = scratch.table(spark.range(10), "flat", made)
        dealt = scratch.bucketed(spark.range(10), "id", "dealt", made)
        joined = flat.join(dealt, "id")
        assert joined.count() == 10 and len(made) == 2
        places = [path for _, path, _ in made]
        assert all(glob.glob(f"{p.removeprefix('file:')}/*.parquet") for p in places)
    assert not any(glob.glob(p.removeprefix("file:")) for p in places)

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from geostride.session import shared_dir

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("left", ["nothing", "empty folder", "pipeline", "both"])
def test_the_rest_works_without_the_llm_folders(tmp_path, left):
    """With the folder gone or emptied, and with or without the pipeline beside it."""
    for name in ("geostride", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "geostride" / "llm", ignore_errors=True)
    if left in ("empty folder", "both"):
        (tmp_path / "geostride" / "llm" / "__pycache__").mkdir(parents=True)
    if left in ("nothing", "empty folder"):
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert "tile_of_point" in run.stdout and "op1_" not in run.stdout and "pipeline" not in run.stdout


def test_errors_inside_the_llm_folder_are_errors(tmp_path):
    for name in ("geostride", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "geostride" / "llm", ignore_errors=True)
    (tmp_path / "geostride" / "llm").mkdir()
    (tmp_path / "geostride" / "llm" / "__init__.py").write_text("")
    (tmp_path / "geostride" / "llm" / "queries.py").write_text("from geostride.llm import missing\n")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=False)
    assert run.returncode and "missing" in run.stderr


OUTSIDE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
what = sys.argv[2]
if what == "fits":
    from geostride.operators import magnet
    print("ROWS", magnet.fits(spark.range(200).selectExpr("1 device", "id seq", "double(id % 7) x", "double(id % 5) y", "double(id % 3) z")).count())
elif what == "tiles":
    from geostride.sources import mvt
    print("ROWS", mvt.decode_tiles(spark.createDataFrame([(1, b"xx")], "z int, payload binary")).count())
else:
    from geostride.sources import pmtiles
    pmtiles.register(spark)
    print("ROWS", spark.read.format("pmtiles").options(path=sys.argv[3], what="header").load().count())
"""


@pytest.mark.parametrize("what", ["fits", "tiles", "source"])
def test_workers_get_the_package(tmp_path, what):
    """From a working folder where workers don't find the package by themselves."""
    (tmp_path / "x.pmtiles").write_bytes(b"no archive")
    (tmp_path / "run.py").write_text(OUTSIDE)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "run.py", str(ROOT), what, str(tmp_path / "x.pmtiles")], cwd=tmp_path, env=env, capture_output=True, text=True, check=False)
    assert "ROWS 1" in run.stdout, run.stderr[-2000:]


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):  # noqa: N802  the context's own name
            return None

    class Session:
        sparkContext, conf = Context(), type("Conf", (), {"get": lambda self, name, default=None: default})()  # noqa: N815

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_nothing_else_imports_the_llm_folder():
    for path in (ROOT / "geostride").rglob("*.py"):
        if "llm" not in path.parts:
            assert "geostride.llm" not in path.read_text(encoding="utf-8")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_flagship(spark):
    assert entry.entry(spark).count() == spark.read.parquet(f"{DATA}/customer.parquet").count()

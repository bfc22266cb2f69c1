"""The pipeline stage by stage against plain Python, and as a whole."""

import os
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from pixelmill.llm import quality, toxicity
from pixelmill.llm.queries import QUERIES
from pixelmill.llm.tables import shared_folder

from conftest import SF
from llm_cases import EDGE, docs_of  # noqa: F401
from test_dedup import kept_bytes, near


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "toxicity", "minhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    rows = lambda df: sorted(df.collect(), key=lambda r: r.doc_id)

    one = stages["quality_rules"](spark, docs, SF)
    verdict = {r.doc_id: r.kept for r in quality.score(docs, quality.fit(docs)).collect()}
    assert rows(one) == [r for r in rows(docs) if verdict[r.doc_id]] and one.schema == docs.schema
    two = stages["toxicity"](spark, one, SF)
    model = toxicity.fit(one, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(one, model).collect()}
    assert rows(two) == [r for r in rows(one) if scores[r.doc_id] < toxicity.THRESHOLD] and two.schema == docs.schema
    three = stages["minhash_near_dedup"](spark, two, SF)
    groups = near([(r.doc_id, r.text) for r in two.collect()])
    assert rows(three) == [r for r in rows(two) if groups[r.doc_id][1] == r.doc_id]
    four = stages["suffix_array_dedup"](spark, three, SF)
    want = kept_bytes([(r.doc_id, r.text) for r in three.collect()])
    assert four.columns == docs.columns
    texts = {r.doc_id: r.text for r in four.collect()}
    for r in three.collect():
        _, removed, _, left = want[r.doc_id]
        if not removed:
            assert texts[r.doc_id] == r.text
        elif r.doc_id in texts:  # characters cut through at a run's ends stay whole
            assert left.decode(errors="ignore").replace(" ", "")[:20] in texts[r.doc_id].replace(" ", "")
            assert 0 <= len(texts[r.doc_id].encode()) - len(left) <= 3 * removed
        else:
            assert not left.decode(errors="ignore").strip()
    last = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in last.collect()) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in stages["best_fit_packing"](spark, four, SF).collect())
    assert {r.doc_id for r in last.collect()} == set(texts)


def test_packed_pieces_hold_their_ids(spark, docs_of):
    out = corpus_pipeline.pack(spark, docs_of(EDGE), SF).collect()
    assert len(out) > len(EDGE)
    for r in out:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, np.int32).tobytes()) == r.ids_crc32


def test_stages_take_any_rows(spark, docs_of):
    for name, step in corpus_pipeline.STAGES:
        docs = docs_of(EDGE)
        out = step(spark, docs, SF)
        if name == "best_fit_packing":
            assert out.filter("piece = 0").count() == len(EDGE)
        else:
            assert out.columns == docs.columns and out.count() <= len(EDGE)
        assert step(spark, docs_of([]), SF).count() == 0


FOREIGN = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import functions as F
from pixelmill.session import build
import __spark_entry__ as entry
spark = build("foreign", "local[4]", **{{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.checkpoint.dir": {folder!r}}})
spark.sparkContext.setLogLevel("OFF")

def absent(rows):
    try:
        import pixelmill
    except ImportError:
        return iter([1])
    return iter([0])

assert spark.sparkContext.parallelize(range(2), 2).mapPartitions(absent).sum() == 2, "workers see the package"
for name in entry.LLM_QUERIES:
    entry.queries()[name](spark, {data!r}).write.format("noop").mode("overwrite").save()
    print("ran", name, flush=True)
spark.stop()
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    """All queries of this folder and the pipeline, with workers that start elsewhere."""
    script = tmp_path / "run.py"
    script.write_text(FOREIGN.format(repo=str(Path(corpus_pipeline.__file__).parent), folder=f"file://{tmp_path}/shared", data=SF))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-3000:]
    assert out.stdout.count("ran ") == len(QUERIES) + 1


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Cluster:
        conf = type("Conf", (), {"get": lambda self, key, default=None: default})()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Cluster())

"""What workers hold: the sketch's counting, the kinds of workers that a run starts, and caches between stages."""

import os
import subprocess
import sys
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa

from umbra.llm import jaccard
from umbra.llm.textops import shingle_sets

ROOT = Path(__file__).resolve().parents[2]


class Taken(Exception):
    pass


class Docs:
    """Stands for a table; gives away the function that its workers would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        raise Taken(run)


def test_counting_needs_little_more_than_the_sketch():
    texts = [" ".join(f"w{(i * j) % 7919}" for j in range(1, 400)).encode() for i in range(1, 2000)]
    try:
        jaccard._sketch(Docs(), 5)
    except Taken as taken:
        count = taken.args[0]
    batches = [pa.record_batch([pa.array(texts[i : i + 250], pa.binary()).cast(pa.string())], ["text"]) for i in range(0, len(texts), 250)]
    slots = 1 << jaccard.SKETCH_BITS
    tracemalloc.start()
    got = list(count(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * slots + (12 << 20)
    total = np.zeros(slots, np.uint32)
    for part in got:
        i = part.column(0)[0].as_py()
        total[i * slots // jaccard.RANGES : (i + 1) * slots // jaccard.RANGES] = np.frombuffer(zlib.decompress(part.column(1)[0].as_py()), np.uint32)
    at = np.concatenate(list(shingle_sets(texts, 5))) >> np.uint64(64 - jaccard.SKETCH_BITS)
    assert (total == np.bincount(at.astype(np.int64), minlength=slots)).all()


SCRIPT = """
import sys
import psutil, pyarrow as pa, public_tokenizers
from pyspark.sql import SparkSession
import corpus_pipeline
from umbra.llm.packing import pack_documents

spark = SparkSession.builder.master("local[1]").config("spark.sql.shuffle.partitions", "1").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
rows = [(i, ("the house and the garden " if i % 2 else "das Haus und der Garten ") + str(i), "en" if i % 2 else "de") for i in range(40)]
ids, texts, langs = zip(*rows)
docs = spark.createDataFrame(pa.table({"doc_id": ids, "text": texts, "lang": langs}))

def held(batches):
    wordbpe = sys.modules.get("umbra.llm.wordbpe")
    for _ in batches:
        yield pa.record_batch([pa.array([wordbpe.coder.cache_info().currsize if wordbpe else 0])], ["held"])

encoders = lambda: spark.range(1).mapInArrow(held, "held bigint").collect()[0].held
pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
packed = encoders()
assert corpus_pipeline.language(spark, docs, "").count() == 40
jvm = next(p for p in psutil.Process().children(recursive=True) if "java" in p.name())
print("SEEN", packed, encoders(), sum("pyspark.daemon" in " ".join(p.cmdline()) for p in jvm.children()))
"""


def test_one_kind_of_workers_which_drop_the_encoder_in_the_next_stage(tmp_path):
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")]), "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", SCRIPT, tmp_path.as_uri()], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "SEEN 1 0 1" in run.stdout, run.stdout + run.stderr[-3000:]

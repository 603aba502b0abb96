"""What line dedup and the training of toxicity leave behind."""

import time

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import lines, toxicity


def test_shuffle_files_go_as_line_dedup_goes_on(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three four five six "), F.col("id") % 40, F.lit(" seven eight\nnine ten eleven twelve thirteen "), "id").alias("text"))
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    spark.sparkContext._jvm.System.gc()
    time.sleep(3)
    before = blocks.getAllFiles().size()
    gone = lines.dropped_lines(docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("rev"), "text"), True)
    time.sleep(3)
    assert blocks.getAllFiles().size() - before <= 8
    assert gone.count() > 250


def test_windows_come_back_from_their_sizes():
    text = " ".join(f"word{i % 60} {i}" for i in range(100))
    ids, windows = toxicity.Terms(toxicity.BUCKETS).windows(text)
    got = toxicity.Examples([(ids, np.bincount(windows)), (ids[:0], np.bincount(windows[:0]))])
    assert len(got) == 2 and (got[0][0] == ids).all() and (got[0][1] == windows).all() and not len(got[1][1])

"""What the operators send to executors: small functions, and everything that runs them."""

import os
import subprocess
import sys

from pyspark import cloudpickle

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FOREIGN = """
import os, sys
sys.path.insert(0, {repo!r})
import numpy as np
from pyspark.sql import SparkSession, functions as F
from graphdyn.llm import decontam, html, language, toxicity
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
rows = [(i, ("ein haus steht dort", "the house is there")[i % 2], ("de", "en")[i % 2], i % 2) for i in range(40)]
df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
model = language.fit(df, "text", "lang", "doc_id")
print(language.predict(df, model, keep=("doc_id",)).count(), language.accept(df, model).count())
print(toxicity.score(df, toxicity.fit(df, df, "text", "toxic", "doc_id"), keep=("doc_id",)).count())
print(decontam.clean(df, df.limit(2).select(F.col("doc_id").alias("item_id"), "text")).count())
pages = df.select("doc_id", F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("html"))
print(html.extract(pages, html.fit(pages), keep=("doc_id",)).count())
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", FOREIGN.format(repo=REPO)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=300)
    assert done.stdout.split() == ["40", "40", "40", "0", "40"], done.stderr[-2000:]


def test_functions_stay_small_after_an_index_was_built():
    from graphdyn.llm import decontam, jaccard, language, suffix, toxicity
    decontam.Index([1], ["some words that make one item of the benchmark " * 50])
    language.grams(["some text"])
    for fn in (jaccard._pack(8), suffix._finish, toxicity.features, language.grams, decontam.Index):
        assert len(cloudpickle.dumps(fn)) < 100_000, fn

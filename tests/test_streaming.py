import json
import os
import tempfile

from pyspark.sql import functions as F

from quire.functions.analyzers import analyze
from quire.streaming.scoring import score_batches, tokenized_stream


def test_stream_tokenise_and_score(spark):
    src = tempfile.mkdtemp(prefix="quire-src-")
    with open(os.path.join(src, "a.txt"), "w") as f:
        for i in range(5):
            f.write(json.dumps({"title": f"Paper {i}", "abstract": "Fig.2 shows it.",
                                "keywords": ["x"], "plength": i}) + "\n")
    out = tempfile.mkdtemp(prefix="quire-out-")
    ck = tempfile.mkdtemp(prefix="quire-ck-")

    def score(batch):
        return batch.select("text", "label", F.size(analyze("text")).cast("double").alias("prediction"))

    q = score_batches(tokenized_stream(spark, src), score, out, ck)
    q.awaitTermination(120)
    got = spark.read.parquet(out).collect()
    assert len(got) == 5
    assert all("fig . 2 shows it ." in r.text for r in got)

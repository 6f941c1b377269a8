"""Hot keys: 200,000 copies of one text among others, and what the tasks of every shuffle read."""

import json
import os
import subprocess
import sys
from collections import defaultdict

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Two sentences of enough words for a span, a signature and a fingerprint.
SCRIPT = """
import sys
from pyspark.sql import SparkSession
name, events, shared = sys.argv[1:]
conf = {"spark.master": "local[4]", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "false", "spark.ui.enabled": "false", "spark.eventLog.enabled": "true", "spark.eventLog.dir": events,
        "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false", "spark.checkpoint.dir": shared, "spark.driver.memory": "2g", "spark.sql.autoBroadcastJoinThreshold": "-1"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
words = "river stone weather through little morning house which where should garden under window after before never always"
hot = f"The {words}. Then {words}, again and again. And {words} at last."
own = "concat('Text ', md5(string(id)), ' of ', md5(string(id + 1)), ' is ', md5(string(id * 7)), ' and ', md5(string(-id)), '.')"
docs = spark.range(0, 300_000, 1, 8).selectExpr("id AS doc_id", f"CASE WHEN id % 3 < 2 THEN '{hot}' ELSE {own} END AS text", "'s' AS source")
from promptgrid.llm import exact_dedup, fingerprints, near_dedup, substring_dedup
exact_dedup.SHARD_KEYS = 500  # else three shards share eight tasks
found = {"op2": near_dedup.near_duplicates, "op6": exact_dedup.duplicates, "op8": fingerprints.similar, "op10": substring_dedup.cut_documents}[name](docs)
found.write.format("noop").mode("overwrite").save()
spark.stop()
"""


@pytest.mark.parametrize("name", ["op2", "op6", "op8", "op10"])
def test_no_task_reads_a_hot_text(tmp_path, name):
    for d in ("events", "shared"):
        (tmp_path / d).mkdir()
    done = subprocess.run([sys.executable, "-c", SCRIPT, name, f"file://{tmp_path}/events", str(tmp_path / "shared")], env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    read = defaultdict(list)
    for line in open(next((tmp_path / "events").iterdir())):
        event = json.loads(line)
        if event["Event"] == "SparkListenerTaskEnd":
            read[event["Stage ID"]].append(event["Task Metrics"]["Shuffle Read Metrics"]["Total Records Read"])
    large = {k: v for k, v in read.items() if sum(v) > 100_000}
    assert all(max(v) <= 2 * sum(v) / len(v) for v in large.values()), large
    assert large

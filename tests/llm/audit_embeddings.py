"""Links found against brute force for all vectors: python tests/llm/audit_embeddings.py FOLDER."""

import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def main() -> None:
    from pyspark.sql import SparkSession

    from millrace.llm import embeddings

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "12").config("spark.driver.memory", "6g").config("spark.checkpoint.dir", tempfile.mkdtemp()).config("spark.log.level", "ERROR").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    table = spark.read.parquet(f"{sys.argv[1]}/embeddings.parquet")
    began = time.time()
    found = embeddings.op5_embedding_dedup(spark, sys.argv[1]).cache()
    print("rows", found.count(), "links", found.agg({"n_links": "sum"}).first()[0], "classes", found.select("component_id").distinct().count(), "seconds", round(time.time() - began, 1))
    print("brute force", embeddings.audit(table, found, step=1).first(), "by fiftieths", embeddings.audit(table, found).first())


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    main()

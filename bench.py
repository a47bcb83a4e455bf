"""Time the headline queries; print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores;
BENCH_QUERIES (comma separated) chooses other queries, ``all`` for every registered one.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.plans.queries import QUERIES  # noqa: E402
from tidemark.session import configure  # noqa: E402

HEADLINE = [
    "treemap",
    "treemap_category_cutoff",
    "heatmap_all",
    "heatmap_label",
    "label_metrics",
    "signals",
    "classification_count",
    "label_delta",
    "quadrant",
    "profile_delta",
    "plot_points",
    "scatter3d",
    "search_labels_all",
    "search_title_cutoff",
    "article_rate_day",
    "article_rate_month",
    "recent_articles",
    "unprocessed_batch",
    "uptime_sessions",
    "uptime_segments_day",
    "uptime_total",
    "filter_regex",
    "filter_per_source",
    "html_clean",
    "uuid5_links",
    "feed_articles",
    "json_articles",
    "webhook_articles",
    "label_score_parse",
    "insert_if_absent",
    "source_sync",
    "flatten_metrics",
    "topn_sentinel",
    "classify_lexical",
    "classify_scorer",
    "classify_replies",
    "render_view",
    "stream_ingest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Plans are built over and over here; do not record where each column was written.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    # Start the session's machinery before the clock does.
    QUERIES["classification_count"](spark, folder).collect()

    timings = {}
    for name in names:
        began = time.perf_counter()
        # Every row and column is produced; none is brought to the driver.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

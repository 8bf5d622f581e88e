"""Time the headline jobs and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of cores.  Builds are timed on their
own; the queries that follow read the tables the builds wrote, as they would in use.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from quern.operators import audit, harvest, normalize, phrases, records, retrieve, tfidf  # noqa: E402
from quern.plans.checks import lines, normal, pages, search, steps, suggest  # noqa: E402
from quern.plans.checks import records as record_checks  # noqa: E402
from quern.plans.tables import table  # noqa: E402
from quern.session import build_session  # noqa: E402


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def jobs(spark: SparkSession, sf: str) -> dict[str, Callable[[], object]]:
    built: dict[str, object] = {}

    def build_text_index():
        built["index"] = tfidf.build_index(table(spark, sf, "documents"), "doc_id", "text")

    def build_stemmed_index():
        built["stemmed"] = normal.stemmed_index(spark, sf)

    def build_phrase_index():
        built["phrases"] = phrases.build_phrase_index(suggest.documents(spark, sf))

    return {
        "index_build": build_text_index,
        "index_build_stemmed": build_stemmed_index,
        "search_one": lambda: run(retrieve.search(built["index"], search.QUERY, 10)),
        "search_batch": lambda: run(retrieve.search(built["index"], search.benchmark(spark, sf), 5, "item_id", "text")),
        "search_filtered": lambda: run(
            retrieve.filtered_search(built["index"], search.QUERY, search.document_catalog(spark, sf), search.FILTERS)
        ),
        "search_stemmed": lambda: run(retrieve.search(built["stemmed"], search.QUERY, 20)),
        "similar_one": lambda: run(retrieve.similar(built["index"], search.SOURCE_DOC, 5)),
        "top_terms_all": lambda: run(retrieve.top_terms(built["index"], 5)),
        "phrase_index_build": build_phrase_index,
        "suggest_one": lambda: run(phrases.suggest(built["phrases"], "red wid")),
        "suggest_batch": lambda: run(phrases.suggest(built["phrases"], suggest.queries(spark, sf), 15, "query", "query")),
        "normalise_records": lambda: run(
            normalize.normalise_records(normal.documents(spark, sf), "lines", "lines", normal.lexicon(spark, sf), "doc_id")
        ),
        "parse_lines": lambda: run(lines.parsed(spark, sf)),
        "process_steps": lambda: run(records.process_instructions(steps.recipes(spark, sf))),
        "harvest_extract": lambda: run(harvest.extract_recipes(harvest.harvest(pages.built(spark, sf)), "page_id")),
        "structure_records": lambda: run(records.keep_first(records.structure_records(record_checks.documents(spark, sf)))),
        "audit": lambda: run(audit.with_errors(record_checks.rows(spark, sf))),
    }


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "quern-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Untimed: start the workers and let the JVM compile what every job shares.
    retrieve.search(tfidf.build_index(table(spark, sf, "benchmark"), "item_id", "text"), search.QUERY).collect()
    spent: dict[str, float] = {}
    for name, job in jobs(spark, sf).items():
        start = time.perf_counter()
        job()
        spent[name] = round(time.perf_counter() - start, 3)
        print(name, spent[name], file=sys.stderr, flush=True)
    n_docs = table(spark, sf, "documents").count()
    batches = {"search_batch": table(spark, sf, "benchmark").count(), "suggest_batch": suggest.queries(spark, sf).count()}
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent,
        "sf": sf.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus),
        "batch_sizes": batches, "index_documents_per_sec": round(n_docs / spent["index_build"], 1),
    }))


if __name__ == "__main__":
    main()

"""Headline queries, timed: one JSON line.

The session and its code paths are warmed on the smallest tables first. Searches run on a stored index; each is timed
three times, and the median counts. `build_index` writes the index and its statistics, `build_all_tables` also what
the other two scorers look at.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import tempfile
import time
from pathlib import Path

os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import functions as F  # noqa: E402

from tessera.collection import Collection, load, save  # noqa: E402
from tessera.queries import documents, parts, table  # noqa: E402
from tessera.search import search  # noqa: E402
from tessera.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
SMALL = f"{Path(SF_DIR).parent}/sf0.001"
CPUS = os.environ.get("BENCH_CPUS", "8")
ROUNDS = 3

TERM = "the wh"
SEARCHES = {
    "prefix_page": {"term": TERM},
    "word_page": {"term": "than with", "exact": True},
    "typo_page": {"term": "thand", "tolerance": 1},
    "filtered_page": {"term": TERM, "where": {"n_chars": {"gte": 2000}}},
    "long_text_complex_filter": {"term": "the than with inging for tion of and that", "where": {"n_chars": {"gte": 1000}, "lang": {"in": ["en", "fr"]}}},
    "threshold_half": {"term": "inging than wher", "threshold": 0.5},
}


def hits(collection: Collection, params: dict) -> list:
    return search(collection, params).hits.collect()


def actions(spark, sf_dir: str, work: str) -> dict:
    """name -> action; those that write run once."""
    built = f"{work}/index"
    docs = load(spark, built)
    scorers = {s: load(spark, built, scorer=s) for s in ("pt15", "qps")}
    products = parts(spark, sf_dir)
    changed = table(spark, sf_dir, "documents").where("doc_id % 10 = 0")
    found = {name: lambda p=p: hits(docs, p) for name, p in SEARCHES.items()}
    found["facets"] = lambda: search(docs, {"term": TERM, "facets": {"lang": {}, "source": {}}}).facets["source"].collect()
    found |= {f"{name}_page": lambda c=c: hits(c, {"term": TERM}) for name, c in scorers.items()}
    found["sorted_page"] = lambda: hits(products, {"sortBy": {"property": "p_retailprice", "order": "DESC"}})
    found["grouped"] = lambda: search(products, {"sortBy": {"property": "p_retailprice"}, "groupBy": {"properties": ["p_brand"], "maxResult": 3}}).groups.collect()
    found["upsert"] = lambda: documents(spark, sf_dir).upsert_dataframe(changed, "doc_id", "doc_id").docs.agg(F.count("*"), F.sum("n_chars")).collect()
    return found


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, partitions=int(CPUS) if CPUS.isdigit() else 8)
    work = tempfile.mkdtemp(prefix="tessera-bench-")
    times: dict[str, float] = {}
    try:
        save(documents(spark, SMALL), f"{work}/warm/index", ("sentences", "placed"))
        for action in actions(spark, SMALL, f"{work}/warm").values():
            action()
        docs = documents(spark, SF_DIR)
        rows = docs.docs.count()
        times["build_index"] = round(timed(lambda: save(docs, f"{work}/full/index")), 3)
        times["build_all_tables"] = round(timed(lambda: save(docs, f"{work}/full/index", ("sentences", "placed"))), 3)
        for name, action in actions(spark, SF_DIR, f"{work}/full").items():
            times[name] = round(statistics.median(timed(action) for _ in range(ROUNDS)), 3)
    finally:
        shutil.rmtree(work, ignore_errors=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": SF_DIR.rpartition("sf")[2], "rows": rows, "index_rows_per_sec": round(rows / times["build_index"])}))


if __name__ == "__main__":
    main()

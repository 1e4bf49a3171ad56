"""Search behind injected searchers: spaced calls, failures as rows, and results given to the pages that asked."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutflow.functions import urls
from scoutflow.operators.topk import top_per_group

# Opens a provider's search for one task: query to results with ``title, url, snippet``.
Searcher = Callable[[], Callable[[str], list[dict]]]
RESULT = "query string, provider string, rank int, title string, url string, snippet string, error string"
# Fixed value: seconds between two calls of one provider.
SPACING = 1.1


def searched(
    queries: DataFrame, searchers: dict[str, Searcher], most: int = 5, spacing: float = SPACING, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep
) -> DataFrame:
    """``query, provider, rank, title, url, snippet, error`` for ``queries`` (``query, provider``), each asked once.

    All queries of a provider are asked by one task, in order, at least ``spacing`` seconds apart. A query that fails is one row with its error and the next ones go on; a provider without a searcher
    gives such a row for each of its queries.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened: dict[str, Callable[[str], list[dict]]] = {}
        last: dict[str, float] = {}
        for batch in batches:
            out = []
            for query, provider in zip(batch["query"], batch["provider"]):
                try:
                    if provider not in opened:
                        if provider not in searchers:
                            raise LookupError(f"no searcher for {provider}")
                        opened[provider] = searchers[provider]()
                    if provider in last and (wait := last[provider] + spacing - clock()) > 0:
                        sleep(wait)
                    last[provider] = clock()
                    found = opened[provider](query)[:most]
                    out += [(query, provider, i, r.get("title", ""), r.get("url", ""), r.get("snippet", ""), None) for i, r in enumerate(found, 1)]
                except Exception as e:  # one query's failure is a row
                    out.append((query, provider, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"rank": "Int32"})

    once = queries.select("query", "provider").distinct()
    return once.repartition("provider").sortWithinPartitions("provider", "query").mapInPandas(ask, RESULT)


def results_of_parents(results: DataFrame, asked: DataFrame, seen: DataFrame, most_pages: int, official_only: bool = True, blocked: Sequence[str] = ()) -> DataFrame:
    """``parent, url, ord`` of the pages to read for each parent: results joined to who asked by the query's text.

    ``asked`` has ``parent, query, ord`` (the query's place among its parent's); ``seen`` has ``parent, url``. A URL counts once a parent, at its first place; what a parent has seen, what can't be
    fetched and, with ``official_only``, what is not on its own domain is left out, and ``most_pages`` a parent stay.
    """
    rows = results.filter("error is null").join(asked, "query").withColumn("link", urls.follow_up_url(F.col("url")))
    rows = rows.filter((F.trim("url") != "") & urls.fetchable(F.col("link"), blocked))
    if official_only:
        rows = rows.filter(urls.same_domain(F.col("parent"), F.col("link")))
    first = rows.groupBy("parent", "link").agg(F.min(F.struct("ord", "rank")).alias("at"))
    new = first.join(seen.select("parent", urls.follow_up_url(F.col("url")).alias("link")), ["parent", "link"], "left_anti")
    return top_per_group(new.select("parent", F.col("link").alias("url"), "at"), ["parent"], [F.asc("at"), F.asc("url")], most_pages).select("parent", "url", F.col("rank").alias("ord"))

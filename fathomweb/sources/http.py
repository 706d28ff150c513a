"""A live HTTP source, for networks that have one. Stored pages are the default source; see operators.fetching."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: What a request says about itself.
ACCEPT = "text/html,application/xhtml+xml,application/xml;q=0.95,text/*;q=0.9,*/*;q=0.8"


def fetch(requests: DataFrame, user_agent: str, timeout: float = 2.0) -> DataFrame:
    """(url, status, body, error) of requests (url). A status other than 2xx is a result, not an error. Store the result before use: a retried task fetches again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch.url:
                try:
                    with urllib.request.urlopen(urllib.request.Request(url, headers={"From": user_agent, "Accept": ACCEPT}), timeout=timeout) as r:
                        rows.append((url, r.status, r.read().decode("utf-8", "replace"), None))
                except urllib.error.HTTPError as e:
                    rows.append((url, e.code, e.read().decode("utf-8", "replace"), None))
                except (OSError, ValueError) as e:
                    rows.append((url, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["url", "status", "body", "error"])

    return requests.select("url").mapInPandas(run, "url string, status int, body string, error string")

"""robots.txt as a table: which URLs an agent may fetch."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .pages import url_parts


def allowed_by_robots(pages: DataFrame, robots: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """pages with `allowed`: the agent or the general entry * may fetch the URL.

    robots: (site, text), site being scheme://host. A file is parsed once for each run of pages of its site in a batch.
    """
    agents = (agent, "*")

    @F.pandas_udf(BooleanType())
    def check(urls: pd.Series, texts: pd.Series) -> pd.Series:
        parsers: dict[str, RobotFileParser] = {}
        out = []
        for u, t in zip(urls, texts, strict=True):
            if t and t not in parsers:
                parsers[t] = RobotFileParser()
                parsers[t].parse(t.splitlines())
            out.append(not t or any(parsers[t].can_fetch(a, u or "") for a in agents))
        return pd.Series(out)

    scheme, host, _ = url_parts(F.col(url))
    met = pages.withColumn("__site", F.concat(scheme, F.lit("://"), host)).join(robots.select(F.col("site").alias("__site"), F.col("text").alias("__text")), "__site", "left")
    return met.withColumn("allowed", check(F.col(url), F.col("__text"))).select(*pages.columns, "allowed")

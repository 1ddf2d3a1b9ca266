"""All queries and oracles by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeworks.plans import (
    job_queries,
    large_queries,
    market,
    model_queries,
    panel_oracle,
    panel_queries,
    signal_oracle,
    signal_queries,
    store_queries,
)


# The same query planned for groups of any size: one oracle for both.
SAME_ROWS = {
    **large_queries.SAME_ROWS,
    "q71_pct_rank_large": "q10_pct_rank", "q72_winsor_fill_large": "q11_winsor_fill",
    "q73_multi_horizon_large": "q15_multi_horizon", "q74_hit_rate_large": "q19_hit_rate",
    "q75_equal_book_large": "q20_equal_book", "q76_snapshot_features_large": "q55_snapshot_features",
}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Period panel with ranks, median labels and benchmark; monthly steps suit short series."""
    rows, _ = market.ranked(spark, sf, forward=21, rebalance=21)
    return panel_queries.six(rows.withColumn("model_score", market.mean_rank()))


def queries() -> dict:
    return dict(sorted({**panel_queries.QUERIES, **signal_queries.QUERIES, **model_queries.QUERIES, **job_queries.QUERIES,
                        **large_queries.QUERIES, **store_queries.QUERIES}.items()))


def oracle_sql() -> dict:
    sql = {**panel_oracle.SQL, **signal_oracle.SQL, **model_queries.SQL, **job_queries.SQL, **large_queries.SQL, **store_queries.SQL}
    return {**sql, **{large: sql[plain] for large, plain in SAME_ROWS.items()}}

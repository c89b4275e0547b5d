"""All queries over the match tables, by name, with the SQL that says what each returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchlake.operators import accuracy, bets, calibration, documents, entities, feeds, filters, form, listings, momentum, names, odds, pages, picks, players, predicted, reports, staking, tennis, texts, views
from matchlake.sources import derived
from matchlake.streaming import status

#: name -> (query over the derived tables, SQL with <matches>, <predictions> and <bets> for them)
FAMILIES = (accuracy.QUERIES, bets.QUERIES, calibration.QUERIES, documents.QUERIES, entities.QUERIES, feeds.QUERIES, filters.QUERIES, form.QUERIES, listings.QUERIES, momentum.QUERIES, names.QUERIES, odds.QUERIES, pages.QUERIES, picks.QUERIES, players.QUERIES, predicted.QUERIES, reports.QUERIES, staking.QUERIES, status.QUERIES, tennis.QUERIES, texts.QUERIES, views.QUERIES)


def _query(build: Callable[[derived.Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(derived.Tables(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(build) for family in FAMILIES for name, (build, _) in family.items()}
ORACLE_SQL: dict[str, str] = {name: derived.filled(sql) for family in FAMILIES for name, (_, sql) in family.items() if sql}
FLAGSHIP = "source_accuracy"

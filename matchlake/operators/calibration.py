"""How far each source can be trusted: coverage, accuracy, and weights drawn from them; thresholds swept over the advice's confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights lie between these; a source with no more than ENOUGH settled predictions keeps its default.
LOWEST, HIGHEST, ENOUGH = 0.5, 2.0, 10
# The sources' default weights.
DEFAULTS = {"h2h": 1.0, "tips": 1.2, "fans": 1.0, "advice": 1.5, "consensus": 2.0}


def coverage(predictions: DataFrame) -> DataFrame:
    """(source, total, correct): settled predictions that a source speaks about, and right ones. Advice is right only if it is strong."""
    actual, home, away = F.col("actual_result"), F.col("fan_home_win_prob"), F.col("fan_away_win_prob")
    of = lambda name, speaks, right: F.struct(F.lit(name).alias("source"), speaks.alias("speaks"), (speaks & F.coalesce(right, F.lit(False))).alias("right"))
    each = F.explode(
        F.array(
            of("h2h", F.col("h2h_win_rate").isNotNull(), F.when(F.col("h2h_win_rate") >= 60, "1").otherwise("2") == actual),
            of("tips", F.col("tip_prediction").isNotNull(), F.col("tip_prediction") == actual),
            of("fans", home.isNotNull(), F.when(home > away, "1").when(away > home, "2").otherwise("X") == actual),
            of("advice", F.col("advice_recommendation").isNotNull(), F.col("advice_recommendation").isin("HIGH", "LOCK") & (F.when(F.col("focus_team") == "away", "2").otherwise("1") == actual)),
            of("consensus", F.lit(False), F.lit(False)),
        )
    )
    got = predictions.where(actual.isNotNull()).select(each.alias("e")).select("e.*")
    return got.groupBy("source").agg(F.count(F.when(F.col("speaks"), 1)).alias("total"), F.count(F.when(F.col("right"), 1)).alias("correct"))


def weights(predictions: DataFrame) -> DataFrame:
    """coverage with accuracy, the weight of each source (its share of all squared accuracies times the number of sources, clamped),
    and the accuracy of all sources together. Without any right source all keep their defaults. The window runs over one row for each source."""
    every = Window.partitionBy()
    got = coverage(predictions).withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0))
    square = F.when(F.col("total") > ENOUGH, F.col("accuracy") * F.col("accuracy"))
    raw = square / F.nullif(F.sum(square).over(every), F.lit(0.0)) * F.count("*").over(every)
    return got.select("source", "total", "correct", "accuracy", F.round(F.when(raw.isNotNull(), F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), raw))).otherwise(F.element_at(F.create_map(*(F.lit(x) for kv in DEFAULTS.items() for x in kv)), F.col("source"))), 6).alias("weight"), (F.sum("correct").over(every) / F.sum("total").over(every)).alias("baseline"))


def sweep(predictions: DataFrame, thresholds: tuple[int, ...] = (50, 60, 70, 80, 90)) -> DataFrame:
    """Advised predictions at or above each threshold of confidence, by sport, and their share: one pass over the rows."""
    got = predictions.where(F.col("advice_confidence").isNotNull()).groupBy("sport").agg(F.count("*").alias("n"), *(F.count(F.when(F.col("advice_confidence") >= t, 1)).alias(f"t{t}") for t in thresholds))
    each = got.select("sport", "n", F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("n_pass")) for t in thresholds))).alias("e"))
    return each.select("sport", "e.threshold", "e.n_pass", (F.col("e.n_pass") / F.col("n")).alias("rate"))


def advice_counts(predictions: DataFrame) -> DataFrame:
    """Advice by recommendation: rows, share of all advised in percent, mean, largest and least confidence."""
    got = predictions.where(F.col("advice_recommendation").isNotNull()).groupBy("advice_recommendation").agg(F.count("*").alias("n"), F.avg("advice_confidence").alias("mean"), F.max("advice_confidence").alias("most"), F.min("advice_confidence").alias("least"))
    return got.withColumn("percent", F.col("n").cast("double") * 100 / F.sum("n").over(Window.partitionBy()))


_COVERAGE = """(SELECT source, COUNT(CASE WHEN speaks THEN 1 END) AS total, COUNT(CASE WHEN speaks AND hit THEN 1 END) AS correct FROM (SELECT source,
 CASE source WHEN 'h2h' THEN h2h_win_rate IS NOT NULL WHEN 'tips' THEN tip_prediction IS NOT NULL WHEN 'fans' THEN fan_home_win_prob IS NOT NULL WHEN 'advice' THEN advice_recommendation IS NOT NULL ELSE FALSE END AS speaks,
 CASE source WHEN 'h2h' THEN CASE WHEN h2h_win_rate >= 60 THEN '1' ELSE '2' END WHEN 'tips' THEN tip_prediction
  WHEN 'fans' THEN CASE WHEN fan_home_win_prob > fan_away_win_prob THEN '1' WHEN fan_away_win_prob > fan_home_win_prob THEN '2' ELSE 'X' END
  WHEN 'advice' THEN CASE WHEN advice_recommendation IN ('HIGH', 'LOCK') THEN CASE WHEN focus_team = 'away' THEN '2' ELSE '1' END END END = actual_result AS hit
 FROM <predictions> p CROSS JOIN (VALUES ('h2h'), ('tips'), ('fans'), ('advice'), ('consensus')) AS s(source) WHERE actual_result IS NOT NULL) x GROUP BY source)"""
#: What a recommendation is worth; another counts 50.
ADVICE = {"LOCK": 95, "HIGH": 80, "MEDIUM": 60, "LOW": 40, "AVOID": 20}


def agreement(focus: Column | None = None) -> Column:
    """How many of the four sources agree with the focus side."""
    focus = F.coalesce("focus_team", F.lit("home")) if focus is None else focus
    home, away = F.coalesce("fan_home_win_prob", F.lit(0)), F.coalesce("fan_away_win_prob", F.lit(0))
    votes = (F.col("h2h_win_rate") >= 60, F.col("tip_prediction") == F.when(focus == "home", "1").otherwise("2"), ((focus == "home") & (home > away)) | ((focus == "away") & (away > home)), F.col("advice_recommendation").isin("HIGH", "LOCK"))
    return sum((F.coalesce(v, F.lit(False)).cast("int") for v in votes), F.lit(0))


def confidence(predictions: DataFrame, weights_of: dict[str, float] = DEFAULTS) -> DataFrame:
    """(id, agreement, confidence): the weighted mean of the rate of past meetings (50 where unknown), the tip, the margin of the fans'
    votes, the advice and the agreement, of those that say something, from 0 to 100."""
    rate, tip = F.coalesce("h2h_win_rate", F.lit(50)), F.coalesce("tip_probability", F.lit(0))
    margin = F.abs(F.coalesce("fan_home_win_prob", F.lit(0)) - F.coalesce("fan_away_win_prob", F.lit(0)))
    advice = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ADVICE.items() for x in kv)), F.col("advice_recommendation")), F.lit(50))
    parts = ((F.lit(True), rate * weights_of["h2h"], 1.0), (tip > 0, tip * weights_of["tips"], 1.0), (margin > 0, F.least(margin * 2, F.lit(100)) * weights_of["fans"], 0.8), (F.col("advice_recommendation").isNotNull(), advice * weights_of["advice"], 1.2), (F.lit(True), agreement() * 25 * weights_of["consensus"], 1.5))
    score = sum((F.when(on, x * w).otherwise(0.0) for on, x, w in parts), F.lit(0.0)) / sum((F.when(on, w).otherwise(0.0) for on, _, w in parts), F.lit(0.0))
    return predictions.select("id", agreement().alias("agreement"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 1).alias("confidence"))


QUERIES = {
    "source_weights": (
        lambda t: weights(t.predictions),
        f"""SELECT source, total, correct, accuracy, ROUND(COALESCE(CASE WHEN total > 10 THEN GREATEST(0.5, LEAST(2.0, accuracy * accuracy / SUM(CASE WHEN total > 10 THEN accuracy * accuracy END) OVER () * COUNT(*) OVER ())) END, CASE source WHEN 'tips' THEN 1.2 WHEN 'advice' THEN 1.5 WHEN 'consensus' THEN 2.0 ELSE 1.0 END), 6) AS weight,
 CAST(SUM(correct) OVER () AS DOUBLE) / SUM(total) OVER () AS baseline FROM (SELECT *, CASE WHEN total > 0 THEN CAST(correct AS DOUBLE) / total ELSE 0.0 END AS accuracy FROM {_COVERAGE} c) d""",
    ),
    "confidence_scores": (
        lambda t: confidence(t.predictions).select("id", "agreement", (F.floor(F.col("confidence") / 5) * 5).cast("int").alias("band")),
        """SELECT id, CAST(agreement AS INTEGER) AS agreement, CAST(FLOOR(ROUND(GREATEST(0.0, LEAST(100.0, total / weight)), 1) / 5) * 5 AS INTEGER) AS band FROM (SELECT id, agreement,
 CAST(rate AS DOUBLE) + CASE WHEN tip > 0 THEN tip * CAST(1.2 AS DOUBLE) ELSE 0 END + CASE WHEN margin > 0 THEN LEAST(margin * 2, 100) * CAST(0.8 AS DOUBLE) ELSE 0 END + CASE WHEN advice IS NOT NULL THEN advice * CAST(1.5 AS DOUBLE) * CAST(1.2 AS DOUBLE) ELSE 0 END + agreement * 25 * CAST(2.0 AS DOUBLE) * CAST(1.5 AS DOUBLE) AS total,
 CAST(1.0 AS DOUBLE) + CASE WHEN tip > 0 THEN CAST(1.0 AS DOUBLE) ELSE 0 END + CASE WHEN margin > 0 THEN CAST(0.8 AS DOUBLE) ELSE 0 END + CASE WHEN advice IS NOT NULL THEN CAST(1.2 AS DOUBLE) ELSE 0 END + CAST(1.5 AS DOUBLE) AS weight FROM (
 SELECT id, COALESCE(h2h_win_rate, 50) AS rate, COALESCE(tip_probability, 0) AS tip, ABS(COALESCE(fan_home_win_prob, 0) - COALESCE(fan_away_win_prob, 0)) AS margin,
 CASE advice_recommendation WHEN 'LOCK' THEN 95 WHEN 'HIGH' THEN 80 WHEN 'MEDIUM' THEN 60 WHEN 'LOW' THEN 40 WHEN 'AVOID' THEN 20 ELSE CASE WHEN advice_recommendation IS NOT NULL THEN 50 END END AS advice,
 CASE WHEN h2h_win_rate >= 60 THEN 1 ELSE 0 END + CASE WHEN tip_prediction = CASE WHEN focus_team = 'home' THEN '1' ELSE '2' END THEN 1 ELSE 0 END + CASE WHEN advice_recommendation IN ('HIGH', 'LOCK') THEN 1 ELSE 0 END
 + CASE WHEN (focus_team = 'home' AND COALESCE(fan_home_win_prob, 0) > COALESCE(fan_away_win_prob, 0)) OR (focus_team = 'away' AND COALESCE(fan_away_win_prob, 0) > COALESCE(fan_home_win_prob, 0)) THEN 1 ELSE 0 END AS agreement FROM <predictions> p) a) b""",
    ),
    "threshold_sweep": (
        lambda t: sweep(t.predictions),
        """SELECT sport, CAST(threshold AS INTEGER) AS threshold, COUNT(CASE WHEN advice_confidence >= threshold THEN 1 END) AS n_pass, CAST(COUNT(CASE WHEN advice_confidence >= threshold THEN 1 END) AS DOUBLE) / COUNT(*) AS rate
 FROM <predictions> p CROSS JOIN (VALUES (50), (60), (70), (80), (90)) AS s(threshold) WHERE advice_confidence IS NOT NULL GROUP BY sport, threshold""",
    ),
    "advice_counts": (
        lambda t: advice_counts(t.predictions),
        """SELECT advice_recommendation, n, mean, most, least, CAST(n AS DOUBLE) * 100 / SUM(n) OVER () AS percent FROM (SELECT advice_recommendation, COUNT(*) AS n, AVG(advice_confidence) AS mean,
 MAX(advice_confidence) AS most, MIN(advice_confidence) AS least FROM <predictions> p WHERE advice_recommendation IS NOT NULL GROUP BY advice_recommendation) x""",
    ),
}

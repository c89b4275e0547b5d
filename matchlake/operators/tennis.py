"""Scores of tennis matches from what was known before them: an older model of four factors, and a newer one that weighs recency,
quality of wins, fatigue, surface and tournament. Positive scores favour the first player.

Histories are arrays with the newest entry last, as windows over each player's and each pair's earlier matches leave them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SURFACES = ("clay", "grass", "hard")
#: Tournament names of the derived matches, by h % 8.
TOURNAMENTS = ("Wimbledon", "Rome Masters", "ATP 500 Dubai", "Challenger Lyon", "", "Open Munich", "US Open", "Shanghai")
# Words that tell a tournament's tier, and the weights of tiers.
GRAND_SLAM = ("wimbledon", "us open", "roland garros", "australian open", "french open", "open usa", "open australii")
MASTERS = ("indian wells", "miami", "monte carlo", "madrid", "rome", "canada", "montreal", "toronto", "cincinnati", "shanghai", "paris", "masters")
WEIGHTS = {"grand_slam": 1.5, "masters_1000": 1.3, "atp_500": 1.1, "atp_250": 1.0, "challenger": 0.8, "unknown": 1.0}


def tier(tournament: Column) -> Column:
    """A tournament's tier by its name; an empty or missing name: unknown."""
    low = F.lower(tournament)
    has = lambda words: low.rlike("|".join(words))
    return F.when(F.coalesce(tournament, F.lit("")) == "", "unknown").when(has(GRAND_SLAM), "grand_slam").when(has(MASTERS), "masters_1000").when(has(("atp 500", "atp500")), "atp_500").when(low.contains("challenger"), "challenger").otherwise("atp_250")


def histories(matches: DataFrame) -> DataFrame:
    """Of each finished tennis match: both players, surface, tournament, and before it their last five meetings, each player's last ten
    matches, and each one's record on the surface. Ranks follow from the length of a name."""
    h, home, away = F.col("h"), F.col("home_team"), F.col("away_team")
    named = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (h % n + 1).cast("int"))
    score = F.concat_ws("-", F.greatest("home_score", "away_score").cast("string"), F.least("home_score", "away_score").cast("string"))
    winner = F.when(F.col("actual_result") == "1", home).when(F.col("actual_result") == "2", away)
    played = matches.where((F.col("sport") == "tennis") & F.col("actual_result").isNotNull())
    played = played.select("match_id", "match_date", home.alias("player_a"), away.alias("player_b"), winner.alias("winner"), score.alias("score"), named(SURFACES, 3).alias("surface"), named(TOURNAMENTS, 8).alias("tournament"))
    before = lambda keys, n: Window.partitionBy(*keys).orderBy("match_date", "match_id").rowsBetween(n, -1)
    pair = [F.least("player_a", "player_b"), F.greatest("player_a", "player_b")]
    met = played.withColumn("h2h", F.collect_list(F.struct("winner", F.col("match_date").alias("date"), "score")).over(before(pair, -5)))
    rank = lambda name: 1 + (F.length(name) * 37) % 150
    side = lambda s, own, other: F.struct(F.lit(s).alias("side"), F.col(own).alias("player"), F.when(F.col("winner") == F.col(own), "W").when(F.col("winner") == F.col(other), "L").otherwise("D").alias("result"), rank(F.col(other)).alias("opponent_rank"), rank(F.col(own)).alias("own_rank"))
    sides = played.select("match_id", "match_date", "surface", "score", F.explode(F.array(side("a", "player_a", "player_b"), side("b", "player_b", "player_a"))).alias("s")).select("match_id", "match_date", "surface", "score", "s.*")
    won = (F.col("result") == "W").cast("int")
    on_surface = before(["player", "surface"], Window.unboundedPreceding)
    sides = sides.select(
        "match_id", "side", F.col("own_rank").alias("rank"),
        F.collect_list(F.struct("result", F.col("match_date").alias("date"), "opponent_rank", "score", "surface")).over(before(["player"], -10)).alias("form"),
        F.struct(F.count("*").over(on_surface).alias("total"), F.coalesce(F.sum(won).over(on_surface), F.lit(0)).alias("wins"), F.collect_list("result").over(before(["player", "surface"], -5)).alias("recent")).alias("stats"),
    )
    of = lambda s: sides.where(F.col("side") == s).select("match_id", *(F.col(c).alias(f"{c}_{s}") for c in ("rank", "form", "stats")))
    return met.join(of("a"), "match_id").join(of("b"), "match_id")


def capped(points: Column, most: float) -> Column:
    return F.when(points.isNotNull(), F.greatest(F.lit(-most), F.least(F.lit(most), points)))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; null where whole is 0."""
    return F.when(whole != 0, part.cast("double") / whole)


def count(array: Column, test) -> Column:
    return F.size(F.filter(array, test))


def favourite(total: Column) -> Column:
    return F.when(total < 0, "player_b").when(total > 0, "player_a").otherwise("even")


def older(t: DataFrame) -> DataFrame:
    """t(wins_a, wins_b, meetings, rank_a, rank_b, results_a, results_b, rate_a, rate_b) with the older model's scores. Results are
    arrays of W, L and D; ranks, results and rates that are missing or empty give no points."""
    a, b = F.col("wins_a"), F.col("wins_b")
    lead = a - b
    h2h = F.when((F.col("meetings") == 0) | (lead == 0), 0.0).otherwise(capped(lead * 10.0 + F.when((lead > 0) & (a * 4 >= F.col("meetings") * 3), 10.0).when((lead < 0) & (b * 4 >= F.col("meetings") * 3), -10.0).otherwise(0.0), 50.0))
    gap = F.col("rank_b") - F.col("rank_a")
    ranking = F.coalesce(capped(gap * 0.5 + F.when((F.col("rank_a") <= 10) & (F.col("rank_b") > 50), 5.0).when((F.col("rank_b") <= 10) & (F.col("rank_a") > 50), -5.0).otherwise(0.0), 25.0), F.lit(0.0))
    wins = lambda c: count(F.col(c), lambda r: r == "W")
    run = lambda c: (F.size(c) >= 3) & F.forall(F.slice(F.col(c), F.greatest(F.size(c) - 2, F.lit(1)), F.lit(3)), lambda r: r == "W")
    ahead = wins("results_a") - wins("results_b")
    form = F.when((F.size("results_a") > 0) & (F.size("results_b") > 0), capped(ahead * 3.0 + F.when((ahead > 0) & run("results_a"), 3.0).when((ahead < 0) & run("results_b"), -3.0).otherwise(0.0), 15.0)).otherwise(0.0)
    edge = F.col("rate_a") - F.col("rate_b")
    surface = F.coalesce(F.when(F.abs(edge) >= 0.01, capped(edge * 50 + F.when((edge > 0) & (F.col("rate_a") >= 0.8) & (edge >= 0.1), 5.0).when((edge < 0) & (F.col("rate_b") >= 0.8) & (edge <= -0.1), -5.0).otherwise(0.0), 10.0)), F.lit(0.0))
    got = t.withColumns({"h2h_score": h2h, "ranking_score": ranking, "form_score": form, "surface_score": surface})
    total = F.col("h2h_score") + F.col("ranking_score") + F.col("form_score") + F.col("surface_score")
    return got.withColumns({"total_score": total, "qualifies": F.abs(total) >= 50, "favourite": favourite(total)})


def older_of(t: DataFrame) -> DataFrame:
    """The older model over histories: the last five results of each player."""
    wins = lambda p: count(F.col("h2h"), lambda m: m["winner"] == F.col(p))
    last = lambda s: F.transform(F.slice(F.col(f"form_{s}"), F.greatest(F.size(f"form_{s}") - 4, F.lit(1)), F.lit(5)), lambda m: m["result"])
    rate = lambda s: ratio(F.col(f"stats_{s}.wins"), F.col(f"stats_{s}.total"))
    return older(t.withColumns({"wins_a": wins("player_a"), "wins_b": wins("player_b"), "meetings": F.size("h2h"), "results_a": last("a"), "results_b": last("b"), "rate_a": rate("a"), "rate_b": rate("b")}))


def meetings_score(h2h: Column, a: Column, as_of: Column) -> Column:
    """8 points for each won meeting, more for recent ones; bonuses for winning all of three or more, and for easy wins. Meetings
    without a winner don't count. Shares of easy wins are in tenths, so ties don't depend on rounding."""
    decided = F.filter(h2h, lambda m: m["winner"].isNotNull())
    sign = lambda m: F.when(m["winner"] == a, 1.0).otherwise(-1.0)
    days = lambda m: F.date_diff(as_of, m["date"])
    points = F.aggregate(decided, F.lit(0.0), lambda s, m: s + sign(m) * 8.0 * F.when(days(m) <= 180, 2.0).when(days(m) <= 365, 1.5).when(days(m) > 730, 0.5).otherwise(1.0))
    n, wins = F.size(decided), count(decided, lambda m: m["winner"] == a)
    easy = lambda m: F.when(m["score"].rlike("[23]-0"), 10).when(m["score"].rlike("[23]-1"), 6).when(m["score"].contains("3-2"), 5).otherwise(7)
    ease = ratio(F.aggregate(decided, F.lit(0), lambda s, m: s + F.when(m["winner"] == a, easy(m)).otherwise(-easy(m))), n)
    all_won = F.when((n >= 3) & (wins == n), 10.0).when((n >= 3) & (wins == 0), -10.0).otherwise(0.0)
    quality = F.when((ease > 8) & (wins * 2 > n), 5.0).when((ease < -8) & (wins * 2 < n), -5.0).otherwise(0.0)
    return capped(points + all_won + quality, 40.0)


def last(array: Column, n: int) -> Column:
    return F.slice(array, F.greatest(F.size(array) - (n - 1), F.lit(1)), F.lit(n))


def won(m: Column) -> Column:
    return m["result"] == "W"


def fatigue(form: Column, as_of: Column) -> Column:
    """Tired after five matches in a week, busy after three, rusty after two weeks without any, fresh after one or two."""
    within = lambda days: count(form, lambda m: F.date_diff(as_of, m["date"]) <= days)
    n7, n14 = within(7), within(14)
    return F.when(n7 >= 5, -5.0).when(n7 >= 3, -2.0).when(n14 == 0, -3.0).when(n7 >= 1, 3.0).otherwise(0.0)


def mean_of_wins(form: Column, value) -> Column:
    """Mean of value(match) in tenths over won matches that have one; 5 without any."""
    values = F.filter(F.transform(F.filter(form, won), value), lambda v: v.isNotNull())
    return F.coalesce(ratio(F.aggregate(values, F.lit(0), lambda s, v: s + v), F.size(values)), F.lit(5.0))


def form_score(a: Column, b: Column, as_of: Column) -> Column:
    recent = lambda f: count(last(f, 3), won)
    run = lambda f: F.when((F.size(f) >= 5) & F.forall(last(f, 5), won), 8.0).otherwise(0.0)
    quality = lambda f: mean_of_wins(f, lambda m: F.when(m["opponent_rank"] <= 10, 10).when(m["opponent_rank"] <= 50, 8).when(m["opponent_rank"] <= 100, 6).when(m["opponent_rank"].isNotNull(), 4))
    points = (count(a, won) - count(b, won)) * 3.0 + F.when((recent(a) == 3) & (recent(b) <= 1), 5.0).when((recent(b) == 3) & (recent(a) <= 1), -5.0).otherwise(0.0) + run(a) - run(b)
    points = points + F.when(quality(a) > quality(b) + 2, 5.0).when(quality(b) > quality(a) + 2, -5.0).otherwise(0.0) + fatigue(a, as_of) - fatigue(b, as_of)
    return capped(points, 30.0)


def surface_score(surface: Column, stats_a: Column, stats_b: Column, form_a: Column, form_b: Column) -> Column:
    rate = lambda s: ratio(s["wins"], s["total"])
    recent = lambda s: ratio(count(s["recent"], lambda r: r == "W"), F.size(s["recent"]))
    edge = rate(stats_a) - rate(stats_b)
    special = F.when((rate(stats_a) >= 0.8) & (edge >= 0.15), 8.0).when((rate(stats_b) >= 0.8) & (edge <= -0.15), -8.0).otherwise(0.0)
    used = F.when((stats_a["total"] >= 10) & (stats_b["total"] < 5), 5.0).when((stats_b["total"] >= 10) & (stats_a["total"] < 5), -5.0).otherwise(0.0)

    def warm(form: Column) -> Column:
        five = last(form, 5)
        n = count(five, lambda m: F.lower(m["surface"]) == F.lower(surface))
        return F.when((n == F.size(five)) & (n == 5), 5.0).when(n >= 3, 3.0).when(n <= 1, -3.0).otherwise(0.0)

    moved = F.when((F.size(form_a) > 0) & (F.size(form_b) > 0), warm(form_a) - warm(form_b)).otherwise(0.0)
    return F.coalesce(capped(edge * 25 + special + used + F.coalesce((recent(stats_a) - recent(stats_b)) * 10, F.lit(0.0)) + moved, 20.0), F.lit(0.0))


def momentum_score(a: Column, b: Column) -> Column:
    run = lambda f: (F.size(f) >= 3) & F.forall(last(f, 3), won)
    none = lambda f: (F.size(f) == 0) | F.forall(last(f, 1), lambda m: ~won(m))
    sure = lambda f: mean_of_wins(f, lambda m: F.when(m["score"].contains("2-0"), 10).when(m["score"].contains("2-1"), 6).otherwise(8))
    return capped(F.when(run(a) & none(b), 5.0).when(run(b) & none(a), -5.0).otherwise(0.0) + F.when(sure(a) > sure(b) + 3, 5.0).when(sure(b) > sure(a) + 3, -5.0).otherwise(0.0), 10.0)


def threshold(factors: Column, with_h2h: Column) -> Column:
    """45 with all four factors; 5 less for each missing one if meetings count, else 50."""
    return F.when(factors == 4, 45.0).when(with_h2h, 45.0 - (4 - factors) * 5.0).otherwise(50.0)


def win_probability(total: Column) -> Column:
    """A sigmoid of the score, between 0.5 and 0.95."""
    return F.greatest(F.lit(0.5), F.least(F.lit(0.95), 1 / (1 + F.exp(-(F.abs(total) - 45) / 10))))


def newer(t: DataFrame) -> DataFrame:
    """histories with the newer model's scores, as of each match's own date."""
    a, b, as_of = F.col("form_a"), F.col("form_b"), F.col("match_date")
    both = (F.size(a) > 0) & (F.size(b) > 0)
    got = t.withColumns({"h2h_score": meetings_score(F.col("h2h"), F.col("player_a"), as_of), "form_score": F.when(both, form_score(a, b, as_of)).otherwise(0.0), "surface_score": F.when(both, surface_score(F.col("surface"), F.col("stats_a"), F.col("stats_b"), a, b)).otherwise(0.0), "momentum_score": F.when(both, momentum_score(a, b)).otherwise(0.0), "tier": tier(F.col("tournament"))})
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv)), F.col("tier"))
    has_h2h = F.col("h2h_score") != 0
    got = got.withColumn("total_score", (F.col("h2h_score") + F.col("form_score") + F.col("surface_score") + F.col("momentum_score")) * weight).withColumn("threshold", threshold(has_h2h.cast("int") + F.when(both, 3).otherwise(0), has_h2h))
    size = F.abs("total_score")
    sure = F.when(size >= 60, "very_high").when(size >= 50, "high").when(size >= 40, "medium").otherwise("low")
    return got.withColumns({"qualifies": size >= F.col("threshold"), "confidence": sure, "favourite": favourite(F.col("total_score")), "win_probability": win_probability(F.col("total_score"))})


def without_meetings(h2h_count: Column, rank_a: Column, rank_b: Column, score: Column) -> Column:
    """The score where two players never met: half of it, and nothing at all unless their ranks are 20 or more apart."""
    return F.when(h2h_count > 0, score).when(F.abs(rank_a - rank_b) >= 20, score * 0.5).otherwise(0.0)


def models(t: DataFrame) -> DataFrame:
    """(match_id, old_*, new_*): both models' totals, verdicts and favourites."""
    new = newer(t).select("match_id", *(F.col(c).alias(f"new_{c}") for c in ("total_score", "qualifies", "favourite")))
    return older_of(t).select("match_id", *(F.col(c).alias(f"old_{c}") for c in ("total_score", "qualifies", "favourite"))).join(new, "match_id")


def compared(t: DataFrame) -> DataFrame:
    """How the models agree: matches by bucket of either score and both verdicts, and how many have the same favourite."""
    bucket = lambda c: F.when(F.abs(c) < 20, "0-20").when(F.abs(c) < 40, "20-40").when(F.abs(c) < 60, "40-60").otherwise("60+")
    got = models(t).groupBy(bucket("old_total_score").alias("old_bucket"), bucket("new_total_score").alias("new_bucket"), "old_qualifies", "new_qualifies")
    return got.agg(F.count("*").alias("n"), F.count(F.when(F.col("old_favourite") == F.col("new_favourite"), 1)).alias("same_favourite"))


def factors_used(t: DataFrame) -> DataFrame:
    """How many matches each factor of the newer model says something about."""
    names = ("h2h_score", "form_score", "surface_score", "momentum_score")
    scores = F.create_map(*(x for n in names for x in (F.lit(n), F.col(n))))
    return newer(t).select(F.explode(scores).alias("factor", "score")).where("score <> 0").groupBy(F.regexp_replace("factor", "_score$", "").alias("factor")).agg(F.count("*").alias("n"))


def against_last_winner(t: DataFrame) -> DataFrame:
    """Matches of players who met: how often the newer model's favourite won, and how often the winner of the last meeting did."""
    got = newer(t).withColumn("last_winner", F.when(F.size("h2h") > 0, F.element_at("h2h", -1)["winner"])).where(F.col("last_winner").isNotNull() & F.col("winner").isNotNull())
    chosen = F.when(F.col("favourite") == "player_a", F.col("player_a")).when(F.col("favourite") == "player_b", F.col("player_b"))
    return got.groupBy("tier").agg(F.count("*").alias("n"), F.count(F.when(chosen == F.col("winner"), 1)).alias("favourite_right"), F.count(F.when(F.col("last_winner") == F.col("winner"), 1)).alias("last_winner_right"))


def _lags(column: str, n: int, window: str) -> str:
    return ", ".join(f"LAG({column}, {k}) OVER {window} AS {column}_{k}" for k in range(1, n + 1))


def _sum(n: int, term: str) -> str:
    return "(" + " + ".join(term.replace("#", str(k)) for k in range(1, n + 1)) + ")"


_EASE = "CASE WHEN regexp_matches(score_#, '[23]-0') THEN 10 WHEN regexp_matches(score_#, '[23]-1') THEN 6 WHEN contains(score_#, '3-2') THEN 5 ELSE 7 END"
_PLAYED = f"""played AS (SELECT match_id, match_date, home_team AS a, away_team AS b, CASE actual_result WHEN '1' THEN home_team WHEN '2' THEN away_team END AS winner,
 CAST(GREATEST(home_score, away_score) AS VARCHAR) || '-' || CAST(LEAST(home_score, away_score) AS VARCHAR) AS score, CASE h % 3 WHEN 0 THEN 'clay' WHEN 1 THEN 'grass' ELSE 'hard' END AS surface,
 CASE h % 8 {" ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(TOURNAMENTS))} END AS tournament FROM <matches> m WHERE sport = 'tennis' AND actual_result IS NOT NULL)"""
_SIDES = f"""sides AS (SELECT s.*, 1 + (length(other) * 37) % 150 AS opponent_rank, 1 + (length(player) * 37) % 150 AS rank, CASE WHEN winner = player THEN 'W' WHEN winner = other THEN 'L' ELSE 'D' END AS result
  FROM (SELECT match_id, match_date, surface, score, winner, 'a' AS side, a AS player, b AS other FROM played UNION ALL SELECT match_id, match_date, surface, score, winner, 'b', b, a FROM played) s),
 marked AS (SELECT *, CAST(result = 'W' AS INTEGER) AS won, CASE WHEN result = 'W' THEN CASE WHEN opponent_rank <= 10 THEN 10 WHEN opponent_rank <= 50 THEN 8 WHEN opponent_rank <= 100 THEN 6 ELSE 4 END END AS quality,
  CASE WHEN result = 'W' THEN CASE WHEN contains(score, '2-0') THEN 10 WHEN contains(score, '2-1') THEN 6 ELSE 8 END END AS sure FROM sides),
 lagged AS (SELECT *, {_lags("match_date", 10, "p")}, {_lags("surface", 5, "p")}, {_lags("won", 10, "p")},
  COUNT(*) OVER (p ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS n10, COALESCE(SUM(won) OVER (p ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS w10, COALESCE(SUM(won) OVER (p ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS w5, COALESCE(SUM(won) OVER (p ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS w3,
  COALESCE(CAST(SUM(quality) OVER (p ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS DOUBLE) / NULLIF(COUNT(quality) OVER (p ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0), 5.0) AS quality10,
  COALESCE(CAST(SUM(sure) OVER (p ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS DOUBLE) / NULLIF(COUNT(sure) OVER (p ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0), 5.0) AS sure10,
  COUNT(*) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS total, COALESCE(SUM(won) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wins,
  CAST(SUM(won) OVER (s ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS DOUBLE) / NULLIF(COUNT(*) OVER (s ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS recent
  FROM marked WINDOW p AS (PARTITION BY player ORDER BY match_date, match_id), s AS (PARTITION BY player, surface ORDER BY match_date, match_id)),
 known AS (SELECT *, CAST(wins AS DOUBLE) / NULLIF(total, 0) AS rate, {_sum(10, "CASE WHEN match_date - match_date_# <= 7 THEN 1 ELSE 0 END")} AS n7, {_sum(10, "CASE WHEN match_date - match_date_# <= 14 THEN 1 ELSE 0 END")} AS n14,
  {_sum(5, "CASE WHEN surface_# = surface THEN 1 ELSE 0 END")} AS same5 FROM lagged),
 each AS (SELECT *, CASE WHEN n7 >= 5 THEN -5.0 WHEN n7 >= 3 THEN -2.0 WHEN n14 = 0 THEN -3.0 WHEN n7 >= 1 THEN 3.0 ELSE 0.0 END AS rest, CASE WHEN same5 = 5 THEN 5.0 WHEN same5 >= 3 THEN 3.0 WHEN same5 <= 1 THEN -3.0 ELSE 0.0 END AS warm FROM known)"""
_METS = f"""lag_met AS (SELECT *, {_lags("winner", 5, "w")}, {_lags("match_date", 5, "w")}, {_lags("score", 5, "w")}, COUNT(*) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS meetings FROM played WINDOW w AS (PARTITION BY LEAST(a, b), GREATEST(a, b) ORDER BY match_date, match_id)),
 met AS (SELECT *, {_sum(5, "CASE WHEN winner_# IS NOT NULL THEN 1 ELSE 0 END")} AS decided, {_sum(5, "CASE WHEN winner_# = a THEN 1 ELSE 0 END")} AS wins_a, {_sum(5, "CASE WHEN winner_# = b THEN 1 ELSE 0 END")} AS wins_b,
  {_sum(5, "CASE WHEN winner_# IS NULL THEN 0.0 ELSE CASE WHEN winner_# = a THEN 8.0 ELSE -8.0 END * CASE WHEN match_date - match_date_# <= 180 THEN 2.0 WHEN match_date - match_date_# <= 365 THEN 1.5 WHEN match_date - match_date_# > 730 THEN 0.5 ELSE 1.0 END END")} AS points,
  CAST({_sum(5, f"CASE WHEN winner_# IS NULL THEN 0 WHEN winner_# = a THEN {_EASE} ELSE -({_EASE}) END")} AS DOUBLE) / NULLIF({_sum(5, "CASE WHEN winner_# IS NOT NULL THEN 1 ELSE 0 END")}, 0) AS ease FROM lag_met)"""
_CAP = lambda x, n: f"GREATEST(-{n}, LEAST({n}, {x}))"
_TIER = f"""CASE WHEN tournament = '' THEN 'unknown' WHEN regexp_matches(lower(tournament), '{"|".join(GRAND_SLAM)}') THEN 'grand_slam' WHEN regexp_matches(lower(tournament), '{"|".join(MASTERS)}') THEN 'masters_1000'
 WHEN regexp_matches(lower(tournament), 'atp 500|atp500') THEN 'atp_500' WHEN contains(lower(tournament), 'challenger') THEN 'challenger' ELSE 'atp_250' END"""
_NEW = f"""factors AS (SELECT m.match_id, m.winner, m.a AS player_a, m.b AS player_b, m.winner_1, m.meetings, {_TIER} AS tier, x.n10 > 0 AND y.n10 > 0 AS full_form,
  CAST({_CAP("points + CASE WHEN decided >= 3 AND wins_a = decided THEN 10.0 WHEN decided >= 3 AND wins_a = 0 THEN -10.0 ELSE 0.0 END + CASE WHEN ease > 8 AND wins_a * 2 > decided THEN 5.0 WHEN ease < -8 AND wins_a * 2 < decided THEN -5.0 ELSE 0.0 END", "40.0")} AS DOUBLE) AS h2h_score,
  CAST({_CAP("(x.w10 - y.w10) * 3.0 + CASE WHEN x.w3 = 3 AND y.w3 <= 1 THEN 5.0 WHEN y.w3 = 3 AND x.w3 <= 1 THEN -5.0 ELSE 0.0 END + CASE WHEN x.w5 = 5 THEN 8.0 ELSE 0.0 END - CASE WHEN y.w5 = 5 THEN 8.0 ELSE 0.0 END + CASE WHEN x.quality10 > y.quality10 + 2 THEN 5.0 WHEN y.quality10 > x.quality10 + 2 THEN -5.0 ELSE 0.0 END + x.rest - y.rest", "30.0")} AS DOUBLE) AS form_score,
  CASE WHEN x.total > 0 AND y.total > 0 THEN {_CAP("(x.rate - y.rate) * 25 + CASE WHEN x.rate >= 0.8 AND x.rate - y.rate >= 0.15 THEN 8.0 WHEN y.rate >= 0.8 AND x.rate - y.rate <= -0.15 THEN -8.0 ELSE 0.0 END + CASE WHEN x.total >= 10 AND y.total < 5 THEN 5.0 WHEN y.total >= 10 AND x.total < 5 THEN -5.0 ELSE 0.0 END + COALESCE((x.recent - y.recent) * 10, 0.0) + x.warm - y.warm", "20.0")} ELSE 0.0 END AS surface_score,
  CAST({_CAP("CASE WHEN x.w3 = 3 AND COALESCE(y.won_1, 0) = 0 THEN 5.0 WHEN y.w3 = 3 AND COALESCE(x.won_1, 0) = 0 THEN -5.0 ELSE 0.0 END + CASE WHEN x.sure10 > y.sure10 + 3 THEN 5.0 WHEN y.sure10 > x.sure10 + 3 THEN -5.0 ELSE 0.0 END", "10.0")} AS DOUBLE) AS momentum_score
  FROM met m JOIN each x ON x.match_id = m.match_id AND x.side = 'a' JOIN each y ON y.match_id = m.match_id AND y.side = 'b'),
 shown AS (SELECT match_id, winner, player_a, player_b, winner_1, meetings, tier, h2h_score, CASE WHEN full_form THEN form_score ELSE 0.0 END AS form_score, CASE WHEN full_form THEN surface_score ELSE 0.0 END AS surface_score, CASE WHEN full_form THEN momentum_score ELSE 0.0 END AS momentum_score,
  CASE WHEN full_form AND h2h_score <> 0 THEN 45.0 WHEN h2h_score <> 0 THEN 30.0 ELSE 50.0 END AS threshold FROM factors),
 new AS (SELECT *, CAST((h2h_score + form_score + surface_score + momentum_score) * CASE tier {" ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())} END AS DOUBLE) AS total FROM shown)"""
_OLD = f"""old_factors AS (SELECT m.match_id,
  CASE WHEN meetings = 0 OR wins_a = wins_b THEN 0.0 ELSE {_CAP("(wins_a - wins_b) * 10.0 + CASE WHEN wins_a > wins_b AND wins_a * 4 >= meetings * 3 THEN 10.0 WHEN wins_a < wins_b AND wins_b * 4 >= meetings * 3 THEN -10.0 ELSE 0.0 END", "50.0")} END AS h2h_score,
  {_CAP("(y.rank - x.rank) * 0.5 + CASE WHEN x.rank <= 10 AND y.rank > 50 THEN 5.0 WHEN y.rank <= 10 AND x.rank > 50 THEN -5.0 ELSE 0.0 END", "25.0")} AS ranking_score,
  CASE WHEN x.n10 > 0 AND y.n10 > 0 THEN {_CAP("(x.w5 - y.w5) * 3.0 + CASE WHEN x.w5 > y.w5 AND x.w3 = 3 THEN 3.0 WHEN x.w5 < y.w5 AND y.w3 = 3 THEN -3.0 ELSE 0.0 END", "15.0")} ELSE 0.0 END AS form_score,
  CASE WHEN ABS(x.rate - y.rate) >= 0.01 THEN {_CAP("(x.rate - y.rate) * 50 + CASE WHEN x.rate - y.rate >= 0.1 AND x.rate >= 0.8 THEN 5.0 WHEN x.rate - y.rate <= -0.1 AND y.rate >= 0.8 THEN -5.0 ELSE 0.0 END", "10.0")} ELSE 0.0 END AS surface_score
  FROM met m JOIN each x ON x.match_id = m.match_id AND x.side = 'a' JOIN each y ON y.match_id = m.match_id AND y.side = 'b'),
 old AS (SELECT *, CAST(h2h_score + ranking_score + form_score + surface_score AS DOUBLE) AS total FROM old_factors)"""
_FAVOURITE = lambda c: f"CASE WHEN {c} < 0 THEN 'player_b' WHEN {c} > 0 THEN 'player_a' ELSE 'even' END"
_BUCKET = lambda c: f"CASE WHEN ABS({c}) < 20 THEN '0-20' WHEN ABS({c}) < 40 THEN '20-40' WHEN ABS({c}) < 60 THEN '40-60' ELSE '60+' END"
_WITH = f"WITH {_PLAYED}, {_SIDES}, {_METS}"
_rounded = lambda *names: [F.round(n, 6).alias(n) for n in names]
_ROUNDED = lambda *names: ", ".join(f"ROUND(CAST({n} AS DOUBLE), 6) AS {n}" for n in names)
QUERIES = {
    "tennis_older_model": (
        lambda t: older_of(histories(t.matches)).select("match_id", *_rounded("h2h_score", "ranking_score", "form_score", "surface_score", "total_score"), "favourite"),
        f"{_WITH}, {_OLD} SELECT match_id, {_ROUNDED('h2h_score', 'ranking_score', 'form_score', 'surface_score')}, ROUND(total, 6) AS total_score, {_FAVOURITE('total')} AS favourite FROM old",
    ),
    "tennis_newer_model": (
        lambda t: newer(histories(t.matches)).select("match_id", "tier", *_rounded("h2h_score", "form_score", "surface_score", "momentum_score", "total_score", "threshold", "win_probability"), "favourite"),
        f"""{_WITH}, {_NEW} SELECT match_id, tier, {_ROUNDED("h2h_score", "form_score", "surface_score", "momentum_score")}, ROUND(total, 6) AS total_score, CAST(threshold AS DOUBLE) AS threshold,
 ROUND(GREATEST(0.5, LEAST(0.95, 1 / (1 + EXP(-(ABS(total) - 45) / 10)))), 6) AS win_probability, {_FAVOURITE("total")} AS favourite FROM new""",
    ),
    "tennis_models_compared": (
        lambda t: compared(histories(t.matches)),
        f"""{_WITH}, {_NEW}, {_OLD} SELECT {_BUCKET("o.total")} AS old_bucket, {_BUCKET("n.total")} AS new_bucket, ABS(o.total) >= 50 AS old_qualifies, ABS(n.total) >= n.threshold AS new_qualifies, COUNT(*) AS n,
 COUNT(CASE WHEN {_FAVOURITE("o.total")} = {_FAVOURITE("n.total")} THEN 1 END) AS same_favourite FROM old o JOIN new n ON n.match_id = o.match_id GROUP BY 1, 2, 3, 4""",
    ),
    "tennis_factors_used": (
        lambda t: factors_used(histories(t.matches)),
        f"""{_WITH}, {_NEW} SELECT factor, COUNT(*) AS n FROM (SELECT 'h2h' AS factor, h2h_score AS s FROM new UNION ALL SELECT 'form', form_score FROM new UNION ALL SELECT 'surface', surface_score FROM new
 UNION ALL SELECT 'momentum', momentum_score FROM new) x WHERE s <> 0 GROUP BY factor""",
    ),
    "tennis_last_winner": (
        lambda t: against_last_winner(histories(t.matches)),
        f"""{_WITH}, {_NEW} SELECT tier, COUNT(*) AS n, COUNT(CASE WHEN CASE WHEN total > 0 THEN player_a WHEN total < 0 THEN player_b END = winner THEN 1 END) AS favourite_right, COUNT(CASE WHEN winner_1 = winner THEN 1 END) AS last_winner_right
 FROM new WHERE winner_1 IS NOT NULL AND winner IS NOT NULL GROUP BY tier""",
    ),
}

from decimal import Decimal

import pytest

from matchlake.operators import odds, pages
from matchlake.sources.html import page_of


def test_nodes_of_broken_pages():
    page = page_of('<div class="a b"><p>one<br>two<li>x</div></b> tail <i>&amp;')
    assert [x.tag for x in page.all()] == ["div", "p", "#text", "br", "#text", "li", "#text", "#text", "i", "#text"]
    div = page.first("div", having="b")
    assert div.text(" ") == "one two x" and page.text() == "onetwoxtail&" and page.all("br")[0].text() == ""
    assert page.first("div", part="a b") is div and page.first("div", having="a b") is None
    assert page_of(None).all() == page_of("").all() == []


def table(spark, *html):
    return spark.createDataFrame([(i, f"http://x/{i}", h, "n") for i, h in enumerate(html)], "page_id long, url string, html string, nodes string")


def test_links(spark):
    html = '<a href="/match/1">A</a><a href="#/match/2">Serie A</a><a href="/x" data-href="https://y/event/3">B</a><a>no</a><a href="/match/1">again</a><a href="/help">h</a>'
    df = table(spark, html, None, "")
    assert {r.link for r in pages.links(df, "https://s").collect()} == {"https://s/match/1", "http://x/0#/match/2", "https://y/event/3"}
    assert {r.link for r in pages.links(df, "https://s", leagues=("serie a", "EVENT")).collect()} == {"http://x/0#/match/2", "https://y/event/3"}


def test_past_meetings(spark):
    row = lambda d, h, a, *g: f'<a class="h2h__row"><span class="h2h__date">{d}</span><span class="h2h__homeParticipant"><span class="h2h__participantInner">{h}</span></span><span class="h2h__awayParticipant"><span class="h2h__participantInner">{a}</span></span><span class="h2h__result">{"".join(f"<span>{x}</span>" for x in g)}</span></a>'
    section = lambda title, *rows: f'<div class="h2h__section"><b>{title}</b>{"".join(rows)}</div>'
    one = section("Last", row("1", "x", "y", 1, 2)) + section("Pojedynki", row("2", "A", "B", 2, 2), row("3", "A", "", 1, 0), row("4", "B", "A", 3), row("5", "B", "A", "-", 1), row("6", "A", "B", 0, 1), row("7", "A", "B", 5, 1))
    two = section("Last", row("1", "x", "y", 1, 2))
    got = sorted(map(tuple, pages.past_meetings(table(spark, one, two, "<p>", None)).collect()))
    assert got == [(0, 1, "2", "A", "B", "2-2", "draw"), (0, 4, "5", "B", "A", "--1", "unknown"), (0, 5, "6", "A", "B", "0-1", "away"), (1, 1, "1", "x", "y", "1-2", "away")]


def test_final_scores(spark):
    status, score = '<div class="detailScore__status">{}</div>', '<div class="detailScore__wrapper">{}</div>'
    data = '<script type="application/ld+json">{}</script>'
    df = table(spark, status.format("FT") + score.format(" 2 ") + score.format("1"), status.format("2nd half") + score.format(1) * 2, score.format("x") + score.format(1),
               data.format("{bad") + data.format('{"homeTeam": {"score": 3}, "awayTeam": {"score": 3}}'), None)
    assert sorted(map(tuple, pages.final_scores(df).collect())) == [(0, "finished", 2, 1, "home"), (1, "not_finished", None, None, None), (2, "no_score", None, None, None), (3, "finished", 3, 3, "draw"), (4, "no_score", None, None, None)]


def test_form_falls_back(spark):
    cells = "".join(f'<span class="form__cell {c}"></span>' for c in ("isWin", "lost", "draw", "none", "win", "win"))
    df = table(spark, f'<div class="smv__homeParticipant"><div class="myform"></div></div><div class="participant__form--home">{cells}</div>', "<div>W</div><span>L</span><span>WL</span>", '<div class="recentForm">x 2 - 1</div><div class="lastMatch">-</div><div class="lastMatch"><b>0:0</b></div>', None)
    assert [r.form for r in pages.team_form(df, "home").orderBy("page_id").collect()] == ["WLDW", "WL", "WD", ""]


def quotes(spark, rows):
    return spark.createDataFrame([(m, s, b, *(None if x is None else Decimal(str(x)) for x in o)) for m, s, b, *o in rows], "match_id long, sport string, bookmaker string, home_odds decimal(6,2), draw_odds decimal(6,2), away_odds decimal(6,2)")


def test_odds_rules(spark):
    df = quotes(spark, [(1, "football", "bet365", 2, 3, 4), (1, "football", "Pinnacle", None, 3, 0), (2, "tennis", "pinnacle", 0, 3, 1.5), (2, "tennis", "bet365", 9, 9, 9), (3, "football", "other", 2, 2, 2), (None, "football", "bet365", 2, 2, 2), (4, "football", "a", 1, None, 2), (4, "football", "b", 1, None, 2)])
    plain = lambda d: sorted(tuple(float(x) if isinstance(x, Decimal) else x for x in r) for r in d.collect())
    assert plain(odds.by_priority(df)) == [(1, 2.0, 3.0, 4.0, "Bet365"), (2, 0.0, None, 1.5, "Pinnacle")]
    best = {r[0]: r[1:] for r in plain(odds.best_of_all(df))}
    assert best[4] == (None, None, None, None, 2.0, "a", "a,b") and best[2] == (9.0, "bet365", None, None, 9.0, "bet365", "bet365,pinnacle")


def test_enrichment_keeps_all_rows_and_shuffles_them_once(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None), (4, True)], "match_id long, qualifies boolean")
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "match_id long, tip string"), spark.createDataFrame([(4, 5)], "match_id long, votes int")
    got = odds.enriched(rows, {"a": a, "b": b})
    assert sorted(map(tuple, got.collect())) == [(1, True, "x", None), (2, False, None, None), (3, None, None, None), (4, True, None, 5)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = odds.enriched(rows, {"a": a, "b": b})._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3  # one for each side


def test_first_source(spark):
    df = lambda rows: spark.createDataFrame(rows, "day string, x int")
    got = odds.first_source([df([("a", 1), ("a", 2)]), df([("a", 3), ("b", 4)]), df([("b", 5), ("c", 6), (None, 7)])], ("day",))
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 1, 0), ("a", 2, 0), ("b", 4, 1), ("c", 6, 2), (None, 7, 2)]


@pytest.mark.parametrize("name", ["enriched_matches", "odds_by_priority"])
def test_plans_have_no_nested_loop(spark, sf_dir, name):
    from matchlake.sources import derived

    plan = odds.QUERIES[name][0](derived.Tables(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def told(page):
    return [(x.at, x.tag, x.attrs, x.own, x.till, x.classes) for x in page.page]


def test_plain_pages_are_read_as_the_parser_reads_them(spark, sf_dir, monkeypatch):
    import random

    from matchlake.operators import predicted
    from matchlake.sources import derived, html

    bits = ["<div>", "</div>", '<div class="a b">', '<span class="x" class="y">', "</span>", "<br>", "<br/>", "<P>", "</P>", "text", " ", "&amp;", "&am", "&", "<", "a<b", ">", '<a href="x>y">', '<a b="1"\tc="&lt;q">', "<i b='2'>", "<u x>"]
    bits += ["<!-- c -->", "<!doctype html>", "<script>", "</script>", "<td", "</", "</ div>", "</div >", "é", "\x00", '"', "=", '<a b="">', "\xa0", "<1>", "<x:y>", "\n", "&#65", "<title>", "</title>", '<img  src="&" >', "\x85", '<a\x0bb="1">', "<İ>", "<li " + 'a="b" ' * 60 + ">"]
    r, plain = random.Random(3), 0
    made = ["".join(r.choice(bits) for _ in range(r.randrange(9))) for _ in range(20000)]
    own = [x.html for x in derived.Tables(spark, sf_dir).rows(predicted.PREDICTED).limit(200).collect()]
    got = [told(html.page_of(h)) for h in made + own]
    plain = [html._read_plain(h) is not None for h in made + own]
    monkeypatch.setattr(html, "_read_plain", lambda h: None)
    assert got == [told(html.page_of(h)) for h in made + own]
    assert 2000 < sum(plain) < 20000 and all(plain[-len(own) :])  # the queries' own pages need no parser

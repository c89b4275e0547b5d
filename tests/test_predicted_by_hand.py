from datetime import date

from matchlake.operators import names, predicted


def pages(spark, *html, player=None):
    return spark.createDataFrame([(i, "football", f"http://x/{i}", player, h) for i, h in enumerate(html)], "page_id long, sport string, url string, player string, html string")


def row(body, home="A", away="B"):
    return f'<div class="rcnt"><span class="homeTeam">{home}</span><span class="awayTeam">{away}</span>{body}</div>'


def test_prediction_rows(spark):
    span = lambda c, t: f'<span class="{c}">{t}</span>'
    one = row(span("forepr", "Draw") + span("pred", "12") + span("fprc", "1") + span("prob", "nan") + span("prob", "4.5e1 %")) + row("", away="") + row(span("btts", "No") + span("both", "Yes") + span("under", "x") + span("over", ".5"), home="<i>A</i> <b>c</b>")
    table = f'<table><tr class="tr_1">{row("", "C", "D")[18:-6]}</tr><tr class="head"></tr></table>'
    got = [tuple(r)[:-1] for r in predicted.prediction_rows(pages(spark, one, table, None, "", "<p")).orderBy("page_id", "nth").collect()]
    # the first chance that is a number is the pick's own field
    assert got == [(0, 1, "A", "B", "12", 1.0, None, None), (0, 3, "Ac", "B", None, None, ".5", "Yes"), (1, 1, "C", "D", None, None, None, None)]


def test_rows_by_the_parser_and_without_it(spark, sf_dir):
    from matchlake.sources import derived, html

    own = derived.Tables(spark, sf_dir).rows(predicted.PREDICTED).where("page_id < 200").cache()
    parsed = own.selectExpr("page_id", "sport", "'<!-- read by the parser -->' || html AS html")
    assert html._read_plain("<!-- a --><b></b>") is None and all(html._read_plain(r.html) for r in own.collect())
    for query in (predicted.prediction_rows, predicted.row_details):
        rows = sorted(map(str, query(own).collect()))
        assert rows == sorted(map(str, query(parsed).collect())) and len(rows) > 200


def test_row_details(spark):
    chances = lambda *n: f'<div class="fprc">{"".join(f"<span>{x}</span>" for x in n)}</div>'
    html = row(chances(30, 40, 40) + '<div class="ex_sc">0<br>2</div><div class="avg_sc">2.5</div>') + row(chances(50, 50)) + row(chances(50, "x", 9) + '<span class="forepr">2</span><div class="ex_sc">3 : 1</div><div class="avg_sc">2.51</div>') + row(chances(7))
    got = [tuple(r)[4:] for r in predicted.row_details(pages(spark, html, None)).orderBy("nth").collect()]
    assert got == [("X", 40.0, "0-2", 2.5, "Under 2.5", "No"), ("2", 50.0, None, None, None, None), ("2", None, "3 : 1", 2.51, "Over 2.5", None), (None, None, None, None, None, None)]


def test_section_form(spark):
    section = lambda *x: f'<div class="h2h__section">{"".join(x)}</div>'
    met = lambda a, b: f'<a class="h2h__row"><span class="h2h__result"><span>{a}</span><span>{b}</span></span></a>'
    badge = lambda t, title="": f'<div class="BadgeForm" title="{title}">{t}</div>'
    html = (
        section(badge("Z"), badge("?", "Remis"), badge("P"), badge(""), badge("W"), badge("L")) + section(met(1, 0)),
        section(met(1, 0), met("x", 1), met(2, 2)) + section(met(1, 0), met(0, 3)) + section(badge("W")),
        '<div class="h2h__row"><i class="score">2:1</i></div><table><tr class="h2h"><td><span class="score">0-1</span></td></tr></table><div class="h2h__row"><i>1:1</i></div>',
        "<b>An Error</b>" + section(badge("W")),
        None,
    )
    got = [tuple(r)[1:] for r in predicted.section_form(pages(spark, *html)).orderBy("page_id").collect()]
    # the third page's first row has its score in neither a division nor a span
    assert got == [("WDLW", ""), ("WD", "LW"), ("L", "W"), ("", ""), ("", "")]


def test_surfaces(spark):
    matches = spark.createDataFrame([(1, date(2024, 1, 1), "tennis", "league_0", "P", "Q", "1", 2, 0), (2, date(2024, 1, 2), "tennis", "league_0", "Q", "P", "1", 2, 1), (3, date(2024, 1, 3), "tennis", "league_1", "P", "Q", None, None, None)],
                                    "match_id long, match_date date, sport string, league string, home_team string, away_team string, actual_result string, home_score int, away_score int")
    html = ('<div class="surfaces">Clay 45/15<section class="surface">Grass 0 - 0</section></div>', '<div class="surface">clay 0-0</div>', None)
    got = {(r.page_id, r.surface): tuple(r)[3:] for r in predicted.surface_counts(pages(spark, *html, player="P"), matches).collect()}
    assert len(got) == 9 and got[0, "clay"] == (45, 60, 0.75, True) and got[0, "grass"] == got[0, "hard"] == (0, 0, 0.0, True)
    assert got[1, "clay"] == got[2, "clay"] == (1, 2, 0.5, False) and got[1, "hard"] == (0, 0, 0.0, False)
    assert {tuple(r)[3:] for r in predicted.surface_counts(pages(spark, None), matches).collect()} == {(0, 0, 0.0, False)}  # no player
    courts = predicted.page_court(pages(spark, '<i class="surface HARD"></i>clay', "Rome", '<i class="surface">s-Hertogenbosch', None)).orderBy("page_id")
    assert [r.surface for r in courts.collect()] == ["hard", "clay", "grass", "hard"]


def test_plain_forms(spark):
    df = spark.createDataFrame([(x,) for x in (" Győr  U19 ", "Beşiktaş II", "FC Köln IF", "São Paulo b", "AIK U7 x.", None, "")], "name string")
    got = [tuple(r) for r in df.select(names.minimal("name"), names.without_end("name"), names.without_club("name"), names.bare_letters("name")).collect()]
    assert got == [("gyr u19", "gyr", "győr", "gyru19"), ("beikta ii", "beikta", "beşiktaş", "beiktaii"), ("fc koln if", "fc koln if", "fc köln", "fckolnif".replace("o", "")), ("so paulo b", "so paulo", "são paulo", "sopaulob"), ("aik u7 x", "aik u7 x", "aik x", "aiku7x"), ("", "", "", ""), ("", "", "", "")]


def by_side_of_one(left, events):
    """Brute force: home first, then guests; the side's team; its events on or after the day, then earlier ones newest first."""
    out = {}
    light = {n: n.lower() for r in [*left, *events] for n in r[3:5]}
    teams = sorted({(n, s) for e in events for s, n in ((e[1], e[3]), (e[1], e[4]))})
    for i, sport, day, home, away in left:
        for side, other in ((home, away), (away, home)):
            near = [(-names.like_tips(light[side], light[t]), t) for t, s in teams if s == sport and names.like_tips(light[side], light[t]) >= 0.5]
            if not near:
                continue
            team = min(near)[1]
            of = [(e[2], e[0], e[4] if side is home else e[3]) for e in events if e[1] == sport and (e[3] if side is home else e[4]) == team]
            alike = [(d, e) for d, e, o in of if names.like_loose(light[other], light[o]) >= 0.30]
            later, before = [x for x in alike if x[0] >= day], [x for x in alike if x[0] < day]
            if later or before:
                out[i] = min(later)[1] if later else min(before, key=lambda x: (-x[0].toordinal(), x[1]))[1]
                break
    return out


def test_one_side_then_the_other(spark):
    teams = ["arsenal", "chelsea", "leeds", "zenit", "qpr"]
    events = [(10 * a + b, "football", date(2024, 1, 1 + (a * 7 + b * 3) % 20), teams[a], teams[b]) for a in range(5) for b in range(5) if a != b]
    events += [(100 + e[0], *e[1:]) for e in events[:6]] + [(200, "tennis", date(2024, 1, 9), "arsenal", "chelsea")]
    left = [(i, "football", date(2024, 1, 1 + i % 22), h, a) for i, (h, a) in enumerate((x, y) for x in ("arsenall", "leeds u", "chelsea", "nobody", "zzz") for y in ("zenit sp", "xxyyxx", "qpr", "arsenal"))]
    left += [(90, "tennis", date(2024, 1, 10), "arsenal", "chelsea"), (91, "golf", date(2024, 1, 10), "arsenal", "chelsea"), (92, "tennis", date(2024, 1, 1), "", "chelsea")]
    schema = "{} long, sport string, match_date date, home_team string, away_team string"
    got = names.by_one_side(spark.createDataFrame([*left, (None, None, None, None, None)], schema.format("left_id")), spark.createDataFrame(events, schema.format("event_id")))
    assert {r.left_id: r.event_id for r in got.collect()} == by_side_of_one(left, events)

"""Rules on hand-made frames, with expected values worked out from the rules."""

import math

import pytest
from pyspark.sql import functions as F

from threadpulse.functions import scores, states, text
from threadpulse.operators import groups, labels, profiles, quantiles, status, timeline, topics


def test_link_classes(spark):
    cases = {"": "self_post", "https://m.youtube.com/x": "video_platform", "https://a.gov/x": "government", "https://thejournal.ie/x": "news_site", "https://herald.example/x": "news_site", "https://bloomberg.com/x": "news_site", "https://some.blog/x": "publisher_or_blog", "mailto": "external_unknown"}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    got = {r.u: r.c for r in df.select("u", text.link_category(F.col("u"), text.link_domain(F.col("u"))).alias("c")).collect()}
    assert got == cases


def test_text_functions(spark):
    df = spark.createDataFrame([("  &amp;lt;b&gt; &eacute;\r\nx&hellip; ", "ÉAbc ñÑ 12", "Breaking: War ends? WOW", None)], "a string, b string, c string, d string")
    r = df.select(
        text.clean_text(F.col("a")).alias("a"), text.uppercase_ratio(F.col("b")).alias("b"), text.clean_text(F.col("d")).alias("d"), text.similarity_key(F.col("c")).alias("k"), text.primary_topic(F.lit("the war and the nato vote")).alias("t"), text.primary_topic(F.lit(" ")).alias("t0"), text.primary_topic(F.lit("zzz")).alias("t1"),
        text.listing_type(F.lit("Top"), F.lit("day")).alias("l"), text.author_name(F.lit(" ")).alias("n"), text.number(F.lit(" 7.9 "), True).alias("w"), text.number(F.lit("x")).alias("x"), *[c.alias(f"s_{k}") for k, c in text.title_style(F.col("c")).items()], *[c.alias(f"p_{k}") for k, c in text.permalink_target(F.lit("https://x/r/News/comments/ab1/t/")).items()],
        text.story_key(F.lit("https://Ex.org/a/b/?q"), F.lit("t"), F.lit(1)).alias("sk"), text.story_key(F.lit(None), F.lit("A b!"), F.lit(1)).alias("sk2"),
    ).first()
    assert (r.a, r.b, r.d, r.k, r.t, r.t0, r.t1, r.l, r.n, r.w, r.x) == ("<b> é\nx…", 3 / 6, "", "war ends wow", "war_geopolitics", "unknown", "general", "top_day", "[deleted]", 7, None)
    assert (r.s_is_question, r.s_is_breaking, r.s_has_negative_word, r.s_all_caps_words, r.s_word_count, r.p_community, r.p_post_id) == (True, True, True, 1, 4, "News", "t3_ab1")
    assert (tuple(r.sk), tuple(r.sk2)) == (("external_link", "ex.org/a/b"), ("title", "a b"))


@pytest.mark.parametrize(
    "state, n, age, moves, want",
    [("surging", 1, 0, False, "surging"), ("cooling", 1, 100, False, "unknown"), ("cooling", 2, 100, False, "unknown"), ("cooling", 3, 100, False, "cooling"), ("dying", 2, 900, False, "unknown"), ("dying", 3, 900, True, "cooling"), ("dying", 3, 900, False, "dying"), ("dead", 3, 719, False, "dying"), ("dead", 3, 720, False, "dead"), ("dead", 3, 5000, True, "dying"), ("dead", 3, None, False, "dead"), ("unknown", 1, None, False, "unknown")],
)
def test_settled_state(spark, state, n, age, moves, want):
    df = spark.createDataFrame([(state, n, age, moves)], "s string, n int, a double, m boolean" if age is None else "s string, n int, a int, m boolean")
    assert df.select(scores.settled_state(F.col("s"), F.col("n"), F.col("a"), F.col("m")).alias("x")).first().x == want


@pytest.mark.parametrize("state, age, want", [("surging", None, "highest"), ("alive", 1, "high"), ("emerging", 1, "high"), ("cooling", 360, "medium"), ("cooling", 361, "low"), ("cooling", None, "low"), ("dying", 1, "low"), ("dead", 1, "very_low"), ("unknown", 1, "low")])
def test_priority(spark, state, age, want):
    df = spark.createDataFrame([(state, age)], "s string, a int")
    assert df.select(scores.analysis_priority(F.col("s"), F.col("a")).alias("x")).first().x == want


def test_scores(spark):
    row = {"latest_comments": 1.0, "latest_upvotes": None, "latest_replies": -3.0, "latest_commenters": 2.0, "max_upvotes_seen": 0.0, "max_replies_seen": 1.0, "last_upvote_velocity": 9.0, "last_comment_velocity": None}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))
    r = df.select(scores.engagement_score().alias("e"), scores.attention_score(F.lit("cooling"), F.lit("hot"), F.lit(60.0), F.lit(1)).alias("a")).first()
    assert r.e == pytest.approx(1.2 * math.log(2) + 0.9 * math.log(3) + 0.8 * math.log(2))
    assert r.a == pytest.approx((1.8 * math.log(10) + 0.7 * math.log(3)) * 0.65 + 0.2 + 1.7 + 1.3 + 2.2 / math.log(3.5))


def snapshots(spark, velocities, age0=0.0, state="dead", community="a", comments=0.0):
    rows = [(community, 1, i, float(i), 100.0, float(v), comments, state, age0 + 60.0 * i) for i, v in enumerate(velocities)]
    return spark.createDataFrame(rows, "community string, post_id long, snapshot_no int, hours double, upvotes double, upvote_velocity double, comment_velocity double, state string, age_minutes double")


@pytest.mark.parametrize(
    "velocities, age0, want",
    [
        ([90, 10, 80, 20, 5, 4, 3, 2, 1], 0, ("dormant", 4)),  # collapsed, dead, but young
        ([90, 10, 80, 20, 5, 4, 3, 2, 1], 1440, ("dropped", 4)),
        ([90, 10, 80, 20, 5, 4, 0, 50, 3, 2, 1], 1440, ("active", None)),  # never settles
        ([90, 10, 80, 20], 5000, ("active", None)),  # too few
        ([90, 10, 80, 20, 5, 4, 3, 2, 1, 30, 30], 5000, ("active", 4)),  # revival
        ([90, 10, 80, 0, 20, 70, 5, 4, 3, 2, 1], 1440, ("dropped", 5)),  # the zero between high ones is a gap
    ],
)
def test_pools(spark, velocities, age0, want):
    r = timeline.pools(snapshots(spark, velocities, age0)).first()
    assert (r.pool, r.collapse_index) == want


def test_one_post_id_in_two_communities(spark):
    both = snapshots(spark, [1, 2, 3]).unionByName(snapshots(spark, [4, 5], community="b"))
    assert {(r.community, r.n) for r in timeline.variance_collapse(both).collect()} == {("a", 3), ("b", 2)}
    got = timeline.sequence_features(both).groupBy("community").agg(F.max("position").alias("n")).collect()
    assert {(r.community, r.n) for r in got} == {("a", 3), ("b", 2)}


def test_gap_patch(spark):
    rows = [(None, 0.0, 5.0, 100.0), (0.0, 0.0, 5.0, 100.0), (1.0, 0.0, 6.0, 100.0), (2.99, 0.0, 0.0, 100.0), (3.0, 9.0, 6.0, 100.0), (5.0, 9.0, None, 100.0), (1.0, 0.0, 6.0, 20.0), (1.0, 3.0, 6.0, 100.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, hours_since_previous double, upvote_velocity double, upvote_delta double, upvotes double")
    got = [(r.is_collection_gap, r.velocity_interpolated, r.is_fuzzing, r.patched_velocity) for r in timeline.gap_patch(df).orderBy("i").collect()]
    assert got == [(0, 0, 0, 0.0), (0, 0, 0, 0.0), (0, 1, 0, 6.0), (0, 0, 1, 0.0), (1, 1, 0, 2.0), (1, 0, 0, 9.0), (0, 0, 0, 0.0), (0, 0, 0, 3.0)]


def test_listing_runs_and_paths(spark):
    rows = [("a", 1, i, float(h), x) for i, (h, x) in enumerate([(0, "n"), (1, "n"), (3, "h"), (8, "h"), (9, "n")])]
    df = spark.createDataFrame(rows, "community string, post_id long, snapshot_no int, hours double, listing string")
    assert [r.run_length for r in timeline.run_lengths(df, "post_id", "snapshot_no", "listing").orderBy("snapshot_no").collect()] == [1, 2, 1, 2, 1]
    r = labels.listing_paths(df).first()
    assert (r.path, r.last_three, r.n_runs, r.run_length, r.hours_in_run) == ("n>h>n", "n>h>n", 3, 1, 0.0)


def grid_of(spark, **counts):
    return spark.createDataFrame([(t, i, n) for t, c in counts.items() for i, n in enumerate(c)], "topic string, day_idx int, n_posts long")


def test_deaths_and_revivals(spark):
    g = grid_of(spark, a=[0, 3, 5, 1, 0, 0, 2], b=[2, 1, 2, 1, 2])
    death = {r.topic: (r.peak_idx, r.death_idx, r.days_to_death, r.quick) for r in topics.confirmed_death(g).collect()}
    assert death == {"a": (2, 3, 1, True), "b": (0, None, None, None)}
    profile = {r.topic: (r.drops, r.revivals, r.peak, r.active_days, r.posts, r.peaks) for r in labels.reviver_profiles(g).collect()}
    assert profile == {"a": (1, 1, 5, 2, 9, 1), "b": (2, 2, 2, 3, 8, 1)}
    runs = {r.run_length: (r.deaths, r.revivals) for r in topics.false_deaths(g).collect()}
    assert runs == {1: (3, 3), 2: (1, 1), 3: (1, 1)}


def days_of(spark, **counts):
    return spark.createDataFrame([(d, t, n, 10 * n) for t, c in counts.items() for d, n in enumerate(c) if n], "day_no int, topic string, n_posts long, total_upvotes long")


def test_dies_tomorrow_and_peaks(spark):
    d = days_of(spark, a=[2, 4, 4, 1, 0, 3], b=[1, 1, 1, 1, 1, 1])
    got = {(r.topic, r.day_idx): (r.dies, r.post_trend, r.age) for r in labels.dies_tomorrow(d).collect()}
    assert [got["a", i] for i in (0, 1, 2, 3)] == [(0, 1.0, 0), (0, 2.0, 1), (1, 1.0, 2), (1, 0.25, 3)] and ("a", 5) not in got
    assert all(got["b", i][0] == 1 for i in range(5))
    p = {r.topic: (r.days_to_peak, r.peak_posts, r.n_days, r.post_growth, r.days_to_quiet) for r in labels.peak_profiles(d).collect()}
    assert p == {"a": (1, 4, 5, 2.0, 2), "b": (0, 1, 6, 1.0, 1)}


def test_gini(spark):
    cases = {1: [1], 2: [0, 0], 3: [1, 1, 1], 4: [0, 0, 9]}
    df = spark.createDataFrame([(k, v) for k, vs in cases.items() for v in vs], "post_id int, upvotes int")
    got = {r.post_id: r.gini for r in groups.gini(df, "post_id", "upvotes").collect()}
    assert got == pytest.approx({1: 0, 2: 0, 3: 0, 4: 2 / 3})


def test_thread_of_any_depth(spark):
    rows = [(1, i, i - 1 if i else None) for i in range(600)] + [(2, 0, None), (2, 1, 0), (2, 2, 99)]
    df = spark.createDataFrame(rows, "post_id int, comment_id int, parent_id int")
    got = {(r.post_id, r.comment_id): r.depth for r in groups.thread_depth(df).collect()}
    assert all(got[1, i] == i + 1 for i in range(600)) and (got[2, 0], got[2, 1], got[2, 2]) == (1, 2, None)


def test_title_diversity_and_split(spark):
    posts = spark.createDataFrame([(0, 1, ["a", "b"], ["k"]), (0, 2, ["b", "c"], ["k"]), (0, 3, ["a", "b"], ["k"])], "day_no int, post_id int, w array<string>, keys array<string>")
    assert profiles.title_diversity(posts, "keys", "w", 5).first().diversity == pytest.approx((2 / 3 + 0 + 2 / 3) / 3)
    rows = spark.createDataFrame([(t, i) for t in range(5) for i in range(3)], "t int, i int")
    train = {(r.t, r.i) for r in profiles.chronological_split(rows, "t", "i", 0.5).where("split = 'train'").collect()}
    assert train == {(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0)}


def test_states_at_their_bounds(spark):
    base = {"hours_since_previous": 1.0, "upvote_delta": 0.0, "comment_delta": 0.0, "upvote_velocity": 0.0, "comment_velocity": 0.0, "still_visible_next": 1, "age_minutes": 100.0, "alive_upvotes": 20.0, "alive_comments": 2.0, "surging_upvotes": 100.0, "surging_comments": 10.0, "dead_upvotes": 5.0, "dead_comments": 0.5}
    cases = [({"hours_since_previous": None, "age_minutes": 60.0}, "emerging"), ({"hours_since_previous": None, "age_minutes": 61.0}, "unknown"), ({"upvote_velocity": 100.0}, "surging"), ({"upvote_velocity": 20.0}, "alive"), ({"upvote_velocity": 5.1, "upvote_delta": 5.1}, "alive"), ({"upvote_velocity": 5.0, "upvote_delta": 5.0}, "cooling"), ({"age_minutes": 720.0}, "dying"), ({"age_minutes": 719.0}, "cooling"), ({"age_minutes": 2160.0}, "dead"), ({"age_minutes": 2160.0, "upvote_velocity": 4.0, "upvote_delta": 4.0}, "cooling"), ({"age_minutes": 2160.0, "upvote_velocity": None, "upvote_delta": None}, "dead")]
    schema = ", ".join(f"{k} {'int' if k == 'still_visible_next' else 'double'}" for k in base)
    df = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], schema).coalesce(1)
    assert [r.s for r in df.select(states.activity_state().alias("s")).collect()] == [w for _, w in cases]


def test_watchlist_and_summary(spark):
    rows = [("a", i, f"{s}", float(10 - i), 1.0, 1.0, "hot") for i, s in enumerate(("alive", "cooling", "dead"))]
    df = spark.createDataFrame(rows, "community string, post_id long, latest_state string, attention double, popularity double, engagement double, last_listing string")
    r = status.attention_summary(df).first()
    assert (r.n_posts, r.n_alive, r.n_cooling, r.n_dead, r.top_post, r.max_attention) == (3, 1, 1, 1, 0, 10.0)


@pytest.mark.parametrize("group", ["g", None])
def test_quantiles_over_ranges_equal_those_of_one_aggregate(spark, group):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 11 != 0, F.pmod(F.xxhash64("id"), F.lit(997)) / 7.0).alias("x"), F.when(F.col("id") > 4990, F.col("id") * 1.0).alias("y"))
    want = {"x": [0.0, 0.35, 0.5, 1.0], "y": [0.1, 0.9]}
    key = lambda r: (r.g if group else 0)
    a, b = ({key(r): (list(r.x), list(r.y)) for r in quantiles.by_group(rows, group, want, most).collect()} for most in (10**9, 0))
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == pytest.approx(b[k][0]) and a[k][1] == pytest.approx(b[k][1])


def test_similarity_key_takes_prefixes_off_in_order(spark):
    cases = [("Breaking: Update on vote", "on vote"), ("update megathread election", "election"), ("Megathread update election", "update election"), ("breaking breaking news", "breaking news"), ("BREAKING", "breaking"), (" It's -- OK ", "its ok"), (None, "")]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", text.similarity_key(F.col("t")).alias("k"), text.similarity_words(F.col("t")).alias("w")).orderBy("i").collect()
    assert [r.k for r in got] == [k for _, k in cases]
    assert got[0].w == ["vote"] and got[6].w == []


def test_forecast_text(spark):
    from threadpulse.operators import reports

    cases = [(10, 1.0, 1.0, "at risk of dying"), (30, 1.0, 1.0, "recovering"), (30, 1.0, None, "at risk"), (60, -1.0, -1.0, "declining"), (60, -1.0, 1.0, "stable"), (75, 1.0, 0.5, "growing"), (90, 0.0, 1.0, "stable")]
    got = spark.createDataFrame([(i, float(s), u, c) for i, (s, u, c, _) in enumerate(cases)], "i int, s double, u double, c double").select("i", reports.forecast_text(F.col("s"), F.col("u"), F.col("c")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [c[-1] for c in cases]


def test_similar_titles_of_equal_sets(spark):
    rows = [(i, "abc"[i % 3], ["x"]) for i in range(30)] + [(40, "a", ["x", "y"]), (41, "b", ["y", "z"]), (42, "c", ["q"])]
    got = {(r.a, r.b): r.similarity for r in groups.similar_titles(spark.createDataFrame(rows, "post_id int, community string, words array<string>")).collect()}
    want = {}
    for i, c, w in rows:
        for j, e, v in rows:
            s = len({*w} & {*v}) / min(len(w), len(v))
            if c < e and s >= 0.5:
                want[i, j] = s
    assert got == want and len(want) > 300


def test_whole_seconds_are_nearest(spark, tmp_path):
    """24 hours to the second before and after: half seconds go to the nearest whole one, as the query's SQL casts them."""
    import oracle

    from threadpulse.plans import registry

    at = ["2024-01-01 10:00:00.700000", "2024-01-02 10:00:01.200000", "2024-01-02 10:00:00.900000", "2024-01-02 10:00:01.600000"]
    events = spark.createDataFrame([(i, t, 3 * i) for i, t in enumerate(at)], "event_id long, t string, user_id long").selectExpr("event_id", "cast(t as timestamp) AS ts", "user_id", "'view' AS event_type", "1.0D AS value")
    events.write.parquet(str(tmp_path / "events.parquet"))
    assert oracle.differences(spark, oracle.duck(tmp_path), registry.queries()["repeat_24h"], registry.oracle_sql()["repeat_24h"], str(tmp_path)) == ""


def test_quantiles_to_the_last_bit(spark):
    """Values a few last bits apart: quantiles equal DuckDB's exactly, by counts and over ranges."""
    import random

    import duckdb

    draw = random.Random(5)
    rows = []
    for g in range(60):
        base = draw.uniform(1, 50)
        rows += [(g, math.nextafter(base, 1e9, steps=draw.randint(0, 3))) for _ in range(draw.randint(2, 40))]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (g INT, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = {r[0]: list(r[1:]) for r in con.execute("SELECT g, quantile_cont(v, 0.35), quantile_cont(v, 0.8), quantile_cont(v, 0.1) FROM t GROUP BY 1").fetchall()}
    df = spark.createDataFrame(rows, "g int, v double")
    for most in (10_000, 0):
        assert {r.g: r.v for r in quantiles.by_group(df, "g", {"v": [0.35, 0.8, 0.1]}, most).collect()} == want


def test_quantiles_of_equal_values(spark):
    """Groups of a few equal values: DuckDB's quantile may miss them by a last bit, and so do these."""
    import duckdb

    rows = [(g, g / 600) for g in range(1, 400) for _ in range(2 + g % 8)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (g INT, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = {g: [q] for g, q in con.execute("SELECT g, quantile_cont(v, 0.1) FROM t GROUP BY 1").fetchall()}
    assert any(q != [g / 600] for g, q in want.items())
    df = spark.createDataFrame(rows, "g int, v double")
    for most in (10_000, 0):
        assert {r.g: r.v for r in quantiles.by_group(df, "g", {"v": [0.1]}, most).collect()} == want


def test_upvotes_are_rounded_as_in_sql(spark, tmp_path):
    """Values a last bit below a half of the fourth place."""
    import duckdb

    from threadpulse.plans import fixtures

    values = [math.nextafter((2 * i + 1) / 20000, 0.0) for i in range(1, 300)]
    events = spark.createDataFrame(list(enumerate(values)), "user_id long, value double").selectExpr("user_id AS event_id", "timestamp'2024-01-01 01:00:00' AS ts", "user_id", "'view' AS event_type", "value")
    events.write.parquet(str(tmp_path / "events.parquet"))
    want = dict(duckdb.sql(f"WITH events AS (FROM '{tmp_path}/events.parquet/*.parquet'), {fixtures.SNAPSHOTS_SQL} SELECT post_id, upvotes FROM fx").fetchall())
    assert {r.post_id: r.upvotes for r in fixtures.post_snapshots(spark, str(tmp_path)).collect()} == want


def test_similar_pairs_are_not_shuffled(spark, monkeypatch):
    """Many posts of one set and frequent words, dealt to small rows and tasks, give all pairs; nothing but the join's own sides is exchanged."""
    import random

    monkeypatch.setattr(groups, "POSTS_A_ROW", 2)
    monkeypatch.setattr(groups, "SETS_A_TASK", 1)
    draw = random.Random(3)
    rows = [(i, "abcd"[i % 4], draw.sample("pqrstuv", draw.randint(1, 4))) for i in range(120)]
    df = spark.createDataFrame(rows, "post_id int, community string, words array<string>")
    out = groups.similar_titles(df)
    got = [(r.a, r.b, r.similarity) for r in out.collect()]
    want = {(i, j, len({*w} & {*v}) / min(len(w), len(v))) for i, c, w in rows for j, e, v in rows if c < e and 2 * len({*w} & {*v}) >= min(len(w), len(v))}
    assert len(got) == len(set(got)) and set(got) == want
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan


def test_cross_posts_move_no_titles(spark, monkeypatch):
    """The lowest pair of each title's start and two communities, as a loop finds it; titles don't go along with the words."""
    import random

    from threadpulse.operators import selection

    kept = []
    monkeypatch.setattr(selection, "similar_pairs", lambda posts, words, keep: kept.extend(keep) or groups.similar_pairs(posts, words, keep=keep))
    draw = random.Random(8)
    rows = [(i, draw.choice("abc"), f"title {draw.randrange(6)}", draw.sample("pqrstuv", draw.randint(1, 3)), float(draw.randrange(90)), i, "alive") for i in range(90)]
    df = spark.createDataFrame(rows, "post_id long, community string, title string, words array<string>, created double, upvotes int, state string")
    want = {}
    for x in rows:
        for y in rows:
            if x[1] < y[1] and 2 * len({*x[3]} & {*y[3]}) >= min(len(x[3]), len(y[3])) and abs(x[4] - y[4]) <= 48:
                f, s = (x, y) if x[4] <= y[4] else (y, x)
                k = f[2], f[1], s[1]
                want[k] = min(want.get(k, (999, 999)), (f[0], s[0]))
    got = {(rows[r.first_id][2], r.first, r.second): (r.first_id, r.second_id) for r in selection.cross_posts(df).collect()}
    assert got == want and len(got) > 20 and kept == ["created"]


def test_links_of_each_post_are_counted(spark, monkeypatch):
    """Links and classes of equal sets as loops find them, for many posts of one set and frequent words; posts without words have none."""
    import random

    monkeypatch.setattr(groups, "POSTS_A_ROW", 2)
    monkeypatch.setattr(groups, "SETS_A_TASK", 1)
    draw = random.Random(4)
    rows = [(i, "abcd"[i % 4], draw.sample("pqrstuv", draw.randint(0, 4))) for i in range(120)] + [(120, "a", None)]
    df = spark.createDataFrame(rows, "post_id int, community string, words array<string>")
    got = {r.post_id: (r.community, r.class_id, r.n_links) for r in groups.similar_counts(df).collect()}
    sets = [frozenset(w or ()) for _, _, w in rows]
    for i, c, _ in rows:
        alike = sum(c != e and bool(sets[i]) and bool(sets[j]) and 2 * len(sets[i] & sets[j]) >= min(len(sets[i]), len(sets[j])) for j, e, _ in rows)
        assert got.pop(i) == (c, sets.index(sets[i]) if sets[i] else i, alike)
    assert not got


def test_pairs_of_the_whole_text(spark):
    """Pairs of the title and of every sentence of the body, once a post; one shuffle, of words with those behind them."""
    rows = [(1, 7, "s0", 5, "alive", "alpha omega. gamma", "alpha omega. gamma\nomega delta alpha! zzz delta"), (1, 8, "s1", 2, "dead", "gamma", "gamma\nalpha: omega"), (2, 9, "s0", 1, "dead", None, None)]
    df = spark.createDataFrame(rows, "day_no int, post_id int, community string, upvotes int, state string, title string, body string")
    days = topics.pair_days(df, "title", "body")
    got = {r.topic: (r.n_posts, r.total_upvotes, r.n_communities) for r in days.collect()}
    assert got == {"alpha+omega": (2, 7, 2), "alpha+gamma": (1, 5, 1), "gamma+omega": (1, 5, 1), "alpha+delta": (1, 5, 1), "delta+omega": (1, 5, 1)}
    assert days._jdf.queryExecution().executedPlan().initialPlan().toString().count("Exchange hashpartitioning") == 1


def test_title_words_travel_as_text(spark):
    """Distances of titles with and without words; no array of words goes along with each keyword."""
    rows = [(1, 1, ["k", "m"], ["alpha", "omega"]), (1, 2, ["k", "m"], ["alpha"]), (1, 3, ["m"], []), (1, 4, ["z"], ["omega"]), (2, 5, ["q"], []), (2, 6, ["q"], [])]
    out = profiles.title_diversity(spark.createDataFrame(rows, "day_no int, post_id int, words array<string>, title_words array<string>"), "words", "title_words", 5)
    got = {(r.day_no, r.topic): (r.n_posts, round(r.diversity, 6)) for r in out.collect()}
    assert got == {(1, "k"): (2, 0.5), (1, "m"): (3, round((0.5 + 1 + 1) / 3, 6)), (2, "q"): (2, 0.0)}
    assert "concat_ws" in out._jdf.queryExecution().optimizedPlan().toString()


def test_title_diversity_of_groups_of_any_size(spark, monkeypatch):
    """Keywords of many posts have a row, as a loop over all pairs finds it, in one block and in several, with copies and titles without words."""
    import itertools
    import random

    draw = random.Random(5)
    rows = [(i % 2, i, draw.sample("km", draw.randint(1, 2)), draw.sample("abcdefgh", draw.choice((0, 1, 2, 2, 3, 4)))) for i in range(60)]
    df = spark.createDataFrame(rows, "day_no int, post_id int, words array<string>, title_words array<string>")
    want = {}
    for day, key in itertools.product((0, 1), "km"):
        sets = [{*t} for d, _, k, t in rows if d == day and key in k]
        each = [1 - len(a & b) / len(a | b) for a, b in itertools.combinations(sets, 2) if a | b]
        want[day, key] = (len(sets), pytest.approx(sum(each) / len(each)))
    for block in (8192, 7):
        monkeypatch.setattr(profiles, "TITLES_A_BLOCK", block)
        got = {(r.day_no, r.topic): (r.n_posts, r.diversity) for r in profiles.title_diversity(df, "words", "title_words").collect()}
        assert got == want


def test_sets_meet_in_blocks(spark, monkeypatch):
    """Pairs and links over several blocks, sets of up to 40 words and posts without a community, as loops find them; no set is compared row by row."""
    import random

    monkeypatch.setattr(groups, "LEAST_BLOCKS", 4)
    monkeypatch.setattr(groups, "SETS_A_TASK", 60)
    draw = random.Random(6)
    rows = [(i, draw.choice(["a", "b", "c", None]), [f"w{k}" for k in draw.sample(range(50), draw.choice((1, 2, 5, 20, 40)))]) for i in range(300)]
    df = spark.createDataFrame(rows, "post_id int, community string, words array<string>")
    links, pairs = dict.fromkeys(range(300), 0), {}
    for i, c, w in rows:
        for j, e, v in rows[i + 1 :]:
            both = len({*w} & {*v}) / min(len(w), len(v))
            if c and e and c != e and both >= 0.5:
                pairs[(i, j) if c < e else (j, i)] = both
                links[i], links[j] = links[i] + 1, links[j] + 1
    out = groups.similar_titles(df)
    assert {(r.a, r.b): r.similarity for r in out.collect()} == pairs and out.count() == len(pairs)
    counts = groups.similar_counts(df)
    assert {r.post_id: r.n_links for r in counts.collect()} == links
    assert not any("array_intersect" in x._jdf.queryExecution().optimizedPlan().toString() for x in (out, counts))


def test_prior_repeats_are_counted_not_joined(spark):
    """Others' first times in [t - span, t) as a loop finds them, with equal times, spans without any, negative times and nulls; first times and times meet in no join of one with many."""
    import random

    draw = random.Random(7)
    rows = [(i, draw.choice("kl"), draw.choice([1, 2, 3, 4, 5, 6, 7, 8, None]), draw.choice([draw.randrange(-30, 60), draw.randrange(400, 420), None])) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, k string, who int, t long")
    first = {}
    for _, k, who, t in rows:
        if who is not None and t is not None:
            first[k, who] = min(first.get((k, who), t), t)
    want = {i: sum(g == k and u != who and t - 10 <= f < t for (g, u), f in first.items()) if who is not None and t is not None else 0 for i, k, who, t in rows}
    out = timeline.prior_repeats(df, ["k"], "who", "t", 10)
    assert {r.i: r.prior_repeats for r in out.collect()} == want and out.columns == [*df.columns, "prior_repeats"]
    assert "NOT (_other" not in out._jdf.queryExecution().optimizedPlan().toString() and ") <" not in "".join(x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)


def test_sentences_of_the_title_are_not_dealt_again(spark, monkeypatch):
    """A sentence whose words are all in the title adds no pair and isn't shuffled; one that only begins like the title's words is."""
    rows = [(1, 7, "s0", 5, "alive", "alpha omega. gamma delta", "alpha omega. gamma delta\ngammas omega! alpha delta"), (1, 8, "s1", 2, "dead", None, "gamma delta. gamma")]
    df = spark.createDataFrame(rows, "day_no int, post_id int, community string, upvotes int, state string, title string, body string")
    dealt, plain = [], topics.pair_rows
    monkeypatch.setattr(topics, "pair_rows", lambda lines, words, keep: dealt.append(lines) or plain(lines, words, keep))
    got = {r.topic: r.n_posts for r in topics.pair_days(df, "title", "body").collect()}
    assert got == {"alpha+omega": 1, "alpha+gamma": 1, "alpha+delta": 1, "delta+omega": 1, "gamma+omega": 1, "delta+gamma": 2, "gammas+omega": 1}
    assert sorted(sorted(r._words) for r in dealt[0].collect()) == [["alpha", "delta", "gamma", "omega"], ["delta", "gamma"], ["gammas", "omega"]]

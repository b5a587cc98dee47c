"""Queries of state flows: chains by age with scenarios, anchored posts, busiest topics, fixed-matrix outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import discussion, flows, pulse
from ..operators.markov import STATES
from ..sources import tables
from . import fixtures as fx
from .now import profiles, PROFILE_SQL
from .registry import _r, query, rounded, states, STATES_SQL

#: The fixture's snapshots are 6 hours apart; an eighth of a post's age has rows in each age bucket
_SLOW = 8
_COMMUNITIES = ("Games", "news", "politics", "technology", "elsewhere")


def moved(s, d):
    rows = states(s, d).withColumn("topic", F.concat(F.lit("t"), (F.col("post_id") % 2).cast("string")))
    speed = scores.velocity_bucket(F.col("upvote_velocity"), F.col("alive_upvotes"), F.col("surging_upvotes"))
    return tables.materialize(flows.moves(rows, scores.snapshot_age_bucket(F.col("age_minutes") / _SLOW), speed))


_FIVE = ", ".join(f"'{x}'" for x in STATES)
_AGE = f"CASE WHEN age_minutes / {_SLOW} < 30 THEN 'under_30m' WHEN age_minutes / {_SLOW} < 60 THEN '30m_to_1h' WHEN age_minutes / {_SLOW} < 180 THEN '1h_to_3h' WHEN age_minutes / {_SLOW} < 360 THEN '3h_to_6h' WHEN age_minutes / {_SLOW} < 720 THEN '6h_to_12h' WHEN age_minutes / {_SLOW} < 1440 THEN '12h_to_24h' ELSE 'over_24h' END"
MOVED_SQL = (
    STATES_SQL
    + f""", fv(s, k) AS (VALUES {', '.join(f"('{x}', {i})" for i, x in enumerate(STATES))}), ag(i, age_bucket) AS (VALUES {', '.join(f"({i}, '{x}')" for i, x in enumerate(flows.AGES))}),
mv AS (SELECT *, CASE WHEN nx IN ({_FIVE}) THEN nx END AS next_state FROM (SELECT community, post_id, snapshot_no, 't' || CAST(post_id % 2 AS VARCHAR) AS topic, state, upvotes, comment_velocity, {_AGE} AS age_bucket, CASE WHEN coalesce(upvote_velocity, 0) >= surging_upvotes THEN 'high' WHEN coalesce(upvote_velocity, 0) >= alive_upvotes THEN 'med' ELSE 'low' END AS velocity_bucket,
  CASE WHEN lead(snapshot_no) OVER o = next_no THEN lead(state) OVER o END AS nx FROM st WINDOW o AS (PARTITION BY community, post_id ORDER BY hours, snapshot_no)) WHERE state IN ({_FIVE}))"""
)
MATRIX_SQL = """sp(v, j) AS (VALUES ('low', 0), ('med', 1), ('high', 2)), mc AS (SELECT community, age_bucket, velocity_bucket, state, next_state, count(*) AS n FROM mv WHERE next_state IS NOT NULL GROUP BY ALL),
mg AS (SELECT c.community, ag.i, ag.age_bucket, sp.j, a.s AS state, b.s AS next_state, coalesce((SELECT n FROM mc WHERE mc.community = c.community AND mc.age_bucket = ag.age_bucket AND mc.velocity_bucket = sp.v AND mc.state = a.s AND mc.next_state = b.s), 0) AS n1,
  coalesce((SELECT sum(n) FROM mc WHERE mc.community = c.community AND mc.age_bucket = ag.age_bucket AND mc.state = a.s AND mc.next_state = b.s), 0) AS n2, coalesce((SELECT sum(n) FROM mc WHERE mc.age_bucket = ag.age_bucket AND mc.state = a.s AND mc.next_state = b.s), 0) AS n3
  FROM (SELECT DISTINCT community FROM mv) c CROSS JOIN ag CROSS JOIN sp CROSS JOIN fv a CROSS JOIN fv b),
mx AS (SELECT community, i, j, state, next_state, CASE WHEN sum(n1) OVER w >= 10 THEN n1 / sum(n1) OVER w WHEN sum(n2) OVER w >= 10 THEN n2 / sum(n2) OVER w WHEN sum(n3) OVER w > 0 THEN n3 / sum(n3) OVER w ELSE 0.2 END::DOUBLE AS q FROM mg WINDOW w AS (PARTITION BY community, i, j, state))"""


def _shift(p: str, m: str, over: str) -> str:
    """A distribution's rows moved by a multiplier."""
    up = f"CASE WHEN s IN ('surging', 'alive') THEN {p} * {m} ELSE {p} / greatest({m}, 0.1::DOUBLE) END"
    return f"CASE WHEN {m} = 1 THEN {p} ELSE ({up}) / sum({up}) OVER (PARTITION BY {over}) END"


_START = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in flows.UNKNOWN_START.items())
_SCENARIOS = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in flows.SCENARIOS.items())
START_SQL = f"""un(s, p) AS (VALUES {_START}), tp AS (SELECT DISTINCT topic, community FROM mv), e0 AS (SELECT tp.topic, tp.community, fv.s, count(mv.state) AS n FROM tp CROSS JOIN fv LEFT JOIN mv ON mv.topic = tp.topic AND mv.community = tp.community AND mv.state = fv.s AND mv.age_bucket IN ('under_30m', '30m_to_1h') GROUP BY ALL),
e1 AS (SELECT e0.topic, e0.community, e0.s, CASE WHEN sum(n) OVER w >= 5 THEN n / sum(n) OVER w ELSE un.p END AS p FROM e0 JOIN un USING (s) WINDOW w AS (PARTITION BY topic, community))"""


def heat(m):
    return pulse.live_heat(m, "snapshot_no", ["topic", "community"])


def mood(s, d):
    p = profiles(s, d).withColumns({"topic": F.concat(F.lit("t"), (F.col("post_id") % 2).cast("string")), "community": F.col("post_id") % 5})
    return discussion.sentiment_signal(p, ["topic", "community"])


def flow_rollout(s, d):
    m = moved(s, d)
    return flows.flow_forecast(m, heat(m), mood(s, d))


query(
    "flow_rollout",
    f"""WITH RECURSIVE {MOVED_SQL}, {MATRIX_SQL}, {START_SQL}, {PROFILE_SQL}, sg AS (SELECT 't' || CAST(post_id % 2 AS VARCHAR) AS topic, post_id % 5 AS community, avg(coalesce(sentiment_weighted, sentiment_mean)) AS a FROM pf GROUP BY 1, 2),
sx AS (SELECT topic, community, CASE WHEN a IS NULL THEN 1.0 WHEN a > 0.15 THEN 1.3 WHEN a > 0.05 THEN 1.1 WHEN a < -0.15 THEN 0.7 WHEN a < -0.05 THEN 0.9 ELSE 1.0 END::DOUBLE AS mood FROM sg),
ht AS (SELECT topic, community, CASE WHEN count(*) FILTER (snapshot_no = m) >= 3 AND avg(CAST(state IN ('surging', 'alive') AS INT)) > 0 THEN avg(CAST(state IN ('surging', 'alive') AS INT)) FILTER (snapshot_no = m) / avg(CAST(state IN ('surging', 'alive') AS INT)) ELSE 1.0 END::DOUBLE AS heat FROM mv, (SELECT max(snapshot_no) AS m FROM mv) GROUP BY 1, 2),
s1 AS (SELECT e1.topic, e1.community, e1.s, {_shift("p", "coalesce(heat, 1)", "e1.topic, e1.community")} AS p, coalesce(mood, 1) AS mood FROM e1 LEFT JOIN ht ON ht.topic = e1.topic AND ht.community = e1.community LEFT JOIN sx ON sx.topic = e1.topic AND sx.community = e1.community),
s2 AS (SELECT topic, community, sc.scenario, s, {_shift("p", "sc.x", "topic, community, sc.scenario")} AS p, mood FROM s1 CROSS JOIN (VALUES {_SCENARIOS}) sc(scenario, x)),
s3 AS (SELECT topic, community, scenario, s, {_shift("p", "mood", "topic, community, scenario")} AS p FROM s2),
r AS (SELECT topic, community, scenario, -1 AS step, s AS state, p FROM s3 UNION ALL SELECT * FROM (SELECT r.topic, r.community, r.scenario, r.step + 1 AS step, m.next_state AS state, sum(r.p * m.q) AS p FROM r JOIN mx m ON m.community = r.community AND m.i = r.step + 1 AND m.j = 1 AND m.state = r.state GROUP BY ALL))
SELECT topic, community, scenario, CAST(step AS INT) AS step, age_bucket, state, round(p, 6) + 0.0 AS p FROM r JOIN ag ON ag.i = step""",
)(lambda s, d: rounded(flow_rollout(s, d)))


def latest(m):
    """Each post's last row with one of the five states."""
    last = m.groupBy("community", "post_id").agg(F.max_by(F.struct("topic", "state", "upvotes", "comment_velocity"), "snapshot_no").alias("x"))
    return last.select("community", "post_id", "x.*")


def flow_anchored(s, d):
    m = moved(s, d)
    return flows.anchored_forecast(m, latest(m))


_ANCHOR = " ".join(f"WHEN band = {b} AND s = '{k}' THEN {v}" for b, t in ((2, flows.ABOVE), (0, flows.BELOW)) for k, v in t.items())
query(
    "flow_anchored",
    f"""WITH RECURSIVE {MOVED_SQL}, {MATRIX_SQL}, tm AS (SELECT topic, community, avg(coalesce(upvotes, 0)) AS u, avg(coalesce(comment_velocity, 0)) AS c FROM mv GROUP BY 1, 2),
la AS (SELECT community, post_id, arg_max(topic, snapshot_no) AS topic, arg_max(state, snapshot_no) AS state, max_by(struct_pack(u := upvotes, c := comment_velocity), snapshot_no) AS x FROM mv GROUP BY 1, 2),
pf AS (SELECT la.*, (CASE WHEN u > 0 THEN coalesce(nullif(x.u, 0), u) / u ELSE 1 END + CASE WHEN tm.c > 0 THEN coalesce(nullif(x.c, 0), tm.c) / tm.c ELSE 1 END) / 2 AS performance FROM la JOIN tm ON tm.topic = la.topic AND tm.community = la.community),
pb AS (SELECT *, CASE WHEN performance >= 2 THEN 2 WHEN performance <= 0.5 THEN 0 ELSE 1 END AS band FROM pf),
k0 AS (SELECT DISTINCT community, state AS anchor, band FROM pb), k1 AS (SELECT community, anchor, band, s, (CASE WHEN s = anchor THEN 0.8 ELSE 0.02 END + CASE {_ANCHOR} ELSE 0 END)::DOUBLE AS w FROM k0 CROSS JOIN fv),
k2 AS (SELECT community, anchor, band, s, greatest(w, 0) / sum(w) OVER (PARTITION BY community, anchor, band) AS p FROM k1),
r AS (SELECT community, anchor, band, -1 AS step, s AS state, p FROM k2 UNION ALL SELECT * FROM (SELECT r.community, r.anchor, r.band, r.step + 1 AS step, m.next_state AS state, sum(r.p * m.q) AS p FROM r JOIN mx m ON m.community = r.community AND m.i = r.step + 1 AND m.j = CASE WHEN band = 2 AND r.step + 1 > 3 THEN 1 ELSE band END AND m.state = r.state GROUP BY ALL)),
o AS (SELECT community, anchor, band, step, first(state ORDER BY round(p, 12) DESC, k) AS likely, sum(CASE WHEN state IN ('surging', 'alive') THEN p END) AS a FROM r JOIN fv ON fv.s = r.state WHERE step >= 0 GROUP BY ALL),
oo AS (SELECT community, anchor, band, string_agg(likely, '>' ORDER BY step) AS outlook, max(CASE WHEN step = 6 THEN a END) AS p_active FROM o GROUP BY ALL)
SELECT post_id, topic, pb.community, state AS anchor_state, {_r('performance')}, outlook, {_r('p_active')} FROM pb JOIN oo ON oo.community = pb.community AND oo.anchor = pb.state AND oo.band = pb.band""",
)(lambda s, d: rounded(flow_anchored(s, d)))

query(
    "flow_by_community",
    f"""WITH RECURSIVE {MOVED_SQL}, tc AS (SELECT community, topic, count(*) AS n FROM mv WHERE next_state IS NOT NULL GROUP BY 1, 2), tb AS (SELECT community, first(topic ORDER BY n DESC, topic) AS topic FROM tc GROUP BY 1),
e0 AS (SELECT tb.community, tb.topic, fv.s, count(CASE WHEN age_bucket IN ('under_30m', '30m_to_1h') THEN 1 END) AS e, count(mv.state) AS n FROM tb CROSS JOIN fv LEFT JOIN mv ON mv.topic = tb.topic AND mv.community = tb.community AND mv.state = fv.s GROUP BY ALL),
e1 AS (SELECT community, topic, s, CASE WHEN sum(e) OVER w > 0 THEN e / sum(e) OVER w ELSE n / sum(n) OVER w END AS p FROM e0 WINDOW w AS (PARTITION BY community)),
mc AS (SELECT community, topic, age_bucket, state, next_state, count(*) AS n FROM mv WHERE next_state IS NOT NULL GROUP BY ALL),
mg AS (SELECT tb.community, ag.i, a.s AS state, b.s AS next_state, coalesce((SELECT n FROM mc WHERE mc.community = tb.community AND mc.topic = tb.topic AND mc.age_bucket = ag.age_bucket AND mc.state = a.s AND mc.next_state = b.s), 0) AS n1,
  coalesce((SELECT sum(n) FROM mc WHERE mc.age_bucket = ag.age_bucket AND mc.state = a.s AND mc.next_state = b.s), 0) AS n3 FROM tb CROSS JOIN ag CROSS JOIN fv a CROSS JOIN fv b),
mx AS (SELECT *, CASE WHEN sum(n1) OVER w >= 10 THEN n1 / sum(n1) OVER w WHEN sum(n3) OVER w > 0 THEN n3 / sum(n3) OVER w ELSE 0.2 END::DOUBLE AS q FROM mg WINDOW w AS (PARTITION BY community, i, state)),
r AS (SELECT community, topic, -1 AS step, s AS state, p FROM e1 UNION ALL SELECT * FROM (SELECT r.community, r.topic, r.step + 1 AS step, m.next_state AS state, sum(r.p * m.q) AS p FROM r JOIN mx m ON m.community = r.community AND m.i = r.step + 1 AND m.state = r.state GROUP BY ALL))
SELECT community, topic, CAST(step AS INT) AS step, age_bucket, state, {_r('p')} FROM r JOIN ag ON ag.i = step""",
)(lambda s, d: rounded(flows.busiest_flows(moved(s, d))))


def last_seen(s, d):
    """Each post's last upvotes, its community by name and the weighted mean sentiment of its comments."""
    name = F.element_at(F.array(*map(F.lit, _COMMUNITIES)), (F.col("community") + 1).cast("int"))
    p = fx.post_snapshots(s, d).groupBy("community", "post_id").agg((F.max_by("upvotes", "snapshot_no") / 10).alias("upvotes")).withColumn("community", name)
    c = profiles(s, d).groupBy("post_id").agg(F.avg("sentiment_weighted").alias("sentiment"))
    return p.join(c, "post_id", "left")


_M = ", ".join(f"('{a}', '{b}', {flows.TRANSITIONS[a][b]}::DOUBLE)" for a in STATES for b in STATES)
_TRAJECTORY = f"""tr(a, b, q) AS (VALUES {_M}), fv(s) AS (VALUES {', '.join(f"('{x}')" for x in STATES)}), r AS (SELECT a.s AS start_state, 0 AS step, b.s AS state, CASE WHEN a.s = b.s THEN 1.0 ELSE 0.0 END::DOUBLE AS p FROM fv a CROSS JOIN fv b
UNION ALL SELECT * FROM (SELECT start_state, step + 1 AS step, tr.b AS state, sum(CASE WHEN p < 0.001 THEN 0 ELSE p * q END) AS p FROM r JOIN tr ON tr.a = r.state WHERE step < 12 GROUP BY ALL))"""
query("fixed_trajectories", f"WITH RECURSIVE {_TRAJECTORY}, dx AS (SELECT count(*) AS n_posts, CASE WHEN m >= 200 THEN 'surging' WHEN m >= 50 THEN 'alive' WHEN m >= 10 THEN 'cooling' ELSE 'dying' END AS start_state FROM (SELECT user_id, floor(sum(value) / 10) AS m FROM events GROUP BY 1) GROUP BY 2) SELECT r.start_state, CAST(step AS INT) AS step, any_value(n_posts) AS n_posts, " + ", ".join(f"round(max(CASE WHEN state = '{x}' THEN p END), 6) + 0.0 AS {x}" for x in STATES) + " FROM r JOIN dx ON dx.start_state = r.start_state GROUP BY 1, 2")(
    lambda s, d: rounded(
        flows.fixed_trajectories(s).join(fx.table(s, d, "events").groupBy("user_id").agg(F.floor(F.sum("value") / 10).alias("m")).groupBy(scores.early_state(F.col("m")).alias("start_state")).agg(F.count(F.lit(1)).alias("n_posts")), "start_state").select("start_state", "step", "n_posts", *STATES)
    )
)
_GROWTH = "CASE " + " ".join(f"WHEN community = '{c}' THEN CASE " + " ".join(f"WHEN up <= {b} THEN {m}" for b, m in list(t.items())[:-1]) + f" ELSE {list(t.values())[-1]} END" for c, t in {**flows.GROWTH, "elsewhere": flows.GROWTH["news"]}.items()) + " END::DOUBLE"
_hours = lambda t: "CASE " + " ".join(f"WHEN community = '{c}' THEN {h}" for c, h in t.items()) + " ELSE 24 END::DOUBLE"
_scaled = lambda t, a, b: f"CASE WHEN start_state = 'surging' THEN round_even({_hours(t)} * {a}::DOUBLE, 0) WHEN start_state = 'dying' THEN round_even({_hours(t)} * {b}::DOUBLE, 0) ELSE {_hours(t)} END"
query(
    "post_outcomes",
    f"""WITH RECURSIVE {_TRAJECTORY}, {PROFILE_SQL}, fy AS (SELECT post_id, community, arg_max(upvotes, snapshot_no) / 10 AS u FROM (SELECT CAST((day(ts) - 1) * 4 + floor(hour(ts) / 6.0) AS INT) AS snapshot_no, user_id AS post_id, user_id % 5 AS community, round(sum(sum(value)) OVER (PARTITION BY user_id ORDER BY CAST((day(ts) - 1) * 4 + floor(hour(ts) / 6.0) AS INT)), 4) AS upvotes FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2),
sc2 AS (SELECT post_id, avg(sentiment_weighted) AS sentiment FROM pf GROUP BY 1), p0 AS (SELECT fy.post_id, list_extract([{', '.join(f"'{c}'" for c in _COMMUNITIES)}], CAST(community AS INT) + 1) AS community, floor(u) AS up, sentiment FROM fy LEFT JOIN sc2 ON sc2.post_id = fy.post_id),
p1 AS (SELECT *, CASE WHEN up >= 200 THEN 'surging' WHEN up >= 50 THEN 'alive' WHEN up >= 10 THEN 'cooling' ELSE 'dying' END AS start_state FROM p0), mid AS (SELECT start_state, round_even(sum(CASE WHEN state IN ('surging', 'alive') THEN p END), 3) AS pop, round_even(sum(CASE WHEN state IN ('dying', 'dead') THEN p END), 3) AS flop FROM r WHERE step = 6 GROUP BY 1),
p2 AS (SELECT p1.*, CASE WHEN sentiment < -0.15 THEN least(0.99::DOUBLE, pop * 1.1::DOUBLE) ELSE pop END AS pop_probability, flop AS flop_probability, {_GROWTH} AS growth_multiplier FROM p1 JOIN mid ON mid.start_state = p1.start_state), p3 AS (SELECT *, round_even(up * growth_multiplier, 0) AS estimated_peak FROM p2)
SELECT post_id, community, start_state, {_r('pop_probability', 'flop_probability')}, CASE WHEN pop_probability >= 0.6 THEN 'LIKELY TO POP' WHEN pop_probability >= 0.4 THEN 'COIN FLIP' WHEN pop_probability >= 0.2 THEN 'PROBABLY FLOPS' ELSE 'DEAD ON ARRIVAL' END AS verdict, growth_multiplier, estimated_peak,
  round_even(estimated_peak * 0.3::DOUBLE, 0) AS peak_low, round_even(estimated_peak * 3, 0) AS peak_high, {_scaled(flows.ALIVE_HOURS, 1.5, 0.3)} AS alive_hours, {_scaled(flows.PEAK_HOURS, 0.8, 0.5)} AS peak_hour,
  CASE WHEN sentiment IS NULL THEN 'no data' WHEN sentiment < -0.15 THEN 'controversial - may boost engagement' WHEN sentiment > 0.15 THEN 'positive - standard trajectory' ELSE 'neutral' END AS sentiment_effect FROM p3""",
)(lambda s, d: rounded(flows.outcome_forecast(last_seen(s, d))))

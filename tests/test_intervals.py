"""Golden cases of intervals and possession, and random games against a second-by-second count."""

import random

import pytest
from pyspark.sql import functions as F

from shiftframe.operators import intervals as I
from shiftframe.operators import buckets, totals
from shiftframe.operators import possession as P

SHIFT = "game_id long, player_id long, team_id long, position string, shift_start long, shift_end long"
PLAY = "event_id long, game_id long, time long, event string, team_id_for long, team_id_against long"


def game(spark, rows):
    return spark.createDataFrame([(1, p, t, "F", s, e) for p, t, s, e in rows], SHIFT)


def five_a_side(gone=(40, 60)):
    rows = [(k, 0, 0, 100) for k in range(4)] + [(10 + k, 1, 0, 100) for k in range(5)]
    return rows + [(4, 0, 0, gone[0]), (4, 0, gone[1], 100)]


def timeline_rows(df):
    return [(r.time, r.team_1, r.team_2, r.exclude) for r in df.orderBy("time").collect()]


def test_one_skater_off(spark):
    own = game(spark, five_a_side())
    assert timeline_rows(I.strength_timeline(own)) == [(0, 5, 5, False), (40, 4, 5, True), (60, 5, 5, False), (100, 0, 0, False)]
    assert [(r.ex_start, r.ex_end) for r in I.exclude_intervals(I.strength_timeline(own)).collect()] == [(40, 60)]


@pytest.mark.parametrize(("side", "kept"), [("right", [39, 60]), ("left", [39, 40])])
def test_side_of_a_breakpoint(spark, side, kept):
    shots = spark.createDataFrame([(t, 1, t, "Shot", 0, 1) for t in (39, 40, 60)], PLAY)
    found = I.equal_strength_plays(shots, I.strength_timeline(game(spark, five_a_side())), side)
    assert sorted(r.time for r in found.collect()) == kept


def test_overlapping_shifts(spark):
    own = game(spark, [(1, 0, 0, 30), (1, 0, 20, 50), (2, 1, 0, 50)])
    even = I.strength_timeline(own).where("false")
    merged = {r.player_id: r.toi_sec for r in I.equal_strength_toi(own, even, P.KEYS).collect()}
    apart = {r.player_id: r.toi_sec for r in I.equal_strength_toi(own, even, P.KEYS, merge=False).collect()}
    assert (merged[1], apart[1]) == (50, 60)
    shot = spark.createDataFrame([(1, 1, 25, "Shot", 0, 1)], PLAY)
    assert I.on_ice(shot, own).where("player_id = 1").count() == 1


@pytest.mark.parametrize(("closed", "n"), [(False, 0), (True, 1)])
def test_last_second(spark, closed, n):
    shot = spark.createDataFrame([(1, 1, 30, "Shot", 0, 1)], PLAY)
    assert I.on_ice(shot, game(spark, [(1, 0, 0, 30)]), closed).count() == n


def test_seven_skaters_are_not_excluded(spark):
    rows = [(k, 0, 0, 50) for k in range(5)] + [(10 + k, 1, 0, 50) for k in range(6)] + [(20, 1, 20, 50)]
    assert timeline_rows(I.strength_timeline(game(spark, rows))) == [(0, 5, 6, True), (20, 5, 7, False), (50, 0, 0, False)]


def test_small_rows_keep_their_tasks(spark):
    """Spark would put what packs to a few bytes into one task."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    timeline = I.strength_timeline(game(spark, five_a_side()))
    shots = spark.createDataFrame([(t, 1, t, "Shot", 0, 1) for t in (39, 40, 60)], PLAY)
    assert timeline.rdd.getNumPartitions() == n
    assert I.merge_intervals(game(spark, five_a_side()), P.KEYS).rdd.getNumPartitions() == n
    plan = I.asof_last(shots, timeline, F.col("exclude"), "x")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2


def test_blocked_shots_count_for_the_other_side(spark):
    shot = spark.createDataFrame([(1, 1, 10, "Blocked Shot", 0, 1)], PLAY)
    rows = {r.player_id: (r.cf, r.ca) for r in P.attempts_for_and_against(shot, game(spark, [(1, 0, 0, 30), (2, 1, 0, 30)])).collect()}
    assert rows == {1: (0, 1), 2: (1, 0)}


def test_three_teams_exclude_nothing(spark):
    own = game(spark, [(1, 0, 0, 30), (2, 1, 0, 20), (3, 2, 0, 30)])
    assert I.strength_timeline(own).count() == 0
    shot = spark.createDataFrame([(1, 1, 25, "Shot", 0, 1)], PLAY)
    assert I.equal_strength_plays(shot, I.strength_timeline(own)).count() == 1


def test_play_before_the_first_change(spark):
    own = game(spark, [(1, 0, 10, 30), (2, 1, 10, 30), (3, 1, 10, 20)])
    shot = spark.createDataFrame([(1, 1, 5, "Shot", 0, 1)], PLAY)
    assert I.equal_strength_plays(shot, I.strength_timeline(own)).count() == 0


def test_players_without_events(spark):
    own, shot = game(spark, [(1, 0, 0, 30), (2, 1, 0, 30)]), spark.createDataFrame([(1, 1, 29, "Shot", 5, 6)], PLAY)
    es = {r.player_id: r for r in P.player_game_es(own, shot).collect()}
    stats = {r.player_id: r for r in P.player_game_stats(own, shot).collect()}
    assert (es[1].cf, es[1].ca, es[1].cf_percent, stats[1].cf_percent) == (0, 0, 0.0, None)


def test_null_position(spark):
    own = spark.createDataFrame([(1, 1, 0, None, 0, 9), (1, 2, 0, "G", 0, 9), (1, 3, 0, "D", 0, 9)], SHIFT)
    assert sorted(r.player_id for r in I.goalies_dropped(own).collect()) == [1, 3]
    assert sorted(r.player_id for r in I.goalies_dropped(own, keep_unknown=False).collect()) == [3]


def test_goalies_stay_as_seeds(spark):
    own = game(spark, [(1, 0, 0, 3000), (2, 0, 0, 30), (3, 1, 0, 30)])
    rows = {r.player_id: r.corsi_for for r in P.corsi(own, spark.createDataFrame([(1, 1, 20, "Shot", 0, 1)], PLAY)).collect()}
    assert rows == {1: 0, 2: 1, 3: 0}


def slow_toi(rows):
    """Equal-strength seconds by player, counted second by second."""
    teams = sorted({t for _, t, _, _ in rows})
    out = dict.fromkeys(((p, t) for p, t, _, _ in rows), 0)
    times = sorted({x for _, _, s, e in rows for x in (s, e)})
    for second in range(times[0], times[-1]):
        on = [(p, t) for p, t, s, e in rows if s <= second < e]
        n = [sum(t == team for _, t in on) for team in teams]
        first = [min(s for _, t, s, _ in rows if t == team) for team in teams]
        n = [x if second >= f else sum(1 for _, t, s, _ in rows if t == team and s == f) for x, f, team in zip(n, first, teams, strict=True)]
        if not (len(teams) == 2 and n[0] != n[1] and max(n) <= 6):
            for key in set(on):
                out[key] += 1
    return out


def test_random_games_second_by_second(spark):
    rng, games = random.Random(4), {}
    for g in range(40):
        starts = [(rng.randrange(12), rng.randrange(60)) for _ in range(rng.randrange(4, 40))]
        games[g] = [(p, p % 2, s, s + rng.randrange(1, 25)) for p, s in starts]
    rows = spark.createDataFrame([(g, p, t, "F", s, e) for g, own in games.items() for p, t, s, e in own], SHIFT)
    found = {(r.game_id, r.player_id, r.team_id): r.toi_sec for r in I.equal_strength_toi(rows, I.strength_timeline(rows), P.KEYS).collect()}
    assert found == {(g, *k): n for g, own in games.items() for k, n in slow_toi(own).items()}


def test_invariants(spark):
    from shiftframe.plans import views

    folder = "/root/testdata/sf0.001"
    rows = P.player_game_stats(views.shifts(spark, folder), views.plays(spark, folder), P.PossessionPolicy(merge=True))
    assert rows.where("toi_es_sec > toi_total_sec OR toi_es_sec < 0").count() == 0
    assert rows.groupBy(*P.KEYS).count().where("count > 1").count() == 0
    assert rows.agg(F.sum("cf")).first()[0] > 0


def test_attempts_of_a_player_with_two_teams(spark):
    """By default the team of the shift gets them; by the stats policy every row of the player does."""
    own = game(spark, [*five_a_side((100, 100)), (9, 0, 0, 10), (9, 1, 10, 100)]).where("player_id <> 4 and player_id <> 14")
    shot = spark.createDataFrame([(1, 1, 50, "Shot", 1, 0)], PLAY)
    count = lambda keys: sorted((r.player_id, r.cf) for r in P.attempts_for_and_against(shot, own, True, keys).where("player_id = 9").collect())
    assert count(P.KEYS) == count(P.KEYS[:2]) == [(9, 1)]
    rows = lambda by_team: {r.team_id: r.cf for r in P.player_game_stats(own, shot, P.PossessionPolicy(closed=True, merge=False, by_team=by_team)).where("player_id = 9").collect()}
    by_team, by_player = rows(True), rows(False)
    assert set(by_team) == {0, 1} and by_team[0] == 0 and by_player[0] == by_player[1] == by_team[1]


def test_totals_with_and_without_goals(spark):
    plays = spark.createDataFrame([(1, 1, 5, e, 0, 1) for e in ("Shot", "Goal", "Missed Shot", "Hit")], PLAY)
    assert {r.team_id: (r.cf, r.ca) for r in totals.season_attempts(plays).collect()} == {0: (3, 0), 1: (0, 3)}
    assert {r.team_id: (r.cf, r.ca) for r in totals.season_attempts(plays, goals=False).collect()} == {0: (2, 0), 1: (0, 2)}


def test_a_game_for_two_teams_counts_twice(spark):
    rows = spark.createDataFrame([(1, 7, 5, 9, 1, 1, 60), (1, 7, 6, 9, 1, 1, 30), (1, 8, 5, 9, 1, 1, 60)], "season long, game_id long, team_id long, player_id long, cf long, ca long, toi_es_sec long")
    found = totals.aggregated_corsi(rows).first()
    assert (found.game_count, found.multi_team, found.team_id) == (3, True, 5)


def test_role_shares_without_the_unknown_sum_to_less(spark):
    rows = spark.createDataFrame([(1, "F0", 50), (1, "D1", 30), (1, "UNK", 20)], "season long, cell string, toi long")
    shares = rows.withColumn("share", buckets.share_over(F.col("toi"), ["season"])).groupBy("season").pivot("cell", ["F0", "D1"]).agg(F.sum("share")).first()
    assert shares.F0 + shares.D1 == pytest.approx(0.8)


@pytest.fixture(scope="module")
def crowded(spark):
    """A game with far more shifts and plays than seconds, beside small ones with the same rules."""
    random.seed(11)
    shifts = [(1, k % 40, k % 2, "F", s, s + random.randint(0, 70)) for k in range(20_000) for s in [random.randint(0, 3500)]]
    shifts += [(g, k % 7, k % 2, "F", s, s + random.randint(0, 70)) for g in (2, 3) for k in range(30) for s in [random.randint(0, 300)]]
    shifts += [(2, 5, 1, "F", 0, 100_000), (3, 6, 0, "F", -50, 5000)]
    plays = [(k, 1 if k % 3 else 2 + k % 2, random.randint(-5, 3600), "Shot", k % 2, 1 - k % 2) for k in range(600)]
    return spark.createDataFrame(shifts, SHIFT).repartition(8).persist(), spark.createDataFrame(plays, PLAY).repartition(3).persist()


@pytest.mark.parametrize("closed", [False, True])
def test_crowded_game_on_ice(crowded, closed):
    shifts, plays = crowded
    found = {(r.game_id, r.event_id, r.player_id, r.team_id, r.is_for) for r in I.on_ice(plays, shifts, closed).collect()}
    rows = shifts.collect()
    want = {(p.game_id, p.event_id, s.player_id, s.team_id, s.team_id == p.team_id_for) for p in plays.collect() for s in rows if s.game_id == p.game_id and s.shift_start <= p.time and (p.time <= s.shift_end if closed else p.time < s.shift_end)}
    assert found == want


def test_plays_meet_only_shifts_near_them(crowded):
    shifts, plays = crowded
    met = I.met_on_clock(plays, shifts, ["game_id"]).count()
    inside = plays.join(shifts, "game_id").where("shift_start <= time and time < shift_end").count()
    assert met < 6 * inside < plays.join(shifts, "game_id").count() / 10


def test_crowded_game_by_the_second(crowded):
    """Timeline, as-of flags and seconds against counts of every second; no window holds more than a game's seconds."""
    import numpy as np

    shifts, plays = crowded
    small = shifts.where("game_id <> 2")  # its one endless shift has no end within the counted seconds
    timeline = I.strength_timeline(small).persist()
    kept = {r.event_id for r in I.equal_strength_plays(plays.where("game_id <> 2"), timeline).collect()}
    toi = {(r.game_id, r.player_id, r.team_id): r.toi_sec for r in I.equal_strength_toi(small, timeline, P.KEYS).collect()}
    assert timeline.groupBy("game_id").count().agg(F.max("count")).first()[0] <= 3600
    for g in (1, 3):
        rows, n, at = [r for r in small.collect() if r.game_id == g], np.zeros((2, 6000), int), lambda t: t + 60
        for r in rows:
            n[r.team_id, at(r.shift_start) : at(r.shift_end)] += 1
        first = [min(r.shift_start for r in rows if r.team_id == t) for t in (0, 1)]
        for t in (0, 1):  # until its first change a team has its first count
            n[t, : at(first[t])] = n[t, at(first[t])]
        begin, end = min(first), max(r.shift_end for r in rows)
        out = (n[0] != n[1]) & (n[0] <= 6) & (n[1] <= 6)
        out[: at(begin)], out[at(end) :] = out[at(begin)], False
        assert {p.event_id for p in plays.collect() if p.game_id == g and not out[at(p.time)]} == {e for e in kept if e in {p.event_id for p in plays.collect() if p.game_id == g}}
        for player, team in {(r.player_id, r.team_id) for r in rows}:
            on = np.zeros(6000, bool)
            for r in rows:
                if (r.player_id, r.team_id) == (player, team):
                    on[at(r.shift_start) : at(r.shift_end)] = True
            assert toi[g, player, team] == int((on & ~out).sum())

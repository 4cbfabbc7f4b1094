"""Functions and operators on small tables."""

from difflib import SequenceMatcher

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shiftframe.functions import names, parse
from shiftframe.operators import buckets, checks, features, grouping, lines, ordering, roster, transitions, upsert
from shiftframe.plans import views
from shiftframe.sources import catalogs, files, paged
from shiftframe.sources.tables import table
from shiftframe.streaming import replay

DATA = "/root/testdata/sf0.001"


def test_normal_names(spark):
    rows = spark.createDataFrame([("O'Regan",), ("J.T. Brown",), ("Bérubé",), (None,), ("",), ("Jean-Luc  d'Or",), ("Erik Černák",), ("Ryan O’Reilly",), ("J. T. Miller",), ("Bo (X)Ray",), ("Eﬁ Ⅸa",)], "n string")
    found = [(r[0], r[1], r[2]) for r in rows.select(names.normalize_name(F.col("n")), names.normalize_name_strict(F.col("n")), names.normalize_name_strict(F.col("n"), accents=False)).collect()]
    assert [r[0] for r in found] == ["oregan", "jt brown", "berube", "", "", "jean luc dor", "erik cernak", "ryan oreilly", "jt miller", "bo x ray", "efi a"]
    assert [r[1] for r in found] == ["oregan", "jt brown", "berube", "", "", "jean luc dor", "erik cernak", "ryan oreilly", "jt miller", "bo xray", "efi a"]
    assert [r[2] for r in found][2:8] == ["brub", "", "", "jean luc dor", "erik ernk", "ryan oreilly"]


def test_every_decomposable_latin_letter_folds(spark):
    import unicodedata

    letters = [chr(c) for c in range(0xC0, 0x250) if chr(c).isalpha()]
    plain = ["".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x)).lower() for c in letters]
    want = [p for p in plain if p.isascii()]
    rows = spark.createDataFrame([(k, c) for k, (c, p) in enumerate(zip(letters, plain, strict=True)) if p.isascii()], "k int, c string")
    assert [r.f for r in rows.select("k", names.fold_accents(F.col("c")).alias("f")).orderBy("k").collect()] == want


def test_scores_aliases_and_variants(spark):
    pairs = [("bob smith", "bill smith", 0), ("matt smith", "matthew smith", 88), ("jean luc foudy", "jeanluc foudy", 92), ("jt miller", "john miller", 85), ("matt x smith", "matt y smith", 90), ("", "smith", 0), ("a b", "a b", 100), ("smith", "smyth", 0)]
    rows = spark.createDataFrame(pairs, "a string, b string, want int")
    assert all(r.got == r.want for r in rows.withColumn("got", names.name_score(F.col("a"), F.col("b"))).collect())
    people = spark.createDataFrame([("Theodor", "Blueger"), ("Theodor", "Smith"), ("Mats", "Zuccarello-Aasen")], "f string, l string")
    first, last = names.with_aliases(F.col("f"), F.col("l"))
    assert [tuple(r) for r in people.select(first, last).collect()] == [("teddy", "blueger"), ("Theodor", "Smith"), ("Mats", "zuccarello")]
    rows = spark.createDataFrame([("alexander", "Alexander Steen"), ("pierre", "Pierre-Alexandre Parenteau"), ("bo", None)], "f string, n string")
    found = [set(r[0]) for r in rows.select(names.first_name_variants(F.col("f"), F.col("n"))).collect()]
    assert found == [{"alexander", "alex", "ale", "sasha"}, {"pierre", "pier", "pie", "pa"}, {"bo"}]


def test_first_name_similarity_is_the_librarys(spark):
    pairs = [("matt", "matthew"), ("jon", "john"), ("al", "alan"), ("", "bob"), ("", ""), ("alan", "al"), ("bo", "bo"), ("nick", "dominick")]
    found = spark.createDataFrame(pairs, "a string, b string").select(names.first_name_similarity(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in found] == pytest.approx([1.0, SequenceMatcher(None, "jon", "john").ratio(), SequenceMatcher(None, "al", "alan").ratio(), 0.0, 0.0, 1.0, 1.0, SequenceMatcher(None, "nick", "dominick").ratio()])


def test_parsed_fields(spark):
    rows = spark.createDataFrame([('"$1,234"', "o'reilly  ryan", "/redirect/player/18?x"), (" $2.50 ", "JANIS..MOSER", "x/player/7/"), ("n/a", None, "/a/12#top"), ("-", "ole", "/player/x9")], "m string, n string, u string")
    first, last = parse.split_name(F.col("n"))
    found = [tuple(r) for r in rows.select(parse.money(F.col("m")), first, last, parse.title_case(F.col("n")), parse.url_id(F.col("u")), parse.path_id(F.col("u"))).collect()]
    assert found == [(1234.0, "o'reilly", "ryan", "O'Reilly Ryan", None, 18), (2.5, "JANIS..MOSER", "", "Janis Moser", 7, 7), (None, None, None, "", None, 12), (None, "ole", "", "Ole", None, None)]


def test_no_pair_across_a_gap(spark):
    rows = spark.createDataFrame([(1, 20182019, 0), (1, 20202021, 1), (1, 20212022, 2)], "player_id long, season long, cluster long")
    assert [(r.season, r.season_t1) for r in transitions.transition_pairs(rows).collect()] == [(20202021, 20212022)]


def test_dirichlet_rows(spark):
    pairs = spark.createDataFrame([("F", 0, 1), ("F", 0, 1), ("F", 1, 1)], "pos_group string, cluster long, cluster_t1 long")
    found = {(r.from_cluster, r.to_cluster): r.prob_mean for r in transitions.dirichlet(pairs).collect()}
    assert found[0, 1] == pytest.approx(3 / 5) and found[2, 0] == pytest.approx(1 / 3)
    assert all(sum(found[f, t] for t in range(3)) == pytest.approx(1) for f in range(3))


def test_flat_and_grouped_rolling_differ(spark):
    rows = spark.createDataFrame([(1, t, g, 10.0 * t + g) for t in (1, 2) for g in range(6)], "season long, team_id long, game_id long, cf double")
    order, keys = [F.col("game_id")], ["season", "team_id"]
    own = {(r.team_id, r.game_id): r.m for r in features.rolling_mean(rows, "cf", "m", order, keys, size=3, least=1).collect()}
    flat = {(r.team_id, r.game_id): r.m for r in features.rolling_mean_flat(rows, "cf", "m", order, keys, size=3, least=1).collect()}
    assert own[1, 0] is None and own[1, 2] == pytest.approx(10.5) and flat[1, 2] == pytest.approx(10.5)
    assert own[2, 0] is None and flat[2, 0] == pytest.approx((13 + 14) / 2)
    assert flat[2, 1] == pytest.approx((14 + 20) / 2) and own[2, 1] == pytest.approx(20)


def test_mode_ties_take_the_smallest(spark):
    rows = spark.createDataFrame([(1, 5), (1, 3), (1, 5), (1, 3), (1, None)], "player_id long, team_id long")
    assert [(r.team_id, r.n) for r in grouping.mode_by(rows, ["player_id"], "team_id").collect()] == [(3, 2)]


def test_ties_share_a_bucket(spark):
    rows = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 2, 3, 4, 5, 6)], "v double")
    found = [(r.v, r.b) for r in buckets.qcut(rows, "v", 4, "b").collect()]
    assert {b for v, b in found if v == 2} == {0} and max(b for _, b in found) == 3


def test_unique_guard(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2)], "k long, v long")
    with pytest.raises(PySparkException):
        grouping.require_unique(rows, ["k"]).collect()
    with pytest.raises(ValueError):
        checks.require(rows, ["k"])
    assert checks.require(rows, ["k", "v"], 2).count() == 2


def test_swap_of_an_unknown_player(spark):
    pool = spark.createDataFrame([(1, 20182019, 5, 100), (2, 20182019, 5, 90)], "player_id long, season long, team_id long, toi_es_sec long")
    assert [r.player_id for r in roster.swapped(pool, pool, 1, 99).collect()] == [2]
    assert sorted(r.player_id for r in roster.swapped(pool.where("player_id = 2"), pool, None, 1).collect()) == [1, 2]


def test_share_shift(spark):
    rows = spark.createDataFrame([(0.2, 0.1, 0.3)], "a double, b double, c double")
    total = F.lit(0.6)
    moved = lambda total, target, delta, **more: tuple(roster.with_shift(rows, list("abc"), total, target, delta, list("xyz"), **more).select(*"xyz").first())
    assert moved(total, 0, F.lit(0.1)) == pytest.approx((0.3, 0.1, 0.2))
    assert moved(total, 0, F.lit(0.35)) == pytest.approx((0.55, 0.05, 0.0))  # the donor's stock, then the third's
    assert moved(total, 0, F.lit(-0.5)) == pytest.approx((0.0, 0.1, 0.5))  # a loss goes wholly to the donor
    assert moved(F.lit(1.2), 1, F.lit(0.0)) == pytest.approx((0.4, 0.2, 0.6))  # scaled to the total
    assert moved(total, 2, F.lit(0.1), donor=2) == pytest.approx((0.1, 0.1, 0.4))  # a donor that is the target: the first other
    assert moved(F.lit(0.0), 0, F.lit(0.1)) == (0.0, 0.0, 0.0)


def test_a_model_row_counts_whole_or_not_at_all(spark):
    players = spark.createDataFrame([(k, "F", 0, 10) for k in range(5)], "player_id long, pos_group string, cluster long, toi_es_sec long")
    model = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 1.0, 2.0), (2, 0.5, None, 0.5), (3, float("nan"), 0.5, 0.5)], "player_id long, m0 double, m1 double, m2 double")
    matrix = spark.createDataFrame([("F", 0, k, p) for k, p in enumerate((0.7, 0.2, 0.1))], "pos_group string, from_cluster long, to_cluster long, prob_mean double")
    found = {r.player_id: (r.p0, r.p1, r.p2) for r in roster.next_role_probs(players, model, matrix).collect()}
    assert found[1] == pytest.approx((0.25, 0.25, 0.5)) and all(found[k] == pytest.approx((0.7, 0.2, 0.1)) for k in (0, 2, 3, 4))
    alone = roster.next_role_probs(players.withColumn("cluster", F.lit(2).cast("long")), model, matrix).where("player_id = 4").first()
    assert (alone.p0, alone.p1, alone.p2) == pytest.approx((1 / 3,) * 3)


def test_failures(spark):
    rows = spark.createDataFrame([(1, 10, 0.9, 0, 0.6), (2, 10, 0.1, 1, 0.6), (3, 11, 0.49, 1, 0.4), (4, 12, 0.51, 0, 0.7), (5, 13, 0.7, 0, 0.2), (6, 14, 0.8, 1, 0.5)], "k long, game long, p double, y int, s double")
    found = {r.k: (r.confident, r.near_even, r.dominant_loss) for r in roster.failures(rows, "p", "y", "s").collect()}
    assert found == {1: (True, False, True), 2: (True, False, False), 3: (False, True, False), 4: (False, True, True), 5: (False, False, False)}
    examples = [(r.category, r.k) for r in roster.failure_examples(roster.failures(rows, "p", "y", "s"), "p", "game", ["k"]).collect()]
    assert examples == [("High-Confidence Miss", 2), ("Close-Call Miss", 3), ("Possession-Dominant Loss", 4)]


def test_exact_quantiles_are_the_librarys(spark):
    import numpy as np

    values = np.round(np.random.default_rng(3).lognormal(0, 1, 3000), 2)
    rows = spark.createDataFrame([(k % 3, float(v)) for k, v in enumerate(values)] + [(0, None)], "g long, v double")
    points = [0.0, 0.013, 0.25, 0.5, 0.9, 1.0]
    for r in ordering.quantile_edges(rows, "v", points, ["g"]).collect():
        assert r.edges == pytest.approx(np.quantile(values[r.g :: 3], points).tolist())
    sums = ordering.sums_before(rows.where("v is not null").groupBy("v").agg(F.count("*").alias("n")), "v", ["n"]).collect()
    assert all(r.before_n == (values < r.v).sum() for r in sums)


def test_suffixes(spark):
    rows = spark.range(1, 60).select(grouping.duplicate_suffix(F.col("id")).alias("s")).collect()
    assert [rows[k].s for k in (0, 1, 2, 25, 26, 27)] == ["", "b", "c", "z", "aa", "ab"] and len({r.s for r in rows}) == 59


def test_match_rate(spark):
    a = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (None, 1)], "x long, y long")
    b = spark.createDataFrame([(1, 1), (1, 1), (1, 1), (3, 1), (None, 1)], "x long, y long")
    assert tuple(checks.match_rate(a, b, ["x", "y"]).first()) == (4, 5, 6)
    assert tuple(checks.match_rate(a.where("false"), b.where("false"), ["x", "y"]).first()) == (0, 0, 0)


def test_line_matchup(spark):
    rows = spark.createDataFrame([(1, 1, 5, 10, 5, 60), (1, 1, 5, 2, 1, 30), (1, 1, 6, 4, 8, 50), (1, 2, 5, 9, 9, 10)], "season long, game_id long, team_id long, cf long, ca long, toi long")
    found = {r.team_id: (r.team_cf, r.opp_cf, r.team_toi, r.opp_toi, round(r.team_cf_share, 4)) for r in lines.line_matchup(rows).collect()}
    assert found == {5: (12, 4, 90, 50, 0.6667), 6: (4, 12, 50, 90, 0.3333)}


def test_compositions_sum_to_100(spark):
    rows = roster.composition(views.player_seasons(spark, DATA), keys=["season"]).groupBy("season", "pos_group").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 100) < 0.05 for r in rows)


def test_lines_have_three(spark):
    found = lines.assign_lines(views.player_seasons(spark, DATA)).groupBy("season", "team_id", "line").count()
    assert found.where("count > 3").count() == 0


def test_upserts(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string"), spark.createDataFrame([(2, "b"), (3, "c")], "k long, v string")
    assert sorted(map(tuple, upsert.upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, upsert.fill_null(old, new, ["k"], "v").collect())) == [(1, "a"), (2, "b")]
    assert [r.k for r in upsert.guarded(spark.createDataFrame([(9, "a"), (1, "a")], "k long, v string"), old, "k", "v").collect()] == [1]
    path = str(tmp_path / "t")
    old.write.parquet(path)
    upsert.replace_table(upsert.upserted(spark.read.parquet(path), new, ["k"]), path)
    assert spark.read.parquet(path).count() == 3
    seasons = spark.createDataFrame([(20182019, 1), (20192020, 2)], "season long, v long")
    upsert.overwrite_seasons(seasons, str(tmp_path / "s"))
    upsert.overwrite_seasons(spark.createDataFrame([(20192020, 7)], "season long, v long"), str(tmp_path / "s"))
    assert sorted((r.season, r.v) for r in files.season_table(spark, str(tmp_path / "s"), [20182019, 20192020]).collect()) == [(20182019, 1), (20192020, 7)]


def test_files(spark, tmp_path):
    import zipfile

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("v", T.DoubleType())])
    for k in (1, 2):
        (tmp_path / f"p{k}.csv").write_text(f"id,v,more\n{k}, 1.5 ,x\nbad,,y\n")
    rows = files.csv_files(spark, str(tmp_path / "p*.csv"), schema)
    assert sorted((r.id, r.v, r.source_file) for r in rows.where("id is not null").collect()) == [(1, 1.5, "p1.csv"), (2, 1.5, "p2.csv")]
    with pytest.raises(ValueError):
        files.csv_files(spark, str(tmp_path / "p*.csv"), T.StructType([T.StructField("gone", T.LongType())]))
    (tmp_path / "p3.csv").write_text("v,more,id\n2,z,20\n")  # columns in another order
    assert sorted((r.id, r.v, r.source_file) for r in files.csv_files(spark, str(tmp_path / "p*.csv"), schema).where("id is not null").collect())[-1] == (20, 2.0, "p3.csv")
    (tmp_path / "p4.csv").write_text("id\n5\n")
    with pytest.raises(ValueError, match="p4.csv"):
        files.csv_files(spark, str(tmp_path / "p*.csv"), schema)
    assert files.csv_files(spark, str(tmp_path / "p*.csv"), schema, skip=True).where("id = 5").count() == 0
    assert files.csv_files(spark, str(tmp_path / "none*.csv"), schema).count() == 0
    files.write_csv(rows, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["id", "v", "source_file"]
    files.write_summary(rows.agg(F.count("*").alias("n")), str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "summary")).first().n == 4
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/plays.csv", "id,v\n7,2\n")
        z.writestr("__MACOSX/plays.csv", "junk")
    assert [tuple(r) for r in files.zipped_csv(spark, str(tmp_path / "*.zip"), "plays.csv", schema).collect()] == [(7, 2.0)]
    assert files.with_snake_headers(spark.createDataFrame([(1, 2)], ["shootCatches", "Game ID"])).columns == ["shoot_catches", "game_id"]
    with pytest.raises(ValueError):
        files.conform(spark.createDataFrame([(1.0,)], ["v"]), schema)


def test_catalog(spark):
    spark.createDataFrame([(1,)], ["k"]).createOrReplaceTempView("seen_20182019")
    assert catalogs.season_tables(spark, "seen") == {20182019: "seen_20182019"}
    assert catalogs.missing_relations(spark, {"seen_20182019": ["k", "gone"], "nowhere": []}) == ["seen_20182019.gone", "nowhere"]
    found = checks.run_checks(spark, {"a": "SELECT ';' AS x; -- note\nSELECT count(*) AS n FROM seen_20182019", "b": "SELECT * FROM nowhere"})
    assert [o.error is None for o in found] == [True, True, False] and found[1].rows[0].n == 1


def test_inputs_go_only_after_success(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"in{k}.csv").write_text("a\n1\n")

    def fails():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        files.consumed(spark, [f"{tmp_path}/in*.csv"], fails)
    assert len(list(tmp_path.glob("*.csv"))) == 2
    done = files.consumed(spark, [f"{tmp_path}/in*.csv"], lambda: spark.read.csv(f"{tmp_path}/in*.csv").write.parquet(f"{tmp_path}/out"))
    assert len(done) == 2 and not list(tmp_path.glob("*.csv"))


@pytest.fixture
def database(spark, tmp_path):
    spark.sql(f"CREATE DATABASE scratch LOCATION '{tmp_path}/db'")
    yield "scratch"
    spark.sql("DROP DATABASE scratch CASCADE")


def test_tables(spark, database):
    catalogs.ensure_database(spark, database)
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    upsert.create_as(rows, f"{database}.t", sort_by=["k"])
    with pytest.raises(PySparkException):
        upsert.create_as(rows, f"{database}.t")
    upsert.create_as(rows.withColumn("s", F.lit(7)), f"{database}.t", drop=True, partition_by=["s"])
    assert spark.table(f"{database}.t").count() == 2
    upsert.truncate_append(spark.createDataFrame([("c", 9)], "v string, k int"), f"{database}.t")
    assert [tuple(r) for r in spark.table(f"{database}.t").select("k", "v", "s").collect()] == [(9, "c", None)]
    assert dict(spark.table(f"{database}.t").dtypes)["k"] == "bigint"
    upsert.truncate_append(rows, f"{database}.new")
    assert catalogs.add_columns(spark, f"{database}.new", {"k": "long", "more": "double"}) == ["more"]
    assert catalogs.add_columns(spark, f"{database}.new", {"more": "double"}) == [] and spark.table(f"{database}.new").columns == ["k", "v", "more"]
    assert catalogs.validate(spark, {f"{database}.new": ["k"]}, {f"{database}.new": "k = 1"}) == (catalogs.VALID, "")
    assert catalogs.validate(spark, {f"{database}.new": ["k", "gone"]})[0] == catalogs.NO_COLUMN and catalogs.validate(spark, {f"{database}.none": []})[0] == catalogs.NO_TABLE
    assert catalogs.validate(spark, {}, {f"{database}.new": "k = 5"}) == (catalogs.NO_ROWS, f"{database}.new")


def test_paged_source(spark, tmp_path):
    import json

    for start in (0, 2, 4):
        (tmp_path / f"{start}.json").write_text(json.dumps({"data": [{"id": k, "name": f"n{k}"} for k in range(start, min(start + 2, 5))]}))
    spark.dataSource.register(paged.PagedJson)
    pages = spark.read.format("paged_json").option("url", f"file://{tmp_path}/{{start}}.json").option("total", 5).option("length", 2).load()
    assert pages.rdd.getNumPartitions() == 3
    assert sorted((r.id, r.name) for r in paged.rows_of(pages, "data", "id long, name string").collect()) == [(k, f"n{k}") for k in range(5)]


def test_stream_equals_batch(spark):
    path = f"{DATA}/events.parquet"
    live = replay.replayed(replay.window_counts(replay.event_stream(spark, path)))
    batch = replay.window_counts(table(spark, DATA, "events"))
    key = lambda df: sorted((str(r.window_start), r.event_type, r.n) for r in df.collect())
    assert key(live) == key(batch)

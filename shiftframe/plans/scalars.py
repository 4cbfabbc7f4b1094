"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftframe.functions import clock, labels, names, parse, seasons
from shiftframe.operators import identity
from shiftframe.sources.tables import table

from . import views
from .catalog import query
from .joins import NORMAL
from .views import with_views

# Written from the rules, not from the operators: DuckDB's own accent stripping and a step for each rule.
STRICT = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(trim(name))), '[^\\x00-\\x7F]', '', 'g'), "
    "'\\b([od])''', '\\1', 'g'), '[.''\\-]', ' ', 'g'), '[^a-z ]', '', 'g'), '\\s+', ' ', 'g'))"
)
INITIALS = "coalesce(regexp_replace(regexp_replace({0}, '\\b([a-z])\\s+([a-z])\\b', '\\1\\2', 'g'), '\\b([a-z])\\s+([a-z])\\b', '\\1\\2', 'g'), '')"
STRICT = INITIALS.format(STRICT)
PEOPLE = ["Erik Černák", "Ryan O'Reilly", "J.T. Miller", "Tony D’Angelo", "Jean-Luc Foudy", "P. A. Parenteau", "Théodor Blüger", "mats zuccarello-aasen", "  Sebastian  Aho ", "Michael  Grossman", "Anže Kopitar Jr.", "JANIS..MOSER", "Ole", "", None]
NAMED = "(SELECT c_custkey, [" + ", ".join("NULL" if n is None else "'" + n.replace("'", "''") + "'" for n in PEOPLE) + f"][c_custkey % {len(PEOPLE)} + 1] AS name FROM customer)"


def _people(spark, sf_dir):
    """(c_custkey, name): names in many spellings."""
    listed = F.array(*(F.lit(n).cast("string") for n in PEOPLE))
    return table(spark, sf_dir, "customer").select("c_custkey", F.element_at(listed, (F.col("c_custkey") % len(PEOPLE) + 1).cast("int")).alias("name"))


@query(with_views(f"SELECT doc_id, {NORMAL} AS name_key FROM v_names", "v_names"))
def normalize_name(spark, sf_dir):
    return views.names(spark, sf_dir).select("doc_id", names.normalize_name(F.col("name")).alias("name_key"))


@query(with_views(f"SELECT doc_id, {STRICT} AS name_key FROM v_names", "v_names"))
def normalize_name_strict(spark, sf_dir):
    return views.names(spark, sf_dir).select("doc_id", names.normalize_name_strict(F.col("name")).alias("name_key"))


@query(f"SELECT c_custkey, {NORMAL} AS name_key, {STRICT} AS strict_key FROM {NAMED}")
def name_spellings(spark, sf_dir):
    return _people(spark, sf_dir).select("c_custkey", names.normalize_name(F.col("name")).alias("name_key"), names.normalize_name_strict(F.col("name")).alias("strict_key"))


FIRST, LAST = (NORMAL.replace("trim(name)", f"trim({c})") for c in ("first", "last"))


@query(
    with_views(
        f""", p AS (SELECT doc_id, {FIRST} AS f, {LAST} AS l FROM v_names), k AS (SELECT doc_id, unnest([f || ' ' || l, f[1] || ' ' || l]) AS name_key FROM p WHERE f <> '' AND l <> '')
    SELECT name_key, max(doc_id) AS doc_id FROM k GROUP BY name_key""",
        "v_names",
    )
)
def name_lookup(spark, sf_dir):
    people = views.names(spark, sf_dir).select("doc_id", *(names.normalize_name(F.col(c)).alias(c) for c in ("first", "last")))
    return identity.name_lookup(people, "doc_id", "first", "last").select("name_key", "doc_id")


NICKS = ", ".join(f"({g}, '{n}')" for g, group in enumerate(names.NICKNAMES) for n in group)
RESOLVING = f""", people AS (SELECT doc_id, n, string_split(n, ' ') AS w FROM (SELECT doc_id, {STRICT} AS n FROM v_names)),
asked AS (SELECT DISTINCT n, string_split(n, ' ') AS w FROM (SELECT {STRICT} AS n FROM v_titled) WHERE contains(n, ' ')),
known AS (SELECT w[-1] AS last, w[1] AS first, min(doc_id) AS low FROM people WHERE len(w) > 1 GROUP BY ALL), lasts AS (SELECT DISTINCT last FROM known),
exact AS (SELECT a.n, min(p.doc_id) AS id FROM asked a JOIN people p ON replace(a.n, ' ', '') = replace(p.n, ' ', '') GROUP BY a.n),
spelt AS (SELECT n, w, unnest([{{'k': 1, 'l': w[-1]}}, {{'k': 2, 'l': CASE WHEN ends_with(w[-1], 'man') THEN w[-1] || 'n' END}}, {{'k': 3, 'l': CASE WHEN ends_with(w[-1], 'son') THEN w[-1][:-4] || 'sen' END}}]) AS x FROM asked WHERE n NOT IN (SELECT n FROM exact)),
blocks AS (SELECT n, w, arg_min(x.l, x.k) AS block FROM spelt JOIN lasts ON x.l = last GROUP BY ALL),
nick AS (SELECT * FROM (VALUES {NICKS}) t(g, v)),
variants AS (SELECT n, w[1] AS v FROM blocks UNION SELECT n, w[1][1:3] FROM blocks WHERE length(w[1]) >= 3 UNION SELECT n, w[1][1:4] FROM blocks WHERE length(w[1]) >= 4
  UNION SELECT n, array_to_string(list_transform(w[1:-2], lambda x: x[1]), '') FROM blocks WHERE len(w) > 2 UNION SELECT n, b.v FROM blocks JOIN nick a ON a.v = w[1] JOIN nick b ON a.g = b.g),
alike AS (SELECT n, min(low) AS id FROM blocks JOIN variants USING (n) JOIN known ON last = block WHERE first <> '' AND (v = first OR (length(v) >= 3 AND (starts_with(v, first) OR starts_with(first, v)))) GROUP BY n)"""
BOTH_NAMES = ("v_names", "v_titled")


@query(with_views(RESOLVING + ", c AS (SELECT n, block, count(*) AS n_first_names FROM blocks JOIN known ON last = block GROUP BY ALL) SELECT n AS name, block, CAST(n_first_names AS BIGINT) AS n_first_names FROM c", *BOTH_NAMES))
def name_candidates(spark, sf_dir):
    """The last name that each title's name is looked up by, and how many first names it meets there."""
    asked, normal = identity.asked_names(views.titled(spark, sf_dir), "page_id", "name"), identity.normal_names(views.names(spark, sf_dir), "doc_id", "name")
    known, flat = identity.by_last_name(normal), normal.select(F.replace("normal", F.lit(" ")).alias("flat")).distinct()
    open_ = asked.withColumn("flat", F.replace("normal", F.lit(" "))).join(flat, "flat", "left_anti").drop("flat")
    blocks = identity.last_name_blocks(open_, known)
    return blocks.join(known, F.col("block") == known["last"]).groupBy(F.col("normal").alias("name"), "block").agg(F.count("*").alias("n_first_names"))


@query(with_views(RESOLVING + f" SELECT page_id, coalesce(e.id, a.id) AS doc_id, CASE WHEN e.id IS NULL THEN 'high' ELSE 'exact' END AS verdict FROM (SELECT page_id, {STRICT} AS n FROM v_titled) LEFT JOIN exact e USING (n) LEFT JOIN alike a USING (n) WHERE coalesce(e.id, a.id) IS NOT NULL", *BOTH_NAMES))
def sure_names(spark, sf_dir):
    """Titles' names that are a person's, or alike by nickname, prefix or initials."""
    return identity.resolved_names(views.titled(spark, sf_dir), views.names(spark, sf_dir), "page_id", "doc_id", sure=True).select("page_id", "doc_id", "verdict")


@query()
def resolved_names(spark, sf_dir):
    """All titles' names that can be told, with the matched ratio's, which SQL lacks; a test compares all pairs."""
    found = identity.resolved_names(views.titled(spark, sf_dir), views.names(spark, sf_dir), "page_id", "doc_id")
    return found.select("page_id", "doc_id", F.round("sim", 6).alias("sim"), "verdict")


MATCHES = [
    ("bob smith", "bill smith"), ("matt smith", "matthew smith"), ("jean luc foudy", "jeanluc foudy"), ("j smith", "john smith"), ("jt miller", "john miller"), ("al smith", "alan jones"),
    ("matt x smith", "matt y smith"), ("smith", "smith"), ("smith", "smyth"), ("", "smith"), ("jo smith", "jim smith"), ("matthew smith", "matt smith"), ("ab cd", "abcd"), ("kim lee", "tim lee"),
]
MATCHED = "(SELECT c_custkey, m.a, m.b FROM (SELECT c_custkey, [" + ", ".join(f"{{'a': '{a}', 'b': '{b}'}}" for a, b in MATCHES) + f"][c_custkey % {len(MATCHES)} + 1] AS m FROM customer))"


def _name_pairs(spark, sf_dir):
    """(c_custkey, a, b): pairs of normal names, alike in different ways."""
    listed = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in MATCHES))
    return table(spark, sf_dir, "customer").select("c_custkey", F.element_at(listed, (F.col("c_custkey") % len(MATCHES) + 1).cast("int")).alias("m")).select("c_custkey", "m.a", "m.b")


@query(
    f"""SELECT c_custkey, CAST(CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 100 WHEN replace(a, ' ', '') = replace(b, ' ', '') THEN 92 WHEN len(x) < 2 OR len(y) < 2 OR x[-1] <> y[-1] THEN 0
    WHEN x[1] = y[1] THEN 90 WHEN starts_with(x[1], y[1]) OR starts_with(y[1], x[1]) THEN 88 WHEN x[1][1] = y[1][1] AND (length(x[1]) <= 2 OR length(y[1]) <= 2) THEN 85 ELSE 0 END AS INT) AS score
    FROM (SELECT *, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM {MATCHED})"""
)
def name_score(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("c_custkey", names.name_score(F.col("a"), F.col("b")).alias("score"))


FULL = ["Mike Smith", "Alexander Steen", "Zachary Hyman", "Ole X", "Pierre-Alexandre Parenteau", "Bo Horvat", "William Nylander"]
GROUPS = "mike michael, alexander alex sasha, william will bill"


@query(
    "WITH nick AS (SELECT g, unnest(string_split(g, ' ')) AS n FROM (SELECT unnest(string_split('"
    + GROUPS
    + "', ', ')) AS g)), f AS (SELECT c_custkey, lower(regexp_replace(["
    + ", ".join(f"'{n}'" for n in FULL)
    + f"][c_custkey % {len(FULL)} + 1], '-', ' ')) AS whole FROM customer), w AS (SELECT c_custkey, string_split(whole, ' ') AS w FROM f),"
    """ v AS (SELECT c_custkey, w[1] AS v FROM w UNION SELECT c_custkey, w[1][1:3] FROM w WHERE length(w[1]) >= 3 UNION SELECT c_custkey, w[1][1:4] FROM w WHERE length(w[1]) >= 4
      UNION SELECT c_custkey, array_to_string(list_transform(w[1:-2], lambda x: x[1]), '') FROM w WHERE len(w) > 2 UNION SELECT c_custkey, unnest(string_split(g, ' ')) FROM w JOIN nick ON n = w[1])
    SELECT c_custkey, string_agg(v, ',' ORDER BY v) AS variants FROM v GROUP BY c_custkey"""
)
def name_variants(spark, sf_dir):
    whole = F.element_at(F.array(*map(F.lit, FULL)), (F.col("c_custkey") % len(FULL) + 1).cast("int"))
    first = F.element_at(F.split(names.normalize_name_strict(whole), " "), 1)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(names.first_name_variants(first, whole), ",").alias("variants"))


ALIASED = [("Mats", "Zuccarello-Aasen"), ("Theodor", "Blueger"), ("Theodor", "Smith"), ("Michael", "Grossman"), ("Teddy", "Blueger"), ("Nicklas", "Grossmann")]


@query(
    "SELECT c_custkey, CASE WHEN lower(l) = 'blueger' AND lower(f) = 'theodor' THEN 'teddy' ELSE f END AS first, CASE lower(l) WHEN 'zuccarello-aasen' THEN 'zuccarello' WHEN 'grossman' THEN 'grossmann' WHEN 'blueger' THEN 'blueger' ELSE l END AS last FROM (SELECT c_custkey, m.f, m.l FROM (SELECT c_custkey, ["
    + ", ".join(f"{{'f': '{f}', 'l': '{n}'}}" for f, n in ALIASED)
    + f"][c_custkey % {len(ALIASED)} + 1] AS m FROM customer))"
)
def name_aliases(spark, sf_dir):
    listed = F.array(*(F.struct(F.lit(f).alias("f"), F.lit(n).alias("l")) for f, n in ALIASED))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(listed, (F.col("c_custkey") % len(ALIASED) + 1).cast("int")).alias("m")).select("c_custkey", "m.f", "m.l")
    first, last = names.with_aliases(F.col("f"), F.col("l"))
    return rows.select("c_custkey", first.alias("first"), last.alias("last"))


@query()
def name_similarity(spark, sf_dir):
    """No SQL: the ratio is that of Python's matched blocks; a test holds it against the library."""
    first = lambda c: F.element_at(F.split(c, " "), 1)
    return _name_pairs(spark, sf_dir).select("c_custkey", F.round(names.first_name_similarity(first("a"), first("b")), 6).alias("similarity"))


SIMS = "SELECT user_id, event_id, round(value / 100, 4) AS sim FROM events WHERE event_type <> 'view'"


@query(
    f"""SELECT user_id, event_id, sim, CASE WHEN sim >= 0.92 THEN 'high' WHEN sim >= 0.8 THEN 'good' ELSE 'margin' END AS verdict
    FROM (SELECT *, row_number() OVER w AS k, lead(sim) OVER w AS nxt FROM (SELECT user_id * 100 + event_id % 37 AS user_id, event_id, sim FROM ({SIMS})) WINDOW w AS (PARTITION BY user_id ORDER BY sim DESC, event_id))
    WHERE k = 1 AND (sim >= 0.8 OR (sim >= 0.55 AND (nxt IS NULL OR sim - nxt >= 0.2)))"""
)
def accept_ladder(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type <> 'view'").select((F.col("user_id") * 100 + F.col("event_id") % 37).alias("user_id"), "event_id", F.round(F.col("value") / 100, 4).alias("sim"))
    return identity.accepted(rows, ["user_id"], "sim", F.asc("event_id"))


URLS = "CASE page_id % 4 WHEN 0 THEN url || '/redirect/player/' || page_id WHEN 1 THEN url || '/player/' || page_id || '/cap-2024' WHEN 2 THEN url || '/team/7?y=' || page_id ELSE url END"


@query(f"SELECT page_id, TRY_CAST(nullif(regexp_extract(u, '/player/(\\d+)(/|$)', 1), '') AS BIGINT) AS player_id, TRY_CAST(nullif(regexp_extract(u, '/(\\d+)(/|$|\\?|#)', 1), '') AS BIGINT) AS path_id FROM (SELECT page_id, {URLS} AS u FROM pages)")
def url_id(spark, sf_dir):
    k, at = F.col("page_id") % 4, F.col("page_id").cast("string")
    url = F.when(k == 0, F.concat("url", F.lit("/redirect/player/"), at)).when(k == 1, F.concat("url", F.lit("/player/"), at, F.lit("/cap-2024"))).when(k == 2, F.concat("url", F.lit("/team/7?y="), at)).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", parse.url_id(url).alias("player_id"), parse.path_id(url).alias("path_id"))


AMOUNTS = ["$1,234.50", '"$70,403,880"', "n/a", " - ", "", "925000", "$ 12", "1 234", "two"]


@query(
    "SELECT c_custkey, TRY_CAST(CASE WHEN trim(raw) IN ('', '-', 'n/a') THEN NULL ELSE trim(replace(replace(replace(trim(raw), '$', ''), ',', ''), '\"', '')) END AS DOUBLE) AS money, TRY_CAST(nullif(regexp_replace(raw, '[^0-9]', '', 'g'), '') AS BIGINT) AS whole FROM (SELECT c_custkey, ["
    + ", ".join(f"'{a}'" for a in AMOUNTS)
    + f"][c_custkey % {len(AMOUNTS)} + 1] AS raw FROM customer)"
)
def money_parse(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, AMOUNTS)), (F.col("c_custkey") % len(AMOUNTS) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", parse.money(raw).alias("money"), parse.whole_money(raw).alias("whole"))


@query(
    """SELECT c_custkey, TRY_CAST(nullif(regexp_extract(raw, '^\\s*(\\d+)''\\s*(\\d+)', 1), '') AS BIGINT) * 12 + TRY_CAST(nullif(regexp_extract(raw, '^\\s*(\\d+)''\\s*(\\d+)', 2), '') AS BIGINT) AS inches
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'tall' ELSE (5 + c_custkey % 2) || ''' ' || (c_custkey % 12) || '"' END AS raw FROM customer)"""
)
def height_parse(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.when(k % 5 == 0, "tall").otherwise(F.concat((5 + k % 2).cast("string"), F.lit("' "), (k % 12).cast("string"), F.lit('"')))
    return table(spark, sf_dir, "customer").select("c_custkey", parse.height_inches(raw).alias("inches"))


@query(
    """SELECT event_id, coalesce(CAST(TRY_CAST(raw AS DOUBLE) AS BIGINT), CASE WHEN len(string_split(raw, ':')) = 2 THEN TRY_CAST(string_split(raw, ':')[1] AS BIGINT) * 60 + TRY_CAST(string_split(raw, ':')[2] AS BIGINT) END) AS seconds
    FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 20) || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') WHEN 1 THEN CAST(event_id % 1200 AS VARCHAR) ELSE 'late' END AS raw FROM events)"""
)
def clock_parse(spark, sf_dir):
    k = F.col("event_id")
    raw = F.when(k % 3 == 0, F.concat_ws(":", (k % 20).cast("string"), F.lpad((k % 60).cast("string"), 2, "0"))).when(k % 3 == 1, (k % 1200).cast("string")).otherwise("late")
    return table(spark, sf_dir, "events").select("event_id", clock.clock_parse(raw).alias("seconds"))


@query(
    f"""SELECT c_custkey, w[1] AS first, CASE WHEN w IS NOT NULL THEN array_to_string(w[2:], ' ') END AS last, shown
    FROM (SELECT c_custkey, string_split(nullif(trim(regexp_replace(name, '\\s+', ' ', 'g')), ''), ' ') AS w,
      array_to_string(list_transform(regexp_extract_all(trim(regexp_replace(regexp_replace(coalesce(name, ''), '\\.+', ' ', 'g'), '\\s+', ' ', 'g')), '\\p{{L}}+|\\P{{L}}+'), lambda r: upper(r[1]) || lower(r[2:])), '') AS shown FROM {NAMED})"""
)
def split_name(spark, sf_dir):
    first, last = parse.split_name(F.col("name"))
    return _people(spark, sf_dir).select("c_custkey", first.alias("first"), last.alias("last"), parse.title_case(F.col("name")).alias("shown"))


@query("SELECT c_custkey, nullif(regexp_extract(upper(raw), '\\b([A-Z]{2,3})\\b', 1), '') AS abbr FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'team ' || lower(c_mktsegment[1:3]) || ' x' ELSE c_mktsegment END AS raw FROM customer)")
def abbrev(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("team "), F.lower(F.substring("c_mktsegment", 1, 3)), F.lit(" x"))).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", parse.abbreviation(raw).alias("abbr"))


@query(
    """SELECT o_orderkey, s AS season, s + 10001 AS season_next, (s // 10000) || '-' || lpad(CAST(s % 100 AS VARCHAR), 2, '0') AS label, CAST((s // 10000 * 1000000 + o_orderkey) // 1000000 AS BIGINT) AS first_year
    FROM (SELECT o_orderkey, CAST(year(o_orderdate) * 10000 + year(o_orderdate) + 1 AS BIGINT) AS s FROM orders)"""
)
def season_codes(spark, sf_dir):
    season = seasons.season_of_year(F.year("o_orderdate"))
    game = F.floor(season / 10000) * 1_000_000 + F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", season.alias("season"), seasons.season_next(season).alias("season_next"), seasons.season_label(season).alias("label"), seasons.season_of_game(game).alias("first_year")
    )


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_prop(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


FEATURE_NAMES = ["roll15_F_share_0", "roll15_D_share_1", "F_share_9", "roll15_diff_cf_percent", "ca60", "roll15_toi_es_sec", "diff_fo_percent", "hits"]
SHOWN = ["F: Two-way", "D: Balanced", "F: F9", "Δ CF%", "CA/60", "ES TOI", "Δ FO%", "hits"]


@query(f"SELECT event_id, {SHOWN!r}[event_id % {len(SHOWN)} + 1] AS shown FROM events")
def feature_labels(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, FEATURE_NAMES)), (F.col("event_id") % len(FEATURE_NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", labels.feature_label(name, {"F0": "Two-way", "D1": "Balanced"}).alias("shown"))

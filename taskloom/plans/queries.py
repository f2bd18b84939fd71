"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.redact import redact
from ..functions.tools import INTERNAL, OPAQUE, VERBS, canonical_tool
from ..operators import mining, scoring, segment
from .events import event_turns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_TURNS = """
turns AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, ts AS t, event_type,
  CASE event_type WHEN 'signup' THEN 'prompt' WHEN 'error' THEN 'result' ELSE 'call' END AS kind,
  event_type = 'signup' AND event_id % 3 = 2 AS fresh_prompt, event_type = 'signup' AND event_id % 3 = 1 AS correction,
  CASE WHEN event_type <> 'signup' THEN NULL WHEN event_id % 3 = 0 THEN 'yes, go on' WHEN event_id % 3 = 1 THEN 'never do that' ELSE 'start over with the report' END AS said FROM events)"""


def _arcs_sql(minutes: int) -> str:
    return f"""{_TURNS},
a AS (SELECT *, coalesce(epoch_us(t) - epoch_us(lag(t) OVER (PARTITION BY session ORDER BY idx)) > {minutes} * 60000000::BIGINT, false) AS pause FROM turns),
b AS (SELECT *, sum(pause::INT) OVER (PARTITION BY session ORDER BY idx) AS island, kind <> 'result' AS opener FROM a),
c AS (SELECT *, sum(opener::INT) OVER (PARTITION BY session, island ORDER BY idx) AS openers FROM b),
d AS (SELECT *, opener AND (openers = 1 OR fresh_prompt) AS first FROM c),
e AS (SELECT * FROM (SELECT *, sum(first::INT) OVER (PARTITION BY session ORDER BY idx) AS arc FROM d) WHERE openers > 0),
f AS (SELECT *, kind = 'call' AND event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY session, arc, kind = 'call' ORDER BY idx) AS same,
  coalesce(last_value(CASE WHEN kind = 'result' THEN true END IGNORE NULLS) OVER (PARTITION BY session, arc ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS failed FROM e),
arcs AS (SELECT * FROM (SELECT session, arc, min(t) FILTER (first OR kind = 'call') AS start, max(t) FILTER (first OR kind = 'call') AS stop,
  count(*) FILTER (opener) AS turns, coalesce(string_agg(event_type, ' ' ORDER BY idx) FILTER (kind = 'call' AND NOT same), '') AS steps,
  count(*) FILTER (kind = 'call' AND NOT same) AS n_steps, count(*) FILTER (kind = 'result') AS errors, count(*) FILTER (same AND failed) AS retries,
  count(*) FILTER (correction AND NOT first) AS corrections,
  coalesce(arg_min(coalesce(said, ''), idx) FILTER (first), '') AS opening,
  coalesce(array_to_string(list_sort(list(DISTINCT event_type) FILTER (kind = 'call')), ' '), '') AS tools,
  substr(sha256(session || chr(0) || strftime(min(t) FILTER (first), '%Y-%m-%dT%H:%M:%SZ') || chr(0) || coalesce(arg_min(coalesce(said, 'anonymous'), idx) FILTER (first), 'anonymous') || chr(0)), 1, 10) AS arc_id
  FROM f GROUP BY session, arc) WHERE n_steps >= 2 OR corrections > 0)"""


def _arcs(spark: SparkSession, sf_dir: str, minutes: int) -> DataFrame:
    a = segment.arcs(event_turns(spark, sf_dir), minutes)
    lists = (F.array_join(c, " ").alias(c) for c in ("steps", "tools", "commands"))
    return a.select("session", "arc", "arc_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("stop"), "turns", *lists, "errors", "retries", "corrections", "intent", F.array_join(F.transform("wishes", lambda w: w["kind"]), " ").alias("wishes"))


_ARC_COLUMNS = """SELECT session, arc::BIGINT AS arc, arc_id, start, stop, turns, steps, tools, '' AS commands, errors, retries, corrections,
  CASE WHEN opening <> '' THEN opening WHEN n_steps > 0 THEN 'untitled work: ' || array_to_string(string_split(steps, ' ')[1:3], ', ') ELSE '' END AS intent,
  array_to_string(list_transform(range(corrections), lambda x: 'preference'), ' ') AS wishes FROM arcs"""


@query(f"WITH {_arcs_sql(90)} {_ARC_COLUMNS}")
def arc_segmentation(spark, sf_dir):
    return _arcs(spark, sf_dir, 90)


@query(f"WITH {_arcs_sql(1440)} {_ARC_COLUMNS}")
def arc_segmentation_24h(spark, sf_dir):
    return _arcs(spark, sf_dir, 1440)


@query("""WITH t AS (SELECT user_id AS session, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, CASE WHEN event_id % 3 <> 0 THEN ts END AS t FROM events)
SELECT session, event_id, coalesce(last_value(t IGNORE NULLS) OVER (PARTITION BY session ORDER BY idx), first_value(t IGNORE NULLS) OVER (PARTITION BY session ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM t""")
def session_backfill(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = e.select(F.col("user_id").alias("session"), "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("idx"), F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("at"))
    return segment.backfill(t).select("session", "event_id", F.col("at").alias("filled"))


_CADENCE_SQL = f"""{_arcs_sql(1440)},
days AS (SELECT DISTINCT session, start::DATE AS day FROM arcs WHERE start IS NOT NULL),
gaps AS (SELECT *, (day - lag(day) OVER (PARTITION BY session ORDER BY day)) * 24.0::DOUBLE AS gap FROM days),
sums AS (SELECT session, min(day) AS first_seen, max(day) AS last_seen, count(*) AS days, coalesce(median(gap), 0) AS med, avg(gap) AS mean, stddev_pop(gap) AS spread FROM gaps GROUP BY session),
cad AS (SELECT session, first_seen, last_seen, days, (last_seen - first_seen + 1)::BIGINT AS span_days, floor(med * 1000 + 0.5) / 1000 AS median_interval_hours,
  floor((CASE WHEN days < 3 OR mean <= 0 THEN 0 ELSE least(1, greatest(0, 1 - spread / mean)) END)::DOUBLE * 1000 + 0.5) / 1000 AS regularity FROM sums)"""


@query(f"""WITH {_CADENCE_SQL}
SELECT *, CASE WHEN days < 2 THEN 'once' WHEN median_interval_hours <= 0 THEN 'same day' WHEN regularity < 0.25 THEN 'bursty' WHEN median_interval_hours <= 30 THEN 'about daily'
  WHEN median_interval_hours <= 96 THEN 'every few days' WHEN median_interval_hours <= 200 THEN 'roughly weekly' WHEN median_interval_hours <= 800 THEN 'every few weeks' ELSE 'occasional' END AS label FROM cad""")
def cadence(spark, sf_dir):
    return mining.cadence(segment.arcs(event_turns(spark, sf_dir), 1440))


@query(f"""WITH {_arcs_sql(1440)},
total AS (SELECT session, count(*) AS arcs FROM arcs GROUP BY session),
each_ AS (SELECT session, arc, n_steps, unnest(string_split(steps, ' ')) AS action, generate_subscripts(string_split(steps, ' '), 1) - 1 AS i FROM arcs WHERE n_steps > 0),
firsts AS (SELECT session, arc, action, min(CASE WHEN n_steps > 1 THEN i::DOUBLE / (n_steps - 1) ELSE 0 END) AS i FROM each_ GROUP BY ALL),
steps AS (SELECT f.session, action, count(*) AS count, median(i) AS position, any_value(arcs) AS arcs FROM firsts f JOIN total t ON f.session = t.session GROUP BY f.session, action)
SELECT session, row_number() OVER (PARTITION BY session ORDER BY floor(position * 1000 + 0.5) / 1000, count DESC, action) AS rank, action,
  floor(count::DOUBLE / arcs * 1000 + 0.5) / 1000 AS support, count, floor(position * 1000 + 0.5) / 1000 AS position FROM steps WHERE count::DOUBLE / arcs >= 0.45""")
def canonical_steps(spark, sf_dir):
    return mining.canonical_steps(segment.arcs(event_turns(spark, sf_dir), 1440))


@query(f"""WITH {_CADENCE_SQL},
runs AS (SELECT session, count(*) AS runs, max(turns) AS turns, max(n_steps) AS n_steps FROM arcs GROUP BY session)
SELECT session, runs, floor(least(1, CASE WHEN days <= 1 THEN 0.05 ELSE ln(days) / ln(12) END)::DOUBLE * 1000 + 0.5) / 1000 AS recurrence, regularity,
  (CASE WHEN n_steps <= 1 THEN 0.65 ELSE 1 END * CASE WHEN days <= 1 THEN 0.55 ELSE 1 END * CASE WHEN runs >= 5 THEN 0.75 ELSE 1 END)::DOUBLE AS penalty FROM runs JOIN cad USING (session)""")
def score_components(spark, sf_dir):
    a = segment.arcs(event_turns(spark, sf_dir), 1440)
    per = a.groupBy("session").agg(F.count("*").alias("runs"), F.max("turns").alias("turns"), F.max_by("steps", F.struct(F.size("steps"), "arc_id")).alias("steps"))
    c = _plain_candidates(per.join(mining.cadence(a), "session"))
    return scoring.score(c).select("session", "runs", T.round3(F.col("recurrence")).alias("recurrence"), "regularity", "penalty")


def _plain_candidates(c: DataFrame) -> DataFrame:
    """Candidates of one session, repository and agent each, without phrases and corrections, which hang together."""
    one, none = F.lit(1), F.lit(0)
    return c.withColumns({"sessions": one, "n_repos": one, "n_agents": one, "phrase": F.lit(None).cast("double"), "error_rate": F.lit(0.0), "n_corrections": none, "n_standing": none, "minutes": F.lit(0.0), "cohesion": F.lit(1.0)})


@query("""SELECT event_type AS agent, count(DISTINCT user_id) AS sessions, count(*) AS turns, min(ts) AS earliest, max(ts) AS latest FROM events GROUP BY event_type""")
def agent_stats(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.col("event_type").alias("agent")).agg(F.countDistinct("user_id").alias("sessions"), F.count("*").alias("turns"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"))


def _tokens_sql(table: str, key: str, text: str = "text") -> str:
    return f"""tok AS (SELECT * FROM (SELECT {key}, regexp_replace(unnest(regexp_extract_all(lower({text}), '[a-z0-9][a-z0-9_\\-.]*')), '^[\\-._]+|[\\-._]+$', '', 'g') AS token FROM {table})
  WHERE length(token) >= 2 AND token NOT IN ({_quoted(T.STOPWORDS)}) AND NOT regexp_full_match(token, '[0-9]+'))"""


@query(f"WITH {_tokens_sql('documents', 'doc_id')} SELECT doc_id, count(*) AS n, count(DISTINCT token) AS n_distinct, min(token) AS least, max(token) AS most FROM tok GROUP BY doc_id")
def tokens(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("token").alias("n_distinct"), F.min("token").alias("least"), F.max("token").alias("most"))


@query(f"""WITH {_tokens_sql('documents', 'doc_id')}, n AS (SELECT count(*) AS docs FROM documents)
SELECT token, count(DISTINCT doc_id) AS df, floor((ln((docs + 1) / (count(DISTINCT doc_id) + 1)) + 1) * 1000 + 0.5) / 1000 AS idf FROM tok, n GROUP BY token, docs""")
def idf(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mining.idf(d, "doc_id", T.tokens(F.col("text"))).withColumn("idf", T.round3(F.col("idf")))


@query(f"""WITH {_tokens_sql('documents', 'doc_id')}, n AS (SELECT count(*) AS docs FROM documents),
i AS (SELECT token, ln((docs + 1) / (count(DISTINCT doc_id) + 1)) + 1 AS idf FROM tok, n GROUP BY token, docs),
w AS (SELECT doc_id, token, floor((1 + ln(count(*))) * any_value(idf) * 1000 + 0.5) / 1000 AS weight FROM tok JOIN i USING (token) GROUP BY doc_id, token)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, token) AS rank FROM w) WHERE rank <= 5""")
def tfidf_top(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mining.top_n(mining.tfidf(d, "doc_id", T.tokens(F.col("text"))).withColumn("weight", T.round3(F.col("weight"))), "doc_id", "weight", 5)


@query(f"""WITH {_tokens_sql('documents', 'source, doc_id')},
u AS (SELECT DISTINCT source, doc_id, token FROM tok WHERE length(token) BETWEEN 3 AND 20 AND NOT regexp_matches(token, '[0-9./]') AND NOT regexp_full_match(token, '[a-f]{{8,}}') AND NOT regexp_matches(token, '{"|".join(c * 4 for c in "abcdefghijklmnopqrstuvwxyz")}|----|____')),
g AS (SELECT source, token, count(*) AS n FROM u GROUP BY ALL), o AS (SELECT token, sum(n) AS n_all FROM g GROUP BY token),
s AS (SELECT source, count(*) AS size FROM documents GROUP BY source), t AS (SELECT count(*) AS total FROM documents),
f AS (SELECT g.source, token, floor(n / size::DOUBLE * 1000 + 0.5) / 1000 AS share, floor((n / size::DOUBLE) / (n_all / total::DOUBLE) * 1000 + 0.5) / 1000 AS lift FROM g JOIN s ON g.source = s.source JOIN o USING (token), t WHERE n / size::DOUBLE >= 0.34)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lift DESC, token) AS rank FROM f) WHERE rank <= 8""")
def distinctive_keywords(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "text")
    return mining.distinctive_keywords(d, "source", T.tokens(F.col("text")))


@query(f"""WITH {_tokens_sql('benchmark', 'item_id')}, w AS (SELECT DISTINCT item_id AS want_id, token FROM tok), wn AS (SELECT want_id, count(*) AS n FROM w GROUP BY want_id),
h AS (SELECT DISTINCT doc_id AS have_id, token FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_\\-.]*')), '^[\\-._]+|[\\-._]+$', '', 'g') AS token FROM documents)),
c AS (SELECT w.want_id, have_id, count(*)::DOUBLE / any_value(n) AS sim FROM w JOIN h USING (token) JOIN wn ON wn.want_id = w.want_id GROUP BY w.want_id, have_id)
SELECT want_id, have_id, floor(sim * 1000 + 0.5) / 1000 AS similarity FROM c WHERE sim >= 0.55 QUALIFY row_number() OVER (PARTITION BY want_id ORDER BY sim DESC, have_id) = 1""")
def containment_best_match(spark, sf_dir):
    want = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("want_id"), T.tokens(F.col("text")).alias("tokens"))
    have = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("have_id"), T.tokens(F.col("text")).alias("tokens"))
    return mining.best_match(want, have)


@query("""WITH e AS (SELECT ts, count(event_id) AS n FROM events WHERE ts IS NOT NULL GROUP BY ts), run AS (SELECT ts, sum(n) OVER (ORDER BY ts) AS n FROM e), undated AS (SELECT count(event_id) AS n FROM events WHERE ts IS NULL),
days AS (SELECT o_orderkey, o_orderdate - INTERVAL 1 MICROSECOND AS t FROM orders)
SELECT o_orderkey, sum(coalesce(run.n, 0) + undated.n)::BIGINT AS before FROM days ASOF LEFT JOIN run ON days.t >= run.ts, undated GROUP BY o_orderkey""")
def before_cutoff(spark, sf_dir):
    """Events before each order, undated ones included.

    Events are counted within the days of all times, then over the days (one row a day), so no order is held against every event.
    """
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").alias("t"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").alias("t"))
    none = F.lit(0).cast("long")
    times = o.select("t", none.alias("n")).distinct().union(e.groupBy("t").agg(F.count("event_id").alias("n"))).where("t is not null").groupBy("t").agg(F.sum("n").alias("n")).withColumn("day", F.to_date("t"))
    within = times.select("t", "day", (F.sum("n").over(Window.partitionBy("day").orderBy("t")) - F.col("n")).alias("today"))
    days = times.groupBy("day").agg(F.sum("n").alias("n")).select("day", (F.sum("n").over(Window.orderBy("day")) - F.col("n")).alias("earlier"))
    dated = within.join(days, "day").select("t", (F.col("today") + F.col("earlier")).alias("dated"))
    undated = e.where("t is null").agg(F.count("event_id").alias("undated"))
    return o.join(dated, "t", "left").crossJoin(undated).groupBy("o_orderkey").agg(F.sum(F.coalesce("dated", none) + F.col("undated")).alias("before"))


@query("SELECT doc_id, substr(sha256(source || chr(0) || coalesce(text, '') || chr(0)), 1, 10) AS id FROM documents")
def fingerprint(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.fingerprint(F.col("source"), F.col("text")).alias("id"))


_SLUG = "trim(substr(trim(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), '-')"


@query(f"SELECT page_id, CASE WHEN {_SLUG} = '' THEN 'workflow' ELSE {_SLUG} END AS slug FROM pages")
def slug(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.slug(F.col("url")).alias("slug"))


def redacted_sql(out: str) -> str:
    from ..functions import redact as R

    for pattern, to in [*R.RULES, (R.MAIL, "[redacted:email]")]:
        p = pattern.replace(R._B, "\\b").replace(R._E, "\\b").replace("'", "''")
        out = f"regexp_replace({out}, '{p}', '{to.replace('$1', chr(92) + '1')}', 'g')"
    return out


@query(f"SELECT doc_id, sha256({redacted_sql('text')}) AS redacted FROM documents")
def redact_documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(redact(F.col("text")).cast("binary"), 256).alias("redacted"))


#: How people begin what they say; put before the turns of the conversations table, which has no such words.
_BEGIN = ["yes, ", "always ", "no, use ", "don't forget ", "that's wrong, ", "OK go on ", ""]


def _marked(patterns: list[str]) -> str:
    return "|".join(p.replace("<", "\\b").replace(">", "\\b") for p in patterns).replace("'", "''")


@query(f"""WITH s AS (SELECT conv_id, turn, [{_quoted(_BEGIN)}][1 + (conv_id + turn) % {len(_BEGIN)}] || CASE WHEN conv_id % 2 = 0 THEN substr(text, 1, 12) ELSE text END AS said FROM conversations WHERE text IS NOT NULL),
p AS (SELECT *, lower(regexp_replace(regexp_replace(said, '^[\\s.!?,]+', ''), '[\\s.!?,]+$', '')) AS plain, trim(said) AS t FROM s)
SELECT conv_id, turn, len(list_filter(string_split_regex(plain, '\\s+'), lambda x: x <> '')) <= 6 AND regexp_matches(plain, '^(?:{"|".join(T.CONTINUATIONS)})(?:[ ,].*)?$') AS continues,
  CASE WHEN t = '' OR strlen(t) > 600 THEN NULL WHEN regexp_matches(t, '(?i){_marked(T.STANDING)}') THEN 'preference' WHEN regexp_matches(t, '(?i){_marked(T.FIX)}') THEN 'fix' END AS kind FROM p""")
def prompt_kinds(spark, sf_dir):
    """Turns of all conversations behind seven ways to begin, half of them cut to a few words."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null")
    begin = F.element_at(F.array(*map(F.lit, _BEGIN)), (1 + (F.col("conv_id") + F.col("turn")) % len(_BEGIN)).cast("int"))
    said = F.concat(begin, F.when(F.col("conv_id") % 2 == 0, F.substring("text", 1, 12)).otherwise(F.col("text")))
    c = c.select("conv_id", "turn", said.alias("said"))
    return c.select("conv_id", "turn", T.is_continuation(F.col("said")).alias("continues"), T.correction_kind(F.col("said")).alias("kind"))


def _tool_names() -> list[str]:
    return [n for names in VERBS.values() for n in names.split()] + INTERNAL


def _segment_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"""WITH n AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'mcp__' || source || '__' || lang WHEN 1 THEN ' ' || split_part(text, ' ', 1) WHEN 2 THEN 'mcp__' || left(sha256(text), 16) || CASE WHEN doc_id % 2 = 0 THEN '__' || lang ELSE '' END
  WHEN 3 THEN upper([{_quoted(_tool_names())}][1 + (doc_id // 5) % {len(_tool_names())}]) ELSE 'my ' || lang || ' git' || CASE WHEN doc_id % 2 = 0 THEN ' browser' ELSE '' END END AS tool FROM documents),
t AS (SELECT doc_id, lower(trim(coalesce(tool, ''))) AS t, substr(lower(trim(coalesce(tool, ''))), 6) AS rest FROM n),
p AS (SELECT *, split_part(rest, '__', 1) AS server, regexp_extract(rest, '(?s)^.*?__(.*)$', 1) AS func, contains(rest, '__') AS two, regexp_matches(split_part(rest, '__', 1), '{OPAQUE}') AS opaque FROM t)
SELECT doc_id, CASE WHEN t = '' OR regexp_matches(t, '^mcp__(?:ccd_|claude_code)') THEN ''
  WHEN starts_with(t, 'mcp__') THEN CASE WHEN two AND opaque THEN 'mcp:' || {_segment_sql("func")} WHEN two THEN 'mcp:' || {_segment_sql("server")} || ':' || {_segment_sql("func")} WHEN opaque THEN '' ELSE 'mcp:' || {_segment_sql("server")} END
  WHEN t IN ({_quoted(INTERNAL)}) THEN '' {" ".join(f"WHEN t IN ({_quoted(names.split())}) THEN '{verb}'" for verb, names in VERBS.items())}
  WHEN regexp_matches(t, 'browser|playwright|puppeteer|chrome|screenshot') THEN 'browser' WHEN contains(t, 'git') THEN 'shell' ELSE 'tool:' || {_segment_sql("t")} END AS verb FROM p""")
def tool_canonical(spark, sf_dir):
    """Tool names made of each document: calls of servers, with plain and opaque names, its first word, known names, and others."""
    d, k = spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("doc_id") % 5
    known = F.element_at(F.array(*map(F.lit, _tool_names())), (1 + F.floor(F.col("doc_id") / 5) % len(_tool_names())).cast("int"))
    even = F.col("doc_id") % 2 == 0
    tool = (
        F.when(k == 0, F.concat(F.lit("mcp__"), "source", F.lit("__"), "lang")).when(k == 1, F.concat(F.lit(" "), F.split_part("text", F.lit(" "), F.lit(1))))
        .when(k == 2, F.concat(F.lit("mcp__"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16), F.when(even, F.concat(F.lit("__"), "lang")).otherwise("")))
        .when(k == 3, F.upper(known)).otherwise(F.concat(F.lit("my "), "lang", F.lit(" git"), F.when(even, F.lit(" browser")).otherwise("")))
    )
    return d.select("doc_id", canonical_tool(tool).alias("verb"))


@query(f"""WITH RECURSIVE {_arcs_sql(1440).strip()},
sets AS (SELECT session, arc, CASE WHEN n_steps = 0 THEN [] ELSE list_sort(list_distinct(list_concat(string_split(steps, ' '), list_transform(range(1, len(string_split(steps, ' '))), lambda i: string_split(steps, ' ')[i] || ' > ' || string_split(steps, ' ')[i + 1])))) END AS items FROM arcs),
classes AS (SELECT session, items, min(arc) AS id FROM sets GROUP BY session, items),
near AS (SELECT x.session, x.id AS a, y.id AS b FROM classes x JOIN classes y ON x.session = y.session AND x.id <> y.id
  WHERE len(list_intersect(x.items, y.items)) / greatest(len(list_distinct(list_concat(x.items, y.items))), 1)::DOUBLE >= 0.42),
reach AS (SELECT session, id AS a, id AS b FROM classes UNION SELECT r.session, r.a, n.b FROM reach r JOIN near n ON n.session = r.session AND n.a = r.b)
SELECT session, arc::BIGINT AS arc, cluster::BIGINT AS cluster FROM sets JOIN classes USING (session, items) JOIN (SELECT session, a AS id, min(b) AS cluster FROM reach GROUP BY ALL) USING (session, id)""")
def leader_clusters(spark, sf_dir):
    return mining.leader_clusters(segment.arcs(event_turns(spark, sf_dir), 1440), "session")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user repeats, how regularly, and how much it counts."""
    a = segment.arcs(event_turns(spark, sf_dir), 1440)
    steps = mining.canonical_steps(a).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("rank", "action"))).alias("s")).select("session", F.transform("s", lambda x: x["action"]).alias("steps"))
    per = a.groupBy("session").agg(F.count("*").alias("runs"), F.median("turns").alias("turns"))
    c = _plain_candidates(per.join(steps, "session").join(mining.cadence(a), "session"))
    return scoring.score(c).select("session", "runs", "days", "label", F.array_join("steps", " > ").alias("steps"), "total").orderBy(F.col("total").desc(), "session")

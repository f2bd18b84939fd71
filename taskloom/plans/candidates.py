"""Queries of the second half of mining: similar rows, phrases, candidates, scores, kinds and the benchmark of the ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import commands, prompts
from ..functions import text as T
from ..operators import candidates, classify as kinds, clusters, evaluation, findings as found, leaders, mining, naming, report, scoring, segment, similar
from ..sources.transcripts import agent_stats
from ..written import written
from .events import event_turns
from .queries import _CADENCE_SQL, _arcs_sql, _quoted, _tokens_sql, query

_RUN = "|".join(c * 4 for c in "abcdefghijklmnopqrstuvwxyz") + "|----|____"


def _meaningful_sql(x: str) -> str:
    return f"length({x}) BETWEEN 3 AND 20 AND NOT regexp_matches({x}, '[0-9./]') AND NOT regexp_full_match({x}, '[a-f]{{8,}}') AND NOT regexp_matches({x}, '{_RUN}')"


def _arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.arcs(event_turns(spark, sf_dir), 1440)


#: How commands begin; put before the first words of each document.
_BEGIN = ["git commit -m '", "FOO=1 sudo npm run ", "cd /tmp && gh pr ", "/usr/bin/docker.exe ", "ls -la | grep ", "nohup ", "yarn run run ", "make -j8 \"", ""]
_FIELD, _QUOTES, _BREAK = commands.FIELD.replace("'", "''"), "'\"' || chr(39)", r"'\s*(?:&&|\|\||;|\||\n)\s*'"


def _program_sql(f: str) -> str:
    return f"regexp_replace(regexp_extract(trim({f}, {_QUOTES}), '([^/]*)/*\\z', 1), '\\.exe\\z', '')"


@query(f"""WITH c AS (SELECT doc_id, trim([{_quoted(_BEGIN)}][1 + doc_id % {len(_BEGIN)}] || substr(coalesce(text, ''), 1, 60)) AS command FROM documents),
s AS (SELECT doc_id, unnest(string_split_regex(command, {_BREAK})) AS segment, generate_subscripts(string_split_regex(command, {_BREAK}), 1) AS i FROM c),
f AS (SELECT doc_id, i, regexp_extract_all(segment, '{_FIELD}') AS f FROM s),
g AS (SELECT doc_id, i, f, list_position(list_transform(f, lambda x: NOT regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_]*=') AND NOT list_contains([{_quoted(commands.WRAPPERS)}], {_program_sql("x")})), true) AS k FROM f),
h AS (SELECT doc_id, i, {_program_sql("f[k]")} AS program, list_filter(list_transform(list_filter(f[k + 1:], lambda x: NOT starts_with(x, '-')), lambda x: lower(trim(x, {_QUOTES}))), lambda x: x NOT IN ('', '.', '..') AND NOT regexp_matches(x, '[/\\\\]|^[$~]')) AS rest FROM g WHERE k > 0),
j AS (SELECT doc_id, i, array_to_string(list_concat([program], CASE WHEN program IN ({_quoted(commands.TWO_WORDS)}) THEN rest[1:2]
  WHEN program IN ({_quoted(commands.ONE_WORD)}) THEN rest[1:CASE WHEN program IN ({_quoted(commands.RUNNERS)}) AND rest[1] = 'run' THEN CASE WHEN rest[2] = 'run' THEN 3 ELSE 2 END ELSE 1 END] ELSE [] END), ' ') AS shape FROM h),
r AS (SELECT doc_id, shape, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM j WHERE shape <> ''),
o AS (SELECT doc_id, string_agg(shape, ' && ' ORDER BY r) AS shape FROM r WHERE r <= 4 GROUP BY doc_id)
SELECT doc_id, coalesce(shape, '') AS shape FROM documents LEFT JOIN o USING (doc_id)""")
def command_shape(spark, sf_dir):
    """The first words of each document behind nine beginnings of commands, with open quotes, options and line breaks as they come."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begin = F.element_at(F.array(*map(F.lit, _BEGIN)), (1 + F.col("doc_id") % len(_BEGIN)).cast("int"))
    return d.select("doc_id", commands.command_shape(F.concat(begin, F.substring(F.coalesce("text", F.lit("")), 1, 60))).alias("shape"))


_SPACED = r"regexp_replace(coalesce(text, ''), '^[\s\x{85}\x{A0}]+|[\s\x{85}\x{A0}]+$', '', 'g')"


@query(f"""SELECT conv_id, turn, sha256(CASE WHEN (conv_id + turn) % 5 = 3 AND {_SPACED} <> '' THEN '/eod ' || {_SPACED} WHEN (conv_id + turn) % 5 = 3 THEN '/eod' WHEN (conv_id + turn) % 5 = 4 THEN '' ELSE {_SPACED} END) AS prompt FROM conversations""")
def clean_prompt(spark, sf_dir):
    """All turns of conversations, wrapped as tools wrap them: behind a block, in a query, behind unknown blocks, as a command's arguments, in a block that never ends."""
    c, k = spark.read.parquet(f"{sf_dir}/conversations.parquet"), (F.col("conv_id") + F.col("turn")) % 5
    said = F.coalesce("text", F.lit(""))
    wraps = [("<env>\nx <b>y</b></env> ", ""), ("<rules>r</rules>\n<user_query>\n", "\n</user_query> more"), ("<my-block>gone</my-block> <other_one>too</other_one> ", ""), ("<command-name>/Team:eod</command-name><command-args> ", " </command-args>"), ("<system-reminder> ", "")]
    wrapped = F.coalesce(*(F.when(k == i, F.concat(F.lit(a), said, F.lit(b))) for i, (a, b) in enumerate(wraps)))
    return c.select("conv_id", "turn", F.sha2(prompts.clean_prompt(wrapped).cast("binary"), 256).alias("prompt"))


@query("SELECT doc_id, " + " OR ".join(f"contains(lower(substr(text, 1, 400)), '{m}')" for m in commands.FAILURES) + " AS failed FROM documents WHERE text IS NOT NULL")
def error_markers(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", commands.failed(F.col("text")).alias("failed"))


@query(f"WITH {_tokens_sql('documents', 'doc_id')} SELECT token, count(DISTINCT doc_id) AS df FROM tok WHERE {_meaningful_sql('token')} GROUP BY token")
def meaningful_tokens(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))
    return d.where(T.meaningful(F.col("token"))).groupBy("token").agg(F.count("*").alias("df"))


@query(f"""WITH {_arcs_sql(1440)}, s AS (SELECT session, arc, string_split(steps, ' ') AS x FROM arcs WHERE n_steps > 0),
r AS (SELECT session, arc, unnest(CASE WHEN len(x) >= 2 THEN list_transform(range(1, len(x)), lambda i: x[i] || ' > ' || x[i + 1]) ELSE x END) AS shingle FROM s)
SELECT shingle, count(DISTINCT (session, arc)) AS df FROM r GROUP BY shingle""")
def shingles_df(spark, sf_dir):
    return _arcs(spark, sf_dir).select(F.explode(F.array_distinct(T.shingles(F.col("steps"), 2))).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("df"))


_ITEMS = f"""{_tokens_sql('benchmark', 'item_id')}, n AS (SELECT count(*) AS docs FROM benchmark), u AS (SELECT DISTINCT item_id, token FROM tok),
idf AS (SELECT token, ln((docs + 1) / (count(*) + 1)) + 1 AS idf FROM u, n GROUP BY token, docs),
w AS (SELECT item_id, token, (1 + ln(count(*))) * any_value(idf) AS weight FROM tok JOIN idf USING (token) GROUP BY item_id, token),
norms AS (SELECT item_id, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY item_id),
cos AS (SELECT x.item_id AS a, y.item_id AS b, sum(x.weight * y.weight) AS dot FROM w x JOIN w y USING (token) WHERE x.item_id < y.item_id GROUP BY 1, 2),
cosines AS (SELECT a, b, dot / (na.norm * nb.norm) AS cosine FROM cos JOIN norms na ON na.item_id = a JOIN norms nb ON nb.item_id = b),
sets AS (SELECT item_id, token FROM u WHERE length(token) >= 5), sizes AS (SELECT item_id, count(*) AS size FROM sets GROUP BY item_id),
commons AS (SELECT x.item_id AS a, y.item_id AS b, count(*) AS shared FROM sets x JOIN sets y USING (token) WHERE x.item_id < y.item_id GROUP BY 1, 2),
jaccards AS (SELECT a, b, shared / (sa.size + sb.size - shared)::DOUBLE AS jaccard FROM commons JOIN sizes sa ON sa.item_id = a JOIN sizes sb ON sb.item_id = b)"""


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"), "text")
    sets = d.select("id", F.filter(F.array_distinct(T.tokens(F.col("text"))), lambda t: F.length(t) >= 5).alias("items"))
    return mining.tfidf(d, "id", T.tokens(F.col("text"))), sets


@query(f"WITH {_ITEMS} SELECT a, b, floor(jaccard * 1000 + 0.5) / 1000 AS jaccard FROM jaccards WHERE jaccard >= 0.02")
def jaccard_pairs(spark, sf_dir):
    return similar.jaccard_pairs(_items(spark, sf_dir)[1], 0.02).withColumn("jaccard", T.round3(F.col("jaccard")))


@query(f"WITH {_ITEMS} SELECT a, b, floor(cosine * 1000 + 0.5) / 1000 AS cosine FROM cosines WHERE cosine >= 0.1")
def cosine_pairs(spark, sf_dir):
    return similar.cosine_pairs(_items(spark, sf_dir)[0], 0.1).withColumn("cosine", T.round3(F.col("cosine")))


@query(f"""WITH {_ITEMS} SELECT a, b, floor((coalesce(cosine, 0) * 0.55 + coalesce(jaccard, 0) * 0.45) * 1000 + 0.5) / 1000 AS similarity
FROM cosines FULL JOIN jaccards USING (a, b) WHERE coalesce(cosine, 0) * 0.55 + coalesce(jaccard, 0) * 0.45 >= 0.08""")
def blended_pairs(spark, sf_dir):
    return similar.blended_pairs(*_items(spark, sf_dir), threshold=0.08).select("a", "b", T.round3(F.col("similarity")).alias("similarity"))


@query(f"""WITH l AS (SELECT source, doc_id, list_filter(list_transform(regexp_extract_all(lower(substr(text, 1, 600)), '[a-z0-9][a-z0-9_\\-.]*'), lambda x: trim(x, '-._')), lambda x:
  length(x) >= 2 AND NOT list_contains([{_quoted(T.STOPWORDS)}], x) AND {_meaningful_sql('x')}) AS w FROM documents WHERE text IS NOT NULL),
r AS (SELECT source, doc_id, len(w) AS n, unnest(range(1, len(w))) AS i, w, 2 AS k FROM l UNION ALL SELECT source, doc_id, len(w), unnest(range(1, len(w) - 1)), w, 3 FROM l),
p AS (SELECT source, doc_id, array_to_string(w[i:i + k - 1], ' ') AS phrase, min((i - 1) / n::DOUBLE) AS pos FROM r
  WHERE len(list_filter(w[i:i + k - 1], lambda x: NOT list_contains([{_quoted(candidates.LITTLE)}], x))) >= 2 GROUP BY ALL),
g AS (SELECT source, phrase, count(*) AS c, sum(pos) AS pos FROM p GROUP BY ALL), e AS (SELECT phrase, sum(c) AS df FROM g GROUP BY phrase),
s AS (SELECT source, count(*) AS size FROM l GROUP BY source), t AS (SELECT count(*) AS total FROM l),
f AS (SELECT g.source, phrase, c, pos, c / size::DOUBLE AS share, (df - c) / greatest(total - size, 1)::DOUBLE AS outside FROM g JOIN s ON s.source IS NOT DISTINCT FROM g.source JOIN e USING (phrase), t
  WHERE c >= 2 AND c / size::DOUBLE >= 0.05)
SELECT source, phrase, c AS count, floor(share * CASE WHEN (share + 0.01) / (outside + 0.01) <= 1 THEN 0.05 ELSE ln((share + 0.01) / (outside + 0.01)) END
  * CASE WHEN len(string_split(phrase, ' ')) >= 3 THEN 1.15 ELSE 1 END * (1 - 0.65 * pos / c) * 1000 + 0.5) / 1000 AS score FROM f WHERE source IS NOT NULL""")
def phrase_scores(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", "source", F.filter(T.tokens(F.substring("text", 1, 600)), T.meaningful).alias("words"))
    return candidates.phrase_scores(d, "source", F.col("words"), "doc_id", 0.05).select("source", "phrase", "count", T.round3(F.col("score")).alias("score"))


_SUMMARY = f"""{_CADENCE_SQL},
summary AS (SELECT session, count(*) AS runs, floor(median(turns) + 0.5)::BIGINT AS turns,
  floor(coalesce(median(CASE WHEN stop > start THEN (epoch_us(stop) - epoch_us(start)) / 60e6 END), 0) * 1000 + 0.5) / 1000 AS minutes, floor(avg((errors > 0)::INT) * 1000 + 0.5) / 1000 AS error_rate,
  least(sum(corrections), 6)::BIGINT AS n_corrections FROM arcs GROUP BY session)"""


@query(f"WITH {_SUMMARY} SELECT session, runs, 1::BIGINT AS sessions, turns, minutes, error_rate FROM summary")
def candidate_summary(spark, sf_dir):
    return candidates.summary(_arcs(spark, sf_dir).withColumn("of", F.col("session")), "of").withColumnRenamed("of", "session")


@query(f"""WITH {_arcs_sql(1440)}, vs AS (SELECT DISTINCT session, arc, unnest(string_split(steps, ' ')) AS v FROM arcs WHERE n_steps > 0), cs AS (SELECT session, v, count(*) AS n FROM vs GROUP BY ALL),
rs AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, v) AS r FROM cs) SELECT session, string_agg(v, ' ' ORDER BY r) AS tools FROM rs WHERE r <= 2 GROUP BY session""")
def top_tools(spark, sf_dir):
    return candidates.top_values(_arcs(spark, sf_dir), "session", "steps", 2).select("session", F.array_join("steps", " ").alias("tools"))


@query(f"""WITH {_arcs_sql(1440)}, p AS (SELECT session, arc_id, row_number() OVER (PARTITION BY session ORDER BY start NULLS FIRST, arc_id) - 1 AS pos, count(*) OVER (PARTITION BY session) AS n FROM arcs),
w AS (SELECT session, arc_id, n, pos, unnest(CASE WHEN n > 4 THEN range(0, 4) ELSE [pos] END) AS pick FROM p)
SELECT session, pick::BIGINT AS pick, arc_id FROM w WHERE n <= 4 OR pos = floor(pick * (n - 1) / 3.0 + 0.5)""")
def evidence_stride(spark, sf_dir):
    return candidates.evidence(_arcs(spark, sf_dir), "session", 4)


_TRIVIAL = _quoted(scoring.TRIVIAL)
_SCORED = f"""{_SUMMARY},
steps_total AS (SELECT session, count(*) AS arcs FROM arcs GROUP BY session),
each_ AS (SELECT session, arc, n_steps, unnest(string_split(steps, ' ')) AS action, generate_subscripts(string_split(steps, ' '), 1) - 1 AS i FROM arcs WHERE n_steps > 0),
firsts AS (SELECT session, arc, action, min(CASE WHEN n_steps > 1 THEN i::DOUBLE / (n_steps - 1) ELSE 0 END) AS i FROM each_ GROUP BY ALL),
common AS (SELECT f.session, action, count(*) AS c, floor(median(i) * 1000 + 0.5) / 1000 AS position, any_value(arcs) AS arcs FROM firsts f JOIN steps_total t ON f.session = t.session GROUP BY f.session, action),
named AS (SELECT session, list(action ORDER BY position, c DESC, action) AS steps, first(floor(c::DOUBLE / arcs * 1000 + 0.5) / 1000 ORDER BY position, c DESC, action) AS first_support FROM common WHERE c::DOUBLE / arcs >= 0.45 GROUP BY session),
cand AS (SELECT *, 1 + session % 4 AS n_repos, 1 + session % 3 AS n_agents, 1 + session % 5 AS sessions, (session % 10) / 10.0::DOUBLE AS cohesion, CASE WHEN session % 3 > 0 THEN (session % 7)::DOUBLE END AS phrase FROM named JOIN summary USING (session) JOIN cad USING (session)),
parts AS (SELECT *, least(1, CASE WHEN days <= 1 THEN 0.05 ELSE ln(days) / ln(12) END) AS recurrence,
  least(1, least(1, len(steps) / 8.0::DOUBLE) * 0.4 + least(1, turns / 25.0::DOUBLE) * 0.25 + least(1, len(list_filter(steps, lambda s: NOT list_contains([{_TRIVIAL}], s))) / 5.0::DOUBLE) * 0.35) AS complexity,
  CASE WHEN phrase IS NULL THEN 0.1 ELSE least(1, phrase / 5) END AS repetition, least(1, error_rate * 0.7 + least(n_corrections / 4.0::DOUBLE, 1) * 0.3) AS friction,
  least(1, least(1, (n_repos - 1) / 3.0::DOUBLE) * 0.6 + least(1, (n_agents - 1) / 2.0::DOUBLE) * 0.4) AS breadth,
  CASE WHEN minutes * runs <= 0 THEN 0.15 ELSE least(1, ln(1 + minutes * runs) / ln(241)) END AS time_spent,
  CASE WHEN n_corrections = 0 THEN 0 ELSE least(1, n_corrections / 3.0::DOUBLE * 0.7 + n_corrections / 6.0::DOUBLE * 0.3) END AS corrections,
  CASE WHEN len(steps) > 0 AND len(list_filter(steps, lambda s: list_contains([{_TRIVIAL}], s))) / greatest(len(steps), 1)::DOUBLE > 0.8 THEN 0.5 ELSE 1 END * CASE WHEN len(steps) <= 1 THEN 0.65 ELSE 1 END
  * CASE WHEN cohesion < 0.35 THEN 0.7 ELSE 1 END * CASE WHEN days <= 1 THEN 0.55 ELSE 1 END * CASE WHEN sessions < 3 AND runs >= 5 THEN 0.75 ELSE 1 END AS penalty FROM cand),
scored AS (SELECT *, recurrence * 0.2 + regularity * 0.1 + complexity * 0.18 + repetition * 0.12 + friction * 0.1 + breadth * 0.08 + time_spent * 0.08 + cohesion * 0.09 + corrections * 0.05 AS blend FROM parts),
totals AS (SELECT *, round((least(1, blend * penalty) * 100)::DOUBLE, 1) AS total, round((blend * 100)::DOUBLE, 1) AS raw FROM scored)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as candidates; what the events table lacks (repositories, agents, phrases, cohesion) is made of the user's number."""
    a = _arcs(spark, sf_dir)
    steps = mining.canonical_steps(a).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("rank", "action", "support"))).alias("s"))
    steps = steps.select("session", F.transform("s", lambda x: x["action"]).alias("steps"), F.col("s")[0]["support"].alias("first_support"))
    wishes = a.groupBy("session").agg(F.least(F.sum("corrections"), F.lit(6)).alias("n_corrections"))
    u = F.col("session")
    c = candidates.summary(a.withColumn("of", u), "of").drop("sessions").withColumnRenamed("of", "session").join(steps, "session").join(mining.cadence(a), "session").join(wishes, "session")
    c = c.withColumns({"n_repos": 1 + u % 4, "n_agents": 1 + u % 3, "sessions": 1 + u % 5, "cohesion": (u % 10) / 10, "phrase": F.when(u % 3 > 0, (u % 7).cast("double")), "n_standing": F.col("n_corrections")})
    return scoring.score(c)


@query(f"WITH {_SCORED} SELECT session, total, raw, floor(penalty * 1000 + 0.5) / 1000 AS penalty, {', '.join(f'floor({p} * 1000 + 0.5) / 1000 AS {p}' for p in ('complexity', 'repetition', 'friction', 'breadth', 'time_spent', 'corrections'))} FROM totals")
def score_total(spark, sf_dir):
    parts = (T.round3(F.col(p)).alias(p) for p in ("penalty", "complexity", "repetition", "friction", "breadth", "time_spent", "corrections"))
    return _scored(spark, sf_dir).select("session", "total", "raw", *parts)


@query(f"""WITH {_SCORED}, told AS (SELECT *, CASE session % 7 WHEN 3 THEN ['read', 'search', 'list'] WHEN 5 THEN ['shell:git push', 'edit', 'write', 'browser'] ELSE steps END AS done FROM totals)
SELECT session, CASE WHEN session % 11 = 0 THEN 'update' WHEN session % 13 = 0 THEN 'update' WHEN total < 66 THEN 'ignore' WHEN session % 7 = 5 THEN 'hook'
  WHEN len(done) >= 2 AND len(list_filter(done, lambda s: s IN ('edit', 'write', 'browser') OR s LIKE 'shell:%')) = 0 AND len(list_filter(done, lambda s: s IN ('read', 'search', 'list', 'web_fetch'))) / len(done)::DOUBLE >= 0.8 THEN 'reference'
  WHEN len(done) <= 3 AND regularity > 0.4 THEN 'command' ELSE 'skill' END AS kind FROM told""")
def classify_kind(spark, sf_dir):
    """Scored users; the number of some gives them a skill, a match, or the steps of a reference or a hook."""
    u = F.col("session")
    c = _scored(spark, sf_dir).withColumns({"skill_ref": F.when(u % 11 == 0, F.lit("eod")), "skill_share": F.when(u % 11 == 0, F.lit(0.7)), "match": F.when(u % 13 == 0, F.lit(0.6))})
    reading, pushing = (F.array(*map(F.lit, x)) for x in (["read", "search", "list"], ["shell:git push", "edit", "write", "browser"]))
    c = c.withColumns({"steps": F.when(u % 7 == 3, reading).when(u % 7 == 5, pushing).otherwise(F.col("steps")), "first_support": F.when(u % 7 == 5, F.lit(0.9)).otherwise(F.lit(0.0))})
    return kinds.classify(c, 66.0).select("session", "kind")


@query(f"""WITH {_tokens_sql('documents', 'doc_id')}, t AS (SELECT DISTINCT doc_id, token FROM tok),
f AS (SELECT DISTINCT item_id AS rank, token FROM (SELECT item_id, regexp_replace(unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_\\-.]*')), '^[\\-._]+|[\\-._]+$', '', 'g') AS token FROM benchmark)
  WHERE length(token) >= 2 AND token NOT IN ({_quoted(T.STOPWORDS)}) AND NOT regexp_full_match(token, '[0-9]+')),
n AS (SELECT rank, count(*) AS n FROM f GROUP BY rank), c AS (SELECT doc_id, rank, count(*) / any_value(n)::DOUBLE AS sim FROM t JOIN f USING (token) JOIN n USING (rank) GROUP BY doc_id, rank),
b AS (SELECT doc_id, min(rank) + 1 AS rank FROM c WHERE sim >= 0.45 GROUP BY doc_id), r AS (SELECT d.doc_id, rank FROM documents d LEFT JOIN b USING (doc_id))
SELECT count(*) AS evaluated, {', '.join(f'floor(avg((coalesce(rank, 1e9) <= {k})::INT) * 1e6 + 0.5) / 1e6 AS recall_{k}' for k in (1, 3, 5, 10))}, floor(avg(coalesce(1.0::DOUBLE / rank, 0)) * 1e6 + 0.5) / 1e6 AS mrr FROM r""")
def recall_mrr(spark, sf_dir):
    truths = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("truth_id"), F.coalesce(T.tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
    findings = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select((F.col("item_id") + 1).alias("rank"), T.tokens(F.col("text")).alias("tokens"))
    out = candidates.recall(candidates.ranks(truths, findings))
    return out.select("evaluated", *((F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in out.columns[1:]))


@query("""SELECT user_id AS session, min(ts) AS start, max(ts) AS stop FROM events GROUP BY user_id
HAVING max(ts) >= TIMESTAMP '2024-01-15' AND bool_or(event_type = 'signup') AND contains('team' || (user_id % 3), 'm1')""")
def kept_sessions(spark, sf_dir):
    t = event_turns(spark, sf_dir).withColumn("workspace", F.concat(F.lit("Team"), F.col("session") % 3))
    return candidates.kept_sessions(t, "2024-01-15", "M1").select("session", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("stop"))


@query()
def arc_clusters(spark, sf_dir):
    """Arcs of all users in the order of time, grouped by what was asked and what was done; no SQL, as each choice depends on all before it."""
    members, groups = clusters.cluster_arcs(_arcs(spark, sf_dir))
    return members.join(groups, "cluster").select("session", "arc_id", "cluster", "runs", "cohesion")


@query()
def rule_groups(spark, sf_dir):
    """What people say again in other conversations: the opening lines of all their turns, grouped as standing wishes are."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'").select(F.col("conv_id").alias("session"), "turn", T.first_line(F.col("text")).alias("text"))
    grouped = candidates.group_wishes(c.where("text is not null"), ["session", "turn", "text"])
    rules = candidates.rule_groups(grouped.drop("group"), grouped.select("id", "group"))
    return rules.select("rule_id", "text", "theme", "occurrences", "sessions", F.array_join("keywords", " ").alias("keywords"))


@query()
def findings(spark, sf_dir):
    """From the turns of all users to ranked findings: clusters, steps, phrases, titles, scores and kinds."""
    turns = event_turns(spark, sf_dir).withColumns({"agent": F.concat(F.lit("agent"), F.col("session") % 2), "repo": F.concat(F.lit("repo"), F.col("session") % 3)})
    out = found.findings(turns, idle_minutes=1440)
    return out.select("rank", "id", "title", "slug", "summary", "kind", "total", "runs", "sessions", "cohesion", F.array_join("steps", " ").alias("steps"))


_LABELS = {"click": "browser", "view": "read", "purchase": "shell:git push", "signup": "mcp:slack:send-message"}


@query("SELECT event_id, CASE " + " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in {"click": "Verify in a browser", "view": "Read the relevant files", "purchase": "Run `git push`", "signup": "Call the slack integration (send message)"}.items()) + """
  ELSE 'Perform ' || replace(event_type, '_', ' ') END AS instruction, CASE event_type WHEN 'click' THEN 'browser' WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'git push' WHEN 'signup' THEN 'slack' ELSE event_type END AS label FROM events""")
def step_instructions(spark, sf_dir):
    """Events as actions of four sorts and others, told as instructions and labels."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    action = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in _LABELS.items()), F.col("event_type"))
    return e.select("event_id", naming.describe_step(action).alias("instruction"), naming.short_step(action).alias("label"))


@query()
def recall_as_of(spark, sf_dir):
    """Each user's last arc as a truth of its day: was its work among the groups of arcs that were there before it, and at which rank?"""
    arcs = _arcs(spark, sf_dir)
    words = clusters.intent_tokens(F.col("intent"), F.col("prompts"), F.col("tools"))
    rows = written(leaders.numbered(arcs.select("session", "arc", "start", words.alias("tokens"), similar.step_set(F.col("steps")).alias("set")), "start", "session", "arc"))
    each = rows.select("n", F.explode("tokens").alias("token"))
    groups = leaders.greedy_groups(rows, rows.select("n", F.explode("set").alias("item")), mining.tfidf(rows, "n", F.col("tokens")), 0.42, 0.55)
    last = rows.groupBy("session").agg(F.max(F.struct("arc", "start", "tokens")).alias("last"))
    truths = last.select(F.col("session").alias("truth_id"), F.col("last.start").alias("cutoff"), F.col("last.tokens").alias("tokens"))
    return candidates.recall(evaluation.ranks_as_of(truths, rows.select("n", "start"), groups, each))


@query("""WITH s AS (SELECT event_type AS agent, count(DISTINCT user_id) AS sessions, min(ts) AS earliest, max(ts) AS latest FROM events GROUP BY event_type)
SELECT min(earliest) AS earliest, max(latest) AS latest, coalesce(sum(sessions), 0)::BIGINT AS sessions, count(*) AS agents,
  CASE WHEN min(earliest) IS NULL THEN 'undated' ELSE strftime(min(earliest), '%Y-%m-%d') || ' → ' || strftime(max(latest), '%Y-%m-%d') END AS range FROM s""")
def report_window(spark, sf_dir):
    """What a report over all events covers, each type of event being an agent."""
    w = report.window(agent_stats(event_turns(spark, sf_dir).withColumn("agent", F.coalesce("tool", "actor"))))
    return w.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("earliest", "latest")})


@query("""WITH n AS (SELECT max(ts) AS now FROM events), s AS (SELECT user_id AS session, min(ts) AS a, max(ts) AS z, any_value(now) AS now FROM events, n GROUP BY user_id)
SELECT session, CASE WHEN a IS NULL THEN 'undated' ELSE strftime(a, '%Y-%m-%d') || ' → ' || strftime(z, '%Y-%m-%d') END AS range,
  CASE WHEN z IS NULL THEN 'unknown' WHEN date_sub('second', z, now) < 60 THEN 'just now' WHEN date_sub('second', z, now) < 3600 THEN date_sub('minute', z, now) || ' minutes ago'
    WHEN date_sub('second', z, now) < 86400 THEN date_sub('hour', z, now) || ' hours ago' ELSE date_sub('hour', z, now) // 24 || ' days ago' END AS age FROM s""")
def session_ages(spark, sf_dir):
    """Days of each user's first and last event, and how long before the last of all events the user's last was."""
    t = event_turns(spark, sf_dir)
    now = t.agg(F.max("at").alias("now")).scalar()
    s = t.groupBy("session").agg(F.min("at").alias("a"), F.max("at").alias("z"))
    return s.select("session", report.range_label(F.col("a"), F.col("z")).alias("range"), report.age_label(F.col("z"), now).alias("age"))


@query(f"""WITH lines AS (SELECT trim(unnest(list_distinct(string_split(text, chr(10))))) AS line, doc_id FROM documents),
rules AS (SELECT line, count(*) AS occurrences FROM (SELECT DISTINCT line, doc_id FROM lines WHERE line <> '') GROUP BY line HAVING count(*) >= 2),
{_tokens_sql('rules', 'line', 'line')}, w AS (SELECT DISTINCT line, token FROM tok), wn AS (SELECT line, count(*) AS n FROM w GROUP BY line),
h AS (SELECT DISTINCT item_id::VARCHAR AS item, token FROM (SELECT item_id, regexp_replace(unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_\\-.]*')), '^[\\-._]+|[\\-._]+$', '', 'g') AS token FROM benchmark)),
c AS (SELECT w.line, item, count(*)::DOUBLE / any_value(n) AS match FROM w JOIN h USING (token) JOIN wn ON wn.line = w.line GROUP BY w.line, item),
b AS (SELECT line, item, match FROM c WHERE match >= 0.55 QUALIFY row_number() OVER (PARTITION BY line ORDER BY match DESC, item) = 1),
d AS (SELECT sha256(line) AS rule_id, occurrences, item AS existing, match FROM rules LEFT JOIN b USING (line))
SELECT rule_id, occurrences, coalesce(existing, '') AS existing, CASE WHEN existing IS NULL THEN 'rule' ELSE 'ignore' END AS kind, floor((CASE WHEN existing IS NULL THEN least(occurrences / 5, 1) ELSE match END) * 1000 + 0.5) / 1000 AS confidence,
  CASE WHEN existing IS NULL THEN row_number() OVER (PARTITION BY existing IS NULL ORDER BY occurrences DESC, rule_id) ELSE 0 END AS rank FROM d""")
def rule_decisions(spark, sf_dir):
    """Lines of two documents or more as standing wishes, benchmark items as installed rules files: what is covered (rank 0), and the rank of the others."""
    d, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    lines = d.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line")).where("line <> ''").distinct()
    rules = lines.groupBy("line").agg(F.count("*").alias("occurrences")).where("occurrences >= 2")
    rules = written(rules.select(F.sha2(F.col("line").cast("binary"), 256).alias("rule_id"), "occurrences", T.tokens(F.col("line")).alias("keywords")))
    name = F.col("item_id").cast("string")
    told = written(report.decided(rules, items.select(F.lit("rules").alias("kind"), name.alias("name"), name.alias("path"), T.tokens(F.col("text")).alias("tokens"))))
    ranked = report.actionable_rules(told).select("rule_id", "rank")
    return told.join(ranked, "rule_id", "left").select("rule_id", "occurrences", F.coalesce("existing", F.lit("")).alias("existing"), "kind", T.round3(F.col("confidence")).alias("confidence"), F.coalesce("rank", F.lit(0)).alias("rank"))

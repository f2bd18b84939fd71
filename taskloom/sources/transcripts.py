"""Transcript files of many tools as turns.

Every tool writes records of about one shape: a role, a content that is a text or
a list of blocks, tool calls inside or beside it, and a time. Records are read as
variants and taken apart by path, so a malformed record costs only itself. A
``Layout`` says what differs between tools: lines or whole documents, where the
session's id is, what is unwrapped or left out, and which file beside a
transcript says what the session is about. One file is one session.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.commands import command_shape, extract_command, failed, flatten_args, path_shapes, repo_name
from ..functions.prompts import clean_prompt, gist, repair_punctuation, skill_refs, without_skill_refs
from ..functions.redact import redact
from ..functions.text import bound
from ..functions.tools import canonical_tool
from ..written import written

MOST_TURNS, MOST_TEXT, MOST_ARG, MOST_FILE = 4000, 8000, 400, 256 << 20

#: Spellings of a speaker, and the fields in which records, folders and times stand.
SPEAKERS = {
    "user": ["user", "human", "input"],
    "assistant": ["assistant", "model", "gemini", "ai", "agent", "output", "qwen", "kimi", "copilot"],
    "tool": ["tool", "function", "tool_result", "function_response", "observation"],
    "system": ["system", "developer"],
}
LISTS = ["messages", "history", "chatHistory", "turns", "events", "conversation", "records", "items"]
INNER = ["session", "state", "data", "chat"]
FOLDERS = ["cwd", "workspace", "workingDirectory", "working_directory", "projectRoot", "project_root", "directory", "root", "path"]
ABOUT = ["info", "metadata", "meta", "session", "context", "state"]
TIMES = ["timestamp", "time", "createdAt", "created_at", "ts", "date"]
CALLS = ["tool_calls", "toolCalls", "function_calls", "functionCalls"]


@dataclass(frozen=True)
class About:
    """A file beside the transcripts that says what a session is about; it belongs to the transcripts with the same ``owner``."""

    glob: str
    owner: str  # what of the file's path tells the session
    transcript: str  # what of a transcript's path does
    title: tuple[str, ...] = ()
    id: tuple[str, ...] = ()
    begun: tuple[str, ...] = ()
    folder: tuple[str, ...] = ()


@dataclass(frozen=True)
class Layout:
    """How a tool stores its sessions."""

    glob: str = "*.jsonl"
    document: bool = False  # a whole JSON document, else one record a line
    unwrap: tuple[str, ...] = ()  # objects that hold the record proper
    each_block: bool = False  # every text block is a message of its own
    mtime: bool = True  # undated records take the file's time
    skip: tuple[str, ...] = ()  # types of records that are no turns
    spoken: tuple[tuple[str, str], ...] = ()  # how types of records begin, and who speaks; other types are no turns
    session: str = r"([^/]*?)(?:\.messages)?\.jsonl?$"  # what of the path is the session's id
    project: str = ""  # what of the path names the project, where nothing else does
    slug: bool = False  # that name has hyphens for separators, else it is percent-encoded
    about: About | None = None


_FOLDER_ID = r"([^/]*)/[^/]*$"

#: Where each tool keeps what, and how it names it.
LAYOUTS = {
    "generic": Layout(),
    "claude": Layout(each_block=True, mtime=False, skip=("system", "summary", "ai-title", "attachment", "progress")),
    "codex": Layout(unwrap=("payload",), mtime=False, skip=("session_meta", "turn_context", "event_msg")),
    "cursor": Layout(each_block=True, project=r"([^/]*)/agent-transcripts/", slug=True),
    "gemini": Layout(glob="*.json", document=True),
    "grok": Layout(
        glob="chat_history.jsonl", skip=("system", "reasoning"), session=_FOLDER_ID, project=r"([^/]*)/[^/]*/[^/]*$",
        about=About("summary.json", r"^(.*)/", r"^(.*)/", ("session_summary", "title"), ("info.id",), (), ("info.cwd", "git_root_dir")),
    ),
    "qwen": Layout(),
    "kimi": Layout(
        unwrap=("event",), spoken=(("turn.prompt", "user"), ("context.append", "assistant")), session=r"([^/]*)/agents/.*$|([^/]*)/[^/]*/[^/]*$", project=r"([^/]*)/[^/]*/agents/.*$",
        about=About("state.json", r"^(.*)/", r"^(.*)/agents/.*$|^(.*)/[^/]*/[^/]*$", ("title", "summary", "name"), (), (), ("workDir", "workdir", "cwd", "workspaceRoot")),
    ),
    "copilot": Layout(unwrap=("data",), session=_FOLDER_ID),
    "cline": Layout(
        glob="{*.messages.json,api_conversation_history.json}", document=True, session=_FOLDER_ID,
        about=About("*.json", r"^(.*)\.json$", r"^(.*)\.messages\.json$", (), (), ("started_at", "startedAt", "time_created", "createdAt", "ts"), ("workspace_root", "workspaceRoot", "cwd", "directory")),
    ),
    "pi": Layout(),
}


def _get(v: Column, *names: str) -> Column:
    """The first of the fields that is a text or another scalar and not empty."""
    return F.get(F.filter(F.array(*(F.try_variant_get(v, f"$.{n}", "string") for n in names)), lambda x: x != ""), 0)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def parse_time(raw: Column) -> Column:
    """RFC 3339 times, and seconds or milliseconds since 1970."""
    number = F.try_to_number(raw, F.lit("99999999999999")).cast("double")
    seconds = F.when(number > 1e12, number / 1000).otherwise(number)
    return F.coalesce(F.when(raw.rlike("^[0-9]{9,14}$"), F.timestamp_seconds(seconds)), F.when(~raw.rlike("^[0-9]+$"), F.try_to_timestamp(raw)))


def _time(v: Column, names: list[str]) -> Column:
    read = F.transform(F.array(*(F.try_variant_get(v, f"$.{n}", "string") for n in names)), parse_time)
    return F.get(F.filter(read, lambda t: t.isNotNull()), 0)


def _field(v: Column) -> Column:
    return _get(v, "text", "content", "value")


def content_text(v: Column) -> Column:
    """The prose of a content: a text, a list of texts and text blocks (other blocks have none), or one block."""

    def prose(b: Column) -> Column:
        return F.when(_is(b, "STRING"), F.try_variant_get(b, "$", "string")).when(F.coalesce(_get(b, "type"), F.lit("text")).isin("text", "input_text", "output_text", "summary_text"), _field(b))

    def text(v: Column) -> Column:
        said = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), prose), lambda x: x.isNotNull())
        return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string")).when(_is(v, "ARRAY"), F.trim(F.array_join(said, "\n"))).when(_is(v, "OBJECT"), _field(v))

    return bound(v, text)


def _array(v: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))


def _args(b: Column) -> Column:
    """The arguments of a call as JSON text; arguments that are a text already stand as they are."""
    found = F.coalesce(*(F.try_variant_get(b, f"$.{p}", "variant") for p in ("input", "args", "arguments", "parameters", "function.arguments", "functionCall.args", "action")))
    return bound(found, lambda v: F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v)))


def _piece(b: Column, call: bool = False) -> Column:
    """A block as struct<kind, name, text, args, flag, status>."""
    kind = F.lower(F.coalesce(_get(b, "type"), F.lit("")))

    def told(k: Column) -> Column:
        is_call = F.lit(call) | k.isin("tool_use", "tooluse", "tool_call", "function_call", "custom_tool_call", "local_shell_call") | F.try_variant_get(b, "$.functionCall", "variant").isNotNull()
        is_result = k.isin("tool_result", "toolresult", "function_response", "function_call_output", "custom_tool_call_output", "tool_call_output") | F.try_variant_get(b, "$.functionResponse", "variant").isNotNull()
        return bound(F.struct(k.alias("type"), F.when(is_call, "tool_call").when(is_result, "tool_result").otherwise("message").alias("kind")), filled)

    def filled(k: Column) -> Column:
        answer = F.coalesce(*(F.try_variant_get(b, f"$.{p}", "variant") for p in ("content", "result", "output", "functionResponse.response", "response")))
        plain = F.when(_is(b, "STRING"), F.try_variant_get(b, "$", "string")).when(k["type"].isin("", "text", "input_text", "output_text", "summary_text"), _field(b))
        return F.struct(
            k["kind"].alias("kind"),
            _get(b, "name", "tool", "toolName", "tool_name", "function.name", "functionCall.name", "functionResponse.name").alias("name"),
            F.when(k["kind"] == "tool_result", F.coalesce(content_text(answer), F.lit(""))).when(k["kind"] == "message", plain).alias("text"),
            F.when(k["kind"] == "tool_call", _args(b)).alias("args"),
            F.coalesce(*(F.try_variant_get(b, f"$.{p}", "boolean") for p in ("is_error", "isError", "error"))).alias("flag"),
            _get(b, "status", "state").alias("status"),
        )

    return bound(kind, told)


def _pieces(r: Column, each_block: bool) -> Column:
    """What a record says: its text first, then its calls and results, inside the content or beside it."""
    message = F.try_variant_get(r, "$.message", "variant")
    content = F.coalesce(F.try_variant_get(r, "$.message.content", "variant"), F.try_variant_get(r, "$.content", "variant"), F.when(_is(message, "STRING"), message))
    return bound(F.struct(content.alias("content"), F.concat(_array(r, "message.parts"), _array(r, "parts")).alias("parts")), lambda c: _said(r, c["content"], c["parts"], each_block))


def _said(r: Column, content: Column, parts: Column, each_block: bool) -> Column:
    blocks = F.concat(F.when(_is(content, "ARRAY"), F.try_variant_get(content, "$", "array<variant>")).otherwise(F.array().cast("array<variant>")), parts)
    calls = F.concat(*(_array(r, f"{level}{name}") for level in ("message.", "") for name in CALLS))
    prose = F.array_join(F.filter(F.transform(parts, _field), lambda x: x.isNotNull()), "\n")
    said = F.coalesce(F.nullif(F.trim(prose), F.lit("")), _get(r, "part.text", "part.content"), F.nullif(content_text(content), F.lit("")), _get(r, "text", "prompt", "value", "output"))
    whole = F.array(F.struct(F.lit("message").alias("kind"), F.lit(None).cast("string").alias("name"), said.alias("text"), F.lit(None).cast("string").alias("args"), F.lit(None).cast("boolean").alias("flag"), F.lit(None).cast("string").alias("status")))
    made = F.transform(blocks, lambda b: _piece(b))
    if each_block:
        of_blocks = F.when(_is(content, "ARRAY"), made).otherwise(whole)
    else:
        of_blocks = F.concat(whole, F.filter(made, lambda p: p["kind"] != "message"))
    return F.filter(F.concat(of_blocks, F.transform(calls, lambda c: _piece(c, True))), lambda p: (p["kind"] != "message") | (F.coalesce(p["text"], F.lit("")) != ""))


@F.pandas_udf(ArrayType(StringType()))
def recovered(texts: pd.Series) -> pd.Series:
    """The records of a document that was cut off: its lines where each is an object, else the complete elements of its first list of objects."""

    def rescue(text: str) -> list[str]:
        lines = [x.strip() for x in text.splitlines() if x.strip().startswith("{")]
        whole = []
        for line in lines:
            try:
                whole.append(json.dumps(json.loads(line)))
            except ValueError:
                continue
        if whole:
            return whole
        decoder, at = json.JSONDecoder(), text.find("[")
        while 0 <= at < len(text):
            at = next((k for k in range(at + 1, len(text)) if text[k] not in " \t\r\n,"), len(text))
            try:
                value, end = decoder.raw_decode(text, at)
            except ValueError:
                return whole
            if isinstance(value, dict):
                whole.append(json.dumps(value))
            at = end - 1
        return whole

    return texts.map(lambda t: rescue(t or ""))


def _files(spark: SparkSession, path: str, glob: str, whole: bool) -> DataFrame:
    return spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=whole, lineSep=None if whole else "\n")


def _path() -> Column:
    """The path of a row's file as it is on disk; Spark gives it percent-encoded."""
    return F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _records(spark: SparkSession, path: str, layout: Layout, most_file: int) -> DataFrame:
    """(source, mtime, block, line, r, about): the records of all files; about is the document around them.

    Lines are read by splits of files, so many tasks share a large file; block,
    where the split begins, and line, which grows within it, give their order.
    """
    files, meta = _files(spark, path, layout.glob, layout.document), F.col("_metadata")
    files = files.where((meta["file_size"] > 0) & (meta["file_size"] <= most_file))
    raw = files.select(_path().alias("source"), meta["file_modification_time"].alias("mtime"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    return _parsed(raw, layout)


def _parsed(raw: DataFrame, layout: Layout) -> DataFrame:
    """The records of lines, or of whole documents, as ``_records`` gives them."""
    if not layout.document:
        lines = raw.where(F.trim("value").startswith("{"))
        return lines.select("source", "mtime", "block", "line", F.try_parse_json("value").alias("r"), F.lit(None).cast("variant").alias("about")).where("r is not null")
    parsed = raw.select("source", "mtime", "block", "value", F.try_parse_json("value").alias("doc"))
    doc = F.col("doc")
    lists = [F.try_variant_get(doc, f"$.{inner}{name}", "array<variant>") for inner in ["", *(f"{i}." for i in INNER)] for name in LISTS]
    found = F.coalesce(F.try_variant_get(doc, "$", "array<variant>"), F.get(F.filter(F.array(*lists), lambda x: F.size(x) > 0), 0))
    good = parsed.where("doc is not null").select("source", "mtime", "block", F.posexplode(found).alias("line", "r"), F.when(_is(doc, "OBJECT"), doc).alias("about"))
    cut = parsed.where("doc is null").select("source", "mtime", "block", F.posexplode(recovered("value")).alias("line", "raw"))
    made = good.union(cut.select("source", "mtime", "block", "line", F.try_parse_json("raw"), F.lit(None).cast("variant")))
    return made.withColumn("line", F.col("line").cast("long"))


def _owner(path: Column, pattern: str) -> Column:
    """What the pattern finds in a path; of its alternatives, the first that fits."""
    found = [F.nullif(F.regexp_extract(path, pattern, k + 1), F.lit("")) for k in range(pattern.count("(") - pattern.count("(?"))]
    return F.coalesce(*found)


def _siblings(spark: SparkSession, path: str, about: About) -> DataFrame:
    """(owner, sibling): what the files beside the transcripts say, one row for each owner."""
    doc = _files(spark, path, about.glob, True).select(_owner(_path(), about.owner).alias("owner"), F.try_parse_json("value").alias("d")).where("owner is not null and d is not null")
    d, none = F.col("d"), F.lit(None).cast("string")
    said = F.struct(
        (_get(d, *about.title) if about.title else none).alias("title"), (_get(d, *about.id) if about.id else none).alias("id"), _get(d, *about.folder).alias("folder"),
        (_time(d, list(about.begun)) if about.begun else F.lit(None).cast("timestamp")).alias("begun"), F.coalesce(F.lower(_get(d, "session_kind")) == "subagent", F.lit(False)).alias("subagent"),
    )
    return doc.groupBy("owner").agg(F.min(said).alias("sibling"))


def _first(value: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), F.struct("block", "line")))


def _folder(v: Column) -> Column:
    """The first field of a record, or of what it holds about itself, that names a folder."""
    found = F.array(*(F.try_variant_get(v, f"$.{p}{n}", "string") for p in ["", *(f"{a}." for a in ABOUT)] for n in FOLDERS))
    return F.get(F.filter(found, lambda x: x.rlike(r"[/\\]")), 0)


def _pieces_of(rows: DataFrame, layout: Layout) -> DataFrame:
    """A row for each piece of each record that is a turn, and what records tell about their session."""
    r, inner = F.col("r"), F.col("r")
    for name in layout.unwrap:
        inner = F.coalesce(F.when(_is(F.try_variant_get(r, f"$.{name}", "variant"), "OBJECT"), F.try_variant_get(r, f"$.{name}", "variant")), r)
    rows = rows.withColumn("x", inner)
    x, about = F.col("x"), F.col("about")
    told = F.struct(
        F.coalesce(_get(r, "sessionId", "session_id"), _get(x, "sessionId", "session_id"), F.when(_get(r, "type") == "session_meta", _get(x, "id")), _get(about, "sessionId", "session_id", "id")).alias("id"),
        F.coalesce(_get(r, "aiTitle", "title"), _get(about, "title", "summary", "name"), F.when(_get(x, "type") == "task_complete", gist(_get(x, "last_agent_message"), 90))).alias("title"),
        F.coalesce(_folder(r), _folder(x), _folder(about)).alias("folder"),
        _get(r, "gitBranch").alias("branch"),
        _time(about, ["startTime", "start_time", "createdAt", "lastUpdated"]).alias("begun"),
    )
    kind = F.lower(F.coalesce(_get(r, "type"), F.lit("")))
    side = F.coalesce(F.try_variant_get(r, "$.isSidechain", "boolean"), F.lit(False)) | F.coalesce(_get(r, "promptSource").isin("sdk", "system"), F.lit(False))
    says = F.lower(F.coalesce(_get(x, "message.role", "role", "type", "speaker", "author", "sender"), F.lit("")))

    def speaker(spoken: Column) -> Column:
        actor = F.lit(None).cast("string")
        for who, names in SPEAKERS.items():
            actor = F.when(spoken.isin(*names), F.lit(who)).otherwise(actor)
        return actor

    def judged(o: Column) -> Column:
        # Calls and results that are records themselves have no role.
        alone = o["own"]["kind"] != "message"
        pieces = F.when(alone & ~o["spoken"].isin("user", "assistant"), F.array(o["own"])).otherwise(_pieces(x, layout.each_block))
        who = F.when(alone, F.lit("assistant")).otherwise(speaker(o["spoken"]))
        return F.struct(F.coalesce(who, F.lit("assistant")).alias("who"), F.when(~F.coalesce(who == "system", F.lit(False)), pieces).alias("pieces"))

    if layout.spoken:
        who = F.lit(None).cast("string")
        for begins, name in reversed(layout.spoken):
            who = F.when(kind.startswith(begins), F.lit(name)).otherwise(who)
        turn = F.struct(who.alias("who"), F.when(who.isNotNull(), _pieces(x, layout.each_block)).alias("pieces"))
    else:
        turn = F.when(~side & ~kind.isin(*layout.skip), bound(F.struct(_piece(x).alias("own"), says.alias("spoken")), judged))
    at = F.coalesce(_time(r, TIMES), _time(x, TIMES), _time(x, ["message.timestamp", "message.createdAt"]))
    rows = rows.select("source", "mtime", "block", "line", told.alias("told"), at.alias("at"), turn.alias("turn"))
    # A record that is no turn keeps a row for what it tells.
    return rows.select("source", "mtime", "block", "line", "told", "at", F.col("turn.who").alias("who"), F.posexplode_outer("turn.pieces").alias("part", "p"))


def read_transcripts(spark: SparkSession, path: str, agent: str = "generic", home: str = "", most_file: int = MOST_FILE, keep_mail: bool = False) -> DataFrame:
    """Turns from all files of a tool below a path.

    (agent, session, source, title, workspace, repo, branch, idx, actor, kind,
    at, text, tool, args, command, paths, skills, is_error). Prompts are cleaned,
    texts and arguments redacted and cut, calls that are no work dropped, and at
    most 4000 turns of a session kept. Empty files and those over ``most_file``
    bytes are left out. Undated turns stay undated where the tool dates its
    records, and take the file's time elsewhere. Titles, folders and ids that a
    tool keeps in a file beside the transcript come from there; sessions that
    such a file calls a subagent's are left out. Pieces of records are written
    once to the shared folder, then what they tell is joined back.
    """
    layout = LAYOUTS[agent]
    siblings = _siblings(spark, path, layout.about) if layout.about else None
    return _sessions(_records(spark, path, layout, most_file), layout, siblings, agent, home, keep_mail)


def turns_of_records(records: DataFrame, agent: str = "generic", home: str = "", keep_mail: bool = False) -> DataFrame:
    """Turns of transcripts that a table holds: (source, line, value), one record a row, or one whole document where the tool writes such.

    value is the JSON text as it stood in the file, source the file's path, which
    for some tools tells the session or its folder, line a long that orders the
    records of a source; the order of records with the same line is not defined.
    Null and malformed values are left out, records without a source too. Other
    columns play no part. Undated turns stay undated, nothing is known of files
    beside the transcripts, and no source is too large; else as
    ``read_transcripts``. An empty table gives none.
    """
    raw = records.select("source", F.lit(None).cast("timestamp").alias("mtime"), F.lit(0).cast("long").alias("block"), F.col("line").cast("long").alias("line"), "value")
    layout = LAYOUTS[agent]
    return _sessions(_parsed(raw.where("source is not null"), layout), layout, None, agent, home, keep_mail)


def _sessions(records: DataFrame, layout: Layout, siblings: DataFrame | None, agent: str, home: str, keep_mail: bool) -> DataFrame:
    """Turns of records, with what their sources, and the files beside those, tell of each session."""
    each = written(_pieces_of(records, layout))
    told = each.groupBy("source").agg(*(_first(F.col(f"told.{c}")).alias(c) for c in ("id", "title", "folder", "branch", "begun")))
    nothing = F.lit(None)
    if layout.about and siblings is not None:
        told = told.withColumn("owner", _owner(F.col("source"), layout.about.transcript)).join(siblings, "owner", "left").where("not coalesce(sibling.subagent, false)")
    else:
        told = told.withColumn("sibling", F.struct(*(nothing.cast("string").alias(c) for c in ("title", "id", "folder")), nothing.cast("timestamp").alias("begun")))
    name = F.col("source")
    slug = _owner(name, layout.project) if layout.project else nothing.cast("string")
    project = F.when(~slug.isin("projects", "empty-window"), F.concat(F.lit("/"), F.replace(slug, F.lit("-"), F.lit("/")))) if layout.slug else F.try_url_decode(slug)
    by_path = _owner(name, layout.session)
    # Where a tool keeps one folder for each session, the folder's name is its id.
    session = F.coalesce("sibling.id", by_path if layout.spoken else F.coalesce("id", by_path))
    folder = F.coalesce("sibling.folder", "folder", project, F.lit(""))
    told = told.select(name, session.alias("session"), F.coalesce("sibling.title", "title").alias("title"), folder.alias("folder"), "branch", F.coalesce("sibling.begun", "begun").alias("begun"))
    return _turns(each, told, agent, home, keep_mail, layout.mtime)


def _turns(each: DataFrame, told: DataFrame, agent: str, home: str, keep_mail: bool, mtime: bool) -> DataFrame:
    """Turns of the pieces (source, mtime, block, line, part, who, at, p) and of what is told of each source (session, title, folder, branch, begun)."""
    folder = F.coalesce("folder", F.lit(""))
    told = told.withColumn("title", redact(F.col("title"), home, keep_mail)).withColumn("workspace", F.replace(folder, F.lit(home), F.lit("${HOME}")) if home else folder).drop("folder")
    of_tool = (F.col("who") == "tool") & (F.col("p.kind") == "message")
    kind = F.when(of_tool, F.lit("tool_result")).otherwise(F.col("p.kind"))
    each = each.where("p is not null").join(told, "source").withColumn("kind", kind)
    raw = repair_punctuation(F.col("p.text"))
    prompt = (F.col("kind") == "message") & (F.col("who") == "user")

    def cut(text: Column, most: int) -> Column:
        return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)

    shown = bound(raw, lambda t: bound(redact(F.when(prompt, clean_prompt(t)).otherwise(t), home, keep_mail), lambda s: cut(s, MOST_TEXT)))
    args = F.transform_values(flatten_args(F.col("p.args")), lambda k, v: bound(redact(v, home, keep_mail), lambda s: cut(s, MOST_ARG)))
    call = F.col("kind") == "tool_call"
    # Written, so that no filter below is carried into these expressions.
    made = written(each.select(
        F.lit(agent).alias("agent"), "session", "source", "title", "workspace", "branch", "block", "line", "part", "kind",
        F.when(F.col("kind") == "tool_result", "tool").otherwise(F.col("who")).alias("actor"), (F.coalesce("at", "begun", "mtime") if mtime else F.col("at")).alias("at"), shown.alias("text"),
        F.when(call, canonical_tool(F.col("p.name"))).alias("tool"), F.when(call, args).alias("args"),
        ((F.col("kind") == "tool_result") & failed(raw, F.col("p.flag"), F.col("p.status"))).alias("is_error"), F.when(prompt, skill_refs(raw)).alias("skills"),
    ))
    out = made.where("(kind != 'tool_call' or tool != '') and (kind != 'message' or text != '')")
    shape = F.nullif(command_shape(extract_command(F.col("args"))), F.lit(""))
    order = Window.partitionBy("session").orderBy("source", "block", "line", "part")
    out = out.withColumn("idx", F.row_number().over(order)).where(F.col("idx") <= MOST_TURNS)
    text = F.when(F.size("skills") > 0, without_skill_refs(F.col("text"))).otherwise(F.col("text"))
    return out.select(
        "agent", "session", "source", "title", "workspace", repo_name(F.col("workspace")).alias("repo"), "branch", "idx", "actor", "kind", "at", text.alias("text"), "tool", "args",
        F.when(F.col("tool") == "shell", shape).alias("command"), path_shapes(F.col("args")).alias("paths"), "skills", "is_error",
    )


def read_jsonl(spark: SparkSession, path: str, agent: str = "generic", home: str = "") -> DataFrame:
    """Turns of JSON-lines transcripts in the lenient shape that most tools share."""
    return read_transcripts(spark, path, agent, home)


def agent_stats(turns: DataFrame) -> DataFrame:
    return turns.groupBy("agent").agg(F.countDistinct("session").alias("sessions"), F.count("*").alias("turns"), F.count_if(F.col("kind") == "tool_call").alias("tool_calls"), F.min("at").alias("earliest"), F.max("at").alias("latest"))

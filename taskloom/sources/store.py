"""Sessions that a tool keeps in SQLite files, as turns."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bound
from ..written import written
from .transcripts import MOST_FILE, _array, _get, _time, _turns

#: The tables of today, and those before them, one row a message or a part of one, in order.
NEW = """SELECT s.id, coalesce(s.directory, ''), coalesce(s.title, ''), coalesce(s.time_created, 0), lower(m.type), coalesce(m.time_created, 0), coalesce(m.data, '{}'), 0
FROM session_v2 s JOIN session_message m ON m.session_id = s.id WHERE coalesce(s.parent_id, '') = '' AND lower(m.type) IN ('user', 'assistant') ORDER BY s.id, coalesce(m.seq, 0), m.rowid"""
OLD = """SELECT s.id, coalesce(s.directory, ''), coalesce(s.title, ''), coalesce(s.time_created, 0), lower(CASE WHEN json_valid(m.data) THEN coalesce(json_extract(m.data, '$.role'), '') ELSE '' END), coalesce(m.time_created, 0), coalesce(p.data, '{}'), 1
FROM session s JOIN message m ON m.session_id = s.id JOIN part p ON p.message_id = m.id WHERE coalesce(s.parent_id, '') = '' ORDER BY s.id, coalesce(m.time_created, 0), m.rowid, coalesce(p.time_created, 0), p.rowid"""
_ROW = "source string, mtime timestamp, id string, folder string, title string, begun long, who string, at long, data string, single int, line long"
#: Rows that leave a file at once.
_AT_ONCE = 5000


def _stored_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The messages of each file; a file that is no such database has none."""
    for batch in batches:
        for i in range(batch.num_rows):
            db = sqlite3.connect(":memory:")
            try:
                db.deserialize(batch.column(2)[i].as_py())
                names = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
                rows = db.execute(NEW if "session_v2" in names else OLD) if names & {"session_v2", "session"} else iter(())
                line = 0
                while some := [r for _, r in zip(range(_AT_ONCE), rows)]:
                    columns = [pa.array(c) for c in zip(*some)]
                    ids = pa.array([f"{batch.column(0)[i].as_py()}#{r[0]}" for r in some])
                    mtime = pa.array([batch.column(1)[i].as_py()] * len(some), pa.timestamp("us", "UTC"))
                    whole = [columns[0], columns[1], columns[2], columns[3].cast(pa.int64()), columns[4], columns[5].cast(pa.int64()), columns[6], columns[7].cast(pa.int32())]
                    yield pa.record_batch([ids, mtime, *whole, pa.array(range(line, line + len(some)), pa.int64())], names=[c.split()[0] for c in _ROW.split(", ")])
                    line += len(some)
            except sqlite3.DatabaseError:
                continue
            finally:
                db.close()


def _piece(kind: str, name: Column, text: Column, args: Column, flag: Column, status: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), name.alias("name"), text.alias("text"), args.alias("args"), flag.alias("flag"), status.alias("status"))


def _pieces(b: Column) -> Column:
    """A part as pieces: a text, a call with what came of it, or an edit of the files that it names."""
    none, no = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    given = F.coalesce(F.try_variant_get(b, "$.state.input", "variant"), F.try_variant_get(b, "$.input", "variant"))
    files = F.to_json(F.create_map(F.lit("files"), F.try_variant_get(b, "$.files", "array<string>")))
    name, output, status = _get(b, "tool", "name"), _get(b, "state.output", "state.error"), F.lower(_get(b, "state.status"))
    failed = F.coalesce(status == "error", F.lit(False))
    made = F.array(_piece("tool_call", name, none, F.to_json(given), no, none), F.when(output.isNotNull() | failed, _piece("tool_result", name, F.coalesce(output, F.lit("")), none, failed, status)))
    text = _get(b, "text")
    cases = F.when((_get(b, "type") == "text") & (F.trim(text) != ""), F.array(_piece("message", none, text, none, no, none)))
    cases = cases.when(_get(b, "type").isin("tool", "tool-call", "tool_use"), F.filter(made, lambda p: p.isNotNull()))
    cases = cases.when((_get(b, "type") == "patch") & (F.size(F.try_variant_get(b, "$.files", "array<string>")) > 0), F.array(_piece("tool_call", F.lit("edit"), none, files, no, none)))
    return F.coalesce(cases, F.filter(made, lambda p: F.lit(False)))


def read_store(spark: SparkSession, path: str, agent: str = "opencode", home: str = "", most_file: int = MOST_FILE, keep_mail: bool = False) -> DataFrame:
    """Turns from all ``.db`` files below a path, with the columns of ``read_transcripts``; source is the file and the session.

    Both generations of tables are read. Sessions that others started, messages
    of neither side and payloads that don't parse are left out, and so are files
    over ``most_file`` bytes and those that are no such database. A file is
    read by one task, in its memory, as it was last checkpointed: what only its
    log holds is not seen.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.db").option("recursiveFileLookup", "true").load(path).where((F.col("length") > 0) & (F.col("length") <= most_file))
    source = F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    rows = files.select(source.alias("source"), "modificationTime", "content").mapInArrow(_stored_rows, _ROW)
    rows = rows.withColumn("r", F.try_parse_json("data")).where("r is not null")
    r = F.col("r")
    parts = F.when(F.col("single") == 1, F.array(r)).otherwise(_array(r, "content"))
    plain = F.array(_piece("message", F.lit(None).cast("string"), _get(r, "text"), F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit(None).cast("string")))

    def said(pieces: Column) -> Column:
        # Many messages have their text beside the list of parts.
        bare = (F.col("single") == 0) & ~F.exists(pieces, lambda p: p["kind"] == "message") & _get(r, "text").isNotNull()
        return F.when(bare, F.concat(pieces, plain)).otherwise(pieces)

    pieces = bound(F.flatten(F.transform(parts, _pieces)), said)
    at = F.coalesce(_time(r, ["time"]), F.when(F.col("at") > 0, F.timestamp_millis("at")))
    begun = F.when(F.col("begun") > 0, F.timestamp_millis("begun"))
    who = F.when(F.col("who") == "user", "user").otherwise("assistant")
    each = written(rows.select("source", "mtime", F.lit(0).cast("long").alias("block"), "line", "id", "title", "folder", begun.alias("begun"), who.alias("who"), at.alias("at"), F.posexplode(pieces).alias("part", "p")))
    told = each.select("source", F.col("id").alias("session"), "title", "folder", F.lit(None).cast("string").alias("branch"), "begun").distinct()
    return _turns(each.drop("id", "title", "folder", "begun"), told, agent, home, keep_mail, True)

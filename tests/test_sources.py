import json
import sqlite3

import pytest

from taskloom.sources import transcripts
from taskloom.sources.store import read_store
from taskloom.sources.transcripts import LAYOUTS, agent_stats, read_jsonl, read_transcripts, turns_of_records


def write(folder, name, rows, tail=""):
    (folder / name).write_text("\n".join(map(json.dumps, rows)) + tail)


def turns(spark, folder, agent):
    return [(r.actor, r.kind, r.text, r.tool, r.command, r.is_error) for r in read_transcripts(spark, str(folder), agent).orderBy("session", "idx").collect()]


def test_lines_with_blocks(spark, tmp_path):
    rows = [
        {"type": "ai-title", "aiTitle": "Build"},
        {"type": "user", "sessionId": "s", "cwd": "/home/me/work/shop", "gitBranch": "main", "timestamp": "2024-01-01T10:00:00Z", "message": {"role": "user", "content": "<env>x</env> build it, token = \"abcdefgh1234\""}},
        {"type": "assistant", "timestamp": "2024-01-01T10:01:00Z", "message": {"role": "assistant", "content": [{"type": "text", "text": "so"}, {"type": "tool_use", "name": "Bash", "input": {"command": "cd x && git status -s"}}, {"type": "tool_use", "name": "TodoRead", "input": {}}]}},
        {"type": "user", "timestamp": 1704103320, "message": {"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "12 passed, 0 failed, no errors"}]}]}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "content": "fatal: no", "is_error": False}]}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "content": "odd", "is_error": True}]}},
        {"type": "user", "isSidechain": True, "message": {"role": "user", "content": "aside"}},
        {"type": "user", "promptSource": "sdk", "message": {"role": "user", "content": "run by a program"}},
    ]
    write(tmp_path, "a.jsonl", rows, '\n{"cut": \n\nnot json\n')
    (tmp_path / "empty.jsonl").write_text("")
    assert turns(spark, tmp_path, "claude") == [
        ("user", "message", "build it, token=[redacted]", None, None, False), ("assistant", "message", "so", None, None, False), ("assistant", "tool_call", None, "shell", "cd && git status", False),
        ("tool", "tool_result", "12 passed, 0 failed, no errors", None, None, False), ("tool", "tool_result", "fatal: no", None, None, True), ("tool", "tool_result", "odd", None, None, True),
    ]
    r = read_transcripts(spark, str(tmp_path), "claude", "/home/me").first()
    assert (r.session, r.title, r.workspace, r.repo, r.branch) == ("s", "Build", "${HOME}/work/shop", "shop", "main")
    assert agent_stats(read_jsonl(spark, str(tmp_path))).first().tool_calls == 1


def test_payloads(spark, tmp_path):
    rows = [
        {"timestamp": "2024-01-01T10:00:00Z", "type": "session_meta", "payload": {"id": "c1", "cwd": "/w/api"}},
        {"timestamp": "2024-01-01T10:00:01Z", "type": "response_item", "payload": {"type": "message", "role": "developer", "content": [{"type": "input_text", "text": "be good"}]}},
        {"timestamp": "2024-01-01T10:00:02Z", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "fix the lint"}]}},
        {"timestamp": "2024-01-01T10:00:03Z", "type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": "{\"command\": \"npm run lint\"}"}},
        {"timestamp": "2024-01-01T10:00:04Z", "type": "response_item", "payload": {"type": "function_call_output", "output": "Error: lint"}},
        {"timestamp": "2024-01-01T10:00:05Z", "type": "event_msg", "payload": {"type": "task_complete", "last_agent_message": "done"}},
    ]
    write(tmp_path, "c.jsonl", rows)
    assert turns(spark, tmp_path, "codex") == [("user", "message", "fix the lint", None, None, False), ("assistant", "tool_call", None, "shell", "npm run lint", False), ("tool", "tool_result", "Error: lint", None, None, True)]
    assert {(r.session, r.repo, r.title) for r in read_transcripts(spark, str(tmp_path), "codex").collect()} == {("c1", "api", "done")}


PARTS = [
    {"role": "user", "timestamp": "2024-01-01T10:00:00Z", "parts": [{"text": "tidy the page"}]},
    {"role": "model", "parts": [{"text": "sure"}, {"functionCall": {"name": "edit", "args": {"file_path": "/w/app/ui/page.tsx"}}}, {"functionResponse": {"name": "edit", "response": "ok"}}]},
]


def test_documents_whole_and_cut_off(spark, tmp_path):
    whole = json.dumps({"sessionId": "g", "startTime": "2024-01-01T09:00:00Z", "state": {"messages": PARTS}})
    (tmp_path / "g.json").write_text(whole)
    want = [("user", "message", "tidy the page", None, None, False), ("assistant", "message", "sure", None, None, False), ("assistant", "tool_call", None, "edit", None, False), ("tool", "tool_result", "ok", None, None, False)]
    assert turns(spark, tmp_path, "gemini") == want
    rows = read_transcripts(spark, str(tmp_path), "gemini").orderBy("idx").collect()
    assert [r.at.hour for r in rows] == [10, 9, 9, 9] and rows[2].paths == ["app/ui/*.tsx"]
    (tmp_path / "g.json").write_text(whole[: whole.index(', {"role": "model"') + 30])
    assert turns(spark, tmp_path, "gemini") == want[:1]


@pytest.mark.parametrize("agent", ["qwen", "copilot", "cursor", "grok"])
def test_lenient_records(spark, tmp_path, agent):
    rows = [
        {"type": "user", "content": "add a test", "ts": 1704103320000}, {"sender": "ai", "message": {"parts": [{"text": "yes"}]}} if agent not in ("cursor", "grok") else {"role": "assistant", "content": "yes"},
        {"role": "assistant", "tool_calls": [{"function": {"name": "bash", "arguments": "{\"cmd\": \"git push\"}"}}]}, {"type": "tool_result", "content": "exit code 1"}, {"type": "system", "content": "x"},
    ]
    if agent == "copilot":
        rows = [{"seq": 1, LAYOUTS[agent].unwrap[0]: r} for r in rows]
    write(tmp_path, "chat_history.jsonl", rows)
    got = turns(spark, tmp_path, agent)
    assert got == [("user", "message", "add a test", None, None, False), ("assistant", "message", "yes", None, None, False), ("assistant", "tool_call", None, "shell", "git push", False), ("tool", "tool_result", "exit code 1", None, None, True)]


def test_event_stream_with_state_file(spark, tmp_path):
    """Two sessions of a log of events; the state file is two folders above one log, and missing for the other."""
    for name in ("s1", "s2"):
        folder = tmp_path / "sessions" / "%2Fw%2Fshop" / name / "agents" / "main"
        folder.mkdir(parents=True)
        rows = [
            {"type": "turn.prompt", "time": 1704103320000, "input": [], "text": f"add a page to {name}"},
            {"type": "usage.record", "text": "120 tokens", "usage": {"input": 3}},
            {"type": "context.append_message", "event": {"message": {"role": "assistant", "content": [{"type": "text", "text": "on it"}]}}},
            {"type": "context.append_loop_event", "event": {"type": "content.part", "part": {"type": "text", "text": "streamed"}}},
            {"type": "context.append_message", "event": {"message": {"content": "", "tool_calls": [{"function": {"name": "Shell", "arguments": "{\"command\": \"git push\"}"}}]}}},
        ]
        write(folder, "wire.jsonl", rows)
    (tmp_path / "sessions" / "%2Fw%2Fshop" / "s1" / "state.json").write_text(json.dumps({"title": "Pages", "workDir": "/w/shop-front", "agents": {}}))
    got = read_transcripts(spark, str(tmp_path), "kimi").orderBy("session", "idx").collect()
    for name in ("s1", "s2"):
        assert [(r.actor, r.kind, r.text, r.command) for r in got if r.session == name] == [("user", "message", f"add a page to {name}", None), ("assistant", "message", "on it", None), ("assistant", "message", "streamed", None), ("assistant", "tool_call", None, "git push")]
    assert {(r.session, r.title, r.workspace, r.repo) for r in got} == {("s1", "Pages", "/w/shop-front", "shop-front"), ("s2", None, "/w/shop", "shop")}


def test_camel_case_blocks_and_project_folder(spark, tmp_path):
    folder = tmp_path / "projects" / "home-me-shop" / "agent-transcripts" / "c9"
    folder.mkdir(parents=True)
    rows = [
        {"role": "user", "message": {"content": [{"type": "text", "text": "<user_query>\nlint it\n</user_query>"}]}},
        {"role": "assistant", "message": {"content": [{"type": "toolUse", "toolName": "Shell", "args": {"command": "npm run lint"}}]}},
        {"role": "user", "message": {"content": [{"type": "toolResult", "result": "Error: lint"}]}},
    ]
    write(folder, "c9.jsonl", rows)
    assert turns(spark, tmp_path, "cursor") == [("user", "message", "lint it", None, None, False), ("assistant", "tool_call", None, "shell", "npm run lint", False), ("tool", "tool_result", "Error: lint", None, None, True)]
    assert {(r.session, r.workspace, r.repo) for r in read_transcripts(spark, str(tmp_path), "cursor").collect()} == {("c9", "/home/me/shop", "shop")}


def test_files_beside_transcripts(spark, tmp_path):
    said = [{"type": "user", "content": "tidy up"}]
    for name, summary in (("g1", {"session_summary": "Tidy", "info": {"cwd": "/w/api", "id": "real"}}), ("g2", {"session_kind": "Subagent"}), ("g3", {"title": "T", "git_root_dir": "/w/root"}), ("g4", None)):
        (tmp_path / "grok" / "%2Fw%2Fold" / name).mkdir(parents=True)
        write(tmp_path / "grok" / "%2Fw%2Fold" / name, "chat_history.jsonl", said)
        if summary:
            (tmp_path / "grok" / "%2Fw%2Fold" / name / "summary.json").write_text(json.dumps(summary))
    got = read_transcripts(spark, str(tmp_path / "grok"), "grok").collect()
    assert sorted((r.session, r.title or "", r.workspace) for r in got) == [("g3", "T", "/w/root"), ("g4", "", "/w/old"), ("real", "Tidy", "/w/api")]
    folder = tmp_path / "cline" / "t1"
    folder.mkdir(parents=True)
    (folder / "t1.messages.json").write_text(json.dumps([{"role": "user", "content": [{"type": "text", "text": "fix it"}]}, {"role": "assistant", "content": [{"type": "tool_use", "name": "write_to_file", "input": {"path": "a/b/c.py"}}]}]))
    (folder / "t1.json").write_text(json.dumps({"started_at": "2024-02-03T04:05:06Z", "workspace_root": "/w/site"}))
    got = read_transcripts(spark, str(tmp_path / "cline"), "cline").orderBy("idx").collect()
    assert [(r.session, r.workspace, str(r.at), r.actor, r.tool) for r in got] == [("t1", "/w/site", "2024-02-03 04:05:06", "user", None), ("t1", "/w/site", "2024-02-03 04:05:06", "assistant", "edit")]


def test_large_files_are_split(spark, tmp_path):
    """Lines keep their order, and the turns kept are a session's first, when one file is read by many tasks."""
    rows = [{"type": "user" if i % 2 == 0 else "assistant", "sessionId": "s", "message": {"role": "user" if i % 2 == 0 else "assistant", "content": f"line {i} of the file " + "x" * (i % 90)}} for i in range(4300)]
    write(tmp_path, "big.jsonl", rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        assert transcripts._files(spark, str(tmp_path), "*.jsonl", False).rdd.getNumPartitions() > 10
        got = read_transcripts(spark, str(tmp_path), "claude").orderBy("idx").select("idx", "text").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.idx for r in got] == list(range(1, 4001)) and [int(r.text.split()[1]) for r in got] == list(range(4000))


def test_records_in_a_table(spark, tmp_path):
    """The same turns as from a file; null and broken values, rows without a source and other columns change nothing; whole documents, an empty table."""
    rows = [{"type": "user", "sessionId": "s", "cwd": "/w/shop", "timestamp": 1704103320, "message": {"role": "user", "content": "lint it" + " again" * 3000}}]
    rows += [{"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "on it"}, {"type": "tool_use", "name": "Bash", "input": {"command": "npm run lint"}}]}}] * 2
    write(tmp_path, "a.jsonl", rows)
    table = [("/w/a.jsonl", n, json.dumps(r)) for n, r in enumerate(rows)] + [("/w/a.jsonl", 7, None), ("/w/a.jsonl", 8, '{"cut": '), ("/w/a.jsonl", 9, ""), (None, 1, json.dumps(rows[0]))]
    schema = "source string, line int, value string, r string, told string, block string"
    records = spark.createDataFrame([(*t, "x", "x", "x") for t in table], schema).repartition(3)
    asked = ("session", "repo", "idx", "actor", "kind", "at", "text", "tool", "command", "skills", "is_error")
    got, want = (df.select(*asked).orderBy("idx").collect() for df in (turns_of_records(records, "claude"), read_transcripts(spark, str(tmp_path), "claude")))
    assert got == want and len(got) == 5 and got[0].text.endswith("…") and got[0].session == "s"
    assert turns_of_records(records.limit(0), "claude").count() == 0
    whole = json.dumps({"sessionId": "g", "messages": PARTS})
    documents = spark.createDataFrame([("/w/g.json", 0, whole), ("/w/h.json", 0, whole[: whole.index(', {"role": "model"') + 30]), ("/w/i.json", 0, None)], "source string, line int, value string")
    assert [(r.source, r.kind) for r in turns_of_records(documents, "gemini").orderBy("source", "idx").collect()] == [("/w/g.json", "message"), ("/w/g.json", "message"), ("/w/g.json", "tool_call"), ("/w/g.json", "tool_result"), ("/w/h.json", "message")]


def test_databases(spark, tmp_path):
    """The tables of today and the older ones; child sessions, bookkeeping rows and broken payloads are left out."""
    new, old = sqlite3.connect(tmp_path / "new.db"), sqlite3.connect(tmp_path / "old.db")
    sessions = "(id TEXT, directory TEXT, title TEXT, time_created INTEGER, time_updated INTEGER, parent_id TEXT)"
    new.execute(f"CREATE TABLE session_v2 {sessions}")
    new.execute("CREATE TABLE session_message (session_id TEXT, type TEXT, seq INTEGER, time_created INTEGER, data TEXT)")
    new.executemany("INSERT INTO session_v2 VALUES (?, ?, ?, ?, ?, ?)", [("a", "/w/shop", "Lint", 1704103200000, 0, None), ("kid", "/w", "", 0, 0, "a")])
    tool = {"type": "tool", "tool": "bash", "state": {"input": {"command": "npm run lint"}, "output": "1 problem", "status": "error"}}
    said = [
        ("a", "assistant", 2, 1704103320000, json.dumps({"content": [{"type": "text", "text": "on it"}, tool, {"type": "patch", "files": ["ui/a.ts", "ui/b.ts"]}]})), ("a", "user", 1, 1704103260000, json.dumps({"text": "lint it"})),
        ("a", "agent-switched", 3, 0, "{}"), ("a", "user", 4, 0, "{broken"), ("kid", "user", 1, 0, json.dumps({"text": "aside"})), ("none", "user", 1, 0, json.dumps({"text": "aside"})),
    ]
    new.executemany("INSERT INTO session_message VALUES (?, ?, ?, ?, ?)", said)
    old.execute(f"CREATE TABLE session {sessions}")
    old.execute("CREATE TABLE message (id TEXT, session_id TEXT, time_created INTEGER, data TEXT)")
    old.execute("CREATE TABLE part (message_id TEXT, time_created INTEGER, data TEXT)")
    old.execute("INSERT INTO session VALUES ('b', '/w/api', '', 0, 0, '')")
    old.executemany("INSERT INTO message VALUES (?, ?, ?, ?)", [("m2", "b", 1704103400000, '{"role": "assistant"}'), ("m1", "b", 1704103300000, '{"role": "user"}')])
    old.executemany("INSERT INTO part VALUES (?, ?, ?)", [("m2", 2, json.dumps({"type": "tool-call", "name": "read", "input": {"path": "src/x/y.go"}})), ("m1", 1, json.dumps({"type": "text", "text": "read it"})), ("m2", 1, json.dumps({"type": "text", "text": "so"})), ("m2", 3, "broken")])
    for db in (new, old):
        db.commit()
        db.close()
    (tmp_path / "other.db").write_bytes(b"no database")
    got = [(r.session, r.title, r.repo, r.actor, r.kind, r.text, r.tool, r.command, r.is_error, r.paths) for r in read_store(spark, str(tmp_path)).orderBy("session", "idx").collect()]
    assert got == [
        ("a", "Lint", "shop", "user", "message", "lint it", None, None, False, []), ("a", "Lint", "shop", "assistant", "message", "on it", None, None, False, []), ("a", "Lint", "shop", "assistant", "tool_call", None, "shell", "npm run lint", False, []),
        ("a", "Lint", "shop", "tool", "tool_result", "1 problem", None, None, True, []), ("a", "Lint", "shop", "assistant", "tool_call", None, "edit", None, False, ["ui/*.ts", "ui/*.ts"]),
        ("b", "", "api", "user", "message", "read it", None, None, False, []), ("b", "", "api", "assistant", "message", "so", None, None, False, []), ("b", "", "api", "assistant", "tool_call", None, "read", None, False, ["src/x/*.go"]),
    ]

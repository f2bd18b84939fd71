"""Vendor tool names as shared verbs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tools of the harness itself, which are no work.
INTERNAL = "toolsearch structuredoutput getdynamictools calldynamictool taskoutput taskstop killshell bashoutput monitor listmcpresourcestool readmcpresourcetool readmcpresourcedirtool listplugins searchplugins listskills searchskills exitplanmode enterplanmode exitworktree enterworktree sendmessage listagents reportfindings schedulewakeup todoread attempt_completion new_task".split()

#: Verb, and the names that mean it.
VERBS = {
    "read": "read read_file readfile view open_file cat str_replace_editor_view",
    "write": "write write_file create_file create new_file",
    "edit": "edit apply_patch str_replace strreplace str_replace_editor multiedit multi_edit edit_file patch update_file replace searchreplace search_replace write_to_file replace_in_file notebookedit notebook_edit",
    "shell": "bash shell exec exec_command run_terminal_command run_command terminal run local_shell container.exec execute_command",
    "search": "grep search ripgrep rg search_files codebase_search file_search grep_search",
    "list": "glob list_files ls list_dir list_directory find",
    "web_fetch": "webfetch web_fetch fetch fetch_url read_url browse",
    "web_search": "websearch web_search google_web_search search_web",
    "subagent": "task agent dispatch_agent spawn_agent subagent",
    "plan": "todowrite todo_write todo update_plan plan updatecurrentstep update_current_step updatetodos update_todos setplan",
    "ask": "askuserquestion ask_user elicit",
    "skill": "skill use_skill invoke_skill",
}
OPAQUE = "^(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{16,})$"


def _segment(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def canonical_tool(tool: Column) -> Column:
    """The shared verb, ``mcp:server:function``, ``tool:name``, or empty for what is no work."""
    t = F.lower(F.trim(F.coalesce(tool, F.lit(""))))
    rest = F.substring(t, 6, 1 << 20)
    server, function = F.substring_index(rest, "__", 1), F.regexp_extract(rest, r"(?s)^.*?__(.*)$", 1)
    two, opaque = F.contains(rest, F.lit("__")), server.rlike(OPAQUE)
    mcp = (
        F.when(two & opaque, F.concat(F.lit("mcp:"), _segment(function)))
        .when(two, F.concat(F.lit("mcp:"), _segment(server), F.lit(":"), _segment(function)))
        .when(opaque, F.lit(""))
        .otherwise(F.concat(F.lit("mcp:"), _segment(server)))
    )
    out = F.when((t == "") | t.rlike("^mcp__(?:ccd_|claude_code)"), F.lit("")).when(t.startswith("mcp__"), mcp).when(t.isin(*INTERNAL), F.lit(""))
    for verb, names in VERBS.items():
        out = out.when(t.isin(*names.split()), F.lit(verb))
    return out.when(t.rlike("browser|playwright|puppeteer|chrome|screenshot"), F.lit("browser")).when(F.contains(t, F.lit("git")), F.lit("shell")).otherwise(F.concat(F.lit("tool:"), _segment(t)))

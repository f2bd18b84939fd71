"""What a person typed, without what the tool around it put in: blocks, slash commands, skill mentions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of blocks that tools put into a user's turn, in the order in which they are taken out.
BLOCKS = [
    "system-reminder", "local-command-caveat", "local-command-stdout", "local-command-stderr", "command-name", "command-message", "command-args", "command-contents",
    "user_info", "user-info", "environment_details", "env", "system_info", "context", "additional_context", "important_context", "project_context",
    "workspace_info", "session_context", "editor_context", "ide_context", "ide_selection", "ide_opened_file", "attached_files", "open_files", "files",
    "git_status", "timestamp", "hook", "user-prompt-submit-hook", "skills_instructions", "function_results", "tool_output", "current_working_directory",
    "rules", "memories", "user_rules", "project_rules", "custom_instructions", "instructions", "agents_md", "available_skills", "background_information",
]

#: Beginnings of turns that no person wrote.
SYNTHETIC = [
    "caveat: the messages below were generated", "[request interrupted by user]", "[request interrupted", "api error", "this session is being continued from a previous conversation",
    "result of calling the", "tool ran without output", "the user doesn't want to proceed", "[tool use was rejected", "please continue the conversation from where we left it off",
    "continue from where we left", "<no message>",
]

#: Commands of the client itself.
BUILT_IN = (
    "model clear config help compact cost login logout status terminal-setup vim init memory doctor exit resume agents mcp permissions hooks ide privacy-settings bug release-notes "
    "upgrade add-dir export fast context output-style statusline todos install-github-app migrate-installer pr-comments review usage settings feedback quit"
).split()

#: Punctuation whose UTF-8 bytes were read as Windows-1252.
DAMAGED = "—–‘’“”…• ·«»"

SPACE = "[\\s\u0085 ]"
SKILL_PATH = r"(?i)[\w.${}/~-]*skills/([a-z0-9][a-z0-9_-]{2,60})(?:/SKILL\.md)?(?![0-9A-Za-z_])"
SKILL_NAME = r"(?i)<skill(?:[^>]*)>\s*([a-z0-9][a-z0-9_:-]{2,60})\s*</skill>|(?<![0-9A-Za-z_])Using\s+(?:the\s+)?([a-z0-9][a-z0-9_:-]{2,60})\s+skill(?![0-9A-Za-z_])"
SKILL_LINE = r"(?im)^\s*(?:base directory for this skill|launching skill|using skill|skill directory|loaded skill)\s*:?.*$"


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def repair_punctuation(text: Column) -> Column:
    """Punctuation that was decoded wrongly, put right; a byte-order mark goes. Other texts are not touched."""
    out = text
    for c in DAMAGED:
        out = F.replace(out, F.lit("".join(bytes([b]).decode("cp1252", "replace") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in c.encode())), F.lit(c))
    return F.when(text.rlike("[âÂ﻿]"), F.replace(out, F.lit("﻿"), F.lit(""))).otherwise(text)


def slash_command(text: Column) -> Column:
    """``/name args`` of a user's own slash command; null for none, and for commands of the client."""
    name = F.lower(F.regexp_extract(text, r"(?is)<command-name>\s*/?([a-z0-9][a-z0-9:_-]{0,60})\s*</command-name>", 1))
    own = F.regexp_replace(name, "^.*:(?=.)", "")
    args = strip_space(F.regexp_extract(text, r"(?is)<command-args>(.*?)</command-args>", 1))
    said = F.when(args != "", F.concat(F.lit("/"), own, F.lit(" "), args)).otherwise(F.concat(F.lit("/"), own))
    return F.when((name != "") & ~own.isin(*BUILT_IN), strip_space(said))


def clean_prompt(text: Column) -> Column:
    """The words a person typed; empty where no one did. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    query = F.regexp_extract(text, r"(?s)<user_query>\s*(.*?)\s*(?:</user_query>|\z)", 1)
    s = F.when(strip_space(query) != "", query).otherwise(text)
    bare = s
    for tag in BLOCKS:
        bare = F.regexp_replace(bare, rf"(?is)<{tag}>(?:.*?</{tag}>|.*)", " ")
    s = strip_space(F.when(s.contains("<"), bare).otherwise(s))
    for _ in range(8):
        s = F.regexp_replace(s, rf"(?is)\A<([a-z][a-z0-9]*(?:[_-][a-z0-9]+)+)>(?:.*?</\1>{SPACE}*|.*)", "")
    s = strip_space(s)
    synthetic = F.lower(s).rlike("^(?:" + "|".join(re.escape(p) for p in SYNTHETIC) + ")")
    return F.coalesce(slash_command(text), F.when(synthetic, F.lit("")).otherwise(s))


def skill_refs(text: Column) -> Column:
    """Names of skills that a text mentions, by path first, then by name, each once and in lower case."""
    by_path = F.regexp_extract_all(text, F.lit(SKILL_PATH), F.lit(1))
    announced = (F.regexp_extract_all(text, F.lit(SKILL_NAME), F.lit(i)) for i in (1, 2))
    by_name = F.zip_with(*announced, lambda a, b: F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(b))
    names = F.transform(F.concat(by_path, by_name), lambda n: F.regexp_replace(F.lower(n), "^.*:", ""))
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))


def without_skill_refs(text: Column) -> Column:
    for pattern in (SKILL_PATH, SKILL_NAME, SKILL_LINE):
        text = F.regexp_replace(text, pattern, " ")
    return strip_space(text)


def gist(text: Column, most: int) -> Column:
    """The first line of prose, without code between fences, headings and list items."""
    lines = F.transform(F.split(strip_space(F.regexp_replace(text, "(?s)```.*?```", " ")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    first = F.coalesce(F.get(F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("-")), 0), F.lit(""))
    return F.when(F.char_length(first) > most, F.concat(F.trim(F.substring(first, 1, most)), F.lit("…"))).otherwise(first)

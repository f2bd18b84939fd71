"""Shell commands as shapes, and the arguments of tool calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

#: Programs whose first words, one or two, say what they do.
ONE_WORD = (
    "git npm pnpm yarn bun npx bunx docker kubectl cargo go make brew terraform vercel supabase prisma drizzle-kit wrangler flyctl fly pip pip3 poetry uv "
    "deno rails bundle composer dotnet mvn gradle systemctl pm2 turbo nx expo eas firebase heroku railway netlify stripe"
).split()
TWO_WORDS = ["gh", "shopify", "aws", "gcloud"]
#: Programs that take a script after ``run``; programs that only start another.
RUNNERS = ["npm", "pnpm", "yarn", "bun", "deno", "turbo", "nx"]
WRAPPERS = ["sudo", "env", "time", "nohup"]
#: Where a call's command and its paths stand.
COMMAND_KEYS = ["command", "cmd", "script", "shell_command", "commandLine", "input"]
PATH_KEYS = ["file_path", "filePath", "path", "files", "notebook_path", "target_file"]

MOST_SHAPES, MOST_PATHS = 4, 6
FIELD = r"""(?:[^ \t'"]|'[^']*(?:'|\z)|"[^"]*(?:"|\z))+"""


def _program(field: Column) -> Column:
    """The last part of a path, without quotes and ``.exe``."""
    return F.regexp_replace(F.regexp_extract(F.btrim(field, F.lit("\"'")), r"([^/]*)/*\z", 1), r"\.exe\z", "")


def _segment(segment: Column) -> Column:
    def placed(fields: Column) -> Column:
        starts = F.transform(fields, lambda f: ~f.rlike("^[A-Za-z_][A-Za-z0-9_]*=") & ~_program(f).isin(*WRAPPERS))
        return bound(F.array_position(starts, True).cast("int"), lambda at: F.when(at > 0, named(F.slice(fields, at, F.size(fields)))).otherwise(F.lit("")))

    def named(fields: Column) -> Column:
        rest = F.transform(F.filter(F.slice(fields, 2, F.size(fields)), lambda f: ~f.startswith("-")), lambda f: F.lower(F.btrim(f, F.lit("\"'"))))
        rest = F.filter(rest, lambda f: (f != "") & ~f.isin(".", "..") & ~f.rlike(r"[/\\]|^[$~]"))
        return bound(F.struct(_program(F.get(fields, 0)).alias("program"), rest.alias("rest")), lambda p: shaped(p["program"], p["rest"]))

    def shaped(program: Column, rest: Column) -> Column:
        run = F.when(program.isin(*RUNNERS) & (F.get(rest, 0) == "run"), F.when(F.get(rest, 1) == "run", 3).otherwise(2)).otherwise(1)
        taken = F.when(program.isin(*TWO_WORDS), F.slice(rest, 1, 2)).when(program.isin(*ONE_WORD), F.slice(rest, F.lit(1), run)).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(F.array(program), taken), " ")

    return bound(F.regexp_extract_all(segment, F.lit(FIELD), F.lit(0)), placed)


def command_shape(command: Column) -> Column:
    """Programs with the words that say what they do, up to four joined by ``&&``; options, paths and texts are left out."""
    segments = F.transform(F.split(F.trim(F.coalesce(command, F.lit(""))), r"\s*(?:&&|\|\||;|\||\n)\s*"), _segment)
    return F.array_join(F.slice(F.filter(segments, lambda s: s != ""), 1, MOST_SHAPES), " && ")


def extract_command(args: Column) -> Column:
    """The first argument of a map that is a command, as it stands; empty for none."""
    values = [F.when(F.trim(F.coalesce(args[k], F.lit(""))) != "", args[k]) for k in COMMAND_KEYS]
    return F.coalesce(*values, F.lit(""))


def flatten_args(raw: Column) -> Column:
    """A JSON object as map<string,string>: scalars as text, lists as their first six texts; other texts under ``input``."""
    pairs = F.from_json(raw, "map<string,string>")
    values = F.map_values(pairs)
    texts = F.transform(values, lambda v: F.when(v.startswith("["), F.array_join(F.slice(F.filter(F.from_json(v, "array<string>"), lambda x: x.isNotNull()), 1, 6), ", ")).otherwise(v))
    kept = F.map_filter(F.map_from_arrays(F.map_keys(pairs), texts), lambda k, v: v.isNotNull() & ~v.startswith("{") & (v != ""))
    return F.when(F.trim(raw).startswith("{") & values.isNotNull(), kept).when(raw.isNotNull(), F.create_map(F.lit("input"), raw))


def path_shapes(args: Column) -> Column:
    """Up to six ``dir/dir/*.ext`` of the paths among the arguments: the last two folders and the ending."""
    lists = F.flatten(F.array(*(F.split(F.coalesce(args[k], F.lit("")), ",") for k in PATH_KEYS)))
    items = F.filter(F.transform(lists, lambda p: F.trim(p)), lambda p: p.contains("/"))

    def shape(item: Column) -> Column:
        folders = F.filter(F.split(F.regexp_extract(item, "^(.*)/[^/]*$", 1), "/"), lambda f: ~f.isin("", "."))
        tail = F.array_join(F.slice(folders, F.greatest(F.size(folders) - 1, F.lit(1)), F.lit(2)), "/")
        ending = F.lower(F.regexp_extract(item, r"(\.[^./]*)$", 1))
        return F.when(ending != "", F.concat(tail, F.lit("/*"), ending)).otherwise(tail)

    return F.slice(F.transform(items, shape), 1, MOST_PATHS)


def repo_name(workspace: Column) -> Column:
    return F.regexp_extract(F.coalesce(workspace, F.lit("")), r"([^/\\]+)[/\\]*$", 1)


#: What shows that a result failed.
FAILURES = ["exit: 1", "exit code 1", "command failed", "traceback (most recent call last)", "error:", "fatal:", "no such file", "permission denied"]


def failed(text: Column, flag: Column | None = None, status: Column | None = None) -> Column:
    """Whether a result failed: by its flag, its status, or a marker in its first 400 characters."""
    head = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 400))
    out = F.lit(False)
    for marker in FAILURES:
        out = out | head.contains(marker)
    if status is not None:
        out = out | F.coalesce(F.lower(status).isin("error", "failed", "failure"), F.lit(False))
    return out if flag is None else out | F.coalesce(flag, F.lit(False))

"""Skills, commands and rules files that are installed, and the one that covers a piece of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import first_line, tokens

KINDS = ("command", "rules", "skill")
#: Files that hold rules.
RULES = ["CLAUDE.md", "AGENTS.md", "GEMINI.md", ".cursorrules"]


def front_matter(text: Column, field: str) -> Column:
    """A field of the block between two ``---`` lines at the beginning, without quotes; null where there is none."""
    head = F.regexp_extract(text, r"(?s)\A\s*---[ \t]*\r?\n(.*?)\r?\n---", 1)
    return F.nullif(F.trim(F.btrim(F.trim(F.regexp_extract(head, rf"(?m)^{field}:[ \t]*(.*?)[ \t]*\r?$", 1)), F.lit("\"'"))), F.lit(""))


def first_prose(text: Column) -> Column:
    """The first line that is no heading, list item or part of the front matter."""
    body = F.regexp_replace(text, r"(?s)\A\s*---[ \t]*\r?\n.*?\r?\n---[ \t]*\r?(?:\n|\z)", "")
    return F.coalesce(first_line(F.regexp_replace(body, r"(?m)^[ \t]*[#>-].*$", "")), F.lit(""))


def installed(spark: SparkSession, roots: list[tuple[str, str, str, str]]) -> DataFrame:
    """(kind, name, description, path, harness, scope, tokens) of all files below the roots (path, kind, harness, scope).

    A skill is a folder with a SKILL.md, at any depth (bundles nest them), a
    command any other .md file, a rules file one that has such a name. Names
    and descriptions come from the front matter, else from the path and, for
    commands and rules, the first line of prose. No roots give no rows.
    """
    out = None
    for path, kind, harness, scope in roots:
        if kind not in KINDS:
            raise ValueError(f"{kind} is none of {KINDS}")
        glob = {"skill": "SKILL.md", "command": "*.[mM][dD]", "rules": "{" + ",".join(RULES) + "}"}[kind]
        files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
        source = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        by_path = F.regexp_extract(source, r"([^/]*)/[^/]*$" if kind == "skill" else r"([^/]*?)(?:\.[^./]*)?$" if kind == "command" else r"([^/]*)$", 1)
        name = by_path if kind == "rules" else F.coalesce(front_matter(F.col("value"), "name"), by_path)
        told = front_matter(F.col("value"), "description")
        about = {"skill": F.coalesce(told, F.lit("")), "command": F.coalesce(told, first_prose(F.col("value"))), "rules": first_prose(F.col("value"))}[kind]
        words = tokens(F.col("value")) if kind == "rules" else F.concat(tokens(F.col("name")), tokens(F.col("description")))
        made = files.select(F.lit(kind).alias("kind"), name.alias("name"), about.alias("description"), source.alias("path"), F.lit(harness).alias("harness"), F.lit(scope).alias("scope"), "value")
        made = made.withColumn("tokens", F.array_distinct(words)).drop("value")
        out = made if out is None else out.union(made)
    if out is None:
        return spark.createDataFrame([], "kind string, name string, description string, path string, harness string, scope string, tokens array<string>")
    return out


def best_match(wanted: DataFrame, items: DataFrame, least: float = 0.55) -> DataFrame:
    """(id, match, path): for each row (id, tokens), the item that holds the largest share of its tokens, ``least`` at any rate.

    Ties go to the first by kind, name and path. An item that holds such a share
    holds one of a row's rarest tokens, and only those are joined; the shares are
    then counted for the pairs found. Rows without tokens match nothing.
    """
    w = wanted.select("id", F.array_distinct("tokens").alias("tokens")).where("size(tokens) > 0")
    named = items.select(F.struct("kind", "name", "path").alias("item"), "tokens")
    held = named.select("item", F.explode(F.array_distinct("tokens")).alias("token"))
    df = held.groupBy("token").agg(F.count("*").alias("df"))
    each = w.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(df, "token", "left")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(0)), "token"))
    prefix = each.withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    pairs = prefix.join(held, "token").select("id", "item").distinct()
    both = pairs.join(w, "id").join(named.withColumnRenamed("tokens", "there"), "item")
    share = F.size(F.array_intersect("tokens", "there")) / F.size("tokens")
    best = both.select("id", "item", share.alias("match")).where(F.col("match") >= least).groupBy("id").agg(F.min(F.struct((-F.col("match")).alias("less"), "item")).alias("best"))
    return best.select("id", (-F.col("best.less")).alias("match"), F.col("best.item.path").alias("path"))


def named_alike(names: DataFrame, items: DataFrame) -> DataFrame:
    """(id, path): for each row (id, name), the first item by kind, name and path whose name is the same but for case."""
    there = items.groupBy(F.lower("name").alias("name")).agg(F.min(F.struct("kind", "name", "path")).alias("item"))
    return names.select("id", F.lower("name").alias("name")).join(there, "name").select("id", F.col("item.path").alias("path"))

"""Names and sentences for groups of arcs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, fingerprint, first_line, slug, truncate

#: How tools and commands of a system begin, and its name, in the order in which they are tried.
SYSTEMS = {
    "mcp:slack": "Slack", "mcp:notion": "Notion", "mcp:linear": "Linear", "mcp:github": "GitHub", "mcp:figma": "Figma", "mcp:posthog": "PostHog", "mcp:sentry": "Sentry", "mcp:stripe": "Stripe",
    "mcp:vercel": "Vercel", "mcp:shopify": "Shopify", "browser": "browser", "shell:gh pr": "pull request", "shell:git": "git", "shell:npm run test": "test", "shell:npm run build": "build",
    "shell:vercel": "Vercel", "shell:shopify": "Shopify", "shell:docker": "Docker", "shell:kubectl": "Kubernetes", "shell:terraform": "Terraform",
}
#: Verbs shown with a second word, what a first tool adds to a title, words of a call that name no object.
SHOWN = {"reply": "Reply to", "clean": "Clean up", "wire": "Wire up", "set": "Set up"}
SUFFIXES = {"browser": "verification", "edit": "changes", "write": "authoring", "search": "investigation", "read": "review", "web_search": "research", "web_fetch": "research", "subagent": "parallel work", "plan": "planning"}
PLAIN = "get list read search send create update fetch query add delete mcp public private data sources record".split()
#: Instructions for actions that are one word.
INSTRUCTIONS = {
    "read": "Read the relevant files", "write": "Write the new file", "edit": "Edit the affected files", "search": "Search the codebase for the affected code", "list": "List the candidate files",
    "shell": "Run the project's commands", "web_fetch": "Fetch the referenced page", "web_search": "Search the web for current information", "browser": "Verify in a browser",
    "subagent": "Delegate the independent parts to subagents", "plan": "Write the task list before starting", "ask": "Ask the operator to resolve the open decision", "skill": "Invoke the matching skill",
}
#: Score from which on a phrase names the work.
STRONG = 0.45


def describe_step(action: Column) -> Column:
    """An action as an instruction."""
    server, call = F.regexp_extract(action, r"^mcp:([^:]*)(?::(.*))?$", 1), F.regexp_extract(action, r"^mcp:([^:]*)(?::(.*))?$", 2)
    of_call = F.concat(F.lit("Call the "), server, F.lit(" integration"), F.when(action.rlike("^mcp:[^:]*:"), F.concat(F.lit(" ("), F.replace(call, F.lit("-"), F.lit(" ")), F.lit(")"))).otherwise(""))
    out = F.when(action.startswith("shell:"), F.concat(F.lit("Run `"), F.substring(action, 7, 1 << 20), F.lit("`"))).when(action.startswith("mcp:"), of_call)
    out = out.when(action.startswith("tool:"), F.concat(F.lit("Use "), F.replace(F.substring(action, 6, 1 << 20), F.lit("-"), F.lit(" "))))
    for name, said in INSTRUCTIONS.items():
        out = out.when(action == name, F.lit(said))
    return out.otherwise(F.concat(F.lit("Perform "), F.replace(action, F.lit("_"), F.lit(" "))))


def short_step(action: Column) -> Column:
    """An action as a label: the command, the server, or the tool."""
    return F.when(action.startswith("mcp:"), F.regexp_extract(action, "^mcp:([^:]*)", 1)).otherwise(F.regexp_replace(action, "^(?:shell|tool):", ""))


def systems(values: Column) -> Column:
    """Names of the systems that tools, actions and commands belong to, each once, in their order."""
    table = F.array(*(F.struct(F.lit(k).alias("begins"), F.lit(v).alias("name")) for k, v in SYSTEMS.items()))

    def of(v: Column) -> Column:
        return F.transform(F.filter(table, lambda h: v.startswith(h["begins"]) | F.concat(F.lit("shell:"), v).startswith(h["begins"])), lambda h: h["name"])

    return F.array_distinct(F.flatten(F.transform(values, of)))


def called_object(actions: Column, names: Column) -> Column:
    """The noun that most integration calls name, as a plural; null for none."""
    rest = F.transform(F.filter(actions, lambda a: a.startswith("mcp:")), lambda a: F.split(F.replace(F.substring(a, 5, 1 << 20), F.lit(":"), F.lit("-")), "-"))
    words = F.transform(F.flatten(rest), lambda w: F.regexp_replace(F.lower(w), "s$", ""))
    skipped = F.transform(names, lambda n: F.lower(n))
    nouns = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*PLAIN) & ~F.array_contains(skipped, w))

    def most(all_: Column) -> Column:
        counted = F.transform(F.array_distinct(all_), lambda x: F.struct((-F.size(F.filter(all_, lambda y: y == x))).alias("less"), x.alias("word")))
        return F.array_min(counted)["word"]

    return F.concat(bound(nouns, most), F.lit("s"))


def title(c: DataFrame) -> DataFrame:
    """c with ``title``.

    c has skill_ref, verb, phrases (array of phrase and score), keywords, tools,
    steps and commands (arrays), repos (array) and said (the intent of its first
    arc). The skill that the work calls for names it; else its subject does: a
    strong phrase, the systems that it works on with their object or first other
    keyword, three keywords, its one repository or its first command. A verb
    that its prompts agree on goes before the subject, else what its first tool
    does after it.
    """
    strong = F.filter("phrases", lambda p: p["score"] >= STRONG)
    first, second = F.get("phrases", F.lit(0)), F.get("phrases", F.lit(1))
    pair = (F.size(F.split(first["phrase"], r"\s+")) < 3) & (second["score"] >= STRONG)
    by_phrase = F.when(first["score"] >= STRONG, F.when(F.coalesce(pair, F.lit(False)), F.concat(first["phrase"], F.lit(" "), second["phrase"])).otherwise(first["phrase"]))
    c = c.withColumn("_strong", F.size(strong)).withColumn("_names", systems(F.concat("tools", "steps", "commands"))).withColumn("_phrase", by_phrase)
    lowered = F.transform("_names", lambda n: F.lower(n))
    other = F.get(F.filter("keywords", lambda k: ~F.array_contains(lowered, k)), 0)
    object_ = F.coalesce(called_object(F.concat("tools", "steps"), F.col("_names")), other)
    by_system = F.when(F.size("_names") > 0, F.concat_ws(" ", F.array_join(F.slice("_names", 1, 2), " and "), object_))
    by_words = F.nullif(F.array_join(F.slice("keywords", 1, 3), " "), F.lit(""))
    command = F.get("commands", F.lit(0))
    by_place = F.when(F.size("repos") == 1, F.get("repos", F.lit(0))).otherwise(F.concat(F.lit("`"), command, F.lit("`")))
    c = c.withColumn("_subject", F.coalesce("_phrase", by_system, by_words, by_place))
    verb = F.col("verb")
    shown = F.coalesce(*(F.when(verb == k, F.lit(v)) for k, v in SHOWN.items()), F.initcap(verb))
    suffix = F.coalesce(*(F.when(F.get("tools", F.lit(0)) == k, F.lit(v)) for k, v in SUFFIXES.items()))
    named = F.concat(F.upper(F.substring("_subject", 1, 1)), F.substring("_subject", 2, 1 << 20))
    bare = bound(named, lambda t: F.when(suffix.isNotNull() & ~F.contains(t, suffix), F.concat(t, F.lit(" "), suffix)).otherwise(t))
    line = F.nullif(truncate(first_line(F.coalesce("said", F.lit(""))), 60), F.lit(""))
    made = F.when(F.coalesce("skill_ref", F.lit("")) != "", F.col("skill_ref")).when(F.col("_subject").isNotNull() & verb.isNotNull(), F.concat(shown, F.lit(" "), F.col("_subject"))).when(F.col("_subject").isNotNull(), bare)
    return c.withColumn("title", F.coalesce(made, F.concat(F.lit("Run "), command), line, F.lit("Recurring workflow"))).drop("_strong", "_names", "_phrase", "_subject")


def summary_line(c: DataFrame) -> Column:
    """How often, where and in what steps the work was done, as a sentence or two."""
    repos, agents = F.size("repos"), F.size("agents")
    where = F.when(repos == 1, F.concat(F.lit(" in "), F.get("repos", F.lit(0)))).when(repos > 1, F.concat(F.lit(" in "), repos, F.lit(" repositories"))).otherwise("")
    who = F.when(agents > 1, F.concat(F.lit(" and "), agents, F.lit(" agents"))).otherwise("")
    often = F.when(~F.coalesce("label", F.lit("")).isin("", "once"), F.concat(F.lit(", "), "label")).otherwise("")
    steps = F.when(F.size("steps") > 0, F.concat(F.lit(" Usually: "), F.array_join(F.transform(F.slice("steps", 1, 4), short_step), " → "), F.lit("."))).otherwise("")
    return F.concat(F.lit("Ran "), F.col("runs"), F.lit(" times across "), F.col("sessions"), F.lit(" sessions"), where, who, often, F.lit("."), steps)


def named(c: DataFrame) -> DataFrame:
    """c with title, slug, summary and id."""
    c = title(c)
    c = c.withColumn("slug", slug(F.col("title"))).withColumn("summary", summary_line(c))
    return c.withColumn("id", fingerprint(F.lit("candidate"), F.col("slug"), F.array_join("steps", "|")))

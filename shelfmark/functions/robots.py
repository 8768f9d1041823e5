"""robots.txt as rules: parsing, choice of the group, longest match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.money import trimmed


def rules(files: DataFrame, key: str = "origin", body: str = "body") -> DataFrame:
    """(key, agent, kind, value, line): one row for each agent and allow, disallow or crawl-delay line; sitemaps have agent null.

    A run of user-agent lines opens a block; the lines that follow belong to all its agents.
    """
    lines = files.select(key, F.posexplode(F.split(F.col(body), "\r\n|\r|\n")).alias("line", "raw"))
    clean = lines.withColumn("raw", trimmed(F.regexp_replace("raw", "(?s)#.*", ""))).where("instr(raw, ':') > 0")
    field = clean.select(key, "line", F.lower(trimmed(F.substring_index("raw", ":", 1))).alias("kind"), trimmed(F.expr("substring(raw, instr(raw, ':') + 1)")).alias("value"))
    order = Window.partitionBy(key).orderBy("line")
    # sitemap lines stand outside the blocks
    inside = field.where("kind != 'sitemap'")
    opens = (F.col("kind") == "user-agent") & (F.coalesce(F.lag("kind").over(order), F.lit("")) != "user-agent")
    blocks = inside.withColumn("block", F.sum(opens.cast("int")).over(order))
    agents = blocks.where("kind = 'user-agent'").groupBy(key, "block", F.lower("value").alias("agent")).agg(F.min("line").alias("agent_line"))
    own = blocks.where("kind in ('allow', 'disallow', 'crawl-delay') and block > 0").join(agents.drop("agent_line"), [key, "block"])
    maps = field.where("kind = 'sitemap'").select(key, F.lit(None).cast("string").alias("agent"), "kind", "value", "line")
    # an agent without lines still counts as a group; its line, below 0, tells where the agent came first
    bare = agents.groupBy(key, "agent").agg((-1 - F.min("agent_line")).alias("line")).select(key, "agent", F.lit("group").alias("kind"), F.lit("").alias("value"), "line")
    return own.select(key, "agent", "kind", "value", "line").unionByName(maps).unionByName(bare)


def agent_token(user_agent: Column) -> Column:
    return F.lower(F.regexp_extract(trimmed(user_agent), r"^([^/\s]+)", 1))


def applying(rule_rows: DataFrame, token: str, key: str = "origin") -> DataFrame:
    """The rules of the group for ``token``: an agent that is the token or a prefix of it, the last such group, else ``*``."""
    fit = F.lit(token).startswith(F.col("agent")) & (F.col("agent") != "*") & (F.col("agent") != "") if token else F.lit(False)
    named = rule_rows.where("kind = 'group'").where(fit | (F.col("agent") == "*"))
    place = F.struct((F.col("agent") != "*").alias("named"), (-F.col("line")).alias("at"))
    best = named.groupBy(key).agg(F.max_by("agent", place).alias("agent"))
    return rule_rows.join(best, [key, "agent"], "left_semi")


def rule_regex(rule: Column) -> Column:
    """``*`` stands for anything, a final ``$`` for the end; else a prefix."""
    bare = F.regexp_replace(rule, r"\$\z", "")
    escaped = F.regexp_replace(bare, r"([.+?^$\{\}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit(".*")), F.when(rule.endswith("$"), F.lit("\\z")).otherwise(""))


def allowed(paths: DataFrame, rule_rows: DataFrame, key: str = "origin") -> DataFrame:
    """paths (key, path) with ``allowed`` and ``rule``: the longest matching rule wins, allow wins ties, empty rules never match.

    Rules are matched within their own origin only.
    """
    own = rule_rows.where("kind in ('allow', 'disallow') and value != ''").select(F.col(key).alias("__key"), "kind", "value", rule_regex(F.col("value")).alias("__regex"), F.length(F.regexp_replace("value", r"\$\z", "")).alias("__n"))
    tagged = paths.withColumn("__path", F.when(F.coalesce("path", F.lit("")) == "", "/").otherwise(F.col("path")))
    met = tagged.select(key, "__path").distinct().join(own, F.col(key) == F.col("__key")).where(F.expr("regexp_like(__path, __regex)"))
    best = met.groupBy(key, "__path").agg(F.max(F.when(F.col("kind") == "allow", F.col("__n"))).alias("a"), F.max(F.when(F.col("kind") == "disallow", F.struct("__n", "value"))).alias("d"))
    blocked = F.col("d").isNotNull() & (F.col("d.__n") > F.coalesce("a", F.lit(-1)))
    return tagged.join(best, [key, "__path"], "left").select(*paths.columns, (~F.coalesce(blocked, F.lit(False))).alias("allowed"), F.when(blocked, F.col("d.value")).alias("rule"))


def allowed_by_origin(paths: DataFrame, answers: DataFrame, token: str) -> DataFrame:
    """paths (origin, path) with ``policy``, ``allowed`` and ``rule``: what robots.txt of the origin says (answers: origin, status, body; one a row); an origin never asked is disallowed."""
    policy = answers.select("origin", fetch_policy(F.col("status")).alias("policy"))
    read = answers.join(policy.where("policy = 'read'"), "origin", "left_semi")
    judged = allowed(paths.join(policy, "origin", "left"), applying(rules(read), token))
    verdict = F.when(F.col("policy") == "read", F.col("allowed")).otherwise(F.coalesce(F.col("policy") == "allow_all", F.lit(False)))
    return judged.select(*paths.columns, F.coalesce("policy", F.lit("disallow_all")).alias("policy"), verdict.alias("allowed"), F.when(F.col("policy") == "read", F.col("rule")).alias("rule"))


def fetch_policy(status: Column) -> Column:
    """What the answer to robots.txt itself means: read, allow_all (4xx) or disallow_all (5xx or no answer)."""
    return F.when(status.between(200, 299), "read").when(status.between(400, 499), "allow_all").otherwise("disallow_all")  # null too

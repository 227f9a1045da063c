"""URL filters: hand-written rules, then a tree of path templates for each host.

Path segments that carry a digit become wildcards at once; of the others under one node, those
that are rare among many siblings become wildcards too. Counts of labelled pages go up the tree
of templates. A branch whose share of bad pages doesn't differ significantly from its parent's is
merged with it: a template is judged by the deepest node on its way from the root that stands out,
else by all pages. It is rejected where that node's smoothed share of bad pages is high.

All of it is SQL. Pages are reduced to counts for each host and template, with partial sums,
before the tree is built; the result is joined back by host and template.

Results: a null url, or one without ``://``, has an empty host and path, matches no rule and is
judged like any other host without segments. Templates are as deep as their paths; a level takes a round of
jobs only where over ``SIBLINGS`` templates lie below one node. Repeated rows each keep their row and each count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingmill.llm.base import settle

#: Verdict, host, path prefix; fixed by the task.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: A segment is variable if it has over SIBLINGS siblings and less than one in RARE of their pages.
SIBLINGS = 20
RARE = 20
#: Squared standard errors by which a branch must differ from its parent.
DIFFERS = 9.0
#: Pages of the common share of bad ones that smoothing adds.
SMOOTHING = 10.0
REJECT = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url) -> "F.Column":
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path(url) -> "F.Column":
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host_, path_, rules=RULES) -> tuple["F.Column", "F.Column"]:
    """The longest rule that fits, and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, own, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_ == own) | host_.endswith("." + own)) & path_.startswith(prefix)
        name, verdict = F.when(fits, own + prefix).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def basic(path_) -> "F.Column":
    """The path with segments that carry a digit as wildcards."""
    return F.regexp_replace(F.regexp_replace(path_, r"[^/]*[0-9][^/]*", "*"), r"/+$", "")


def generalise(counts: DataFrame) -> DataFrame:
    """``host, template`` with its ``final`` form, in which rare segments are wildcards too.

    A node has no more children than templates below it, so that those of a node with at most ``SIBLINGS`` are finished
    at once; only the others take a round for each level."""
    now, done, k = counts.withColumn("part", F.split("template", "/")).withColumn("final", F.lit("")), None, 1
    while True:
        many = now.groupBy("host", "final").agg(F.count("*").alias("below")).where(F.col("below") > SIBLINGS)
        now = settle(now.join(many, ["host", "final"], "left").withColumn("open", F.col("below").isNotNull() & (F.size("part") > k)).drop("below"))
        rest = F.concat("final", F.lit("/"), F.array_join(F.slice("part", F.lit(k + 1), F.greatest(F.size("part") - k, F.lit(0))), "/"))
        ended = now.where("not open").select("host", "template", F.when(F.size("part") > k, rest).otherwise(F.col("final")).alias("final"))
        done = ended if done is None else done.unionByName(ended)
        now = now.where("open").drop("open").withColumn("own", F.get("part", F.lit(k)))
        if now.isEmpty():
            return done
        kids = now.groupBy("host", "final", "own").agg(F.sum("n").alias("many"))
        nodes = kids.groupBy("host", "final").agg(F.count("*").alias("kids"), F.sum("many").alias("total"))
        rare = kids.join(nodes.where(F.col("kids") > SIBLINGS), ["host", "final"]).where(F.col("many") * RARE < F.col("total")).select("host", "final", "own", F.lit(True).alias("rare"))
        step = F.concat("final", F.lit("/"), F.when(F.col("rare"), F.lit("*")).otherwise(F.col("own")))
        now = now.join(rare, ["host", "final", "own"], "left").withColumn("final", step).drop("rare", "own")
        k += 1


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, bad_share`` for each row of ``pages`` (``page_id``,
    ``url``); ``labelled`` has ``page_id`` and ``bad`` (boolean), one row for a page at most."""
    base = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    base = base.select("*", name.alias("rule"), verdict.alias("ruled"), basic(F.col("path")).alias("template"))
    marked = base.join(labelled.select("page_id", "bad"), "page_id", "left")
    bad = F.when(F.col("bad"), 1).otherwise(0)
    counts = settle(
        marked.groupBy("host", "template").agg(
            F.count("*").alias("n"), F.count("bad").alias("known"), F.sum(bad).alias("bad")
        )
    )
    finals = settle(counts.join(generalise(counts.select("host", "template", "n")), ["host", "template"]).select("host", "template", "final", "known", "bad"))
    all_known, all_bad = (float(x or 0) for x in finals.agg(F.sum("known"), F.sum("bad")).first())
    common = all_bad / all_known if all_known else 0.0
    # nodes on the way from the root: the host itself is level 0
    by = finals.groupBy("host", "final").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"))
    # a node is the digest of its parent's and its segment, so that deep paths aren't written once for each level
    chain = F.aggregate(F.split("final", "/"), F.array(F.lit("")), lambda way, x: F.array_append(way, F.md5(F.concat(F.element_at(way, -1), F.lit("/"), x))))
    ways = by.select("host", "final", "known", "bad", chain.alias("way")).select("*", F.posexplode(F.slice("way", F.lit(2), F.size("way") - 1)).alias("level", "node"))
    ways = ways.withColumn("parent", F.when(F.col("level") > 0, F.get("way", F.col("level")))).drop("way")
    nodes = settle(ways.groupBy("host", "level", "node", "parent").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad")))
    up = nodes.select("host", F.col("node").alias("parent"), (F.col("level") + 1).alias("level"), F.col("known").alias("up_known"), F.col("bad").alias("up_bad"))
    against = nodes.join(up, ["host", "parent", "level"], "left")
    top_known, top_bad = F.coalesce("up_known", F.lit(all_known)), F.coalesce("up_bad", F.lit(all_bad))
    known, bad_ = F.col("known").cast("double"), F.col("bad").cast("double")
    p = top_bad / top_known
    stands_out = (known > 0) & (F.pow(bad_ / known - p, F.lit(2.0)) * known > DIFFERS * p * (1 - p))
    share = (bad_ + SMOOTHING * common) / (known + SMOOTHING)
    out = against.where(stands_out).select("host", "level", "node", share.alias("share"))
    best = ways.select("host", "final", "level", "node").join(out, ["host", "level", "node"]).groupBy("host", "final").agg(F.max_by("share", "level").alias("share"))
    result = settle(finals.join(best, ["host", "final"], "left").select("host", "template", "final", "share"))
    joined = base.join(result, ["host", "template"], "left")
    own = F.when(F.coalesce("share", F.lit(0.0)) >= REJECT, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), F.col("final").alias("template"), F.round("share", 6).alias("bad_share"))


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of pages: a page whose path ends with a number (before an extension) shows the
    document of that number, and is bad if that is of low quality or toxic. Where ``page_id`` or ``doc_id``
    repeats, one bad label makes the page bad; a label of which one half is null counts by the other."""
    number = F.regexp_extract(path(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    shown = pages.select("page_id", F.when(number != "", number).cast("long").alias("doc_id"))
    on = lambda c: F.coalesce(c, F.lit(False))
    known = labels.where("quality is not null or toxic is not null")
    bad = known.select("doc_id", (on(F.col("quality") == 0) | on(F.col("toxic") == 1)).alias("bad"))
    return shown.join(bad, "doc_id").where("page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))


def oracle_sql(depth: int = 8) -> str:
    """DuckDB SQL for the registered query, for paths of up to ``depth`` segments."""
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(what, own, prefix, f"(host = '{own}' or ends_with(host, '.{own}')) and starts_with(path, '{prefix}')") for what, own, prefix in rules]
    case = lambda k: "case " + " ".join(f"when {f[3]} then '{f[0] if k else f[1] + f[2]}'" for f in fits) + " end"
    steps, now = "", "select *, string_split(template, '/') as part, '' as final from counts"
    for k in range(1, depth + 1):
        steps += f"""
n{k} as ({now}),
k{k} as (select host, final, part[{k + 1}] as own, sum(n) as many from n{k} where len(part) > {k} group by 1, 2, 3),
r{k} as (select host, final, own from (select *, count(*) over w as kids, sum(many) over w as total from k{k} window w as (partition by host, final)) where kids > {SIBLINGS} and many * {RARE} < total),"""
        now = f"select n.* replace (case when len(part) > {k} then n.final || '/' || case when r.own is not null then '*' else part[{k + 1}] end else n.final end as final) from n{k} n left join r{k} r on r.host = n.host and r.final = n.final and r.own = part[{k + 1}]"
    return f"""
with u as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
base as (select *, {case(0)} as rule, {case(1)} as ruled, regexp_replace(regexp_replace(path, '[^/]*[0-9][^/]*', '*', 'g'), '/+$', '') as template from u),
shown as (select page_id, try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\\.[a-z]+)?/?$', 1), '') as bigint) as doc_id from u where page_id is not null),
l as (select page_id, max(coalesce(quality = 0, false) or coalesce(toxic = 1, false)) as bad from shown join labels using (doc_id) where quality is not null or toxic is not null group by 1),
counts as (select host, template, count(*) as n, count(bad) as known, count(*) filter (bad) as bad from base left join l using (page_id) group by 1, 2),{steps}
finals as ({now}),
a as (select sum(known)::double as known, sum(bad)::double as bad from finals),
ways as (
  select host, final, known, bad, level, array_to_string(string_split(final, '/')[1:level + 1], '/') as node, case when level > 0 then array_to_string(string_split(final, '/')[1:level], '/') end as parent
  from (select host, final, sum(known) as known, sum(bad) as bad, unnest(range(0, len(string_split(final, '/')))) as level from finals group by 1, 2)),
nodes as (select host, level, node, parent, sum(known)::double as known, sum(bad)::double as bad from ways group by 1, 2, 3, 4),
pairs as (select n.*, coalesce(p.known, a.known) as up, coalesce(p.bad, a.bad) / coalesce(p.known, a.known) as p, a.bad / a.known as common
  from nodes n cross join a left join nodes p on p.host = n.host and p.level = n.level - 1 and p.node = n.parent),
outs as (select host, level, node, (bad + {SMOOTHING} * common) / (known + {SMOOTHING}) as share from pairs where known > 0 and pow(bad / known - p, 2) * known > {DIFFERS} * p * (1 - p)),
best as (select host, final, max_by(share, level) as share from ways join outs using (host, level, node) group by 1, 2),
result as (select f.host, f.template, f.final, share from finals f left join best using (host, final))
select page_id, host, path, rule, coalesce(ruled, case when coalesce(share, 0) >= {REJECT} then 'block' else 'allow' end) as verdict, final as template, round(share, 6) as bad_share
from base join result using (host, template)"""

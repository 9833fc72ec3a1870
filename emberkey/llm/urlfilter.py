"""URL verdicts by rules and, where none fits, by a tree of path templates. DataFrame functions only.

Every host has a tree of path segments. Digits in a segment become ``#``, long hexadecimal runs
``*``. Where a node has many different children with few pages each, they are one variable segment,
``*``. Children of a node whose share of blocked pages doesn't differ from their parent's by more than chance
are merged into ``~``. A template is blocked if its purity, the share of blocked among its labelled
pages, smoothed by the same template on all hosts and by its host, is at least one half.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberkey.llm.common import materialize

#: (verdict, host, path): a rule fits its host and all subdomains, where the path starts with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DEPTH = 8  # levels of the tree; what follows the last one belongs to it, whole
FEW_PAGES = 4  # a node is variable if it has ...
MANY_CHILDREN = 8  # ... so many children and fewer pages a child
SMOOTHING = 4.0
CHANCE = 1.96


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null urls and those without ``://``."""
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path``, and its verdict; nulls if none does. Rules are few and constant."""

    def fits(h: str, p: str) -> Column:
        return ((host == F.lit(h)) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))

    longest_first = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    pick = lambda of: F.coalesce(*[F.when(fits(h, p), F.lit(of(v, h, p))) for v, h, p in longest_first])
    return pick(lambda v, h, p: h + p), pick(lambda v, h, p: v)


def general_segments(path: Column, depth: int = DEPTH) -> list[Column]:
    """The path in general form: a segment for each level, empty past the end; the last level takes all that follow."""
    parts = F.filter(F.split(path, "/", -1), lambda s: s != "")
    general = F.transform(
        parts,
        lambda s: F.when(F.regexp_like(s, F.lit("^[0-9a-fA-F-]{16,}$")), F.lit("*")).otherwise(F.regexp_replace(s, "[0-9]+", "#")),
    )
    rest = F.array_join(F.slice(general, F.lit(depth), F.greatest(F.size(general) - (depth - 1), F.lit(0))), "/")
    return [*[F.coalesce(F.get(general, F.lit(i)), F.lit("")) for i in range(depth - 1)], F.coalesce(rest, F.lit(""))]


def judge_pages(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, depth: int = DEPTH) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row of (page_id, url).

    Pages that a rule judges are the labelled ones. Without any labelled page purity is 0.5 by its prior and
    unruled pages are blocked. Null and odd urls have an empty host and the empty template. Repeated
    rows each give a row, an empty table none; other columns are ignored, whatever their names. However long an url is, all
    of its path counts: segments past `depth` levels are one segment together.

    All statistics are sums with map-side combine over (host, general path); later steps work on these
    counts only. The pages meet the counts in one join on (host, segments), of which a busy host
    is split by adaptive execution, or no shuffle at all while the counts are small.
    """
    host, path = url_parts(F.col("url"))
    seg = [f"s{i}" for i in range(depth)]
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, ruled = fitting_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "ruled": ruled, **dict(zip(seg, general_segments(F.col("path"), depth), strict=True))})
    n, b = F.count("ruled"), F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0))
    forms = materialize(base.groupBy("host", *seg).agg(F.count("*").alias("pages"), n.alias("n"), b.alias("b")), "forms")

    # Level by level, as far as any path goes: a node's many rare children become one.
    last = lambda c: reduce(lambda rest, i: F.when(F.col(f"{c}{i}") != "", F.lit(i)).otherwise(rest), range(depth), F.lit(-1))
    levels = 1 + (forms.agg(F.max(last("s"))).first()[0] or 0)
    tree = forms.withColumns({f"t{i}": F.lit("") for i in range(depth)})
    for i in range(levels):
        node = ["host", *[f"t{j}" for j in range(i)]]
        children = tree.groupBy(*node, seg[i]).agg(F.sum("pages").alias("pages")).groupBy(*node)
        wide = children.agg(F.count("*").alias("children"), F.sum("pages").alias("below"))
        wide = wide.where((F.col("children") >= MANY_CHILDREN) & (F.col("below") < F.col("children") * FEW_PAGES))
        wide = wide.select(*node, F.lit(True).alias("variable"))
        shown = F.when(F.col("variable") & (F.col(seg[i]) != ""), F.lit("*")).otherwise(F.col(seg[i]))
        tree = materialize(tree.join(wide, node, "left").withColumn(f"t{i}", shown).drop("variable"), "tree")

    # Siblings that differ from their parent by chance only are one branch, ~.
    # Siblings are children of the deepest node that has any segment; the last filled segment is the leaf.
    leafed = tree.withColumn("deep", last("t"))
    leaf = F.when(F.col("deep") >= 0, F.get(F.array(*[F.col(f"t{i}") for i in range(depth)]), F.col("deep"))).otherwise("")
    parent = F.concat_ws("/", *[F.when(F.col("deep") > i, F.col(f"t{i}")) for i in range(depth)])
    leafed = leafed.withColumns({"leaf": leaf, "parent": parent})
    branch = leafed.groupBy("host", "parent", "leaf").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    above = branch.groupBy("host", "parent").agg(F.sum("n").alias("pn"), F.sum("b").alias("pb"))
    rate = (F.col("pb") + 0.5) / (F.col("pn") + 1.0)
    same = F.abs(F.col("b") - F.col("n") * rate) <= CHANCE * F.sqrt(F.col("n") * rate * (1.0 - rate)) + 0.5
    merged = branch.join(above, ["host", "parent"]).withColumn("shown", F.when(same, F.lit("~")).otherwise(F.col("leaf")))
    merged = merged.withColumn("template", F.concat(F.lit("/"), F.when(F.col("parent") != "", F.concat("parent", F.lit("/"))).otherwise(""), "shown"))
    merged = materialize(merged.select("host", "parent", "leaf", "template", "n", "b"), "branches")

    every = merged.agg(((F.coalesce(F.sum("b"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("n"), F.lit(0)) + 2.0)).alias("g"))
    smooth = lambda x, m, prior: (F.col(x) + SMOOTHING * prior) / (F.col(m) + SMOOTHING)
    # A form on all hosts is taken before merging, for a merged branch hides it.
    forms_all = merged.groupBy("parent", "leaf").agg(F.sum("n").alias("fn"), F.sum("b").alias("fb"))
    hosts = merged.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("b").alias("hb"))
    pooled = merged.groupBy("host", "template").agg(F.sum("n").alias("tn"), F.sum("b").alias("tb"))
    scored = merged.join(pooled, ["host", "template"]).join(forms_all, ["parent", "leaf"]).join(hosts, "host").join(F.broadcast(every))
    prior = (smooth("fb", "fn", F.col("g")) + smooth("hb", "hn", F.col("g"))) / 2.0
    scored = scored.withColumn("purity", F.round(smooth("tb", "tn", prior), 6))
    scored = leafed.select("host", *seg, "parent", "leaf").join(scored.select("host", "parent", "leaf", "template", "purity"), ["host", "parent", "leaf"])
    scored = materialize(scored.select("host", *seg, "template", "purity"), "templates")

    judged = base.join(scored, ["host", *seg])
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def sql(rules: tuple[tuple[str, str, str], ...] = RULES) -> str:
    """The same in DuckDB's SQL."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda of: "CASE " + " ".join(f"WHEN {fits.format(h=h, p=p)} THEN '{of(v, h, p)}'" for v, h, p in ordered) + " END"
    general = "CASE WHEN regexp_matches(s, '^[0-9a-fA-F-]{16,}$') THEN '*' ELSE regexp_replace(s, '[0-9]+', '#', 'g') END"
    def step(i: int) -> str:
        node = ", ".join(["host", *[f"t{j}" for j in range(i)]])
        prev = "forms" if i == 0 else f"tree{i - 1}"
        return f"""kid{i} AS MATERIALIZED (SELECT {node}, s{i}, sum(pages) AS pages FROM {prev} GROUP BY ALL),
wide{i} AS (SELECT {node}, count(*) >= {MANY_CHILDREN} AND sum(pages) < count(*) * {FEW_PAGES} AS variable FROM kid{i} GROUP BY {node}),
tree{i} AS MATERIALIZED (SELECT x.*, CASE WHEN variable AND s{i} <> '' THEN '*' ELSE s{i} END AS t{i} FROM {prev} x JOIN wide{i} USING ({node}))"""

    levels = range(DEPTH)
    names = ", ".join(f"s{i}" for i in levels)
    segments = ", ".join([*[f"coalesce(g[{i + 1}], '') AS s{i}" for i in levels[:-1]], f"coalesce(array_to_string(g[{DEPTH}:], '/'), '') AS s{DEPTH - 1}"])
    steps = ",\n".join(step(i) for i in levels)
    leaf = "CASE " + " ".join(f"WHEN t{i} <> '' THEN t{i}" for i in reversed(levels)) + " ELSE '' END"
    parent = "CASE " + " ".join(f"WHEN t{i} <> '' THEN concat_ws('/', {', '.join(f't{j}' for j in range(i))})" for i in reversed(levels[1:])) + " ELSE '' END"
    smooth = lambda x, m, prior: f"(({x} + {SMOOTHING} * {prior})::DOUBLE / ({m} + {SMOOTHING}))"
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS after FROM pages),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(after, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(substr(after, length(regexp_extract(after, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1), '') AS path FROM cut),
segs AS (SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS ruled,
  list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {general}) AS g FROM parts),
base AS MATERIALIZED (SELECT page_id, host, path, rule, ruled, {segments} FROM segs),
forms AS MATERIALIZED (SELECT host, {names}, count(*) AS pages, count(ruled) AS n, count(*) FILTER (ruled = 'block') AS b FROM base GROUP BY ALL),
{steps},
leafed AS MATERIALIZED (SELECT *, {leaf} AS leaf, {parent} AS parent FROM tree{DEPTH - 1}),
branch AS (SELECT host, parent, leaf, sum(n) AS n, sum(b) AS b FROM leafed GROUP BY ALL),
above AS (SELECT host, parent, sum(n) AS pn, (sum(b) + 0.5)::DOUBLE / (sum(n) + 1.0) AS rate FROM branch GROUP BY ALL),
merged AS MATERIALIZED (SELECT host, parent, leaf, n, b, '/' || CASE WHEN parent <> '' THEN parent || '/' ELSE '' END ||
  CASE WHEN abs(b - n * rate) <= {CHANCE} * sqrt(n * rate * (1.0 - rate)) + 0.5 THEN '~' ELSE leaf END AS template FROM branch JOIN above USING (host, parent)),
every AS (SELECT (coalesce(sum(b), 0) + 1.0)::DOUBLE / (coalesce(sum(n), 0) + 2.0) AS g FROM merged),
forms_all AS (SELECT parent, leaf, sum(n) AS fn, sum(b) AS fb FROM merged GROUP BY ALL),
hosts AS (SELECT host, sum(n) AS hn, sum(b) AS hb FROM merged GROUP BY ALL),
pooled AS (SELECT host, template, sum(n) AS tn, sum(b) AS tb FROM merged GROUP BY ALL),
scored AS (SELECT m.host, m.parent, m.leaf, m.template,
  round({smooth("tb", "tn", f"(({smooth('fb', 'fn', 'g')} + {smooth('hb', 'hn', 'g')}) / 2.0)")}, 6) AS purity
  FROM merged m JOIN pooled USING (host, template) JOIN forms_all USING (parent, leaf) JOIN hosts USING (host) CROSS JOIN every)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template, purity
FROM base JOIN leafed USING (host, {names}) JOIN scored USING (host, parent, leaf)
"""

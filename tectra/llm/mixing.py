"""Mixing sources to target weights by hierarchical budgets, with DataFrame operations alone.

Weights run down a tree of domain, language and source. A node's budget goes to its children by weight, none above its
capacity (its tokens times the most epochs); what one can't take goes to its siblings, and since a node's capacity is
that of what lies below it, only what siblings can't take goes to an ancestor's siblings. A leaf takes whole epochs of
its documents and then a prefix, by tokens, of one more; each epoch has its own seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

TREE = ["domain", "lang", "source"]
#: Target weights, whole numbers; a node that isn't listed has weight 1.
WEIGHTS = {"domain": {"web": 50, "books": 30, "code": 20}, "lang": {"en": 40, "de": 25, "fr": 25, "es": 10}, "source": {}}
_WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of a document's place in its epoch that make its bucket.
_DIGITS = 3


def source_domain(source: Column) -> Column:
    """The domain of the synthetic sources: their number by three."""
    n = F.coalesce(F.regexp_extract(source, r"(\d+)", 1).try_cast("long"), F.lit(0)) % 3
    return F.when(n == 0, "web").when(n == 1, "books").otherwise("code")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    w = F.lit(1).cast("long")
    for name, value in sorted(weights.get(level, {}).items()):
        w = F.when(F.col(level) == name, F.lit(value).cast("long")).otherwise(w)
    return w


def share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes: parent's columns, `name`, weight, capacity, budget (the parent's). Adds given: at most the capacity, in all at
    most the budget, by weight among those whose capacity holds. Whole numbers throughout; what is lost by rounding
    down is less than one token a node."""
    order = [F.col("capacity").cast("double") / F.col("weight").cast("double"), F.col(name)]
    by = Window.partitionBy(*parent)
    before, after = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), by.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    nodes = nodes.filter("weight > 0").withColumn("left", F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("among", F.sum("weight").over(after))
    nodes = nodes.withColumn("open", F.col("left") * F.col("weight") <= F.col("capacity") * F.col("among"))
    # the first open node has the greatest rest and weights; it sets the rate for all open ones
    nodes = nodes.withColumn("rest", F.max(F.when(F.col("open"), F.col("left"))).over(by)).withColumn("sum", F.max(F.when(F.col("open"), F.col("among"))).over(by))
    given = F.when(F.col("open"), F.expr("rest * weight div sum")).otherwise(F.col("capacity"))
    return nodes.withColumn("given", given).drop("left", "among", "open", "rest", "sum")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], percent: int, max_epochs: int) -> DataFrame:
    """leaves: TREE, tokens. Adds budget: the leaf's tokens to take. The whole budget is percent of all tokens."""
    cap = leaves.select(*TREE, "tokens", (F.col("tokens") * max_epochs).alias("capacity"))
    total = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * percent).alias("t")).select(F.expr("t div 100").alias("budget"), F.lit(1).alias("one"))
    upper = None
    for depth, level in enumerate(TREE):
        nodes = cap.groupBy(*TREE[: depth + 1]).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(level, weights))
        if upper is None:
            nodes = nodes.withColumn("one", F.lit(1)).join(total, "one")
            upper = share(nodes, ["one"], level).select(level, F.col("given").alias("budget"))
        else:
            upper = share(nodes.join(upper, TREE[:depth]), TREE[:depth], level).select(*TREE[: depth + 1], F.col("given").alias("budget"))
    return cap.select(*TREE, "tokens").join(upper, TREE)


def mix_sources(docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, percent: int = 100, max_epochs: int = 4, seed: int = 7, domain=source_domain, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", epoch_col: str = "epoch") -> DataFrame:
    """The rows of `docs` that are taken, once for each epoch that takes them, with all their columns and the number of the epoch.

    Tokens are words between ASCII white space. The budget is percent of all tokens. Null languages and sources are the
    empty name. Null and empty texts have no tokens: they go with the epochs of a leaf that has tokens, and with its
    prefix where that has tokens; a leaf without tokens gives nothing. Equal ids in one leaf have equal places and are ordered by their text. An empty table gives
    an empty one. A column named as epoch_col is replaced.

    A leaf may hold any share of the rows: its running sum goes over buckets of the seeded order, which are summed
    first, and row by row only in the one bucket where the prefix ends.
    """
    own = [c for c in docs.columns if c != epoch_col]
    tree = F.struct(domain(F.col(source_col)).alias("domain"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"))
    rows = docs.select(F.struct(*own).alias("row"), tree.alias("leaf"), F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("words"))
    rows = rows.select("row", "leaf.*", "id", "words")
    tokens = F.regexp_count("words", F.lit(_WORD)).cast("long")

    # texts are counted once: what follows reads ids and counts alone
    counted = common.cut(rows.select(*TREE, "id", tokens.alias("n")))
    leaves = counted.groupBy(*TREE).agg(F.sum("n").alias("tokens")).filter("tokens > 0")
    plan = leaf_budgets(leaves, weights, percent, max_epochs)
    # a written table has a known size, so that Spark joins documents to it without a shuffle where it is small
    plan = common.cut(plan.select(*TREE, F.expr("budget div tokens").alias("epochs"), F.expr("budget % tokens").alias("rest")))

    def placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
        at = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epochs").cast("string"), "id"))
        return rows.join(plan, TREE).withColumn("at", at).withColumn("bucket", F.substring("at", 1, _DIGITS))

    sums = placed(counted, plan).groupBy(*TREE, "epochs", "rest", F.substring("bucket", 1, 1).alias("part"), "bucket").agg(F.sum("n").alias("n"))
    sums = common.cut(sums)
    common.forget(docs.sparkSession, counted)
    # what comes before a bucket: the parts before its own, and in it the buckets before
    parts = sums.groupBy(*TREE, "part").agg(F.sum("n").alias("all"))
    parts = parts.select(*TREE, "part", (F.sum("all").over(Window.partitionBy(*TREE).orderBy("part")) - F.col("all")).alias("earlier"))
    run = sums.join(parts, [*TREE, "part"])
    run = run.withColumn("through", F.col("earlier") + F.sum("n").over(Window.partitionBy(*TREE, "part").orderBy("bucket")))
    edge = run.filter("through > rest").groupBy(*TREE, "epochs", "rest").agg(F.min_by(F.struct("bucket", (F.col("through") - F.col("n")).alias("before")), "bucket").alias("edge"))
    rows = placed(rows, common.cut(edge.select(*TREE, "epochs", "rest", F.col("edge.bucket").alias("edge"), F.col("edge.before").alias("before"))))

    whole = rows.filter("bucket <> edge").withColumn("take", F.col("epochs") + F.when((F.col("rest") > 0) & (F.col("bucket") < F.col("edge")), 1).otherwise(0))
    last = rows.filter("bucket = edge").withColumn("n", tokens)
    through = F.sum("n").over(Window.partitionBy(*TREE).orderBy("at", "id", F.md5("words"), "n").rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("take", F.col("epochs") + F.when((F.col("rest") > 0) & (F.col("before") + through <= F.col("rest")), 1).otherwise(0))
    taken = whole.select("row", "take").unionByName(last.select("row", "take")).filter("take > 0")
    return taken.withColumn(epoch_col, F.explode(F.sequence(F.lit(0), (F.col("take") - 1).cast("int")))).select("row.*", epoch_col)


def _weight_sql(level: str) -> str:
    listed = " ".join(f"WHEN '{k}' THEN {v}" for k, v in sorted(WEIGHTS[level].items()))
    return f"CAST(CASE {level} {listed} ELSE 1 END AS BIGINT)" if listed else "CAST(1 AS BIGINT)"


def mixing_sql(percent: int = 100, max_epochs: int = 4, seed: int = 7) -> str:
    """doc_id, domain, lang, source, epoch of what is taken from `documents`, for DuckDB."""
    levels, upper = [], f"SELECT CAST(coalesce(sum(tokens), 0) * {percent} // 100 AS BIGINT) AS budget FROM leaf"
    for depth, level in enumerate(TREE):
        keys, parent = ", ".join(TREE[: depth + 1]), ", ".join(TREE[:depth]) or "1"
        join = f"JOIN g{depth} USING ({', '.join(TREE[:depth])})" if depth else f"CROSS JOIN ({upper})"
        w = f"PARTITION BY {parent} ORDER BY CAST(capacity AS DOUBLE) / CAST(weight AS DOUBLE), {level}"
        levels.append(f"""
n{depth + 1} AS (SELECT *, {_weight_sql(level)} AS weight FROM (SELECT {keys}, CAST(sum(tokens * {max_epochs}) AS BIGINT) AS capacity FROM leaf GROUP BY {keys}) {join}),
o{depth + 1} AS (SELECT *, budget - coalesce(sum(capacity) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains,
    sum(weight) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS among FROM n{depth + 1}),
g{depth + 1} AS (SELECT {keys}, CAST(CASE WHEN remains * weight <= capacity * among
    THEN max(CASE WHEN remains * weight <= capacity * among THEN remains END) OVER (PARTITION BY {parent}) * weight
        // max(CASE WHEN remains * weight <= capacity * among THEN among END) OVER (PARTITION BY {parent})
    ELSE capacity END AS BIGINT) AS budget FROM o{depth + 1})""")
    return rf"""
WITH base AS (
    SELECT doc_id, CASE coalesce(TRY_CAST(regexp_extract(source, '(\d+)', 1) AS BIGINT), 0) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'code' END AS domain,
        coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS n
    FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS tokens FROM base GROUP BY ALL HAVING sum(n) > 0),{",".join(levels)},
plan AS (SELECT domain, lang, source, budget // tokens AS epochs, budget % tokens AS rest FROM leaf JOIN g3 USING (domain, lang, source)),
placed AS (SELECT *, md5(concat_ws('|', '{seed}', epochs, doc_id)) AS h FROM base JOIN plan USING (domain, lang, source)),
run AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS through FROM placed),
taken AS (SELECT doc_id, domain, lang, source, epochs + CASE WHEN rest > 0 AND through <= rest THEN 1 ELSE 0 END AS take FROM run)
SELECT doc_id, domain, lang, source, CAST(unnest(range(take)) AS INT) AS epoch FROM taken"""

"""Mixing sources to target weights by hierarchical budgets; DataFrame functions only.

A budget of tokens goes from the root through domain, language and source. At each node the children get it by their
weights; one that has less to give than its share is filled, and what it lacks goes to its siblings. A node's own
capacity is that of all below it, so only what no descendant can take reaches the siblings of the node, and so on up.
A leaf takes whole epochs of its documents, then the prefix of one more in a seeded order until its budget is met.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.shared import written

#: Production parameters: weights of tree paths (others count 1), passes over a document at most, and the seed.
WEIGHTS = {"web": 50, "books": 30, "reference": 20, "web/en": 3, "books/en": 3, "reference/en": 3}
MAX_EPOCHS = 4
SEED = 11
#: Documents of a leaf that one sort takes.
BUCKET_DOCS = 4000
#: Leaves up to which their budgets are sent to all tasks; with more, budgets and documents are shuffled by leaf.
SENT_LEAVES = 100_000

WORDS = "[^\\x20\\x09-\\x0D]+"


def domain_of(source: Column) -> Column:
    """The domain of the synthetic sources: src0-9 web, src10-14 books, others reference."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), "^src([0-9]{1,6})$", 1)
    return F.when(n == "", "reference").when(n.cast("int") < 10, "web").when(n.cast("int") < 15, "books").otherwise("reference")


def token_count(text: Column) -> Column:
    """Words of the whole text; zero for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def _weight(path: Column, weights: Mapping[str, int]) -> Column:
    if not weights:
        return F.lit(1.0)
    return F.coalesce(F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in weights.items())), path), F.lit(1.0))


def _fill(children: DataFrame, parent: Sequence[str], node: str) -> DataFrame:
    """Adds ``budget`` to children(capacity, weight, given): the parent's budget ``given`` in shares by weight, none over its capacity.

    In the order of capacity per weight the first children are filled and the others share what is left; a child is
    filled if its share of what the smaller ones left is at least its capacity.
    """
    own = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = own.orderBy("ratio", node)
    c = children.withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))))
    c = c.withColumns({
        "before": F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("capacity"),
        "left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    c = c.withColumn("filled", (F.col("weight") > 0) & (F.col("capacity") * F.col("left") <= F.col("weight") * (F.col("given") - F.col("before"))))
    c = c.withColumns({
        "used": F.sum(F.when(F.col("filled"), F.col("capacity")).otherwise(0.0)).over(own),
        "open": F.sum(F.when(F.col("filled"), 0.0).otherwise(F.col("weight"))).over(own),
    })
    share = F.when(F.col("filled"), F.col("capacity")).when(F.col("open") > 0, (F.col("given") - F.col("used")) * F.col("weight") / F.col("open")).otherwise(0.0)
    return c.withColumn("budget", F.greatest(share, F.lit(0.0))).drop("ratio", "before", "left", "filled", "used", "open")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, int], budget_tokens: int | None, max_epochs: int) -> DataFrame:
    """(levels, tokens, n_docs, budget long, epochs, rest) of each leaf(levels, tokens, n_docs).

    budget_tokens: None for as many as one epoch of everything has. A path is its levels joined by '/'; paths not in
    ``weights`` weigh 1; what weighs zero gives nothing. A budget that all leaves cannot meet is all they have.
    """
    def path(depth: int) -> Column:
        return F.concat_ws("/", *levels[: depth + 1])

    can = F.when(_weight(path(len(levels) - 1), weights) > 0, F.col("tokens").cast("double") * max_epochs).otherwise(0.0)
    tree = leaves.withColumn("capacity", can)
    total = F.sum("tokens").cast("double") if budget_tokens is None else F.lit(float(budget_tokens))
    given = leaves.agg(F.coalesce(total, F.lit(0.0)).alias("given"))
    parents: DataFrame | None = None
    for depth in range(len(levels)):
        keys = list(levels[: depth + 1])
        nodes = tree.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(path(depth), weights))
        # What weighs nothing above gives nothing below.
        nodes = nodes.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0.0))
        up = given if parents is None else parents
        nodes = nodes.crossJoin(up) if parents is None else nodes.join(up, keys[:-1])
        parents = _fill(nodes, keys[:-1], keys[-1]).select(*keys, F.col("budget").alias("given"))
    out = leaves.join(parents, list(levels)).withColumn("budget", F.floor(F.col("given") + 1e-6).cast("long"))
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int")
    return out.withColumn("epochs", whole).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")).drop("given")


def _sent(df: DataFrame, leaves: int) -> DataFrame:
    """A table with a row a leaf: to all tasks if there are at most SENT_LEAVES of them, else as it is."""
    return F.broadcast(df) if leaves <= SENT_LEAVES else df


def mix(docs: DataFrame, levels: Sequence[str] = ("domain", "lang", "source"), weights: Mapping[str, int] = WEIGHTS, budget_tokens: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, key: str = "doc_id", tokens: str = "n_tokens", bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """``docs`` with epoch, take_tokens: a row for each time that a document is taken.

    take_tokens is less than the document's for the last one of a leaf, at which its budget is met; rows are whole
    documents all the same. The seeded order of an epoch is by the md5 of seed, epoch and key, then by tokens. Null
    levels count as '', null tokens as none; a document without tokens is taken with the epochs of its leaf and where
    it stands in the prefix. Repeated rows count as often as they are there. Of the documents only counts by leaf and
    by ranges of the order are shuffled, and the rows of the one range of a leaf in which its budget ends.
    """
    # The documents' own columns go along as one, so that none of their names meets one of these.
    m = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_key"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("_tokens"), *[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in levels])
    leaves = written(m.groupBy(*levels).agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("n_docs")), "leaves")
    many = leaves.count()
    plan = budgets(leaves, levels, weights, budget_tokens, max_epochs).select(*levels, "epochs", "rest", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / bucket_docs)).cast("long").alias("buckets"))
    plan = written(plan, "budgets")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("_key").cast("string")))
    bucket = F.floor(F.conv(F.substring("order_key", 1, 8), 16, 10).cast("long") * F.col("buckets") / F.lit(float(1 << 32))).cast("long")
    m = m.join(_sent(plan, many), list(levels)).withColumn("order_key", order).withColumn("bucket", bucket)
    sums = m.groupBy(*levels, "bucket", "rest").agg(F.sum("_tokens").alias("t"))
    before = Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("start", F.sum("t").over(before) - F.col("t"))
    # The range in which the rest is reached: the first whose end is not below it.
    cut = sums.filter(F.col("start") + F.col("t") >= F.col("rest")).groupBy(*levels).agg(F.min(F.struct("bucket", "start")).alias("cut"))
    m = m.join(_sent(written(cut, "cuts"), many), list(levels), "left").withColumn("cut", F.when(F.col("rest") > 0, F.col("cut")))
    names = [*[F.col("_row")[c].alias(c) for c in docs.columns], "epoch", "take_tokens"]
    whole_to = F.col("epochs") + F.when(F.col("bucket") < F.col("cut.bucket"), 1).otherwise(0)
    whole = m.filter(whole_to > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), (whole_to - 1).cast("int")))).withColumn("take_tokens", F.col("_tokens"))
    # Places in the last range. Rows of one key, of which there may be any number, are numbered by the task that wrote
    # them; only how many a task has is summed up in their order.
    last = written(m.filter("bucket = cut.bucket").withColumn("task", F.spark_partition_id()), "last-ranges")
    same = [*levels, "order_key", "_tokens", "task"]
    inside = Window.partitionBy(*levels).orderBy("order_key", "_tokens", "task").rowsBetween(Window.unboundedPreceding, 0)
    groups = last.groupBy(*same).agg(F.sum("_tokens").alias("t")).withColumn("ahead", F.sum("t").over(inside) - F.col("t")).drop("t")
    nth = F.row_number().over(Window.partitionBy(*same).orderBy(F.xxhash64("_row"))) - 1
    last = last.withColumn("nth", nth).join(groups, same).withColumn("place", F.col("cut.start") + F.col("ahead") + F.col("nth") * F.col("_tokens"))
    last = last.filter("place < rest").withColumn("epoch", F.col("epochs")).withColumn("take_tokens", F.least(F.col("_tokens"), F.col("rest") - F.col("place")))
    return whole.select(*names).unionByName(last.select(*names))


def with_tree(docs: DataFrame) -> DataFrame:
    """The documents' columns for the tree and their tokens."""
    return docs.withColumns({"domain": domain_of(F.col("source")), "n_tokens": token_count(F.col("text"))})


def op5_hierarchical_mix(spark, sf_dir: str) -> DataFrame:
    """A null text has no tokens, a null lang or source counts as ''; repeated rows and null ids are taken as often as they are there."""
    docs = with_tree(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")).drop("text")
    docs = written(docs, "token-counts")  # words are counted once
    return mix(docs).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "take_tokens")


def _level_sql(name: str, source: str, parent: str, keys: list[str], up: list[str]) -> str:
    by = f"PARTITION BY {', '.join(up)} " if up else ""
    key = ", ".join(keys)
    join = f"JOIN {parent} p USING ({', '.join(up)})" if up else f"CROSS JOIN {parent} p"
    weight = "CASE concat_ws('/', " + key + ") " + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in WEIGHTS.items()) + " ELSE 1.0 END"
    return f"""{name}_n AS (SELECT {key}, CAST(sum(capacity) AS DOUBLE) AS capacity, CAST({weight} AS DOUBLE) AS weight FROM {source} GROUP BY {key}),
{name}_o AS (SELECT n.*, p.given AS given, capacity / weight AS ratio FROM {name}_n n {join}),
{name}_w AS (SELECT *, sum(capacity) OVER ({by}ORDER BY ratio, {keys[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - capacity AS before,
  sum(weight) OVER ({by}ORDER BY ratio, {keys[-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lft FROM {name}_o),
{name}_f AS (SELECT *, capacity * lft <= weight * (given - before) AS filled FROM {name}_w),
{name}_u AS (SELECT *, sum(CASE WHEN filled THEN capacity ELSE 0.0 END) OVER ({by}) AS used, sum(CASE WHEN filled THEN 0.0 ELSE weight END) OVER ({by}) AS opn FROM {name}_f),
{name} AS (SELECT {key}, greatest(CASE WHEN filled THEN capacity ELSE (given - used) * weight / opn END, 0.0) AS given FROM {name}_u)"""


OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN NOT regexp_full_match(coalesce(source, ''), 'src[0-9]{{1,6}}') THEN 'reference' WHEN CAST(substr(source, 4) AS INTEGER) < 10 THEN 'web' WHEN CAST(substr(source, 4) AS INTEGER) < 15 THEN 'books' ELSE 'reference' END AS domain,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents
), leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, sum(n_tokens) * {float(MAX_EPOCHS)} AS capacity FROM d GROUP BY ALL),
root AS (SELECT CAST(sum(tokens) AS DOUBLE) AS given FROM leaf),
{_level_sql("l1", "leaf", "root", ["domain"], [])},
{_level_sql("l2", "leaf", "l1", ["domain", "lang"], ["domain"])},
{_level_sql("l3", "leaf", "l2", ["domain", "lang", "source"], ["domain", "lang"])},
plan AS (SELECT domain, lang, source, tokens, CAST(floor(given + 1e-6) AS BIGINT) AS budget FROM leaf JOIN l3 USING (domain, lang, source)),
e AS (SELECT *, CASE WHEN tokens > 0 THEN CAST(budget // tokens AS INTEGER) ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN budget % tokens ELSE budget END AS rest FROM plan),
o AS (SELECT d.*, epochs, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws(':', '{SEED}', CAST(epochs AS VARCHAR), CAST(doc_id AS VARCHAR))), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS place FROM d JOIN e USING (domain, lang, source)),
taken AS (
  SELECT doc_id, domain, lang, source, CAST(unnest(range(epochs)) AS INTEGER) AS epoch, n_tokens, n_tokens AS take_tokens FROM o
  UNION ALL
  SELECT doc_id, domain, lang, source, epochs AS epoch, n_tokens, CAST(least(n_tokens, rest - place) AS BIGINT) AS take_tokens FROM o WHERE place < rest
)
SELECT * FROM taken
"""


def first_tokens(text: Column, n: Column) -> Column:
    """The text up to the end of its first n words, as ``token_count`` counts them."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"[\\x20\\x09-\\x0D]*{WORDS}"), F.lit(0)), F.lit(1), n.cast("int")), "")

"""The prefix trie of conversations: SQL ROLLUP over positional columns of turn ids.

One sorted pass cuts each conversation into blocks of ``WIDTH`` turns, a row with a column for each place. A block is
keyed by its node: the digest of all turns before it, so that blocks of one node have one history whatever their depth.
``GROUP BY block, node, ROLLUP (t1, ..., t8)`` then aggregates the prefixes of all lengths together, ``grouping_id``
telling a row's depth; long conversations need more rows, not more columns or passes.

A node is represented by its smallest member. Of one conversation, the nodes that it represents are the deepest ones of
its path, since groups only shrink on the way down. Sums over a subtree follow from that without walking it: they are
the totals of the nodes that its members represent, less what its own representative represents above it. So a second
ROLLUP adds up the members' totals, and nothing is done level by level.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.shared import written

#: Turns of a block: positional columns of the ROLLUP.
WIDTH = 8
#: The most turns that a conversation can take over from another.
MOST_HEAD = 8
ROOT = b""
TURN = pa.struct([("id", pa.binary()), ("words", pa.int64())])
NOTHING = hashlib.sha256(b"").hexdigest()


def _columns(width: int) -> list[str]:
    return [f"t{i + 1}" for i in range(width)]


def turn_id(role: str, text: str) -> bytes:
    """The 128-bit name of a turn."""
    role, text = role.encode(), text.encode()
    return hashlib.md5(b"%d:%b%b" % (len(role), role, text)).digest()


def blocks(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", width: int = WIDTH, base: Callable | None = None, head: Callable[[int], int] | None = None) -> DataFrame:
    """(c, k, node, t1..., last, end_key): a row for each block of each conversation, at least one a conversation.

    Turns are ordered by ``turn``, null first, then role and text; null roles and texts are empty, rows without
    conversation take no part, repeated rows are turns of their own. With ``base`` (the conversation, as a column of
    ``conv``, whose first turns a conversation takes over) and ``head`` (how many, of which its own are left out) the
    conversations are rebuilt so. One shuffle, by conversation or base; turns stream through in order, and no
    conversation is held, only a block of one and the few first turns of its base.
    """
    c = F.col(conv).cast("long")
    rows = turns.filter(F.col(conv).isNotNull()).select((base(c) if base else c).alias("b"), c.alias("c"), F.col(turn).alias("n"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = rows.repartition("b").sortWithinPartitions("b", F.col("c") != F.col("b"), "c", F.col("n").asc_nulls_first(), "r", "t").select("b", "c", "r", "t")
    names = _columns(width)
    schema = pa.schema([("c", pa.int64()), ("k", pa.int64()), ("node", pa.binary()), *[(n, TURN) for n in names], ("last", pa.bool_()), ("end_key", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, k, node, held, own, skip = None, 0, ROOT, [], 0, 0
        first_of, first = None, []  # the base whose first turns are at hand

        def emit(last: bool) -> bytes:
            key = hashlib.md5(node + b"".join(i for i, _ in held)).digest() if held else node
            out.append((now, k, node, *[{"id": i, "words": w} for i, w in held], *[None] * (width - len(held)), last, key if last else None))
            return key

        def ready() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return made

        for batch in batches:
            for b, c, r, t in zip(*(x.to_pylist() for x in batch.columns)):
                coming = []
                if c != now:
                    if now is not None:
                        emit(True)
                    now, k, node, held, own, skip = c, 0, ROOT, [], 0, 0
                    if c == b:
                        first_of, first = b, []
                    elif head:
                        skip = head(c)
                        if skip > MOST_HEAD:
                            raise ValueError(f"a conversation takes over {MOST_HEAD} turns at most")
                        coming = first[:skip] if first_of == b else []
                own += 1
                this = (turn_id(r, t), len(t.encode().split()))
                if c == b and len(first) < MOST_HEAD:
                    first.append(this)
                for x in [*coming, this] if own > skip else coming:
                    if len(held) == width:
                        node, k, held = emit(False), k + 1, []
                    held.append(x)
                if len(out) >= 8192:
                    yield ready()
        if now is not None:
            emit(True)
        if out:
            yield ready()

    kinds = ", ".join(["c long, k long, node binary", *[f"{n} struct<id: binary, words: long>" for n in names], "last boolean, end_key binary"])
    return rows.mapInArrow(cut, kinds)


def _rolled(cut: DataFrame, measures: str, width: int) -> DataFrame:
    """(k, node, depth, t1..., measures) of every prefix within its block; the empty one for the first block only."""
    cols = _columns(width)
    at = f"{width} - bit_count(grouping_id())"
    ended = " OR ".join(f"({at} = {j + 1} AND {c} IS NOT NULL)" for j, c in enumerate(cols))
    return cut.sparkSession.sql(f"SELECT k, node, {at} AS j, {', '.join(cols)}, {measures} FROM {{cut}} GROUP BY k, node, ROLLUP ({', '.join(cols)}) HAVING ({at} = 0 AND k = 0) OR {ended}", cut=cut)


def _key(width: int, upto: int = 0):
    """The digest of a prefix, or with ``upto`` = -1 of the prefix that is one turn shorter."""
    parts = [F.when(F.col("j") + upto > i, F.coalesce(F.col(c)["id"], F.lit(b""))).otherwise(F.lit(b"")) for i, c in enumerate(_columns(width))]
    return F.when(F.col("j") + upto > 0, F.unhex(F.md5(F.concat("node", *parts)))).when(F.col("j") + upto == 0, F.col("node"))


def _ends(cut: DataFrame) -> DataFrame:
    """(key, ends_sha256): the digest of the ids of the conversations that end at a node, in order.

    A digest is of its bytes in their order, so the ids of one node stream through one task; nothing of them is held.
    """
    rows = cut.filter("last").select(F.col("end_key").alias("key"), "c").repartition("key").sortWithinPartitions("key", "c")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["key", "ends_sha256"], [pa.binary(), pa.string()]
        now, h = None, None
        for batch in batches:
            out = []
            for key, c in zip(*(x.to_pylist() for x in batch.columns)):
                if key != now:
                    if h:
                        out.append((now, h.hexdigest()))
                    now, h = key, hashlib.sha256(b"%d" % c)
                else:
                    h.update(b",%d" % c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([now], kinds[0]), pa.array([h.hexdigest()], kinds[1])], names)

    return rows.mapInArrow(digest, "key binary, ends_sha256 string")


def trie(cut: DataFrame, width: int = WIDTH) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, key): a row a node of the ``blocks``, the root too.

    saved_tokens counts the words of a subtree's turns that a cache of prefixes wouldn't read again. Blocks and nodes
    are written to the shared folder, as each is met several times. Without conversations there are no nodes.
    """
    cut = written(cut, "blocks")
    n = _rolled(cut, "min(c) AS conv_id, count(*) AS n_convs", width)
    words = F.coalesce(*[F.when(F.col("j") == i + 1, F.col(c)["words"]) for i, c in enumerate(_columns(width))], F.lit(0).cast("long"))
    nodes = written(n.select(_key(width).alias("key"), _key(width, -1).alias("parent"), (F.col("k") * width + F.col("j")).alias("depth"), "conv_id", "n_convs", ((F.col("n_convs") - 1) * words).alias("saved")), "nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "key")
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    nodes = written(nodes, "nodes-with-children")

    totals = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved")).filter("leaves <> 0 OR saved <> 0")
    below = _rolled(cut.join(totals, "c"), "sum(leaves) AS leaves, sum(saved) AS saved", width)
    below = below.select(_key(width).alias("key"), F.col("leaves").alias("all_leaves"), F.col("saved").alias("all_saved"))
    above = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    out = nodes.withColumns({"_leaves": F.coalesce(F.sum("leaf").over(above), F.lit(0)), "_saved": F.coalesce(F.sum("saved").over(above), F.lit(0))})
    out = out.join(below, "key", "left").join(_ends(cut), "key", "left")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return out.join(parents, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.coalesce("all_leaves", F.lit(0)) - F.col("_leaves")).alias("n_leaves"), (F.coalesce("all_saved", F.lit(0)) - F.col("_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), F.hex("key").alias("key"),
    )


def head_of(c: int) -> int:
    return zlib.crc32(str(c).encode()) % 4


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """A row a node. Rows without conv_id take no part; turns of one number are in the order of role and text."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return trie(blocks(turns, base=lambda c: c - c % 20, head=head_of)).drop("key")


OP13_SQL = """
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT)] || CAST(range(8) AS BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS tab),
o AS (SELECT CAST(conv_id AS BIGINT) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, c - c % 20 AS b, list(x ORDER BY p) AS xs FROM o GROUP BY c),
h AS (SELECT own.*, xor(list_reduce([4294967295] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda a, s: xor(a >> 8, tab[(xor(a, s) & 255) + 1])), 4294967295) % 4 AS h FROM own, crc),
rb AS (SELECT h.c, coalesce(base.xs[:h.h], []) || h.xs[h.h + 1:] AS xs FROM h LEFT JOIN own AS base ON base.c = h.b),
m AS (SELECT c, d, xs[:d] AS path, len(xs) = d AS ends, CASE WHEN d > 0 THEN len(regexp_extract_all(xs[d].t, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS w FROM (SELECT c, xs, unnest(range(len(xs) + 1)) AS d FROM rb)),
n AS (SELECT d AS depth, path, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY d, path),
k AS (SELECT n.*, p.conv_id AS parent_conv_id FROM n LEFT JOIN n AS p ON p.depth = n.depth - 1 AND p.path = n.path[:n.depth - 1]),
l AS (SELECT k.*, coalesce(q.n_children, 0) AS n_children FROM k LEFT JOIN (SELECT parent_conv_id AS pc, depth - 1 AS pd, count(*) AS n_children FROM k WHERE depth > 0 GROUP BY ALL) AS q ON q.pc = k.conv_id AND q.pd = k.depth),
s AS (SELECT a.depth, a.path, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.w) AS saved_tokens FROM (SELECT n_children, n_convs, w, unnest(range(depth + 1)) AS ad, path FROM l) AS b JOIN l AS a ON a.depth = b.ad AND a.path = b.path[:b.ad] GROUP BY a.depth, a.path)
SELECT conv_id, CAST(l.depth AS BIGINT) AS depth, parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM l JOIN s ON s.depth = l.depth AND s.path = l.path
"""

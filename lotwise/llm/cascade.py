"""Quality rules as a short-circuit cascade; DataFrame functions only.

A rule rejects a text by an expression. What a rule costs and what it rejects is estimated on a sample; rules are then
ordered by rejection per cost, each next one counted on what those before it leave, and applied as one chain of
conditions: a text meets no rule behind the first that rejects it. The verdict is that of all rules in any order, so an
estimate changes how long the cascade takes and never what it keeps.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.shared import written

SPACE = r"[\x20\x09-\x0D]"
#: White space other than the end of a line.
BLANK = r"[\x20\x09\x0B-\x0D]"
#: Rows of the sample on which the order is estimated, about so many.
SAMPLE_ROWS = 2000
SEED = 20260722


def let(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then(x)`` with x taken once."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def n_repeat_words(words: Column) -> Column:
    """How many words stand in a three-word window that the text has twice or more.

    Windows are sorted as (leading bits of a hash, place) in one long each, so that equal ones are neighbours. Should
    neighbours of equal bits differ in their words, the windows themselves are sorted instead: the count is exact.
    """
    long = lambda x: F.lit(x).cast("long")
    shift = lambda name, x, b: F.call_function(name, x, b)

    def covered(places: Column) -> Column:
        """Words in the windows at ascending places."""
        return F.aggregate(F.transform(places, lambda x, k: F.least(F.coalesce(F.get(places, k + 1) - x, long(3)), long(3))), long(0), lambda a, x: a + x)

    def alike(i: Column, j: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.get(words, i + d) == F.get(words, j + d) for d in range(3)])

    def exact() -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.concat_ws(" ", *[F.get(words, i + d) for d in range(3)]).alias("g"), i.cast("long").alias("i")))
        own = lambda s, k: F.get(s, k)["g"]
        return let(F.sort_array(grams), lambda s: let(F.sort_array(F.transform(F.filter(s, lambda x, k: (x["g"] == own(s, k - 1)) | (x["g"] == own(s, k + 1))), lambda x: x["i"])), covered))

    def packed(bits: Column) -> Column:
        coded = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: shift("shiftleft", F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), bits).bitwiseOR(i.cast("long")))
        return let(F.sort_array(coded), lambda s: counted(s, bits))

    def counted(s: Column, bits: Column) -> Column:
        place = lambda x: x.bitwiseAND(shift("shiftleft", long(1), bits) - 1)
        alike_bits = lambda x, y: shift("shiftrightunsigned", x.bitwiseXOR(y), bits) == 0

        def of(d: Column) -> Column:
            mixed = F.exists(F.transform(d, lambda x, k: alike_bits(x, F.get(d, k + 1)) & ~alike(place(x).cast("int"), place(F.get(d, k + 1)).cast("int"))), lambda x: F.coalesce(x, F.lit(False)))
            return F.when(mixed, exact()).otherwise(let(F.sort_array(F.transform(d, place)), covered))

        first = F.exists(F.transform(s, lambda x, k: F.coalesce(alike_bits(x, F.get(s, k + 1)), F.lit(False))), lambda x: x)
        return F.when(~first, long(0)).otherwise(let(F.filter(s, lambda x, k: alike_bits(x, F.get(s, k - 1)) | alike_bits(x, F.get(s, k + 1))), of))

    return F.when(F.size(words) < 3, long(0)).otherwise(let(F.coalesce(F.ceil(F.log2(F.size(words) + F.lit(1.0))).cast("int"), F.lit(31)), packed))


def _lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def counts_of(text: Column, words: Column) -> dict[str, Column]:
    """What the rules look at, longs; ``lines`` has ``all`` lines with a word and those equal ``again`` to an earlier one. ``text`` isn't null."""
    big = lambda c: c.cast("long")
    lines = let(_lines(text), lambda x: F.struct(big(F.size(x)).alias("all"), big(F.size(x) - F.size(F.array_distinct(x))).alias("again")))
    return {
        "n_words": big(F.size(words)), "word_chars": big(F.char_length(F.array_join(words, ""))), "n_symbols": big(F.regexp_count(text, F.lit("[#*$%&|<>]"))),
        "n_repeat_words": n_repeat_words(words), "lines": lines,
    }


@dataclass(frozen=True)
class Rule:
    """``rejects(text, words, count)``: true for texts that go; ``count(name)`` is one of ``counts_of``."""

    name: str
    rejects: Callable[[Column, Column, Callable[[str], Column]], Column]


#: The rules that every kept text has passed. The first two are those of ``base_failed``.
RULES = (
    Rule("few_words", lambda t, w, n: n("n_words") < 50),
    Rule("repeated_windows", lambda t, w, n: 100 * n("n_repeat_words") > 50 * n("n_words")),
    Rule("word_length", lambda t, w, n: (n("word_chars") < 2 * n("n_words")) | (n("word_chars") > 12 * n("n_words"))),
    Rule("symbols", lambda t, w, n: 10 * n("n_symbols") > n("n_words")),
    Rule("duplicate_lines", lambda t, w, n: 10 * n("lines")["again"] > 3 * n("lines")["all"]),
    Rule("shouting", lambda t, w, n: 10 * F.regexp_count(t, F.lit(r"\p{Lu}")) > 3 * n("word_chars")),
    Rule("exclamations", lambda t, w, n: 10 * F.regexp_count(t, F.lit("[!?]")) > 3 * n("n_words")),
    Rule("words_without_letters", lambda t, w, n: 10 * F.regexp_count(t, F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])")) > 3 * n("n_words")),
    Rule("list_marks", lambda t, w, n: 10 * F.regexp_count(t, F.lit(rf"(?:\A|\n){BLANK}*+[-*\x{{2022}}]")) > 9 * n("lines")["all"]),
    Rule("ellipses", lambda t, w, n: 10 * F.regexp_count(t, F.lit(rf"(?:\.\.\.|\x{{2026}}){BLANK}*+(?:\n|\z)")) > 3 * n("lines")["all"]),
)


@dataclass(frozen=True)
class Estimate:
    """Of a rule, on the sample: nanoseconds a text, and the share that it rejects of what the rules before it leave."""

    name: str
    cost: float
    rejected: float


def _conditions(rules: Sequence[Rule], text: Column, words: Column, counted: Mapping[str, Column]) -> dict[str, Column]:
    return {r.name: F.coalesce(r.rejects(text, words, counted.__getitem__), F.lit(False)) for r in rules}


def ranked(costs: Mapping[str, float], patterns: Sequence[tuple[frozenset, int]]) -> list[Estimate]:
    """Rules by rejection per cost, each next one on what those before it leave; of equal ones the cheaper, then the first by name.

    ``patterns``: (the rules that reject a text, how many such texts).
    """
    out, left, todo = [], list(patterns), dict(costs)
    while todo:
        rows = sum(n for _, n in left)
        share = {r: sum(n for p, n in left if r in p) / rows if rows else 0.0 for r in todo}
        best = min(todo, key=lambda r: (-share[r] / todo[r], todo[r], r))
        out.append(Estimate(best, todo.pop(best), share[best]))
        left = [(p, n) for p, n in left if best not in p]
    return out


def estimated(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = SEED, runs: int = 2) -> list[Estimate]:
    """The rules in the order in which they are to be applied, by a sample of about ``sample_rows`` texts.

    A rule's cost is the least of some runs over the sample less a run that looks at nothing. The sample's patterns of
    rejections, at most a row for each of its texts, come to the driver. An empty table keeps the rules as they are
    but for their names: all cost the same and reject nothing.
    """
    rows = docs.count()
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    some = written(docs.select(t.alias("t")).sample(min(1.0, sample_rows / max(rows, 1)), seed).limit(2 * sample_rows), "rule-sample").select("t", words_of(F.col("t")).alias("w")).persist()
    conditions = _conditions(rules, F.col("t"), F.col("w"), counts_of(F.col("t"), F.col("w")))

    def seconds(c: Column) -> float:
        least = float("inf")
        for _ in range(runs):
            began = time.perf_counter()
            some.agg(F.count_if(c)).collect()
            least = min(least, time.perf_counter() - began)
        return least

    texts = some.count()
    nothing = seconds(F.col("t").isNull())
    costs = {name: max(seconds(c) - nothing, 1e-4) / max(texts, 1) * 1e9 for name, c in conditions.items()}
    by = some.select(F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]), lambda x: x.isNotNull()).alias("p")).groupBy("p").count()
    patterns = [(frozenset(r["p"]), r["count"]) for r in by.collect()]
    some.unpersist()
    return ranked(costs, patterns)


def first_rejection(text: Column, words: Column, order: Sequence[str], rules: Sequence[Rule] = RULES, counted: Mapping[str, Column] | None = None) -> Column:
    """The name of the first rule in ``order`` that rejects, null if none does: later ones aren't looked at."""
    conditions = _conditions(rules, text, words, counted or counts_of(text, words))
    if sorted(order) != sorted(conditions):
        raise ValueError("an order names each rule once")
    return reduce(lambda c, name: c.when(conditions[name], name), order[1:], F.when(conditions[order[0]], order[0]))


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, order: Sequence[str] | None = None, text: str = "text", out: str = "rejected_by") -> DataFrame:
    """``docs`` with the rule that rejects each row, null for rows to keep. Narrow: no shuffle.

    Null texts are empty, and an empty text has few words; repeated rows fare alike, null keys are no matter, and a
    column named ``out`` is replaced. Without ``order`` it is estimated on ``docs``. Any order keeps the same rows;
    which of several rules is named depends on it.
    """
    order = order or [e.name for e in estimated(docs, rules, text)]
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    verdict = let(t, lambda t: let(words_of(t), lambda w: first_rejection(t, w, order, rules)))
    return docs.withColumn(out, verdict)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_repeat_words")
OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op12_rule_cascade(spark, sf_dir: str) -> DataFrame:
    """(doc_id, the five counts, base_failed, kept), a row a document; null texts are empty, repeated rows and null ids have their rows.

    The counts are asked of every document, so the rules read them; the others run up to the first that rejects.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    order = [e.name for e in estimated(docs)]
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).withColumn("w", words_of(F.col("t")))
    base = base.select("doc_id", "t", *[c.alias(n) for n, c in counts_of(F.col("t"), F.col("w")).items()])
    counted = {n: F.col(n) for n in (*COUNTS, "lines")} | {"n_dup_lines": F.col("lines")["again"]}
    failed = (counted["n_words"] < 50) | (100 * counted["n_repeat_words"] > 50 * counted["n_words"])
    return base.select("doc_id", *[counted[n].alias(n) for n in OUT], failed.alias("base_failed"), first_rejection(F.col("t"), F.lit(None), order, RULES, counted).isNull().alias("kept"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM b WHERE len(w) >= 3),
g2 AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS k FROM g),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g2 WHERE k > 1) GROUP BY r),
c AS (SELECT b.r, doc_id, t, w, lines, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM b LEFT JOIN rep ON b.r = rep.r),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * len(lines)
    OR 10 * len(regexp_extract_all(t, '\p{Lu}')) > 3 * word_chars OR 10 * len(regexp_extract_all(t, '[!?]')) > 3 * n_words
    OR 10 * len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{L}'))) > 3 * n_words
    OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{2022}]'))) > 9 * len(lines)
    OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$'))) > 3 * len(lines)) AS kept
FROM v
"""

"""Quality by nearest-neighbour voting: documents and labelled examples as latent-semantic vectors, exact cosines.

Terms are hashed: lower-cased words, the shapes of words (runs of small letters, capitals, digits, other signs) and
pairs of shapes that follow each other. The basis is the truncated singular value decomposition of the tf-idf matrix
of a bounded sample of labelled training documents, document frequencies being those of all; the sample's vectors are broadcast, and each task computes the
cosines of its documents with all of them in blocks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.bytestext import Words, mixed, segment_hashes, steps

#: Hash bits of words, shapes and shape pairs.
WORD_BITS, SHAPE_BITS = 13, 11
TERMS = (1 << WORD_BITS) + 2 * (1 << SHAPE_BITS)

# Classes of bytes for shapes: small letters, capitals, digits, other bytes of letters beyond ASCII; the rest stand for themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 97, 65, 48, 97


@dataclass(frozen=True)
class Settings:
    """max_examples bounds the labelled documents whose terms are read to the driver (those with the least hashes of
    their ids, over all sources alike), and max_example_bytes the sum of their texts."""

    max_examples: int = 6000
    max_example_bytes: int = 64 << 20
    dimensions: int = 48
    neighbours: int = 25
    power: float = 8.0
    block: int = 512
    seed: int = 7


def _shapes(words: Words, raw: np.ndarray) -> np.ndarray:
    """A hash of each word's shape: its byte classes without repeats."""
    kind = _CLASS[raw]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[words.start] = True
    at = np.concatenate(([0], np.cumsum(new)))
    return segment_hashes(kind[new], at[words.start], at[words.end])


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, occurrences), by row and term."""
    from lotwise.llm.bytestext import buffers

    words = Words(column)
    raw, _ = buffers(column)
    if not len(words.start):
        return (np.zeros(0, np.int64),) * 3
    h = words.hashes()
    s = _shapes(words, raw)
    pair = mixed(s[:-1] * np.uint64(31) ^ s[1:])
    same = words.row[1:] == words.row[:-1]
    base = 1 << WORD_BITS
    term = np.concatenate([
        (h >> np.uint64(64 - WORD_BITS)).astype(np.int64),
        base + (s >> np.uint64(64 - SHAPE_BITS)).astype(np.int64),
        base + (1 << SHAPE_BITS) + (pair[same] >> np.uint64(64 - SHAPE_BITS)).astype(np.int64),
    ])
    row = np.concatenate([words.row, words.row, words.row[1:][same]])
    key = np.sort(row * TERMS + term)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first] // TERMS, key[first] % TERMS, np.diff(np.append(first, len(key)))


def _projected(column: pa.Array, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit vectors of each row; zero for a text without words."""
    row, term, n = terms_of(column)
    out = np.zeros((len(column), basis.shape[1]), np.float32)
    if len(row):
        weight = ((1 + np.log(n)) * idf[term]).astype(np.float32)
        for at in range(0, len(row), 65536):
            p = slice(at, at + 65536)
            part = basis[term[p]] * weight[p, None]
            first = np.flatnonzero(np.concatenate(([True], row[p][1:] != row[p][:-1])))
            out[row[p][first]] += np.add.reduceat(part, first, axis=0)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0)


@dataclass(frozen=True)
class Voter:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    settings: Settings

    def scores(self, column: pa.Array) -> np.ndarray:
        """The similarity-weighted share of label 1 among the nearest examples, exact over all of them."""
        own = _projected(column, self.idf, self.basis)
        out = np.full(len(own), self.prior)
        k = min(self.settings.neighbours, len(self.vectors))
        for at in range(0, len(own), self.settings.block):
            x = own[at : at + self.settings.block]
            cosine = x @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < cosine.shape[1] else np.tile(np.arange(k), (len(x), 1))
            w = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** self.settings.power
            total = w.sum(axis=1)
            some = (total > 0) & (np.abs(x).sum(axis=1) > 0)
            vote = (w * self.labels[near]).sum(axis=1)
            out[at : at + len(x)][some] = vote[some] / total[some]
        return np.clip(out, 0.0, 1.0)


def _emit_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in steps(batches, "t"):
        row, term, n = terms_of(b.column(2))
        offs = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
        lists = pa.ListArray.from_arrays
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(offs, pa.array(term, pa.int16())), lists(offs, pa.array(n, pa.int32()))], ["h", "y", "term", "n"])


def _emit_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each term of the task's texts, and one, under TERMS, with how many texts these were."""
    df, texts = np.zeros(TERMS, np.int64), 0
    for b in steps(batches, "t"):
        df += np.bincount(terms_of(b.column(0))[1], minlength=TERMS)
        texts += b.num_rows
    own = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(own, TERMS), pa.int32()), pa.array(np.append(df[own], texts))], ["term", "df"])


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """(how many texts ``docs`` has, in how many of them each term occurs), from one pass over all of them.

    The driver gets one number a term; a task sends that many at most.
    """
    got = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(_emit_frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(TERMS + 1, np.int64)
    out[got.column("term").to_numpy()] = got.column("df").to_numpy()
    return int(out[TERMS]), out[:TERMS]


def _chosen(keys: DataFrame, settings: Settings) -> list[tuple[int, int, int]]:
    """(h, c, y) of the examples to take of keys(h, c, n, y): those with the least h, passing over any that no longer fits the bytes."""
    one = keys.groupBy("h").agg(F.min(F.struct("c", "n", "y")).alias("x"))  # repeated rows are one example
    got = one.select("h", "x.c", "x.n", "x.y").orderBy("h").limit(settings.max_examples).collect()
    out, left = [], settings.max_example_bytes
    for h, c, n, y in got:
        if n <= left:
            out.append((h, c, y))
            left -= n
    return out


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", settings: Settings = Settings(), corpus: DataFrame | None = None) -> Voter | None:
    """Fits on at most ``max_examples`` of ``docs`` that have a row in ``labels(key, label)``; None where there is none.

    The examples with the least hashes of their keys are taken, while their texts are at most ``max_example_bytes``
    together; a text that no longer fits is passed over. So they are the same ones on every run, whatever the
    partitions. Rows whose label is neither 0 nor 1 and null keys take no part; of a key's repeated rows one does.
    Document frequencies are those of all of ``corpus`` (if None, of ``docs``). Sizes and hashes are taken before
    the labels are joined, so no text is shuffled; of the chosen texts the driver gets numbered terms only.
    """
    spark = docs.sparkSession
    hashed = F.xxhash64(F.col(key), F.lit(settings.seed))
    content = F.xxhash64(F.col(text).cast("string"))
    sizes = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), hashed.alias("h"), content.alias("c"), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n"))
    marks = labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("label_k"), F.col(label).cast("int").alias("y"))
    chosen = _chosen(sizes.join(marks, F.col("k") == F.col("label_k")).select("h", "c", "n", "y"), settings)
    if not chosen:
        return None
    wanted = F.broadcast(spark.createDataFrame(chosen, "h long, c long, y int"))  # max_examples rows at most
    texts = docs.select(hashed.alias("h"), content.alias("c"), F.col(text).cast("string").alias("t")).join(wanted, ["h", "c"])
    found = texts.select("h", "y", "t").mapInArrow(_emit_terms, "h long, y int, term array<short>, n array<int>")
    got = found.groupBy("h").agg(F.first("y").alias("y"), F.first("term").alias("term"), F.first("n").alias("n")).orderBy("h").toArrow()
    files, df = document_frequencies(docs if corpus is None else corpus, text)
    return _voter(got, files, df, settings)


def _voter(got: pa.Table, files: int, df: np.ndarray, settings: Settings) -> Voter:
    labels = got.column("y").to_numpy().astype(np.float64)
    size = pc.list_value_length(got.column("term")).to_numpy().astype(np.int64)
    term = pc.list_flatten(got.column("term")).to_numpy()
    idf = (np.log((1 + files) / (1 + df)) + 1).astype(np.float32)
    weight = (1 + np.log(pc.list_flatten(got.column("n")).to_numpy(), dtype=np.float32)) * idf[term]
    offs = np.concatenate(([0], np.cumsum(size)))
    if not len(term):  # no example has a word: every score is the share of label 1
        return Voter(idf, np.zeros((TERMS, 1), np.float32), np.zeros((len(size), 1), np.float32), labels, float(labels.mean()), settings)
    matrix = _Rows(offs, term, weight)
    basis = _basis(matrix, settings)
    vectors = np.concatenate([x @ basis for x in matrix])
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Voter(idf, basis, np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0), labels, float(labels.mean()), settings)


class _Rows:
    """Sparse rows, given as dense blocks of some rows of unit length at a time: the only dense copy that there is."""

    def __init__(self, offs: np.ndarray, term: np.ndarray, weight: np.ndarray, block: int = 256):
        self.offs, self.term, self.weight, self.block = offs, term, weight, block

    def __iter__(self) -> Iterator[np.ndarray]:
        for at in range(0, len(self.offs) - 1, self.block):
            o = self.offs[at : at + self.block + 1]
            x = np.zeros((len(o) - 1, TERMS), np.float32)
            x[np.repeat(np.arange(len(x)), np.diff(o)), self.term[o[0] : o[-1]]] = self.weight[o[0] : o[-1]]
            length = np.linalg.norm(x, axis=1, keepdims=True)
            yield np.divide(x, length, out=x, where=length > 0)


def _basis(rows: _Rows, settings: Settings) -> np.ndarray:
    """The leading right singular vectors of the rows, by subspace iteration from a seeded start."""
    k = min(settings.dimensions, len(rows.offs) - 1, TERMS)
    q = np.random.default_rng(settings.seed).standard_normal((TERMS, k)).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(q)
        back = np.zeros_like(q)
        for x in rows:
            back += x.T @ (x @ q)
        q = back
    q, _ = np.linalg.qr(q)
    _, _, vt = np.linalg.svd(np.concatenate([x @ q for x in rows]), full_matrices=False)
    return np.ascontiguousarray((q @ vt.T).astype(np.float32))


def classify(docs: DataFrame, voter: Voter | None, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of every row and ``score``: the chance of label 1 by the whole text.

    Texts that are null, empty or like no example get the share of label 1 among the examples; with no examples at
    all every score is 0.5. One narrow pass: no shuffle.
    """
    spark = docs.sparkSession
    if voter is None:
        return docs.select(*columns, F.lit(0.5).alias("score"))
    shared = spark.sparkContext.broadcast(pickle.dumps(voter))
    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        for b in steps(batches, "t"):
            out = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(model.scores(b.column(b.num_columns - 1)))], [*b.schema.names[:-1], "score"])

    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, f"{kinds}, score double").toDF(*columns, "score")


def held_out_part(key: str = "doc_id"):
    """The rows that no label is learnt from; a null key is none of them."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def fit_quality(spark, docs: DataFrame, sf_dir: str, settings: Settings = Settings()) -> Voter | None:
    """The quality model of the documents' labels, but for the held-out part; term statistics are those of all ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return fit(docs.filter(~held_out_part()), labels, "text", "quality", "doc_id", settings, corpus=docs)


#: Scores from here on are label 1.
THRESHOLD = 0.7


def op8_neighbour_quality(spark, sf_dir: str) -> DataFrame:
    """A row a document: null and empty texts have the share of label 1 among the examples; a null doc_id is not held out and teaches nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", held_out_part())
    scored = classify(docs, fit_quality(spark, docs.select("doc_id", "text"), sf_dir), ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

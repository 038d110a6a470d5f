"""I-Match document fingerprints (operator 4).

A text's terms whose inverse document frequency lies in a band are kept, made distinct,
sorted and hashed, once for each of several random subsets of the lexicon: near copies
then agree on the subsets that hold none of the terms in which they differ.

The lexicon of the band is broadcast. A term of it stands in at least N * exp(-HIGH_IDF)
texts, so there are at most (mean distinct terms of a text) * exp(HIGH_IDF) of them,
however large the corpus; beyond LEXICON_BYTES the terms are joined instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm import kernels as K
from loomtext.llm.shared import materialise, table, text_key

#: Terms in 0.1 to 2 per cent of the texts.
LOW_IDF = float(np.log(50))
HIGH_IDF = float(np.log(1000))
SUBSETS = 8
#: A term is in a subset with chance 2 / 3.
DROP = 3
#: A subset of a text's terms with fewer than this has no fingerprint.
LEAST_TERMS = 3
LEXICON_BYTES = 32 << 20

_STEP = np.uint64(0x9DDFEA08EB382D69)


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The text and hash of each of its distinct terms, sorted by both."""
    buf, starts, ends, counts = K.words(texts)
    h = K.span_hashes(buf, starts, ends)
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in K.slices(batch.column(0)):
            owner, h = _terms(batch.column(0).slice(i, j - i))
            term, n = np.unique(h, return_counts=True)
            # Term 0 counts the texts that have a word.
            term, n = np.r_[np.uint64(0), term], np.r_[len(np.unique(owner)), n]
            yield pa.record_batch([pa.array(term.view(np.int64)), pa.array(n, pa.int64())], ["term", "n"])


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, n): in how many texts each term stands, by its hash; the term 0 has the number of texts with words."""
    return docs.where("text IS NOT NULL").select(F.col("text").cast("string").alias("text")).mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _hash_terms(owner: np.ndarray, h: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts, SUBSETS) fingerprints, and whether each is there; owner and h are sorted."""
    out, there = np.zeros((texts, SUBSETS), np.uint64), np.zeros((texts, SUBSETS), bool)
    for k in range(SUBSETS):
        use = K.mix(h + np.uint64(K.mix_int(k + 1))) % np.uint64(DROP) != 0
        o, x = owner[use], h[use]
        n = np.bincount(o, minlength=texts)
        place = np.arange(len(o)) - np.repeat(np.cumsum(n) - n, n)
        power = np.cumprod(np.r_[np.uint64(1), np.full(int(n.max(initial=0)), _STEP, np.uint64)], dtype=np.uint64)
        upto = np.r_[np.uint64(0), np.cumsum(x * power[place], dtype=np.uint64)]
        ends = np.cumsum(n)
        out[:, k] = K.mix(upto[ends] - upto[ends - n] + n.astype(np.uint64))
        there[:, k] = n >= LEAST_TERMS
    return out, there


def _as_lists(out: np.ndarray, there: np.ndarray) -> pa.Array:
    flat = pa.array(out.view(np.int64).reshape(-1), mask=~there.reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * SUBSETS, pa.int32()), flat)


PRINTS = T.StructType([T.StructField("terms", T.IntegerType()), T.StructField("prints", T.ArrayType(T.LongType()))])


def _printer(lexicon):
    def run(texts: pa.Array) -> pa.Array:
        known = np.frombuffer(lexicon.value, np.uint64)
        found = []
        for i, j in K.slices(texts):
            owner, h = _terms(texts.slice(i, j - i))
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            use = known[at] == h if len(known) else np.zeros(len(h), bool)
            out, there = _hash_terms(owner[use], h[use], j - i)
            found.append(pa.StructArray.from_arrays([pa.array(np.bincount(owner[use], minlength=j - i), pa.int32()), _as_lists(out, there)], ["terms", "prints"]))
        empty = pa.array([], pa.struct([("terms", pa.int32()), ("prints", pa.list_(pa.int64()))]))
        return pa.concat_arrays(found) if found else empty

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in K.slices(batch.column(1)):
            owner, h = _terms(batch.column(1).slice(i, j - i))
            yield pa.record_batch([batch.column(0).slice(i, j - i).take(pa.array(owner)), pa.array(h.view(np.int64))], ["row", "term"])


def _print_lists(lists: pa.Array) -> pa.Array:
    counts = np.array([len(x) for x in lists.to_pylist()], np.int64)
    owner, h = np.repeat(np.arange(len(counts)), counts), lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    order = np.lexsort((h, owner))
    out, there = _hash_terms(owner[order], h[order], len(counts))
    return pa.StructArray.from_arrays([pa.array(counts, pa.int32()), _as_lists(out, there)], ["terms", "prints"])


def fingerprints(docs: DataFrame, low: float = LOW_IDF, high: float = HIGH_IDF, lexicon_bytes: int = LEXICON_BYTES) -> DataFrame:
    """(doc_id, terms, fingerprints) of every row: how many terms of the band, and SUBSETS hashes.

    A hash is null where its subset leaves fewer than LEAST_TERMS terms; so are all hashes of
    null, empty and wordless texts. Document frequencies count every row with a word, repeated
    rows each; equal texts get equal fingerprints, and a term whose frequency ties with an end
    of the band is in it. Very long texts are read whole, in slices of their own. A null
    doc_id stays null. An empty table gives no rows. Columns besides doc_id and text are not
    read.
    """
    spark = docs.sparkSession
    counts = materialise(document_frequencies(docs))
    first = counts.where("term = 0").first()
    total = int(first["n"]) if first else 0
    idf = F.log(F.lit(float(max(total, 1))) / F.col("n"))
    band = materialise(counts.where("term != 0").where((idf >= low) & (idf <= high)).select("term"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if band.count() * 8 <= lexicon_bytes:
        known = np.sort(np.array([r[0] for r in band.toLocalIterator()], np.int64).view(np.uint64))
        lexicon = spark.sparkContext.broadcast(known.tobytes())
        return slim.select("doc_id", F.arrow_udf(_printer(lexicon), PRINTS)("text").alias("p")).select("doc_id", "p.terms", F.col("p.prints").alias("fingerprints"))
    keyed = slim.withColumn("row", text_key(F.col("text")))
    terms = keyed.where("text IS NOT NULL").select("row", "text").dropDuplicates(["row"]).mapInArrow(_exploded, "row binary, term long").join(band, "term", "left_semi")
    lists = terms.groupBy("row").agg(F.collect_list("term").alias("terms"))
    joined = keyed.select("doc_id", "row").join(lists, "row", "left")
    return joined.select("doc_id", F.arrow_udf(_print_lists, PRINTS)(F.coalesce("terms", F.array().cast("array<bigint>"))).alias("p")).select("doc_id", "p.terms", F.col("p.prints").alias("fingerprints"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op4_imatch_fingerprints": op4}
SQL: dict[str, str] = {}

"""BM25 expressions: terms, term hashing, inverse document frequency, saturation."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMS = 65536
LONGEST_TERM = 127
#: ln 2, the weight of a term that no statistics know.
UNSEEN_IDF = math.log(2)
#: English words that carry no topic; by length.
STOPWORDS = tuple(
    (
        "whether neither through further should before during either "
        "being could after while would ought shall above below again might under "
        "used then been down were both does dare once with need into have will over from "
        "yet had did may and are but not out for has off was the can nor "
        "in is of on or so to up an as at be by do if a"
    ).split()
)

_NOT_LETTERS = re.compile("[^A-Za-z]+")


def tokens(text: Column) -> Column:
    """All terms of a text in order, repeats included: runs of ASCII letters in lower case, less stop words."""
    # Lower-casing comes last: it turns some letters beyond ASCII into ASCII ones.
    words = F.split(F.lower(F.regexp_replace(text, "[^A-Za-z]+", " ")), " ")
    return F.filter(words, lambda w: (w != "") & (F.length(w) <= LONGEST_TERM) & ~w.isin(*STOPWORDS))


def tokenize(text: Column) -> Column:
    """The distinct terms in the order of their first occurrence."""
    return F.array_distinct(tokens(text))


def query_terms(query: str) -> list[str]:
    """tokenize() for a query on the driver."""
    words = _NOT_LETTERS.sub(" ", query).lower().split()
    return list(dict.fromkeys(w for w in words if len(w) <= LONGEST_TERM and w not in STOPWORDS))


def dim_of(term: str) -> int:
    h = 5381
    for byte in term.encode():
        h = (h * 33 & 0xFFFFFFFF) ^ byte
    return h % DIMS + 1


def term_dim(term: Column) -> Column:
    """Dimension of a term of ASCII letters, 1 to 65,536."""
    codes = F.transform(F.split(term, ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, c: (h * F.lit(33)).bitwiseAND(F.lit(4294967295)).bitwiseXOR(c)
    return (F.aggregate(codes, F.lit(5381).cast("long"), step) % DIMS + 1).cast("int")


def idf(n: Column, df: Column) -> Column:
    """ln(1 + (n - df + 0.5) / (df + 0.5)); 0 for df <= 0, ln 2 for an unknown df."""
    # A df beyond n tells that n is out of date.
    n, df = F.greatest(n, df).cast("double"), df.cast("double")
    known = F.when(df <= 0, F.lit(0.0)).otherwise(F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5))))
    return F.when(df.isNull(), F.lit(UNSEEN_IDF)).otherwise(known)


def weight(idf_: Column, tf: Column, length: Column, average: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """Saturated term weight; 0 where its denominator isn't positive."""
    tf, length = tf.cast("double"), length.cast("double")
    average = F.when(average > 0, average.cast("double")).otherwise(F.lit(1.0))
    below = tf + F.lit(float(k1)) * (F.lit(1.0 - b) + F.lit(float(b)) * length / average)
    return F.when(below <= 0, F.lit(0.0)).otherwise(idf_ * tf * F.lit(k1 + 1.0) / below)


def sparse_text(entries: Column) -> Column:
    """{dim:weight,...}/65536 of an array of (dim, w) structs, by dimension, six decimals."""
    spelled = F.transform(F.array_sort(entries), lambda e: F.format_string("%d:%.6f", e["dim"], e["w"]))
    return F.concat(F.lit("{"), F.array_join(spelled, ","), F.lit("}/65536"))

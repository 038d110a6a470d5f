"""Quality rules as weak supervision (operator 8).

Each rule votes good, votes bad or abstains on a text, and is silent on texts too short for
it. The rules overlap and err: a kind of junk moves several measures, and good texts cross
some thresholds. Expectation-maximisation over the counts of vote patterns estimates, for
good and bad texts, how often each rule votes either way and abstains; the posterior of
good quality decides, not the number of rules passed. There are at most 4 ** len(RULES)
patterns, however many documents, so what reaches the driver doesn't grow with the corpus.

EM starts from the share of good votes among the votes of a pattern. What makes one class
the good one is a Dirichlet prior that weighs as PRIOR_WEIGHT of the rows: without it, on a
table with no junk at all, EM parts the good texts in two and rejects 7 % of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm import kernels as K
from loomtext.llm.shared import materialise, table

BAD, ABSTAIN, GOOD, SILENT = 0, 1, 2, 3
VOTES = 4
#: Documents whose posterior of good quality is under this are rejected.
KEEP_FROM = 0.5
#: How a rule is taken to vote (bad, abstain, good) on bad and on good texts before any is seen; these
#: rates weigh as many rows as PRIOR_ROWS and this share of all rows.
PRIOR_BAD, PRIOR_GOOD = (0.4, 0.2, 0.4), (0.02, 0.08, 0.9)
PRIOR_WEIGHT = 0.02
PRIOR_ROWS = 1.0
#: The share of good texts before any is seen, as so many good and bad rows.
PRIOR_SHARE = (9.0, 1.0)
ROUNDS = 500
TOLERANCE = 1e-10

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_LETTER = _UPPER | _LOWER
_LETTER[128:] = True
#: What a plain word is made of.
_PLAIN = _LETTER.copy()
_PLAIN[[ord("'"), ord("-")]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+<=>@^_`{|}~\\"]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[ord(c) for c in ".,;:?!"]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".?!"]] = True
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32

#: Frequent words of four languages; prose is full of them.
FUNCTION_WORDS = (
    "the of and to in is that it for was on as with be by at this are from or an a not have "
    "der die das und den von zu ist mit im ein eine auf für nicht sich des dem als auch es "
    "le la les de du et un une que qui en pour dans est sur pas au il elle se ne ce plus par "
    "el los las y con una no su lo del al como más pero"
).split()

#: Name of each rule, its measure, bad from, good from, and the words that a text needs for it to speak.
#: Bad and good lie beyond thresholds on either side of the measure, or outside and inside ranges.
RULES: tuple[tuple[str, str, float | tuple[float, float], float | tuple[float, float], int], ...] = (
    ("symbols", "symbol_share", 0.02, 0.003, 5),
    ("plain_words", "plain_share", 0.80, 0.96, 15),
    ("function_words", "function_share", 0.20, 0.23, 40),
    ("sentence_ends", "end_share", (0.04, 0.25), (0.055, 0.16), 40),
    ("word_length", "word_length", (4.5, 6.2), (4.7, 5.8), 40),
    ("stutter", "stutter_share", 0.06, 0.02, 15),
    ("vocabulary", "repeat_share", 0.42, 0.33, 40),
    ("capitals", "upper_share", 0.10, 0.03, 15),
    ("exclamations", "bang_share", 0.05, 0.005, 5),
    ("repeated_lines", "line_share", 0.15, 0.0, 40),
)


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many distinct hashes each text has."""
    # The text above, 40 bits of the hash below: one sort of plain integers finds the distinct ones.
    keys = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[new] >> np.uint64(40)).astype(np.int64), minlength=n)


def _function_hashes() -> np.ndarray:
    buf, off = K.raw(pa.array(FUNCTION_WORDS))
    return np.unique(K.span_hashes(buf, off[:-1], off[1:]))


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """What the rules look at, per text; words are what blanks part. All 0 for a text without words."""
    buf, off = K.raw(texts)
    n = len(off) - 1
    solid = ~_SPACE[buf]
    starts, ends, counts = K.spans(solid, off)
    owner = np.repeat(np.arange(n), counts)
    words = np.maximum(counts, 1)
    last = buf[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    #: A word less one closing mark.
    core = ends - _CLOSE[last]

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(owner[flags], minlength=n) / words

    def upto(inside: np.ndarray) -> np.ndarray:
        return np.r_[0, np.cumsum(inside, dtype=np.int32)]

    def per_text(c: np.ndarray) -> np.ndarray:
        return c[off[1:]] - c[off[:-1]]

    symbol, upper, lower, inked = upto(_SYMBOL[buf]), upto(_UPPER[buf]), upto(_LOWER[buf]), upto(solid)
    plain = upto(_PLAIN[buf])
    heads = upto(solid & ((buf & 0xC0) != 0x80))
    hashes = K.span_hashes(_TO_LOWER[buf], starts, core)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    line_starts, line_ends, lines = K.spans(buf != 10, off)
    line_owner = np.repeat(np.arange(n), lines)
    distinct_lines = _distinct(line_owner, K.span_hashes(buf, line_starts, line_ends), n)
    return {
        "words": counts.astype(np.float64),
        "symbol_share": per_text(symbol) / np.maximum(per_text(inked), 1),
        "plain_share": share((plain[core] - plain[starts] == core - starts) & (core > starts)),
        "function_share": share(np.isin(hashes, _function_hashes())),
        "end_share": share(_END[last]),
        "word_length": per_text(heads) / words,
        "stutter_share": share(same),
        "repeat_share": np.where(counts > 0, 1 - _distinct(owner, hashes, n) / words, 0.0),
        "upper_share": per_text(upper) / np.maximum(per_text(upper) + per_text(lower), 1),
        "bang_share": share((last == ord("!")) & (ends - starts > 1)),
        "line_share": np.where(lines > 0, 1 - distinct_lines / np.maximum(lines, 1), 0.0),
    }


def votes(texts: pa.Array) -> np.ndarray:
    """A row of BAD, ABSTAIN, GOOD or SILENT by rule for each text; all silent on null, empty and blank texts."""
    found = measures(texts)
    out = np.full((len(texts), len(RULES)), ABSTAIN, np.int8)
    for r, (_, measure, bad, good, least) in enumerate(RULES):
        x = found[measure]
        if isinstance(bad, tuple):
            is_bad, is_good = (x < bad[0]) | (x > bad[1]), (x >= good[0]) & (x <= good[1])
        elif bad > good:
            is_bad, is_good = x >= bad, x <= good
        else:
            is_bad, is_good = x <= bad, x >= good
        out[is_bad, r] = BAD
        out[is_good, r] = GOOD
        out[found["words"] < least, r] = SILENT
    return out


_PLACES = VOTES ** np.arange(len(RULES))


def _codes(texts: pa.Array) -> pa.Array:
    codes = [votes(texts.slice(i, j - i)) @ _PLACES for i, j in K.slices(texts)]
    return pa.array(np.concatenate(codes) if codes else [], pa.int32())


def pattern(text: Column) -> Column:
    """A text's votes as one int, in base 4, the first rule lowest."""
    return F.arrow_udf(_codes, T.IntegerType())(text.cast("string"))


def spell(codes: np.ndarray) -> np.ndarray:
    """A row of votes for each code."""
    return (np.asarray(codes, np.int64)[:, None] // _PLACES % VOTES).astype(np.int8)


class LabelModel:
    """Votes are independent given the quality; rates[q, r, v] is the chance that rule r, where it speaks, votes v."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(codes)
        cast, weight = spell(np.asarray(codes)[order]), np.asarray(counts, np.float64)[order]
        good, bad = (cast == GOOD).sum(1), (cast == BAD).sum(1)
        p = (good + 1.0) / (good + bad + 2.0)
        prior = (PRIOR_ROWS + PRIOR_WEIGHT * weight.sum()) * np.array([PRIOR_BAD, PRIOR_GOOD])
        self.rates = np.ones((2, len(RULES), VOTES))
        for self.rounds in range(1, ROUNDS + 1):
            self.good = float((weight @ p + PRIOR_SHARE[0]) / (weight.sum() + sum(PRIOR_SHARE)))
            for q, mass in ((0, weight * (1 - p)), (1, weight * p)):
                for v in (BAD, ABSTAIN, GOOD):
                    self.rates[q, :, v] = mass @ (cast == v) + prior[q, v]
                # Silence tells nothing of quality.
                self.rates[q, :, :SILENT] /= self.rates[q, :, :SILENT].sum(1, keepdims=True)
            before, p = p, self.posteriors(cast)
            if not len(p) or np.abs(p - before).max() <= TOLERANCE:
                break

    def posteriors(self, cast: np.ndarray) -> np.ndarray:
        """The chance of good quality for each row of votes."""
        away = np.log(1 - self.good) - np.log(self.good) + np.zeros(len(cast))
        ratio = np.log(self.rates[0]) - np.log(self.rates[1])
        for r in range(len(RULES)):
            away += ratio[r, cast[:, r]]
        return 1 / (1 + np.exp(np.clip(away, -700, 700)))

    def kept(self, cast: np.ndarray) -> np.ndarray:
        """Whether each row of votes keeps its text; where all rules are silent nothing speaks against it."""
        return (cast == SILENT).all(1) | (self.posteriors(cast) >= KEEP_FROM)

    def accuracies(self) -> dict[str, float]:
        """Chance that a rule is right where it votes good or bad."""
        bad, good = self.rates
        right = self.good * good[:, GOOD] + (1 - self.good) * bad[:, BAD]
        voted = self.good * (1 - good[:, ABSTAIN]) + (1 - self.good) * (1 - bad[:, ABSTAIN])
        return {name: float(x) for (name, *_), x in zip(RULES, right / voted)}


def fit(docs: DataFrame) -> LabelModel:
    """Counts the vote patterns of all rows and estimates the model from them."""
    return fit_codes(docs.select(pattern(F.col("text")).alias("code")))


def fit_codes(codes: DataFrame) -> LabelModel:
    # At most VOTES ** len(RULES) rows, a million, whatever the corpus; as Arrow they are 12 MB.
    found = codes.groupBy("code").agg(F.count("*").alias("n")).toArrow()
    return LabelModel(found["code"].to_numpy(), found["n"].to_numpy())


JUDGED = T.StructType([T.StructField("votes", T.ArrayType(T.IntegerType())), T.StructField("posterior", T.DoubleType()), T.StructField("keep", T.BooleanType())])


def verdict(code: Column, model: LabelModel) -> Column:
    """votes, posterior and keep of a pattern."""

    def run(codes: pa.Array) -> pa.Array:
        cast = spell(codes.to_numpy(zero_copy_only=False))
        flat = pa.array(cast.reshape(-1).astype(np.int32) - 1, mask=cast.reshape(-1) == SILENT)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cast) + 1) * len(RULES), pa.int32()), flat)
        return pa.StructArray.from_arrays([lists, pa.array(model.posteriors(cast).round(9)), pa.array(model.kept(cast))], ["votes", "posterior", "keep"])

    return F.arrow_udf(run, JUDGED)(code)


def judged(docs: DataFrame, model: LabelModel | None = None) -> DataFrame:
    """(doc_id, votes, posterior, keep) of every row: votes holds -1, 0 or 1 by rule, null where it is silent.

    Without a model one is fitted to docs; each text is then looked at once. Nulls: a null
    doc_id stays null; on a null, empty or blank text all rules are silent, the posterior is
    the share of good texts, and it is kept. Very long texts are measured whole, and in
    slices of their own. Repeated rows are judged each, alike; texts whose votes tie have one
    posterior, and at exactly KEEP_FROM a text is kept. An empty table gives no rows. Columns
    besides doc_id and text are not read.
    """
    codes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), pattern(F.col("text")).alias("code"))
    if model is None:
        codes = materialise(codes)
        model = fit_codes(codes)
    return codes.select("doc_id", verdict(F.col("code"), model).alias("v")).select("doc_id", "v.votes", "v.posterior", "v.keep")


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that the posterior keeps, all columns unchanged; rows are judged as by judged().

    Nulls, empty and long texts, ties, repeated rows and empty tables are as there.
    """
    model = fit(docs)

    def run(texts: pa.Array) -> pa.Array:
        kept = [model.kept(votes(texts.slice(i, j - i))) for i, j in K.slices(texts)]
        return pa.array(np.concatenate(kept) if kept else [], pa.bool_())

    return docs.where(F.arrow_udf(run, T.BooleanType())(F.col("text").cast("string")))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


QUERIES = {"op8_quality_rules": op8}
SQL: dict[str, str] = {}

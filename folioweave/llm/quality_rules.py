"""Quality rules combined by weak supervision.

Each rule votes good or bad on a document or abstains. Nobody knows how far each rule can
be trusted, so expectation-maximisation estimates for every rule how often it is right on
good and on bad documents, and a document is kept if its posterior probability of being
good reaches ``keep_at``. No single rule can reject by itself, except the base rules.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50
#: Votes of a rule.
ABSTAIN, GOOD, BAD = 0, 1, 2
RULES = ("symbols", "dup_lines", "repeat_words", "word_length", "capitals", "punctuation", "sentences", "variety")
#: Every combination of votes, so no more rows than this are ever gathered.
PATTERNS = 3 ** len(RULES)
SCHEMA = T.StructType([T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("votes", T.IntegerType())])


def repeated_words(ids: np.ndarray) -> int:
    """Words covered by three-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    _, at = np.unique(ids, return_inverse=True)
    at = at.astype(np.int64)
    pairs = np.unique(at[:-1] * (at.max() + 1) + at[1:], return_inverse=True)[1].astype(np.int64)
    _, window, n = np.unique(pairs[:-1] * (at.max() + 1) + at[2:], return_inverse=True, return_counts=True)
    hit = n[window] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of one text and the votes of the rules on it, as digits to the base three."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, symbols = len(words), sum(map(text.count, SYMBOLS))
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    numbers: dict[bytes, int] = {}
    repeat = repeated_words(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64))
    return n, chars, symbols, dup, repeat, vote(n, chars, symbols, dup / max(len(lines), 1), repeat, len(numbers), np.bincount(np.frombuffer(raw, np.uint8), minlength=256))


def vote(n: int, chars: int, symbols: int, dup: float, repeat: int, distinct: int, used: np.ndarray) -> int:
    """The rules' votes. ``used`` counts the bytes of the text.

    Lacking a defect is no merit: rules that look for one vote BAD or abstain. GOOD comes
    from the rules that know what prose looks like.
    """
    if not n:
        return 0
    upper, lower, other = used[65:91].sum(), used[97:123].sum(), used[128:].sum()
    marks = used[33:127].sum() - used[48:58].sum() - upper - lower
    stops = (used[33] + used[46] + used[63]) / n
    length, marked, shouted = chars / n, marks / max(marks + upper + lower + other, 1), upper / max(upper + lower, 1)
    votes = (
        BAD if symbols > 0.1 * n else ABSTAIN,
        BAD if dup > 0.3 else ABSTAIN,
        BAD if repeat > 0.3 * n else ABSTAIN,
        BAD if not 2.5 <= length <= 12 else ABSTAIN,
        BAD if shouted > 0.3 else GOOD if shouted <= 0.15 else ABSTAIN,
        BAD if marked > 0.08 else GOOD if marked <= 0.05 else ABSTAIN,
        BAD if stops > 0.5 or not stops else GOOD if 0.025 <= stops <= 0.34 else ABSTAIN,
        ABSTAIN if n < BASE_MIN_WORDS else BAD if distinct < 0.1 * n else ABSTAIN,
    )
    code = 0
    for x in reversed(votes):
        code = 3 * code + x
    return code


@F.pandas_udf(SCHEMA)
def measured(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(x) for x in text], columns=SCHEMA.names)


#: Spark would repeat a function that it may at each use of its result, in a filter and above it.
measured = measured.asNondeterministic()


def digits(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(RULES)) % 3


#: Where estimation starts: the chances that a rule abstains, votes GOOD or votes BAD on a bad and on a good document.
START = np.array([[0.35, 0.4, 0.25], [0.28, 0.7, 0.02]])


def fit(counts: Iterable[tuple[int, int]], rounds: int = 500, strength: float = 20.0, prior: float = 0.85) -> dict[int, float]:
    """Posterior probability of good for each pattern of votes, from how often each occurs.

    Expectation-maximisation of every rule's confusion table: how it votes on good and on bad
    documents. ``strength`` pseudo-documents hold a rule that seldom votes near START, and a
    BAD vote may never speak for a document, nor a GOOD one against it, so the classes can't
    change places.
    """
    counts = sorted(counts)
    if not counts:
        return {}
    patterns, n = np.array([p for p, _ in counts], np.int64), np.array([c for _, c in counts], float)
    given = (digits(patterns)[:, :, None] == np.arange(3)).astype(float)  # pattern, rule, vote
    table = np.repeat(START[:, None, :], len(RULES), axis=1)  # class, rule, vote
    share, after = prior, np.zeros(len(n))
    for _ in range(rounds):
        likely = np.einsum("prv,crv->cp", given, np.log(table))
        before, after = after, 1 / (1 + np.exp(np.clip(likely[0] + np.log(1 - share) - likely[1] - np.log(share), -500, 500)))
        if np.abs(after - before).max() < 1e-9:
            break
        for y, w in ((0, n * (1 - after)), (1, n * after)):
            seen = np.einsum("p,prv->rv", w, given) + strength * START[y]
            table[y] = seen / seen.sum(axis=1, keepdims=True)
        table[0, :, BAD] = np.maximum(table[0, :, BAD], table[1, :, BAD])
        table[1, :, GOOD] = np.maximum(table[0, :, GOOD], table[1, :, GOOD])
        share = float(np.clip((n @ after + prior * strength) / (n.sum() + strength), 0.5, 0.99))
    return dict(zip(patterns.tolist(), after.tolist(), strict=True))


def base_failed(q: Column) -> Column:
    return (q["n_words"] < BASE_MIN_WORDS) | (100 * q["n_repeat_words"] > BASE_MAX_REPEAT_PERCENT * q["n_words"])


def _judged(df: DataFrame, counts: DataFrame, keep_at: float) -> DataFrame:
    """df has struct q; adds probability, base_failed, kept. At most PATTERNS rows reach the driver or are broadcast."""
    spark = df.sparkSession
    found = fit((r[0], r[1]) for r in counts.groupBy("votes").count().collect())
    model = spark.createDataFrame(list(found.items()), "votes int, probability double")
    joined = df.withColumn("votes", F.col("q.votes")).join(F.broadcast(model), "votes", "left")
    failed = base_failed(F.col("q"))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("probability") >= keep_at))


def quality_report(docs: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """A row for each document with its counts, the posterior probability and the verdict.

    Null and empty texts have no words and fail the base rules; repeated rows get a row each;
    an empty table gives no rows. The counts are made once and checkpointed without texts.
    """
    from .common import cut

    q = cut(docs.select("doc_id", measured("text").alias("q")))
    out = _judged(q, q.select("q.votes"), keep_at)
    return out.select("doc_id", *[f"q.{x}" for x in SCHEMA.names[:-1]], "base_failed", "kept", "probability")


def quality_filter(docs: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """The documents whose verdict is kept, with their own columns.

    Votes are counted in a pass of its own, so texts are never shuffled or stored.
    """
    own = [F.col("d")[c].alias(c) for c in docs.columns]
    q = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("d"), measured(docs["text"]).alias("q"))
    counts = docs.select(measured("text").alias("q")).select("q.votes")
    return _judged(q, counts, keep_at).where("kept").select(*own)

"""Spelling variants of a corpus: words one edit apart, each led to the far more frequent word it stands for.

Near words meet by a rare-first q-gram prefix filter. An edit destroys at most two of a
word's bigrams, so of two words one edit apart each has a bigram that both share among its
three rarest, at places that differ by one at most. What stands before such a bigram or what
stands after it is then equal in both, and of the other side one half is: postings are keyed
by all of these, so that no key gathers the many words that merely share a bigram.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Letters of a word, after A-Z were lower-cased.
LETTERS = "[a-zÀ-ÿ]"
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
#: Bigrams that one edit destroys at most, and so the prefix that two words one edit apart must share.
DESTROYED = 2
PREFIX = DESTROYED + 1
#: Words that a task counts before it hands its counts on.
HELD = 200_000


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, worn: int | None = None) -> DataFrame:
    """word, n: how often each word of at least ``min_chars`` letters stands in all texts.

    With ``worn``, a run whose checksum with its document's id is divisible by it loses one
    letter: misspellings of known number, for measuring.
    """
    run = re.compile(f"{LETTERS}{{{min_chars},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                if not text.is_valid:
                    continue
                found = Counter(run.findall(text.as_buffer().to_pybytes().lower().decode()))
                if worn is None:
                    total.update(found)
                else:
                    begun = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for word, n in found.items():
                        h = zlib.crc32(word.encode(), begun)
                        if h % worn == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                            if len(word) < min_chars:
                                continue
                        total[word] += n
                if len(total) > HELD:
                    yield _counted(total)
                    total = Counter()
        yield _counted(total)

    found = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(total: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Each bigram's place by frequency, rarest first, ties by code points: at most the square of the 90 letters."""
    at = F.explode(F.sequence(F.lit(1), F.length("word") - 1))
    grams = words.select("word", at.alias("at")).groupBy(F.expr("substring(word, at, 2)").alias("gram")).agg(F.count("*").alias("n"))
    return {r["gram"]: k for k, r in enumerate(grams.orderBy("n", "gram").collect())}


def _halves(rest: str) -> Iterator[tuple[int, str, str]]:
    """Keys of which two texts one edit apart share one: the shorter one's length with its first or its last half."""
    for shorter in {max(0, len(rest) - 1), len(rest)}:
        half = shorter // 2
        yield shorter, "first", rest[:half]
        yield shorter, "last", rest[len(rest) - (shorter - half) :]


def keys(word: str, ranks: dict[str, int]) -> set[tuple]:
    """What a word is posted under: its rarest bigrams with the text on one side and half of that on the other."""
    grams = sorted((ranks[word[i : i + 2]], i) for i in range(len(word) - 1))[:PREFIX]
    found = set()
    for _, i in grams:
        found |= {("before", i, word[: i + 2], *h) for h in _halves(word[i + 2 :])}
        found |= {("after", word[i:], *h) for h in _halves(word[:i])}
    return found


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: the pairs of words, a before b, that one inserted, deleted or replaced letter tells apart.

    ``words`` are distinct and have three letters or more. Keys are compared by 64 bits of a
    hash, and every pair that meets is verified.
    """
    import xxhash

    ranks = gram_ranks(words)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, hashed = [], []
            for k, word in enumerate(batch["word"].to_pylist()):
                found = {xxhash.xxh3_64_intdigest("\0".join(map(str, x))) for x in keys(word, ranks)}
                which += [k] * len(found)
                hashed += [x - (1 << 63) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(hashed, pa.int64()), batch["word"].take(pa.array(which, pa.int64())), batch["n"].take(pa.array(which, pa.int64()))], ["key", "word", "n"])

    posted = words.select("word", "n").mapInArrow(post, "key long, word string, n long")
    a, b = (posted.select("key", F.col("word").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    met = a.join(b, "key").where("a < b AND abs(length(a) - length(b)) <= 1")
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """word, root of word, form: where forms lead to at last, by doubling the step each round.

    Counts grow along forms, so there is no circle.
    """
    led = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(max_rounds):
        further = led.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(led.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        led = step.select("word", "root")
        if step.where("moved").isEmpty():
            return led
    raise RuntimeError(f"forms did not end in {max_rounds} rounds")


def variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, worn: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of at least ``min_chars`` letters that stands ``min_count`` times or more.

    A word's form is the near word of greatest count (ties: the first by code points) if that
    is at least ``ratio`` times its own, else null; root follows forms to their end. Null and
    empty texts have no words, a null doc_id counts as an empty one, repeated rows count each
    time, other columns are ignored, and an empty table gives no rows.
    """
    words = cut(word_counts(docs, min_chars, worn).where(F.col("n") >= min_count))
    pairs = near_pairs(words)
    either = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    either = either.unionByName(pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = either.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    formed = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    best = cut(best.select("word", "n_near", F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")))
    led = roots(best.where("form is not null"))
    return words.join(best, "word", "left").join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")

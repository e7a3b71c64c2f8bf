"""Secret scan: long tokens of a text, with a random forest that removes false positives.

The forest sees a candidate's length, the transitions between its characters, how much of it a
dictionary covers, the path it comes from and the words beside it. Dictionary and transitions
are counted over all documents. It is trained from labelled findings: some made up, which
know formats that a corpus may lack, and some from the documents themselves.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lower_ascii, once

SPACE = r"[\x20\x09-\x0D]+"
MIN_CHARS = 16
#: Values behind a secret word and an assignment sign are candidates from so many characters on, whatever signs they hold.
MIN_ASSIGNED = 6
#: A candidate: the longest run of such characters in a word, of MIN_CHARS or more.
CORE = r"[A-Za-z0-9_+/=.-]*[A-Za-z0-9_+/=-]"
#: What an assignment gives, at the end of a word, and what closes it.
OWN = rf"(?:^|[=:])[\"'`]?([^\"'`=:]{{{MIN_ASSIGNED},}}?)([\"'`]?[,;.)]*)$"
#: Words that placeholders and identifiers are made of.
DICTIONARY = (
    "access", "account", "address", "admin", "another", "application", "authorization", "before", "between", "build", "change", "changeme",
    "client", "config", "configuration", "connection", "container", "content", "copy", "data", "database", "default", "demo", "document",
    "dummy", "environment", "example", "fake", "file", "foo", "from", "function", "handler", "header", "hello", "here", "image", "index",
    "information", "insert", "international", "interface", "internal", "key", "license", "list", "local", "manager", "message", "method",
    "module", "name", "null", "object", "organization", "package", "page", "password", "path", "placeholder", "private", "production",
    "project", "property", "provider", "public", "random", "redacted", "remote", "replace", "report", "request", "resource", "response",
    "sample", "script", "secret", "section", "server", "service", "session", "software", "something", "source", "string", "system",
    "table", "template", "test", "text", "the", "this", "token", "type", "undefined", "update", "user", "value", "version", "with", "world",
    "your", "xxxx",
)
#: Neighbours that speak for a secret, and for a mere digest or name.
SECRET_WORDS = r"token|secret|passw|pwd|api_?key|apikey|access_?key|private|credential|bearer|auth"
DIGEST_WORDS = r"commit|sha1|sha256|sha512|md5|checksum|digest|hash|integrity|revision|uuid|guid|etag|version"
#: Paths of examples and tests.
SAMPLE_PATHS = r"test|example|sample|fixture|mock|demo|doc|readme|tutorial"
FEATURES = (
    "length", "digit_share", "upper_share", "lower_share", "other_share", "kind_changes", "vowel_changes", "repeats", "runs", "variety",
    "hex_only", "digits_only", "known_prefix", "coverage", "corpus_words", "transitions", "longest_letters", "secret_before", "digest_before", "assigned", "quoted", "sample_path", "word_after",
)
TREES, DEPTH, SEED, LABELLED = 40, 8, 5, 6000
#: Words of the corpus dictionary, the most frequent ones; and documents, drawn by hash, from which findings are taken.
DICTIONARY_WORDS, SAMPLED_DOCUMENTS = 3000, 20_000
LETTERS = 26


@dataclass(frozen=True)
class Language:
    """What the corpus is written in: its frequent words, and log2 chances of a character after another (letters by number, all other signs last)."""

    words: tuple[str, ...]
    chances: tuple[float, ...]

    @classmethod
    def of(cls, words: Iterable[str], pairs: dict[str, int]) -> Language:
        """``pairs`` counts pairs of letters; the fixed dictionary counts once, so that none is unknown."""
        n = np.ones((LETTERS + 1, LETTERS + 1))
        for pair, k in [*pairs.items(), *((w[i : i + 2], 1) for w in DICTIONARY for i in range(len(w) - 1))]:
            a, b = (ord(c) - 97 for c in pair)
            n[a, b] += k
        return cls(tuple(sorted({*words, *DICTIONARY})), tuple(np.log2(n / n.sum(axis=1, keepdims=True)).ravel().tolist()))


def language(docs: DataFrame, most: int = DICTIONARY_WORDS) -> Language:
    """Words and pairs of letters of all documents. At most ``most`` words and 676 pairs reach the driver."""
    words = docs.select(F.explode(F.split(lower_ascii(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    words = cut(words.where("length(w) between 2 and 40"))
    common = words.where("length(w) >= 4").orderBy(F.desc("n"), "w").limit(most).collect()
    pairs = words.select("n", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("k"), "w").groupBy(F.substring("w", F.col("k"), F.lit(2)).alias("pair")).agg(F.sum("n").alias("n")).collect()
    return Language.of((r["w"] for r in common), {r["pair"]: r["n"] for r in pairs})


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """A row for each candidate: key (of the text), doc_id, word_at (its word's number from 0), found, word, before (two words), after, path.

    A candidate is a run of MIN_CHARS or more, or what an assignment gives to a name of a secret.
    """
    read = once(docs.select("doc_id", F.xxhash64("text").alias("key"), F.col(path).cast("string").alias("path"), "text"), words=words_of(F.col("text"))).drop("text")
    run = f"[A-Za-z0-9_+/=-][A-Za-z0-9_+/=.-]{{{MIN_CHARS - 1}}}"
    inside = rf"(?i)(?:{SECRET_WORDS})[a-z_]*[\"'`]?[=:][\"'`]?[^\"'`=:]{{{MIN_ASSIGNED}}}"
    # The cheap tests go first: most words are short, and few stand behind a sign.
    behind = lambda i: F.get("words", i - 1).endswith("=") | F.get("words", i - 1).endswith(":")
    wanted = lambda w, i: (F.length(w) >= MIN_ASSIGNED) & (((F.length(w) >= MIN_CHARS) & w.rlike(run)) | ((F.contains(w, F.lit("=")) | F.contains(w, F.lit(":"))) & w.rlike(inside)) | ((i > 0) & F.coalesce(behind(i), F.lit(False))))
    long_ = F.filter(F.transform("words", lambda w, i: F.when(wanted(w, i), i)), lambda i: i.isNotNull())
    near = lambda k: F.coalesce(F.get("words", F.col("word_at") + k), F.lit(""))
    out = read.select("key", "doc_id", "path", "words", F.explode(long_).alias("word_at"))
    out = out.select("key", "doc_id", "path", F.col("word_at").cast("long").alias("word_at"), near(0).alias("word"), F.concat_ws(" ", near(-2), near(-1)).alias("before"), near(1).alias("after"))
    cores = F.filter(F.regexp_extract_all("word", F.lit(CORE), F.lit(0)), lambda c: F.length(c) >= MIN_CHARS)
    own = F.regexp_extract("word", OWN, 1)
    named = lower_ascii(F.concat_ws(" ", "before", F.regexp_extract("word", r"^([^=:]*[=:])", 1))).rlike(rf"(?:{SECRET_WORDS})[a-z_]*[\"'`]?\s*[=:]\s*$")
    cores = F.when(F.size(cores) > 0, cores).when(named & (own != ""), F.array(own)).otherwise(F.array().cast("array<string>"))
    return out.withColumn("found", F.explode(cores))


def featured(found: DataFrame, known: Language | None = None) -> DataFrame:
    """Adds FEATURES to rows of found, word, before, after and path; nulls count as empty."""
    known = known or Language.of((), {})
    texts = {c: F.coalesce(F.col(c), F.lit("")) for c in ("found", "word", "before", "after", "path")}
    c, word, before, after, path = texts.values()
    lower = lower_ascii(c)
    n = F.greatest(F.length(c), F.lit(1))
    count = lambda p, x=c: F.regexp_count(x, F.lit(p)) / n
    letters = F.regexp_extract_all(lower, F.lit("[a-z]+"), F.lit(0))
    left = F.concat(lower_ascii(before), F.lit(" "), lower_ascii(F.call_function("substring_index", word, c, F.lit(1))))
    flag = lambda x: x.cast("double")
    codes = F.transform(F.filter(F.split(lower, ""), lambda x: x != ""), lambda x: F.when(x.between("a", "z"), F.ascii(x) - 97).otherwise(LETTERS))
    after_it = F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0)))
    chances = F.array(*[F.lit(x) for x in known.chances])
    pairs = F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), after_it, lambda x, y: F.get(chances, (x * (LETTERS + 1) + y).cast("int")))
    made = {
        "length": F.log1p(n.cast("double")),
        "digit_share": count("[0-9]"), "upper_share": count("[A-Z]"), "lower_share": count("[a-z]"), "other_share": count("[^A-Za-z0-9]"),
        "kind_changes": count("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "vowel_changes": count("(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])", lower),
        "repeats": count(r"(.)(?=\1)", lower), "runs": count("012|123|234|345|456|567|678|789|abc|bcd|cde|def|efg|xyz", lower),
        "variety": F.size(F.array_distinct(F.split(c, ""))) / n,
        "hex_only": flag(lower.rlike(r"\A[0-9a-f]+\z")), "digits_only": flag(c.rlike(r"\A[0-9.+-]+\z")),
        "known_prefix": flag(c.rlike(r"\A(AKIA|ASIA|ghp_|gho_|ghs_|glpat-|xox[abp]-|sk_live_|rk_live_|AIza|eyJ|npm_|pypi-)")),
        "coverage": 1 - F.length(F.regexp_replace(lower, "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")) / n,
        "corpus_words": F.aggregate(F.filter(letters, lambda w: w.isin(list(known.words))), F.lit(0), lambda t, w: t + F.length(w)) / n,
        "transitions": F.aggregate(pairs, F.lit(0.0), lambda t, x: t + x) / F.greatest(n - 1, F.lit(1)),
        "longest_letters": F.coalesce(F.array_max(F.transform(letters, F.length)), F.lit(0)) / n,
        "secret_before": flag(left.rlike(SECRET_WORDS)), "digest_before": flag(left.rlike(DIGEST_WORDS)),
        "assigned": flag(left.rlike(r"[=:]>?[ \"'`]*\z")), "quoted": flag(word.rlike("[\"'`]")),
        "sample_path": flag(lower_ascii(path).rlike(SAMPLE_PATHS)), "word_after": flag(after.rlike(r"\A[A-Za-z]")),
    }
    return found.withColumns({k: made[k].cast("double") for k in FEATURES})


def labelled_findings(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    """n findings labelled by construction: found, word, before, after, path, label.

    Half are random keys of usual formats beside the words that introduce them. The others are
    what scans take for keys: digests, identifiers, placeholders, long words, numbers, paths.
    Every value follows from its number.
    """
    h = lambda salt: F.sha2(F.concat_ws(":", F.lit(salt), "id"), 256)
    draw = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(k)).cast("int")

    def pick(salt: str, *of: str | Column) -> Column:
        return F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in of]), draw(salt, len(of)) + 1)

    b64 = F.regexp_replace(F.base64(F.unhex(h("b"))), "=+$", "")
    upper = F.upper(F.translate(h("u"), "01", "qz"))
    syllables = ("ing", "tion", "er", "the", "ment", "est", "ar", "lich", "keit", "ado", "que", "eau", "on", "re", "ble", "ous")
    long_word = F.concat(*[pick(f"s{k}", *syllables) for k in range(8)])
    named = F.replace(F.concat_ws("_", *[pick(f"d{k}", *DICTIONARY) for k in range(4)]), F.lit("_"), pick("sep", "_", "-", "."))
    camel = F.concat(*[F.initcap(pick(f"c{k}", *DICTIONARY)) for k in range(4)])
    uuid = F.regexp_replace(F.substring(h("g"), 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    secret = pick("kind", F.substring(h("x"), 1, 32), F.substring(h("x"), 1, 40), h("x"), b64, F.substring(b64, 1, 24), F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)), F.concat(F.lit("sk_live_"), F.substring(b64, 1, 24)))
    digest = pick("kind", F.substring(h("x"), 1, 32), F.substring(h("x"), 1, 40), h("x"), uuid)
    plain = pick(
        "plain", long_word, F.substring(long_word, 1, 18), named, camel, F.concat(pick("y", "your_", "my-", "insert_"), pick("z", "api_key", "secret_token", "access_token"), F.lit("_here")), F.repeat(pick("r", "x", "0", "*", "abc", "-", "="), 20),
        F.concat(F.lit("0123456789abcdef"), F.lit("0123456789abcdef")), F.translate(F.substring(h("n"), 1, 18), "abcdef", "123456"), F.concat(F.lit("src/"), named, F.lit(".py")),
    )
    neighbours = {
        0: pick("l0", "token =", "the token =", "api_key:", "secret =", "password:", "Authorization: Bearer", "export SECRET_KEY =", "access_key =", "and auth:"),
        1: pick("l1", "commit", "sha256:", "md5 =", "checksum:", "revision", "uuid =", "the digest", "at version"),
        2: pick("l2", "of the", "and with", "token =", "password:", "set to", "see file", "call the", "id =", "", "key:"),
    }
    kind = F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 6 == 1, 1).otherwise(2)
    found = F.when(kind == 0, secret).when(kind == 1, digest).otherwise(plain)
    before = F.when(kind == 0, neighbours[0]).when(kind == 1, neighbours[1]).otherwise(neighbours[2])
    quote = F.when(draw("q", 3) > 0, F.lit('"')).otherwise(F.lit(""))
    path = F.when((kind != 0) & (draw("p", 4) == 0), pick("pp", "tests/data", "docs/readme", "example")).otherwise(F.concat(F.lit("src"), draw("pn", 20).cast("string")))
    rows = once(spark.range(n), found=F.coalesce(found, F.lit("")), before=before, quote=quote, path=path, after=pick("a", "and", "the", "", "}", "of", "#"), label=(kind == 0).cast("double"))
    return rows.select("found", F.concat("quote", "found", "quote").alias("word"), "before", "after", "path", "label")


def document_findings(docs: DataFrame, path: str = "source", most: int = SAMPLED_DOCUMENTS) -> DataFrame:
    """Labelled findings of about ``most`` documents, drawn by a hash of the text: found, word, before, after, path, label.

    A value with a digit that an assignment gives to a secret's name is a secret; all other
    candidates are not. The words beside every second one are then hidden, so that the forest
    can't learn the labelling rule alone but must judge the value.
    """
    share = min(1.0, most / max(docs.count(), 1))
    found = candidates(docs.where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20))), path)
    left = lower_ascii(F.concat(F.col("before"), F.lit(" "), F.call_function("substring_index", F.col("word"), F.col("found"), F.lit(1))))
    secret = left.rlike(rf"(?:{SECRET_WORDS})[a-z_]*[\"'`]?\s*[=:]>?[ \"'`]*\z") & F.col("found").rlike("[0-9]") & ~left.rlike(DIGEST_WORDS)
    rows = found.select("found", "word", "before", "after", "path", secret.cast("double").alias("label")).distinct()
    hidden = F.pmod(F.xxhash64("found", "before"), F.lit(2)) == 0
    return rows.select("found", *[F.when(hidden, own).otherwise(F.col(c)).alias(c) for c, own in (("word", F.col("found")), ("before", F.lit("")), ("after", F.lit("")))], "path", "label")


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, known: Language | None = None) -> PipelineModel:
    """A random forest over FEATURES of labelled findings, a bounded table."""
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    rows = cut(assembler.transform(featured(findings, known).select("label", *FEATURES)))
    return PipelineModel([assembler, forest.fit(rows)])


def scored(docs: DataFrame, findings: DataFrame | None, path: str) -> DataFrame:
    """candidates() with probability, by a forest trained on the findings or else on made-up ones and the documents' own."""
    known = language(docs)
    if findings is None:
        findings = labelled_findings(docs.sparkSession).unionByName(document_findings(docs, path))
    model = train(findings, known=known)
    return model.transform(featured(candidates(docs, path), known)).withColumn("chance", vector_to_array("probability")[1])


def scan(docs: DataFrame, findings: DataFrame | None = None, keep_at: float = 0.5, path: str = "source") -> DataFrame:
    """doc_id, word_at, n_chars, masked, digest, probability, is_secret: a row for each candidate in ``docs``.

    is_secret is false where the forest finds a false positive. The secret itself is not
    returned: ``masked`` shows its first two characters, ``digest`` is its SHA-256. Null and empty
    texts have no candidates; repeated rows are scanned each; a null path counts as empty.
    Of texts only counts of words are shuffled.
    """
    p = F.round("chance", 6)
    return scored(docs, findings, path).select(
        "doc_id", "word_at", F.length("found").cast("long").alias("n_chars"), F.concat(F.substring("found", 1, 2), F.lit("***")).alias("masked"),
        F.sha2("found", 256).alias("digest"), p.alias("probability"), (p >= keep_at).alias("is_secret"),
    )


def places(word: Column, found: Column) -> Column:
    """Where in its word a candidate stands: a list of starts, from 1. A run of such characters stands wherever it is whole, an assigned value at the end."""
    runs = F.regexp_extract_all(word, F.lit(CORE), F.lit(0))
    none = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("starts"))

    def step(done: Column, run: Column) -> Column:
        at = F.call_function("locate", run, word, done["next"])
        return F.struct((at + F.length(run)).alias("next"), F.when(run == found, F.array_append(done["starts"], at)).otherwise(done["starts"]).alias("starts"))

    whole = F.aggregate(runs, none, step)["starts"]
    behind = F.regexp_extract(word, OWN, 2)
    return F.when(F.size(whole) > 0, whole).otherwise(F.array((F.length(word) - F.length(behind) - F.length(found) + 1).cast("int")))


def redacted(docs: DataFrame, findings: DataFrame | None = None, keep_at: float = 0.5, path: str = "source", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secrets found in their texts replaced by ``mask``, each where it was found, whatever their doc_id.

    What looks like a secret elsewhere, or within another word, stays. Texts without secrets, nulls among them, are as they were.
    """
    bad = scored(docs, findings, path).where(F.col("chance") >= keep_at).select("key", "word_at", F.explode(places(F.col("word"), F.col("found"))).alias("at"), F.length("found").alias("n"))
    bad = bad.groupBy("key", "word_at").agg(F.sort_array(F.collect_set(F.struct("at", "n")), asc=False).alias("cuts"))
    bad = bad.groupBy(F.col("key").alias("own_key")).agg(F.map_from_entries(F.collect_list(F.struct("word_at", "cuts"))).alias("own_cuts"))
    met = docs.join(bad, F.xxhash64(docs["text"]) == bad["own_key"], "left")
    pieces = F.regexp_extract_all(docs["text"], F.lit(rf"{SPACE}|[^\x20\x09-\x0D]+"), F.lit(0))
    begins = docs["text"].rlike(rf"\A{SPACE}").cast("int")  # white space comes first

    def cut_out(piece: Column, i: Column) -> Column:
        cuts = F.when((i - begins) % 2 == 0, bad["own_cuts"][((i - begins) / 2).cast("long")])
        return F.aggregate(F.coalesce(cuts, F.array().cast("array<struct<at:int,n:int>>")), piece, lambda t, c: F.concat(F.substring(t, F.lit(1), c["at"] - 1), F.lit(mask), F.substring(t, c["at"] + c["n"], F.length(t))))

    text = F.when(bad["own_key"].isNull(), docs["text"]).otherwise(F.array_join(F.transform(pieces, cut_out), ""))
    return met.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns])

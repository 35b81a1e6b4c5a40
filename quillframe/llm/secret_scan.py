"""Secret scans: candidates by pattern, false positives removed by a random forest, all in DataFrame functions.

Candidates are values assigned to a telling name (password, Passwort, token, ... with a sign or "is"), passwords in URLs,
private-key blocks from BEGIN to END and long runs of key-like characters with a digit, without a name and sign before them.
Each is described by its length, its character classes and their transitions, how many of its letter pairs and letters
belong to frequent pairs and words, what is known of the path, and the neighbouring words; a random forest trained on labelled
findings tells secrets from the rest. Frequent pairs and words are counted over the whole corpus by `learn_words`
(WORDS and PAIRS of them are kept); without that, short built-in lists stand in. Training takes at most
MAX_TRAINING labelled findings, chosen by hash (a documented bound on the classifier's sample); scanning reads every whole text.

Labelled findings: (value, before, after, path, label). `synthetic_findings` makes the built-in set from a seed: real
key formats, random values and glued words next to telling names on one side; words, numbers, dates, identifiers, check sums,
paths and placeholders on the other.

Defined results: a null or empty text has no findings. Null ids and repeated rows are rows of their own. A null path
says nothing. An empty table gives no findings. `redact` keeps every row and column and replaces what was found;
columns may have any names. Time is linear in a text's length and number of candidates.
"""

from __future__ import annotations

import random
import string
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

MAX_TRAINING = 20_000
#: Frequent words (of four to twenty letters) and letter pairs of a corpus that are kept.
WORDS, PAIRS = 1000, 80
CONTEXT = 48
ALPHABET = 64  # distinct characters of a longer value are counted against this many
MASK = "[SECRET]"

# Names that announce a secret, words that announce something else, and parts of paths.
TELLING = ["passwor[dt]", "kennwort", "contrase(?:ñ|n)a", "mot de passe", "passwd", "pwd", "passphrase", "secret", "token", "api[_-]?key", "apikey", "access[_-]?key", "private[_-]?key", "client[_-]?secret", "auth", "credential", "bearer"]
BENIGN = ["commit", "sha1", "sha256", "md5", "hash", "checksum", "digest", "uuid", "guid", "version", "revision", "build", "example", "sample", "placeholder", "dummy", "isbn", "card", "phone", "order", "invoice", "http", "https", "www", "href", "src", "file", "path"]
PATHS_TEST = ["test", "example", "sample", "fixture", "mock", "docs", "spec"]
PATHS_KEYS = [r"\.env", r"\.pem", r"\.key", r"\.p12", r"\.cfg", r"\.ini", r"\.ya?ml", "config", "secret", "credential"]
COMMON_PAIRS = ["th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "it", "is", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ve", "co", "me", "de", "hi", "ri", "ro", "ic", "ne", "ea", "ra", "ce", "ch", "ei", "ie", "un", "ge", "be", "la", "qu", "el", "os", "ci", "ue", "ai", "au", "eu"]
PLACEHOLDERS = ["password", "example", "changeme", "default", "secret", "token", "test", "sample", "dummy", "placeholder", "your", "here", "insert", "null", "none", "true", "false", "string", "value", "required", "optional", "undefined", "xxx", r"\*\*\*"]
DICTIONARY = ["password", "example", "changeme", "default", "secret", "token", "admin", "user", "test", "sample", "dummy", "placeholder", "your", "here", "insert", "null", "none", "true", "false", "string", "value", "name", "index", "page", "image", "file", "data", "report", "version", "update", "and", "the", "for", "with", "from", "that", "this", "tion", "ment", "ing", "ung", "keit", "heit", "lich", "schaft", "ción", "mente", "able", "ness", "less", "over", "under", "inter", "http", "https", "www", "com", "org", "html", "json", "config", "build", "release", "class", "import", "return"]
KNOWN = r"^(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.?.*|-----BEGIN .*)$"

_ASSIGNED = "(?i:(?:" + "|".join(TELLING) + r")s?[\"']?(?:\s*+(?::=|=>|=|:)\s*+|\s++is\s++)[\"']?)"
# The password between the user and the host of a URL.
_USER = r"(?<=://)[^\s/?#@:\"'<>]*+:"
_IN_URL = rf"{_USER}[^\s/@\"'<>]{{4,}}+(?=@)"
# From BEGIN to END, whatever is between but another marker; without an END, header lines and what may be base64.
_LABEL = r"[A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----"
_KEY = rf"-----BEGIN {_LABEL}(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END {_LABEL}|(?:\s*+[A-Za-z][A-Za-z0-9-]*+:[^\r\n]*+)*+[A-Za-z0-9+/=\s]*+)"
# Key-like characters with a digit, 16 or more with the signs of equality that pad them.
_CHARS = "[A-Za-z0-9+/_-]"
_LONG = f"(?=[A-Za-z+/_-]*+[0-9])(?:{_CHARS}{{16,}}+=*+|" + "|".join(f"{_CHARS}{{{n}}}={{{16 - n},}}+" for n in range(15, 0, -1)) + ")"
_RUN = f"(?<!{_CHARS}){_LONG}"
# A name and its sign before a run: one that is not such a run itself, or a telling one.
_NAME = f"(?=[A-Za-z_][A-Za-z0-9_-]*+={_CHARS})(?:(?!{_LONG})|(?=[A-Za-z0-9_-]*?(?i:" + "|".join(TELLING) + r")))[A-Za-z0-9_-]++="
_LEAD = f"(?:{_ASSIGNED}|(?<!{_CHARS}){_NAME})"
CANDIDATE = f"{_IN_URL}|{_ASSIGNED}(?:{_KEY}|[^\\s\"'<>,;#]{{6,}}+)|{_KEY}|(?<!{_CHARS}){_NAME}{_LONG}|{_RUN}"
#: A cheap test that every text with a candidate passes.
LIKELY = f"{_IN_URL}|{_ASSIGNED}[^\\s]|-----BEGIN|{_RUN}"

FEATURES = ["length", "transitions", "digits", "upper", "lower", "distinct", "pairs", "covered", "placeholder", "telling", "benign", "known", "path_test", "path_keys", "longest_word", "repeats", "hex_digest", "in_url"]


def _share(value: Column, pattern: str) -> Column:
    return 1 - F.char_length(F.regexp_replace(value, pattern, "")) / F.greatest(F.char_length(value), F.lit(1))


def _has(text: Column, words: list[str]) -> Column:
    return F.coalesce(text.rlike("(?i)(?:" + "|".join(words) + ")"), F.lit(False)).cast("double")


@dataclass(frozen=True)
class Language:
    """What is frequent in a corpus: words, and letter pairs inside words."""

    words: tuple[str, ...] = tuple(DICTIONARY)
    pairs: tuple[str, ...] = tuple(COMMON_PAIRS)


@dataclass(frozen=True)
class Judge:
    forest: RandomForestClassificationModel
    language: Language


def learn_words(docs: DataFrame, text_col: str = "text", words: int = WORDS, pairs: int = PAIRS) -> Language:
    """Counts the words of all texts, and the letter pairs in them, and keeps the most frequent ones (a bounded number)."""
    found = docs.select(F.explode(F.split(F.lower(text_col), "[^\\p{L}]+", -1)).alias("word")).filter(F.char_length("word").between(2, 20))
    tmp = Scratch(docs.sparkSession, "secret-words")
    counts = tmp.keep(found.groupBy("word").agg(F.count("*").alias("n")), "words")
    two = F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    top = lambda df, most: tuple(r.word for r in df.orderBy(F.desc("n"), "word").limit(most).collect())
    by_pair = counts.select(F.explode(two).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    language = Language(top(counts.filter(F.char_length("word") >= 4), words) or Language.words, top(by_pair, pairs) or Language.pairs)
    tmp.drop()
    return language


def features(found: DataFrame, language: Language = Language()) -> DataFrame:
    """found: value, before, after, path. Adds the columns FEATURES."""
    v, n = F.col("value"), F.greatest(F.char_length("value"), F.lit(1))
    classes = v
    for pattern, mark in (("[a-z]+", "l"), ("[A-Z]+", "u"), ("[0-9]+", "d"), ("[^lud]+", "o")):
        classes = F.regexp_replace(classes, pattern, mark)
    near = F.concat_ws(" ", F.right(F.regexp_replace("before", r"\s+", " "), F.lit(24)), F.left(F.col("after"), F.lit(8)))
    longest = F.array_max(F.transform(F.split(v, "[^A-Za-z]+"), lambda x: F.char_length(x)))
    # Whole values of any length: no array of their characters but of the few that are not printable ASCII.
    ascii_kinds = reduce(Column.__add__, [F.contains(v, F.lit(chr(c))).cast("int") for c in range(33, 127)])
    other_kinds = F.size(F.array_distinct(F.split(F.regexp_replace(v, "[\\x21-\\x7E]+", ""), ""))) - F.when(v.rlike("[^\\x21-\\x7E]"), 0).otherwise(1)
    return found.withColumns({
        "length": n.cast("double"),
        "transitions": (F.char_length(classes) - 1) / n,
        "digits": _share(v, "[0-9]"),
        "upper": _share(v, "[A-Z]"),
        "lower": _share(v, "[a-z]"),
        "distinct": (ascii_kinds + other_kinds) / F.least(n, F.lit(ALPHABET)),
        "pairs": F.regexp_count(F.lower(v), F.lit("(?=(?:" + "|".join(language.pairs) + "))")) / n,
        "covered": _share(F.lower(v), "(?:" + "|".join(sorted(language.words, key=lambda w: (-len(w), w))) + ")"),
        "placeholder": _share(F.lower(v), "(?:" + "|".join(PLACEHOLDERS) + ")"),
        "telling": _has(near, TELLING),
        "benign": _has(near, BENIGN),
        "known": v.rlike("(?s)" + KNOWN).cast("double"),
        "path_test": _has(F.col("path"), PATHS_TEST),
        "path_keys": _has(F.col("path"), PATHS_KEYS),
        "longest_word": F.coalesce(longest, F.lit(0)) / n,
        "repeats": _share(v, r"(.)\1{3,}"),
        "hex_digest": v.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$").cast("double"),
        "in_url": (F.col("before").rlike(f"(?:{_USER})$") & F.startswith("after", F.lit("@"))).cast("double"),
    })


def synthetic_findings(spark: SparkSession, n: int = 6000, seed: int = 11, language: Language = Language()) -> DataFrame:
    """Labelled findings: label 1 is a secret."""
    r = random.Random(seed)
    known = [w for w in language.words if w.isascii() and len(w) >= 4] or list(DICTIONARY)
    hexa, alnum, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "sch", "ung", "keit", "lich", "eau", "ment", "que", "tion", "ción", "mente", "ar", "os"]

    def some(chars: str, lo: int, hi: int | None = None) -> str:
        return "".join(r.choice(chars) for _ in range(r.randint(lo, hi or lo)))

    def word(k: int | None = None) -> str:
        return "".join(r.choice(syllables) for _ in range(k or r.randint(1, 5)))

    def prose(k: int) -> str:
        return " ".join(word() for _ in range(k))

    def spoken() -> str:
        return r.choice(known) if r.random() < 0.7 else word(r.randint(2, 4))

    def glued(k: int) -> str:
        sign = r.choice(["", "", "", "-", "_", "."])
        return sign.join(spoken() for _ in range(k))

    def assignment() -> str:
        name = r.choice(["password", "passwd", "Passwort", "Kennwort", "contraseña", "mot de passe", "passphrase", "secret", "token", "api_key", "apikey", "access_key", "client_secret", "auth_token", "API_KEY", "DB_PASSWORD", "Token", "credentials"])
        return name + r.choice(["=", " = ", ": ", ' = "', "='", '": "', ":", " is ", " : ", "    =   "])

    def in_url() -> str:
        return r.choice(["postgres", "https", "mysql", "redis", "amqp", "ftp"]) + "://" + r.choice(["user", "admin", "app", "root", ""]) + ":"

    secrets = [
        lambda: (some(hexa, r.choice([16, 18, 24, 32, 40, 40, 64])), assignment()),
        lambda: (some(alnum, 8, 44), assignment()),
        lambda: (some(b64, 20, 60) + r.choice(["", "=", "=="]), assignment()),
        lambda: (some(alnum + "!@$%^&*-_", 8, 24), assignment()),
        lambda: (glued(r.randint(4, 6)), assignment()),
        lambda: ("".join(word(r.randint(1, 3)) for _ in range(r.randint(4, 5))), assignment()),
        lambda: (spoken() + some(string.digits, 1, 4) + spoken() + some(string.digits + "!$%&", 1, 4), assignment()),
        lambda: (spoken().capitalize() + some(string.digits + "&!$-", 1, 3) + some(alnum, 2, 6), assignment()),
        lambda: (r.choice([some(alnum + "!$%-_", 6, 20), spoken() + some(string.digits, 2, 4), some(alnum, 8, 16)]), in_url()),
        lambda: ("-----BEGIN RSA PRIVATE KEY-----\n" + some(b64, 400, 2000) + "\n-----END RSA PRIVATE KEY-----", ""),
        lambda: (r.choice(["AKIA", "ASIA"]) + some(string.ascii_uppercase + string.digits, 16), r.choice(["", "", "aws_access_key_id = ", "key "])),
        lambda: (r.choice(["ghp_", "gho_", "ghs_"]) + some(alnum, 36), r.choice(["", assignment()])),
        lambda: ("sk_live_" + some(alnum, 24), r.choice(["", assignment()])),
        lambda: ("AIza" + some(alnum + "_-", 35), r.choice(["", assignment()])),
        lambda: ("-----BEGIN RSA PRIVATE KEY-----\n" + some(b64, 200, 380), ""),
    ]
    others = [
        lambda: (r.choice(["changeme", "password", "example", "your_api_key_here", "your-token-here", "xxxxxxxx", "********", "placeholder", "insert_token_here", "undefined", "string,", "required", "optional", "${PASSWORD}", "{{token}}", "$TOKEN", "process.env.TOKEN", "os.environ[KEY]", "example_token", "test1234", "password123", "default-secret"]), assignment()),
        lambda: (word(r.randint(2, 4)), assignment()),
        lambda: (word() + "_" + word() + "()", assignment()),
        lambda: (spoken() + r.choice(["", ".", "?", ")", ",", "!"]), assignment()),
        lambda: (spoken() + r.choice(["-", "_", "."]) + spoken(), assignment()),
        lambda: (r.choice(["password", "PASSWORD", "pass", "secret", "changeme", "${DB_PASS}", "<password>", "your-password", "xxxx", "****"]), in_url()),
        lambda: (some(string.digits, 16, 19), r.choice(["", "card ", "order ", "call "])),
        lambda: (some(hexa, r.choice([32, 40, 64])), r.choice(["commit ", "sha1: ", "sha256 ", "md5 ", "checksum: ", "digest=", "revision "])),
        lambda: ("-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), r.choice(["uuid ", "id ", "guid: ", "", "request "])),
        lambda: (word(4) + "-" + word(3) + str(r.randint(1, 99)), ""),
        lambda: ("/".join([word(2), word(2), word(2) + str(r.randint(1, 2030))]), r.choice(["", "path ", "see "])),
        lambda: (f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}-{word(3)}", ""),
        lambda: ("=" * r.randint(12, 40) + str(r.randint(0, 9)) + "=" * 4, ""),
        lambda: ("_".join(word(2) for _ in range(3)) + str(r.randint(0, 9)), ""),
        lambda: (word(5) + some(string.digits, 1, 4), ""),
        lambda: (r.choice("abcx0") * r.randint(12, 40) + "1", r.choice(["", assignment()])),
        lambda: (word(2).upper() + str(r.randint(1, 9)) + "-" + word(3).upper(), ""),
    ]
    rows = []
    for i in range(n):
        label = i % 2
        value, name = r.choice(secrets if label else others)()
        path = f"src{r.randint(0, 30)}" if r.random() < 0.6 else r.choice(["app/config.yaml", "deploy/.env", "src/main.py", "README.md"] if label or r.random() < 0.5 else ["tests/test_auth.py", "docs/example.md", "fixtures/sample.json", "package-lock.json"])
        tail = "@" + word(2) + ".example.org/" + word() if "://" in name else f"{r.choice(['', chr(34), ' '])} {prose(5)}"
        rows.append((value, f"{prose(6)} {name}", tail, path, float(label)))
    return spark.createDataFrame(rows, "value string, before string, after string, path string, label double")


def train(labelled: DataFrame, language: Language = Language(), trees: int = 40, depth: int = 9, seed: int = 5) -> Judge:
    """labelled: value, before, after, path, label. Of more than MAX_TRAINING rows those with the smallest hashes are used."""
    chosen = labelled.orderBy(F.xxhash64("value", "before", "after", "path"), "value", "before", "after", "path", "label").limit(MAX_TRAINING)
    ready = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(features(chosen, language))
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8)
    return Judge(forest.fit(ready), language)


def _cut(text: Column) -> tuple[Column, Column]:
    """The candidates of a text, and the gaps before, between and after them."""
    return F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)


def _lead(gap: Column, hit: Column, after: Column) -> Column:
    """The name and sign, or the user of a URL, that a candidate begins with."""
    in_url = F.endswith(gap, F.lit("://")) & F.startswith(after, F.lit("@")) & hit.rlike(r"^[^\s/?#@:\"'<>]*:[^\s/@\"'<>]*$")
    return F.when(in_url, F.regexp_extract(hit, "^[^:]*:", 0)).otherwise(F.regexp_extract(hit, f"^{_LEAD}", 0))


def candidates(docs: DataFrame, keys: list[str], text_col: str, path: Column) -> DataFrame:
    """keys, i (number in the text), start (code points from 0), lead_length, value, before, after, path; keys must name a row."""
    text = F.col(text_col)
    hits, gaps = _cut(text)
    cut = docs.filter(text.rlike(LIKELY)).select(*keys, path.cast("string").alias("path"), hits.alias("hits"), gaps.alias("gaps"))
    sides = F.arrays_zip(F.col("hits").alias("hit"), F.slice("gaps", 1, F.size("hits")).alias("gap"), F.slice("gaps", 2, F.size("hits")).alias("after"))
    each = cut.select(*keys, "path", F.posexplode(sides).alias("i", "x")).select(*keys, "path", "i", "x.*")
    each = each.withColumn("lead", _lead(F.col("gap"), F.col("hit"), F.col("after")))
    told = each.select(
        *keys, "path", "i", F.char_length("gap").alias("gap_length"), F.char_length("hit").alias("hit_length"), F.char_length("lead").alias("lead_length"),
        F.concat(F.right("gap", F.lit(CONTEXT)), "lead").alias("before"), F.left("after", F.lit(CONTEXT)).alias("after"), F.substring(F.col("hit"), F.char_length("lead") + 1, F.char_length("hit")).alias("value"),
    )
    so_far = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("gap_length") + F.col("hit_length")).over(so_far) - F.col("hit_length") + F.col("lead_length")
    return told.select(*keys, "path", "i", start.alias("start"), "lead_length", "before", "after", "value")


def judge(found: DataFrame, model: Judge, threshold: float = 0.5) -> DataFrame:
    """Adds probability and is_secret."""
    ready = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(features(found, model.language))
    scored = model.forest.transform(ready).withColumn("probability", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.withColumn("is_secret", F.col("probability") >= threshold)


def scan(docs: DataFrame, model: Judge, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """One row per candidate: row, doc_id, start, length, value_sha256, shown (first four characters), probability, is_secret. Without the path column, paths are null."""
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.col(path_col) if path_col in docs.columns else F.lit(None)).cast("string").alias("path"))
    found = judge(candidates(base, ["row", "doc_id"], "text", F.col("path")), model, threshold)
    return found.select("row", "doc_id", F.col("start").cast("long").alias("start"), F.char_length("value").cast("long").alias("length_chars"), F.sha2("value", 256).alias("value_sha256"), F.left("value", F.lit(4)).alias("shown"), "probability", "is_secret")


def redact(docs: DataFrame, model: Judge, text_col: str = "text", path_col: str | None = "source", chars_col: str | None = "n_chars", threshold: float = 0.5) -> DataFrame:
    """All rows and columns; secrets in the text are replaced by MASK and the length column, if there is one, follows.

    Texts without a candidate pass through without a shuffle; only the others meet their findings. A text is put together
    again from its gaps and candidates, each of which knows whether it is masked, in one pass.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, count = f"c{names.index(text_col)}", f"c{names.index(chars_col)}" if chars_col in names else None
    path = F.col(f"c{names.index(path_col)}") if path_col in names else F.lit(None)
    likely = F.coalesce(F.col(text).rlike(LIKELY), F.lit(False))
    tmp = Scratch(docs.sparkSession, "secret-scan")
    suspects = tmp.keep(plain.filter(likely).withColumn("row", F.monotonically_increasing_id()), "suspects")
    told = judge(candidates(suspects, ["row"], text, path), model, threshold)
    kept = F.when(F.col("is_secret"), F.col("lead_length")).otherwise(F.lit(-1))  # how much of a masked candidate stays
    marks = told.groupBy("row").agg(F.max("is_secret").alias("any"), F.transform(F.array_sort(F.collect_list(F.struct("i", kept.alias("kept")))), lambda x: x["kept"]).alias("marks"))
    met = suspects.join(tmp.keep(marks.filter("any").select("row", "marks"), "marks"), "row", "left").drop("row")
    hits, gaps = _cut(F.col(text))
    new = F.zip_with(hits, "marks", lambda hit, kept: F.when(kept < 0, hit).otherwise(F.concat(F.left(hit, kept), F.lit(MASK))))
    whole = F.array_join(F.zip_with(gaps, new, lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit("")))), "")  # the last gap has no candidate after it
    met = met.withColumn(text, F.when(F.col("marks").isNull(), F.col(text)).otherwise(whole)).drop("marks")
    if count:
        met = met.withColumn(count, F.when(F.col(count).isNotNull(), F.char_length(text)).cast(plain.schema[count].dataType))
    return plain.filter(~likely).unionByName(met).toDF(*names)

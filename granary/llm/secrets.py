"""Secret scans: a random forest over candidates, native DataFrame functions only.

Candidates are runs of at least ``LEAST`` characters of the base64, hex and identifier alphabets, with or without digits;
after a secret word or an assignment to one, runs of ``SHORT`` or more of any signs that are no blanks (up to the quote if it is
quoted); after any other assignment such runs up to the next separator. The forest decides, not the expression. The
text is cut at its candidates by one pass of the expression, so each knows what stands before and behind it. Features: length, share and kind of
characters and the transitions between kinds, variety of characters, coverage by the corpus's own dictionary, whether it
is part of a path, address or number, and the words next to it. A random forest trained from labelled findings removes
false positives; findings it keeps are reported, and ``redacted`` replaces them at their places in the text.

There is no table of labelled secrets, so ``labelled_findings`` makes one: templates filled with digests as secrets or
as look-alikes (checksums, commits, identifiers, numbers, addresses, words), a fixed number of rows. It is a parameter of the scan.

The dictionary holds the corpus's alphabetic words, counted over all documents. Null and empty texts have no candidates.
Repeated rows are scanned each; rows with a null id are scanned too. What is found depends on the text alone, so ``redacted``
keys it by the id and the digest of the text: rows that share an id, or have none, do not touch each other's texts. Other
columns are not looked at and pass through ``redacted``. An empty table gives no findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import fresh, saved

#: Characters of the shortest candidate, and of one behind an assignment or a secret word; documents a dictionary word occurs in; labelled findings; trees and their depth.
LEAST, SHORT, KNOWN_FROM, LABELLED, TREES, DEPTH, SEED = 12, 4, 5, 6_000, 30, 7, 17
MASK = "[SECRET]"
# Fixed word lists of the neighbourhood features.
SECRET_WORDS = r"(?i)(password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|bearer|private)"
PLAIN_WORDS = r"(?i)(commit|sha\d*|md5|checksum|digest|uuid|guid|version|order|phone|call|invoice|example|sample|isbn|etag|revision)"

_CHARS = r"[A-Za-z0-9+/_-]"
# Names of secrets by length: a look behind has a fixed width in some engines. A tuple per length keeps them readable.
_NAMES = (("pwd",), ("auth", "pass"), ("token",), ("secret", "passwd", "bearer", "apikey"), ("api_key", "api-key", "private"), ("password",),
          ("accesskey",), ("access_key", "access-key", "secret_key", "secret-key", "credential"), ("private_key", "private-key", "credentials"))
_BLANK, _SIGN, _FREE = r"[ \t]", r"[^\x00-\x20]", r"[^\x00-\x20\"']"
# What stands between a name and its value, by the end that a position is looked at for first; the last only behind names.
_BETWEEN = (("[=:]", ("[=:]", "[:=]=", f"{_BLANK}[=:]", "[\"'][=:]")),
            (f"[=:]{_BLANK}", (f"[=:]{_BLANK}", f"{_BLANK}[=:]{_BLANK}", f"[\"'][=:]{_BLANK}")), (f"[=:]{_BLANK}{{2}}", (f"[=:]{_BLANK}{{2}}",)),
            (f"(?:[Ww][Dd]|[Tt][Hh]|[Ss][Ss]|[Ee][NnTtRrYy]|[Tt][Ee]|[Rr][Dd]|[Aa][Ll]|[Ll][Ss]|is){_BLANK}", (_BLANK, f"{_BLANK}is{_BLANK}")))


def _behind_name(quote: str) -> str:
    """Positions behind a name of a secret, what assigns it and the quote."""
    names = lambda between: "|".join(f"(?<=(?:(?i:{'|'.join(n)})){between}{quote})" for n in _NAMES)
    return "(?:" + "|".join(f"(?<={end}{quote})(?:" + "|".join(map(names, all_)) + ")" for end, all_ in _BETWEEN) + ")"


# The scheme of a header and the two slashes of an address are no values.
_VALUE = r"(?!(?i:bearer|basic)[ \t])(?!//)"
_QUOTE = "[\"']"
CANDIDATE = "|".join((
    rf"(?<=[=: \t\"'])(?:(?<={_QUOTE}){_behind_name(_QUOTE)}{_VALUE}{_FREE}{{{SHORT},}}+|(?<!{_QUOTE}){_behind_name('')}{_VALUE}(?![\"'=:]){_SIGN}{{{SHORT},}}+"
    rf"|(?:(?<=[=:])|(?<=[=:]{_BLANK})|(?<=[=:]{_QUOTE})|(?<=[=:]{_BLANK}{_QUOTE})){_VALUE}[^\x00-\x20\"'&,;:=<>(){{}}\[\]]{{{SHORT},}}+={{0,2}})",
    rf"(?<!{_CHARS}){_CHARS}{{{LEAST},}}+={{0,2}}"))
CONTEXT = 40
#: The mark put around candidates, and what stands for it where the text has it.
CUT, INSTEAD = "\x01", "\x02"
FEATURES = ("length", "lower_share", "upper_share", "digit_share", "transitions", "variety", "entropy", "longest_letters",
            "is_hex", "is_number", "dictionary", "path", "address", "assigned", "quoted", "secret_near", "plain_near", "named", "equals", "signs")


def candidates(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, columns to keep, nth, start (characters before it), value, before, after: one row per candidate of (doc_id, text)."""
    # no candidate holds a control character, so one of them can mark where candidates begin and end; the text's own become another
    marked = F.regexp_replace(F.translate("text", CUT, INSTEAD), CANDIDATE, f"{CUT}$0{CUT}")
    cut = docs.select("doc_id", *keep, F.split(marked, CUT, -1).alias("pieces"))
    piece = lambda i: F.get("pieces", i)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, i: Column) -> Column:
        place = state["at"] + F.char_length(piece(2 * i))
        return F.struct((place + F.char_length(piece(2 * i + 1))).alias("at"), F.array_append(state["out"], place).alias("out"))
    found = F.floor((F.size("pieces") - 1) / 2).cast("int")
    number = F.when(found > 0, F.sequence(F.lit(0), found - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.aggregate(number, begin, step, lambda s: s["out"])
    one = F.explode(F.zip_with(number, starts, lambda i, at: F.struct(
        i.alias("nth"), at.alias("start"), piece(2 * i + 1).alias("value"),
        F.substring(piece(2 * i), -CONTEXT, CONTEXT).alias("before"),
        F.substring(piece(2 * i + 2), 1, CONTEXT).alias("after"))))
    return cut.select("doc_id", *keep, one.alias("c")).select("doc_id", *keep, "c.*")


def dictionary(docs: DataFrame) -> DataFrame:
    """Words of letters in lower case that occur in at least ``KNOWN_FROM`` documents."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    return docs.where("text IS NOT NULL").select(F.explode(words).alias("word")).groupBy("word").count().where(
        (F.col("count") >= KNOWN_FROM) & (F.length("word") >= 3)).select("word")


def _covered(found: DataFrame, words: DataFrame) -> DataFrame:
    """value and the share of its characters in runs of letters that are dictionary words, for distinct values."""
    values = found.select("value").distinct()
    runs = values.select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    known = runs.join(words, "word").groupBy("value").agg(F.sum(F.length("word")).alias("known_chars"))
    return known.select(F.col("value").alias("known_value"), (F.col("known_chars") / F.length("known_value")).alias("dictionary"))


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """The candidates and the columns of ``FEATURES``."""
    value, n = F.col("value"), F.length("value")
    kinds = F.translate(value, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "l" * 26 + "u" * 26 + "d" * 10)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    flag = lambda test: F.when(test, 1.0).otherwise(0.0)
    signs = F.array_distinct(F.split(value, ""))
    entropy = F.aggregate(signs, F.lit(0.0), lambda acc, c: F.when(c == "", acc).otherwise(
        acc - (n - F.length(F.replace(value, c, F.lit("")))) / n * F.log2((n - F.length(F.replace(value, c, F.lit("")))) / n)))
    longest = F.array_max(F.transform(F.split(kinds, "[^lu]+"), lambda r: F.length(r)))
    token_before, token_after = F.regexp_extract("before", r"(\S*)$", 1), F.regexp_extract("after", r"^(\S*)", 1)
    table = found.join(_covered(found, words), F.col("value") == F.col("known_value"), "left").drop("known_value")
    return table.select(
        *[c for c in table.columns if c != "dictionary"], n.cast("double").alias("length"), (count(kinds, "l") / n).alias("lower_share"),
        (count(kinds, "u") / n).alias("upper_share"), (count(kinds, "d") / n).alias("digit_share"),
        (count(kinds, "l(?=[ud])|u(?=[ld])|d(?=[lu])") / n).alias("transitions"),
        (F.size(signs) / n).alias("variety"), entropy.alias("entropy"), longest.cast("double").alias("longest_letters"),
        flag(value.rlike("^([0-9a-f]+|[0-9A-F]+)$")).alias("is_hex"), flag(value.rlike("^[0-9_-]+$")).alias("is_number"),
        F.coalesce("dictionary", F.lit(0.0)).alias("dictionary"),
        (count(value, "/") + count(F.concat(token_before, F.lit(" "), token_after), r"[/\\]")).alias("path"),
        flag(F.concat(token_before, F.lit(" "), token_after).rlike(r"@|\.[a-z]{2,}|://")).alias("address"),
        flag(F.col("before").rlike(r"[=:]\s*[\"']?$")).alias("assigned"),
        flag(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).alias("quoted"),
        flag(F.col("before").rlike(SECRET_WORDS)).alias("secret_near"), flag(F.col("before").rlike(PLAIN_WORDS)).alias("plain_near"),
        flag(F.col("before").rlike(SECRET_WORDS + r"[\w-]*[\"']?\s*(is\s|[=:]*)\s*[\"']?$")).alias("named"), flag(F.col("before").rlike("=\\s*[\"']?$")).alias("equals"),
        (count(value, "[^A-Za-z0-9/_-]") / n).alias("signs"))


def labelled_findings(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """doc_id, text, label, template: secrets (1) and look-alikes (0), filled with digests of the row number."""
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("doc_id").cast("string")), 256)
    pick = lambda salt, *of: F.element_at(F.array(*map(F.lit, of)), F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(len(of))).cast("int") + 1)
    up = F.translate(F.upper(digest("k")), "0189", "GHJK")
    mixed = F.substring(F.translate(F.base64(F.unhex(digest("m"))), "+/=", "xYz"), 1, 36)
    digits = F.substring(F.translate(digest("n"), "abcdef", "104729"), 1, 16)
    caps = F.translate(F.upper(digest("c")), "0123456789", "QWRTYUIOPS")
    letters = F.translate(mixed, "0123456789", "qWeRtYuIoP")
    lower = F.translate(digest("l"), "0123456789", "ghijkmorst")
    signs = lambda at, n: F.concat(F.substring(mixed, at, 4), pick("s", "!", "$", "&", "#", "@", "%", "*"), F.substring(mixed, at + 5, n),
                                   pick("t", "!", "#", "&", "?", "^", "~"), F.substring(digits, 1, 1))
    word = pick("w", "account", "the", "value", "in", "server", "and", "para", "der", "service", "que")
    name = lambda salt: pick(salt, "correct", "horse", "battery", "staple", "summer", "winter", "dragon", "monkey", "garden", "purple")
    usual = pick("u", "required", "expired", "changed", "policy", "recovery", "missing", "meeting", "garden", "property", "hidden", "invalid", "of", "ring", "information")
    long = pick("v", "internationalisation", "responsabilidades", "Authorization", "characteristically", "Geschwindigkeit", "well-established", "infrastructure",
                "state-of-the-art", "recommendation", "Verantwortung", "institutionnelle", "max_connections", "communication", "naturalmente", "and/or-something")
    say = lambda *parts: F.concat(word, F.lit(" "), *(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit(" "), word)
    hex_ = lambda n: F.substring(digest("h"), 1, n)
    size = F.pmod(F.xxhash64("doc_id"), F.lit(60)).cast("int") + 12
    secret = (say("AKIA", F.substring(up, 1, 16)), say('token = "', hex_(40), '"'), say("password=", hex_(18)), say("api_key: ", mixed),
              say('secret = "', mixed, '"'), say("Auth: Bearer ", mixed), say("AKIA", F.substring(up, 9, 16), "."),
              say("passwd: ", F.substring(mixed, 1, 16)), say("access_key=", F.upper(F.substring(mixed, 1, 20))), say("ghp_", mixed),
              say("AKIA", F.substring(caps, 1, 16)), say("password=", F.lower(F.substring(mixed, 3, 7)), F.substring(digits, 2, 2)),
              say("password=", signs(2, 6)), say("passwd: ", name("a"), "_", name("b"), "_", name("c")), say("pwd=", F.substring(lower, 1, 10)),
              say('secret_key: "', signs(9, 8), '"'), say("password ", name("a"), F.substring(digits, 1, 3)), say("token: ", F.substring(letters, 1, 24)),
              say("password is ", signs(5, 5)), say("api-key '", F.substring(mixed, 1, 20), "'"), say("password: ", name("a"), "-", name("b"), F.substring(digits, 1, 2)),
              say('"password": "', signs(1, 3), '"'))
    plain = (say("commit ", hex_(40)), say("sha1: ", hex_(40)), say("md5 checksum ", hex_(32)), say("+", digits), say(digits),
             say("https://example.org/files/", hex_(16), "/index"), say("name", F.substring(digits, 1, 12), "@mail.example.com"),
             say("order-", F.substring(digits, 1, 12)), say("lib/module_", F.substring(digits, 1, 4), "/component"),
             say("uuid ", F.substring(digest("u"), 1, 8), "-", F.substring(digest("u"), 9, 4), "-4", F.substring(digest("u"), 14, 3)),
             say(F.substring(lower, 1, 14)), say(long), say("note: ", usual), say("the secret ", usual), say("token ", usual), say("password ", usual), say("password: ", usual),
             say("width=", F.substring(digits, 1, 4)), say(F.upper(long)), F.repeat(pick("r", "-", "_", "/", "+"), size), say("src/", name("a"), "/", name("b"), "/component"),
             F.repeat(pick("x", "x", "a", "A", "ha"), size), say("mode = '", usual, "'"), say("date: 2024-0", F.substring(digits, 1, 1), "-1", F.substring(digits, 2, 1)),
             say("Password: ", long), say("private ", long))
    kind = F.pmod(F.col("doc_id"), F.lit(len(secret) + len(plain)))
    text = F.coalesce(*(F.when(kind == i, t) for i, t in enumerate((*secret, *plain))))
    return spark.range(rows).withColumnRenamed("id", "doc_id").select(
        "doc_id", text.alias("text"), (kind < len(secret)).cast("int").alias("label"), kind.cast("int").alias("template"))


def train(findings: DataFrame, words: DataFrame) -> RandomForestClassificationModel:
    """A forest from (doc_id, text, label); findings of a text carry its label."""
    rows = features(candidates(findings).join(findings.select("doc_id", "label"), "doc_id"), words)
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(saved(rows, "labelled"))
    return RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(data)


def scan(docs: DataFrame, findings: DataFrame | None = None, *keep: str) -> DataFrame:
    """doc_id, columns to keep, nth, start, value, score, is_secret: all candidates of the documents, scored."""
    spark = docs.sparkSession
    words = saved(dictionary(docs), "dictionary")
    model = train(labelled_findings(spark) if findings is None else findings, words)
    rows = features(saved(candidates(docs, *keep), "candidates"), words)
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", *keep, "nth", "start", "value", score.alias("score"), (score >= 0.5).cast("int").alias("is_secret"))


def redacted(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """All columns of the documents; secrets are replaced in the text at their places, and n_chars follows if there.

    Candidates of one text whose value is that of a secret found in it are replaced as well; parts of other words never are.
    """
    id_name, key_name, places, own = fresh(docs, "id_of_finding", "text_of_finding", "secret_places", "text_key")
    texts = docs.select("doc_id", "text", F.sha2("text", 256).alias("text_key"))
    found = scan(texts, findings, "text_key")
    # copies of a row repeat its places; sets are combined before the shuffle
    by_value = found.groupBy("doc_id", "text_key", "value").agg(
        F.max("is_secret").alias("is_secret"), F.collect_set("start").alias("starts"))
    bad = by_value.where("is_secret = 1").select("doc_id", "text_key", F.transform("starts", lambda at: F.struct(
        at.alias("start"), F.char_length("value").alias("length"))).alias("found")).groupBy(
        F.col("doc_id").alias(id_name), F.col("text_key").alias(key_name)).agg(
        F.array_sort(F.flatten(F.collect_list("found"))).alias(places))

    def step(state: Column, place: Column) -> Column:
        clean = F.substring(F.col("text"), state["at"] + 1, place["start"] - state["at"])
        return F.struct((place["start"] + place["length"]).alias("at"), F.array_append(state["out"], F.concat(clean, F.lit(MASK))).alias("out"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    masked = F.aggregate(places, begin, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(
        F.col("text"), s["at"] + 1, F.char_length("text"))))
    rows = docs.withColumn(own, F.sha2("text", 256)).join(
        bad, F.col("doc_id").eqNullSafe(F.col(id_name)) & (F.col(own) == F.col(key_name)), "left")
    rows = rows.withColumn("text", F.when(F.col(places).isNull(), F.col("text")).otherwise(masked))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(places).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))

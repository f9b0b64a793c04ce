"""Secret scans: candidate strings, judged by a random forest. Native functions only.

Candidates are long unbroken runs of key characters, whatever is assigned to a
name that tells of a secret, and passwords in addresses. The forest sees a
candidate's length, its character classes and the changes between them, how
much of it dictionary words cover, whether it stands in a path or address, and
the words next to it; it removes the findings that are no secrets.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, text_digest

#: What a candidate looks like, and words that announce one.
HINTS = r"(?i)(api[_-]?key|access[_-]?key|secret|token|passw(or)?d|pwd|credential|bearer|private[_-]?key|auth)"
#: What follows a hint and an assignment, in any characters up to a blank or quote, but for the stops that end it;
#: passwords in addresses; and long runs of key characters anywhere. The short look-behinds spare the long ones.
CANDIDATE = (
    r"(?<=[=:][\s\"']{0,3})(?<=(?i:key|secret|token|passwd|password|pwd|credential|credentials|auth)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)[^\s\"'=:][^\s\"']{6,}[^\s\"'.,;:)\]}>]"
    r"|(?<=:)(?<=://[^\s/:@]{0,64}:)[^\s/:@]{8,128}(?=@)"
    r"|(?<![\p{L}\p{N}_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}(?![\p{L}\p{N}_])"
)
CHECKSUM_HINTS = r"(?i)(commit|sha-?\d*|md5|checksum|digest|revision|hash|uuid|etag)"
PLACEHOLDER = r"(?i)(example|placeholder|your|xxxx|changeme|dummy|0000000|1234567)"
#: Characters of context on either side; occurrences that make a corpus word a dictionary word.
CONTEXT, MIN_COUNT = 40, 5
#: Labelled findings made for training, trees and depth.
TRAIN_ROWS, TREES, DEPTH = 6_000, 24, 7
#: Corpus words that training findings are made of, at most; the probability from which a finding is a secret.
TRAIN_WORDS, LEAST = 300, 0.5
FEATURES = ["f_length", "f_digits", "f_upper", "f_hex", "f_distinct", "f_changes", "f_symbols", "f_words", "f_path", "f_hint", "f_assigned", "f_quoted", "f_checksum", "f_placeholder", "f_address", "f_hint_right"]


def candidates(docs: DataFrame) -> DataFrame:
    """``key, source, candidate, place, left, right`` for each match in each text, ``source`` naming the text; whole texts.

    The work grows with the text, also where it is full of candidates: contexts
    are joined from the ends of the few pieces next to a match, and places are
    sums over blocks of matches, not over all matches before.
    """
    # Each inline of one struct keeps what it holds from being computed again for every use.
    found = docs.select("key", "text", F.inline(F.array(F.struct(F.regexp_extract_all("text", F.lit(CANDIDATE), 0).alias("matches"))))).where("size(matches) > 0")
    cut = found.select("key", F.xxhash64("text").alias("source"), "matches", F.inline(F.array(F.struct(F.split("text", CANDIDATE, -1).alias("between")))))
    sizes = cut.select(
        "key", "source", "matches", "between",
        F.inline(F.array(F.struct(
            F.expr(f"transform(between, b -> right(b, {CONTEXT}))").alias("ends"),
            F.expr(f"transform(between, b -> left(b, {CONTEXT}))").alias("starts"),
            F.expr("transform(matches, (m, i) -> length(between[i]) + length(m))").alias("steps"),
            F.expr("cast(ceil(sqrt(size(matches))) as int)").alias("w"),
        ))),
    )
    total = "aggregate({}, 0, (s, x) -> s + x)"
    blocks = sizes.withColumn("sums", F.expr(f"transform(sequence(0, (size(matches) - 1) div w), b -> {total.format('slice(steps, cast(b * w + 1 as int), w)')})"))
    heads = blocks.select("*", F.inline(F.array(F.struct(F.expr(f"transform(sums, (x, b) -> {total.format('slice(sums, 1, b)')})").alias("heads")))))
    place = f"heads[cast(i div w as int)] + {total.format('slice(steps, cast((i div w) * w + 1 as int), cast(i % w as int))')} + length(between[i]) + 1"
    # A candidate and what parts it from the next have 9 characters at least.
    far = -(-CONTEXT // 9)
    left = f"right(array_join(transform(sequence(greatest(0, i - {far}), i), j -> concat(ends[j], if(j < i, matches[j], ''))), ''), {CONTEXT})"
    right = f"left(array_join(transform(sequence(i + 1, least(i + 1 + {far}, size(matches))), j -> concat(starts[j], if(j < size(matches), matches[j], ''))), ''), {CONTEXT})"
    return heads.select("key", "source", F.inline(F.expr(f"transform(matches, (m, i) -> struct(m as candidate, cast({place} as int) as place, {left} as left, {right} as right))")))


def _share(pattern: str) -> Column:
    return F.length(F.regexp_replace("candidate", pattern, "")) / F.length("candidate")


def features(rows: DataFrame, dictionary: DataFrame | None) -> DataFrame:
    """Add FEATURES to ``id, candidate, left, right`` (``id`` unique).

    ``dictionary(word)`` has distinct lower-case words; it only meets the letter
    runs of candidates.
    """
    run = F.explode(F.array_distinct(F.expr("filter(split(lower(candidate), '[^a-z]+'), w -> length(w) >= 3)")))
    runs = rows.select("id", run.alias("word"))
    if dictionary is None:
        covered = runs.where("false").groupBy("id").agg(F.sum(F.length("word")).alias("covered"))
    else:
        covered = runs.join(dictionary, "word", "left_semi").groupBy("id").agg(F.sum(F.length("word")).alias("covered"))
    kinds = "regexp_replace(translate(candidate, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', concat(repeat('a', 26), repeat('A', 26), repeat('0', 10))), '[^aA0]', '_')"
    changes = f"length(regexp_replace(regexp_replace(regexp_replace({kinds}, 'a+', 'a'), 'A+', 'A'), '0+', '0'))"
    return rows.join(covered, "id", "left").select(
        *[F.col(f"`{c}`") for c in rows.columns],
        F.length("candidate").cast("double").alias("f_length"),
        _share(r"[^0-9]").alias("f_digits"),
        _share(r"[^A-Z]").alias("f_upper"),
        _share(r"[^0-9a-fA-F]").alias("f_hex"),
        (F.expr("size(array_distinct(split(lower(candidate), '')))") / F.length("candidate")).alias("f_distinct"),
        (F.expr(changes) / F.length("candidate")).alias("f_changes"),
        _share(r"[A-Za-z0-9]").alias("f_symbols"),
        F.least(F.lit(1.0), F.coalesce(F.col("covered"), F.lit(0)) / F.length("candidate")).alias("f_words"),
        F.expr(r"cast(left rlike '(://|www\\.|@|[/\\\\.])\\S*$' or right rlike '^[/\\\\.]\\w' or length(candidate) - length(replace(candidate, '/', '')) >= 3 as double)").alias("f_path"),
        F.col("left").rlike(HINTS).cast("double").alias("f_hint"),
        F.col("left").rlike(r"[=:]\s*[\"']?$").cast("double").alias("f_assigned"),
        F.col("left").rlike(r"[\"']$").cast("double").alias("f_quoted"),
        F.col("left").rlike(CHECKSUM_HINTS).cast("double").alias("f_checksum"),
        F.col("candidate").rlike(PLACEHOLDER).cast("double").alias("f_placeholder"),
        (F.col("left").rlike(r"://[^\s/:@]*:$") & F.col("right").startswith("@")).cast("double").alias("f_address"),
        F.col("right").rlike(HINTS).cast("double").alias("f_hint_right"),
    )


def labelled_findings(spark: SparkSession, words: list[str], rows: int = TRAIN_ROWS, first: int = 0) -> DataFrame:
    """Labelled findings by rule: ``id, candidate, left, right, label`` with ``id`` from ``first`` on.

    Secrets are random keys of the usual shapes, mostly announced by a word, and
    passwords with signs, also in addresses; the others are words (of ``words`` and unknown ones), checksums, addresses,
    placeholders and repeated characters in the places where those occur.
    """
    base = spark.range(first, first + rows).select("id", F.sha2(F.col("id").cast("string"), 512).alias("h"), F.pmod(F.xxhash64("id"), F.lit(997)).alias("r"))
    if words:
        known, many = F.array(*[F.lit(w) for w in words]), F.lit(len(words))  # the words stand in the plan once
        picked = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.element_at(known, (F.pmod(F.xxhash64(k, "id"), many) + 1).cast("int")))
        base = base.withColumn("picked", picked)
        base = base.withColumn("phrase", F.when(F.col("r") % 3 == 0, F.array_join("picked", "_")).when(F.col("r") % 3 == 1, F.array_join("picked", "-")).otherwise(F.array_join("picked", "")))
    else:
        base = base.withColumn("phrase", F.lit(None).cast("string"))
    b64 = "translate(base64(unhex(h)), '=', 'A')"
    kind = "id % 16"
    unknown = "substring(translate(h, '0123456789', 'nthersiolu'), 1, 20 + r % 25)"
    # Passwords with signs in them, of 10 to 24 characters, and words with a sign, as people write about passwords.
    signs = f"translate(substring({b64}, 1 + r % 8, 10 + r % 15), element_at(array('/+abcde', 'xyzABC', '/+0123', 'mnopqr'), 1 + cast(r % 4 as int)), element_at(array('!#$%&*?', '@^~!#%', '-_.!@#', '$*?&^~'), 1 + cast(r % 4 as int)))"
    word = f"substring(coalesce(element_at(split(phrase, '[_-]'), 1), {unknown}), 1, 16)"
    candidate = f"""case {kind}
      when 12 then {signs} when 13 then if(r % 2 = 0, {signs}, substring({b64}, 1 + r % 8, 10 + r % 15)) when 14 then concat(rpad({word}, 8, 'ing'), if(r % 3 = 0, '!', ''))
      when 15 then element_at(array('password', 'your_password', 'changeme', 'examplepass', 'placeholder'), 1 + cast(r % 5 as int))
      when 0 then substring(h, 1, 40) when 1 then substring(h, 1, 32 + 8 * (r % 5)) when 2 then substring({b64}, 1, 40)
      when 3 then concat('AKIA', upper(substring(translate(h, '01', 'XY'), 1, 16))) when 4 then concat('ghp_', translate(substring({b64}, 1, 36), '/+', 'ab'))
      when 5 then upper(substring(h, 1, 40))
      when 6 then if(r % 2 = 0, coalesce(phrase, {unknown}), {unknown})
      when 7 then substring(h, 1, 40) when 8 then concat(substring(h, 1, 8), '-', substring(h, 9, 4), '-', substring(h, 13, 4), '-', substring(h, 17, 12))
      when 9 then concat('docs/', translate(substring(h, 1, 6), '0123456789', 'nthersiolu'), '/', translate(substring(h, 7, 8), '0123456789', 'nthersiolu'), '/', substring(h, 20, 4))
      when 10 then element_at(array('your_api_key_goes_here', 'EXAMPLE_EXAMPLE_EXAMPLE', 'xxxxxxxxxxxxxxxxxxxxxxxx', 'changeme_changeme_changeme', 'placeholder_token_value'), 1 + cast(r % 5 as int))
      else element_at(array('--------------------------', '========================', '____________________________', '00000000000000000000000000'), 1 + cast(r % 4 as int)) end"""
    left = f"""case when {kind} in (13, 15) then element_at(array('connect to postgres://admin:', 'see ftp://user:', 'url = "mysql://root:', 'amqp://svc:'), 1 + cast(r % 4 as int))
      when {kind} in (12, 14) then element_at(array('password = "', 'the password: ', 'pwd=', 'secret: ', "passwd: '", 'token = '), 1 + cast(r % 6 as int))
      when {kind} <= 5 then concat(element_at(array('the ', 'with ', 'in ', ''), 1 + cast(r % 4 as int)),
        element_at(array('token = "', 'api_key: ', 'secret="', 'password = "', 'Authorization: Bearer ', 'TOKEN = "', 'export ACCESS_KEY=', 'key = "'), 1 + cast(r % 8 as int)))
      when {kind} = 7 then element_at(array('commit ', 'sha1: ', 'md5 = ', 'revision ', 'checksum: '), 1 + cast(r % 5 as int))
      when {kind} = 8 then element_at(array('uuid ', 'request id: ', 'etag "'), 1 + cast(r % 3 as int))
      when {kind} = 9 then element_at(array('see https://example.org/', 'in ./', 'www.example.com/'), 1 + cast(r % 3 as int))
      when {kind} = 10 then element_at(array('token = "', 'api_key: ', 'password='), 1 + cast(r % 3 as int))
      else element_at(array('and the ', 'wer ', 'est. ', 'los '), 1 + cast(r % 4 as int)) end"""
    return base.select(
        "id", F.expr(candidate).alias("candidate"), F.expr(left).alias("left"),
        F.expr(f"case when {kind} in (13, 15) then '@db.example.org/main' when {kind} in (0, 1, 2, 3, 4, 5, 12) and r % 2 = 0 then '\" and' else ' of the' end").alias("right"),
        F.expr(f"cast({kind} <= 5 or {kind} in (12, 13) as double)").alias("label"),
    )


def assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(rows)


def train(labelled: DataFrame, dictionary: DataFrame | None = None) -> RandomForestClassificationModel:
    """The forest, from a bounded table of labelled findings (``id, candidate, left, right, label``), measured as the scan measures."""
    table = assembled(features(labelled, dictionary))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, cacheNodeIds=False).fit(table.select("features", "label"))


def dictionary_words(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Lower-case words of ASCII letters that occur at least ``min_count`` times in all texts; counted before the shuffle."""
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("length(word) >= 3")
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count).select("word")


def sample_words(words: DataFrame, most: int = TRAIN_WORDS) -> list[str]:
    """Words of the corpus that training findings are made of: those of the smallest hash."""
    return [r["word"] for r in words.where("length(word) between 4 and 12").orderBy(F.xxhash64("word"), "word").limit(most).collect()]


def findings(docs: DataFrame, model: RandomForestClassificationModel | None = None) -> DataFrame:
    """``key, source, candidate, places, probability`` for ``docs(key, text)``; ``source`` names the text of the key.

    Every occurrence is judged by its own context; a candidate has the largest
    probability of any in its text. ``places`` are its positions, from 1, in
    order. Null and empty texts have no findings. Only words and candidates
    move, never texts.
    """
    parts = ["key", "source", "candidate", "place"]
    found = materialise(candidates(docs).withColumn("id", F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(7), *parts).alias("b"))), "secret-candidates")
    words = materialise(dictionary_words(docs), "secret-words")
    model = model or train(labelled_findings(docs.sparkSession, sample_words(words)), words)
    wanted = found.select(F.explode(F.split(F.lower("candidate"), "[^a-z]+")).alias("word")).distinct()
    judged = model.transform(assembled(features(found.dropDuplicates(["id"]), words.join(wanted, "word", "left_semi"))))
    return judged.groupBy("key", "source", "candidate").agg(F.sort_array(F.collect_list("place")).alias("places"), F.max(vector_to_array("probability")[1]).alias("probability"))


def secret_query(docs: DataFrame) -> DataFrame:
    """Every finding of every document with its verdict: ``doc_id, candidate, place, occurrences, probability, is_secret``.

    ``place`` is the first. A repeated row gives its findings once; texts that
    share a doc_id are judged apart, and a candidate at one place in several of
    them gets one row with the largest values. Extra columns are not looked at;
    an empty table gives an empty result.
    """
    found = findings(docs.select(F.col("doc_id").alias("key"), "text"))
    told = found.groupBy(F.col("key").alias("doc_id"), "candidate", F.element_at("places", 1).alias("place")).agg(F.max(F.size("places")).alias("occurrences"), F.max("probability").alias("probability"))
    return told.withColumn("is_secret", F.col("probability") >= LEAST)


def mask_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; other columns and rows stay, whatever their names.

    Only texts that hold a candidate are joined; they are found by their digest,
    so copies are masked alike.
    """
    held = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))
    # Words are counted over all texts, candidates are sought where there are any.
    found = findings(docs.select(text_digest("text").alias("key"), "text").where("text is not null"))
    each = found.select("key", F.explode("places").alias("place"), (F.col("probability") >= LEAST).alias("secret"))
    # One flag a match, in the order of the matches; texts without a secret need none.
    flags = each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "secret"))).alias("found"), F.max("secret").alias("any")).where("any")
    flags = flags.select(F.col("key").alias("__digest_of_secret"), F.col("found.secret").alias("__secret_flags"))
    cut = F.expr("transform(array(struct(regexp_extract_all(text, {0}, 0) as m, split(text, {0}, -1) as b)), e -> array_join(transform(e.b, (x, i) -> concat(x, if(i < size(e.m), if(__secret_flags[i], {1}, e.m[i]), ''))), ''))[0]".format(_literal(CANDIDATE), _literal(mask)))
    clean = F.when(F.col("__secret_flags").isNull(), F.col("text")).otherwise(cut)
    masked = docs.where(held).withColumn("__text_digest", text_digest("text")).join(flags, F.col("__text_digest") == F.col("__digest_of_secret"), "left")
    return docs.where(~held).unionByName(masked.select(*[clean.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]))


def _literal(text: str) -> str:
    return "r'" + text + "'" if "'" not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

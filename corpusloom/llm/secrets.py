"""Secret scan: a random forest over candidate strings removes false findings, in DataFrame functions only.

Candidates are (1) runs of 12 or more key characters with a digit, or of 20 or more without one, (2) whatever is assigned to a
credential word, from 8 characters on, and (3) the opening line of a private key. Every place of a candidate is a finding.
Features of a finding are its length, the shares of its character classes, the transitions between them, how many different
characters it has, how much of it consists of words of a dictionary, what its path says, and which words stand around it. The
dictionary is a table: by default the words that several documents of the corpus hold. The forest (Spark ML, on the JVM)
learns from labelled findings: a table of them (:func:`train`), or findings that :func:`plant` writes into lines of the
corpus, so that their truth is known and both classes are always there.

Plan. One pass over every whole text cuts it into words once, and only candidates leave it. The dictionary is an aggregation
by word with map-side combine, of which only words that occur in candidates are kept. At most ``MAX_TRAIN`` labelled findings
are used for a fit (the lowest by hash), a documented bound; planting takes ``PLANTED`` documents (the lowest by hash) as hosts.

Null text: no candidate. A null path has no path features. Rows that repeat a doc_id give their findings again. An empty
table has no findings. Columns besides doc_id, the text and the path are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stored

RUN = r"[A-Za-z0-9_+/\-]{12,}={0,2}"
LONG_RUN = r"[A-Za-z_+/\-]{20,}"
MAX_TRAIN, TREES, DEPTH, PLANTED = 20_000, 32, 8, 400
#: Documents that must hold a word before it counts as one, and letters that it must have.
MIN_DOCUMENTS, MIN_LETTERS = 3, 4

#: Words before a credential, and words before other numbers and digests.
ASKING = "token secret password passwd pwd passphrase apikey api_key access_key private_key credential bearer auth".split()
CALMING = "phone card page call order invoice sha sha1 sha256 md5 checksum digest commit uuid version example sample isbn revision".split()
#: A credential word that assigns the rest of its word, or the word after it.
ASSIGNS = rf"(?i)({'|'.join(ASKING)})[\"'`]?\s*[:=]+>?\s*[\"'`]?"

FEATURES = ["length", "digits", "upper", "lower", "marks", "transitions", "distinct", "covered", "hex_only", "digits_only", "asks_before", "asks_near", "calms", "assigned", "quoted", "block", "path_test", "path_config"]


def _any(text: Column, words: list[str]) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(words)), F.lit(False)).cast("double")


def candidates(docs: DataFrame, text: str = "text", path: str = "source") -> DataFrame:
    """doc_id, path, word_no, place (inside the word, from 0), kind (run, assigned or block), candidate, head and tail (the
    text of the word before and after it), two words before and one after."""
    words = F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+")

    def run(w: Column) -> Column:
        return (F.length(w) >= 12) & ((w.rlike("[0-9]") & w.rlike(RUN)) | ((F.length(w) >= 20) & w.rlike(LONG_RUN)))

    def asked(w: Column, before: Column, before2: Column) -> Column:
        inside = (F.length(w) >= 10) & (F.contains(w, F.lit("=")) | F.contains(w, F.lit(":"))) & w.rlike(ASSIGNS + r"[^\"'`]{8,}")
        mark = F.endswith(before, F.lit("=")) | F.endswith(before, F.lit(":")) | F.endswith(before, F.lit("=>"))
        after = (F.length(w) >= 8) & mark & (before.rlike(ASSIGNS + "$") | (before.isin("=", ":", "=>", ":=") & F.lower(before2).rlike("(" + "|".join(ASKING) + ")[\"'`]?$")))
        return inside | F.coalesce(after, F.lit(False))

    def found(ws: Column) -> Column:
        block = lambda w: F.startswith(w, F.lit("-----BEGIN"))
        at = F.filter(F.transform(ws, lambda w, i: F.when(run(w) | asked(w, F.get(ws, i - 1), F.get(ws, i - 2)) | block(w), i)), lambda i: i.isNotNull())
        around = lambda i: [F.get(ws, i + k).alias(n) for k, n in ((0, "word"), (-1, "before"), (-2, "before2"), (1, "after"), (2, "after2"), (3, "after3"))]
        return F.transform(at, lambda i: F.struct(i.alias("word_no"), *around(i)))

    where = F.col(path) if path in docs.columns else F.lit(None).cast("string")
    hits = docs.select("doc_id", where.cast("string").alias("path"), F.explode(F.transform(F.array(words), found)[0]).alias("h")).select("doc_id", "path", "h.*")
    w = F.col("word")
    key = F.concat_ws(" ", "word", "after", "after2", "after3")
    block = F.when(key.rlike(r"^-----BEGIN [A-Z ]*PRIVATE KEY-----"), F.array(F.struct(F.lit("block").alias("kind"), F.regexp_extract(key, r"^-----BEGIN [A-Z ]*PRIVATE KEY-----", 0).alias("candidate"), F.lit("").alias("head"), F.lit("").alias("tail"))))
    cut, match = F.split(w, RUN, -1), F.regexp_extract_all(w, F.lit(f"({RUN})"), F.lit(1))
    runs = F.transform(match, lambda c, i: F.struct(F.lit("run").alias("kind"), c.alias("candidate"), F.get(cut, i).alias("head"), F.get(cut, i + 1).alias("tail")))
    runs = F.filter(runs, lambda r: r["candidate"].rlike("[0-9]") | r["candidate"].rlike(f"^{LONG_RUN}=*$"))
    inside = F.regexp_extract(w, ASSIGNS + r"([^\"'`]{8,})", 2)
    value = F.regexp_replace(F.when(inside != "", inside).when(asked(w, F.col("before"), F.col("before2")), F.regexp_replace(w, "^[\"'`]", "")), "[\"'`].*$|[,;]+$", "")
    told = F.when(F.coalesce(F.length(value) >= 8, F.lit(False)) & ~F.exists(runs, lambda r: r["candidate"] == value), F.array(F.struct(F.lit("assigned").alias("kind"), value.alias("candidate"), F.call_function("substring_index", w, value, F.lit(1)).alias("head"), F.lit("").alias("tail"))))
    none = F.filter(runs, lambda r: F.lit(False))
    each = hits.select("doc_id", "path", "word_no", "before", "before2", "after", F.posexplode(F.when(block.isNotNull(), block).otherwise(F.concat(runs, F.coalesce(told, none)))).alias("place", "c"))
    return each.select("doc_id", "path", "word_no", "place", "c.*", "before", "before2", "after")


def corpus_dictionary(docs: DataFrame, found: DataFrame, min_documents: int = MIN_DOCUMENTS, text: str = "text") -> DataFrame:
    """(word): runs of letters in candidates that at least so many documents hold as a word of their own."""
    wanted = found.select(F.explode(_letters(F.col("candidate"))).alias("word")).distinct()
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![0-9a-z_+/=-])[a-z]{{{MIN_LETTERS},20}}(?![0-9a-z_+/=-])"), F.lit(0)))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_documents).join(wanted, "word", "left_semi").select("word")


def _letters(candidate: Column) -> Column:
    """Lower-cased runs of letters of a candidate, cut at changes of case as well."""
    return F.transform(F.regexp_extract_all(candidate, F.lit(rf"[A-Z]?[a-z]{{{MIN_LETTERS - 1},}}|[A-Z]{{{MIN_LETTERS},}}|[a-z]{{{MIN_LETTERS},}}"), F.lit(0)), F.lower)


def with_features(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The findings with FEATURES; ``dictionary`` has a column word (lower case)."""
    runs = found.select("candidate").distinct().select("candidate", F.explode(_letters(F.col("candidate"))).alias("word"))
    known = runs.join(dictionary.select("word").distinct(), "word", "left_semi").groupBy(F.col("candidate").alias("_c")).agg(F.sum(F.length("word")).alias("_known"))
    found = found.join(known, F.col("candidate") == F.col("_c"), "left")
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    change = "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])|(?<=[A-Za-z0-9])(?=[^A-Za-z0-9])"
    near = F.concat_ws(" ", "before2", "before", "head")
    features = {
        "length": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "marks": share("[^A-Za-z0-9]"),
        "transitions": share(change),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "covered": F.least(F.lit(1.0), F.coalesce(F.col("_known"), F.lit(0)) / n),
        "hex_only": F.coalesce(c.rlike("^[0-9a-f]+$") & c.rlike("[a-f]"), F.lit(False)).cast("double"),
        "digits_only": F.coalesce(c.rlike("^[0-9/+\\-]+$"), F.lit(False)).cast("double"),
        "asks_before": _any(F.col("head"), ASKING),
        "asks_near": _any(near, ASKING),
        "calms": _any(F.concat_ws(" ", near, "after"), CALMING),
        "assigned": F.coalesce(F.concat_ws(" ", "before", "head").rlike("[=:]"), F.lit(False)).cast("double"),
        "quoted": F.coalesce(F.col("head").rlike("[\"'`]$"), F.lit(False)).cast("double"),
        "block": (F.col("kind") == "block").cast("double"),
        "path_test": _any(F.col("path"), ["test", "example", "fixture", "sample", "doc"]),
        "path_config": _any(F.col("path"), ["env", "conf", "yml", "yaml", "ini", "settings"]),
    }
    return found.withColumns(features).drop("_c", "_known")


#: What :func:`plant` writes, as (name, whether it is a secret, SQL of its text). R is a random hex string of 64 digits, B a
#: random string in base 64, D its digits, and W1 and W2 are words of the host document.
KINDS = [
    ("hex_token", True, "concat('token = \"', left(R, 40), '\"')"),
    ("hex_secret", True, "concat('client_secret: ', left(R, 32))"),
    ("bare_hex", True, "concat('secret ', left(R, 40))"),
    ("base64_key", True, "concat('api_key=', left(B, 36))"),
    ("base64_bearer", True, "concat('Authorization: Bearer ', left(B, 40))"),
    ("cloud_id", True, "concat('AKIA', upper(translate(left(R, 16), '01', 'XY')))"),
    ("git_token", True, "concat('ghp_', translate(left(B, 36), '+/=', 'abc'))"),
    ("password", True, "concat('password=', left(B, 5), '!', left(D, 3), '&', right(left(B, 9), 3))"),
    ("pass_word_after", True, "concat('passwd: ', W1, left(D, 4), '#', left(B, 3))"),
    ("letters_key", True, "concat('apikey = ', translate(left(B, 32), '0123456789+/=', 'qwertyuiopxyz'))"),
    ("private_key", True, "concat('-----BEGIN ', CASE WHEN left(D, 1) < '5' THEN 'RSA ' ELSE '' END, 'PRIVATE KEY-----\\n', left(B, 60))"),
    ("public_key", False, "concat('-----BEGIN PUBLIC KEY-----\\n', W1)"),
    ("card", False, "concat('card ', left(D, 16))"),
    ("phone", False, "concat('call +', left(D, 12))"),
    ("order", False, "concat('order ', left(D, 14), ' ', W1)"),
    ("commit", False, "concat('commit ', left(R, 40))"),
    ("digest", False, "concat('sha256:', R)"),
    ("checksum", False, "concat('md5 checksum ', left(R, 32))"),
    ("uuid", False, "concat(left(R, 8), '-', substr(R, 9, 4), '-', substr(R, 13, 4), '-', substr(R, 17, 4), '-', substr(R, 21, 12))"),
    ("file", False, "concat('img/', W1, '_', W2, '_', left(D, 6), '.png')"),
    ("link", False, "concat('https://www.example.org/', W1, '-', W2, '/', W2, '-', left(D, 5))"),
    ("identifier", False, "concat(W1, '_', W2, '_', W1, '_id', left(D, 2))"),
    ("release", False, "concat('version ', W1, '-', left(D, 2), '.', left(D, 1), '-build-2024', left(D, 2))"),
    ("long_words", False, "concat(W1, '-', W2, '-', W1, '-', W2)"),
    ("placeholder", False, "concat('password=', W1, W2)"),
    ("asking_text", False, "concat('token: ', W1, W2, W1, ' ', W2)"),
]


def plant(docs: DataFrame, kinds: list[tuple[str, bool, str]] = KINDS, hosts: int = PLANTED, seed: int = 7, text: str = "text", path: str = "source") -> DataFrame:
    """(doc_id, text, path, is_secret, planted): for each of ``hosts`` documents and each kind a line of the document with the
    planted string in its middle. The finding in it is known to be a secret or not."""
    where = (F.col(path) if path in docs.columns else F.lit(None)).cast("string").alias("path")
    h = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id"), F.lit(0)), F.col(text)).alias("h")
    keys = docs.select(h).orderBy("h").limit(hosts).distinct()  # hashes alone meet in one task, not texts
    ws = F.slice(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), 1, 400).alias("ws")
    some = docs.select("doc_id", where, text, h).join(F.broadcast(keys), "h", "left_semi").select("doc_id", "path", ws, "h").dropDuplicates(["h"])
    each = some.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("planted"), F.lit(1.0 if secret else 0.0).alias("is_secret")) for n, secret, _ in kinds])).alias("k")).select("*", "k.*")
    plain = F.filter("ws", lambda w: w.rlike("^[A-Za-z]{4,12}$"))
    salt = F.concat_ws("/", F.lit(seed), F.col("h"), "planted")
    r = F.sha2(salt, 256)
    word = lambda k: F.lower(F.coalesce(F.get(plain, F.pmod(F.xxhash64(salt, F.lit(k)), F.greatest(F.size(plain), F.lit(1))).cast("int")), F.lit(["thing", "other"][k])))
    named = each.select("doc_id", "path", "planted", "is_secret", "ws", "h", r.alias("R"), F.base64(F.unhex(r)).alias("B"), F.concat(*[F.lpad(F.pmod(F.xxhash64(salt, F.lit(k)), F.lit(1_000_000)).cast("string"), 6, "4") for k in range(3)]).alias("D"), word(0).alias("W1"), word(1).alias("W2"))
    written = F.expr("CASE " + " ".join(f"WHEN planted = '{n}' THEN {sql}" for n, _, sql in kinds) + " END")
    at = F.pmod(F.xxhash64(salt, F.lit("at")), F.greatest(F.size("ws") - 6, F.lit(1))).cast("int") + 1
    line = F.concat_ws(" ", F.concat_ws(" ", F.slice("ws", at, 3)), written, F.concat_ws(" ", F.slice("ws", at + 3, 3)))
    return named.select("doc_id", line.alias("text"), "path", "is_secret", "planted", written.alias("written"))


def planted_findings(docs: DataFrame, kinds: list[tuple[str, bool, str]] = KINDS, hosts: int = PLANTED, seed: int = 7, text: str = "text", path: str = "source") -> DataFrame:
    """The findings of :func:`plant`'s lines inside what was planted, with is_secret and planted; host words' own are left out."""
    lines = plant(docs, kinds, hosts, seed, text, path)
    keyed = stored(lines.select(F.xxhash64("planted", "written", "text").alias("doc_id"), "text", "path", "is_secret", "planted", "written"), "planted-lines")
    found = candidates(keyed.select("doc_id", "text", "path"), "text", "path")
    truth = keyed.select(F.col("doc_id").alias("_id"), "is_secret", "planted", "written")
    return found.join(truth, F.col("doc_id") == F.col("_id")).where(F.contains("written", "candidate") | ((F.col("kind") == "block") & F.startswith("written", F.lit("-----BEGIN")))).drop("_id", "written")


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="_features", handleInvalid="keep").transform(df)


def train(labelled: DataFrame, max_train: int = MAX_TRAIN, seed: int = 7) -> RandomForestClassificationModel | None:
    """The forest of at most ``max_train`` labelled findings (features and is_secret); None when one class is absent.

    The sample is taken per class and by distinct candidate, so one string that is copied everywhere counts once.
    """
    each = labelled.select(*FEATURES, "candidate", "is_secret").dropDuplicates(["candidate", "is_secret"])
    half = max_train // 2
    picked = [each.where(F.col("is_secret") == k).orderBy(F.xxhash64("candidate"), "candidate").limit(half) for k in (0.0, 1.0)]
    sample = stored(picked[0].unionAll(picked[1]), "labelled-findings")
    if sample.select("is_secret").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="_features", labelCol="is_secret", numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt")
    model = forest.fit(_assembled(sample.coalesce(1).sortWithinPartitions("is_secret", F.xxhash64("candidate"), "candidate")))
    return model.copy()  # without the summary of its training, which holds the session and cannot always go to tasks


def judge(found: DataFrame, model: RandomForestClassificationModel | None, threshold: float = 0.5) -> DataFrame:
    """The findings with ``score`` (the forest's share for secret) and ``is_secret``; without a model nothing is known: 0.5, and
    every finding counts."""
    if model is None:
        return found.withColumn("score", F.lit(0.5)).withColumn("is_secret", F.lit(True))
    model = model.setProbabilityCol("_probability").setRawPredictionCol("_raw").setPredictionCol("_prediction")
    scored = model.transform(_assembled(found)).withColumn("score", vector_to_array("_probability")[1])
    return scored.withColumn("is_secret", F.col("score") >= threshold).drop("_features", "_probability", "_raw", "_prediction")


def scan_secrets(docs: DataFrame, text: str = "text", path: str = "source", labelled: DataFrame | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """Every finding of every document with its score.

    ``labelled`` are findings as :func:`candidates` gives them, with is_secret (1 or 0); planted ones if not given.
    ``dictionary`` has a column word; the corpus's own words if not given.
    """
    found = stored(candidates(docs, text, path), "findings")
    known = stored(labelled if labelled is not None else planted_findings(docs, text=text, path=path), "known-findings")
    both = found.select("candidate").unionAll(known.select("candidate"))
    words = stored(dictionary.select("word") if dictionary is not None else corpus_dictionary(docs, both, text=text), "dictionary")
    return judge(with_features(found, words), train(with_features(known, words)))

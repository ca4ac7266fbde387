"""Secret scanning: candidates by pattern, false positives removed by a random forest, all in DataFrame expressions.

Candidates are long runs of token characters, and shorter values of a wider alphabet that follow a word like "password"
and a colon or an equals sign.  Each gets features: its length, how its character classes change, how much of it the
most frequent words of the corpus cover, whether it looks like a path, and which words stand beside it.  A random
forest, trained with Spark's own learner on a bounded sample of labelled findings, gives the chance that a candidate is
a secret; its trees are arrays of nodes, walked by array functions, so scoring is one pass over the texts without Python,
without a shuffle, and without code that grows with the forest.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words after which a value is a candidate whatever its characters.
NAMES = r"(?i:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|secret[_-]?key|auth|bearer|credentials?)"
#: A run of token characters, and a value assigned to one of the names; a name and its value are two.
RUN = r"[A-Za-z0-9_\-+/.]{16,}={0,2}"
ASSIGNED = rf"(?:(?<=[:=\"'])|(?<=[:=]\s))(?<={NAMES}[\"']?\s?[:=]\s?[\"']?)[^\s\"'<>,;]{{6,}}"
CANDIDATE = f"{ASSIGNED}|{RUN}"
#: What the words before a secret speak of, and what an example's do.
HINTS = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|private.?key|credential|auth|bearer)"
EXAMPLES = r"(?i)(example|sample|dummy|placeholder|your[._-]|xxxx|changeme|test.?only)|^(1234|abcd)"
NOT_SECRET = r"(?i)(example|sample|dummy|placeholder|test.?only|digest|checksum|commit|sha1|sha256|md5|etag|uuid|version|revision)"
#: Documented shapes of credentials.
KNOWN = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_(live|test)_[0-9A-Za-z]{16,}|xox[abprs]-[0-9A-Za-z-]{10,}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\..*|AIza[0-9A-Za-z_\-]{35}|glpat-[0-9A-Za-z_\-]{20})$"
FEATURES = ["length", "transitions", "digits", "upper", "lower", "marks", "distinct", "dictionary", "path", "hint", "example", "known"]
#: Characters of context on either side.
BEFORE, AFTER = 48, 24


def candidates(docs: DataFrame, *, text: str = "text", keep: list[str] = ()) -> DataFrame:
    """``doc_id, start, candidate, context, after``: every candidate with its 1-based position and the characters beside it.

    The context before a candidate goes back to the start of the one before it at most.  Texts are cut into narrow rows
    at once, so none is carried along with its candidates.  Positions are sums of the lengths of what lies before,
    taken by blocks of about the root of their number, so a text with very many candidates is no square of them.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select("doc_id", *keep, t.alias("_t")).filter(F.col("_t").rlike(CANDIDATE))
    d = d.select("doc_id", *keep, F.regexp_extract_all("_t", F.lit(CANDIDATE), F.lit(0)).alias("_c"), F.split("_t", CANDIDATE, -1).alias("_g"))
    right = lambda x, n: F.substring(x, F.greatest(F.length(x) - n + 1, F.lit(1)), F.lit(n))
    d = d.withColumn("_n", F.transform("_c", lambda x, i: F.length(F.get("_g", i)) + F.length(x))).withColumn("_b", F.ceil(F.sqrt(F.size("_c"))).cast("int"))
    add = lambda a, x: a + x
    d = d.withColumn("_sums", F.transform(F.sequence(F.lit(0), F.floor((F.size("_n") - 1) / F.col("_b")).cast("int")), lambda k: F.aggregate(F.slice("_n", k * F.col("_b") + 1, F.col("_b")), F.lit(0), add)))
    d = d.withColumn("_starts", F.transform("_sums", lambda _, k: F.aggregate(F.slice("_sums", F.lit(1), k), F.lit(0), add)))

    def narrow(x: Column, i: Column) -> Column:
        block = F.floor(i / F.col("_b")).cast("int")
        passed = F.get("_starts", block) + F.aggregate(F.slice("_n", block * F.col("_b") + 1, i - block * F.col("_b")), F.lit(0), add)
        gap = F.get("_g", i)
        before = F.when(F.length(gap) >= BEFORE, right(gap, BEFORE)).otherwise(right(F.concat(F.coalesce(F.when(i > 0, F.get("_c", i - 1)), F.lit("")), gap), BEFORE))
        return F.struct((passed + F.length(gap) + 1).cast("long").alias("start"), x.alias("candidate"), before.alias("context"), F.substring(F.get("_g", i + 1), 1, AFTER).alias("after"))

    return d.select("doc_id", *keep, F.explode(F.transform("_c", narrow)).alias("_")).select("doc_id", *keep, "_.*")


def dictionary(docs: DataFrame, *, size: int = 300, text: str = "text") -> list[str]:
    """The ``size`` most frequent words of 3 to 12 letters over all texts, ties by code point; they alone come to the driver."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"\b[a-z]{3,12}\b"), F.lit(0))).alias("w"))
    return [r.w for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect()]


@dataclass
class Forest:
    """A trained forest: the corpus's words, the words beside findings that it asks for, and its chance of a secret, which reads
    the values of all features as the array ``_f``."""

    dictionary: list[str]
    neighbours: list[str]
    chance: Column = field(repr=False)


def _beside() -> Column:
    """The words next to a candidate: four before, two after."""
    cut = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    return F.concat(F.slice(F.reverse(cut(F.col("context"))), 1, 4), F.slice(cut(F.col("after")), 1, 2))


def with_features(c: DataFrame, words: list[str], neighbours: list[str]) -> DataFrame:
    s, n = F.col("candidate"), F.length("candidate").cast("double")
    of = lambda pattern: F.length(F.regexp_replace(s, f"[^{pattern}]", "")) / n
    classes = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[0-9]", "\x01"), "[A-Z]", "\x02"), "[a-z]", "\x03"), "[^\x01-\x03]", "\x04"), "\x01\x02\x03\x04", "duln")
    # places where the class of a character differs from that of its predecessor
    runs = F.length(F.regexp_replace(classes, r"(.)\1*", "x"))
    # letters in frequent words, longest first, without overlap
    known = "|".join(sorted(words, key=lambda w: (-len(w), w)))
    covered = F.length(s) - F.length(F.regexp_replace(F.lower(s), f"({known})", "")) if known else F.lit(0)
    beside = _beside()
    c = c.withColumns({
        "length": n, "transitions": (runs - 1) / n, "digits": of("0-9"), "upper": of("A-Z"), "lower": of("a-z"), "marks": of(r"_\-+/=."),
        "distinct": F.size(F.array_distinct(F.split(s, ""))) / n, "dictionary": covered / n,
        "path": (s.rlike(r"^(\.{0,2}/|www\.)|\.(com|org|net|html?|py|js|css|png|jpe?g|txt|md)\b|//") | F.col("context").rlike(r"(https?:/?/?|[\\/~@])$")).cast("double"),
        "hint": F.col("context").rlike(HINTS + r"[^A-Za-z0-9]*$|" + HINTS + r"\W{0,4}\w{0,8}\W{0,4}$").cast("double"),
        "example": (s.rlike(EXAMPLES) | F.col("context").rlike(NOT_SECRET + r"[^A-Za-z0-9]*$")).cast("double"), "known": s.rlike(KNOWN).cast("double"),
    })
    if neighbours:
        c = c.withColumn("_beside", beside).withColumns({f"near_{w}": F.array_contains("_beside", w).cast("double") for w in neighbours})
    return c.withColumn("_f", F.array(*FEATURES, *[f"near_{w}" for w in neighbours]))


def labelled_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """``text, value, label``: short texts with one value each, whose label is known because a rule made them; the same
    rows every time.

    Secrets are random hexadecimal, base-64 and known-prefix tokens and short passwords after words that introduce one;
    false positives are words, identifiers, paths, hosts, numbers, repeats, placeholders, names of settings, and digests whose
    words say so.
    """
    i = F.col("id")
    h = F.sha2(F.concat(F.lit("finding"), i.cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(h)), "=", "")
    pick = lambda names, k: F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(names))) + 1).cast("int"))
    word = lambda k: pick(["alpha", "nation", "entering", "there", "houses", "lecture", "mention", "ardent", "station", "reading", "der", "montes", "queue", "ensemble"], k)
    intro = F.concat(word(90), F.lit(" "), pick(["token", "secret", "api_key", "password", "access_key", "auth", "SECRET_KEY", "client_secret", "AWS_SECRET_ACCESS_KEY", "private_key"], 1), pick([" = \"", "=", ": ", "='", "\": \"", " = "], 2))
    said = F.concat(word(90), F.lit(" "), pick(["token", "secret", "Bearer", "access key"], 7), pick([" ", " is ", ": "], 8))
    plain = F.concat(word(91), F.lit(" "), word(92), pick([" ", ", ", ": ", " the ", " = "], 3))
    digest = F.concat(word(93), F.lit(" "), pick(["commit", "sha256", "md5", "checksum", "etag", "revision", "uuid"], 4), pick([" ", ": ", " = ", "="], 5))
    length = (F.pmod(F.xxhash64("id", F.lit(6)), F.lit(33)) + 24).cast("int")
    short = F.concat(F.substring(b64, F.lit(1), (F.pmod(F.xxhash64("id", F.lit(9)), F.lit(6)) + 5).cast("int")), pick(["#", "!", "@", "$", "%7", "9"], 10), F.substring(b64, 20, 3))
    secret = F.when(i % 9 < 3, F.substring(h, F.lit(1), length)).when(i % 9 < 5, F.substring(b64, F.lit(1), length)).when(i % 9 == 5, F.concat(F.lit("AKIA"), F.upper(F.substring(h, 1, 16)))).when(i % 9 == 6, F.concat(F.lit("ghp_"), F.substring(b64, 1, 36))).when(i % 9 == 7, F.concat(F.lit("sk_live_"), F.substring(b64, 1, 24))).otherwise(short)
    noise = (
        F.when(i % 9 == 0, F.concat_ws("_", word(10), word(11), word(12), word(13))).when(i % 9 == 1, F.concat(F.lit("/usr/"), word(14), F.lit("/"), word(15), F.lit("/"), word(16), F.lit(".py")))
        .when(i % 9 == 2, F.concat(word(17), word(18), word(19), word(20))).when(i % 9 == 3, F.concat(F.lit("your."), word(21), F.lit("-xxxxxxxxxxxx")))
        .when(i % 9 == 4, F.repeat(F.substring(h, 1, 1), 24)).when(i % 9 == 5, F.concat(F.lit("www."), word(22), F.lit(".example.com/"), word(23)))
        .when(i % 9 == 6, pick(["changeme", "required", "undefined", "os.environ", "getenv(name)", "string|null", "false_or_true", "placeholder"], 24)).when(i % 9 == 7, F.concat(word(25), word(26)))
        .otherwise(F.concat(F.conv(F.substring(h, 1, 12), 16, 10), F.conv(F.substring(h, 13, 12), 16, 10)))
    )
    kind = F.pmod(F.xxhash64("id", F.lit(0)), F.lit(10))
    value = F.when(kind < 4, secret).when(kind < 5, F.substring(h, F.lit(1), F.element_at(F.array(F.lit(32), F.lit(40), F.lit(64)), (i % 3 + 1).cast("int")))).otherwise(noise)
    before = F.when(kind < 4, F.when((i % 9 >= 5) & (i % 9 < 8) & (i % 3 == 0), plain).when((i % 9 < 5) & (i % 4 == 0), said).otherwise(intro)).when(kind < 5, digest).when(kind < 7, intro).otherwise(plain)
    mail = (kind >= 7) & (i % 9 == 5) & (i % 2 == 0)  # the host of an address
    value = F.when(mail, F.concat(F.lit("mail"), (i % 10).cast("string"), pick([".example.com", ".sample.org", ".provider.net"], 28))).otherwise(value)
    before = F.when(mail, F.concat(word(91), F.lit(" "), word(27), pick([".45@", "@", "_7@"], 29))).otherwise(before)
    quote = F.when(before.rlike("\"$"), F.lit("\"")).when(before.rlike("'$"), F.lit("'")).otherwise(F.lit(""))
    return spark.range(0, rows, 1, 1).select(F.concat(before, value, quote, pick([" ", "\n", ", ", " and "], 11), word(94)).alias("text"), value.alias("value"), (kind < 4).cast("double").alias("label"))


def cut(findings: DataFrame) -> DataFrame:
    """The candidates of labelled texts; only the labelled value itself has the text's label."""
    c = candidates(findings.withColumn("doc_id", F.lit(0)), keep=["value", "label"])
    return c.withColumn("label", F.when(F.col("candidate") == F.col("value"), F.col("label")).otherwise(F.lit(0.0))).drop("doc_id", "value", "start")


def train(findings: DataFrame, words: list[str], *, max_rows: int = 20_000, neighbours: int = 40, trees: int = 20, depth: int = 6, seed: int = 5) -> Forest:
    """The forest over FEATURES and the most frequent words beside findings; at most ``max_rows`` findings are used."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    sample = findings.orderBy(F.xxhash64("text", "value"), "text", "value", "label").limit(max_rows)
    beside = cut(sample).select(F.explode(F.array_distinct(_beside())).alias("w")).filter(F.col("w").rlike("^[a-z]{2,20}$"))
    near = [r.w for r in beside.groupBy("w").count().filter("count >= 5").orderBy(F.desc("count"), "w").limit(neighbours).collect()]
    columns = FEATURES + [f"near_{w}" for w in near]
    rows = with_features(cut(sample), words, near).select(*columns, "label").coalesce(1)
    data = VectorAssembler(inputCols=columns, outputCol="features").transform(rows).select("features", "label")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(data)

    def chance(root) -> Column:
        feature, bound, low, high, value = [], [], [], [], []

        def add(node) -> int:
            k = len(feature)
            for column in (feature, bound, low, high, value):
                column.append(0)
            stats = list(node.impurityStats().stats())
            value[k] = float(stats[1] / sum(stats)) if sum(stats) else 0.0
            if node.numDescendants():
                split = node.split()
                feature[k], bound[k] = split.featureIndex(), float(split.threshold())
                low[k], high[k] = add(node.leftChild()), add(node.rightChild())
            else:
                low[k] = high[k] = k  # a leaf leads to itself
            return k

        add(root)
        ints, numbers = (lambda v: F.lit(v).cast("array<int>")), (lambda v: F.lit([float(x) for x in v]))
        down = lambda k, _: F.when(F.get("_f", F.get(ints(feature), k)) <= F.get(numbers(bound), k), F.get(ints(low), k)).otherwise(F.get(ints(high), k))
        leaf = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), down)
        return F.get(numbers(value), leaf)

    return Forest(words, near, sum((chance(t._call_java("rootNode")) for t in model.trees), F.lit(0.0)) / trees)


def scan(docs: DataFrame, forest: Forest, *, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """``doc_id, start, candidate, score``: the findings the forest holds for secrets.

    Null and empty texts have none; long texts are read whole, with every candidate; repeated rows repeat their findings;
    other columns are ignored; an empty table gives an empty result.
    """
    c = with_features(candidates(docs, text=text), forest.dictionary, forest.neighbours).select("doc_id", "start", "candidate", "_f")
    c = c.select("doc_id", F.struct("start", "candidate", F.round(forest.chance, 6).alias("score")).alias("_"))
    # not a filter on the score, which Spark would push down and with it work out all features a second time
    found = F.explode_outer(F.filter(F.array("_"), lambda x: x["score"] >= threshold)).alias("_")
    return c.select("doc_id", found).filter("_ IS NOT NULL").select("doc_id", "_.start", "_.candidate", "_.score")

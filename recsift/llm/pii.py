"""Personal data: wide generators propose spans, boosted trees with calibrated thresholds choose.

Base kinds (email, ip, card, phone) are the spans of fixed patterns that pass fixed
checks; they are always reported.  Further spans come from candidate boosting:

1. every generator (the base patterns without their checks, and wider formats such as
   local phone numbers, identity numbers, account numbers and spelled-out addresses)
   proposes spans, which may overlap;
2. a candidate that passes the strict check of its kind is always reported: that depends on its text
   alone, never on other rows;
3. the trees add others.  Distinct candidates (kind, value and context; copies count once) are labelled by the
   strict checks.  Of a sample of at most ``SAMPLE``, dealt to the kinds as evenly as their
   numbers allow and inside a kind by the smallest hash, one half fits gradient-boosted trees
   on format features (lengths, digits, separators, check digits) and context features
   (words and characters around the span).  All distinct candidates of the table that the trees have not been
   fitted on set one threshold per kind: the lowest score above which ``PRECISION`` of at least ``SUPPORT``
   candidates are right.  A kind without such a score, or with fewer candidates, adds nothing more;
4. the trees become one SQL expression that scores all candidates of all rows in place.

The sample bounds the fitting alone; candidates, thresholds, scores and spans cover every
row.  Main path: DataFrame and ML functions on the JVM only, no shuffle of texts.

Defined cases: null and empty texts have no spans; repeated rows are scanned each on
their own; a null doc_id stays null; extra columns are ignored; without candidates of
both labels no trees are fitted and strict checks alone decide; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recsift.llm.textcols import joined, let, match_spans
from recsift.session import materialize
from recsift.sources.tables import read_table

SAMPLE = 20_000
TREES, DEPTH = 10, 3
PRECISION, SUPPORT = 0.98, 20
CONTEXT = 24
#: words before a span that announce personal data
ANNOUNCE = "(?i)(tel|phone|call|fax|mobile|mail|contact|card|visa|iban|account|ssn|passport|tax|address|ip)[^a-z]*$"


@dataclass(frozen=True)
class Generator:
    kind: str
    pattern: str
    #: a pattern without which this one cannot match
    needs: str


#: Base patterns.  A match can only begin where a run of its first characters begins or where the last
#: match ended (\G), and repeated groups are possessive: both leave the matches as they are and keep the
#: time in proportion to the text.
BASE = (
    Generator("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Generator("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]\\.[0-9]"),
    Generator("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]"),
    Generator("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "\\+[0-9]"),
)
WIDE = (
    Generator("spelled_email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?i:at)[\])] ?[A-Za-z0-9-]++"
              r"(?: ?(?:[\[(](?i:dot)[\])]|\.) ?[A-Za-z0-9-]++)++", "[\\[(](?i:at)[\\])]"),
    Generator("local_phone", r"(?<![0-9+])(?<!\+[0-9]{1,3}[\x20.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", "[0-9]{3}[\\x20.-][0-9]{4}"),
    Generator("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]"),
    Generator("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}"),
    Generator("mac", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])", "[0-9A-Fa-f]:[0-9A-Fa-f]{2}:"),
    Generator("number", r"(?<![0-9])[0-9]{9,19}(?![0-9])", "[0-9]{9}"),
)
GENERATORS = BASE + WIDE
KIND = {g.kind: n for n, g in enumerate(GENERATORS)}
CANDIDATE = "array<struct<n:int,start:bigint,end:bigint,value:string,before:string,after:string>>"


def candidates(text: Column) -> Column:
    """All generators' spans, by generator and then by start."""
    lists = []
    for n, g in enumerate(GENERATORS):
        found = F.transform(match_spans(text, g.pattern, context=CONTEXT), lambda m: F.struct(
            F.lit(n).alias("n"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"),
            m["before"].alias("before"), m["after"].alias("after")))
        lists.append(F.when(F.regexp_like(text, F.lit(g.needs)), found).otherwise(F.array().cast(CANDIDATE)))
    return F.concat(*lists)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """1 where the digits pass the check-digit rule."""
    def total(d):
        signs = F.reverse(F.split(d, ""))
        return F.aggregate(F.transform(signs, lambda x, i: let(
            x.cast("int") * (1 + i % 2), lambda y: F.when(y > 9, y - 9).otherwise(y))), F.lit(0), lambda a, x: a + x)
    return let(_digits(value), lambda d: F.when(F.length(d) > 0, (total(d) % 10 == 0).cast("int")).otherwise(0))


def _remainder(value: Column) -> Column:
    """The account-number check: first four signs moved to the end, letters as 10 to 35, modulo 97."""
    signs = let(F.replace(value, F.lit(" ")), lambda v: F.split(F.concat(F.substring(v, 5, 99), F.left(v, F.lit(4))), ""))
    return F.aggregate(signs, F.lit(0), lambda a, x: F.when(x == "", a).when(
        x.between("0", "9"), (a * 10 + F.ascii(x) - 48) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97))


_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def base_check(c: Column) -> Column:
    """Whether a candidate of a base pattern is a base span."""
    digits = F.length(_digits(c["value"]))
    return (F.when(c["n"] == KIND["email"], F.lit(True))
            .when(c["n"] == KIND["ip"], F.regexp_like(c["value"], F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")))
            .when(c["n"] == KIND["card"], F.when(digits.between(16, 19), _luhn(c["value"]) == 1).otherwise(False))
            .when(c["n"] == KIND["phone"], digits.between(8, 15))
            .otherwise(False))


def strict_check(c: Column) -> Column:
    """The label of a training candidate."""
    v, like = c["value"], lambda p: F.regexp_like(c["value"], F.lit(p))
    return (F.when(c["n"] == KIND["email"], like(r"\.[A-Za-z]{2,}$"))
            .when(c["n"] == KIND["spelled_email"], like(r"[A-Za-z]{2,}$"))
            .when(c["n"] == KIND["local_phone"], like(r"^\(?[2-9][0-9]{2}\)?[ .-][2-9]"))
            .when(c["n"] == KIND["ssn"], ~like(r"^(000|666|9)|-00-|-0000$"))
            .when(c["n"] == KIND["iban"], F.length(F.replace(v, F.lit(" "))).between(15, 34) & (_remainder(v) == 1))
            .when(c["n"] == KIND["number"], F.length(v).between(13, 19) & (_luhn(v) == 1) & F.regexp_like(c["before"], F.lit(ANNOUNCE)))
            .when(c["n"] == KIND["mac"], ~like(r"^(00:){5}00$"))
            .otherwise(base_check(c)))


def features(c: Column) -> list[Column]:
    """Format and context of a candidate, as doubles."""
    v = c["value"]
    count = lambda p: F.length(F.regexp_replace(v, p, ""))
    flag = lambda col, p: F.regexp_like(col, F.lit(p))
    out = [c["n"] == n for n in range(len(GENERATORS))]
    out += [F.length(v), count("[^0-9]"), count("[^A-Za-z]"), count("[^ ().-]"), count("[^.]"),
            flag(v, "^0|[^0-9]0[0-9]"), flag(v, "([0-9])\\1{3}"), flag(v, "[3-9][0-9]{2}\\."),
            _luhn(v), flag(v, "\\.[A-Za-z]{2,}$")]
    out += [flag(c["before"], ANNOUNCE), flag(c["before"], "[\\s(\\[<\"']$|^$"), flag(c["before"], "[=:#]\\s?$"),
            flag(c["after"], "^[\\s)\\]>\"',.;]|^$"), flag(c["after"], "^[A-Za-z0-9_-]")]
    return [x.cast("double") for x in out]


N_FEATURES = len(GENERATORS) + 15


# ---- fitted trees as one expression ---------------------------------------------

def _tree(lines: list[str], x: Column) -> Column:
    """The expression of one tree in the indented text form of the fitted model."""
    head = lines.pop(0).strip()
    if head.startswith("Predict:"):
        return F.lit(float(head.split(":")[1]))
    feature, value = re.match(r"If \(feature (\d+) <= ([^)]+)\)", head).groups()
    yes = _tree(lines, x)
    lines.pop(0)  # Else
    no = _tree(lines, x)
    return F.when(x[int(feature)] <= float(value), yes).otherwise(no)


def score_expression(model):
    """Function of an array of features: the model's probability that a candidate is right."""
    def score(x: Column) -> Column:
        total = F.lit(0.0)
        for tree, weight in zip(model.trees, model.treeWeights, strict=True):
            total = total + F.lit(float(weight)) * _tree(tree.toDebugString.strip().split("\n")[1:], x)
        return 1.0 / (1.0 + F.exp(-2.0 * total))
    return score


def _quotas(counts: dict[int, int]) -> dict[int, int]:
    """Rows of each kind in a sample of at most ``SAMPLE``: small kinds whole, the others in equal parts."""
    quotas, left = {}, SAMPLE
    for k, n in enumerate(sorted(counts, key=lambda n: (counts[n], n))):
        quotas[n] = min(counts[n], left // (len(counts) - k))
        left -= quotas[n]
    return quotas


def fit(found: DataFrame):
    """(score function, {kind number: threshold}) from the ``c`` candidates of ``found``; without both labels (None, {})."""
    once = materialize(found.select("c.n", "c.value", "c.before", "c.after").distinct()
                       .withColumn("h", F.xxhash64("value", "before", "after", "n")), "pii-distinct")
    counts = {r["n"]: r["count"] for r in once.groupBy("n").count().collect()}
    fitting = F.lit(False)
    for n, quota in _quotas(counts).items():
        mine = F.col("n") == n
        if quota < counts[n]:
            cut = once.filter(mine).select("h").orderBy("h").limit(quota).agg(F.max("h")).first()[0]
            mine = mine & (F.col("h") <= cut)
        fitting = fitting | mine
    fitting = fitting & (F.col("h") % 2 == 0)
    c = F.struct("n", "value", "before", "after")
    rows = lambda some: some.select("n", let(c, strict_check).cast("double").alias("label"),
                                    let(c, lambda x: F.array(*features(x))).alias("x"))
    names = [f"f{i}" for i in range(N_FEATURES)]
    train = materialize(rows(once.filter(fitting)).select("label", *[F.col("x")[i].alias(f) for i, f in enumerate(names)]),
                        "pii-sample")
    if train.agg(F.countDistinct("label")).first()[0] < 2:
        return None, {}
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(
        VectorAssembler(inputCols=names, outputCol="features").transform(train).select("features", "label"))
    score = score_expression(model)
    bins = rows(once.filter(~fitting)).select("n", "label", F.floor(let(F.col("x"), score) * 100).cast("int").alias("bin")) \
        .groupBy("n", "bin").agg(F.sum("label").alias("right"), F.count(F.lit(1)).alias("all")).collect()
    thresholds = {}
    for n in range(len(GENERATORS)):
        right = total = 0
        for b in sorted((b for b in bins if b["n"] == n), key=lambda b: -b["bin"]):
            right, total = right + b["right"], total + b["all"]
            if total >= SUPPORT and right >= PRECISION * total:
                thresholds[n] = b["bin"] / 100
    return score, thresholds


def detect(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: ``keep`` columns, ``base`` and ``spans`` as array<struct<kind, start, end, score>>,
    each by kind as listed and then by start."""
    wide = docs.select(*keep, candidates(F.coalesce(F.col(text), F.lit(""))).alias("cands"))
    wide = materialize(wide, "pii-candidates")
    score, thresholds = fit(wide.select(F.explode("cands").alias("c")))

    def scored(c):
        base = base_check(c)
        chosen = base | strict_check(c)
        if score is None or not thresholds:
            return F.struct(c.alias("c"), base.alias("base"), F.lit(None).cast("double").alias("score"), chosen.alias("chosen"))
        least = F.element_at(F.array(*[F.lit(thresholds.get(n, 2.0)) for n in range(len(GENERATORS))]), c["n"] + 1)
        return let(let(F.array(*features(c)), score), lambda s: F.struct(
            c.alias("c"), base.alias("base"), s.alias("score"), (chosen | (s >= least)).alias("chosen")))

    names = F.array(*[F.lit(g.kind) for g in GENERATORS])

    def spans(of):
        return F.transform(of, lambda s: F.struct(
            F.element_at(names, s["c"]["n"] + 1).alias("kind"), s["c"]["start"].alias("start"),
            s["c"]["end"].alias("end"), s["score"].alias("score")))

    out = wide.select(*keep, F.filter(F.transform("cands", scored), lambda s: s["chosen"]).alias("s"))
    return out.select(*keep, spans(F.filter("s", lambda s: s["base"])).alias("base"), spans(F.col("s")).alias("spans"))


def op10_personal_data(spark, sf_dir):
    """Personal data in every document: base kinds, and the spans that the boosted trees add."""
    d = detect(read_table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return d.select("doc_id", *[count(g.kind) for g in BASE],
                    F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op10_personal_data": op10_personal_data}

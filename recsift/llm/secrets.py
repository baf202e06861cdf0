"""Secret scans with an incremental blob ledger.

Texts are content-addressed: a blob is one distinct text, named by the SHA-256 of
its bytes, however many rows (paths, versions) hold it.  The ledger is a Parquet
table in the shared folder with one row per scanned (blob, rule version): the spans
found there.  A scan looks up every blob of the input, applies the rules to the
(blob, rule version) pairs that the ledger has not seen, appends those, and joins
the findings back to every row by content.  Scanning a grown or changed corpus
again costs only its new texts; a new rule version scans every blob once more and
leaves the rows of the old one as they are.

Two runs of a job that write the same pair write the same row (rules depend on the
text alone), so a job that is repeated after a failure leaves duplicates at most;
readers take one row per pair.  Blobs are formed by a distinct
aggregate, which combines equal texts in each input task first; findings are joined
back without the texts.  Main path: DataFrame functions only.

Defined cases: null texts read as empty, and empty texts have no spans; repeated
rows each get the findings of their text; a null doc_id stays null; extra columns
are ignored; an empty table gives an empty result and an empty ledger entry.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recsift.llm.textcols import joined, match_spans
from recsift.session import scratch_path
from recsift.sources.tables import read_table

#: raised whenever a rule below changes, so that old blobs are scanned anew
RULE_VERSION = "1"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: capture group whose length counts, and the least length of it
    group: int = 0
    least: int = 1
    #: a plain substring without which the pattern cannot match
    needs: str | None = None


#: fixed patterns and lengths of the base kinds.  ``hex`` asks for its length inside the pattern: a
#: match is always a whole run, so that drops the same matches as a test of its length would.
#: Groups that repeat are possessive: nothing follows them, and Java's matcher then needs no stack.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, "AKIA"),
    Rule("hex", r"[0-9a-f]{16,}+", 0, 16),
)
#: formats of well-known services, and keys in text form
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+", needs="gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+", needs="xox"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", needs="AIza"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}+", needs="k_live_"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", needs="eyJ"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", needs="PRIVATE KEY-----"),
    Rule("userinfo", r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s/:@]++:([^\s/:@]++)@", 1, 4, "://"),
)
SPAN = "struct<kind:string,start:bigint,end:bigint>"
LEDGER = f"blob string, rule_version string, spans array<{SPAN}>"


def spans_of(text: Column, rules=BASE + MORE) -> Column:
    """Spans of all rules, by start and then in the order of the rules."""
    lists = []
    for n, r in enumerate(rules):
        found = match_spans(text, r.pattern, r.group or None)
        found = F.transform(F.filter(found, lambda m: F.char_length(m["part"]) >= r.least), lambda m: F.struct(
            m["start"].alias("start"), F.lit(n).alias("n"), m["end"].alias("end"), F.lit(r.kind).alias("kind")))
        may = F.contains(text, F.lit(r.needs)) if r.needs else F.regexp_like(text, F.lit(r.pattern))
        lists.append(F.when(may, found).otherwise(F.array().cast("array<struct<start:bigint,n:int,end:bigint,kind:string>>")))
    return F.transform(F.array_sort(F.concat(*lists)), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def read_ledger(spark, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def create_ledger(spark, path: str) -> None:
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)


def update_ledger(docs: DataFrame, ledger: str, text: str = "text", rule_version: str = RULE_VERSION,
                  rules=BASE + MORE) -> None:
    """Scan the blobs of ``docs`` that the ledger at ``ledger`` lacks under ``rule_version``."""
    spark = docs.sparkSession
    create_ledger(spark, ledger)
    content = F.coalesce(F.col(text), F.lit(""))
    blobs = docs.select(blob_of(content).alias("blob"), content.alias("content")).distinct()
    known = read_ledger(spark, ledger)
    seen = known.filter(F.col("rule_version") == rule_version).select("blob")
    if not known.isEmpty():
        blobs = blobs.join(seen, "blob", "left_anti")
    found = blobs.select("blob", F.lit(rule_version).alias("rule_version"),
                         spans_of(F.col("content"), rules).alias("spans"))
    found.write.mode("append").parquet(ledger)


def findings(docs: DataFrame, ledger: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
             rule_version: str = RULE_VERSION) -> DataFrame:
    """``keep`` columns, blob and spans of every row of ``docs``, from the ledger."""
    rows = read_ledger(docs.sparkSession, ledger).filter(F.col("rule_version") == rule_version)
    one = rows.groupBy("blob").agg(F.first("spans").alias("spans"))
    return docs.select(*keep, blob_of(F.col(text)).alias("blob")).join(one, "blob", "left")


def op5_secret_scan(spark, sf_dir):
    """Secrets in every document: base kinds and known formats, through a fresh ledger."""
    docs = read_table(spark, sf_dir, "documents")
    ledger = scratch_path(spark, "secret-ledger")
    update_ledger(docs, ledger)
    kinds = [r.kind for r in BASE]

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return findings(docs, ledger).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in kinds],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(kinds))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))


QUERIES = {"op5_secret_scan": op5_secret_scan}

"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by its content: its blob is the SHA-256 of its text.  Three
tables are kept in a folder: the versions (path, blob) seen so far, the ledger of (blob, rule, version
of the rule) triples that have been scanned, and the findings by blob.  A scan looks only at those
triples of the present blobs and rules that the ledger lacks, each blob once however many paths and
versions have it; a rule whose version is raised is scanned anew, the others are not.  Findings are
joined back to all paths that ever had their blob, a path met first in a later scan included.

A rule can have anchors, pieces of text one of which every match holds; that they do is proved from the
pattern when the rule is made.  A text without any of a rule's anchors is entered in the ledger as
scanned by it without the pattern being tried; a rule without anchors is tried on every text.

The table is passed once a scan: one pass gives path, blob, the rules that could match and, only where
there are any, the text, and is written in the shared folder; all else is derived from that.  Findings
are written first, then the ledger, then the versions: whatever is lost in between is found again by
the next scan and counts once.

A finding holds the SHA-256 of the secret instead of the secret.

Defined results: a null text is no version; an empty one is a blob without findings; a secret that a
blob holds more than once is one finding with its number of occurrences; repeated rows are one
version; null ids are a path of their own; other columns are ignored; rule names can hold any
character; two rules of one name and version are an error, as are anchors that a match could lack.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernmill.session import cut, shared_folder, table

#: Stands for text that a pattern leaves open.
GAP = "\x00"


def _spellings(tree, most: int = 4096) -> list[str]:
    """What a parsed pattern's matches spell, with a gap for all that it leaves open."""
    out = [""]
    for kind, value in tree:
        if kind is C.LITERAL:
            part = [chr(value)]
        elif kind is C.IN and len(value) <= 8 and all(k is C.LITERAL for k, _ in value):
            part = [chr(v) for _, v in value]
        elif kind is C.BRANCH:
            part = [x for branch in value[1] for x in _spellings(branch, most)]
        elif kind is C.SUBPATTERN:
            part = _spellings(value[3], most) if not value[1] and not value[2] else [GAP]
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, body = value
            inner = _spellings(body, most)
            part = inner if low == high == 1 else ["", *inner] if (low, high) == (0, 1) else [x + GAP for x in inner] if low else [GAP]
        elif kind in (C.AT, C.ASSERT, C.ASSERT_NOT):
            part = [""]
        else:
            part = [GAP]
        if len(out) * len(part) > most:
            part = [GAP]
        out = [a + b for a, b in product(out, part)]
    return out


@dataclass(frozen=True)
class Rule:
    """A pattern that Java and RE2 read alike; a text without one of the anchors has no match.  Without anchors it is tried on every text."""

    name: str
    version: int
    pattern: str
    anchors: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        tree = parser.parse(self.pattern)
        flags = tree.state.flags & (C.SRE_FLAG_IGNORECASE | C.SRE_FLAG_VERBOSE)
        if self.anchors and (flags or not all(any(a in x for a in self.anchors) for x in _spellings(tree))):
            raise ValueError(f"rule {self.name}: a match of the pattern can lack all anchors")


RULES = (
    Rule("aws_access_key", 1, r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", ("AKIA", "ASIA")),
    Rule("github_token", 1, r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack_token", 1, r"\bxox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    Rule("google_api_key", 1, r"\bAIza[0-9A-Za-z_-]{35}", ("AIza",)),
    Rule("stripe_key", 1, r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}\b", ("k_live_", "k_test_")),
    Rule("json_web_token", 1, r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyJ",)),
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", ("PRIVATE KEY",)),
    Rule("assigned_secret", 1, r"(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Aa]pi_?[Kk]ey|API_?KEY)\s{0,3}[:=]\s{0,3}[\"'][A-Za-z0-9+/_-]{16,}[\"']", ("oken", "OKEN", "ecret", "ECRET", "assword", "ASSWORD", "pi_key", "pi_Key", "pikey", "piKey", "API_KEY", "APIKEY")),
)


def blob(text: str = "text") -> Column:
    """The address of a text."""
    return F.sha2(F.col(text).cast("binary"), 256)


def _near(rule: Rule) -> Column:
    """Whether a rule has to be tried on a text."""
    if not rule.anchors:
        return F.lit(True)
    found = F.lit(False)
    for anchor in rule.anchors:
        found = found | F.contains("text", F.lit(anchor))
    return found


def addressed(docs: DataFrame, rules: tuple[Rule, ...] = RULES, path: str = "doc_id") -> DataFrame:
    """(path, blob, near, text) of each row that has a text: the places of the rules to be tried on it; its text only if there are any.

    This is the one pass over the table; it is written in the shared folder.
    """
    if len({(r.name, r.version) for r in rules}) < len(rules):
        raise ValueError("two rules have one name and version")
    near = F.array_compact(F.array(*[F.when(_near(r), F.lit(i)) for i, r in enumerate(rules)]).cast("array<int>"))
    rows = docs.where("text is not null").select(F.col(path).alias("path"), blob().alias("blob"), near.alias("near"), "text")
    return cut(rows.withColumn("text", F.when(F.size("near") > 0, F.col("text"))))


def _place(rules: tuple[Rule, ...]) -> Column:
    """A ledger row's place among the rules, or null."""
    return F.coalesce(*[F.when((F.col("rule") == r.name) & (F.col("version") == r.version), F.lit(i)) for i, r in enumerate(rules)], F.lit(None).cast("int"))


def unseen(rows: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, todo): each blob of addressed rows that the ledger lacks a rule for, and the places of those rules."""
    every = F.array(*[F.lit(i) for i in range(len(rules))]).cast("array<int>")
    blobs = rows.select("blob").distinct()
    if ledger is None:
        return blobs.withColumn("todo", every)
    done = ledger.withColumn("i", _place(rules)).where("i is not null").groupBy("blob").agg(F.collect_set("i").alias("done"))
    rest = blobs.join(done, "blob", "left").withColumn("todo", F.when(F.col("done").isNull(), every).otherwise(F.array_except(every, "done")))
    return rest.where("size(todo) > 0").select("blob", "todo")


def _finding(rule: Rule):
    return lambda x: F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"), F.sha2(x.cast("binary"), 256).alias("secret"))


def scan_rows(rows: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(new ledger rows, new findings) of addressed rows: (blob, rule, version), and (blob, rule, version, secret, occurrences)."""
    todo = cut(unseen(rows, ledger, rules))
    # equal blobs are equal texts: any one stands for all
    texts = rows.where("text is not null").groupBy("blob").agg(F.first("text").alias("text"), F.first("near").alias("near"))
    texts = texts.join(todo, "blob").select("blob", "text", F.array_intersect("todo", "near").alias("todo")).where("size(todo) > 0")
    hits = []
    for i, r in enumerate(rules):
        found = F.when(F.array_contains("todo", i), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)))
        hits.append(F.transform(F.coalesce(found, F.array().cast("array<string>")), _finding(r)))
    found = texts.select("blob", F.explode(F.concat(*hits)).alias("hit")).select("blob", "hit.*")
    found = found.groupBy("blob", "rule", "version", "secret").agg(F.count(F.lit(1)).alias("occurrences"))
    keys = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    scanned = todo.select("blob", F.explode(F.transform("todo", lambda i: F.get(keys, i))).alias("key")).select("blob", "key.*")
    return scanned, found


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(new ledger rows, new findings) of a table."""
    return scan_rows(addressed(docs, rules, path), ledger, rules)


def on_paths(found: DataFrame, versions: DataFrame, path: str = "doc_id") -> DataFrame:
    """Findings joined to all the paths of some versions (path, blob) that have their blob."""
    return versions.join(found, "blob").select(F.col("path").alias(path), "blob", "rule", "version", "secret", "occurrences")


LEDGER = "blob string, rule string, version int"
FINDINGS = "blob string, rule string, version int, secret string, occurrences long"


def kept(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows kept at a path; none before the first are written."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def update(docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, path: str = "doc_id") -> DataFrame:
    """Scans what the ledger in a folder lacks, adds to findings, ledger and versions there, and returns all findings of the present rules on all paths that ever had them."""
    spark = docs.sparkSession
    rows = addressed(docs, rules, path)
    new, found = scan_rows(rows, kept(spark, f"{folder}/ledger", LEDGER), rules)
    own = rows.select("path", "blob").distinct()
    versions = kept(spark, f"{folder}/versions", own.schema)
    known = versions.select(F.col("path").alias("_path"), F.col("blob").alias("_blob"))
    added = own.join(known, F.col("path").eqNullSafe(F.col("_path")) & (F.col("blob") == F.col("_blob")), "left_anti")
    kept(spark, f"{folder}/findings", FINDINGS)
    found.write.mode("append").parquet(f"{folder}/findings")
    new.write.mode("append").parquet(f"{folder}/ledger")
    added.write.mode("append").parquet(f"{folder}/versions")
    findings = kept(spark, f"{folder}/findings", FINDINGS).where(_place(rules).isNotNull()).distinct()
    return on_paths(findings, kept(spark, f"{folder}/versions", own.schema).distinct(), path)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings in the documents, by path, after two scans: the first knows all rules but one, the second only tries what the ledger lacks, which is that one."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    update(docs, folder, RULES[:-1])
    return update(docs, folder)


def _sql() -> str:
    cases = " union all ".join(
        f"select doc_id, sha256(text) as blob, '{r.name}' as rule, {r.version}::int as version, unnest(regexp_extract_all(text, '{r.pattern.replace(chr(39), chr(39) * 2)}')) as hit from (select distinct doc_id, text from documents where text is not null)"
        for r in RULES
    )
    return f"select doc_id, blob, rule, version, sha256(hit) as secret, count(*) as occurrences from ({cases}) group by all"


ORACLE_SQL = _sql()

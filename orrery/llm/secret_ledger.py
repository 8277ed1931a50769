"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a document is content-addressed by the SHA-256 of its text. The ledger says which blob has
been scanned under which rule version, and its findings table holds the spans of each. A scan takes the
versions at hand, keeps one text of each blob whose (blob, rule version) pair the ledger lacks, finds the
spans there, appends both, and joins the findings of all the blobs back to every path that holds them.

Spans are in code points, end exclusive. The text is split at a rule's matches: pieces and matches in turn
add up to the offsets, so no match is searched for again.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orrery.llm.common import cut, fresh_path, named, small_or_not

# The base rules' patterns, with letters in either case spelt out, and the least length that counts.
_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]+"
_HEX = r"[0-9a-f]{24,}"


#: Tasks that a blob's copies are spread over before one is taken.
SPREAD = 64


@dataclass(frozen=True)
class Rule:
    """kind: its name in results; pattern: a Java regular expression; least: the characters needed of the group."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True


#: In the order in which kinds are listed. Those that aren't base add spans of their own.
RULES = (
    Rule("assign", _ASSIGN, 2, 6),
    Rule("access", _ACCESS, 0, 20),
    Rule("hex", _HEX, 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
)


def version_of(rules: tuple[Rule, ...]) -> str:
    """The version of a set of rules: a digest of all that they say, so other rules never find old findings."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _spans(text: Column, order: int, rule: Rule) -> Column:
    """An array of (start, end, kind order, kind) of the rule's matches in text; null rather than empty."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    pieces = F.split(text, rule.pattern, -1)
    step = F.transform(matches, lambda m, i: F.struct(F.char_length(F.get(pieces, i)).cast("long").alias("gap"), F.char_length(m).cast("long").alias("size"), (F.char_length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least).alias("ok")))
    return F.when(text.rlike(rule.pattern), F.struct(F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), step.alias("steps")))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, start, end, kind, kind_order of every match in each row's text; blobs without one give no row."""
    found = blobs.select("blob", F.explode(F.array_compact(F.array(*(_spans(F.col("text"), k, r) for k, r in enumerate(rules))))).alias("f"))
    steps = found.select("blob", "f.order", "f.kind", F.posexplode("f.steps").alias("at", "s"))
    # offsets are running sums over one blob's matches of one kind
    so_far = Window.partitionBy("blob", "order").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("s.gap") + F.col("s.size")).over(so_far)
    return steps.select("blob", (end - F.col("s.size")).alias("start"), end.alias("end"), "kind", F.col("order").alias("kind_order"), F.col("s.ok").alias("ok")).where("ok").drop("ok")


class Ledger:
    """Blobs scanned under a rule version and their findings: Parquet under one shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except Exception as e:  # nothing was scanned yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)))

    def scanned(self, version: str) -> DataFrame:
        return self._read("scanned", "blob binary, rule_version string").where(F.col("rule_version") == version).select("blob")

    def findings(self, version: str) -> DataFrame:
        """One row for each blob that has findings: its spans, by start and then kind."""
        return self._read("findings", "blob binary, spans array<struct<start:long,end:long,kind_order:int,kind:string>>, rule_version string").where(F.col("rule_version") == version).select("blob", "spans")

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan the texts of versions(blob, text) that this version of the rules has not seen; one text of each blob is read.

        Findings are written before the ledger says that a blob was scanned: a run that is lost between the
        two scans again and readers take one row of each blob.
        """
        version = version_of(rules)
        blobs = cut(versions.select("blob").distinct().join(self.scanned(version), "blob", "left_anti"), "unseen")
        texts = versions.join(small_or_not(blobs), "blob", "left_semi")
        # one text of each blob: of the tasks' own first ones, whatever a blob's copies, SPREAD meet before they meet in one
        part = texts.withColumn("part", F.spark_partition_id() % SPREAD).groupBy("blob", "part").agg(F.first("text").alias("text"))
        one = part.groupBy("blob").agg(F.first("text").alias("text"))
        spans = scan_blobs(one, rules).groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", F.col("end"), F.col("kind_order"), "kind"))).alias("spans"))
        spans = spans.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind_order"].alias("kind_order"), s["kind"].alias("kind"))).alias("spans"))
        spans.withColumn("rule_version", F.lit(version)).write.mode("append").parquet(f"{self.path}/findings")
        blobs.withColumn("rule_version", F.lit(version)).write.mode("append").parquet(f"{self.path}/scanned")


def versions_of(docs: DataFrame, path_cols: list[str], text_col: str = "text") -> DataFrame:
    """The versions of docs: path columns, blob (SHA-256 of the text in UTF-8) and text; a null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*path_cols, F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))


def secret_spans(docs: DataFrame, ledger: Ledger, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, rounds: int = 1) -> DataFrame:
    """doc_id and spans (array of start, end, kind_order, kind) for each row of docs, after scanning what the ledger lacks.

    A null or empty text has no spans (an empty array); rows that repeat an id or a text each get a row;
    other columns are ignored. All matches of a rule count, leftmost first and not overlapping, and those
    whose group is too short are dropped afterwards. With several rounds the rows arrive in as many parts, by
    a hash of their ids, and each part's scan passes over the blobs that an earlier part brought.
    """
    versions = versions_of(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"])
    for part in range(rounds):
        ledger.scan(versions.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == part).select("blob", "text"), rules)
    found = ledger.findings(version_of(rules)).groupBy("blob").agg(F.first("spans").alias("spans"))
    return versions.select("doc_id", "blob").join(found, "blob", "left").select("doc_id", F.coalesce("spans", F.array()).alias("spans"))


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts by base kind, a digest of the base spans and all spans as text, for each document of docs.

    The ledger is its own and is filled in two rounds, so that the second goes by what the first has scanned.
    """
    spark = docs.sparkSession
    spans = secret_spans(docs, Ledger(spark, fresh_path(spark, "ledger")), rules=rules, rounds=2)
    base = [r.kind for r in rules if r.base]
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda s: F.array_join(F.transform(s, shown), ",")
    return spans.select(
        "doc_id", of("assign"), of("access"), of("hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redacted(docs: DataFrame, ledger: Ledger, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span of its texts replaced by mark, overlapping spans by one; null texts stay null.

    All columns of docs come back, in order; they are held in one struct, so none clashes with a helper's name.
    Documents are joined with their findings by blob, so rows that repeat an id keep their own texts.
    """
    text = F.col("row").getField(text_col)
    versions = docs.select(F.struct(*map(named, docs.columns)).alias("row")).withColumn("blob", F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)))
    ledger.scan(versions.select("blob", F.coalesce(text, F.lit("")).alias("text")), rules)
    found = ledger.findings(version_of(rules)).groupBy("blob").agg(F.first("spans").alias("spans"))
    joined = versions.join(found, "blob", "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    put = lambda acc, s: F.when(
        s["start"] >= acc["at"], F.struct(F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mark)).alias("out"), s["end"].alias("at"))
    ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))
    finish = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.char_length(text)))
    clean = F.when(F.col("spans").isNull() | text.isNull(), text).otherwise(F.aggregate("spans", start, put, finish))
    return joined.select(*(clean.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))


# The same in DuckDB's SQL. RE2 finds the same leftmost matches of these patterns.
_SQL_KIND = """
    select doc_id, '{kind}' as kind, {order} as kind_order, unnest(range(len(m))) as k, m, p
    from (select doc_id, regexp_extract_all(t, {re}) as m, regexp_split_to_array(t, {re}) as p from d where regexp_matches(t, {re}))"""


def report_sql(rules: tuple[Rule, ...] = RULES) -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    parts = " union all ".join(_SQL_KIND.format(kind=r.kind, order=k, re=quoted(r.pattern)) for k, r in enumerate(rules))
    ok = " or ".join(f"(kind = '{r.kind}' and length(regexp_extract(m[k + 1], {quoted(r.pattern)}, {r.group})) >= {r.least})" for r in rules)
    base = ", ".join(f"'{r.kind}'" for r in rules if r.base)
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
hits as ({parts}),
spans as (
    select doc_id, kind, kind_order,
        list_sum(list_transform(p[1:k + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k], lambda x: length(x))), 0) as start, length(m[k + 1]) as size
    from hits where {ok}),
listed as (
    select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
        string_agg(kind || ':' || start::bigint || ':' || (start + size)::bigint, ',' order by start, kind_order) filter (kind in ({base})) as base,
        string_agg(kind || ':' || start::bigint || ':' || (start + size)::bigint, ',' order by start, kind_order) as spans
    from spans group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
    sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join listed using (doc_id)"""

"""URL filter by the ratio of two character language models, in DataFrame functions only.

Rules decide the URLs that they fit, the longest rule first. Those URLs are also the examples, each distinct one
once: allowed ones train a model of accepted URLs, blocked ones a model of rejected ones. Both are variable-order Markov models
of up to ORDER characters of context, smoothed by interpolation (Witten-Bell): what follows a context is
estimated as far as the context was seen, the rest goes to the next shorter context, down to a uniform
guess. A URL's score is the log likelihood of the whole URL as accepted less that as rejected, by character; it
is allowed if that is at least a threshold, calibrated to the least balanced error on examples that a hash
holds out of both models.

Characters are mapped to a small alphabet, so no table of character sequences exceeds ALPHABET ** (ORDER + 1)
rows; those of contexts, ALPHABET ** ORDER at most, are broadcast, that of weights if a count shows it to be
small. Counts of shorter sequences are sums over longer ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import cut

#: Characters of context.
ORDER = 3
#: Digits count as 0; other characters than these as ~.
_KEPT = "abcdefghijklmnopqrstuvwxyz0/.-_?=&#:%"
ALPHABET = len(_KEPT) + 2
#: Bins of the score in which the threshold is sought, from -SPAN to SPAN.
BINS = 400
SPAN = 4.0
#: Examples are held out of the models, for the threshold, if the MD5 of their text begins with one of these.
HELD_OUT = "012"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules (host, path).
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ?, # or end, A-Z in lower case; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """A struct of the longest rule's name and verdict; null if none fits. Of equally long rules the first."""
    fits = [
        (r, ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path))
        for r in sorted(rules, key=lambda r: -len(r.name))
    ]
    found = reduce(lambda rest, rf: F.when(rf[1], F.struct(F.lit(rf[0].name).alias("rule"), F.lit(rf[0].verdict).alias("verdict"))).otherwise(rest), reversed(fits), F.lit(None).cast("struct<rule:string,verdict:string>"))
    return found


def _plain(text: Column) -> Column:
    """text in the small alphabet, after ORDER starting marks and before an ending one."""
    low = F.translate(F.lower(text), "123456789", "000000000")
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(low, rf"[^{_KEPT.replace('-', '')}\-]", "~"), F.lit("^"))


def _grams(texts: DataFrame) -> DataFrame:
    """Each position's character with its context, gram, with the other columns."""
    plain = texts.withColumn("__t", _plain(F.col("text")))
    return plain.withColumn("gram", F.explode(F.transform(F.sequence(F.lit(1), F.length("__t") - ORDER), lambda i: F.substr("__t", i, F.lit(ORDER + 1))))).drop("__t", "text")


def gram_weights(examples: DataFrame) -> DataFrame:
    """gram and weight, the log ratio of the two models, for every gram of examples(text, accepted or null).

    accepted is null for texts that are in neither model; their grams are weighed all the same.
    """
    level = _grams(examples).groupBy("gram").agg(F.count(F.when(F.col("accepted"), 1)).alias("a"), F.count(F.when(~F.col("accepted"), 1)).alias("r"))
    levels = [cut(level, "grams")]
    for order in range(ORDER, 0, -1):  # counts by shorter and shorter suffixes
        levels.insert(0, levels[0].groupBy(F.substring("gram", 2, order).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
    table = None
    for order, level in enumerate(levels):
        head = F.substring("gram", 1, order).alias("context")
        kinds = [F.sum(k).alias(f"m{k}") for k in "ar"] + [F.count_if(F.col(k) > 0).alias(f"d{k}") for k in "ar"]
        contexts = level.groupBy(head).agg(*kinds)  # ALPHABET ** order rows at most
        now = level.withColumns({"context": F.substring("gram", 1, order), "shorter": F.substring("gram", 2, order)}).join(F.broadcast(contexts), "context")
        if table is not None:
            now = now.join(F.broadcast(table), "shorter")  # as many
        shorter = {k: F.lit(1.0 / ALPHABET) if table is None else F.col(f"s{k}") for k in "ar"}
        p = {k: F.when(F.col(f"m{k}") + F.col(f"d{k}") > 0, (F.col(k) + F.col(f"d{k}") * shorter[k]) / (F.col(f"m{k}") + F.col(f"d{k}"))).otherwise(shorter[k]) for k in "ar"}
        table = now.select(F.col("gram").alias("shorter"), *(p[k].alias(f"s{k}") for k in "ar"))
    return table.select(F.col("shorter").alias("gram"), (F.log("sa") - F.log("sr")).alias("weight"))


def scored(texts: DataFrame, weights: DataFrame) -> DataFrame:
    """texts(key, ..., text) to key and score, the mean weight of its grams.

    Weights are broadcast: the alphabet bounds them to ALPHABET ** (ORDER + 1) grams, whatever the texts.
    """
    return _grams(texts).join(F.broadcast(cut(weights, "weights")), "gram").groupBy("key").agg(F.avg("weight").alias("score"))


def threshold(examples: DataFrame) -> float:
    """The bin edge of score that gives the least mean of the two error rates on examples(score, accepted); 0.0 without both kinds.

    Counts by bin are collected, BINS rows at most.
    """
    bins = examples.where("accepted is not null").groupBy(F.floor(F.least(F.greatest((F.col("score") + SPAN) / (2 * SPAN), F.lit(0.0)), F.lit(1.0)) * BINS).alias("bin"), "accepted").count().collect()
    a = {r["bin"]: r["count"] for r in bins if r["accepted"]}
    b = {r["bin"]: r["count"] for r in bins if not r["accepted"]}
    if not a or not b:
        return 0.0
    errors = [(sum(n for k, n in a.items() if k < edge) / sum(a.values()) + sum(n for k, n in b.items() if k >= edge) / sum(b.values()), abs(edge - BINS / 2), edge) for edge in range(BINS + 1)]
    return min(errors)[2] / BINS * 2 * SPAN - SPAN


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score and threshold for each row of pages.

    Each distinct URL is scored once, as a whole, and joined back to all rows that have it. A null URL and one
    without :// have an empty host and path and fit no rule; a null one is scored as the empty text. Rows that
    repeat an id or URL each get a row; other columns are ignored. Without held-out examples of both kinds the
    threshold is 0, the point where both models find a URL as likely. To the models digits are all alike, and
    so are characters beyond the alphabet; the rules see them as they are.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    urls = rows.select("url").distinct().withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    accepted, held_out = F.col("r.verdict") == "allow", F.substring(F.md5(F.col("url").cast("binary")), 1, 1).isin(*HELD_OUT)
    urls = cut(urls.withColumns({"accepted": accepted, "held_out": held_out}), "urls")
    weights = gram_weights(urls.select(F.col("url").alias("text"), F.when(~F.col("held_out"), F.col("accepted")).alias("accepted")))
    score = scored(urls.select(F.col("url").alias("key"), F.col("url").alias("text")), weights)
    by_url = cut(urls.join(score.withColumnRenamed("key", "url"), "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0))), "scores")
    limit = threshold(by_url.where("held_out").select("score", "accepted"))
    told = F.coalesce(F.col("r.verdict"), F.when(F.col("score") >= limit, "allow").otherwise("block"))
    return rows.join(by_url, "url", "left").select("page_id", "host", "path", F.col("r.rule").alias("rule"), told.alias("verdict"), "score", F.lit(limit).alias("threshold"))


def judged_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB's SQL, without score and threshold."""
    ordered = sorted(rules, key=lambda r: -len(r.name))
    fits = [f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')" for r in ordered]
    name = "case " + " ".join(f"when {f} then '{r.name}'" for r, f in zip(ordered, fits, strict=True)) + " end"
    verdict = "case " + " ".join(f"when {f} then '{r.verdict}'" for r, f in zip(ordered, fits, strict=True)) + " end"
    kept = _KEPT.replace("-", "")
    levels, before = [], {k: f"{1.0 / ALPHABET!r}::double" for k in "ar"}
    source = "seen"
    for o in range(ORDER + 1):
        s, c = f"substring(gram, {ORDER + 1 - o}, {o + 1})", f"substring(gram, {ORDER + 1 - o}, {o})"
        levels.append(f"l{o} as (select *, {s} as s{o}, {c} as c{o}, " + ", ".join(f"sum({k}) over (partition by {s}) as n{k}{o}, sum({k}) over (partition by {c}) as m{k}{o}" for k in "ar") + f" from {source})")
        levels.append(f"d{o} as (select *, " + ", ".join(f"count(distinct case when n{k}{o} > 0 then s{o} end) over (partition by c{o}) as d{k}{o}" for k in "ar") + f" from l{o})")
        levels.append(f"p{o} as (select *, " + ", ".join(f"case when m{k}{o} + d{k}{o} > 0 then (n{k}{o} + d{k}{o} * {before[k]}) / (m{k}{o} + d{k}{o})::double else {before[k]} end as p{k}{o}" for k in "ar") + f" from d{o})")
        before, source = {k: f"p{k}{o}" for k in "ar"}, f"p{o}"
    return f"""
with rows as (select page_id, coalesce(url, '') as url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{_UPPER}', '{_LOWER}') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
texts as (select distinct url, {name} as rule, {verdict} as told, md5(url)[1] in ({', '.join(repr(x) for x in HELD_OUT)}) as held_out from rows),
plain as (select *, repeat('^', {ORDER}) || regexp_replace(translate(lower(url), '123456789', '000000000'), '[^{kept}-]', '~', 'g') || '^' as t from texts),
grams as (select url, case when not held_out then told end as told, substring(t, unnest(range(1, length(t) - {ORDER} + 1)), {ORDER + 1}) as gram from plain),
seen as (select gram, count(*) filter (told = 'allow') as a, count(*) filter (told = 'block') as r from grams group by gram),
{", ".join(levels)},
scores as (select url, avg(ln({before['a']}) - ln({before['r']})) as score from grams join {source} using (gram) group by url),
bins as (select told, floor(least(greatest((score + {SPAN}::double) / {2 * SPAN}::double, 0), 1) * {BINS}) as bin from scores join texts using (url) where told is not null and held_out),
edges as (select edge, (select count(*) from bins where told = 'allow' and bin < edge) / nullif((select count(*) from bins where told = 'allow'), 0)::double
    + (select count(*) from bins where told = 'block' and bin >= edge) / nullif((select count(*) from bins where told = 'block'), 0)::double as error from range({BINS + 1}) e(edge)),
threshold as (select coalesce((select edge / {BINS}::double * {2 * SPAN}::double - {SPAN}::double from edges where error is not null order by error, abs(edge - {BINS / 2}::double), edge limit 1), 0) as bar)
select page_id, host, path, rule, coalesce(told, case when score >= bar then 'allow' else 'block' end) as verdict
from rows join texts using (url) left join scores using (url), threshold"""

"""URL filter: longest fitting rule first, else a logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Store

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
SAMPLE = 20_000  # labelled URLs that fit the model, chosen by hash
FEATURES = 1 << 14
SIZES = (3, 4)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for a null or a URL without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(F.col(url)))).otherwise(F.lit(""))
    return (F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def _rule_hosts(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """(verdict, rule, host, path), the longest rule first."""
    return [(v, r, *(lambda h, _, p: (h, "/" + p))(*r.partition("/"))) for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[1]))]


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    fits = [(F.lit(r), ((host == h) | host.endswith("." + h)) & path.startswith(p)) for _, r, h, p in _rule_hosts(rules)]
    return F.coalesce(*[F.when(ok, r) for r, ok in fits], F.lit(None).cast("string"))


def rule_verdict(rule: Column, rules: Sequence[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(rule == r, F.lit(v)) for v, r in rules], F.lit(None).cast("string"))


def ngrams(host: Column, path: Column, sizes: Sequence[int] = SIZES) -> Column:
    """Character n-grams; marks around host and path keep the two apart and show their ends."""
    def of(text: Column, n: int) -> Column:
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)),
                                                       lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    marked = (F.concat(F.lit("<"), host, F.lit(">")), F.concat(F.lit("{"), path, F.lit("}")))
    return F.concat(*[of(t, n) for t in marked for n in sizes])


def train(labelled: DataFrame, store: Store, features: int = FEATURES, sample: int = SAMPLE):
    """A function that adds ``p`` (probability of allow), from rows (host, path, label 1 for allow).

    Different (host, path, label) count once, however often they stand; at most about ``sample`` of them,
    chosen by the hash of host and path, fit the model.  With labels of one kind only, or none, every URL gets that kind, or allow.
    """
    labelled = labelled.select("host", "path", "label").distinct()
    kinds = {r[0]: r[1] for r in labelled.groupBy("label").count().collect()}
    if len(kinds) < 2:
        return lambda df: df.withColumn("p", F.lit(float(next(iter(kinds), 1))))
    share = int((1 << 30) * min(1.0, sample / sum(kinds.values())))
    hashing = HashingTF(numFeatures=features, binary=True, inputCol="grams", outputCol="features")
    part = labelled.where(F.pmod(F.xxhash64("host", "path"), F.lit(1 << 30)) <= share)
    rows = store.keep(hashing.transform(part.select(F.col("label").cast("double").alias("label"),
                                                    ngrams(F.col("host"), F.col("path")).alias("grams"))).drop("grams"), "train")
    model = LogisticRegression(maxIter=25, regParam=1e-3, standardization=False, probabilityCol="pair").fit(rows)

    def score(df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array
        ready = hashing.transform(df.withColumn("grams", ngrams(F.col("host"), F.col("path"))))
        return model.transform(ready).withColumn("p", F.get(vector_to_array("pair"), 1)).drop(
            "grams", "features", "rawPrediction", "pair", "prediction")
    return score


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id",
               url_col: str = "url", sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_allow) for each row of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's; the
    longest wins and decides.  The other URLs get the model's verdict: allow from
    a probability of 0.5.  ``labelled`` is the small table (url, label 0/1) the model is
    trained on; without it the URLs of ``pages`` that a rule decides serve as labels.  A null
    or malformed URL has an empty host and path, which no rule fits; repeated rows
    are judged alike; an empty table gives no rows; other columns are ignored.
    """
    store = Store(pages.sparkSession, "urls")
    def parts(df: DataFrame, url: str, *keep: Column) -> DataFrame:
        text = df.select(*keep, F.coalesce(F.col(url).cast("string"), F.lit("")).alias("_url"))
        host, path = split_url("_url")
        return text.withColumn("host", host).withColumn("path", path).drop("_url")
    rows = parts(pages, url_col, F.col(id_col).cast("bigint").alias("page_id"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("ruled", rule_verdict(F.col("rule"), rules))
    if labelled is None:
        known = rows.where("rule IS NOT NULL").select("host", "path", (F.col("ruled") == "allow").cast("int").alias("label"))
    else:
        known = parts(labelled, "url", F.col("label").cast("int").alias("label")).where("label IS NOT NULL")
    scored = train(known, store, sample=sample)(rows)
    verdict = F.coalesce("ruled", F.when(F.col("p") >= 0.5, F.lit("allow")).otherwise(F.lit("block")))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("p").alias("p_allow"))

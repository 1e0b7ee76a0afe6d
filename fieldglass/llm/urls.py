"""URL filters: host/path rules, and a ratio of two character language models.

Only DataFrame functions are used.  The models are smoothed variable-order
Markov models over a fixed alphabet, so their tables have a proven bound.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import ascii_lower, materialize

#: Longest context, in characters.  With 33 symbols there are at most 33^4 (about 1.2 million) windows.
ORDER = 3
#: Weight of the next shorter context, in pseudo-counts.
BACKOFF = 4.0
#: Of the URLs with a rule, one in so many calibrates the threshold and is not counted by the models.
CALIBRATION_FOLD = 5
#: Width of a bin of the calibrated score, and the number of bins to either side of 0.
BIN, BINS = 0.02, 250


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` for URLs of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it or for null."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """struct(name, verdict) of the longest rule that fits, else null.  Ties go to the rule named first."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def symbols(host: Column, path: Column) -> Column:
    """Host and path over the models' alphabet: a-z, one sign for digits, ``. / - _``, one for the rest, and the two ends."""
    s = F.regexp_replace(ascii_lower(F.concat(host, path)), "[0-9]", "0")
    s = F.regexp_replace(s, r"[^a-z0./\-_]", "*")
    return F.concat(F.lit("^" * ORDER), s, F.lit("$"))


def _windows(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - ORDER), lambda i: F.substring(text, i, ORDER + 1))


@dataclass
class UrlModel:
    """``ratios``: window -> log p(accepted) - log p(rejected) of its last character; ``threshold`` for the mean."""

    ratios: DataFrame
    threshold: float


def _ratios(counts: DataFrame) -> DataFrame:
    """Smoothed log ratios for every window of ``counts`` (gram, good, bad), from order 0 upwards."""
    size = ORDER + 1
    out = counts
    for label in ("good", "bad"):
        p = F.lit(1.0 / 33)
        for n in range(1, size + 1):
            tail, stem = F.substring("gram", size - n + 1, n), F.substring("gram", size - n + 1, n - 1)
            mine, all_ = F.sum(label).over(Window.partitionBy(tail)), F.sum(label).over(Window.partitionBy(stem)) if n > 1 else None
            if n == 1:
                total = counts.agg(F.sum(label)).first()[0] or 0
                out = out.withColumn("p", (mine + BACKOFF * p) / (F.lit(float(total)) + BACKOFF))
            else:
                out = out.withColumn("p", (mine + BACKOFF * F.col("p")) / (all_ + BACKOFF))
            p = F.col("p")
        out = out.withColumn(f"log_{label}", F.ln("p")).drop("p")
    return out.select("gram", (F.col("log_good") - F.col("log_bad")).alias("ratio"))


def _scored(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """Add ``mean_ratio``: the mean of the ratios of a row's windows.  One row in gives one row out."""
    keep = urls.columns
    rows = urls.withColumn("_row", F.monotonically_increasing_id()).withColumn("gram", F.explode(_windows(F.col("_symbols"))))
    joined = rows.join(F.broadcast(ratios), "gram", "left")
    return joined.groupBy("_row", *keep).agg(F.avg(F.coalesce("ratio", F.lit(0.0))).alias("mean_ratio")).drop("_row")


def fit_url_model(urls: DataFrame) -> UrlModel:
    """Fit on ``urls`` with columns ``_symbols`` and ``_label`` ('allow', 'block' or null).

    Counts cover all labelled rows but the calibration fold.  The threshold is
    the one with the best balanced accuracy on that fold, the middle one of
    equals; 0 where a class has no rows there.
    """
    fold = F.conv(F.substring(F.md5("_symbols"), 1, 8), 16, 10).cast("long") % CALIBRATION_FOLD == 0
    train = ~fold & F.col("_label").isNotNull()
    grams = urls.select(
        F.explode(_windows(F.col("_symbols"))).alias("gram"),
        (train & (F.col("_label") == "allow")).cast("long").alias("good"),
        (train & (F.col("_label") == "block")).cast("long").alias("bad"),
    )
    counts = grams.groupBy("gram").agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    ratios = materialize(_ratios(materialize(counts, "url-counts")), "url-ratios")
    held = _scored(urls.where(fold & F.col("_label").isNotNull()).select("_symbols", "_label"), ratios)
    at = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("mean_ratio") / BIN))).cast("int")
    bins = held.groupBy(at.alias("bin")).agg(F.sum((F.col("_label") == "allow").cast("long")).alias("good"), F.sum((F.col("_label") == "block").cast("long")).alias("bad")).collect()
    good, bad = sum(r.good for r in bins), sum(r.bad for r in bins)
    if not good or not bad:
        return UrlModel(ratios, 0.0)
    by = {r.bin: r for r in bins}
    gains, below_good, below_bad = [], 0, 0
    for b in range(-BINS, BINS + 2):
        gains.append((below_bad / bad - below_good / good, b))
        if b in by:
            below_good, below_bad = below_good + by[b].good, below_bad + by[b].bad
    top = max(g for g, _ in gains)
    best = [b for g, b in gains if g == top]
    return UrlModel(ratios, best[len(best) // 2] * BIN)


def filter_urls(pages: DataFrame, rules: Sequence[UrlRule], url: str = "url") -> DataFrame:
    """Judge every row's URL: the longest fitting rule decides, the model's ratio where none fits.

    Adds ``host``, ``path``, ``rule`` (null without one), ``mean_ratio`` and
    ``verdict`` ('allow' or 'block'); columns of these names are replaced.
    A null or malformed URL has an empty host and path and is judged by the
    model on the empty string.  Repeated rows stay repeated; an empty table
    gives an empty table.
    """
    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "mean_ratio", "verdict")]
    parts = pages.select(F.struct(*own).alias("_page"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = parts.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    lettered = ruled.withColumn("_symbols", symbols(F.col("host"), F.col("path")))
    model = fit_url_model(lettered.select("_symbols", F.col("_rule.verdict").alias("_label")))
    scored = _scored(lettered, model.ratios)
    method = F.when(F.col("mean_ratio") >= model.threshold, "allow").otherwise("block")
    return scored.select("_page.*", "host", "path", F.col("_rule.name").alias("rule"), "mean_ratio", F.coalesce(F.col("_rule.verdict"), method).alias("verdict"))

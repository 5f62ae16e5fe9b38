"""URL filter: host and path rules, and a character language-model ratio for the rest.

URLs that a rule decides train two variable-order Markov models over characters, one of accepted and
one of rejected URLs. Contexts of up to `ORDER` characters are blended by Witten-Bell smoothing: an
unseen context hands over to the next shorter one, down to a uniform distribution. A URL's score is
the difference of the two log-likelihoods per character. The models read everything behind the scheme,
query string and fragment included (with the host A-Z lower-cased); rules read host and path only. One half of the decided URLs, by hash, gives
the counts, the other half calibrates the threshold: the cut with the smallest mean of both error
rates. Other URLs are blocked when their score is below it.

Everything is DataFrame functions. Models are tables of distinct character sequences, joined on the
sequence, so a sequence found in every URL is a hot key that Spark splits by size; equal URLs are
scored once. Counts cover all distinct URLs, each once however many rows hold it, for equal copies of a
URL say nothing new about others. The driver sees the calibrated threshold only.

Defined results: a null URL, or one without "://", has an empty host and path, no rule, and no
evidence: allow. If one of the classes has no URLs to learn or calibrate from, the threshold is 0;
with no decided URL at all, everything else is allowed. Host rules are compared label by label.
Repeated rows and ids get equal verdicts; an empty table gives an empty result; only the two named
columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inferbatch.llm.exact_dedup import UPPER
from inferbatch.session import materialize

# Action, host, path prefix.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
ORDER = 4
# Scores are kept in millionths and calibrated in steps of a hundredth between these bounds.
MILLION = 1_000_000
BOUND = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without a scheme."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(u, instr(u, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower())
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return host, path


def ruled(urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Add host, path, rule and action (null without a rule) to rows with a column `u`."""
    host, path = host_and_path(F.col("u"))
    rows = urls.withColumns({"host": host, "path": path})
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The longest rule that fits wins, so the shorter ones are asked last.
    for what, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        inside = (F.col("host") == name) | F.col("host").endswith(f".{name}")
        fits = inside & F.col("path").startswith(prefix)
        rule = F.when(fits, F.lit(name + prefix)).otherwise(rule)
        action = F.when(fits, F.lit(what)).otherwise(action)
    return rows.withColumns({"rule": rule, "action": action})


def sequences(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """Every character of every URL with up to `order` characters before it, as one string.

    The start is padded with U+0002 and the end marked with U+0003.
    """
    padded = F.concat(F.lit("\x02" * order), F.col("url"), F.lit("\x03"))
    length = F.char_length("url") + 1
    at = F.explode(F.sequence(F.lit(1), length))
    return urls.withColumns({"padded": padded, "length": length}).withColumn("at", at).withColumn(
        "gram", F.expr(f"substring(padded, at, {order + 1})")
    )


def gram_ratios(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """Distinct sequences with counts per class to the log ratio of their last character."""
    names = ("good", "bad")
    rows = grams.withColumn("ch", F.substring("gram", order + 1, 1))
    uniform = F.lit(1.0) / rows.agg(F.count_distinct("ch") + 1).first()[0]
    rows = rows.withColumns({f"p_{c}": uniform for c in names})
    for k in range(order + 1):
        rows = rows.withColumn("ctx", F.substring("gram", order + 1 - k, k) if k else F.lit(""))
        seen = rows.groupBy("ctx", "ch").agg(*[F.sum(c).alias(f"c_{c}") for c in names])
        totals = seen.groupBy("ctx").agg(
            *[F.sum(f"c_{c}").alias(f"n_{c}") for c in names],
            *[F.count_if(F.col(f"c_{c}") > 0).alias(f"t_{c}") for c in names],
        )
        rows = rows.join(seen, ["ctx", "ch"]).join(totals, "ctx")
        blended = {
            f"p_{c}": F.when(
                F.col(f"n_{c}") > 0,
                F.try_divide(
                    F.col(f"c_{c}") + F.col(f"t_{c}") * F.col(f"p_{c}"), F.col(f"n_{c}") + F.col(f"t_{c}")
                ),
            ).otherwise(F.col(f"p_{c}"))
            for c in names
        }
        drop = [f"{x}_{c}" for x in "cnt" for c in names]
        rows = rows.withColumns(blended).drop("ctx", *drop)
        rows = materialize(rows, f"order{k}")
    ratio = F.round((F.log("p_good") - F.log("p_bad")) * MILLION).cast("bigint")
    return rows.select("gram", ratio.alias("ratio"))


def calibrated(scores: DataFrame) -> int:
    """Threshold, in millionths, with the smallest mean error over scored rows with an action."""
    step = MILLION // 100
    cell = F.greatest(F.least(F.floor(F.col("score") / step), F.lit(100 * BOUND)), F.lit(-100 * BOUND))
    cells = scores.groupBy(cell.alias("cell")).agg(
        F.count_if(F.col("action") == "allow").alias("good"), F.count_if(F.col("action") == "block").alias("bad")
    )
    # At most 1,001 rows, whatever the input: one task sums them up.
    below = W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    sums = cells.select(
        "cell",
        F.coalesce(F.lag("cell").over(W.orderBy("cell")) + 1, F.col("cell")).alias("after"),
        F.coalesce(F.sum("good").over(below), F.lit(0)).alias("lost"),
        F.coalesce(F.sum("bad").over(below), F.lit(0)).alias("caught"),
    )
    whole = cells.agg(F.sum("good"), F.sum("bad")).first()
    if not whole[0] or not whole[1]:
        return 0
    error = F.col("lost") / whole[0] + 1 - F.col("caught") / whole[1]
    best = sums.orderBy(F.round(error, 9), F.abs("cell"), "cell").first()
    # Any cut between the two neighbouring cells gives the same errors: take the middle.
    return int(best["after"] + best["cell"]) * step // 2


def judged(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    order: int = ORDER,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict and the score per character (or null)."""
    rows = ruled(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("u")), rules)
    behind_host = F.expr("substring(u, instr(u, '://') + 3 + char_length(host))")
    url = F.when(F.instr("u", "://") > 0, F.concat("host", behind_host)).otherwise("")
    rows = rows.withColumn("url", url)
    first, second = F.xxhash64("url"), F.xxhash64(F.lit("url"), "url")
    rows = rows.withColumns({"k1": first, "k2": second})
    urls = rows.filter("url <> ''").groupBy("k1", "k2", "url").agg(F.max("action").alias("action"))
    urls = materialize(urls, "urls")
    trains = (F.pmod("k1", F.lit(2)) == 0) & F.col("action").isNotNull()
    places = sequences(urls, order)
    counts = places.groupBy("gram").agg(
        F.count_if(trains & (F.col("action") == "allow")).alias("good"),
        F.count_if(trains & (F.col("action") == "block")).alias("bad"),
    )
    ratios = gram_ratios(materialize(counts, "grams"), order)
    scores = places.select("k1", "k2", "action", "length", "gram").join(ratios, "gram")
    scores = scores.groupBy("k1", "k2", "action", "length").agg(F.sum("ratio").alias("total"))
    score = (F.col("total") / F.col("length")).alias("score")
    scores = materialize(scores.select("k1", "k2", "action", score), "scores")
    threshold = calibrated(scores.filter((F.pmod("k1", F.lit(2)) != 0) & F.col("action").isNotNull()))
    found = rows.join(scores.drop("action"), ["k1", "k2"], "left")
    by_model = F.when(F.col("score") < threshold, "block").otherwise("allow")
    return found.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("action", by_model).alias("verdict"),
        (F.col("score") / MILLION).alias("score"),
    )

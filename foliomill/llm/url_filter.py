"""URL filter: rules first, then a ratio of two character language models.

Native throughout: DataFrame functions only. A rule fits its host and all subdomains if the
path starts with the rule's; the longest rule wins. Urls that a rule decides are the training
text of two smoothed variable-order Markov models, one of accepted and one of rejected urls:
the chance of a character after its last three is its relative frequency, interpolated with
the chance after its last two, and so on down to a uniform one. A url without a rule is
decided by the length-normalised difference of its log-likelihoods, through a calibration.

The models read the characters of the whole url, scheme, query and fragment included; equal
urls are read once and weighed by their number. The calibration is cross-fitted: urls are
dealt to two folds by hash, and each fold is scored by models that learn from the other one.
If a fold lacks accepted or rejected urls, so that one of these models would be empty, the
difference itself decides, shifted by the classes' odds.

Every n-gram of the corpus gets its log ratios from count tables that are far smaller than the
urls; the join with them is left to AQE, which broadcasts what is small by measured size.

Defined results: a null url or one without ``://`` has empty host and path; without urls of
both verdicts to learn from, urls without a rule are allowed; ties at the threshold allow;
rows are judged one by one, so repeated rows agree, whatever their page_id; ``keep_allowed``
judges rows too, so a null page_id neither keeps nor drops any other row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path) of the rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

ORDER = 4
PRIOR = 0.5
ALPHABET = 96


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def with_rules(pages: DataFrame, rules=RULES, kept: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns ``kept`` and ``url, host, path, rule, ruled``: the longest rule that fits each url, if any."""
    host, path = host_and_path(F.col("url"))
    out = pages.select(*kept, F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, ruled = F.when(fits, h + p).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return out.withColumn("rule", rule).withColumn("ruled", ruled)


def _fold() -> Column:
    return F.md5("url").substr(1, 1).isin(*"01234567").cast("int")


#: Models: all labelled urls, and those of one fold, which score the other.
MODELS = ("", "0", "1")


def _log_ratios(counts: DataFrame) -> DataFrame:
    """``gram, ratio, ratio0, ratio1`` for every full-length n-gram, from its counts ``a0, a1`` (accepted, by fold) and ``r0, r1``."""
    sums = [F.sum(f"{x}{m}").alias(f"{x}{m}") for x in "ar" for m in MODELS]
    level, weight = None, PRIOR * 10
    for k in range(1, ORDER + 1):
        own = counts.groupBy(F.expr(f"right(gram, {k})").alias("g")).agg(*sums).withColumn("c", F.expr(f"left(g, {k - 1})"))
        around = own.groupBy("c").agg(*[F.sum(f"{x}{m}").alias(f"c{x}{m}") for x in "ar" for m in MODELS])
        made = own.join(around, "c")
        if level is not None:
            made = made.withColumn("s", F.expr(f"right(g, {k - 1})")).join(level, "s")
        before = lambda x: F.lit(1 / ALPHABET) if level is None else F.col(f"p{x}")  # noqa: B023, E731
        level = made.select(F.col("g").alias("s"), *[((F.col(x) + weight * before(x)) / (F.col(f"c{x}") + weight)).alias(f"p{x}") for x in (f"{y}{m}" for y in "ar" for m in MODELS)])
    return level.select(F.col("s").alias("gram"), *[(F.log(f"pa{m}") - F.log(f"pr{m}")).alias(f"ratio{m}") for m in MODELS])


@dataclass
class Calibration:
    """Chance of acceptance as a logistic function of the log-likelihood difference."""

    slope: float
    shift: float
    known: bool

    @staticmethod
    def of(stats: dict) -> Calibration:
        """From count, sum and sum of squares of both classes: two normal densities of one variance."""
        na, nr = stats["na"] or 0, stats["nr"] or 0
        if not na or not nr:
            return Calibration(0.0, 0.0, False)
        if not all(stats[f"n{x}{m}"] for x in "ar" for m in "01"):
            return Calibration(1.0, math.log(na / nr), True)
        ma, mr = stats["sa"] / na, stats["sr"] / nr
        spread = max((stats["qa"] - na * ma * ma + stats["qr"] - nr * mr * mr) / (na + nr), 1e-6)
        if ma <= mr:
            return Calibration(0.0, math.log(na / nr), True)
        return Calibration((ma - mr) / spread, (mr * mr - ma * ma) / (2 * spread) + math.log(na / nr), True)


def score_urls(ruled: DataFrame) -> tuple[DataFrame, Calibration]:
    """``url, llr`` of every distinct url, and the calibration."""
    urls = ruled.groupBy("url").agg(F.sum(F.expr("cast(ruled = 'allow' as long)")).alias("la"), F.sum(F.expr("cast(ruled = 'block' as long)")).alias("lr"))
    urls = materialize(urls.select("url", F.coalesce("la", F.lit(0)).alias("la"), F.coalesce("lr", F.lit(0)).alias("lr"), _fold().alias("fold")))
    padded = F.concat(F.lit("^" * (ORDER - 1)), "url", F.lit("$"))
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.length("url") + 1), lambda i: F.substr(padded, i, F.lit(ORDER)))).alias("gram")
    grams = urls.select("url", "fold", "la", "lr", cut)
    own = [F.sum(F.when(F.col("fold") == int(m), F.col(f"l{x}")).otherwise(0) if m else F.col(f"l{x}")).alias(f"{x}{m}") for x in "ar" for m in MODELS]
    ratios = _log_ratios(materialize(grams.groupBy("gram").agg(*own)))
    ratio = F.when(F.col("fold") == 0, F.col("ratio1")).otherwise(F.col("ratio0"))
    scores = grams.select("url", "fold", "gram").join(ratios, "gram").groupBy("url").agg((F.sum("ratio") / F.count("*")).alias("llr"), (F.sum(ratio) / F.count("*")).alias("held"))
    scored = materialize(scores.join(urls, "url"))
    of = lambda x: (F.sum(f"l{x}").alias(f"n{x}"), F.sum(F.col(f"l{x}") * F.col("held")).alias(f"s{x}"), F.sum(F.col(f"l{x}") * F.col("held") * F.col("held")).alias(f"q{x}"), *[F.sum(F.when(F.col("fold") == int(m), F.col(f"l{x}"))).alias(f"n{x}{m}") for m in "01"])
    return scored.select("url", "llr"), Calibration.of(scored.agg(*of("a"), *of("r")).first().asDict())


def judge(pages: DataFrame, rules=RULES, kept: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns ``kept`` and ``host, path, rule, verdict, score``; the score is the models' chance of acceptance."""
    ruled = with_rules(pages, rules, kept)
    scores, fitted = score_urls(ruled)
    out = ruled.join(scores, "url", "left")
    logit = F.lit(fitted.slope) * F.col("llr") + F.lit(fitted.shift)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
    model = F.when(logit >= 0, "allow").otherwise("block") if fitted.known else F.lit("allow")
    return out.select(*kept, "host", "path", "rule", F.coalesce("ruled", model).alias("verdict"), score.alias("score"))


def keep_allowed(pages: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``pages`` whose url is allowed."""
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row")
    judged = judge(pages.select(row, "url"), rules, ("_row",))
    return judged.where("verdict = 'allow'").select("_row.*")


def _oracle() -> str:
    by_length = sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in by_length)
    ruled = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in by_length)
    w, models = PRIOR * 10, [f"{x}{m}" for x in "ar" for m in MODELS]
    levels = []
    for k in range(1, ORDER + 1):
        before = (lambda x: f"1.0 / {ALPHABET}") if k == 1 else (lambda x: f"b.p{x}")
        join = "" if k == 1 else f"JOIN level{k - 1} b ON b.g = right(o.g, {k - 1})"
        levels.append(f"""own{k} AS (SELECT right(gram, {k}) AS g, {", ".join(f"sum({x})::DOUBLE AS {x}" for x in models)} FROM counts GROUP BY 1),
around{k} AS (SELECT left(g, {k - 1}) AS c, {", ".join(f"sum({x}) AS c{x}" for x in models)} FROM own{k} GROUP BY 1),
level{k} AS (SELECT o.g, {", ".join(f"(o.{x} + {w} * {before(x)}) / (c{x} + {w}) AS p{x}" for x in models)} FROM own{k} o JOIN around{k} ON c = left(o.g, {k - 1}) {join})""")
    own = ", ".join(f"sum(l{x}{f' * (fold = {m})::INT' if m else ''}) AS {x}{m}" for x in "ar" for m in MODELS)
    return f"""
WITH cut AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE {rule} END AS rule, CASE {ruled} END AS ruled FROM parts),
urls AS (SELECT url, count(*) FILTER (ruled = 'allow') AS la, count(*) FILTER (ruled = 'block') AS lr, (substr(md5(url), 1, 1) < '8')::INT AS fold FROM ruled GROUP BY url),
grams AS (SELECT url, fold, la, lr, unnest(list_transform(range(1, length(url) + 2), lambda i: substr('{"^" * (ORDER - 1)}' || url || '$', i, {ORDER}))) AS gram FROM urls),
counts AS (SELECT gram, {own} FROM grams GROUP BY gram),
{", ".join(levels)},
scored AS (SELECT url, sum(ln(pa) - ln(pr)) / count(*) AS llr, sum(CASE WHEN fold = 0 THEN ln(pa1) - ln(pr1) ELSE ln(pa0) - ln(pr0) END) / count(*) AS held FROM grams JOIN level{ORDER} ON g = gram GROUP BY url),
stats AS (SELECT sum(la) AS na, sum(lr) AS nr, sum(la * held) / sum(la) AS ma, sum(lr * held) / sum(lr) AS mr, sum(la * held * held) AS qa, sum(lr * held * held) AS qr,
  sum(la * fold) > 0 AND sum(la * (1 - fold)) > 0 AND sum(lr * fold) > 0 AND sum(lr * (1 - fold)) > 0 AS fair FROM scored JOIN urls USING (url)),
fitted AS (SELECT *, greatest((qa - na * ma * ma + qr - nr * mr * mr) / (na + nr), 1e-6) AS spread FROM stats),
line AS (SELECT na > 0 AND nr > 0 AS known, CASE WHEN NOT fair THEN 1 WHEN ma <= mr THEN 0 ELSE (ma - mr) / spread END AS slope,
  CASE WHEN NOT fair OR ma <= mr THEN ln(na / nr) ELSE (mr * mr - ma * ma) / (2 * spread) + ln(na / nr) END AS shift FROM fitted)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN NOT coalesce(known, false) OR slope * llr + shift >= 0 THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled LEFT JOIN scored USING (url), line
"""


#: Rules, models and calibration for DuckDB.
ORACLE = _oracle()

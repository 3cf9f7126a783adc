"""URL filter by rules and a character language-model ratio (DataFrame functions only).

Rules name a host and a path prefix; the longest rule that fits a URL decides.
The URLs that rules accept and reject teach two character models, and the
models decide the URLs that no rule fits.

1. Every place of a URL is a gram: a symbol and the ``ORDER`` symbols before it.
   Grams are counted per class, map-side first, and the counts of all shorter
   contexts follow from these.
2. A model is a variable-order Markov model with Witten-Bell smoothing: the
   probability of a symbol after a context mixes its count there with its
   probability after the context that is one symbol shorter; contexts that the
   class holds fewer than ``LEAST`` times are passed over.  Each order is one
   equality join of distinct grams, in which a key meets no more rows than
   there are symbols.
3. A URL's score is the sum of its grams' log ratios over its length.  Grams
   that hold more than 1/``HOT`` of all places are at most ``HOT`` and are
   broadcast; the others meet their weights in a shuffled join.
4. Labelled URLs set aside from the counts calibrate the score: with normal
   densities of one variance for both classes, the log odds are linear in it.

Counts and weights cover all URLs and grow with them; log ratios are whole
numbers of 1/``SCALE``, so that sums do not depend on their order.

Defined cases: a null URL is empty; a URL without ``://`` has an empty host and
path and is scored whole; an empty text is scored by its end alone; repeated
rows count each and get one verdict; without set-aside URLs of both classes, or
if their means are not apart the right way, the score's sign decides (zero: allow);
an empty table gives an empty result.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import ascii_lower, materialise

ORDER = 5
LEAST = 2
HOT = 1024
SCALE = 1 << 20
START, END = "\x02", "\x03"

# (host, path, allow): the rules of the registered query
RULES = [("net", "/", False), ("example.net", "/en/", True), ("example.com", "/de/", False), ("org", "/fr/", True)]


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and the text that the models read."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return (ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
            ascii_lower(F.when(at > 0, rest).otherwise(url)))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, bool]]) -> Column:
    """struct(size, rule, allow) of the longest rule whose host is ``host`` or a parent domain of it and whose path begins ``path``.

    ``rules`` is a configuration of moderate size; of equal rules that differ, allow wins.
    """
    by_host: dict[str, list[Column]] = {}
    for h, p, allow in rules:
        h = h.lower()
        by_host.setdefault(h, []).append(F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(allow).alias("allow"), F.lit(p).alias("path")))
    if not by_host:
        return F.lit(None).cast("struct<size:int,rule:string,allow:boolean,path:string>")
    table = F.map_from_arrays(F.array(*map(F.lit, by_host)), F.array(*[F.array(*v) for v in by_host.values()]))
    most = max(h.count(".") for h in by_host) + 1  # labels of the longest rule host: no longer suffix can be one
    labels = F.slice(F.reverse(F.split(host, r"\.")), 1, most)
    domains = F.transform(labels, lambda _, i: F.array_join(F.reverse(F.slice(labels, F.lit(1), i + 1)), "."))
    found = F.flatten(F.transform(domains, lambda d: F.coalesce(F.try_element_at(table, d), F.expr("cast(array() as array<struct<size:int,rule:string,allow:boolean,path:string>>)"))))
    return F.array_max(F.filter(found, lambda r: F.startswith(path, r["path"])))


def judged_by_rule(pages: DataFrame, rules: list[tuple[str, str, bool]]) -> DataFrame:
    """(_row, page_id, host, path, rule, _label, _text, _held) of every row, written once; ``_label``: the rule's word."""
    host, path, text = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), text.alias("_text"))
    rows = rows.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    return materialise(rows.select(F.monotonically_increasing_id().alias("_row"), "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
                                   F.col("_rule.allow").alias("_label"), "_text",
                                   F.substring(F.md5(F.col("_text").cast("binary")), 1, 1).isin("0", "1", "2").alias("_held")), "url-rules")


def _grams(rows: DataFrame, order: int, *keep: str) -> DataFrame:
    """One row per symbol of ``_text`` and its end: the symbol with the ``order`` symbols before it."""
    chars = F.filter(F.split("_text", ""), lambda c: c != "")
    symbols = F.concat(F.array_repeat(F.lit(START), order), chars, F.array(F.lit(END)))
    rows = rows.select(*keep, symbols.alias("_symbols"))
    return rows.select(*keep, F.explode(F.transform(
        F.sequence(F.lit(1), F.size("_symbols") - order), lambda i: F.array_join(F.slice("_symbols", i, F.lit(order + 1)), ""))).alias("_gram"))


def gram_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """Per order and gram: places in all URLs, and for each class the count, the count of its context and the symbols seen after that."""
    teach = F.col("_label").isNotNull() & ~F.col("_held")
    ones = [F.sum(F.when(teach & (F.col("_label") == want), 1).otherwise(0)).alias(n) for n, want in (("_n1", True), ("_n0", False))]
    full = _grams(rows, order, "_label", "_held").groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"), *ones)
    every = full.select(F.explode(F.sequence(F.lit(0), F.lit(order))).alias("_order"), "_gram", "_n", "_n1", "_n0")
    counts = (every.select("_order", F.expr("substring(_gram, -(_order + 1))").alias("_gram"), "_n", "_n1", "_n0")
              .groupBy("_order", "_gram").agg(*[F.sum(c).alias(c) for c in ("_n", "_n1", "_n0")]))
    context = "over (partition by _order, substring(_gram, 1, _order))"
    return materialise(counts.select("*", *[F.expr(f"{what} {context}").alias(name) for what, name in (
        ("sum(_n1)", "_t1"), ("sum(_n0)", "_t0"), ("sum(int(_n1 > 0))", "_d1"), ("sum(int(_n0 > 0))", "_d0"), ("count(*)", "_v"))]), "url-grams")


def gram_weights(counts: DataFrame, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """(_gram, _n, _w): every full gram, its places, and its log probability ratio in units of 1/``SCALE``."""
    shorter = None
    for k in range(order + 1):
        at = counts.filter(F.col("_order") == k)
        if k:
            at = at.join(shorter, F.substring("_gram", 2, order + 1) == F.col("_tail"))
        else:
            at = at.withColumns({"_q1": 1 / F.col("_v"), "_q0": 1 / F.col("_v")})
        mixed = [F.when(F.col(f"_t{c}") >= least, (F.col(f"_n{c}") + F.col(f"_d{c}") * F.col(f"_q{c}")) / (F.col(f"_t{c}") + F.col(f"_d{c}")))
                 .otherwise(F.col(f"_q{c}")).alias(f"_q{c}") for c in "10"]
        at = at.select("_gram", "_n", *mixed)
        shorter = at.select(F.col("_gram").alias("_tail"), "_q1", "_q0")
    return at.select("_gram", "_n", F.round(F.log(F.col("_q1") / F.col("_q0")) * SCALE).cast("long").alias("_w"))


def scores(rows: DataFrame, weights: DataFrame, places: int, order: int = ORDER) -> DataFrame:
    """(_row, _score): the log-likelihood difference per symbol."""
    frequent = F.col("_n") * HOT > places
    hot = weights.filter(frequent).select("_gram", "_w")  # at most HOT rows, as their places add up
    rest = weights.filter(~frequent).select("_gram", "_w")
    at = _grams(rows, order, "_row")
    summed = [part.groupBy("_row").agg(F.sum("_w").alias("_w"), F.count(F.lit(1)).alias("_n")) for part in (
        at.join(F.broadcast(hot), "_gram"),
        at.join(F.broadcast(hot), "_gram", "left_anti").join(rest, "_gram"))]
    return summed[0].unionAll(summed[1]).groupBy("_row").agg((F.sum("_w") / SCALE / F.sum("_n")).alias("_score"))


def calibration(scored: DataFrame) -> tuple[float, float]:
    """Slope and offset of the log odds for ``allow``, from the set-aside rows of ``scored``; one row reaches the driver."""
    held = scored.filter("_held and _label is not null")
    stats = [f(F.when(F.col("_label") == want, F.col("_score"))).alias(f"{n}{int(want)}")
             for want in (True, False) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))]
    r = held.agg(*stats).first()
    if not r.n1 or not r.n0 or r.m1 <= r.m0:
        return 1.0, 0.0
    slope = (r.m1 - r.m0) / ((r.n1 * r.v1 + r.n0 * r.v0) / (r.n1 + r.n0) + 1e-6)
    return slope, -slope * (r.m1 + r.m0) / 2


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, bool]], order: int = ORDER, least: int = LEAST, allow_from: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule, probability that the models allow it, verdict.

    ``allow_from`` is the calibrated probability from which a URL without rule is allowed.
    """
    if not 0 < allow_from < 1:
        raise ValueError("allow_from must lie between 0 and 1")
    rows = judged_by_rule(pages, rules)
    counts = gram_counts(rows, order)
    places = counts.filter("_order = 0").agg(F.sum("_n")).first()[0] or 0
    weights = materialise(gram_weights(counts, order, least), "url-weights")
    scored = materialise(rows.select("_row", "page_id", "host", "path", "rule", "_label", "_held")
                         .join(scores(rows, weights, places, order), "_row"), "url-scores")
    slope, offset = calibration(scored)
    odds = F.col("_score") * slope + offset
    allow = F.coalesce("_label", odds >= log(allow_from / (1 - allow_from)))
    return scored.select("page_id", "host", "path", "rule", (1 / (1 + F.exp(-odds))).alias("allow_probability"),
                         F.when(allow, "allow").otherwise("block").alias("verdict"))


def keep_allowed(pages: DataFrame, rules: list[tuple[str, str, bool]], **options) -> DataFrame:
    """The rows of ``pages`` whose URL is allowed, all columns as they were; a verdict depends on the URL alone."""
    urls = pages.select(F.coalesce("url", F.lit("")).alias("url")).distinct()
    blocked = judge_urls(urls.withColumn("page_id", F.col("url")), rules, **options).filter("verdict = 'block'").select(F.col("page_id").alias("_blocked"))
    return pages.join(blocked, F.coalesce(pages["url"], F.lit("")) == F.col("_blocked"), "left_anti")


def url_report(pages: DataFrame) -> DataFrame:
    """The verdicts under ``RULES``."""
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def _query_sql() -> str:
    """The same computation on DuckDB: one pair of statements per order."""
    rules = ", ".join(f"('{h}', '{p}', {str(a).lower()})" for h, p, a in RULES)
    mix = ", ".join(f"CASE WHEN t{c} >= {LEAST} THEN (n{c} + d{c} * q{c}) / (t{c} + d{c}) ELSE q{c} END AS q{c}" for c in "10")
    levels = f"p0 AS (SELECT gram, {mix} FROM (SELECT *, 1.0::double / v AS q1, 1.0::double / v AS q0 FROM counts WHERE k = 0))"
    for k in range(1, ORDER + 1):
        levels += f""",
p{k} AS (SELECT gram, {mix} FROM (SELECT c.*, p.q1, p.q0 FROM counts c JOIN p{k - 1} p ON substr(c.gram, 2) = p.gram WHERE c.k = {k}))"""
    return rf"""
WITH urls AS MATERIALIZED (
  SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS colon FROM pages),
parts AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         translate(CASE WHEN colon > 0 THEN rest ELSE url END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM (SELECT *, CASE WHEN colon > 0 THEN substr(url, colon + 3) ELSE '' END AS rest FROM urls)),
rules(rule_host, rule_path, allow) AS (VALUES {rules}),
fits AS (
  SELECT r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(allow, length(rule_host || rule_path)) AS allow
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r),
rowset AS MATERIALIZED (
  SELECT parts.*, rule, allow, substr(md5(text), 1, 1) IN ('0', '1', '2') AS held FROM parts LEFT JOIN fits USING (r)),
places AS MATERIALIZED (
  SELECT r, allow, held, substr(repeat(chr(2), {ORDER}) || text || chr(3), i::int, {ORDER + 1}) AS gram
  FROM (SELECT *, unnest(generate_series(1, length(text) + 1)) AS i FROM rowset)),
whole AS (
  SELECT gram, count(*) FILTER (WHERE allow AND NOT held) AS n1, count(*) FILTER (WHERE NOT allow AND NOT held) AS n0 FROM places GROUP BY gram),
tails AS (
  SELECT k, right(gram, (k + 1)::int) AS gram, sum(n1) AS n1, sum(n0) AS n0
  FROM (SELECT *, unnest(generate_series(0, {ORDER})) AS k FROM whole) GROUP BY ALL),
counts AS MATERIALIZED (
  SELECT k, gram, n1::double AS n1, n0::double AS n0, (sum(n1) OVER c)::double AS t1, (sum(n0) OVER c)::double AS t0,
         (count(*) FILTER (WHERE n1 > 0) OVER c)::double AS d1, (count(*) FILTER (WHERE n0 > 0) OVER c)::double AS d0, count(*) OVER c AS v
  FROM tails WINDOW c AS (PARTITION BY k, left(gram, k::int))),
{levels},
scored AS MATERIALIZED (
  SELECT r, sum(round(ln(q1 / q0) * {SCALE})::bigint) / {SCALE}.0::double / count(*) AS score FROM places JOIN p{ORDER} USING (gram) GROUP BY r),
stats AS (
  SELECT count(*) FILTER (WHERE allow) AS n1, count(*) FILTER (WHERE NOT allow) AS n0, avg(score) FILTER (WHERE allow) AS m1,
         avg(score) FILTER (WHERE NOT allow) AS m0, var_pop(score) FILTER (WHERE allow) AS v1, var_pop(score) FILTER (WHERE NOT allow) AS v0
  FROM rowset JOIN scored USING (r) WHERE held AND allow IS NOT NULL),
line AS (
  SELECT CASE WHEN n1 > 0 AND n0 > 0 AND m1 > m0 THEN (m1 + m0) / 2 ELSE 0 END AS middle FROM stats)
SELECT page_id, host, path, rule, CASE WHEN coalesce(allow, score >= middle) THEN 'allow' ELSE 'block' END AS verdict
FROM rowset JOIN scored USING (r) CROSS JOIN line
"""


QUERY_SQL = _query_sql()

"""URL filtering by host rules and by mined association rules; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.session import durable

#: (verdict, host, path): fixed rules; a rule holds for its host and all subdomains.
HOST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Share and number of the labelled addresses that must hold a token combination, and share of these that must be bad.
MIN_SUPPORT = 0.01
LEAST_PAGES = 20
MIN_CONFIDENCE = 0.5
#: The bad share among addresses with the combination, as a multiple of the bad share overall.
MIN_LIFT = 1.5
#: Labels that a host name can have; of a longer run of labels the last ones become tokens.
MOST_LABELS = 127
#: What the SQL below reads of an address: labels of the host from its end, first folders and first parameters.  The
#: operator reads them all.
HOST_LABELS, FOLDERS, PARAMETERS = 4, 4, 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule(verdict_host_path: tuple[str, str, str], host: Column, path: Column) -> Column:
    _, rule_host, rule_path = verdict_host_path
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def with_host_rule(urls: DataFrame, url_col: str = "url", rules: tuple = HOST_RULES) -> DataFrame:
    """Adds `host`, `path`, `rule` and `rule_verdict`, which replace columns of these names.

    The host runs from the first `://` up to `/`, `?`, `#` or the end with A-Z lowered, the path from there
    up to `?`, `#` or the end; without `://` and for null both are empty.  Of the rules that fit, the
    longest wins.
    """
    host, path = host_of(F.col(f"`{url_col}`")), path_of(F.col(f"`{url_col}`"))
    out = urls.drop("host", "path", "rule", "rule_verdict").withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = _rule(r, F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, r[1] + r[2]).otherwise(rule), F.when(fits, r[0]).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def tokens_of(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of an address: scheme, suffixes of the host, folders of the path, names of parameters.

    Runs of digits are one token each, whatever their value, so that numbered pages look alike.
    """
    labels = F.split(host, r"\.")
    most = F.least(F.size(labels), F.lit(MOST_LABELS))
    suffixes = F.transform(F.sequence(F.lit(1), most), lambda k: F.concat(F.lit("host="), F.array_join(F.slice(labels, -k, k), ".")))
    folders = F.transform(F.filter(F.split(path, "/"), lambda p: p != ""), lambda p: F.concat(
        F.lit("path="), F.regexp_replace(p, "[0-9]+", "0")))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda q: q != ""), lambda q: F.concat(F.lit("query="), F.split_part(q, F.lit("="), F.lit(1))))
    scheme = F.array(F.concat(F.lit("scheme="), F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))
    parts = [F.when(host != "", suffixes).otherwise(F.array().cast("array<string>")), folders, names, scheme]
    return F.coalesce(F.array_distinct(F.concat(*parts)), F.array().cast("array<string>"))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
               min_lift: float = MIN_LIFT, most_tokens: int | None = None, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(rule_id, tokens, confidence, support, lift, alternatives) of the token combinations that go with bad labels.

    `labelled` is (tokens, bad).  FP-growth counts frequent combinations over all labelled rows; those with
    the bad label, divided by those without it, are the confidence.  A combination is pruned when a part
    of it is a rule already, since whatever it blocks is blocked.  What cannot change a rule is left out before:
    rare tokens, tokens of all rows, tokens that are rules alone, and all but one of the tokens that stand in
    the same rows.  `alternatives` has, for each token of a rule, the tokens that stand in the same rows.
    """
    baskets = durable(labelled.filter("bad is not null").select(
        F.col("tokens").alias("items"), "bad").withColumn("row", F.monotonically_increasing_id()), "baskets")
    total = baskets.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad")).first()
    empty = baskets.select(F.lit(0).cast("long").alias("rule_id"), F.col("items").alias("tokens"), F.lit(0.0).alias("confidence"),
                           F.lit(0.0).alias("support"), F.lit(0.0).alias("lift"), F.array("items").alias("alternatives")).limit(0)
    need = max(math.ceil(min_support * total["n"]), least_pages)
    need_bad = max(1, math.ceil(min_confidence * need))
    if need_bad > total["bad"] or need > total["n"]:
        return empty
    # a rule has at least `need` rows, hence `need_bad` bad ones, and so has each of its tokens
    tokens = baskets.select("row", "bad", F.explode("items").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), F.bit_xor(F.xxhash64("row")).alias("a"),
        F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("b")).filter((F.col("n") >= need) & (F.col("n_bad") >= need_bad))
    same = durable(tokens.groupBy("n", "n_bad", "a", "b").agg(F.array_sort(F.collect_list("token")).alias("same")).select(
        F.array(F.col("same")[0]).alias("tokens"), "n", "n_bad", "same"), "tokens")
    confidence = F.col("n_bad") / F.col("n")
    holds = (F.col("n") >= need) & (confidence >= min_confidence) & (confidence / F.lit(total["bad"] / total["n"]) >= min_lift)
    rules = same.filter(holds).select("tokens", "n", "n_bad")
    rest = same.filter(~holds & (F.col("n") < total["n"])).agg(F.flatten(F.collect_list("tokens")).alias("keep"))
    if most_tokens != 1:
        left = baskets.crossJoin(rest).select(F.array_intersect("items", "keep").alias("items"), "bad").filter("size(items) > 1")
        left = durable(left, "left")
        rows = left.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad")).first()
        if need <= rows["n"] and need_bad <= rows["bad"]:
            fits = F.size("items").between(2, most_tokens or 1 << 30)
            # mining the bad rows first keeps both runs small
            bad_sets = FPGrowth(itemsCol="items", minSupport=(need_bad - 0.5) / rows["bad"]).fit(left.filter("bad").select("items")).freqItemsets
            bad_sets = durable(bad_sets.filter(fits).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n_bad")), "bad-sets")
            all_sets = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / rows["n"]).fit(left.select("items")).freqItemsets
            all_sets = durable(all_sets.filter(fits).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n")), "all-sets")
            rules = rules.unionByName(bad_sets.join(all_sets, "tokens").filter(holds))
    rules = durable(rules, "rules")
    # a rule with a part that is a rule is redundant; the part is met under its first token
    part = rules.select(F.col("tokens").alias("part"), F.col("tokens")[0].alias("token"))
    longer = rules.select("tokens", F.explode("tokens").alias("token")).join(part, "token").filter(
        (F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0)).select("tokens").distinct()
    kept = rules.join(longer, "tokens", "left_anti")
    alternatives = kept.select("tokens", F.posexplode("tokens").alias("pos", "token")).join(
        same.select(F.col("tokens")[0].alias("token"), "same"), "token").groupBy("tokens").agg(
        F.array_sort(F.collect_list(F.struct("pos", "same"))).alias("found"))
    return kept.join(alternatives, "tokens").select(
        F.xxhash64("tokens").alias("rule_id"), "tokens", confidence.alias("confidence"), (F.col("n") / F.lit(total["n"])).alias("support"),
        (confidence / F.lit(total["bad"] / total["n"])).alias("lift"), F.col("found.same").alias("alternatives"))


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, matched rules) of the (key, tokens) rows whose tokens hold each token of a rule or one of its alternatives.

    The index lists each rule under its rarest token and the alternatives of it only; a row finds candidates by
    its tokens and checks the whole rule, so frequent tokens such as a scheme never meet.
    """
    seen = rules.select("rule_id", F.explode(F.arrays_zip("tokens", "alternatives")).alias("t")).select(
        "rule_id", F.col("t.tokens").alias("token"), F.col("t.alternatives").alias("under"))
    often = seen.groupBy("token").agg(F.count(F.lit(1)).alias("rules_with"))
    key = seen.join(often, "token").groupBy("rule_id").agg(F.min_by("under", F.struct("rules_with", "token")).alias("under"))
    index = rules.select("rule_id", "alternatives", "confidence").join(key, "rule_id").withColumn("token", F.explode("under")).drop("under")
    asked = pages.select("key", "tokens", F.explode("tokens").alias("token"))
    hits = asked.join(durable(index, "index"), "token").filter(F.forall("alternatives", lambda same: F.arrays_overlap(same, F.col("tokens"))))
    return hits.groupBy("key").agg(F.array_sort(F.collect_set("rule_id")).alias("matched_rules"), F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, url_col: str = "url", id_col: str = "page_id", **kw) -> DataFrame:
    """(page_id, host, path, rule, verdict, matched_rules): block or allow for every address.

    `labels` is (url, bad): addresses known to be good or bad.  A host rule decides where one fits, else a
    mined rule that fits blocks, else the address is allowed.  Null addresses and those without `://` have
    an empty host and path and, having no tokens but a scheme, are allowed; repeated rows stay repeated;
    without labels nothing is mined.  Other columns play no part.
    """
    url = F.col(url_col)
    judged = with_host_rule(pages.select(F.col(id_col).alias("page_id"), url.alias("url")))
    known = with_host_rule(labels.select("url", "bad")).select(tokens_of(F.col("host"), F.col("path"), F.col("url")).alias("tokens"), "bad")
    rules = mine_rules(known, **kw)
    # one row per distinct token list: numbered pages of a site are judged once
    with_tokens = judged.withColumn("tokens", tokens_of(F.col("host"), F.col("path"), F.col("url")))
    distinct = with_tokens.filter("rule is null").select("tokens").distinct().select(F.xxhash64("tokens").alias("key"), "tokens")
    matched = match_rules(distinct, rules)
    # addresses with a host rule need no match; keys of their own spread them over the tasks
    key = F.when(F.col("rule").isNull(), F.xxhash64("tokens")).otherwise(F.xxhash64("url", "page_id"))
    out = with_tokens.withColumn("key", key).join(matched, "key", "left")
    mined = F.when(F.col("rule").isNull(), F.col("matched_rules"))
    return out.select("page_id", "host", "path", "rule",
                      F.coalesce("rule_verdict", F.when(mined.isNotNull(), "block").otherwise("allow")).alias("verdict"),
                      mined.alias("matched_rules"))


def labels_of_documents(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): a page's address carries the number of its document; bad is of low quality or toxic."""
    number = F.expr("try_cast(regexp_extract(url, '://[^/?#]*/(?:[^/?#]*/)*([0-9]+)', 1) as bigint)")
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("bad"))
    return pages.select("url", number.alias("doc_id")).join(marks, "doc_id").select("url", "bad")


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in HOST_RULES)

#: The same over the test tables: every combination of up to three tokens is counted instead of mined.
SQL = f"""
WITH pg AS (
  SELECT row_number() OVER () AS r, page_id, url,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
fixed (verdict, h, p) AS (VALUES {_RULE_ROWS}),
ruled AS (
  SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM pg, fixed WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r),
parts AS (
  SELECT r, url, CASE WHEN host = '' THEN [] ELSE string_split(host, '.') END AS labels,
    list_filter(string_split(path, '/'), lambda x: x <> '')[1:{FOLDERS}] AS folders,
    list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1, 's'), '&'), lambda x: x <> '')[1:{PARAMETERS}] AS names FROM pg),
tokens AS (
  SELECT r, url, list_sort(list_distinct(list_concat(
    list_transform(range(1, least(len(labels), {HOST_LABELS}) + 1), lambda k: 'host=' || array_to_string(labels[len(labels) - k + 1:], '.')),
    list_transform(folders, lambda x: 'path=' || regexp_replace(x, '[0-9]+', '0', 'g')),
    list_transform(names, lambda x: 'query=' || split_part(x, '=', 1)),
    ['scheme=' || regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)]))) AS t FROM parts WHERE url IS NOT NULL),
one AS (SELECT r, unnest(t) AS x FROM tokens),
sets AS (
  SELECT r, [x] AS s FROM one UNION ALL
  SELECT a.r, [a.x, b.x] FROM one a JOIN one b ON a.r = b.r AND a.x < b.x UNION ALL
  SELECT a.r, [a.x, b.x, c.x] FROM one a JOIN one b ON a.r = b.r AND a.x < b.x JOIN one c ON a.r = c.r AND b.x < c.x),
marks AS (
  SELECT doc_id, bool_or(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
known AS (
  SELECT r, bad FROM pg JOIN marks
    ON doc_id = TRY_CAST(regexp_extract(url, '://[^/?#]*/(?:[^/?#]*/)*([0-9]+)', 1) AS BIGINT)),
total AS (SELECT count(*) AS n, count_if(bad) AS bad FROM known),
need AS (SELECT *, greatest(ceil(CAST({MIN_SUPPORT} AS DOUBLE) * n), {LEAST_PAGES}) AS pages FROM total),
counted AS (SELECT s, count(*) AS n, count_if(bad) AS bad FROM sets JOIN known USING (r) GROUP BY 1),
rules AS (
  SELECT s FROM counted c, need d WHERE c.n >= d.pages AND c.bad / c.n >= {MIN_CONFIDENCE}
    AND (c.bad / c.n) / (d.bad / d.n) >= {MIN_LIFT}),
blocked AS (SELECT DISTINCT r FROM sets JOIN rules USING (s))
SELECT page_id, host, path, rule,
  CASE WHEN rule IS NOT NULL THEN verdict WHEN r IN (SELECT r FROM blocked) THEN 'block' ELSE 'allow' END AS verdict
FROM pg LEFT JOIN ruled USING (r)"""

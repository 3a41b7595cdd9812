"""Mixing sources to target weights by hierarchical budgets; DataFrame operations only.

Leaves of a domain-language-source tree have a supply: their tokens times `epochs`. A
budget flows from the root down. At every node it is shared among the children by
weight, no child getting more than its subtree can supply; what a short child leaves
goes to its siblings by weight, and only what a whole subtree cannot use returns to
the node above. Since a child's cap is its subtree's supply, one pass from the top does
this: with caps c and weights w, children get min(c, level * w), where the level makes
the parts add up to the node's budget. Sorting children by c / w gives the level from
running sums, so a node may have any number of children.

A leaf takes a prefix of its tokens from seeded epochs: in each epoch its documents
are ordered by a seeded MD5 of the id; whole epochs first, then documents in order
until the budget is used, the last one in part. Prefix sums run within BUCKETS hash
ranges of a leaf, so the documents of a leaf, however many, are never in one task.

Defined results: null and empty texts have no tokens and are never taken; a null lang,
source or domain is the leaf name ''; rows of the same id are ordered by tokens and
text, equal rows in any order; a leaf without weight gets the default weight; with an
empty table nothing is taken; of further columns, mixed() keeps those of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import materialize

BUCKETS = 3  # leading hexadecimal digits: 4,096 hash ranges for each leaf
SEED = 17
EPOCHS = 2
SHARE = 0.6  # budget as a share of the corpus's tokens
#: Production weights: integers, compared among siblings only.
DOMAIN_WEIGHTS = {"web": 5, "books": 3, "code": 2}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 2}
DEFAULT_WEIGHT = 1


def domain_of(source: Column) -> Column:
    """The domain of a source named srcN: by N modulo 3; others are web."""
    n = F.regexp_extract(source, r"^src([0-9]{1,9})$", 1)
    return F.when(n == "", "web").otherwise(F.element_at(F.array(*map(F.lit, ("web", "books", "code"))), (F.when(n == "", "0").otherwise(n).cast("int") % 3) + 1))


def n_tokens(text: Column) -> Column:
    """White-space separated words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _weight(name: str, weights: dict[str, int]) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for k, w in weights.items():
        out = F.when(F.col(name) == k, w).otherwise(out)
    return out.cast("double")


def _share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `amount`: the part of each row's `budget` (equal within a parent) that the child gets."""
    ratio = (F.col("cap") / F.col("w")).alias("ratio")
    c = children.withColumn("ratio", ratio)
    up_to = Window.partitionBy(*parent).orderBy("ratio", name).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*parent).orderBy("ratio", name).rowsBetween(1, Window.unboundedFollowing)
    c = c.withColumn("caps", F.sum("cap").over(up_to)).withColumn("weights", F.coalesce(F.sum("w").over(after), F.lit(0.0)))
    c = c.withColumn("full", F.col("caps") + F.col("ratio") * F.col("weights") <= F.col("budget"))
    whole = Window.partitionBy(*parent)
    c = c.withColumn("used", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)))
    c = c.withColumn("open", F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(whole), F.lit(0.0)))
    amount = F.when(F.col("full"), F.col("cap")).otherwise(F.floor((F.col("budget") - F.col("used")) * F.col("w") / F.col("open")))
    return c.withColumn("amount", amount.cast("long")).drop("ratio", "caps", "weights", "full", "used", "open")


def budgets(leaves: DataFrame, total: int | None = None, epochs: int = EPOCHS, domain_weights=DOMAIN_WEIGHTS, lang_weights=LANG_WEIGHTS, source_weights=None) -> DataFrame:
    """(domain, lang, source, tokens, budget) from (domain, lang, source, tokens); statistics of leaves, not documents."""
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    domains = domains.withColumn("root", F.lit(1)).withColumn("w", _weight("domain", domain_weights))  # a row for each domain
    everything = F.sum("tokens").over(Window.partitionBy("root"))
    domains = domains.withColumn("budget", F.floor(everything.cast("double") * SHARE).cast("long") if total is None else F.lit(total).cast("long"))
    domains = _share(domains, ["root"], "domain")
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(domains.select("domain", F.col("amount").alias("budget")), "domain")
    langs = _share(langs.withColumn("w", _weight("lang", lang_weights)), ["domain"], "lang")
    sources = leaves.join(langs.select("domain", "lang", F.col("amount").alias("budget")), ["domain", "lang"])
    sources = _share(sources.withColumn("w", _weight("source", source_weights or {})), ["domain", "lang"], "source")
    return sources.select("domain", "lang", "source", "tokens", F.col("amount").alias("budget"))


LEAF = ["domain", "lang", "source"]


def _sized(docs: DataFrame, id_col: str, text_col: str, domain: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), F.coalesce(domain, F.lit("")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        n_tokens(text).alias("n_tokens"), F.xxhash64(text).alias("text_hash"),
    )


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", epochs: int = EPOCHS, seed: int = SEED, domain: Column | None = None, **weights) -> DataFrame:
    """(id, domain, lang, source, epoch, n_tokens, take_tokens, text_hash): what the mixture takes, document by document and epoch."""
    sized = materialize(_sized(docs, id_col, text_col, domain_of(F.col("source")) if domain is None else domain).filter("n_tokens > 0"), "sized")
    leaves = sized.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    plan = materialize(budgets(leaves, epochs=epochs, **weights), "budgets")
    # Whole epochs, and what is left for the one that is cut.
    cut = plan.select(*LEAF, F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("left"))
    rows = sized.join(cut, LEAF).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.least(F.col("whole"), F.lit(epochs - 1)).cast("int"))))
    rows = rows.filter((F.col("epoch") < F.col("whole")) | (F.col("left") > 0))
    complete = rows.filter(F.col("epoch") < F.col("whole")).withColumn("take_tokens", F.col("n_tokens"))
    part = rows.filter(F.col("epoch") >= F.col("whole")).withColumn("order", F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    part = part.withColumn("bucket", F.substring("order", 1, BUCKETS))
    ahead = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = part.groupBy(*LEAF, "bucket").agg(F.sum("n_tokens").alias("n"), F.max("left").alias("left"))  # 4,096 rows a leaf at most
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).filter("before < left").select(*LEAF, "bucket", "before")
    own = Window.partitionBy(*LEAF, "bucket").orderBy("order", "n_tokens", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    part = part.join(ranges, [*LEAF, "bucket"]).withColumn("before", F.col("before") + F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
    part = part.filter("before < left").withColumn("take_tokens", F.least(F.col("n_tokens"), F.col("left") - F.col("before")))
    cols = ["id", *LEAF, "epoch", "n_tokens", "take_tokens", "text_hash"]
    return complete.select(cols).unionByName(part.select(cols))


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """mixture() with the id under its own name and without the text's hash."""
    return mixture(docs, id_col, text_col, **options).withColumnRenamed("id", id_col).drop("text_hash")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mixture's documents: columns of docs, text cut to the tokens taken, with epoch and take_tokens."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = ("id", "text_hash", "epoch", "take_tokens", "n_tokens")
    found = mixture(docs, id_col, text_col, **options).select(*(F.col(c).alias(f"__codeloom_{c}") for c in names)).distinct()
    id_, hash_, epoch, take, size = (F.col(f"__codeloom_{c}") for c in names)
    rest = [c for c in docs.columns if c not in ("epoch", "take_tokens")]
    hit = docs.select(rest).withColumn("__codeloom_hash", F.xxhash64(text)).join(materialize(found, "mixture"), F.col(id_col).eqNullSafe(id_) & (F.col("__codeloom_hash") == hash_))
    prefix = F.regexp_extract(text, r"^[\x20\x09-\x0D]*+", 0)
    words = F.slice(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"), F.lit(0)), F.lit(1), take.cast("int"))
    cut = F.concat(prefix, F.array_join(words, ""))
    return hit.withColumn(text_col, F.when(take < size, cut).otherwise(F.col(text_col))).select(*rest, epoch.alias("epoch"), take.alias("take_tokens"))


def _sql_weight(name: str, weights: dict[str, int]) -> str:
    return f"CAST(CASE {' '.join(f'''WHEN {name} = '{k}' THEN {w}''' for k, w in weights.items())} ELSE {DEFAULT_WEIGHT} END AS DOUBLE)" if weights else f"CAST({DEFAULT_WEIGHT} AS DOUBLE)"


def _sql_share(out: str, source: str, parent: str, name: str) -> str:
    return f"""
{out}_1 AS (SELECT *, sum(cap) OVER p AS caps, cap / w AS ratio, coalesce(sum(w) OVER n, 0) AS weights FROM ({source})
  WINDOW p AS (PARTITION BY {parent} ORDER BY cap / w, {name} ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY {parent} ORDER BY cap / w, {name} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
{out}_2 AS (SELECT *, caps + ratio * weights <= budget AS full_ FROM {out}_1),
{out}_3 AS (SELECT *, coalesce(sum(cap) FILTER (full_) OVER (PARTITION BY {parent}), 0) AS used, coalesce(sum(w) FILTER (NOT full_) OVER (PARTITION BY {parent}), 0) AS open_ FROM {out}_2),
{out} AS (SELECT *, CASE WHEN full_ THEN cap ELSE CAST(floor((budget - used) * w / open_) AS BIGINT) END AS amount FROM {out}_3)"""


ORACLE_SQL = f"""
WITH s0 AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
    CASE WHEN regexp_matches(source, '^src[0-9]{{1,9}}$') THEN ['web', 'books', 'code'][CAST(substr(source, 4) AS INT) % 3 + 1] ELSE 'web' END AS domain FROM documents),
s AS (SELECT * FROM s0 WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {EPOCHS} AS BIGINT) AS cap FROM s GROUP BY ALL),
{_sql_share("d", f"SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, {_sql_weight('domain', DOMAIN_WEIGHTS)} AS w, 1 AS one, (SELECT CAST(floor(CAST(sum(tokens) AS DOUBLE) * {SHARE}) AS BIGINT) FROM leaves) AS budget FROM leaves GROUP BY domain", "one", "domain")},
{_sql_share("l", f"SELECT domain, lang, CAST(sum(leaves.cap) AS BIGINT) AS cap, {_sql_weight('lang', LANG_WEIGHTS)} AS w, max(d.amount) AS budget FROM leaves JOIN d USING (domain) GROUP BY domain, lang", "domain", "lang")},
{_sql_share("q", f"SELECT domain, lang, source, tokens, leaves.cap AS cap, {_sql_weight('source', {})} AS w, l.amount AS budget FROM leaves JOIN l USING (domain, lang)", "domain, lang", "source")},
e AS (SELECT s.*, unnest(range(0, {EPOCHS})) AS epoch, amount // tokens AS whole, amount % tokens AS rest FROM s JOIN q USING (domain, lang, source)),
o AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('{SEED}:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM e)
SELECT doc_id, domain, lang, source, epoch, n_tokens, CASE WHEN epoch < whole THEN n_tokens ELSE CAST(least(n_tokens, rest - ahead) AS BIGINT) END AS take_tokens
FROM o WHERE epoch < whole OR (epoch = whole AND ahead < rest)
"""

"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a domain / language / source tree. At each node the children share it by weight, none gets more than
its subtree can supply (its tokens times ``epochs``), and what one cannot take goes to its siblings; only what
all siblings together cannot take was never given to their parent, so shortages reach ancestors last. A leaf spends its budget in
seeded epochs: whole epochs first, then the prefix, in that epoch's own seeded order, whose tokens fit.

All of it is SQL. A leaf's order is cut into 4096 ranges of a hash, so the running sum of a leaf with a third of all rows is dealt over
as many tasks; weights travel as literals and the tree is one row per leaf.

Edge cases: null language, source or text count as '' (an empty leaf name, no words); texts without words are
never short of budget and follow the whole epochs only; weights not given are ``DEFAULT_WEIGHT``; what has weight 0 supplies
nothing, a weight below 0 is an error, names may hold any characters; an empty table
gives an empty result; ties in the seeded order fall by doc_id and then tokens. ``mix`` reads four columns and returns its own; ``stage`` carries
columns of any names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specmatch.llm.frames import plain
from specmatch.llm.quality_rules import SPACES
from specmatch.session import cut

DEFAULT_WEIGHT = 0.1
#: What a weight of 0 divides by.
_LEAST = 1e-300


@dataclass(frozen=True)
class Targets:
    """Weights of siblings (names not listed weigh DEFAULT_WEIGHT), the share of all tokens to spend, and the most epochs of a leaf."""

    domains: dict[str, float] = field(default_factory=lambda: {"web": 0.4, "books": 0.3, "news": 0.2, "reference": 0.1})
    languages: dict[str, float] = field(default_factory=lambda: {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1})
    sources: dict[str, float] = field(default_factory=dict)
    share: float = 1.0
    epochs: int = 3
    seed: int = 7
    #: SQL of the domain of a source: its number modulo 4, which its last two digits tell.
    domain: str = "CASE CAST('0' || regexp_extract(source, '([0-9]{1,2})$', 1) AS INT) % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'news' ELSE 'reference' END"

    def __post_init__(self):
        if any(not v >= 0 for w in (self.domains, self.languages, self.sources) for v in w.values()):
            raise ValueError("weights are numbers of 0 or more")


def _text(name: str) -> str:
    """SQL of a string, in any dialect: quotes and backslashes by their codes."""
    return "||".join(f"chr({ord(part)})" if part in "'\\" else f"'{part}'" for part in re.split(r"(['\\])", name) if part) or "''"


def _number(weight: float) -> str:
    return f"CAST({float(weight)!r} AS DOUBLE)"


def _case(column: str, weights: dict[str, float]) -> str:
    whens = " ".join(f"WHEN {column} = {_text(k)} THEN {_number(v or _LEAST)}" for k, v in weights.items())
    return f"CASE {whens} ELSE {_number(DEFAULT_WEIGHT)} END" if whens else _number(DEFAULT_WEIGHT)


def _none(targets: Targets) -> str:
    """SQL of whether a leaf or a node above it has weight 0."""
    zero = [f"{column} = {_text(k)}" for column, weights in (("domain", targets.domains), ("lang", targets.languages), ("source", targets.sources)) for k, v in weights.items() if not v]
    return " OR ".join(zero) or "1 = 0"


def _fill(name: str, below: str, parent: str, key: str, weight: str, up: str) -> str:
    """CTEs that share each parent's budget among its children, none above its capacity."""
    over = f"PARTITION BY {parent}"
    keys = f"{parent}, {key}"
    return f"""
{name}_c AS (SELECT {keys}, CAST(sum(capacity) AS DOUBLE) AS capacity, {weight} AS weight FROM {below} GROUP BY {keys}),
{name}_o AS (
  SELECT c.*, u.budget AS parent_budget,
         sum(c.capacity) OVER (PARTITION BY {', '.join('c.' + p for p in parent.split(', '))} ORDER BY c.capacity / c.weight, c.{key} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - c.capacity AS taken,
         sum(c.weight) OVER (PARTITION BY {', '.join('c.' + p for p in parent.split(', '))} ORDER BY c.capacity / c.weight DESC, c.{key} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS left_weight
  FROM {name}_c c JOIN {up} u ON {' AND '.join(f'c.{p} = u.{p}' for p in parent.split(', '))}),
{name}_l AS (SELECT *, (parent_budget - taken) / left_weight AS level FROM {name}_o),
{name}_b AS (
  SELECT {keys}, capacity,
         CASE WHEN capacity <= weight * level THEN capacity
              ELSE weight * max(CASE WHEN capacity > weight * level THEN level END) OVER ({over}) END AS budget
  FROM {name}_l)"""


def plan_sql(targets: Targets, tokens: str) -> str:
    """The whole selection over ``tokens`` (doc_id, domain, lang, source, tokens, h). Runs in Spark and in DuckDB."""
    return f"""
WITH leaf AS (
  SELECT 0 AS root, domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CASE WHEN {_none(targets)} THEN 0 ELSE CAST(sum(tokens) AS BIGINT) * {targets.epochs} END AS capacity
  FROM {tokens} GROUP BY domain, lang, source),
top AS (SELECT 0 AS root, CAST(floor(sum(tokens) * {targets.share!r}e0) AS DOUBLE) AS budget FROM leaf),
{_fill('d', 'leaf', 'root', 'domain', _case('domain', targets.domains), 'top')},
{_fill('g', 'leaf', 'root, domain', 'lang', _case('lang', targets.languages), 'd_b')},
{_fill('s', 'leaf', 'root, domain, lang', 'source', _case('source', targets.sources), 'g_b')},
quota AS (
  SELECT s.domain, s.lang, s.source, leaf.tokens AS leaf_tokens, CAST(floor(s.budget + 0.000001e0) AS BIGINT) AS leaf_budget
  FROM s_b s JOIN leaf ON s.domain = leaf.domain AND s.lang = leaf.lang AND s.source = leaf.source),
spend AS (
  SELECT *, CASE WHEN leaf_tokens = 0 THEN 1 ELSE CAST(floor(CAST(leaf_budget AS DOUBLE) / leaf_tokens) AS BIGINT) END AS whole,
         CASE WHEN leaf_tokens = 0 THEN 0 ELSE leaf_budget % leaf_tokens END AS rest
  FROM quota),
hashed AS (
  SELECT t.doc_id, t.domain, t.lang, t.source, t.tokens, s.leaf_budget, s.whole, s.rest,
         md5('{targets.seed}:' || CAST(s.whole AS STRING) || ':' || coalesce(CAST(t.doc_id AS STRING), '')) AS h
  FROM {tokens} t JOIN spend s ON t.domain = s.domain AND t.lang = s.lang AND t.source = s.source),
ranges AS (
  SELECT domain, lang, source, r, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before
  FROM (SELECT domain, lang, source, substr(h, 1, 3) AS r, sum(tokens) AS n FROM hashed GROUP BY domain, lang, source, substr(h, 1, 3)) x),
placed AS (
  SELECT h.*, r.before + sum(h.tokens) OVER (PARTITION BY h.domain, h.lang, h.source, r.r ORDER BY h.h, h.doc_id, h.tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM hashed h JOIN ranges r ON h.domain = r.domain AND h.lang = r.lang AND h.source = r.source AND substr(h.h, 1, 3) = r.r)
SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT) AS tokens, leaf_budget,
       CAST(whole + CASE WHEN rest > 0 AND tokens > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM placed
"""


def _named(text: str = "text", lang: str = "lang", source: str = "source") -> tuple:
    """lang, source and tokens of a document, as columns."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    tokens = F.when(bare == "", 0).otherwise(F.regexp_count(bare, F.lit(r"[\x20\x09-\x0D]+")) + 1).cast("long")
    return F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), tokens.alias("tokens")


def token_table(docs: DataFrame, targets: Targets) -> DataFrame:
    """doc_id, domain, lang, source, tokens of every document, written once: the text is read one time."""
    return cut(docs.select("doc_id", *_named()).withColumn("domain", F.expr(targets.domain)))


def mix(docs: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """Per document: its leaf, tokens, the leaf's budget and the number of copies the mixture takes of it."""
    return docs.sparkSession.sql(plan_sql(targets, "{tokens}"), tokens=token_table(docs, targets))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = plan_sql(
    Targets(),
    r"(SELECT doc_id, lang, source, tokens, " + Targets().domain + r""" AS domain FROM (
       SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
              CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents))""",
)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document as often as it is taken, with its own columns. Rows that share doc_id, leaf and tokens are
    alike to ``mix``: their copies are dealt to them one by one, most first, in order of a hash of the text; a null doc_id is an id
    like any other."""
    base, name = plain(docs)
    doc_id, text = name["doc_id"], name["text"]
    own = base.select(*(F.col(name[c]).alias(c) for c in ("doc_id", "text", "lang", "source")))
    key = ["id", "none", "lang", "source", "tokens"]
    ids = lambda c: (F.coalesce(F.col(c), F.lit(0)).alias("id"), F.col(c).isNull().alias("none"))
    copies = mix(own).select(*ids("doc_id"), "lang", "source", "tokens", "copies").groupBy(*key).agg(F.sort_array(F.collect_list("copies"), False).alias("copies")).where("copies[0] > 0")
    rows = base.select("*", *ids(doc_id), *_named(text, name["lang"], name["source"])).join(copies, key)
    rows = rows.withColumn("row", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(text))))
    taken = rows.withColumn("n", F.element_at("copies", F.col("row"))).where("n > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(*base.columns).toDF(*docs.columns)

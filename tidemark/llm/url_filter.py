"""URL verdicts: rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter has up to MAX_BLOCKS blocks of 512 bits. A URL picks one block and one
bit in each of the block's eight 64-bit words, so a probe touches one row of the
filter table, which is broadcast: its size is bounded by MAX_BLOCKS whatever the
list's length, and a longer list only lets more false positives through. Possible
hits, and only they, go to an exact hash join with the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged, table

MAX_BLOCKS = 1 << 16  # of 64 bytes: 4 MB of filter at most
KEYS_A_BLOCK = 32  # 16 bits a listed URL while the filter may still grow
RULE_LIMIT = 200  # rules are an expression, so their number is bounded

# Rules as (host, path, action).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

# Parts of host names that put a page's URL on the list.
LISTED_WORDS = ["ads", "adult", "bets", "casino", "pills", "poker", "porn", "spam", "track", "viagra", "warez"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = "^(utm_[^=]*|ref|gclid|fbclid)(=|$)"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and query; all empty where the URL is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(after, "^[^?#]*", 0)
    query = F.regexp_extract(F.substring(after, F.length(path) + 1, F.length(after)), "^\\?([^#]*)", 1)
    return F.translate(host, UPPER, LOWER), path, query


def canonical(host: Column, path: Column, query: Column) -> Column:
    """Without scheme, fragment, leading www., slashes at the path's end and tracking parameters; the others sorted."""
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(F.regexp_replace(host, "^www\\.", ""), F.regexp_replace(path, "/+\\z", ""), tail)


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    host, path, query = url_parts(F.col(url))
    return pages.withColumns({"host": host, "path": path, "_query": query}).withColumn("canonical", canonical(F.col("host"), F.col("path"), F.col("_query"))).drop("_query")


def bloom_keys(df: DataFrame, blocks: int, key: str = "canonical") -> DataFrame:
    """``df`` with the key's block and the bit in each of the block's words."""
    bits = F.xxhash64(F.lit("bits"), key)
    one = F.lit(1).cast("long")
    masks = {f"_bit{i}": F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_bits, {6 * i}) & 63 as int))") for i in range(8)}
    return df.withColumns({"_block": F.pmod(F.xxhash64(key), F.lit(blocks) * one), "_bits": bits}).withColumns(masks).drop("_bits")


def bloom_filter(listed: DataFrame, blocks: int, key: str = "canonical") -> DataFrame:
    """A row for each block in use; blocks pre-aggregate, so the shuffle has at most a row a block and task."""
    return bloom_keys(listed, blocks, key).groupBy("_block").agg(*[F.bit_or(f"_bit{i}").alias(f"_word{i}") for i in range(8)])


def possible(keyed: DataFrame, name: str) -> DataFrame:
    """``keyed``, joined with its filter's words, with whether its key may be in the filter; without the helping columns."""
    every = F.lit(True)
    for i in range(8):
        every &= F.coalesce(F.col(f"_word{i}").bitwiseAND(F.col(f"_bit{i}")) != 0, F.lit(False))
    return keyed.withColumn(name, every).drop("_block", *[f"_{x}{i}" for x in ("bit", "word") for i in range(8)])


def marked(rows: DataFrame, wanted: DataFrame, key: str, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``rows`` with _possible: whether the key may be among ``wanted``, which is read twice. A Bloom filter of bounded size tells; it never misses a key."""
    blocks = min(max_blocks, max(1, -(-wanted.count() // KEYS_A_BLOCK)))
    words = F.broadcast(bloom_filter(wanted, blocks, key))  # max_blocks rows of 72 bytes at most
    return possible(bloom_keys(rows, blocks, key).join(words, "_block", "left"), "_possible")


def semi_join(rows: DataFrame, keys: DataFrame, key: str, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The rows whose ``key`` is in ``keys``, exactly; a Bloom filter of bounded size takes most others out before the join's shuffle."""
    wanted = staged(keys.select(key).distinct(), "keys")
    return marked(rows, wanted, key, max_blocks).where("_possible").drop("_possible").join(wanted, key, "left_semi")


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (of equals the first in order) and its action; null where none fits."""
    if len(rules) > RULE_LIMIT:
        raise ValueError(f"at most {RULE_LIMIT} rules")
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, does in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, h + p).otherwise(rule), F.when(fits, does).otherwise(action)
    return rule, action


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``pages(url, ...)`` with host, path, canonical, listed, rule and verdict.

    ``listed(canonical)`` are the URLs to block. A null URL, or one without
    ``://``, has empty parts, fits no rule and can't be listed, so it is allowed.
    Repeated pages are judged alike; repeated or null listed URLs count once or
    not at all. Columns of these names in ``pages`` are replaced.
    """
    listed = staged(listed.select("canonical").where("canonical <> ''").distinct(), "listed")
    blocks = min(max_blocks, max(1, -(-listed.count() // KEYS_A_BLOCK)))
    words = F.broadcast(bloom_filter(listed, blocks))  # max_blocks rows of 72 bytes at most
    keyed = possible(bloom_keys(with_parts(pages.drop("listed", "rule", "verdict")), blocks).join(words, "_block", "left"), "_possible")
    # Two branches: a left join on a key that is null for the others would deal all of them to one task.
    hits = keyed.where("_possible").join(listed.withColumn("listed", F.lit(True)), "canonical", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    all_rows = hits.unionByName(keyed.where("not _possible").withColumn("listed", F.lit(False))).drop("_possible")
    rule, action = rule_columns(F.col("host"), F.col("path"), rules)
    return all_rows.withColumns({"rule": rule, "verdict": F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow"))})


def listed_urls(pages: DataFrame) -> DataFrame:
    """Canonical URLs of pages whose host name has one of LISTED_WORDS between its dots and hyphens."""
    parts = with_parts(pages.select("url"))
    return parts.where(F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, LISTED_WORDS)))).select("canonical").distinct()


def op7_url_filter(spark, sf_dir):
    """A verdict for every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict", "listed")


def oracle() -> str:
    whens = [(h + p, f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')", does) for h, p, does in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))]
    words = ", ".join(f"'{w}'" for w in LISTED_WORDS)
    return f"""
with a as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
b as (select *, regexp_extract(rest, '^[^/?#]*') as h from a),
c as (select *, substr(rest, length(h) + 1) as after from b),
d as (select *, translate(h, '{UPPER}', '{LOWER}') as host, regexp_extract(after, '^[^?#]*') as path from c),
e as (select *, regexp_extract(substr(after, length(path) + 1), '^\\?([^#]*)', 1) as query from d),
f as (select *, list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' and not regexp_matches(p, '{TRACKING}'))) as kept from e),
g as (select *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+\\z', '') || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as canonical from f),
l as (select distinct canonical as on_list from g where list_has_any(regexp_split_to_array(host, '[.-]'), [{words}]) and canonical <> ''),
r as (select *, on_list is not null as listed,
  case {' '.join(f"when {fits} then '{rule}'" for rule, fits, _ in whens)} end as rule,
  case {' '.join(f"when {fits} then '{does}'" for _, fits, does in whens)} end as action
  from g left join l on canonical = on_list)
select page_id, host, path, rule, coalesce(action, case when listed then 'block' else 'allow' end) as verdict, listed from r"""

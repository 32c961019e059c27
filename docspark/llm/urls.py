"""URL filter: host rules, and a list of blocked URLs behind a blocked Bloom filter.

The filter is a table of 64-bit blocks, at most MAX_BLOCKS of them whatever the list's length: a URL's hash
chooses a block and four bits in it. It is broadcast, since its size is bounded, and a probe is one
hash join on the block number. What passes is joined exactly with the listed URLs, which removes false
positives; a longer list makes more of them, never a wrong verdict. All of it is DataFrame work.

Defined cases: a null URL, or one without `://`, has an empty host and path, fits no rule and is allowed;
repeated rows are judged each; an empty list or table is fine; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import block_of, bloom, mask_of

#: 2^17 blocks of 8 bytes.
MAX_BLOCKS = 1 << 17
#: Parts in which rows of one hot URL are joined.
SALTS = 16

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _rest(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)


def host(url: Column) -> Column:
    """What stands between the first `://` and `/`, `?`, `#` or the end, ASCII letters lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(host_: Column, path_: Column) -> Column:
    """The form under which URLs are listed: no scheme, leading `www.` or `m.`, query, fragment, index page or closing `/`."""
    name = F.regexp_replace(host_, r"^(www|m)\.", "")
    return F.concat(name, F.regexp_replace(F.regexp_replace(path_, r"\.html?$", ""), r"/+$", ""))


def rule_of(host_: Column, path_: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one. Equal lengths: the first in code points.

    A rule is (host and path prefix as one string, verdict).
    """
    dotted = F.concat(F.lit("."), host_)
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        name, slash, rest = rule.partition("/")
        fits = dotted.endswith("." + name) & path_.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return found, verdict


def in_list(urls: DataFrame, listed: DataFrame, blocks: int = MAX_BLOCKS) -> DataFrame:
    """Add `listed` to rows (canonical, salt, ...): whether the list (canonical, distinct) holds the URL.

    Only rows that pass the filter are shuffled to the list. A URL that many rows share is dealt over
    SALTS parts, the list's few candidates being repeated for each.
    """
    hash_ = F.xxhash64("canonical")
    sieve = F.broadcast(bloom(listed, hash_, blocks))
    probed = urls.join(sieve, block_of(hash_, blocks) == F.col("_block"), "left")
    mask = mask_of(hash_)
    probed = probed.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(mask) == mask, F.lit(False))).drop("_block", "_bits")
    part = F.pmod(F.xxhash64("salt"), F.lit(SALTS))
    # a row that the filter clears gets a key that no listed URL has, and so needs no partner
    key = F.when(F.col("_maybe"), F.concat(F.col("canonical"), F.lit("\n"), part))
    copies = listed.select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.concat(F.col("canonical"), F.lit("\n"), s))).alias("_key")
    )
    maybe = probed.where("_maybe").withColumn("_k", key)
    sure = maybe.join(copies, F.col("_k") == F.col("_key"), "left").withColumn("listed", F.col("_key").isNotNull())
    cleared = probed.where("not _maybe").withColumn("listed", F.lit(False))
    return sure.drop("_k", "_key", "_maybe").unionByName(cleared.drop("_maybe"))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], blocks: int = MAX_BLOCKS) -> DataFrame:
    """Verdict of every page: (page_id, host, path, rule, listed, verdict).

    A rule decides; without one, a listed URL is blocked and any other allowed.
    """
    url = pages["url"]
    rows = pages.select(pages["page_id"].alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    rows = rows.withColumn("canonical", canonical(F.col("host"), F.col("path"))).withColumn("salt", F.col("page_id"))
    judged = in_list(rows, listed, blocks)
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(says, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", rule.alias("rule"), "listed", verdict.alias("verdict"))

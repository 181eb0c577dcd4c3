"""Secret scans with corpus-wide ownership frequency.

Every text is scanned for the base kinds and for a few kinds of vendor keys. A candidate's value is hashed,
and over the whole corpus the distinct repositories and owners that have it are counted. A value is a widely
copied example if COPIED_OWNERS owners have it, or two owners in COPIED_REPOS repositories; a value of one owner,
in however many of their repositories, and one that two owners have in few, looks like a live credential. Base
findings are always reported; vendor keys are added where they look live.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, cut, small

#: Kinds in the order that breaks ties; pattern, group of the value, least characters of the value, and a pattern that
#: every text with a match has, to pass over the others quickly.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12, "(?i)passw|secret|token|api_?key"),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18, "AKIA"),
    ("hex", r"[0-9a-f]{16,}", 0, 16, "[0-9a-f]{16}"),
)
VENDOR = (
    ("forge", r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|glpat-[A-Za-z0-9_-]{20,})", 0, 20, "gh[pousr]_|glpat-"),
    ("chat", r"\bxox[abprs]-[A-Za-z0-9-]{20,}", 0, 20, "xox"),
    ("sk", r"\bsk[-_](?:live[-_]|test[-_]|proj-)?[A-Za-z0-9]{20,}", 0, 20, "sk[-_]"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 30, "eyJ"),
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]{40,}", 0, 60, "-----BEGIN "),
)
KINDS = tuple(k for k, *_ in (*BASE, *VENDOR))
#: Owners from which a value counts as widely copied, and repositories from which one of two owners does.
COPIED_OWNERS, COPIED_REPOS = 3, 4
#: Occurrences from which a value may be a hot one (a larger share of all findings may be asked for, see _by_value).
HOT = 10_000


def _found(text: Column, rank: int, pattern: str, group: int, least: int, needs: str) -> Column:
    """Structs ``start, rank, end, value`` of a pattern's matches, leftmost and non-overlapping, in code points.

    A match starts after all text between matches and all matches before it. Short values are dropped
    after matching, so that they still use up their text.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    sizes = F.transform(whole, F.char_length)
    gaps = F.transform(F.split(text, pattern), F.char_length)
    step = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), sizes.alias("size"), value.alias("value"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>").alias("out"))
    walked = F.aggregate(
        step, zero,
        lambda s, m: F.struct(
            (s["at"] + m["gap"] + m["size"]).alias("at"),
            F.when(
                F.char_length(m["value"]) >= least,
                F.concat(s["out"], F.array(F.struct((s["at"] + m["gap"]).alias("start"), F.lit(rank).alias("rank"), (s["at"] + m["gap"] + m["size"]).alias("end"), m["value"].alias("value")))),
            ).otherwise(s["out"]).alias("out"),
        ),
        lambda s: s["out"],
    )
    plain = re.fullmatch(r"[\w -]+", needs)
    return F.when(F.contains(text, F.lit(needs)) if plain else F.rlike(text, F.lit(needs)), walked).otherwise(zero["out"])


def _listed(spans: Column, more=lambda s: []) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"), *more(s))), ",")


def _spread(every: DataFrame) -> DataFrame:
    """``value, owners, repos, n`` of ``every(value, owner, repo)``; partial sums come before each exchange."""
    homes = every.groupBy("value", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = homes.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("n"))


def _by_value(findings: DataFrame, shared: DataFrame) -> DataFrame:
    """``findings`` joined to ``shared`` by value, without a hot value's rows meeting in one task.

    A broadcast if ``shared`` is small. Else the values of the most occurrences are broadcast, those with HOT or
    more and over one in BROADCAST_ROWS / 2 of all, of which there can't be more than that; the others are exchanged.
    """
    sized = small(shared)
    if sized is not shared:
        return findings.join(sized, "value")
    least = max(HOT, 2 * (shared.agg(F.sum("n")).first()[0] or 0) // BROADCAST_ROWS)
    hot = shared.filter(F.col("n") > least)
    hot_rows = findings.join(F.broadcast(hot), "value")
    return hot_rows.unionByName(findings.join(F.broadcast(hot.select("value")), "value", "left_anti").join(shared.filter(F.col("n") <= least), "value"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None,
         copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """One row per row of ``docs``: the id, counts and digest of base findings, all spans, and the method's verdicts.

    ``spans`` lists base findings and the vendor keys that look live; ``verdicts`` lists every finding, vendor keys
    left out of ``spans`` included, as kind:start:end:owners:repositories:live or copied; ``n_live`` and
    ``n_copied`` count the distinct values of each verdict. Owner defaults to ``source`` and repository to source
    and language; null owners are one owner. A null or empty text has no findings; repeated rows stay, each with
    its own spans; an empty table gives an empty one; other columns are ignored. Texts of any length are scanned
    whole and once; only findings go on.
    """
    by = F.col("source").cast("string") if owner is None else owner
    of = F.concat_ws("/", F.coalesce(by, F.lit("?")), F.col("lang").cast("string")) if repository is None else repository
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(by, F.lit("?")).alias("owner"), F.coalesce(of, F.lit("?")).alias("repo"), text.alias("text"))
    base = F.concat(*(_found(F.col("text"), k, *how) for k, (_, *how) in enumerate(BASE)))
    more = F.concat(*(_found(F.col("text"), k + len(BASE), *how) for k, (_, *how) in enumerate(VENDOR)))
    hashed = lambda spans: F.transform(F.sort_array(spans), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.xxhash64(s["value"], F.lit(3)).alias("value")))
    slim = keyed.select("id", "owner", "repo", hashed(base).alias("base"), hashed(more).alias("more"))
    slim = cut(slim.withColumn("row", F.monotonically_increasing_id()))
    every = slim.select("row", "owner", "repo", F.explode(F.concat("base", "more")).alias("s")).select("row", "owner", "repo", F.col("s.value").alias("value"))
    # a value of one repository needs no entry
    shared = cut(_spread(every).filter("repos > 1"))
    found = _by_value(every.select("row", "value").distinct(), shared)
    told = found.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("value", F.struct("owners", "repos")))).alias("known"))
    one = F.struct(F.lit(1).cast("long").alias("owners"), F.lit(1).cast("long").alias("repos"))
    joined = slim.join(told, "row", "left")
    spread = lambda value: F.coalesce(F.try_element_at("known", value), one)
    is_copied = lambda value: (spread(value)["owners"] >= copied_owners) | ((spread(value)["owners"] > 1) & (spread(value)["repos"] >= copied_repos))
    verdict = lambda s: [spread(s["value"])["owners"].cast("string"), spread(s["value"])["repos"].cast("string"), F.when(is_copied(s["value"]), "copied").otherwise("live")]
    live = F.filter("more", lambda s: ~is_copied(s["value"]))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    values = F.array_distinct(F.transform(F.concat("base", "more"), lambda s: s["value"]))
    n_copied = F.size(F.filter(values, is_copied)).cast("long")
    return joined.select(
        F.col("id").alias(id_col), *(count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.sort_array(F.concat("base", live))).alias("spans"),
        (F.size(values).cast("long") - n_copied).alias("n_live"), n_copied.alias("n_copied"),
        _listed(F.sort_array(F.concat("base", "more")), verdict).alias("verdicts"),
    )

"""URL filters by a cascade of Bloom filters, with DataFrame functions only.

A rule is a host and a path; it fits the host and its subdomains where the url's path starts with the rule's. Every url
gives its candidate keys: each host suffix with each path prefix of a length that some rule has. The cascade holds the
listed keys exactly over the whole universe of candidate keys in the corpus: level 0 encodes the listed keys, level 1
the other keys of the universe that level 0 lets through, level 2 the listed keys that level 1 lets through, and so on
until a level lets nothing wrong through. A key is listed if the first level that rejects it is odd. One pass over the corpus counts
its distinct keys approximately; level 0 takes so many hashes (log2 of keys of the universe a listed key) that a second
pass finds about as many false positives as there are listed keys, whatever the corpus; later levels work on those and
the list alone. The filters are literals of the plan, each of them once, so urls are judged in one scan without join or
shuffle.

The filters' bits are proportional to the list, at most 1.5 log2(universe / list) bits a key in level 0; the list and the
false positives pass the driver as bits only, never as keys. The count sets sizes alone: with a wrong one the answers are
the same.

A second cascade over the listed keys tells blocked from allowed ones.

Defined cases: null url, or one without `://`, has an empty host and path and no rule; of rules that fit, the longest
(as `host` + `path`) wins, of equally long ones the one with the longer host; without a rule the verdict is the
cascade's for an unlisted key: allow. Repeated rules with the same key count once, block before allow. A very long url is
one row, with a key for each host suffix and known path length; repeated rows are judged alike; other columns, also such
as `host` or `rule`, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beliefmesh.llm.common import pick

# the contract's rules
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
HASHES = 3
MOST_HASHES = 40


AFTER_SCHEME = "if(instr(url, '://') > 0, substring(url, instr(url, '://') + 3), '')"


def host_of() -> Column:
    host = F.regexp_extract(F.expr(AFTER_SCHEME), r"^[^/?#]*", 0)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of() -> Column:
    return F.coalesce(F.regexp_extract(F.expr(AFTER_SCHEME), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(lengths: list[int]) -> Column:
    """Array of (size, host length, key), longest first: host suffixes at label bounds x path prefixes of known lengths."""
    sizes = ", ".join(str(n) for n in lengths) or "cast(null as int)"
    return F.expr(f"""array_sort(flatten(transform(
        filter(sequence(1, greatest(1, length(host))), i -> length(host) > 0 and (i = 1 or substring(host, i - 1, 1) = '.')),
        i -> transform(filter(array({sizes}), n -> n <= length(path)),
            n -> named_struct('size', length(host) - i + 1 + n, 'of_host', length(host) - i + 1, 'key', concat(substring(host, i), substring(path, 1, n))))
    )), (a, b) -> case when a.size != b.size then b.size - a.size else b.of_host - a.of_host end)""")


@dataclass
class Cascade:
    levels: list[tuple[int, int, int, list[int]]] = field(default_factory=list)  # seed, hashes, bits, words

    def passes(self, key: str, level: int) -> str:
        """SQL: whether the level's filter lets the key through. The words stand in it once, as a lambda's argument."""
        seed, hashes, bits, words = self.levels[level]
        table = "array(" + ", ".join(f"{w}L" if w > -(1 << 63) else "-9223372036854775807L - 1L" for w in words) + ")"
        tests = [f"getbit(element_at(w{level}, cast({at} div 64 as int) + 1), cast({at} % 64 as int)) = 1" for at in positions(key, seed, hashes, bits)]
        return f"exists(array({table}), w{level} -> {' and '.join(tests)})"

    def contains(self, key: str) -> str:
        """SQL: exact membership for keys of the universe: the first level that rejects is odd, or none does and the
        number of levels is odd."""
        out = "true" if len(self.levels) % 2 else "false"
        for i in reversed(range(len(self.levels))):
            out = f"if({self.passes(key, i)}, {out}, {'true' if i % 2 else 'false'})"
        return out


def positions(key: str, seed: int, hashes: int, bits: int) -> list[str]:
    return [f"pmod(xxhash64({key}, {seed * MOST_HASHES + j}), {bits})" for j in range(hashes)]


def bits_of(keys: DataFrame, seed: int, hashes: int, bits: int) -> list[int]:
    """The filter over column `key` as 64-bit words: ors of single bits, aggregated by word."""
    at = keys.select(F.explode(F.array(*[F.expr(x) for x in positions("key", seed, hashes, bits)])).alias("at"))
    words = at.selectExpr("cast(at div 64 as int) as w", "shiftleft(1L, cast(at % 64 as int)) as b").groupBy("w").agg(F.bit_or("b").alias("b"))
    got = {r["w"]: r["b"] for r in words.collect()}
    return [got.get(i, 0) for i in range(-(-bits // 64))]


def build(listed: DataFrame, universe: DataFrame, universe_size: int | None = None, most_levels: int = 40) -> Cascade:
    """listed, universe: DataFrames with one string column `key`. `universe` may hold the listed keys too;
    universe_size, its distinct keys, is counted (approximately) by default and sets the size of level 0 alone."""
    cascade = Cascade()
    inside = listed.where("key is not null").distinct().persist()
    n = inside.count()
    if not n:
        inside.unpersist()
        return cascade
    if universe_size is None:
        universe_size = universe.agg(F.approx_count_distinct("key")).first()[0]
    first_hashes = min(MOST_HASHES, max(HASHES, math.ceil(math.log2(max(2.0, universe_size / n)))))
    current, count, before = inside, n, None
    for level in range(most_levels):
        hashes = HASHES if level else first_hashes
        bits = 64 * math.ceil(count * hashes * (2 if level else 1.5) / 64)
        cascade.levels.append((level, hashes, bits, bits_of(current, level, hashes, bits)))
        if before is None:  # the one pass over the corpus
            before = universe.where(cascade.passes("key", 0)).distinct().join(inside, "key", "left_anti").persist()
            outside = before
        else:
            before = before.where(cascade.passes("key", level))
        current, before = before, current
        count = current.count()
        if not count:
            break
    inside.unpersist()
    outside.unpersist()
    if count:
        raise ValueError(f"the cascade did not end after {most_levels} levels")
    return cascade


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every url. rules: (verdict, key), key = host and path."""
    spark: SparkSession = pages.sparkSession
    listed: dict[str, str] = {}
    for verdict, key in rules:
        listed[key] = "block" if "block" in (verdict, listed.get(key)) else "allow"
    lengths = sorted({len(k) - k.index("/") for k in listed})
    urls = pick(pages, "page_id", "url").withColumns({"host": host_of(), "path": path_of()})
    keys = spark.createDataFrame([(k, v) for k, v in listed.items()], "key string, verdict string")
    universe = urls.select(F.explode(candidates(lengths)).alias("c")).select("c.key")
    member = build(keys.select("key"), universe)
    blocked = build(keys.where("verdict = 'block'").select("key"), keys.select("key"))
    fits = urls.withColumn("fits", candidates(lengths)).withColumn("rule", F.expr(f"get(filter(transform(fits, c -> c.key), k -> {member.contains('k')}), 0)"))
    return fits.select("page_id", "host", "path", "rule", F.expr(f"if(rule is not null and {blocked.contains('rule')}, 'block', 'allow')").alias("verdict"))

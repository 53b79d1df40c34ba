"""URL rules by a cascade of Bloom filters, exact over the key universe of the corpus; SQL functions only.

Level 1 encodes the listed keys; level 2 encodes the unlisted keys of the universe that level 1 lets through;
level 3 the listed keys that level 2 lets through, and so on, until no key is wrong. Tests of a key then
need no join: the levels are literals whose size depends on the lists, not on the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domora.session import materialise, table

HASHES = 4
BITS_PER_KEY = 10
MAX_LEVELS = 24
#: Most bits of a level (32 MB); a list that needs more is refused with an error.
MAX_BITS = 1 << 28
#: (host, path, verdict); fixed by the job, longest first wins.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Hosts of the default block list; a subdomain of a listed host is listed too.
LISTED_HOSTS = ["casino-win.example.com", "free-bets.example.com", "cheap-pills.example.com", "ads-track.example.com", "spam-farm.example.com", "adult-x.example.net"]
#: Names of the block list by names: a host with one of them as a label, under any ending, is listed.
LISTED_NAMES = [h.split(".", 1)[0] for h in LISTED_HOSTS]


@dataclass(frozen=True)
class Level:
    bits: int
    words: list[int] = field(repr=False)


def _places(key: Column, level: int, bits: int) -> list[Column]:
    """Bit numbers of a key by double hashing; each level has its own seed."""
    a = F.pmod(F.xxhash64(F.lit(2 * level), key), F.lit(bits))
    b = F.pmod(F.xxhash64(F.lit(2 * level + 1), key), F.lit(bits - 1)) + 1
    return [(a + F.lit(i) * b) % bits for i in range(HASHES)]


def _may_contain(key: Column, n: int, level: Level) -> Column:
    # one text that the optimizer folds into an array, instead of an expression for each word
    held = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")
    hit = F.lit(True)
    for p in _places(key, n, level.bits):
        word = F.element_at(held, (F.floor(p / 64) + 1).cast("int"))
        hit = hit & (word.bitwiseAND(_bit(p)) != 0)
    return hit


def _bit(place: Column) -> Column:
    return F.element_at(F.lit([1 << i if i < 63 else -(1 << 63) for i in range(64)]), (place % 64 + 1).cast("int"))


def _encode(keys: DataFrame, n: int) -> Level | None:
    """One Bloom filter over the distinct keys of a column named key; None without keys."""
    count = keys.count()
    if not count:
        return None
    bits = max(64, -(-count * BITS_PER_KEY // 64) * 64)
    if bits > MAX_BITS:
        raise ValueError(f"level {n} would need {bits} bits; the limit is {MAX_BITS}")
    rows = (
        keys.select(F.explode(F.array(*_places(F.col("key"), n, bits))).alias("place"))
        .groupBy(F.floor(F.col("place") / 64).cast("int").alias("word"))
        .agg(F.bit_or(_bit(F.col("place"))).alias("held"))
        .collect()
    )
    words = [0] * (bits // 64)
    for r in rows:
        words[r["word"]] = r["held"]
    return Level(bits, words)


def build(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels for the listed keys against the universe; both have a column key, nulls and repeats are ignored.

    Work on the corpus is one scan: what passes level 1 wrongly is written to the shared folder once, and the
    later levels work on those few keys.
    """
    yes = listed.select("key").where("key is not null").distinct()
    levels: list[Level] = []
    first = _encode(yes, 1)
    if first is None:
        return levels
    levels.append(first)
    passed = universe.select("key").where(F.col("key").isNotNull() & _may_contain(F.col("key"), 1, first)).distinct()
    no = materialise(passed.join(yes, "key", "left_anti"))
    sides = [yes, no]
    for n in range(2, MAX_LEVELS + 1):
        side = sides[(n + 1) % 2]  # level 2 encodes the unlisted, level 3 the listed, ...
        level = _encode(side, n)
        if level is None:
            return levels
        levels.append(level)
        other = sides[n % 2]
        sides[n % 2] = other.where(_may_contain(F.col("key"), n, level))
    raise ValueError("the cascade does not end; raise BITS_PER_KEY")


def contains(key: Column, levels: list[Level]) -> Column:
    """Exact membership for keys of the universe that the levels were built over; false for a null key."""
    out = F.lit(len(levels) % 2 == 1)
    for n in range(len(levels), 0, -1):
        # the first level that does not hold the key decides: an odd one says unlisted, an even one listed
        out = F.when(_may_contain(key, n, levels[n - 1]), out).otherwise(F.lit(n % 2 == 0))
    return F.coalesce(key.isNotNull() & out, F.lit(False))


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): empty for a null url or one without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def label_counts(*hosts: DataFrame) -> list[int]:
    """How many labels the hosts of a list have; distinct, most first."""
    every = reduce(DataFrame.unionByName, [h.select(F.size(F.split("host", r"\.")).alias("n")) for h in hosts])
    return sorted((r["n"] for r in every.where("n > 0").distinct().collect()), reverse=True)


def suffixes(host: Column, counts: list[int]) -> Column:
    """The host and its parent domains, as far as they have one of the numbers of labels, longest first.

    Only these can be listed, so that a host of thousands of labels costs no more than its length.
    """
    none = F.array().cast("array<string>")
    if not counts:
        return none
    labels = F.split(host, r"\.")
    fitting = F.filter(F.lit(counts), lambda n: n <= F.size(labels))
    return F.when(host == "", none).otherwise(F.transform(fitting, lambda n: F.concat_ws(".", F.slice(labels, F.size(labels) - n + 1, n))))


def _keys(host: Column, path: Column, lengths: list[int], counts: list[int]) -> Column:
    """Keys host suffix + path prefix of the given lengths, as far as host and path have them."""
    return F.flatten(F.transform(suffixes(host, counts), lambda h: F.filter(F.array(*[F.when(F.length(path) >= n, F.concat(h, F.substring(path, 1, n))) for n in lengths]), lambda k: k.isNotNull()))) if lengths else F.array().cast("array<string>")


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict for every page.

    rules: host, path, verdict (allow or block); a rule fits its host and all subdomains if the url's path
    starts with the rule's path; the longest host + path wins, of equally long ones that with the longer host,
    and block wins over allow for one key listed twice. listed: host; without a fitting rule a page on a listed host or below one is blocked, else
    allowed. A null url, or one without ://, has empty parts, fits nothing and is allowed. Rows are judged
    one by one, so repeats stay; other columns are not read. Very long urls, and hosts of any number of labels,
    are judged like others: only parent domains with as many labels as a listed host are looked up.
    """
    rules = rules.where("host is not null and path is not null").select(F.lower("host").alias("host"), "path", "verdict")
    listed = listed.where("host is not null").select(F.lower("host").alias("host"))
    # path lengths and numbers of labels are those of the lists, not of the corpus
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    host, path = parts(F.col("url").cast("string"))
    urls = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    keyed = urls.withColumn("keys", _keys(F.col("host"), F.col("path"), lengths, label_counts(rules))).withColumn("hosts", suffixes(F.col("host"), label_counts(listed)))
    rule_keys = rules.select(F.concat("host", "path").alias("key"), "verdict")
    universe = keyed.select(F.explode("keys").alias("key"))
    every = build(rule_keys, universe)
    blocks = build(rule_keys.where("verdict = 'block'"), universe)
    bad = build(listed.select(F.col("host").alias("key")), keyed.select(F.explode("hosts").alias("key")))
    fitting = F.filter(F.col("keys"), lambda k: contains(k, every))
    longest = F.reduce(fitting, F.lit(None).cast("string"), lambda held, k: F.when(held.isNull() | (F.length(k) > F.length(held)), k).otherwise(held))
    ruled = keyed.withColumn("rule", longest)
    verdict = F.when(F.col("rule").isNotNull(), F.when(contains(F.col("rule"), blocks), "block").otherwise("allow")).otherwise(
        F.when(F.exists("hosts", lambda h: contains(h, bad)), "block").otherwise("allow")
    )
    return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def default_rules(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)
    return (
        spark.sql(f"select * from values {values(RULES)} as t(host, path, verdict)"),
        spark.sql(f"select * from values {values([(h,) for h in LISTED_HOSTS])} as t(host)"),
    )


def hosts_by_name(pages: DataFrame, names: list[str]) -> DataFrame:
    """host: all hosts and parent domains of the pages that start with one of the names, whatever their ending."""
    host, _ = parts(F.col("url").cast("string"))
    labels = F.split("host", r"\.")
    places = F.filter(F.sequence(F.lit(1), F.size(labels)), lambda i: (i < F.size(labels)) & F.element_at(labels, i).isin(names))
    return pages.select(host.alias("host")).select(F.explode(F.transform(places, lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))).alias("host")).distinct()


def op10_listed_names(spark, sf_dir):
    """op10_url_cascade with a list that is derived from all pages; the default list stays as its SQL has it."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, default_rules(spark)[0], hosts_by_name(pages, LISTED_NAMES))


def op10_url_cascade(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), *default_rules(spark))


def oracle(is_listed: str = "exists (select 1 from listed l where ('.' || u.host) like ('%.' || l.h))") -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    listed = ", ".join(f"('{h}')" for h in LISTED_HOSTS)
    return f"""
with rules(h, p, v) as (values {rules}), listed(h) as (values {listed}),
r as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) end as rest from pages),
u as (select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1), '') as path from r),
m as (select u.page_id, h || p as rule, v, row_number() over (partition by u.page_id order by length(h || p) desc) as nth
  from u join rules on ('.' || host) like ('%.' || h) and starts_with(path, p))
select u.page_id, host, path, m.rule, coalesce(m.v, case when {is_listed} then 'block' else 'allow' end) as verdict
from u left join m on m.page_id = u.page_id and m.nth = 1"""


def oracle_by_name() -> str:
    return oracle(rf"regexp_matches('.' || u.host, '\.({'|'.join(LISTED_NAMES)})\.')")

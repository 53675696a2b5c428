"""URL filters: pattern rules indexed by their rarest literal token.

A rule names literal tokens that every URL it fits must hold as whole
alphanumeric runs.  One aggregate counts those tokens over all URLs; each rule is
filed under its rarest one.  A URL's tokens fetch candidate rules, and only those
run their regular expression.  Everything is DataFrame functions.

Up to ``inline`` rules the index is a literal map: no shuffle, no join.  A longer
list is joined by token to the distinct URLs.

Host rules come first, the longest that fits wins, ties by label; else the pattern rules
in their order, A-Z lower-cased first; else allow.

The counts of the rules' tokens are an action that runs while the result is built.

Defined results: a null URL, or one without ``://``, has an empty host and path and
is allowed; a very long URL is judged whole; repeated rows are judged alike; an empty
table gives no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INLINE_RULES = 500


@dataclass(frozen=True)
class Rule:
    """A regular expression over host and path, and the literal tokens that a match always holds."""

    verdict: str
    label: str
    regex: str
    tokens: tuple[str, ...]
    #: of a host rule, its length; the longest fit wins.  0: a pattern rule, the first fit wins.
    length: int = field(default=0)


def host_rule(verdict: str, host: str, path: str = "/") -> Rule:
    """Fits the host and all its subdomains where the path starts with ``path``."""
    regex = r"^(?:[^/]*\.)?" + re.escape(host) + (re.escape(path) if path else r"(?=/|$)")
    tokens = re.findall(r"[a-z0-9]+(?=[^a-z0-9]|$)", host) + re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.lower())
    return Rule(verdict, host + path, regex, tuple(tokens), len(host + path))


def word_rule(verdict: str, *words: str, label: str = "") -> Rule:
    """Fits where the words stand in a row, joined by one of ``. _ + -``, with a separator around them."""
    body = "[._+-]".join(map(re.escape, words))
    return Rule(verdict, label or "-".join(words), rf"(?:^|[^a-z0-9]){body}(?:[^a-z0-9]|$)", words)


HOST_RULES = (
    host_rule("block", "net", "/"),
    host_rule("allow", "example.net", "/en/"),
    host_rule("block", "example.com", "/de/"),
    host_rule("allow", "org", "/fr/"),
)
#: Phrases by category, in the order in which they are tried.
PHRASES = {
    "pharmacy": (
        "cheap pills", "cheap meds", "diet pills", "viagra", "cialis", "levitra", "kamagra", "sildenafil", "tadalafil", "tramadol",
        "xanax", "phentermine", "no prescription", "without prescription", "canadian pharmacy", "online pharmacy", "pills online", "buy steroids", "male enhancement", "penis enlargement",
    ),
    "gambling": (
        "online casino", "casino", "casinos", "casino bonus", "sports betting", "sportsbook", "betting odds", "betting tips", "poker", "poker online",
        "blackjack", "baccarat", "roulette online", "slot machines", "online slots", "free spins", "judi online", "slot gacor", "togel", "sbobet",
    ),
    "loans": (
        "payday loans", "payday loan", "quick loans", "instant loan", "fast cash", "bad credit loans", "no credit check", "debt relief now", "cash advance online", "credit repair secrets",
    ),
    "adult": (
        "xxx", "porn", "porno", "porntube", "pornhub", "xvideos", "xhamster", "redtube", "adult dating", "adult video",
        "adult chat", "sex cam", "sex cams", "sex chat", "sex videos", "live cams", "webcam girls", "camgirls", "nude pics", "nudes",
        "hentai", "milf", "escort service", "escorts", "hookup tonight", "hot singles", "onlyfans leak", "erotic stories", "blowjob", "gangbang",
    ),
    "piracy": (
        "warez", "keygen", "keygens", "serial key", "serial keys", "crack download", "cracked software", "cracked apk", "nulled", "nulled scripts",
        "torrent download", "torrents", "full movie download", "free movie download", "mp3 download", "free ringtones", "license key generator", "activation key free", "mod apk", "rapidshare download",
    ),
    "seo": (
        "spam farm", "link farm", "seo links", "buy backlinks", "backlinks cheap", "guest post service", "article spinner", "buy followers", "buy likes", "buy views",
        "buy reviews", "traffic exchange", "paid to click", "expired domains list", "link exchange", "directory submission", "doorway page", "cheap seo", "web traffic bot", "autoblog",
    ),
    "goods": (
        "replica watches", "replica handbags", "fake rolex", "fake id", "fake passport", "fake diploma", "buy degree", "cheap jordans", "louis vuitton outlet", "ugg outlet",
        "wholesale jerseys", "cheap jerseys", "essay writing service", "buy essay", "write my essay", "counterfeit money", "cloned cards", "buy cocaine", "buy weed online", "buy fentanyl",
    ),
    "schemes": (
        "get rich quick", "make money fast", "easy money online", "work from home now", "free bitcoin", "bitcoin doubler", "crypto giveaway", "forex signals free", "binary options", "hyip",
        "ponzi", "pyramid scheme", "multi level marketing", "passive income secret", "lottery winner", "you have won", "claim your prize", "free gift card", "free iphone", "miracle cure",
    ),
    "malware": (
        "phishing kit", "ransomware download", "free antivirus download", "registry cleaner", "driver updater", "flash player update", "codec pack download", "account hacked", "hack facebook", "hack instagram",
        "password cracker", "carding", "cvv shop", "botnet", "ddos service", "stresser", "booter", "rat download", "stealer logs", "verify your account",
    ),
}
PATTERN_RULES = (
    *(word_rule("block", *phrase.split(), label=f"{kind}/{phrase.replace(' ', '-')}") for kind, phrases in PHRASES.items() for phrase in phrases),
    Rule("block", "host/dotted-quad", r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?:/|$)", ()),
    Rule("block", "host/many-labels", r"^(?:[^./]+\.){7}", ()),
    Rule("block", "host/many-hyphens", r"^[^/.]*-[^/.]*-[^/.]*-[^/.]*-[^/.]*\.", ()),
    Rule("block", "malware/login-verify", r"(?:^|[^a-z0-9])login[.-](?:[^/]*[.-])?verify(?:[^a-z0-9]|$)", ("login", "verify")),
    Rule("block", "malware/secure-update", r"^[^/]*(?:^|[^a-z0-9])secure[.-](?:[^/]*[.-])?update(?:[^a-z0-9]|$)", ("secure", "update")),
    Rule("block", "seo/comment-reply", r"/index\.php/comment/reply/[0-9]+(?:/|$)", ("index", "php", "comment", "reply")),
    Rule("block", "seo/tag-trap", r"(?:/tag/[^/]+){3}", ("tag",)),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct alphanumeric runs of host and path, A-Z lower-cased; an empty one stands for rules without tokens."""
    parts = F.split(F.translate(F.concat(host, F.lit("/"), path), UPPER, LOWER), "[^a-z0-9]+")
    return F.array_distinct(F.concat(F.array(F.lit("")), parts))


def token_counts(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """URLs that hold each token of the rules; as many rows come back as the rules have tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    held = F.array_intersect(tokens_of(F.col("host"), F.col("path")), F.array(*map(F.lit, wanted)))
    rows = urls.select(F.explode(held).alias("token")).groupBy("token").count().collect()
    return dict.fromkeys(wanted, 0) | {r["token"]: r["count"] for r in rows}


def index(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """The rules' numbers under their rarest token; equally rare ones by name."""
    out: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        out.setdefault(min(r.tokens, key=lambda t: (counts[t], t), default=""), []).append(i)
    return out


def judge(
    pages: DataFrame,
    host_rules: tuple[Rule, ...] = HOST_RULES,
    pattern_rules: tuple[Rule, ...] = PATTERN_RULES,
    inline: int = INLINE_RULES,
) -> DataFrame:
    """page_id, host, path, rule (of a host rule, else null), verdict, pattern (of a pattern rule, else null)."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # the order of preference: longer host rules, shorter ones, patterns in order
    rules = sorted(host_rules, key=lambda r: (-r.length, r.label)) + list(pattern_rules)
    filed = index(rules, token_counts(urls, rules))
    best = _inline(urls, rules, filed) if len(rules) <= inline else _joined(urls, rules, filed)
    rule = lambda f: F.col(f"best.{f}")
    return best.select(
        "page_id",
        "host",
        "path",
        F.when(rule("length") > 0, rule("label")).alias("rule"),
        F.coalesce(rule("verdict"), F.lit("allow")).alias("verdict"),
        F.when(rule("length") == 0, rule("label")).alias("pattern"),
    )


def _fits(rule: Column) -> Column:
    at = F.concat("host", "path")
    # paths of host rules are given letter by letter; patterns are in lower case
    return F.rlike(F.when(rule["length"] > 0, at).otherwise(F.translate(at, UPPER, LOWER)), rule["regex"])


def _inline(urls: DataFrame, rules: list[Rule], filed: dict[str, list[int]]) -> DataFrame:
    def entry(i: int) -> Column:
        r = rules[i]
        return F.struct(F.lit(i).alias("rank"), F.lit(r.verdict).alias("verdict"), F.lit(r.label).alias("label"), F.lit(r.length).alias("length"), F.lit(r.regex).alias("regex"))

    if not filed:
        best = F.lit(None).cast("struct<rank:int,verdict:string,label:string,length:int,regex:string>")
    else:
        lookup = F.create_map(*[x for t, of in filed.items() for x in (F.lit(t), F.array(*map(entry, of)))])
        fetched = F.filter(F.transform(tokens_of(F.col("host"), F.col("path")), lambda t: F.try_element_at(lookup, t)), lambda x: x.isNotNull())
        best = F.array_min(F.filter(F.flatten(fetched), _fits))
    return urls.select("*", best.alias("best"))


def _joined(urls: DataFrame, rules: list[Rule], filed: dict[str, list[int]]) -> DataFrame:
    rows = [(t, i, rules[i].verdict, rules[i].label, rules[i].length, rules[i].regex) for t, of in filed.items() for i in of]
    book = urls.sparkSession.createDataFrame(rows, "token string, rank int, verdict string, label string, length int, regex string")
    distinct = urls.select("host", "path").distinct()
    fits = (
        distinct.select("host", "path", F.explode(tokens_of(F.col("host"), F.col("path"))).alias("token"))
        .join(book, "token")
        .withColumn("best", F.struct("rank", "verdict", "label", "length", "regex"))
        .where(_fits(F.col("best")))
        .groupBy("host", "path")
        .agg(F.min("best").alias("best"))
    )
    return urls.join(fits, ["host", "path"], "left")

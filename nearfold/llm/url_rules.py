"""URL verdicts from pattern rules, indexed by their rarest literal token.

A rule names a host suffix and a path prefix (a domain rule) or a regular
expression over the lower-cased URL (a pattern rule). Each rule is filed under
one of its literal tokens, the one fewest URLs hold; a URL looks up its own
tokens, and only the rules so found run their expression.

Everything is DataFrame functions, a row in and a row out. A rule list of bounded size travels
as a literal, without any shuffle, so a host that holds a third of all rows costs no more than
others; a longer one is a table joined on the token with the distinct addresses. URLs that
are null or lack "://" have an empty host and path, fit no domain rule and get the
default; pattern rules look at the host and path alone. Repeated rows are judged alike and very long URLs
whole; columns not asked for are left out; an empty table gives no rows, no rules the default.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm.common import ascii_lower

ALLOW, BLOCK = "allow", "block"
TOKEN = r"[a-z0-9]+"
# So many rules travel inside the plan; longer lists are a table joined on the token.
MOST_RULES = 5_000


@dataclass(frozen=True)
class UrlRule:
    """`tokens`: literals that every URL the rule fits holds as whole tokens."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...] = field(default=())
    is_domain: bool = False


def domain_rule(rule: str, verdict: str) -> UrlRule:
    """`example.org/es/`: the host or any subdomain, and every path that starts so.

    The last token of the path may go on in the URL (`/1` fits `/12`), so it is no
    literal token unless a slash ends it.
    """
    host, slash, path = rule.partition("/")
    if not host or not slash:
        raise ValueError(f"a domain rule needs a host and a path: {rule!r}")
    whole = re.findall(TOKEN, host.lower())
    inner = re.sub(r"[A-Za-z0-9]+$", "", path)
    whole += re.findall(TOKEN, inner.lower())
    pattern = rf"^([^/]*\.)?{re.escape(host.lower())}/{re.escape(path)}"
    return UrlRule(rule, verdict, pattern, tuple(dict.fromkeys(whole)), True)


def pattern_rule(name: str, verdict: str, pattern: str, *tokens: str) -> UrlRule:
    """An expression over the lower-cased host and path, and the tokens it cannot do without."""
    if not tokens:
        raise ValueError(f"{name}: a pattern rule needs a literal token")
    return UrlRule(name, verdict, pattern, tuple(tokens))


def _after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower case."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*(/[^?#]*)", 1)


def _tokens(address: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(address), F.lit(f"({TOKEN})"), 1))


def token_counts(urls: DataFrame, rules: list[UrlRule], url: str = "url") -> dict[str, int]:
    """In how many URLs each literal token of the rules occurs, over all rows.

    Only tokens of rules are counted, so what comes back is bounded by the rules.
    """
    known = F.array(*[F.lit(t) for t in sorted({t for r in rules for t in r.tokens})])
    here = F.array_intersect(_tokens(F.concat(url_host(F.col(url)), url_path(F.col(url)))), known)
    counted = urls.select(F.explode(here).alias("token")).groupBy("token").count()
    return {r["token"]: r["count"] for r in counted.collect()}


def file_rules(rules: list[UrlRule], counts: dict[str, int]) -> dict[str, list[int]]:
    """token -> numbers of the rules filed under it: the rarest, then the longest, then the first."""
    filed: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
        filed.setdefault(rarest, []).append(i)
    return filed


def judge_urls(
    urls: DataFrame,
    rules: list[UrlRule] | DataFrame,
    url: str = "url",
    keep: tuple[str, ...] = ("page_id",),
    default: str = ALLOW,
) -> DataFrame:
    """`keep`, host, path, rule, method_rule and verdict for each row.

    Of the domain rules that fit the longest wins (ties: the first by name). Else a
    fitting pattern rule decides, allow before block, and is named in `method_rule`.
    Up to `MOST_RULES` rules travel in the plan; longer lists, and tables as `rules_table` makes
    them, are joined with the URLs' distinct addresses on the token.
    """
    split = urls.select(*keep, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    if isinstance(rules, list) and len(rules) > MOST_RULES:
        rules = rules_table(urls.sparkSession, rules)
    if isinstance(rules, DataFrame):
        best = _best_by_join(split.select("host", "path").distinct(), rules)
        judged = split.join(best, ["host", "path"], "left")
    elif rules:
        judged = split.withColumn("best", _best_in_plan(rules, token_counts(urls, rules, url)))
    else:
        judged = split.withColumn("best", F.lit(None).cast(BEST))
    return judged.select(
        *keep,
        "host",
        "path",
        F.when(F.col("best.rank") == 0, F.col("best.name")).alias("rule"),
        F.when(F.col("best.rank") == 1, F.col("best.name")).alias("method_rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )


BEST = "struct<rank:int,weight:int,name:string,verdict:string>"


def _fits(address: Column, rule) -> Column:
    return F.rlike(F.when(rule["is_domain"], address).otherwise(F.lower(address)), rule["pattern"])


def _best(rule) -> Column:
    """The least wins: by pattern rule, length downwards or allow first, name."""
    return F.struct(rule["rank"], rule["weight"], rule["name"], rule["verdict"])


def _best_in_plan(rules: list[UrlRule], counts: dict[str, int]) -> Column:
    filed = file_rules(rules, counts)
    index = F.create_map(
        *[
            x
            for token, numbers in sorted(filed.items())
            for x in (F.lit(token), F.array(*[_literal(rules[i], i) for i in numbers]))
        ]
    )
    address = F.concat("host", "path")
    known = F.array(*[F.lit(t) for t in sorted(filed)])
    fetched = F.flatten(F.transform(F.array_intersect(_tokens(address), known), lambda t: index[t]))
    return F.array_min(F.transform(F.filter(fetched, lambda r: _fits(address, r)), _best))


def rules_table(spark: SparkSession, rules: list[UrlRule]) -> DataFrame:
    """number, is_domain, pattern, rank, weight, name, verdict and tokens of each rule."""
    rows = [(i, r.is_domain, r.pattern, 0 if r.is_domain else 1, _weight(r), r.name, r.verdict, list(r.tokens)) for i, r in enumerate(rules)]
    return spark.createDataFrame(
        rows, "number long, is_domain boolean, pattern string, rank int, weight int, name string, verdict string, tokens array<string>"
    )


def _best_by_join(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path and the best rule of each address that any rule fits."""
    listed = rules.select("number", F.explode("tokens").alias("token"))
    held = addresses.select("host", "path", F.explode(_tokens(F.concat("host", "path"))).alias("token"))
    counts = held.join(listed.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rarest = F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), -F.length("token"), "token"))
    filed = listed.join(counts, "token", "left").groupBy("number").agg(rarest.alias("token")).join(rules, "number")
    fitting = held.join(filed, "token").where(_fits(F.concat("host", "path"), {c: F.col(c) for c in ("is_domain", "pattern")}))
    return fitting.groupBy("host", "path").agg(
        F.min(_best({c: F.col(c) for c in ("rank", "weight", "name", "verdict")})).alias("best")
    )


def _weight(rule: UrlRule) -> int:
    return -len(rule.name) if rule.is_domain else int(rule.verdict != ALLOW)


def _literal(rule: UrlRule, number: int) -> Column:
    return F.struct(
        F.lit(rule.is_domain).alias("is_domain"),
        F.lit(rule.pattern).alias("pattern"),
        F.lit(0 if rule.is_domain else 1).alias("rank"),
        F.lit(_weight(rule)).alias("weight"),
        F.lit(rule.name).alias("name"),
        F.lit(rule.verdict).alias("verdict"),
    )


DOMAIN_RULES = [
    domain_rule("org/", ALLOW),
    domain_rule("example.org/es/", BLOCK),
    domain_rule("example.org/en/1", BLOCK),
    domain_rule("com/fr/", ALLOW),
    domain_rule("com/de/", BLOCK),
]


def _label(*tokens: str) -> str:
    """The tokens as one host label, joined by hyphens."""
    return rf"^([^/]*\.)?{'-'.join(tokens)}\."


PATTERN_RULES = [
    pattern_rule("casino", BLOCK, r"^[^/]*\b(online-)?casino(-[a-z0-9]+)?\.", "casino"),
    pattern_rule("bets", BLOCK, r"^[^/]*\b(free|live|sports?)-bets\.", "bets"),
    pattern_rule("poker", BLOCK, r"^[^/]*\b(online-)?poker(-[a-z0-9]+)?\.", "poker"),
    pattern_rule("pills", BLOCK, r"^[^/]*\b(cheap|buy|diet)-pills\.", "pills"),
    pattern_rule("adult", BLOCK, r"^[^/]*\badult(-[a-z0-9]+)?\.", "adult"),
    pattern_rule("xxx", BLOCK, r"^[^/]*\bxxx\b", "xxx"),
    pattern_rule("porn", BLOCK, r"^[^/]*\bporn\b", "porn"),
    pattern_rule("spam farm", BLOCK, _label("spam", "farm"), "spam", "farm"),
    pattern_rule("link farm", BLOCK, _label("link", "farm"), "link", "farm"),
    pattern_rule("tracker", BLOCK, _label("ads", "track"), "ads", "track"),
    pattern_rule("ad server", BLOCK, r"^([^/]*\.)?ads\.[^/]*\.", "ads"),
    pattern_rule("doubleclick", BLOCK, r"^[^/]*\bdoubleclick\.", "doubleclick"),
    pattern_rule("click tracker", BLOCK, r"^([^/]*\.)?click\.[^/]*\.", "click"),
    pattern_rule("pixel", BLOCK, r"/pixel\.(gif|png)$", "pixel"),
    pattern_rule("payday", BLOCK, r"^[^/]*\bpayday-loans?\.", "payday"),
    pattern_rule("replica", BLOCK, r"^[^/]*\breplica-watches\.", "replica", "watches"),
    pattern_rule("warez", BLOCK, r"^[^/]*\bwarez\b", "warez"),
    pattern_rule("torrent", BLOCK, r"^[^/]*\btorrent\.", "torrent"),
    pattern_rule("admin pages", BLOCK, r"/wp-admin(/|$)", "wp", "admin"),
    pattern_rule("login pages", BLOCK, r"/(user/)?login(\.[a-z]+|/|$)", "login"),
    pattern_rule("carts", BLOCK, r"/cart/", "cart"),
    pattern_rule("print views", BLOCK, r"/print/", "print"),
    pattern_rule("encyclopaedia", ALLOW, r"^([^/]*\.)?wikipedia\.", "wikipedia"),
    pattern_rule("standards", ALLOW, r"^([^/]*\.)?w3\.", "w3"),
]

# Words that say what a host or a folder is for.
BLOCKED_HOST_WORDS = (
    "slots roulette blackjack jackpot bingo lottery sportsbook bookmaker wagering baccarat viagra cialis levitra tramadol "
    "steroids pharmacy escorts hookup camgirls erotic hentai fetish nsfw webcams swingers mp3s keygen cracked serials "
    "nulled rapidshare megaupload torrents pirated streams123 loans forex binaryoptions cryptobonus getrich clickbank "
    "affiliates popunder popads adserver adclick adnetwork banners doubleclicks tracking telemetry beacons analytics2 "
    "metrics2 pagead sponsored counterfeit fakebags essaymill essays4you termpapers homeworkhelp followers likes4you "
    "parked expireddomain domainsale bulkmail mailblast spamlist freehost linkexchange backlinks seoboost"
).split()
BLOCKED_FOLDERS = (
    "signin signup register logout password checkout basket wishlist account billing invoice admin administrator cgi "
    "phpmyadmin xmlrpc feed rss trackback pingback comment-page replytocom share sharer printable print-view email-friend "
    "calendar ical attachment thumbnails gallery-slideshow adclick sponsored-links banner-ads popup redirect outbound "
    "go-to track-click pixel-track beacon telemetry search-results advanced-search sitemap-index tag-cloud"
).split()
ALLOWED_HOST_WORDS = (
    "wikisource wikibooks wiktionary gutenberg arxiv pubmed openstax stackoverflow rfc-editor ietf unicode python-docs "
    "readthedocs openlibrary parliament legislation"
).split()


def _word_rules() -> list[UrlRule]:
    tokens = lambda w: re.findall(TOKEN, w)
    host = r"^([^/]*[.-])?{}[.-]"
    made = [pattern_rule(f"host word {w}", BLOCK, host.format(re.escape(w)), *tokens(w)) for w in BLOCKED_HOST_WORDS]
    made += [pattern_rule(f"shop of {w}", BLOCK, rf"/(buy|cheap|free)-{w}(-[a-z0-9-]+)?(\.[a-z]+|/|$)", w) for w in BLOCKED_HOST_WORDS]
    made += [pattern_rule(f"folder {w}", BLOCK, rf"/{re.escape(w)}(/|\.[a-z]+$|$)", *tokens(w)) for w in BLOCKED_FOLDERS]
    return made + [pattern_rule(f"reference {w}", ALLOW, host.format(re.escape(w)), *tokens(w)) for w in ALLOWED_HOST_WORDS]


PATTERN_RULES += _word_rules()

"""URL filters: pattern rules indexed by their rarest literal token. DataFrame operations only.

A rule is a pattern over the canonical url (host, A-Z lower-cased, then the path). Each rule is indexed under one of
its literal tokens, a run of [a-z0-9] that every matching url must hold as a whole token: the one that is rarest among
the urls, counted over all of them. A url's tokens fetch the rules indexed under them, and only those run their regular
expression. A rule without a literal token is fetched by every url.

Pattern syntax: `host/path` fits the host and all its subdomains where the path begins with /path (host rules,
is_host=True); other patterns are literal text in which `*` stands for any run of characters, `^` for one character
outside [a-z0-9] or an end, `|` at an end anchors there.

Defined cases: a null url, or one without `://`, has an empty host and an empty path and no rule; repeated urls get the
same verdict each; an empty table gives an empty result; of several fitting host rules the longest wins, of several
patterns an allowing one wins; columns pass through `judge_urls`, whatever their names, but for those it adds (host, path,
rule, verdict, pattern).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostride.session import materialize, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number are compiled into the plan; more are joined as a table.
INLINE_RULES = 500


@dataclass(frozen=True)
class Rule:
    pattern: str
    action: str
    is_host: bool = False
    regex: str = field(init=False)
    tokens: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        regex, tokens = (host_rule if self.is_host else glob_rule)(self.pattern)
        object.__setattr__(self, "regex", regex)
        object.__setattr__(self, "tokens", tokens)


def _ascii_lower(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def host_rule(pattern: str) -> tuple[str, tuple[str, ...]]:
    """`host/path` as a regular expression over the canonical url, and the tokens that it needs whole."""
    host, _, path = pattern.partition("/")
    host = _ascii_lower(host)
    # the path may go on with more letters after its end, so a token that reaches the end is not whole
    whole = [m[0] for m in re.finditer("[a-z0-9]+", host)] + [m[0] for m in re.finditer("[a-z0-9]+", _ascii_lower("/" + path)) if m.end() < len(path) + 1]
    return rf"^(?:[^/]*\.)?{_quoted(host)}{_quoted('/' + path)}", tuple(dict.fromkeys(whole))


def glob_rule(pattern: str) -> tuple[str, tuple[str, ...]]:
    """A `*`, `^`, `|` pattern as a regular expression over the lower-cased canonical url, and its whole tokens."""
    p = _ascii_lower(pattern)
    start, end = p.startswith("|"), p.endswith("|") and len(p) > 1
    body = p[start : len(p) - end]
    regex = ("^" if start else "") + "".join(".*" if c == "*" else "(?:[^a-z0-9]|$|^)" if c == "^" else _quoted(c) for c in body) + ("$" if end else "")
    whole = []
    for m in re.finditer("[a-z0-9]+", body):
        left = start if m.start() == 0 else body[m.start() - 1] != "*"
        right = end if m.end() == len(body) else body[m.end()] != "*"
        if left and right:
            whole.append(m[0])
    return "(?s)" + regex, tuple(dict.fromkeys(whole))


def _quoted(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_])", r"\\\1", s) if s.isascii() else re.sub(r"([\x00-\x2E\x3A-\x40\x5B-\x5E\x60\x7B-\x7F])", r"\\\1", s)


HOST_RULES = (
    Rule("org/", "allow", True), Rule("example.org/es/", "block", True), Rule("example.org/en/1", "block", True),
    Rule("com/fr/", "allow", True), Rule("com/de/", "block", True),
)
#: What the pattern rules block: hosts that sell wagers, drugs and the like, and paths that only track or log in.
PATTERN_RULES = tuple(Rule(p, a) for p, a in (
    ("^casino^", "block"), ("^casino-win^", "block"), ("^free-bets^", "block"), ("^bets^", "block"), ("^poker^", "block"), ("^cheap-pills^", "block"), ("^pills^", "block"),
    ("^viagra^", "block"), ("^payday-loans^", "block"), ("^xxx^", "block"), ("^porn^", "block"), ("^adult-cams^", "block"), ("/wp-login.php", "block"), ("/cgi-bin/", "block"),
    ("/ads/*/track^", "block"), ("/responsible-gambling^", "allow"), ("^addiction-help^", "allow"),
))


def canonical(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path then up to `?`, `#` or the end."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def url_tokens(canon: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(canon, UPPER, LOWER), F.lit("([a-z0-9]+)"), F.lit(1)))


def token_counts(urls: DataFrame, canon: Column, wanted: set[str]) -> dict[str, int]:
    """How many of all urls hold each token of the rules. The result has one entry for each token of the rules at most."""
    if not wanted:
        return {}
    held = urls.select(F.explode(F.filter(url_tokens(canon), lambda t: t.isin(*sorted(wanted)))).alias("token"))
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}


def index_rules(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Token -> numbers of the rules indexed under it; '' holds those without a token."""
    index: dict[str, list[int]] = {}
    for k, rule in enumerate(rules):
        index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(k)
    return index


def _rule_struct(rule: Rule) -> Column:
    return F.struct(F.lit(rule.regex).alias("regex"), F.lit(rule.pattern).alias("rule"), F.lit(rule.action).alias("action"), F.lit(rule.is_host).alias("is_host"))


def judge_urls(urls: DataFrame, url: str = "url", rules: Sequence[Rule] = (*HOST_RULES, *PATTERN_RULES), default: str = "allow") -> DataFrame:
    """Adds host, path, rule (the longest fitting host rule, else null), verdict and pattern (the rule that decided)."""
    host, path = canonical(F.col(url))
    canon = F.concat(host, path)
    counts = token_counts(urls, canon, {t for r in rules for t in r.tokens})
    index = index_rules(rules, counts)
    # a row's own columns travel in a struct, so that their names meet none of this operator's
    own = F.struct(*(F.col(f"`{c}`") for c in urls.columns)).alias("_row")
    rows = urls.select(own, host.alias("_host"), path.alias("_path")).withColumn("_canon", F.concat("_host", "_path"))
    if len(rules) <= INLINE_RULES:
        rows = rows.withColumn("_fits", _fits_inline(F.col("_canon"), rules, index))
    else:
        rows = _fits_joined(rows, rules, index)
    added = ("host", "path", "rule", "verdict", "pattern")
    return _decide(rows, default).select(*(f"_row.`{c}`" for c in urls.columns if c not in added), *added)


def _fits_inline(canon: Column, rules: Sequence[Rule], index: dict[str, list[int]]) -> Column:
    """The fitting rules of a url without any exchange: the index is part of the plan, its size that of the given rules."""
    empty = F.array().cast("array<struct<regex:string,rule:string,action:string,is_host:boolean>>")
    keyed = {t: F.array(*(_rule_struct(rules[k]) for k in ks)) for t, ks in index.items() if t}
    fetched = empty
    if keyed:
        # the index as a chain of lookups on the url's tokens; a url without any indexed token fetches nothing
        table_ = F.map_from_arrays(F.array(*map(F.lit, keyed)), F.array(*keyed.values()))
        known = F.array_intersect(url_tokens(canon), F.array(*map(F.lit, keyed)))
        fetched = F.flatten(F.transform(known, lambda t: F.element_at(table_, t)))
    if "" in index:
        fetched = F.concat(fetched, F.array(*(_rule_struct(rules[k]) for k in index[""])))
    lowered = F.translate(canon, UPPER, LOWER)
    return F.filter(fetched, lambda r: F.when(r["is_host"], F.call_function("rlike", canon, r["regex"])).otherwise(F.call_function("rlike", lowered, r["regex"])))


def _fits_joined(rows: DataFrame, rules: Sequence[Rule], index: dict[str, list[int]]) -> DataFrame:
    """For long rule lists: the distinct urls' tokens fetch rules by a join, then the verdicts return to the rows."""
    spark = rows.sparkSession
    listed = [(t, rules[k].regex, rules[k].pattern, rules[k].action, rules[k].is_host) for t, ks in index.items() for k in ks]
    # written, so that Spark knows its size: under the session's threshold it is broadcast and no url's token is dealt out
    indexed = materialize(spark.createDataFrame(listed, "token string, regex string, rule string, action string, is_host boolean"), "url-rules")
    urls = rows.select("_canon").distinct()
    tokens = url_tokens(F.col("_canon"))
    pairs = urls.select("_canon", F.explode(F.concat(tokens, F.array(F.lit(""))) if "" in index else tokens).alias("token")).join(indexed, "token")
    fits = pairs.filter(F.when(F.col("is_host"), F.call_function("rlike", F.col("_canon"), F.col("regex"))).otherwise(F.call_function("rlike", F.translate("_canon", UPPER, LOWER), F.col("regex"))))
    fits = fits.groupBy("_canon").agg(F.collect_list(F.struct("regex", "rule", "action", "is_host")).alias("_fits"))
    return rows.join(fits, "_canon", "left")


def _decide(rows: DataFrame, default: str) -> DataFrame:
    key = lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["action"].alias("action"))
    best = F.array_max(F.transform(F.filter("_fits", lambda r: r["is_host"]), key))
    # 'allow' sorts before 'block': the least is an allowing pattern if there is one
    other = F.array_min(F.transform(F.filter("_fits", lambda r: ~r["is_host"]), lambda r: F.struct(r["action"].alias("action"), r["rule"].alias("rule"))))
    rows = rows.withColumn("_best", best).withColumn("_other", other)
    judged = rows.withColumn("host", F.col("_host")).withColumn("path", F.col("_path")).withColumn("rule", F.col("_best.rule"))
    return judged.withColumn("verdict", F.coalesce("_best.action", "_other.action", F.lit(default))).withColumn("pattern", F.coalesce("_best.rule", "_other.rule"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    """DuckDB: every rule against every url, no index."""
    fit = lambda r: "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')".format(h=r.pattern.partition("/")[0], p=r.pattern.partition("/")[2])
    ordered = sorted(HOST_RULES, key=lambda r: (-len(r.pattern), r.pattern))
    rule = "CASE " + " ".join(f"WHEN {fit(r)} THEN '{r.pattern}'" for r in ordered) + " END"
    action = "CASE " + " ".join(f"WHEN {fit(r)} THEN '{r.action}'" for r in ordered) + " END"
    bad = lambda a: " OR ".join(f"regexp_matches(low, '{r.regex}')" for r in PATTERN_RULES if r.action == a)
    return rf"""
WITH parts AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path FROM parts),
c AS (SELECT *, translate(host || path, '{UPPER}', '{LOWER}') AS low FROM hp)
SELECT page_id, coalesce(host, '') AS host, path, {rule} AS rule,
       coalesce({action}, CASE WHEN {bad('allow')} THEN 'allow' WHEN {bad('block')} THEN 'block' ELSE 'allow' END) AS verdict
FROM c
"""


ORACLE_SQL = _oracle()

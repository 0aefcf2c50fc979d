"""URL filters with DataFrame functions only.

Rules are patterns. Each is indexed by its rarest literal token, so that a URL's
tokens fetch the few rules that can match and only those run their regular
expression. Of the rules that match, the longest decides.

The rule set goes into the plan as constants if it has at most `inline_rules`
rules, which is a bound known when the plan is made; then nothing is shuffled. A
larger set stays a table that URL tokens are joined with.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Literals that go into a plan as constants, at most.
LITERALS = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """name: what is reported; verdict: allow or block; pattern: on host and path joined; literals: tokens of all that match.

    listed: whether the name is reported as a rule; others are of the method's own.
    """

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    listed: bool = True


def site_rule(name: str, verdict: str) -> Rule:
    """A rule for a host, its subdomains and the paths that begin as the rule's: `host/path`."""
    host, slash, path = name.partition("/")
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}"
    # the last token may go on in the URL if the rule's path breaks off inside it
    whole = re.sub(r"[0-9a-z]+$", "", name.lower()) if path else name.lower()
    return Rule(name, verdict, pattern, tuple(t for t in re.split(r"[^0-9a-z]+", whole) if t))


def word_rule(word: str) -> Rule:
    """Blocks URLs with a label or path part that holds this word as a token."""
    return Rule(f"*{word}*", "block", rf"(?:^|[^0-9A-Za-z]){re.escape(word)}(?:[^0-9A-Za-z]|$)", (word,), listed=False)


def read_rules(lines: Iterable[str]) -> list[Rule]:
    """Rules of a filter list, one a line; comments (`!`) and blank lines are passed over.

    `||host/path` fits a host, its subdomains and what follows; `|` at either end is the
    begin or end of host and path; `*` stands for anything, `^` for one separator or
    the end; a line without `||` or `|` fits anywhere. `@@` before a rule allows. Letters
    match in either case. As of all rules, the longest one that fits decides. A rule
    without a whole token, one that its neighbours keep from going on, can't be indexed
    and is an error.
    """
    out = []
    for line in lines:
        text = line.strip()
        if not text or text.startswith("!"):
            continue
        verdict, body = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
        begin, body = ("host", body[2:]) if body.startswith("||") else ("start", body[1:]) if body.startswith("|") else ("", body)
        end, body = (True, body[:-1]) if body.endswith("|") else (False, body)
        parts = re.split(r"([*^])", body)
        regex = "".join({"*": ".*", "^": "(?:[^0-9A-Za-z._%-]|$)"}.get(p, re.escape(p)) for p in parts)
        regex = {"host": r"^(?:[^/]*\.)?", "start": "^", "": ""}[begin] + regex + ("$" if end else "")
        # tokens that end inside the rule; at its open ends, and beside `*`, they may go on in the URL
        marked = ("" if begin else "*") + body.lower() + ("" if end else "*")
        literals = tuple(t for t in re.findall(r"(?<![0-9a-z*])[0-9a-z]+(?![0-9a-z*])", marked))
        if not literals:
            raise ValueError(f"a rule needs a literal token: {text}")
        out.append(Rule(text, verdict, "(?i)" + regex, literals))
    return out


#: Rules of the method itself, for URLs that no listed rule fits.
OWN_RULES = tuple(word_rule(w) for w in ("spam", "casino", "porn", "xxx", "viagra", "malware", "phishing", "torrent", "warez", "adserver"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path, both empty for null or a URL without `://`.

    The host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z
    lower-cased; the path then goes up to `?`, `#` or the end.
    """
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format(f"`{_URL}`"))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


_URL = "__url"


def tokens(target: Column) -> Column:
    """Distinct literal tokens of host and path, in lower case."""
    return F.array_distinct(F.filter(F.split(lower_ascii(target), r"[^0-9a-z]+"), lambda t: t != ""))


def index_rules(rules: list[Rule], frequency: dict[str, int] | None = None) -> dict[str, list[int]]:
    """Rule numbers by their rarest token; `frequency` counts URLs with a token, else rules do."""
    counts = frequency if frequency is not None else Counter(t for r in rules for t in set(r.literals))
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        if not r.literals:
            raise ValueError(f"a rule needs a literal token: {r.name}")
        index.setdefault(min(r.literals, key=lambda t: (counts.get(t, 0), t)), []).append(i)
    return index


def token_frequency(urls: DataFrame, rules: list[Rule], url_col: str = "url") -> dict[str, int]:
    """URLs that hold each literal of the rules; at most one count for each literal."""
    literals = sorted({t for r in rules for t in r.literals})
    host, path = split_url(F.col(_URL))
    rows = urls.select(F.col(url_col).cast("string").alias(_URL)).select(F.concat(host, path).alias("target"))
    if not literals:
        return {}
    if len(literals) <= LITERALS:  # only they are counted, in the tasks that read the URLs
        own = F.array_intersect(tokens(F.col("target")), F.array(*map(F.lit, literals)))
        found = rows.select(F.explode(own).alias("t"))
    else:
        wanted = urls.sparkSession.createDataFrame([(t,) for t in literals], "t string")
        found = rows.select(F.explode(tokens(F.col("target"))).alias("t")).groupBy("t").agg(F.count("*").alias("count")).join(wanted, "t")
        return {r["t"]: r["count"] for r in found.collect()}
    return {r["t"]: r["count"] for r in found.groupBy("t").count().collect()}


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    own_rules: list[Rule] | tuple[Rule, ...] = OWN_RULES,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    inline_rules: int = 1000,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    The longest listed rule that fits gives rule and verdict; equal lengths go to
    the smaller name. Where none fits, rule is null and the verdict is that of the
    method's own rules, or `default`. Null and malformed URLs have empty host and
    path and get the default. Repeated rows are judged as often as they stand; null
    ids stay null; an empty table gives no rows; other columns don't matter; a URL of
    any length is used as a whole. Up to `inline_rules` rules are constants of the plan,
    and nothing is shuffled; more are a table that tokens are joined with. Both give
    the same result.
    """
    every = [*rules, *own_rules]
    host, path = split_url(F.col(_URL))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias(_URL))
    urls = urls.select("page_id", host.alias("host"), path.alias("path"))
    index = index_rules(every, token_frequency(pages, every, url_col) if every else None)
    target = F.concat("host", "path")
    if len(every) <= inline_rules:
        found = _inline(urls.withColumn("target", target), every, index)
    else:
        found = _joined(urls.withColumn("target", target), every, index)
    best = F.col("best")
    listed = F.coalesce(best["listed"], F.lit(False))
    return found.select("page_id", "host", "path", F.when(listed, best["name"]).alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))


def _rank(name: Column, listed: Column) -> Column:
    """Order of rules that match: listed ones first, then longer, then smaller names."""
    return F.struct((~listed).alias("other"), (-F.length(name)).alias("shorter"), name.alias("name"))


def _inline(urls: DataFrame, rules: list[Rule], index: dict[str, list[int]]) -> DataFrame:
    kind = "struct<rank:struct<other:boolean,shorter:int,name:string>,name:string,verdict:string,listed:boolean>"
    if not rules:
        return urls.withColumn("best", F.lit(None).cast(kind))
    fields = [F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"), F.lit(r.listed).alias("listed")) for r in rules]
    table = F.array(*fields)
    by_token = F.create_map(*(x for t, ids in index.items() for x in (F.lit(t), F.array(*map(F.lit, ids)))))
    candidates = F.flatten(F.transform(tokens(F.col("target")), lambda t: F.coalesce(by_token[t], F.array().cast("array<int>"))))
    rows = urls.withColumn("candidates", F.transform(candidates, lambda i: F.get(table, i)))
    matching = F.filter("candidates", lambda r: F.regexp_like("target", r["pattern"]))
    ranked = F.transform(matching, lambda r: F.struct(_rank(r["name"], r["listed"]).alias("rank"), r["name"].alias("name"), r["verdict"].alias("verdict"), r["listed"].alias("listed")))
    return rows.withColumn("best", F.array_min(ranked))


def _joined(urls: DataFrame, rules: list[Rule], index: dict[str, list[int]]) -> DataFrame:
    where = {i: t for t, ids in index.items() for i in ids}
    table = urls.sparkSession.createDataFrame([(where[i], r.name, r.verdict, r.pattern, r.listed) for i, r in enumerate(rules)], "token string, name string, verdict string, pattern string, listed boolean")
    asked = urls.select("target").distinct()
    pairs = asked.select("target", F.explode(tokens(F.col("target"))).alias("token")).join(table, "token").where(F.regexp_like("target", F.col("pattern")))
    rank = _rank(F.col("name"), F.col("listed"))
    best = pairs.groupBy("target").agg(F.min(F.struct(rank.alias("rank"), "name", "verdict", "listed")).alias("best"))
    return urls.join(best, "target", "left")

"""URL filter: host and path rules, and block decisions that spread over redirect and canonical-link aliases. DataFrame operations only.

A rule is (host, path, verdict). It fits its host and all subdomains if the path starts with the rule's; of the fitting rules the one with
the longest host + path wins. Pages are aliases if connected by edges url -> target, where the target stands in the page's
<link rel="... canonical ..." href=...> or <meta http-equiv="refresh" content="...url=...">, in any number of such tags, resolved against the page's <base href=...> or URL. Comments, scripts,
styles and other raw text hold no tags, attributes are read by their whole names, and the first of equal ones counts. A page without a rule is blocked if a page or target of its
component is blocked by a rule; a page's own allow rule takes precedence over whatever its aliases have.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .graph import components

#: The rules of the contract, as (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; null or no :// gives the empty string."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _AZ, _az)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, as text like net/es/; nulls if none fits. Ties go to allow."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _let(value: Column, use) -> Column:
    """use(value) with value written once in the plan, however often use has it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def decoded(text: Column) -> Column:
    """Character references (named ones of HTML 5 and numeric ones, with their semicolon) replaced in one pass; numbers of no character give U+FFFD."""
    named = F.from_json(F.lit(json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")})), "map<string,string>")

    def put(p, name):
        digits = F.regexp_extract(name, r"^#[xX]?(.*)$", 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(digits, 16, 10)).when(name.startswith("#"), digits).cast("long")
        code = _let(code, lambda c: F.when(c.between(1, 0xD7FF) | c.between(0xE000, 0x10FFFF), c).when(c.isNotNull(), 0xFFFD))
        char = F.coalesce(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"), F.try_element_at(named, name))
        return _let(char, lambda c: F.when((name == "") | c.isNull(), p).otherwise(F.concat(c, F.substr(p, F.length(name) + F.lit(3)))))

    one = lambda p: _let(F.regexp_extract(p, r"^&(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]*);", 1), lambda name: put(p, name))
    return F.when(text.contains("&"), F.array_join(F.transform(F.split(text, "(?=&)"), one), "")).otherwise(text)


def _no_dots(path: Column) -> Column:
    """A path that starts with / without its . and .. segments."""
    parts = F.split(path, "/")
    step = lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    left = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), step)
    last = F.element_at(parts, -1).isin(".", "..")
    whole = lambda x: F.concat(F.lit("/"), F.array_join(x, "/"), F.when(last & (F.size(x) > 0), "/").otherwise(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), _let(left, whole)).when(path == "", "/").otherwise(path)


def node_of(url: Column) -> Column:
    """The URL as a node: scheme and host with A-Z lower-cased, no dot segments, / for an empty path, no fragment."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), _AZ, _az)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host_of(url), _let(path_of(url), _no_dots), query)).otherwise(F.regexp_replace(url, "(?s)#.*$", ""))


def resolved(url: Column, target: Column) -> Column:
    """The target of a page's link: absolute, or against the page's scheme, host, folder or path; null for an empty one, a mere fragment or no page (mailto:)."""
    site, page = (F.regexp_extract(url, p, 0) for p in (r"(?s)^.*?://[^/?#]*", r"(?s)^.*?://[^?#]*"))
    folder = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*/)?", 1)
    folder = F.when(folder == "", "/").otherwise(folder)

    def full(t):
        x = F.when(t == "", None).when(t.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), t).when(t.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), None)
        x = x.when(t.startswith("//"), F.concat(F.regexp_extract(url, "(?s)^(.*?:)//", 1), t)).when(t.startswith("/"), F.concat(site, t))
        return x.when(t.startswith("?"), F.concat(page, t)).otherwise(F.concat(site, folder, t))

    return _let(F.regexp_replace(target, "(?s)#.*$", ""), full)


#: What a page consists of besides text: comments, elements whose content is no markup, tags. A > ends a tag unless it stands in a quoted value (one of the first 200: deeper loops could exhaust the stack).
_MARKUP = (
    r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|<(script|style|title|textarea|xmp|iframe|noembed|noframes)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\z)"
    r"|<[a-z/!?][^>=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')?+[^>=]*+){0,200}+[^>]*+>"
)
#: An attribute, each directly behind the one before: the matches end where the tag does.
_ATTRIBUTE = r"(?s)\G[\s/]*+([^\s=>/][^\s=>/]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+"


def _attribute(tag: Column, name: str) -> Column:
    """The value of the first attribute of that name of a tag without its <name, null if there is none."""
    names, values = (F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(k)) for k in (1, 2))
    own = F.filter(F.zip_with(names, values, lambda n, v: F.struct(F.lower(n).alias("n"), v.alias("v"))), lambda x: x["n"] == name)
    return F.regexp_replace(F.get(own, F.lit(0))["v"], r"(?s)^[\"']?\s*(.*?)\s*[\"']?$", "$1")


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): nodes of url and of what the page's HTML declares as its canonical or redirect targets, by all such tags."""
    html = F.coalesce(F.col("html"), F.lit(""))
    some = F.lower(html).rlike("canonical|refresh")
    tags = F.filter(F.regexp_extract_all(html, F.lit(_MARKUP), F.lit(0)), lambda x: x.rlike(r"(?i)^<(link|meta|base)[\s/>]"))
    # staged twice, as the optimizer would put each step into every condition on its result
    p = stage(pages.where(some & F.col("url").contains("://")).select("url", tags.alias("tags")).where("size(tags) > 0"))

    def target(tag):
        kind, rest = F.lower(F.regexp_extract(tag, r"^<([A-Za-z]+)", 1)), F.regexp_replace(tag, r"^<[A-Za-z]+", "")
        link = F.when(F.array_contains(F.split(F.lower(_attribute(rest, "rel")), r"\s+"), "canonical"), _attribute(rest, "href"))
        goes = F.regexp_extract(_attribute(rest, "content"), r"(?is)^(?:[0-9.]*\s*[;,]?\s*url\s*=|[0-9.]+\s*[;,])\s*(?:\"([^\"]*)|'([^']*)|([^\"'].*))", 0)
        goes = F.regexp_replace(goes, r"(?is)^[0-9.]*\s*[;,]?\s*(?:url\s*=)?\s*[\"']?\s*|\s+$", "")
        return F.when(kind == "link", link).when((kind == "meta") & (F.lower(_attribute(rest, "http-equiv")) == "refresh"), goes)

    bases = F.filter(F.transform(F.filter("tags", lambda x: x.rlike("(?i)^<base")), lambda x: _attribute(F.regexp_replace(x, r"^<[A-Za-z]+", ""), "href")), lambda x: x.isNotNull())
    e = p.select("url", decoded(F.get(bases, F.lit(0))).alias("base"), F.explode(F.transform("tags", target)).alias("t")).where("t != ''")
    e = stage(e.select("url", "base", decoded(F.col("t")).alias("t")))
    e = stage(e.select("url", F.coalesce(resolved(F.col("url"), F.col("base")), F.col("url")).alias("base"), "t"))
    e = e.select("url", resolved(F.col("base"), F.col("t")).alias("t")).where("t is not null")
    return stage(e.select(node_of(F.col("url")).alias("a"), node_of(F.col("t")).alias("b")))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, component.

    component is the smallest URL (as node_of writes it) of the alias group, null if the page has no alias. Null url or html is taken as empty; repeated rows are each
    judged; a URL without :// has no host, fits no rule and is allowed. Other columns are not read.
    """
    p = pages.select("page_id", "url", "html")
    groups = stage(components(alias_edges(p)))
    hit = groups.select("component", rule_for(host_of(F.col("node")), path_of(F.col("node")), rules)[1].alias("v"))
    blocked = hit.where("v = 'block'").select("component").distinct().select("component", F.lit(True).alias("spread"))
    state = groups.join(blocked, "component", "left").select(F.col("node").alias("bare"), "component", "spread")
    base = p.select("page_id", node_of(F.col("url")).alias("bare"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, own = rule_for(F.col("host"), F.col("path"), rules)
    out = base.join(state, "bare", "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(own, F.when(F.col("spread"), "block"), F.lit("allow")).alias("verdict"), "component")

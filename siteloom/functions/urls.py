"""URL functions as Column expressions; lists of scopes, globs and rules are given on the driver and become literals or tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Address prefixes that are left out by default.
DEFAULT_EXCLUDED = (
    "https://social-plugins.line.me",
    "https://access.line.me",
    "https://lineit.line.me",
    "https://line.me",
    "https://plus.google.com",
    "https://twitter.com",
    "https://x.com",
    "https://www.facebook.com/share.php",
    "https://www.facebook.com/share/",
    "https://www.facebook.com/sharer/",
    "https://www.facebook.com/share_channel/",
    "https://www.google.com",
)


def without_hash(u: Column) -> Column:
    return F.regexp_replace(u, "#.*$", "")


def without_hash_and_auth(u: Column) -> Column:
    return F.regexp_replace(without_hash(u), "^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1")


def protocol_key(u: Column) -> Column:
    """Equal for http and https."""
    return F.regexp_replace(u, "^https?:", "")


def host(u: Column) -> Column:
    return F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)


def port(u: Column) -> Column:
    return F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]+:([0-9]+)", 1)


def pathname(u: Column) -> Column:
    path = F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def query(u: Column) -> Column:
    return F.regexp_extract(u, "^[^?#]*[?]([^#]*)", 1)


def paths(u: Column) -> Column:
    return F.split(F.substring(pathname(u), 2, 1_000_000_000), "/")


def depth(u: Column) -> Column:
    return F.size(paths(u))


def is_index(u: Column) -> Column:
    last = F.element_at(paths(u), -1)
    return (last == "") | last.rlike("^index[.]")


def dirname(u: Column) -> Column:
    p = paths(u)
    return F.concat(F.lit("/"), F.array_join(F.slice(p, 1, F.size(p) - 1), "/"))


def parts(u: Column) -> Column:
    """The parsed address as a struct."""
    return F.struct(
        without_hash(u).alias("withoutHash"), without_hash_and_auth(u).alias("withoutHashAndAuth"), F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1).alias("protocol"),
        host(u).alias("hostname"), port(u).alias("port"), pathname(u).alias("pathname"), paths(u).alias("paths"), depth(u).alias("depth"),
        dirname(u).alias("dirname"), F.element_at(paths(u), -1).alias("basename"), is_index(u).alias("isIndex"), query(u).alias("query"),
        F.regexp_extract(u, "(#.*)$", 1).alias("hash"), u.rlike("^https?:").alias("isHTTP"),
    )


def normalized(u: Column, disable_queries: bool = False) -> Column:
    """Session ids go, repeated slashes are one, and on demand all queries."""
    out = F.regexp_replace(u, "([?&])PHPSESSID=[^&#]*&?", "$1")
    out = F.regexp_replace(F.regexp_replace(out, "[?&](#|$)", "$1"), "([^:/])/{2,}", "$1/")
    return F.regexp_replace(out, "[?][^#]*", "") if disable_queries else out


def decomposed(u: Column) -> Column:
    """Host with port, path segments and query pairs by key, equal keys in their order; null unless it begins with // or http(s)://."""
    rest = F.regexp_extract(u, "^(?:https?:)?//([^#]*)", 1)
    tail = F.regexp_extract(rest, "^[^/?]*/?([^?]*)", 1)
    pairs = F.filter(F.split(F.regexp_extract(rest, "[?](.*)$", 1), "&"), lambda x: x != "")
    keyed = F.transform(pairs, lambda x, i: F.struct(F.regexp_extract(x, "^([^=]*)", 1).alias("key"), i.alias("i"), F.regexp_extract(x, "^[^=]*=(.*)$", 1).alias("value")))
    ordered = F.array_sort(keyed)
    return F.when(
        u.rlike("^(https?:)?//"),
        F.struct(
            F.regexp_extract(u, "^(https?:)", 1).alias("protocol"),
            F.regexp_extract(rest, "^([^/?]*)", 1).alias("host"),
            F.when(tail == "", F.array().cast("array<string>")).otherwise(F.split(tail, "/")).alias("pathSegments"),
            F.transform(ordered, lambda x: x["key"]).alias("queryKeys"),
            F.transform(ordered, lambda x: x["value"]).alias("queryValues"),
        ),
    )


def encode_component(value: Column) -> Column:
    """As browsers encode a component: blank as %20, and !'()*~ as they are."""
    out = F.regexp_replace(F.url_encode(value), "[+]", "%20")
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def reconstructed(d: Column, index: Column, value: Column) -> Column:
    """The address with token `index` replaced; tokens are path segments first, then query values by key."""
    n = F.size(d["pathSegments"])
    segments = F.transform(d["pathSegments"], lambda x, i: F.when(i == index, value).otherwise(x))
    values = F.transform(d["queryValues"], lambda x, i: F.when(i + n == index, value).otherwise(x))
    pairs = F.zip_with(d["queryKeys"], values, lambda k, v: F.concat(encode_component(k), F.lit("="), encode_component(v)))
    tail = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    return F.concat(d["protocol"], F.lit("//"), d["host"], F.lit("/"), F.array_join(segments, "/"), tail)


def decode_safely(segment: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment)


def is_lower_layer(u: Column, base: str) -> Column:
    """Same host, and the base's path segments begin the target's; an empty last one of the base does not count."""
    m = re.match(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?/?([^?#]*)", base, re.I)
    segments = m[2].split("/") if m else []
    if segments and segments[-1] == "":
        segments.pop()
    same = host(u) == (m[1] if m else "")
    for k, s in enumerate(segments, 1):
        same = same & F.coalesce(F.get(paths(u), F.lit(k - 1)) == s, F.lit(False))
    return same


def in_any_lower_layer(u: Column, scopes: list[str]) -> Column:
    out = F.lit(False)
    for s in scopes:
        out = out | is_lower_layer(u, s)
    return out


def best_scope(rows: DataFrame, scopes: DataFrame, key: str = "url") -> DataFrame:
    """rows with `scope`: the deepest scope of the same host that begins the path; the earlier of equals; else null.

    scopes has (pos, scope). The join is by host, so Catalyst may broadcast the scope table when it is small.
    """
    s = scopes.select(F.col("pos").alias("__pos"), F.col("scope").alias("__scope"))
    s = s.withColumns({"__host": host(F.col("__scope")), "__paths": F.filter(paths(F.col("__scope")), lambda x: x != "")})
    hits = rows.select(key).distinct().withColumn("__host", host(F.col(key))).join(s, "__host")
    begins = F.slice(paths(F.col(key)), F.lit(1), F.greatest(F.size("__paths"), F.lit(1))) == F.col("__paths")
    hits = hits.filter((F.size("__paths") == 0) | begins)
    w = Window.partitionBy(key).orderBy(F.size("__paths").desc(), "__pos")
    best = hits.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(key, F.col("__scope").alias("scope"))
    return rows.join(best, key, "left")


def is_external(u: Column, hosts: list[str]) -> Column:
    return ~host(u).isin(hosts)


def with_auth(u: Column, user: Column, password: Column) -> Column:
    """The address with user data; without a user it loses any."""
    bare = F.regexp_replace(u, "^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1")
    auth = F.concat(user, F.coalesce(F.concat(F.lit(":"), password), F.lit("")), F.lit("@"))
    return F.when(user.isNull(), bare).otherwise(F.concat(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*://)", 1), auth, F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://(.*)$", 1)))


def with_scope_auth(rows: DataFrame, scopes: DataFrame, key: str = "url") -> DataFrame:
    """rows with `address`: key with the user data of its best scope, none if that has none; without a scope as it is."""
    found = best_scope(rows, scopes, key)
    part = lambda n: F.nullif(F.regexp_extract("scope", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@:]*)(?::([^/?#@]*))?@", n), F.lit(""))
    return found.withColumn("address", F.when(F.col("scope").isNull(), F.col(key)).otherwise(with_auth(F.col(key), part(1), part(2)))).drop("scope")


def glob_regex(glob: str) -> str:
    """A glob on the path: * and ** match anything, ? one character, {a,b} either."""
    out = ""
    depth_ = 0
    for token in re.findall(r"\*+|.", glob):
        if token[0] == "*":
            out += ".*"
        elif token == "?":
            out += "[^/]"
        elif token == "{":
            out, depth_ = out + "(?:", depth_ + 1
        elif token == "}" and depth_:
            out, depth_ = out + ")", depth_ - 1
        elif token == "," and depth_:
            out += "|"
        else:
            out += re.escape(token)
    return f"^{out}$"


def should_skip(u: Column, globs: list[str], prefixes: list[str]) -> Column:
    """A glob matches the path, or a prefix begins the address, http and https being one."""
    out = F.lit(False)
    for g in globs:
        out = out | pathname(u).rlike(glob_regex(g))
    for p in prefixes:
        out = out | protocol_key(u).startswith(re.sub("^https?:", "", p))
    return out


def string_regex(text: str) -> str:
    """/pattern/flags as a Java pattern, any other text as a literal one."""
    m = re.fullmatch(r"/(.*)/([a-z]*)", text, re.S)
    if not m:
        return re.escape(text)
    flags = "".join(f for f in m[2] if f in "ims")
    return f"(?{flags}){m[1]}" if flags else m[1]


def keyword_excluded(html: Column, keywords: list[str]) -> Column:
    out = F.lit(False)
    for k in keywords:
        out = out | html.rlike(string_regex(k))
    return out


def scope_list(text: str | None) -> list[str]:
    return [s.strip() for s in (text or "").split(",") if s.strip()]


def origin(u: Column) -> Column:
    return F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def robots_rules(body: str, agent: str) -> list[tuple[bool, str]]:
    """(allow, pattern) of the group that applies: the agent's own, or else that of *."""
    groups: dict[str, list[tuple[bool, str]]] = {}
    agents: list[str] = []
    fresh = True
    for line in body.splitlines():
        name, _, value = line.split("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            agents = [*agents, value.lower()] if fresh else [value.lower()]
            fresh = True
            groups.setdefault(value.lower(), [])
        elif name in ("allow", "disallow"):
            fresh = False
            for a in agents:
                if value:
                    groups[a].append((name == "allow", value))
    product = agent.split("/")[0].lower()
    return groups.get(product, groups.get("*", []))


def robots_regex(pattern: str) -> str:
    body = re.escape(pattern.removesuffix("$")).replace(r"\*", ".*")
    return f"^{body}" + ("$" if pattern.endswith("$") else "")


def robots_allowed(rows: DataFrame, rules: DataFrame, key: str = "url") -> DataFrame:
    """rows with `allowed`; rules has (origin, allow, pattern, regex). The longest pattern wins, allow on a tie; no rule, or no http, allows."""
    path = F.concat(pathname(F.col(key)), F.when(query(F.col(key)) != "", F.concat(F.lit("?"), query(F.col(key)))).otherwise(""))
    r = rules.select(F.col("origin").alias("__origin"), "allow", "pattern", "regex")
    asked = rows.select(key).distinct().withColumns({"__origin": origin(F.col(key)), "__path": path}).join(r, "__origin").filter(F.expr("__path RLIKE regex"))
    verdict = asked.groupBy(key).agg(F.max_by("allow", F.struct(F.length("pattern"), F.col("allow"))).alias("allowed"))
    http = F.col(key).rlike("^https?:")
    return rows.join(verdict, key, "left").withColumn("allowed", F.when(http, F.coalesce("allowed", F.lit(True))).otherwise(True))


def natural_key(u: Column) -> Column:
    """Sorts by host, then segment by segment, runs of digits by value: each run gets its length, three digits, in front.

    The sign between segments sorts before all others, and an index page is its directory, so it comes first there.
    """
    flat = F.translate(F.regexp_replace(protocol_key(u), "/index[.][^/?#]*", "/"), "/", "\x01")
    flat = F.regexp_replace(flat, "(^|[^0-9])0+([0-9])", "$1$2")
    pieces = F.regexp_extract_all(flat, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(x).cast("string"), 3, "0"), x)).otherwise(x)), "")

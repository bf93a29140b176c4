"""Answers of robots.txt files: a table of rules by distinct file, then the first rule that a URL's path begins with.

No file is parsed by URL: lines of distinct files are rows, entries are found by
windows over the lines of one file, and URLs meet the rules that count for the
agent in one join. Names, order and quoting follow the standard library's parser.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a URL's file are spread over so many keys, as one file may be that of most URLs.
SALTS = 16

LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"
SPACE = r"[\t-\r\x1C-\x20\x85\p{Z}]"
EDGES = rf"^{SPACE}+|{SPACE}+$"
#: Parts after the scheme: authority, path, query, fragment.
PARTS = r"(?s)^(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"

# fixed values: schemes whose last path segment may have parameters; schemes with an authority
WITH_PARAMS = ("", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel")
WITH_AUTHORITY = ("ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services")


def unquoted(x: Column) -> Column:
    """Percent escapes as the characters they stand for; a sign that begins none stays."""
    kept = F.replace(F.regexp_replace(x, r"%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.try_url_decode(kept)


def quoted(x: Column) -> Column:
    """All but letters, digits and ``_.-~/`` as percent escapes of UTF-8."""
    fixed = (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), fixed, F.url_encode(x))


def rejoined(x: Column, whole: bool) -> Column:
    """A URL taken apart and put together again, which drops empty parts; unless whole, from its path on.

    Authorities are cut off without being checked.
    """
    x = F.regexp_replace(F.regexp_replace(x, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(x, r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.when(scheme != "", F.regexp_replace(x, r"(?s)^[^:]*:", "")).otherwise(x)
    part = lambda i: F.regexp_extract(rest, PARTS, i)
    authority, path = F.regexp_replace(part(1), "^//", ""), part(2)
    path = F.when(scheme.isin(*WITH_PARAMS) & path.rlike(r"(?s)^(.*/)?[^/;]*;$"), F.regexp_replace(path, ";$", "")).otherwise(path)
    tail = F.concat(F.when(part(3) != "?", part(3)).otherwise(""), F.when(part(4) != "#", part(4)).otherwise(""))
    doubled = F.when(path.startswith("//"), F.concat(F.lit("//"), path))
    if not whole:
        return F.concat(F.coalesce(doubled, path), tail)
    rooted = F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    bare = F.when(scheme.isin(*WITH_AUTHORITY) & ((path == "") | path.startswith("/")), F.concat(F.lit("//"), path)).otherwise(path)
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(authority != "", F.concat(F.lit("//"), authority, rooted)).otherwise(F.coalesce(doubled, bare)), tail)


def entries(files: DataFrame) -> DataFrame:
    """Lines of the entries of files (file, text): file, entry, place, key, value.

    An entry is a run of user-agent lines and the rules after them; an empty line
    ends it, as does a user-agent line after a rule. Rules before any
    user-agent line, and entries without a rule, belong to nothing.
    """
    lines = files.select("file", F.posexplode(F.split("text", LINE_END)).alias("place", "line"))
    bare = F.regexp_replace(F.regexp_replace("line", "(?s)#.*$", ""), EDGES, "")
    stripped = lambda c: F.regexp_replace(c, EDGES, "")
    lines = lines.withColumn("bare", bare).select(
        "file", "place", (F.col("line") == "").alias("ends"),
        F.when(F.contains("bare", F.lit(":")), F.lower(stripped(F.substring_index("bare", ":", 1)))).alias("key"),
        unquoted(stripped(F.regexp_extract("bare", "(?s)^[^:]*:(.*)$", 1))).alias("value"),
    )
    lines = lines.where(F.col("ends") | F.col("key").isin("user-agent", "disallow", "allow", "crawl-delay", "request-rate"))
    of_file = Window.partitionBy("file").orderBy("place")
    lines = lines.withColumn("block", F.count_if("ends").over(of_file)).where(~F.col("ends"))
    of_block = Window.partitionBy("file", "block").orderBy("place")
    named = F.col("key") == "user-agent"
    starts = named & (F.coalesce(F.lag("key").over(of_block), F.lit("")) != "user-agent")
    lines = lines.withColumn("starts", starts)
    return lines.withColumn("i", F.count_if("starts").over(of_block)).where("i > 0").select("file", F.struct("block", "i").alias("entry"), "place", "key", "value")


def rules(files: DataFrame, agent: str) -> DataFrame:
    """The rules of distinct files (file, text) that count for an agent: file, rules (path, allow) in their order.

    They are those of the first entry that names the agent, else of the first one
    for all agents; a file with neither has no row. Memory is that of a file's rules.
    """
    named, token = F.col("key") == "user-agent", F.lit(agent.split("/")[0].lower())
    rule = F.when(F.col("key").isin("allow", "disallow"), F.struct("place", quoted(rejoined(F.col("value"), True)).alias("path"), ((F.col("key") == "allow") | (F.col("value") == "")).alias("allow")))
    grouped = entries(files).groupBy("file", "entry").agg(
        F.min("place").alias("at"), F.bool_or(named & (F.col("value") == "*")).alias("any"), F.bool_or(named & F.contains(token, F.lower("value"))).alias("own"),
        F.bool_or(~named).alias("ruled"), F.array_sort(F.collect_list(rule)).alias("found"),
    )
    chosen = grouped.where(F.col("ruled") & (F.col("any") | F.col("own"))).groupBy("file").agg(F.min_by("found", F.struct("any", "at")).alias("found"))
    return chosen.select("file", F.transform("found", lambda r: F.struct(r["path"].alias("path"), r["allow"].alias("allow"))).alias("rules"))


def allowed(pairs: DataFrame, agent: str) -> DataFrame:
    """Adds allowed: whether robots text lets the agent fetch the url; without text, url or a rule that fits it may.

    Other columns stay as they are. Files are told apart by SHA-256.
    """
    text, url = F.col("robots").cast("string"), F.col("url").cast("string")
    # rows that need no file get keys of their own, so they don't meet in one task
    key = F.coalesce(F.when((text != "") & url.isNotNull(), F.sha2(text, 256)), F.concat(F.lit("none:"), F.xxhash64(url, F.monotonically_increasing_id()).cast("string")))
    keyed = pairs.withColumns({"_robots_file": key, "_robots_salt": F.pmod(F.xxhash64(url), F.lit(SALTS))})
    files = keyed.where(~F.col("_robots_file").startswith("none:")).groupBy("_robots_file").agg(F.first(text).alias("text"))
    table = rules(files.withColumnRenamed("_robots_file", "file"), agent).withColumn("_robots_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    path = quoted(rejoined(unquoted(url), False))
    path = F.when(path == "", "/").otherwise(path)
    met = keyed.withColumn("_robots_path", path).join(table.withColumnRenamed("file", "_robots_file").withColumnRenamed("rules", "_robots_rules"), ["_robots_file", "_robots_salt"], "left")
    first = F.get(F.filter("_robots_rules", lambda r: (r["path"] == "*") | F.col("_robots_path").startswith(r["path"])), 0)
    return met.select(*(met[c] for c in pairs.columns), F.coalesce(first["allow"], F.lit(True)).alias("allowed"))

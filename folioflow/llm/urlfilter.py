"""URL filters: a trie over reversed host labels and path segments, with longest-match precedence.

An entry is a host, or a host and a path prefix. It covers the host, its subdomains, and paths that begin with its segments.
Of the entries that cover a URL the one with most host labels decides, then the one with most path segments; an entry
listed as both allow and block blocks. URLs that no entry covers are allowed.

Entries are pairs (entry, action), or a DataFrame with these columns, such as a blocklist file. The trie is broadcast when its nodes, at ``NODE_BYTES`` each, take at
most ``BROADCAST_BYTES`` in a worker. Beyond, the URLs' host and path prefixes are joined to the entries by shuffle, with the same precedence; the list never comes to the driver then.

Defined results: the scheme, user, port, query and fragment don't count; hosts are compared in lower case without a trailing dot;
empty path segments don't count; null, empty and host-less URLs match no entry and get action ``none``; rows of the input repeat in
the result; an empty table gives an empty result; an empty list of entries allows every URL with a host; entries that are null or blank are ignored;
columns of the input named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

#: Measured on tries of 10,000 to 300,000 entries; what a worker may hold.
NODE_BYTES, BROADCAST_BYTES = 400, 64 << 20
#: The default list: (entry, action).
ENTRIES = (
    ("spam-farm.example.org", "block"), ("cheap-pills.example.com", "block"), ("www.cheap-pills.example.com/en/about", "allow"),
        ("example.net", "block"), ("tionsh.example.net", "allow"),
    ("tionsh.example.net/es", "block"), ("blog.tionsh.example.net/es/533", "allow"), ("ththan.example.net/en", "allow"),
        ("ththan.example.net/en/960", "block"), ("m.ththth.example.net", "allow"),
    ("example.com/de", "block"), ("ththon.example.com/de", "allow"), ("example.org/fr", "block"),
        ("thther.example.org/fr/414", "allow"), ("blog.example.com", "block"), ("blog.tiontion.example.com/en", "allow"),
    ("ththth.example.com", "allow"), ("ththth.example.com/es", "block"),
)
ADDED = ("host", "path", "action", "entry")


def host_of(url: Column) -> Column:
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(authority, r"^.*@", "")), r":[0-9]*$", ""), r"\.$", "")


def path_of(url: Column) -> Column:
    """The path's segments joined by one slash each, without a slash at either end."""
    raw = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(raw, "/+", "/"), "^/|/$", "")


def _split(entry: str) -> tuple[str, str]:
    host, _, path = entry.strip().partition("/")
    return host.lower().rstrip("."), "/".join(s for s in path.split("/") if s)


def cleaned(entries) -> list[tuple[str, str, str]]:
    """(host, path, action), one row an entry; block wins over allow."""
    out: dict[tuple[str, str], str] = {}
    for entry, action in entries:
        if entry and _split(entry)[0]:
            key = _split(entry)
            out[key] = "block" if "block" in (action, out.get(key)) else action
    return [(h, p, a) for (h, p), a in sorted(out.items())]


def build(entries: list[tuple[str, str, str]]) -> dict:
    """Nodes are dicts; host labels lead to str keys, path segments to ("/", segment), an action is held under ""."""
    root: dict = {}
    for host, path, action in entries:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        for segment in path.split("/") if path else ():
            node = node.setdefault(("/", segment), {})
        node[""] = (action, host + ("/" + path if path else ""))
    return root


def look_up(trie: dict, host: str, path: str) -> tuple[str, str | None]:
    if not host:
        return "none", None
    labels, segments = host.split(".")[::-1], path.split("/") if path else []
    node, chain = trie, []
    for label in labels:
        node = node.get(label)
        if node is None:
            break
        chain.append(node)
    for node in reversed(chain):
        best = node.get("")
        for segment in segments:
            node = node.get(("/", segment))
            if node is None:
                break
            best = node.get("", best)
        if best:
            return best
    return "allow", None


def parsed_entries(entries: DataFrame) -> DataFrame:
    """(host, path, action), one row an entry; block wins over allow."""
    whole = F.trim("entry")
    host = F.regexp_replace(F.lower(F.substring_index(whole, "/", 1)), r"\.+$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(whole, "^[^/]*(/.*)?$", 1), "/+", "/"), "^/|/$", "")
    one = entries.where("entry IS NOT NULL").select(host.alias("host"), path.alias("path"), "action").where("host <> ''")
    return one.groupBy("host", "path").agg(F.when(F.bool_or(F.col("action") == "block"), "block").otherwise(F.max("action")).alias("action"))


def trie_bytes(listed: DataFrame) -> int:
    """An upper bound on the trie of parsed entries: a node for every label and segment."""
    nodes = F.size(F.split("host", r"\.")) + F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    return NODE_BYTES * listed.agg(F.coalesce(F.sum(nodes), F.lit(0))).first()[0]


def verdicts(pages: DataFrame, entries=ENTRIES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with host, path, action and the entry that decided."""
    rest = pages.drop(*ADDED)
    url = F.coalesce("url", F.lit(""))
    parsed = rest.withColumns({"host": host_of(url), "path": path_of(url)})
    if isinstance(entries, DataFrame):
        table = parsed_entries(entries)
        if trie_bytes(table) > broadcast_bytes:
            return joined(parsed, table)
        listed = sorted(tuple(r) for r in table.collect())  # bounded: checked just above
    else:
        listed = cleaned(entries)
        if NODE_BYTES * sum(len(h.split(".")) + (len(p.split("/")) if p else 0) for h, p, _ in listed) > broadcast_bytes:
            return joined(parsed, pages.sparkSession.createDataFrame(listed, "host string, path string, action string"))
    shared = pages.sparkSession.sparkContext.broadcast(build(listed))
    schema = T.StructType([*parsed.schema.fields, T.StructField("action", T.StringType()), T.StructField("entry", T.StringType())])
    names = parsed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            found = [look_up(trie, h, p) for h, p in zip(batch.column(names.index("host")).to_pylist(), batch.column(names.index("path")).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in found], pa.string()),
                    pa.array([e for _, e in found], pa.string())], names=[*names, "action", "entry"])

    return map_arrow(parsed, run, schema)


def joined(parsed: DataFrame, entries: DataFrame) -> DataFrame:
    """The same by shuffle: every (host suffix, path prefix) of a distinct URL, as long as any entry is, is looked up; one row a distinct URL is shuffled, not the pages' content."""
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    most = entries.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)), F.coalesce(F.max(depth), F.lit(0))).first()
    urls = parsed.select("host", "path").distinct().where("host <> ''")
    labels, segments = F.split("host", r"\."), F.split("path", "/", most[1] + 1)  # the rest of a longer path stays in one piece
    n_labels = F.least(F.size(labels), F.lit(max(1, most[0])))
    n_segments = F.least(F.when(F.col("path") == "", 0).otherwise(F.size(segments)), F.lit(most[1]))
    suffixes = F.transform(F.sequence(F.lit(1), n_labels),
        lambda i: F.struct(i.alias("n_host"), F.array_join(F.slice(labels, F.size(labels) - i + 1, i), ".").alias("h")))
    prefixes = F.transform(F.sequence(F.lit(0), n_segments),
        lambda i: F.struct(i.alias("n_path"), F.array_join(F.slice(segments, F.lit(1), i), "/").alias("p")))
    keys = urls.withColumn("s", F.explode(suffixes)).withColumn("q", F.explode(prefixes)).select("host", "path", "s.*", "q.*")
    e = entries.select(F.col("host").alias("h"), F.col("path").alias("p"), "action")
    top = Window.partitionBy("host", "path").orderBy(F.desc("n_host"), F.desc("n_path"))
    best = keys.join(e, ["h", "p"]).withColumn("rn", F.row_number().over(top)).where("rn = 1").select("host", "path", "action",
        F.concat_ws("/", "h", F.expr("nullif(p, '')")).alias("entry"))
    out = parsed.join(best, ["host", "path"], "left")
    action = F.when(F.col("host") == "", "none").otherwise(F.coalesce("action", F.lit("allow")))
    return out.select(*parsed.columns, action.alias("action"), "entry")


def oracle(entries=ENTRIES) -> str:
    rows = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in cleaned(entries))
    return f"""
WITH u AS (SELECT page_id, url, regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')), ':[0-9]*$', ''), '\\.$', '') AS host,
 regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '^/|/$', '', 'g') AS path FROM pages),
e(h, p, a) AS (VALUES {rows}),
m AS (SELECT u.*, e.*, row_number() OVER (PARTITION BY page_id ORDER BY len(string_split(h, '.')) DESC NULLS LAST, CASE WHEN p = '' THEN 0 ELSE len(string_split(p, '/')) END DESC) AS rn
 FROM u LEFT JOIN e ON (host = h OR ends_with(host, '.' || h)) AND (p = '' OR path = p OR starts_with(path, p || '/')))
SELECT page_id, host, path, CASE WHEN host = '' THEN 'none' ELSE coalesce(a, 'allow') END AS action, CASE WHEN p = '' THEN h ELSE h || '/' || p END AS entry FROM m WHERE rn = 1
"""

"""What a service around the library computes for each request: credentials, identities, names, filters, event text, log lines, model calls with retries."""

from __future__ import annotations

import ipaddress
import random
import time
from collections.abc import Callable
from datetime import datetime
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

STATUSES, SCOPES, DONE = ("new", "processing", "ready", "failed"), ("cleaned", "raw"), ("succeeded", "failed", "canceled")
READS, SEARCHES = ("GET", "HEAD", "OPTIONS"), ("/search", "/search/results", "/search/facets")
LOG_FIELDS = ("request_id", "method", "path", "status_code", "duration_ms", "run_id", "document_id", "stage", "status")


def parse_status(value: str | None) -> str | None:
    if value is not None and value not in STATUSES:
        raise ValueError("Invalid document_status")
    return value


def parse_scope(value: str) -> str:
    if value not in SCOPES:
        raise ValueError("Invalid search scope")
    return value


def parse_moment(value: str | None, name: str = "value") -> datetime | None:
    """An ISO-8601 timestamp, with Z for UTC if it likes."""
    if value is None:
        return None
    try:
        return datetime.fromisoformat(value.removesuffix("Z") + "+00:00" if value.endswith("Z") else value)
    except ValueError:
        raise ValueError(f"{name} must be an ISO-8601 timestamp") from None


def credential(entry: Column) -> Column:
    """struct(key, scope) of ``read:key``, ``write:key`` and synonyms; what has no such prefix is a key of full scope."""
    raw = X.strip(entry)
    prefix, key = F.lower(F.regexp_extract(raw, "^([^:]*):", 1)), X.strip(F.regexp_extract(raw, "(?s)^[^:]*:(.*)$", 1))
    scope = F.when(key == "", None).when(prefix.isin("read", "readonly", "read-only"), "read").when(prefix.isin("write", "admin", "full"), "write")
    return F.struct(F.when(scope.isNotNull(), key).otherwise(raw).alias("key"), F.coalesce(scope, F.lit("write")).alias("scope"))


def supplied_key(api_key: Column, authorization: Column) -> Column:
    """The key header, else the token of a bearer header, else null."""
    scheme, token = F.regexp_extract(authorization, "^([^ ]*) ", 1), X.strip(F.regexp_extract(authorization, "(?s)^[^ ]* (.*)$", 1))
    return F.coalesce(X.blank_to_null(api_key), F.when(F.lower(scheme) == "bearer", X.blank_to_null(token)))


def matched_credential(requests: DataFrame, credentials: DataFrame, key: str = "supplied") -> DataFrame:
    """``requests`` with the scope of their key: credentials (ordinal, key, scope, hashed), of several that match the first. Keys are compared by hash."""
    digest = F.when(F.col("hashed"), F.col("key")).otherwise(F.sha2("key", 256))
    first = credentials.select(digest.alias("_digest"), "scope", "ordinal").groupBy("_digest").agg(F.min_by("scope", "ordinal").alias("scope"))
    return requests.withColumn("_digest", F.sha2(key, 256)).join(first, "_digest", "left").drop("_digest")


def allows(scope: Column, method: Column, path: Column, restricted: tuple[str, ...] = ("/config", "/metrics")) -> Column:
    """May a credential of this scope make the request? Reading may search by POST, and may not see restricted paths."""
    read = ~path.isin(*restricted) & (method.isin(*READS) | ((method == "POST") & path.isin(*SEARCHES)))
    return (scope == "write") | ((scope == "read") & read)


@lru_cache(maxsize=65536)
def _address(text: str | None):
    try:
        return ipaddress.ip_address(text)
    except ValueError:
        return None


def in_networks(host: Column, networks: str) -> Column:
    """Is the address in one of the comma-separated CIDR networks? Names and other texts are in none."""
    parsed = [ipaddress.ip_network(n.strip(), strict=False) for n in networks.split(",") if n.strip()]

    @F.pandas_udf("boolean")
    def run(hosts: pd.Series) -> pd.Series:
        return hosts.map(lambda h: (a := _address(h)) is not None and any(a in n for n in parsed))

    return run(host) if parsed else F.lit(False)


def is_address(text: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _address(t) is not None)

    return run(text)


def client_host(host: Column, forwarded: Column, trusted: str = "") -> Column:
    """The first forwarded address if a trusted proxy says it and it is one, else the peer."""
    first = X.strip(F.split(forwarded, ",")[0])
    return F.when(in_networks(host, trusted) & is_address(first), first).otherwise(F.coalesce(host, F.lit("unknown")))


def rate_limit_identity(key: Column, host: Column) -> Column:
    return F.when(key.isNotNull() & (key != ""), F.concat(F.lit("api-key:"), F.sha2(key, 256))).otherwise(F.concat(F.lit("ip:"), host))


def credential_summary(present: Column, scope: Column) -> Column:
    return F.when(scope.isNotNull() & (scope != ""), F.concat(F.lit("scope="), scope)).when(present, "present").otherwise("")


def event_text(events: DataFrame, runs: DataFrame, records: bool = False) -> DataFrame:
    """(run_id, text): each run's events as server-sent text in order, closed by a done event if the run has ended (or is unknown)."""
    if records:
        fields = [c for c in ("sequence", "run_id", "stage", "message", "created_at") if c in events.columns]
        line = F.concat(F.lit("event: run-event\ndata: "), F.to_json(F.struct(*fields)), F.lit("\n\n"))
    else:
        line = F.concat(F.lit("data: "), "stage", F.lit(": "), "message", F.lit("\n\n"))
    told = events.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("sequence").alias("s"),
                line.alias("l")))), lambda x: x["l"]), "").alias("text"))
    state = runs.select("run_id", F.col("status").alias("_s"))
    ended = F.col("_s").isNull() | F.col("_s").isin(*DONE)
    return told.join(state, "run_id", "left").select("run_id", F.concat("text", F.when(ended, "event: done\ndata: done\n\n").otherwise("")).alias("text"))


def log_line(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``records`` (level, logger, message, timestamp, fields of a request, exception) as JSON lines, secrets redacted, nulls left out; columns ``keep`` stay beside them."""
    fields = [F.col(c) for c in ("level", "logger")] + [X.redact(F.col("message")).alias("message"),
        F.col("timestamp")] + [F.col(c) for c in LOG_FIELDS if c in records.columns]
    if "exception" in records.columns:
        fields.append(X.redact(F.col("exception")).alias("exception"))
    return records.select(*keep, F.to_json(F.struct(*fields)).alias("line"))


def otel_headers(headers: Column) -> Column:
    """The map of ``k=v,k=v``; a part without = or without a name is an error. Blank is empty; of a repeated name the last counts."""
    parts = F.split(headers, ",")
    key, value = lambda p: X.strip(F.substring_index(p, "=", 1)), lambda p: X.strip(F.regexp_extract(p, "(?s)=(.*)$", 1))
    wrong = F.exists(parts, lambda p: ~F.contains(p, F.lit("=")))
    nameless = F.exists(parts, lambda p: key(p) == "")
    last = F.filter(parts, lambda p, i: ~F.exists(F.slice(parts, i + 2, F.greatest(F.size(parts), F.lit(1))), lambda q: key(q) == key(p)))
    made = F.map_from_entries(F.transform(last, lambda p: F.struct(key(p), value(p))))
    empty = F.expr("map()").cast("map<string,string>")
    return F.when(headers.isNull() | (X.strip(headers) == ""), empty).when(wrong,
        F.raise_error(F.lit("OpenTelemetry headers must use key=value pairs")).cast("map<string,string>")).when(nameless,
        F.raise_error(F.lit("OpenTelemetry header names must not be empty")).cast("map<string,string>")).otherwise(made)


def retry_delay(attempt: Column, base: float, most: float) -> Column:
    """Seconds before the next try, without jitter: base doubled each time, up to a maximum."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt), F.lit(float(most)))


def is_retriable(error: Exception) -> bool:
    """Connections, timeouts, rate limits and server errors pass; other answers don't."""
    code = getattr(error, "status_code", None)
    return isinstance(error, (ConnectionError, TimeoutError)) or (isinstance(code, int) and (code == 429 or code >= 500))


def with_retries(call: Callable[[str], str], retries: int = 3, base: float = 0.5, most: float = 8.0,
    sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """``call`` tried again while its errors may pass; the last one is raised with secrets redacted. Runs in the workers."""

    def run(prompt: str) -> str:
        for attempt in range(retries + 1):
            try:
                return call(prompt)
            except Exception as e:
                if not is_retriable(e):
                    raise RuntimeError(f"LLM provider request failed: {X.redact_text(str(e))}") from None
                if attempt == retries:
                    raise RuntimeError(f"LLM provider request failed after retries: {X.redact_text(str(e))}") from None
            delay = min(base * 2**attempt, most)
            sleep(delay + random.uniform(0, delay * 0.1))
        raise AssertionError("unreachable")

    return run


def model_column(call: Callable[[str], str] | None, most_prompt_chars: int = 200_000, **retries) -> Callable[[Column], Column]:
    """A model as a Column function: the deterministic stand-in without a ``call``; a longer prompt is an error before any call. One prompt is asked once a batch."""

    def bounded(prompt: Column) -> Column:
        too_long = F.raise_error(F.concat(F.lit("LLM prompt exceeded configured character limit ("),
                F.length(prompt).cast("string"), F.lit(f" > {most_prompt_chars})"))).cast("string")
        return F.when(F.length(prompt) > most_prompt_chars, too_long).otherwise(prompt)

    if call is None:
        return lambda prompt: X.mock_clean(bounded(prompt))
    robust = with_retries(call, **retries)

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        answers = {p: robust(p) for p in prompts.dropna().unique()}
        return pd.Series([answers.get(p) for p in prompts], dtype=object)

    return lambda prompt: ask(bounded(prompt))


@lru_cache(maxsize=64)
def load_prompt(folder: str, family: str, version: str) -> str:
    """The prompt text of a family and version; read once."""
    from pathlib import Path

    return (Path(folder) / f"{family}_{version}.txt").read_text(encoding="utf-8")

"""Full-text search over an inverted index kept as DataFrames.

A query is parsed on the driver into a small tree: quoted runs are phrases, the other words terms, all required; a
compound joined by hyphens or a slash matches its parts or the joined word. The index holds a row for each term of each document with its
positions; a search reads the rows of its terms only. Scores are BM25 (k1 1.2, b 0.75) as full-text engines with a floor on
the inverse document frequency compute it: lower is better.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import spread

K1, B, MOST_CHARS = 1.2, 0.75, 4096
TOKEN = r"[\p{L}\p{N}]+"
_WORD = re.compile(r"\w+")
_DASHES = "-/‐-―"


@dataclass(frozen=True)
class Leaf:
    """A phrase of one or more tokens."""

    tokens: tuple[str, ...]


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any_:
    parts: tuple


def _leaf(word: str) -> Leaf:
    return Leaf(tuple(re.findall(r"[^\W_]+", word)))


def parse_query(query: str, phrase: bool = False) -> All:
    """The query tree; ValueError for a query that is too long or has no word. What follows an unclosed quote is plain words."""
    if len(query) > MOST_CHARS:
        raise ValueError(f"Search query exceeds configured limit of {MOST_CHARS} characters")
    words_of = lambda s: _WORD.findall(s.casefold())
    if phrase:
        quoted, plain = [query], ""
    else:
        pieces = query.split('"')
        closed = len(pieces) - 1 if len(pieces) % 2 == 0 else len(pieces)
        quoted, plain = pieces[1:closed:2], "".join(pieces[0:closed:2])
        if closed < len(pieces):
            if not plain:
                raise ValueError("Invalid search query")
            plain += pieces[-1]
    parts: list = [Leaf(tuple(t for w in ws for t in _leaf(w).tokens)) for q in quoted if (ws := words_of(q))]
    for run in re.findall(rf"\w+(?:[{_DASHES}]\w+)*", re.sub(r"(?<=\w)['’]s\b", "", plain.casefold())):
        ws = _WORD.findall(run)
        parts.append(_leaf(ws[0]) if len(ws) == 1 else Any_((All(tuple(map(_leaf, ws))), _leaf("".join(ws)))))
    parts = [p for p in parts if not isinstance(p, Leaf) or p.tokens]
    if not parts:
        raise ValueError("Invalid search query")
    return All(tuple(parts))


def render(tree) -> str:
    """The tree as a boolean expression."""
    if isinstance(tree, Leaf):
        return tree.tokens[0] if len(tree.tokens) == 1 else '"' + " ".join(tree.tokens) + '"'
    if isinstance(tree, Any_):
        return "(" + " OR ".join(f"({render(p)})" if isinstance(p, All) else render(p) for p in tree.parts) + ")"
    return " AND ".join(map(render, tree.parts))


def leaves(tree) -> list[Leaf]:
    return [tree] if isinstance(tree, Leaf) else [x for p in tree.parts for x in leaves(p)]


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def terms_of(tree) -> list[str]:
    return sorted({t for leaf in leaves(tree) for t in leaf.tokens})


def _stats(sizes: DataFrame) -> DataFrame:
    """One row: texts and mean tokens."""
    return sizes.agg(F.count(F.lit(1)).alias("N"), F.avg("n_tokens").alias("avgdl"))


#: Tokens whose postings are made at once, at about 100 bytes each; a longer text is taken alone.
SLICE_TOKENS = 1 << 18


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows whose lists, in the last column, hold up to ``most`` values together, one row at least."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0), np.int64))
    at, before = 0, 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, stop - at)
        at, before = stop, ends[stop - 1]


def _term_lists(batches: Iterator[pa.RecordBatch], only: list[str] | None) -> Iterator[pa.RecordBatch]:
    """(key.., term, positions) of texts (key.., tokens): the tokens of a text are in one row, so its postings are made there, without a shuffle and without a loop over tokens."""
    wanted = None if only is None else pa.array(only, pa.string())
    for batch in (part for whole in batches for part in _slices(whole, SLICE_TOKENS)):
        lists = batch.column(batch.num_columns - 1)
        sizes = np.asarray(lists.value_lengths())
        row, flat = np.repeat(np.arange(len(sizes)), sizes), lists.flatten()
        position = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        if wanted is not None:
            hit = np.asarray(pc.is_in(flat, wanted))
            row, position, flat = row[hit], position[hit], flat.filter(pa.array(hit))
        words = flat.dictionary_encode()
        code = np.asarray(words.indices, np.int64)
        order = np.argsort(row * (len(words.dictionary) + 1) + code, kind="stable")  # positions ascend already
        row, code, position = row[order], code[order], position[order]
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])])[: len(row)])
        positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(position.astype(np.int32)))
        keys = [c.take(pa.array(row[first])) for c in batch.columns[:-1]]
        yield pa.RecordBatch.from_arrays([*keys, words.dictionary.take(pa.array(code[first])), positions],
            names=[*batch.schema.names[:-1], "term", "positions"])


class Index:
    """``postings``: key, term, positions; ``sizes``: key, n_tokens. ``key`` are the columns that name an indexed text; they should name one row, postings of a repeated key are taken together."""

    def __init__(self, postings: DataFrame, sizes: DataFrame, key: list[str], stats: DataFrame | None = None):
        self.postings, self.sizes, self.key, self.stats = postings, sizes, key, stats

    @classmethod
    def build(cls, texts: DataFrame, key: list[str], text: str = "text", only: list[str] | None = None) -> Index:
        """Index ``texts``: one scan, no shuffle. With ``only``, just the postings of these terms are made."""
        split = spread(texts.select(*key, text)).select(*key, tokens_of(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
        schema = T.StructType([*split.select(*key).schema.fields, T.StructField("term", T.StringType()),
                T.StructField("positions", T.ArrayType(T.IntegerType()))])
        return cls(split.mapInArrow(lambda batches: _term_lists(batches, only), schema), split.select(*key, F.size("tokens").alias("n_tokens")), key)

    def write(self, path: str, buckets: int = 64) -> None:
        """The one shuffle: postings by term, sorted within hash partitions, so that a search reads few row groups. The size of the index is written beside them."""
        self.postings.repartition(buckets, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.sizes.write.mode("overwrite").parquet(f"{path}/sizes")
        spark = self.postings.sparkSession
        _stats(spark.read.parquet(f"{path}/sizes")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def read(cls, spark, path: str, key: list[str]) -> Index:
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return cls(read("postings"), read("sizes"), key, read("stats"))

    def updated(self, texts: DataFrame, text: str = "text") -> Index:
        """The index after ``texts`` were indexed anew: their old rows are replaced."""
        new, keys = Index.build(texts, self.key, text), texts.select(*self.key).distinct()
        keep = lambda df: df.join(keys, self.key, "left_anti")
        return Index(keep(self.postings).unionByName(new.postings), keep(self.sizes).unionByName(new.sizes), self.key)

    def without(self, keys: DataFrame) -> Index:
        on = keys.columns
        return Index(self.postings.join(keys, on, "left_anti"), self.sizes.join(keys, on, "left_anti"), self.key)

    def matches(self, tree) -> DataFrame:
        """key, f_0.. (occurrences of each leaf) of the texts that satisfy the tree."""
        terms = terms_of(tree)
        at = self.postings.where(F.col("term").isin(*terms)).groupBy(*self.key).agg(*(F.flatten(F.collect_list(F.when(F.col("term") ==
                        t, F.col("positions")))).alias(f"_p{i}") for i, t in enumerate(terms)))
        place = {t: F.coalesce(F.col(f"_p{i}"), F.array().cast("array<int>")) for i, t in enumerate(terms)}

        def count(leaf: Leaf) -> Column:
            first, *rest = leaf.tokens
            if not rest:
                return F.size(place[first])
            follows = lambda p: reduce(lambda a, b: a & b, (F.array_contains(place[t], p + d + 1) for d, t in enumerate(rest)))
            return F.size(F.filter(place[first], follows))

        every = leaves(tree)
        counted = at.select(*self.key, *(count(leaf).alias(f"f_{i}") for i, leaf in enumerate(every)))
        number = iter(range(len(every)))

        def holds(node) -> Column:
            if isinstance(node, Leaf):
                return F.col(f"f_{next(number)}") > 0
            parts = [holds(p) for p in node.parts]
            return reduce((lambda a, b: a | b) if isinstance(node, Any_) else (lambda a, b: a & b), parts)

        return counted.withColumn("_hit", holds(tree))

    def scored(self, tree) -> DataFrame:
        """key, score of the matching texts. Document frequencies count all indexed texts, the matching ones or not."""
        counted, every = self.matches(tree), leaves(tree)
        frequency = counted.agg(*(F.coalesce(F.count_if(F.col(f"f_{i}") > 0), F.lit(0)).alias(f"n_{i}") for i in range(len(every))))
        corpus = _stats(self.sizes) if self.stats is None else self.stats
        stats = F.broadcast(frequency.crossJoin(corpus))  # one row
        joined = counted.where("_hit").join(self.sizes, self.key).crossJoin(stats)
        score = F.lit(0.0)
        for i in range(len(every)):
            n, f = F.col(f"n_{i}"), F.col(f"f_{i}")
            idf = F.log((F.col("N") - n + 0.5) / (n + 0.5))
            idf = F.when(idf > 0, idf).otherwise(1e-6)
            score -= idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n_tokens") / F.col("avgdl")))
        return joined.select(*self.key, score.alias("score"))


def like(c: Column, needle: str, prefix: bool = False) -> Column:
    """Case-insensitive prefix or substring, with ``%``, ``_`` and ``~`` taken as themselves."""
    safe = needle.replace("~", "~~").replace("%", "~%").replace("_", "~_").lower()
    return F.like(F.lower(c), F.lit(safe + "%" if prefix else f"%{safe}%"), F.lit("~"))


@dataclass(frozen=True)
class Filters:
    code: str | None = None
    code_prefix: str | None = None
    status: str | None = None
    filename_contains: str | None = None
    created_after: object = None
    created_before: object = None

    def __post_init__(self):
        ends = (self.created_after, self.created_before)  # values, or Columns, which can't be compared here
        if all(x is not None and not isinstance(x, Column) for x in ends) and ends[0] > ends[1]:
            raise ValueError("created_after must not be later than created_before")

    def apply(self, df: DataFrame) -> DataFrame:
        """Only what is set becomes a predicate, so that it can be pushed down."""
        tests = ((self.code, lambda v: F.col("code") == v), (self.code_prefix, lambda v: like(F.col("code"), v, True)),
            (self.status, lambda v: F.col("status") == v), (self.filename_contains, lambda v: like(F.col("filename"), v)),
            (self.created_after, lambda v: F.col("created_at") >= F.lit(v)),
            (self.created_before, lambda v: F.col("created_at") <= F.lit(v)))
        for value, test in tests:
            if value is not None:
                df = df.where(test(value))
        return df


def latest_outputs(outputs: DataFrame, runs: DataFrame) -> DataFrame:
    """Search's rule: of succeeded runs, the outputs as late as any output of the document; ties all stay."""
    ranked = outputs.withColumn("_r", F.rank().over(Window.partitionBy("document_id").orderBy(F.desc("created_at")))).where("_r = 1").drop("_r")
    return ranked.join(runs.where("status = 'succeeded'").select("run_id"), "run_id")


def latest_succeeded(outputs: DataFrame, runs: DataFrame) -> DataFrame:
    """The export rule: the newest output of a succeeded run, one a document."""
    done = outputs.join(runs.where("status = 'succeeded'").select("run_id"), "run_id")
    return done.withColumn("_r", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("created_at"),
                F.desc("run_id")))).where("_r = 1").drop("_r")


def hits(index: Index, query: str, documents: DataFrame, classifications: DataFrame | None = None, filters: Filters = Filters(),
    phrase: bool = False, scored: bool = True, current: DataFrame | None = None) -> DataFrame:
    """All matching rows with document and classification columns. ``current`` limits an index of versions to (document_id, run_id) in force."""
    tree = parse_query(query, phrase)
    found = index.scored(tree) if scored else index.matches(tree).where("_hit").select(*index.key)
    if current is not None:
        found = found.join(current.select(*index.key), index.key, "left_semi")
    joined = found.join(documents.drop("text"), "document_id")
    if classifications is not None:
        joined = joined.join(classifications.select("document_id", "code", "label"), "document_id", "left")
    return filters.apply(joined)


def search(index: Index, query: str, documents: DataFrame, classifications: DataFrame | None = None, filters: Filters = Filters(),
    phrase: bool = False, limit: int = 20, offset: int = 0, **how) -> DataFrame:
    """A page of hits: best score first, then newest, then by id."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be between 1 and 500, offset not negative")
    return hits(index, query, documents, classifications, filters, phrase, **how).orderBy("score", F.desc("created_at"),
        "document_id").offset(offset).limit(limit)


def count(index: Index, query: str, documents: DataFrame, classifications: DataFrame | None = None, filters: Filters = Filters(),
    phrase: bool = False, **how) -> DataFrame:
    return hits(index, query, documents, classifications, filters, phrase, scored=False, **how).agg(F.count_distinct("document_id").alias("total"))


def facets(index: Index, query: str, documents: DataFrame, classifications: DataFrame, filters: Filters = Filters(),
    phrase: bool = False, facet_limit: int = 20, **how) -> DataFrame:
    """(facet, value, label, count): classification and filename cut at ``facet_limit``, status whole, and the total. One pass over the hits."""
    if not 1 <= facet_limit <= 500:
        raise ValueError("facet_limit must be between 1 and 500")
    each = hits(index, query, documents, classifications, filters, phrase, scored=False, **how).select("document_id", "code",
        "label", "status", "filename").distinct()
    kinds = F.array(*(F.struct(F.lit(k).alias("facet"), v.alias("value"), l.alias("label")) for k, v,
            l in (("classification", F.col("code"), F.col("label")), ("status", F.col("status"), F.lit(None).cast("string")),
                ("filename", F.col("filename"), F.lit(None).cast("string")),
                ("total", F.lit(None).cast("string"), F.lit(None).cast("string")))))
    counted = each.select(F.inline(kinds)).groupBy("facet", "value", "label").agg(F.count(F.lit(1)).alias("count"))
    top = Window.partitionBy("facet").orderBy(F.desc("count"), F.asc_nulls_first("value"), F.asc_nulls_first("label"))
    return counted.withColumn("_n", F.row_number().over(top)).where(F.col("facet").isin("status",
            "total") | (F.col("_n") <= facet_limit)).select("facet", F.coalesce("value", F.lit("")).alias("value"),
        F.coalesce("label", F.lit("")).alias("label"), "count")


def snippets(page: DataFrame, texts: DataFrame, query: str, phrase: bool = False, window: int = 16) -> DataFrame:
    """``page`` with ``snippet``: the window of tokens with most query words, escaped, hits in mark tags. Runs on a page, not on the corpus."""
    wanted = set(terms_of(parse_query(query, phrase)))

    @F.pandas_udf("string")
    def cut(texts_: pd.Series) -> pd.Series:
        import html

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            tokens = [(m.start(), m.end(), m.group().lower() in wanted) for m in re.finditer(r"[^\W_]+", text)]
            if not tokens:
                return html.escape(text)
            starts = range(max(1, len(tokens) - window + 1))
            best = max(starts, key=lambda s: (len({text[a:b].lower() for a, b, h in tokens[s : s + window] if h}),
                    sum(h for _, _, h in tokens[s : s + window]), -s))
            shown = tokens[best : best + window]
            out, at = [] if best == 0 else ["..."], 0 if best == 0 else shown[0][0]
            for a, b, hit in shown:
                out += [html.escape(text[at:a]), f"<mark>{html.escape(text[a:b])}</mark>" if hit else html.escape(text[a:b])]
                at = b
            out.append(html.escape(text[at:]) if best + window >= len(tokens) else "...")
            return "".join(out)

        return texts_.map(one)

    return page.join(texts.select("document_id", F.col("text").alias("_text")), "document_id", "left").withColumn("snippet", cut("_text")).drop("_text")


def recall(index: Index, phrases: list[str], documents: DataFrame, expected_id, top: int = 20) -> DataFrame:
    """(phrase, hit) of each phrase: is the expected document among the first ``top``?"""
    frames = [search(index, p, documents, limit=top).agg(F.lit(p).alias("phrase"),
            F.coalesce(F.bool_or(F.col("document_id") == F.lit(expected_id)), F.lit(False)).alias("hit")) for p in phrases]
    return reduce(DataFrame.unionByName, frames)


def quote_of_query(query: str) -> str:
    """The longest quoted run, else the query."""
    return max(re.findall(r'"([^"]+)"', query), key=len, default=query)


#: Characters of quotes that one pass looks for at once, at about 100 bytes of automaton each; and passes before the join on token triples is used.
PASS_CHARS, PASSES = 1_000_000, 8


def _quote_passes(quotes: DataFrame, quote_key: str) -> Iterator[list[tuple]]:
    part, n = [], 0
    for key, quote in quotes.select(quote_key, "_quote").distinct().toLocalIterator():
        part.append((key, quote))
        n += len(quote)
        if n >= PASS_CHARS:
            yield part
            part, n = [], 0
    if part:
        yield part


def _scan_for(docs: DataFrame, quotes: DataFrame, key: str, quote_key: str) -> DataFrame:
    """Every text is read once a pass by one automaton over all quotes of the pass; texts don't move."""
    fields = [quotes.schema[quote_key], docs.schema[key]]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), T.StructField("at", T.IntegerType())])
    types = to_arrow_schema(schema).types
    out = docs.sparkSession.createDataFrame([], schema)
    for part in _quote_passes(quotes, quote_key):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            found_by: dict[str, list] = {}
            for k, quote in shared.value:
                found_by.setdefault(quote, []).append(k)
            automaton = ahocorasick.Automaton()
            for quote in found_by:
                automaton.add_word(quote, quote)
            automaton.make_automaton()
            for batch in batches:
                rows = []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    first: dict[str, int] = {}
                    for end, quote in automaton.iter(text or ""):
                        first.setdefault(quote, end - len(quote) + 2)
                    rows += [(k, i, at) for quote, at in first.items() for k in found_by[quote]]
                ids, at = batch.column(0).take(pa.array([i for _, i, _ in rows], pa.int32())), pa.array([a for _, _, a in rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in rows], types[0]), ids.cast(types[1]), at], names=[quote_key, key, "at"])

        out = out.unionByName(docs.select(key, F.lower("text").alias("text")).mapInArrow(run, schema))
    return out


def quotes_in(docs: DataFrame, quotes: DataFrame, key: str, quote_key: str) -> DataFrame:
    """(quote_key, key, at): where ``quotes`` stand verbatim in ``docs``, case aside. Empty quotes stand nowhere; ``at`` is the first place, from 1.

    Up to ``PASSES`` passes of ``PASS_CHARS`` characters of quotes are found by scanning. Beyond, quotes of five or more tokens are found by a join:
    tokens inside a quote are whole tokens of a text that holds it, so three of them in a row are an equi-join key and only
    candidates are compared; shorter quotes have no such key and are scanned for.
    """
    q = quotes.where(F.length("text") > 0).select(quote_key, F.lower("text").alias("_quote"), tokens_of(F.col("text")).alias("_t"))
    total = q.agg(F.coalesce(F.sum(F.length("_quote")), F.lit(0))).first()[0]
    if total <= PASSES * PASS_CHARS:
        return _scan_for(docs, q, key, quote_key).distinct()
    d = docs.select(key, F.lower("text").alias("_text"))
    gram = lambda t, i: F.xxhash64(F.get(t, i), F.get(t, i + 1), F.get(t, i + 2))
    grams = F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3),
            lambda i: gram(F.col("_w"), i))).otherwise(F.array().cast("array<bigint>"))
    keyed = d.withColumn("_w", tokens_of(F.col("_text"))).select(key, F.explode(F.array_distinct(grams)).alias("_gram"))
    long = q.where(F.size("_t") >= 5).select(quote_key, "_quote", gram(F.col("_t"), F.lit(1)).alias("_gram"))
    # candidates first, so that only texts that have one are joined again
    pairs = keyed.join(long, "_gram").select(key, quote_key, "_quote").distinct().join(d, key)
    found = pairs.where(F.contains("_text", "_quote")).select(quote_key, key, F.position("_quote", "_text").alias("at"))
    return found.unionByName(_scan_for(docs, q.where(F.size("_t") < 5), key, quote_key)).distinct()

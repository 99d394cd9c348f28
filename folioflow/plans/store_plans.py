"""Lookups, pages, upserts and the cases of validation and assembly over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import process
from ..operators import search as S
from ..operators import tables as T
from .base import DOCS, RUNS, classifications, documents, outputs, query, runs, table
from .table_plans import _QUEUE, NOW, _now, _queue


@query(f"WITH {RUNS} SELECT run_id, document_id, status FROM runs WHERE run_id = 7")
def lookup_run(spark: SparkSession, d: str) -> DataFrame:
    return T.lookup(runs(spark, d), {"run_id": 7}).select("run_id", "document_id", "status")


@query("SELECT 'raw:doc_' || doc_id AS key, text FROM documents WHERE doc_id = 11")
def lookup_text(spark: SparkSession, d: str) -> DataFrame:
    """A text that has to be there."""
    blobs = table(spark, d, "documents").select(F.concat(F.lit("raw:doc_"), F.col("doc_id").cast("string")).alias("key"), "text")
    return T.lookup(blobs, {"key": "raw:doc_11"}, required=True)


@query("SELECT c_custkey AS run_id, c_mktsegment = 'BUILDING' AS canceled FROM customer")
def runs_canceled(spark: SparkSession, d: str) -> DataFrame:
    """Is each wanted run canceled? Ids that are no run are not."""
    c = table(spark, d, "customer")
    held = c.select(F.col("c_custkey").alias("run_id"),
        F.when(F.col("c_mktsegment") == "BUILDING",
            "canceled").otherwise("running").alias("status")).where("status = 'canceled' OR run_id % 2 = 0")
    return T.are_canceled(held, c.select(F.col("c_custkey").alias("run_id")))


@query(f"WITH {RUNS} SELECT run_id FROM runs ORDER BY created_at DESC, run_id LIMIT 30 OFFSET 10")
def runs_page(spark: SparkSession, d: str) -> DataFrame:
    made = outputs(spark, d).select("run_id", "created_at")
    return T.page(runs(spark, d).join(made, "run_id"), [F.desc("created_at"), "run_id"], 30, 10).select("run_id")


@query(f"WITH {_QUEUE} SELECT run_id, status FROM q ORDER BY updated_at DESC, run_id LIMIT 25 OFFSET 5")
def queue_page(spark: SparkSession, d: str) -> DataFrame:
    return T.page(_queue(spark, d), [F.desc("updated_at"), "run_id"], 25, 5).select("run_id", "status")


@query("SELECT 'chk_' || substr(sha256(doc_id::varchar || ':0:' || sha256(text)), 1, 16) AS chunk_id, doc_id AS document_id, lang AS text FROM documents WHERE doc_id % 3 <> 0")
def chunks_remapped(spark: SparkSession, d: str) -> DataFrame:
    """Old surrogate ids replaced by those that derive from content; chunks without a new id are left out."""
    t = table(spark, d, "documents")
    rows = t.select((F.col("doc_id") + 100).alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("lang").alias("text"))
    new = X.digest("chk_", F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("0"), F.sha2("text", 256)))
    return T.remapped(rows, t.where("doc_id % 3 <> 0").select((F.col("doc_id") + 100).alias("old_id"),
            F.col("doc_id").alias("document_id"), new.alias("new_id")))


@query(f"WITH {DOCS} SELECT document_id, filename, n AS output_chars, code FROM (SELECT document_id, filename, length(text) + 2 AS n FROM docs WHERE document_id = (SELECT min(doc_id) FROM labels)) LEFT JOIN (SELECT doc_id AS document_id, quality::varchar AS code FROM labels) USING (document_id)")
def shown_document(spark: SparkSession, d: str) -> DataFrame:
    """A document with the length of its newest output and its classification."""
    docs = documents(spark, d)
    made = docs.select("document_id", "created_at", F.explode(F.array(F.lit(1), F.lit(2))).alias("run_id"),
        "text").withColumn("text", F.concat("text", F.repeat(F.lit("x"), F.col("run_id"))))
    first = classifications(spark, d).agg(F.min("document_id")).first()[0]
    return T.show_document(docs.drop("text"), made, classifications(spark, d), first).select("document_id", "filename", "output_chars", "code")


@query("SELECT c_custkey AS run_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'canceled' WHEN s IS NULL THEN 'running' ELSE s END AS status FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def runs_saved(spark: SparkSession, d: str) -> DataFrame:
    """Runs saved again, unless they are canceled."""
    held = table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "canceled").otherwise("running").alias("status"))
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.max("o_orderstatus").alias("status"))
    return T.guarded_upsert(held, new, ["run_id"], F.col("status") == "canceled")


@query("SELECT 'raw:doc_' || doc_id AS key, CASE WHEN doc_id % 4 = 0 THEN 'new ' || lang ELSE text END AS text, CASE WHEN doc_id >= 900000000 THEN 'b' ELSE 'a' END AS created, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE len(regexp_extract_all(lower(text), '[\\pL\\pN]+')) END AS n_tokens FROM documents")
def texts_put(spark: SparkSession, d: str) -> DataFrame:
    """Texts put again by key: replaced, the moment they were made kept, and indexed anew."""
    t = table(spark, d, "documents").withColumn("key", F.concat(F.lit("raw:doc_"), F.col("doc_id").cast("string")))
    old = t.select("key", "text", F.lit("a").alias("created"))
    new = t.where("doc_id % 4 = 0").select("key", F.concat(F.lit("new "), "lang").alias("text"), F.lit("b").alias("created"))
    after = T.upsert(old, new, ["key"], keep=("created",))
    return after.join(S.Index.build(old, ["key"]).updated(new.select("key", "text")).sizes, "key")


@query("WITH c AS (SELECT sha256(text) AS chunk_sha256, CASE WHEN doc_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS prompt_version, max(doc_id) AS last FROM documents GROUP BY 1, 2) SELECT chunk_sha256, prompt_version, 'mock' AS model_provider, 'm' AS model_name, CASE WHEN last % 3 = 0 THEN 'new' ELSE 'old' END AS text FROM c")
def cache_saved(spark: SparkSession, d: str) -> DataFrame:
    """The chunk cache by its key of four: text, prompt, provider, model."""
    t = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("chunk_sha256"),
        F.when(F.col("doc_id") % 2 == 0, "v1").otherwise("v2").alias("prompt_version"), F.lit("mock").alias("model_provider"),
        F.lit("m").alias("model_name"))
    key = ["chunk_sha256", "prompt_version", "model_provider", "model_name"]
    last = t.groupBy(*key).agg(F.max("doc_id").alias("last"))
    old, new = last.select(*key, F.lit("old").alias("text")), last.where("last % 3 = 0").select(*key, F.lit("new").alias("text"))
    return T.upsert(old, new.unionByName(new), key)


@query("SELECT doc_id AS document_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS policy, CASE WHEN doc_id % 2 = 0 THEN u.o ELSE 0 END AS ordinal FROM documents, range(0, 2) u(o) WHERE doc_id % 2 = 0 OR u.o = 0")
def chunks_saved(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of documents cut anew by another policy: the old chunks of the document go."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    old = t.select("document_id", F.lit(0).alias("policy"), F.lit(0).alias("ordinal"))
    new = t.where("document_id % 2 = 0").select("document_id", F.lit(1).alias("policy"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal"))
    return T.replace_by(old, new, ["document_id"])


@query(f"SELECT event_id AS sequence, 'e' AS stage FROM events UNION ALL SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY c_custkey), 'n' FROM customer")
def events_emitted(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "events").select(F.col("event_id").alias("sequence"), F.col("user_id").alias("run_id"),
        F.lit("e").alias("stage"), F.lit("m").alias("message"), F.col("ts").alias("created_at"))
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.lit("n").alias("stage"),
        F.lit("m").alias("message"), _now().alias("created_at"))
    return T.emit(old, new).select("sequence", "stage")


#: (answer, source, warnings): one case for each branch of validation. <id> is the document's id.
_VALIDATIONS = (
    ("", "x", "empty-output"),
    ("As an AI model I cannot\nplease provide your transcript", "x", "artifact-filtered;empty-after-artifact-filter"),
    ("kept <id>\nI cannot access this file", "x", "artifact-filtered"),
    ("short <id>", "long " * 40, "suspiciously-short-output"),
    ("text <id> [Next Context: y]", "x", "context-marker-leak"),
    ("text <id>\n- \nmore", "x", "orphan-list-marker"),
    ("|a|<id>|\n|b|c|", "x", "malformed-markdown-table"),
    ("text <id> " + "again and on " * 9, "x", "repeated-tail"),
    ("one <id> " + "word and some other words " * 3 + "x" * 500, "a\n\nb\n\nc", "collapsed-paragraphs"),
    ("plain <id>", "# Head\n\ntext", "missing-markdown-heading"),
    ("plain <id>", "- item\n- item", "missing-markdown-list"),
    ("plain <id>", "|a|b|\n|---|---|\n|c|d|", "missing-markdown-table"),
    ("plain <id>", "as said [12] there", "missing-citation-marker"),
    ("fine <id>\n\n\n\n\n\nend  \n  of", "x", ""),
)


def _case(values: list[str], by: str) -> str:
    """A CASE over literals, with <id> put in; the same text for DuckDB and Spark."""
    quoted = lambda v: " || ".join("chr(10)" if p == "\n" else by.split(" %")[0] + "::string" if p == "<id>" else "'" +
        p.replace("'", "''") + "'" for p in _pieces(v)) or "''"
    return f"CASE {by} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"


def _pieces(value: str) -> list[str]:
    import re

    return [p for p in re.split(r"(\n|<id>)", value) if p]


@query(f"SELECT doc_id, {_case([w for _, _, w in _VALIDATIONS], f'doc_id % {len(_VALIDATIONS)}')} AS warnings, CASE WHEN doc_id % {len(_VALIDATIONS)} = 13 THEN 'fine ' || doc_id || chr(10) || chr(10) || chr(10) || 'end' || chr(10) || 'of' WHEN doc_id % {len(_VALIDATIONS)} = 2 THEN 'kept ' || doc_id END AS text FROM documents")
def validation_cases(spark: SparkSession, d: str) -> DataFrame:
    """Every warning of validation, each by a text that earns it alone."""
    n = len(_VALIDATIONS)
    case = table(spark, d, "documents").select("doc_id",
        F.expr(_case([a for a, _, _ in _VALIDATIONS], f"doc_id % {n}")).alias("answer"),
        F.expr(_case([s for _, s, _ in _VALIDATIONS], f"doc_id % {n}")).alias("source"))
    told = case.select("doc_id", X.validate(F.col("answer"), F.length("source"), F.col("source")).alias("v"))
    return told.select("doc_id", F.array_join("v.warnings", ";").alias("warnings"), F.when((F.col("doc_id") % n).isin(2, 13), F.col("v.text")).alias("text"))


@query("SELECT doc_id AS document_id, '# Head' || chr(10) || chr(10) || 'One ' || doc_id || '. Two.' || chr(10) || chr(10) || chr(10) || 'Three ' || source || '.' || chr(10) || chr(10) || 'Four.' || chr(10) || chr(10) || '- list one.' || chr(10) || '- five' || chr(10) || chr(10) || 'Six.' || chr(10) || 'kept' AS text, 4::bigint AS n_chunks, 1::bigint AS failed_chunks, 'a,b' AS warnings FROM documents")
def assembly_cases(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that repeat a sentence over their border, echo their context, leak a refusal and double a header; one is blank."""
    number, source = F.col("doc_id").cast("string"), F.col("source")
    part = lambda o, w, *c: F.struct(F.lit(o).alias("ordinal"),
        F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in c)).alias("clean_text"),
        F.array(*map(F.lit, w)).cast("array<string>").alias("warnings"))
    parts = [part(2, ["b"], "[CONTEXT: This continues from: z]\n\nThree ", source,
            ". Four.\n\n- list one.\n- five\nAs an AI language model"),
        part(0, ["b", "a"], "# Head\n# Head\n\nOne ", number, ". Two. two."),
        part(1, [], "Two.  \n\n\n\n\nThree ", source, "."), part(3, ["a"], " \n ")]
    tail = F.struct(F.lit(4).alias("ordinal"), F.lit("Six.\n  kept").alias("clean_text"), F.array().cast("array<string>").alias("warnings"))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"),
        F.inline(F.array(*parts[:3], parts[3].withField("ordinal", F.lit(9)), tail)))
    out = process.assemble(rows.where("ordinal <> 9").unionByName(rows.where("ordinal = 9")), "document_id")
    return out.select("document_id", "text", (F.col("n_chunks") - 1).alias("n_chunks"), "failed_chunks", F.array_join("warnings", ",").alias("warnings"))

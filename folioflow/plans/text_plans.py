"""Hashing, cleaning, validation, chunking, classification, series, exports and the bundle over the test tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import export, process, rollups
from ..session import spread
from ..sources import readers
from .base import documents, query, table

POLICY = process.ChunkPolicy(1000, 100, 200)


@query("SELECT doc_id, 'doc_' || substr(sha256(text), 1, 16) AS document_id, sha256(text) AS sha256, strlen(text)::bigint AS byte_size FROM documents")
def doc_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.digest("doc_", F.col("text")).alias("document_id"),
        F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("byte_size"))


@query("SELECT doc_id AS document_id, 'chk_' || substr(sha256(doc_id::varchar || ':0:' || sha256(text)), 1, 16) AS chunk_id FROM documents")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of chunks that are whole texts."""
    return documents(spark, d).select("document_id",
        X.digest("chk_", F.concat_ws(":", F.col("document_id").cast("string"), F.lit("0"),
                F.sha2("text", 256))).alias("chunk_id"))


@query()
def chunks(spark: SparkSession, d: str) -> DataFrame:
    return process.chunks(documents(spark, d), POLICY)


@query()
def process_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunk, clean, validate, assemble and classify every document."""
    return process.process(documents(spark, d), POLICY).drop("text")


@query()
def process_coherent(spark: SparkSession, d: str) -> DataFrame:
    """The same with the context of the chunk before."""
    return process.process(documents(spark, d), POLICY, mode="max-coherence").drop("text")


_BROKEN = "CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN 'As an AI language model' WHEN doc_id % 4 = 2 THEN substr(text, 1, 15) ELSE text || chr(10) || '[Context: x]' || chr(10) || '- ' END"


@query(
    rf"""WITH s AS (SELECT doc_id, text, length(text) AS n, {_BROKEN} AS raw FROM documents),
c AS (SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS first FROM s),
k AS (SELECT *, first ILIKE 'as an ai language model' AS dirty FROM c),
f AS (SELECT *, CASE WHEN dirty THEN '' ELSE first END AS kept FROM k)
SELECT doc_id, CASE WHEN first = '' THEN 'empty-output' WHEN kept = '' THEN 'artifact-filtered,empty-after-artifact-filter' ELSE array_to_string(list_filter([
 CASE WHEN n > 100 AND length(kept) < n * 0.2::double THEN 'suspiciously-short-output' END, CASE WHEN contains(kept, '[Context:') THEN 'context-marker-leak' END, CASE WHEN ends_with(kept, chr(10) || '-') THEN 'orphan-list-marker' END], lambda x: x IS NOT NULL), ',') END AS warnings FROM f"""
)
def validation_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Warnings of answers that are empty, refused, cut or leak their context."""
    raw = table(spark, d, "documents").withColumn("raw", F.expr(_BROKEN))
    return raw.select("doc_id", F.array_join(X.validate(F.col("raw"), F.length("text"))["warnings"], ",").alias("warnings"))


@query(r"""WITH l AS (SELECT doc_id, list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS lines FROM documents) SELECT doc_id, regexp_replace(array_to_string(lines, chr(10)), '^\n+|\n+$', '', 'g') AS text FROM l""")
def clean_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.mock_clean(F.col("text")).alias("text"))


_MARKS = "'# Report ' || doc_id || chr(10) || '> quoted' || chr(10) || '- item `code`' || chr(10) || '1. one [link](http://x.y/z) ![pic](a.png)' || chr(10) || '<!-- gone -->' || chr(10) || chr(10) || chr(10) || '*bold* ' || text"


@query(rf"""WITH m AS (SELECT doc_id, {_MARKS} AS t FROM documents) SELECT doc_id, md5(regexp_replace({"regexp_replace(" * 12}t, '(?s)```.*?```', '', 'g'), '(?s)^---\n.*?\n---\n?', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '`([^`]*)`', '\1', 'g'), '!\[([^\]]*)\]\([^)]+\)', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '(?m)^\s{{0,3}}#{{1,6}}\s*', '', 'g'), '(?m)^\s{{0,3}}>\s?', '', 'g'), '(?m)^\s*[*+-]\s+', '', 'g'), '(?m)^\s*\d+\.\s+', '', 'g'), '[_*]{{1,3}}([^_*]+)[_*]{{1,3}}', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS h FROM m""")
def markdown_to_text(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).select("doc_id", F.md5(X.markdown_to_text(F.expr(_MARKS))).alias("h"))


_BLOCKS = "p|div|h[1-6]|li|ul|ol|tr|table|nav|header|footer|section|article|br"


#: Appended to every page: decimal, hexadecimal, far and named entities, and one that is none.
_ODD, _READ = "<p>&#65;&#x42;&#128512; &eacute;&apos;&Uuml;&zzz;</p>", "AB😀 é\'\'Ü&zzz;"


def _named(c: str) -> str:
    """Named entities replaced one after the other, the ampersand last."""
    for name, char in (*X.ENTITIES.items(), ("amp", "&")):
        char = char.replace("'", "''")
        c = f"replace({c}, '&{name};', '{char}')"
    return c


@query(
    rf"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<head\b.*?</head\s*>', ' ', 'g'), '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<noscript\b.*?</noscript\s*>', ' ', 'g') AS c FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(c, '(?i)</?(?:{_BLOCKS})\b[^>]*>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g') AS c FROM a),
e AS (SELECT page_id, {_named("replace(c, '&#39;', chr(39))")} || chr(10) || '{_READ}' || chr(10) AS c FROM b)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '[ \t\x0B\f\r]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{2,}}', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM e"""
)
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_pages(table(spark, d, "pages").withColumn("html", F.concat("html", F.lit(_ODD)))).select("page_id", "text")


_SPOKEN = "CASE doc_id % 5 WHEN 0 THEN text || ' nightmare' WHEN 1 THEN text || ' Algorithm' WHEN 2 THEN text || ' HEALTH' WHEN 3 THEN text || ' novel' ELSE text END"


@query(
    rf"""WITH s AS (SELECT doc_id, {_SPOKEN} AS t FROM documents), c AS (SELECT doc_id, t, CASE WHEN regexp_matches(lower(t), 'horse|equine|colt|mare|stallion') THEN '636.1' WHEN regexp_matches(lower(t), 'software|programming|computer|algorithm') THEN '000' WHEN regexp_matches(lower(t), 'medicine|health|doctor|disease') THEN '610' WHEN regexp_matches(lower(t), 'writing|literature|novel|poetry') THEN '800' ELSE '000' END AS code FROM s)
SELECT doc_id, code, CASE code WHEN '636.1' THEN 'Horses & Equines' WHEN '610' THEN 'Medicine & Health' WHEN '800' THEN 'Literature' ELSE 'Computer Science & Information' END AS label, coalesce(nullif(regexp_replace(substr(t, 1, 500), '^\s+|\s+$', '', 'g'), ''), 'No summary available.') AS summary FROM c"""
)
def classify_heuristic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.classify(F.expr(_SPOKEN)).alias("c")).select("doc_id", "c.*")


@query(
    r"""WITH d AS (SELECT doc_id, text, source, doc_id % 5 AS g FROM documents)
SELECT doc_id, CASE g WHEN 0 THEN '610' WHEN 1 THEN '000' WHEN 2 THEN '800' ELSE '610' END AS code, CASE g WHEN 0 THEN 'Care' WHEN 1 THEN 'Computer Science & Information' WHEN 2 THEN 'Literature' ELSE 'Medicine & Health' END AS label,
 CASE g WHEN 0 THEN 's' || doc_id WHEN 1 THEN 'No summary available.' WHEN 2 THEN 's' ELSE regexp_replace(substr('a doctor ' || text, 1, 500), '^\s+|\s+$', '', 'g') END AS summary, CASE g WHEN 0 THEN 0.5 END AS confidence, CASE g WHEN 0 THEN 'A title' END AS title, CASE g WHEN 0 THEN 'x y,' || source ELSE '' END AS tags,
 CASE g WHEN 0 THEN 'About it.' END AS description, CASE g WHEN 0 THEN 'Acme' END AS issuer, CASE g WHEN 0 THEN 'acme-weekly-' || source WHEN 1 THEN 'acme-office-view' WHEN 2 THEN 'acme-office-view' END AS series_key, CASE g WHEN 0 THEN 'Weekly ' || source END AS series_title, CASE g WHEN 0 THEN '2026-Q2' WHEN 1 THEN '2025' END AS period FROM d"""
)
def classification_payloads(spark: SparkSession, d: str) -> DataFrame:
    """A model's answers: whole payloads in prose, payloads with blanks, one field missing, no JSON. All fields cleaned; keywords decide where there is no payload."""
    raw = F.expr(
        """CASE doc_id % 5 WHEN 0 THEN concat('Sure: {"summary": " s', doc_id, ' ", "dewey_code": "610", "category_name": "Care", "confidence": 0.5, "title": " A  title", "tags": ["X  y", "", "x y", "', source, '"], "description": "About it.", "issuer": "Acme ", "series": "Weekly ', source, '", "period": "Q2 2026"} done')
WHEN 1 THEN '{"summary": " ", "dewey_code": " ", "category_name": "", "period": "year 2025"}' WHEN 2 THEN '{"summary": "s", "dewey_code": "800", "category_name": " "}' WHEN 3 THEN '{"summary": "s", "dewey_code": "800"}' ELSE 'no answer' END"""
    )
    said, file = F.concat(F.lit("a doctor "), "text"), F.when(F.col("doc_id") % 5 < 3, "Acme_Office_View_2026-06.pdf").otherwise("Acme_Office_2026-07.pdf")
    return table(spark, d, "documents").select("doc_id", X.classified(raw, said, file).alias("c")).select("doc_id",
        "c.*").withColumn("tags", F.array_join("tags", ","))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(lower(source || ' No. ' || doc_id || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.slug(F.concat("source", F.lit(" No. "), F.col("doc_id").cast("string"), F.lit("!"))).alias("slug"))


_TIME = "CASE doc_id % 6 WHEN 0 THEN '2026-0' || (doc_id % 9 + 1) WHEN 1 THEN 'Q' || (doc_id % 4 + 1) || ' 2025' WHEN 2 THEN 'H2 2024' WHEN 3 THEN 'March 2023' WHEN 4 THEN 'spring' ELSE 'the year 1999' END"


@query(f"SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN '2025-Q' || (doc_id % 4 + 1) WHEN 2 THEN '2024-H2' WHEN 3 THEN '2023-03' WHEN 5 THEN '1999' ELSE {_TIME} END AS period FROM documents")
def periods(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.period(F.expr(_TIME)).alias("period"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'acme-' || source || '-weekly' WHEN doc_id % 3 = 1 THEN 'acme-' || source || '-office' END AS series_key FROM documents")
def series_keys(spark: SparkSession, d: str) -> DataFrame:
    """Named series; series of distinctive file names; none."""
    third = F.col("doc_id") % 3
    issuer, title = F.when(third == 0, "Acme"), F.when(third == 0, F.concat("source", F.lit(" Weekly, March 2024")))
    name = F.when(third == 1, F.concat(F.lit("Acme_"), "source", F.lit("_Office_2026-0"),
            (F.col("doc_id") % 9 + 1).cast("string"), F.lit(".pdf"))).otherwise("report.pdf")
    return table(spark, d, "documents").select("doc_id", X.series_key(issuer, title, name).alias("series_key"))


_CODE = "CASE doc_id % 4 WHEN 0 THEN '636.1' WHEN 1 THEN '610' WHEN 2 THEN '8' ELSE 'x' END"


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '600/630/636/636.1' WHEN 1 THEN '600/610' WHEN 2 THEN '800/8' ELSE 'x' END AS path FROM documents")
def dewey_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(X.dewey_path(F.expr(_CODE)), "/").alias("path"))


_SAID = """' {"api_key": "k' || doc_id || '", ''Secret'' : ''s p''} token=abc' || doc_id || '; PASSWORD : x,y Authorization: Bearer t' || doc_id || ' sk-abcdefghij' || doc_id || ' sk-short'"""


@query(f"""SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)\\b(api[_-]?key|token|secret|password)(\\s*[:=]\\s*)([^\\s,;]+)', '\\1\\2[REDACTED]', 'g'), '\\bsk-[A-Za-z0-9_-]{{8,}}\\b', '[REDACTED]', 'g') || ' {{"api_key": "[REDACTED]", ''Secret'' : ''[REDACTED]''}} token=[REDACTED]; PASSWORD : [REDACTED],y Authorization: Bearer [REDACTED] [REDACTED] sk-short' AS text FROM (SELECT doc_id, text FROM documents)""")
def redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    """All four families: quoted pairs, assignments, bearer headers, keys of a known prefix."""
    parts = [F.lit(p) if i % 2 == 0 else F.col("doc_id").cast("string") for i, p in enumerate(re.split(r"' \|\| (doc_id) \|\| '", _SAID.strip("'")))]
    said = F.concat("text", *(p if i % 2 else F.lit(x) for i,
            (p, x) in enumerate(zip(parts, (x.replace("''", "'") for x in re.split(r"' \|\| (doc_id) \|\| '", _SAID[1:-1]))))))
    return table(spark, d, "documents").select("doc_id", X.redact(said).alias("text"))


@query("SELECT doc_id, CASE WHEN length(text) + 2 <= 1000 THEN 'e ' || text ELSE substr('e ' || text, 1, 1000) || '...[truncated]' END AS error FROM (SELECT doc_id, replace(replace(replace(text, ':', ' '), '=', ' '), 'sk-', 'sk ') AS text FROM documents)")
def sanitized_errors(spark: SparkSession, d: str) -> DataFrame:
    plain = F.replace(F.replace(F.replace("text", F.lit(":"), F.lit(" ")), F.lit("="), F.lit(" ")), F.lit("sk-"), F.lit("sk "))
    return table(spark, d, "documents").select("doc_id", X.sanitize_error(F.concat(F.lit("e "), plain)).alias("error"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN '610 ' || source || ' & notes' ELSE 'file ' || doc_id END AS stem FROM documents JOIN labels USING (doc_id)")
def export_stems(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return t.select("doc_id", X.export_stem(F.lit("610"), F.when(F.col("quality") == 1, F.concat("source", F.lit(" & | notes/"))),
            F.concat(F.lit("file_"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("stem"))


@query("SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'upload.txt' WHEN 1 THEN 'a b' || page_id || '.md' WHEN 2 THEN 'c' || page_id || '.txt' WHEN 3 THEN regexp_extract(url, '[^/]*$') WHEN 4 THEN 'upload.txt' ELSE 'tab' || page_id END AS name FROM (SELECT page_id, CASE WHEN page_id % 6 = 3 AND url LIKE '%/' THEN url || 'x' ELSE url END AS url FROM pages)")
def safe_filenames(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("CASE page_id % 6 WHEN 0 THEN '../..' WHEN 1 THEN concat('dir/a%20b', page_id, '.md') WHEN 2 THEN concat('C:\\\\x\\\\c', page_id, '.txt') WHEN 3 THEN CASE WHEN url LIKE '%/' THEN concat(url, 'x') ELSE url END WHEN 4 THEN ' ' ELSE concat('\t tab', page_id, '\n') END")
    return table(spark, d, "pages").select("page_id", X.safe_filename(raw).alias("name"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/out/' ELSE '/in/conv/' END || page_id || '.md' AS path FROM pages")
def output_paths(spark: SparkSession, d: str) -> DataFrame:
    source = F.concat(F.lit("/in/"), F.col("page_id").cast("string"), F.lit(".html"))
    new = readers.output_path(source, "/in", "md", "new-directory", "/out")
    return table(spark, d, "pages").select("page_id",
        F.when(F.col("page_id") % 2 == 0, new).otherwise(readers.output_path(source, "/in", "md", "subdirectory",
                subdirectory="conv")).alias("path"))


@query("SELECT doc_id, '# src a' || chr(10) || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) AS content FROM documents")
def rendered_conversions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", readers.render_conversion(F.col("text"), F.lit("/in/src_a.html"), "md").alias("content"))


@query("SELECT doc_id, strpos(regexp_replace(lower(text), '\\s+', ' ', 'g'), 'the') > 0 AND strpos(regexp_replace(lower(text), '\\s+', ' ', 'g'), 'and') > strpos(regexp_replace(lower(text), '\\s+', ' ', 'g'), 'the') AS ordered FROM documents")
def text_order(spark: SparkSession, d: str) -> DataFrame:
    """Does "the" stand before "and"?"""
    return table(spark, d, "documents").select("doc_id", rollups.in_order(F.col("text"), F.lit("The"), F.lit("AND"), F.lit(False)).alias("ordered"))


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'the') THEN '' ELSE 'missing: The;' END || CASE WHEN contains(lower(text), 'license') THEN 'forbidden: license;' ELSE '' END || CASE WHEN n_chars > 2000 THEN 'output ratio too large;' WHEN n_chars < 300 THEN 'output ratio too small;' ELSE '' END AS failures FROM documents""")
def eval_failures(spark: SparkSession, d: str) -> DataFrame:
    found = rollups.case_failures(F.col("text"), F.array(F.lit("The")), F.array(F.lit("license")), F.col("n_chars") / 1000, F.lit(0.3), F.lit(2.0))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(found, lambda x: F.concat(x, F.lit(";"))), "").alias("failures"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Processed documents for exports: the text's first 300 characters as summary, a series by source, an edition by language."""
    t = table(spark, d, "documents")
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(hours=F.col("doc_id").cast("int"))
    none = F.lit(None).cast("string")
    return t.select(F.col("doc_id").alias("document_id"), F.concat("source", F.lit(".txt")).alias("filename"), "text",
        at.alias("created_at"), F.expr(_CODE).alias("code"), none.alias("label"),
        F.substring("text", 1, 300).alias("summary"), F.concat(F.lit("Note "), F.col("lang")).alias("title"),
        F.array("lang", "source").alias("tags"), none.alias("description"), none.alias("issuer"),
        F.col("source").alias("series_key"), F.col("source").alias("series_title"), F.col("lang").alias("period"),
        F.lit(0.5).alias("confidence"))


@query(rf"""SELECT doc_id AS document_id, md5('# Note ' || lang || chr(10) || CASE WHEN regexp_replace(substr(text, 1, 300), '^\s+|\s+$', '', 'g') = '' THEN '' ELSE chr(10) || '> ' || replace(regexp_replace(substr(text, 1, 300), '^\s+|\s+$', '', 'g'), chr(10), ' ') || chr(10) END || chr(10) || 'Classification: ' || {_CODE} || chr(10) || chr(10) || 'Tags: ' || lang || ', ' || source || chr(10) || chr(10) || '---' || chr(10) || chr(10) || text) AS h FROM documents""")
def export_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _sources(spark, d).select("document_id", F.md5(export.render("md")).alias("h"))


@query(rf"""SELECT doc_id AS document_id, doc_id::varchar AS id, {_CODE} AS classification, 'Note ' || lang AS title, substr(text, 1, 300) AS summary, lang || ',' || source AS tags, {_CODE} || ' Note ' || lang AS suggested_stem, md5(text) AS h, 8 AS n_fields FROM documents""")
def export_json(spark: SparkSession, d: str) -> DataFrame:
    """The export read back: every field, and how many there are."""
    ddl = "document_id string, filename string, classification string, title string, summary string, tags array<string>, suggested_stem string, text string"
    read = _sources(spark, d).select("document_id", export.render("json").alias("c")).select("document_id",
        F.from_json("c", ddl).alias("j"), F.size(F.json_object_keys("c")).alias("n_fields"))
    return read.select("document_id", F.col("j.document_id").alias("id"), "j.classification", "j.title", "j.summary",
        F.array_join("j.tags", ",").alias("tags"), "j.suggested_stem", F.md5("j.text").alias("h"), "n_fields")


@query(
    f"""WITH s AS (SELECT doc_id, 'note-' || lang AS stem, CASE doc_id % 4 WHEN 0 THEN '600-technology/630-agriculture/636-animal-husbandry/636-1-horses-equines' WHEN 1 THEN '600-technology/610-medicine-health' WHEN 2 THEN '800-literature/8-general' ELSE 'x-general' END AS dir FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY dir, stem ORDER BY doc_id) AS n FROM s) SELECT doc_id AS document_id, dir || '/' || stem || CASE WHEN n = 1 THEN '' ELSE '-' || n END || '.md' AS path FROM r"""
)
def bundle_paths(spark: SparkSession, d: str) -> DataFrame:
    return export.concepts(_sources(spark, d)).select("document_id", "path")


@query("""WITH s AS (SELECT CASE doc_id % 4 WHEN 0 THEN ['600-technology', '600-technology/630-agriculture', '600-technology/630-agriculture/636-animal-husbandry', '600-technology/630-agriculture/636-animal-husbandry/636-1-horses-equines'] WHEN 1 THEN ['600-technology', '600-technology/610-medicine-health'] WHEN 2 THEN ['800-literature', '800-literature/8-general'] ELSE ['x-general'] END AS dirs FROM documents) SELECT u.dir AS directory, count(*) AS n_concepts FROM s, unnest(dirs) u(dir) GROUP BY 1""")
def bundle_directories(spark: SparkSession, d: str) -> DataFrame:
    return export.directories(export.concepts(_sources(spark, d))).select("directory", "n_concepts")


_MEMBERS = f"""s AS (SELECT doc_id, {_CODE} AS code, source, lang, 'Note ' || lang AS title, 'note-' || lang AS stem, CASE doc_id % 4 WHEN 0 THEN '600-technology/630-agriculture/636-animal-husbandry/636-1-horses-equines' WHEN 1 THEN '600-technology/610-medicine-health' WHEN 2 THEN '800-literature/8-general' ELSE 'x-general' END AS dir FROM documents),
p AS (SELECT *, dir || '/' || stem || CASE WHEN n = 1 THEN '' ELSE '-' || n END || '.md' AS path FROM (SELECT *, row_number() OVER (PARTITION BY dir, stem ORDER BY doc_id) AS n FROM s))"""


@query(
    f"""WITH {_MEMBERS}, a AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY doc_id) AS r, row_number() OVER (PARTITION BY source ORDER BY lang, lower(title), path) AS e FROM p),
near AS (SELECT x.doc_id, y.title || '>' || y.path AS link, row_number() OVER (PARTITION BY x.doc_id ORDER BY y.r) AS n FROM a x JOIN a y ON x.code = y.code AND x.path <> y.path WHERE y.r <= 13),
same AS (SELECT x.doc_id, y.lang || '>' || y.path AS link, row_number() OVER (PARTITION BY x.doc_id ORDER BY y.e) AS n FROM a x JOIN a y ON x.source = y.source AND x.path <> y.path WHERE y.e <= 13)
SELECT doc_id AS document_id, coalesce((SELECT string_agg(link, ';' ORDER BY n) FROM near WHERE near.doc_id = p.doc_id AND n <= 12), '') AS related, coalesce((SELECT string_agg(link, ';' ORDER BY n) FROM same WHERE same.doc_id = p.doc_id AND n <= 12), '') AS editions FROM p"""
)
def bundle_links(spark: SparkSession, d: str) -> DataFrame:
    """The related concepts and series editions that each concept links to, in order."""
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["text"], F.lit(">"), x["path"])), ";").alias(c)
    return export.linked(export.concepts(_sources(spark, d))).select("document_id", shown("related"), shown("editions"))


@query(
    r"""WITH s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a-' || doc_id % 5 ELSE 'a-2-2' END AS stem FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY doc_id) - 1 AS j FROM s),
taken AS (SELECT base, list(k) AS ks FROM (SELECT DISTINCT regexp_extract(stem, '^(.*)-([2-9]|[1-9][0-9]+)$', 1) AS base, regexp_extract(stem, '^(.*)-([2-9]|[1-9][0-9]+)$', 2)::int AS k FROM s WHERE regexp_matches(stem, '^(.*)-([2-9]|[1-9][0-9]+)$')) GROUP BY 1)
SELECT doc_id AS document_id, 'x-general/' || stem || CASE WHEN j = 0 THEN '' ELSE '-' || list_filter(range(2, 40 + j), lambda f: NOT list_contains(coalesce(ks, []::int[]), f::int))[j] END || '.md' AS path FROM r LEFT JOIN taken ON base = stem"""
)
def bundle_paths_that_meet(spark: SparkSession, d: str) -> DataFrame:
    """Titles that are what numbering would make of others: no two paths meet."""
    docs = _sources(spark,
        d).withColumns({"title": F.expr("CASE document_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN concat('a ', document_id % 5) ELSE 'A 2 2' END"),
            "code": F.lit("x")})
    return export.concepts(docs).select("document_id", "path")


@query()
def bundle_files(spark: SparkSession, d: str) -> DataFrame:
    return export.bundle(_sources(spark, d))

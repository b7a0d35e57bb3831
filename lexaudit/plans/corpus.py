"""A corpus of policies and answers, built from the customer and orders tables by SQL that Spark and DuckDB both run.

The phrases are ASCII, so that engines agree on words, cases and lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import spread

NL = "chr(10)"

INTROS = ("Privacy Policy", "Terms of Service", "Service Agreement", "Project Proposal", "Annual Report", "Storage Notes")
COLLECTION = (
    "We collect the email address and phone number of every user of the platform.",
    "The app may record location and profile information. Tracking starts at once! Users must agree before they continue.",
    "Nothing is gathered here.",
    "Biometric and health data are processed by our data broker, a third party in another country.",
    "Customers can access, rectify and delete their account. Consent is optional? Yes, an opt-in is asked for.",
)
RETENTION = (
    "Records are kept indefinitely for trend analysis.",
    "Retention follows our privacy notice; the period ends after two years. Encryption protects every database.",
    "All data is retained as long as necessary, with no deletion policy in place.",
    "The controller documents compliance, security and accountability. An audit checks every breach notification.",
)
CLOSING = (
    "There is no opt-out and consent cannot be withdrawn.",
    "Automated profiling decides on every request.",
    "The data protection officer answers within thirty days.",
    "End of text.",
    "Use of the service means consent: users must agree to sharing and tracking, and the contract is a legal obligation.",
    "Contact us by email.",
    "A supervisory authority may audit the lawful basis, the rights of access and erasure, and the fine for a breach.",
)
PATTERNS = """Pattern: Unlimited Storage
Description: Data is kept without a limit in time
Indicators: "indefinitely", "as long as necessary", "no deletion policy"
Related Articles: Article 5(1)(e)

Pattern: Forced Consent
Description: Consent is a condition of use
Indicators: "must agree", "required to accept"
Related Articles: Article 7(4), Article 4(11)

Pattern: No Way Back
Description: Consent can't be taken back
Indicators: cannot be withdrawn, no opt-out
Related Articles: Article 7(3)

Pattern: Silent Profiling
Description: Decisions without people
Indicators: "automated profiling", "Biometric"
Related Articles: Article 22, Article 9

Not a pattern: too short"""
ARTICLES = """Preamble of the rules on data and consent.
Article 5(1)(e) - Storage limitation - Retention period
Personal data is kept no longer than the process needs. Storage and retention end in time.

Article 7 - Conditions for consent
Consent of the individual is asked for, and a right to access and delete data stays.
1. Records
The controller keeps a record of each transfer to a third entity.
DUTY OF CARE
Security and safeguard of confidential information.
2.1 Notice
A notice will inform the person, share the duration and disclose the control.
lower-case lines belong to the article above - with dashes
"""
TERMS = """# terms that point to personal data
personal data
email
phone
location
profile
tracking
biometric

collect
user
  third party
encryption
API
"""
KEYWORDS = """privacy
consent
# rights
rights
access
erasure
security
encryption
opt-in
opt-out
legal obligation
profiling
audit
breach
compliance
"""

ISSUES = (
    'The document keeps data without limit, violating storage limitation (Article 5(1)(e)). "Records are kept indefinitely"',
    'The document keeps data with no limit, violating storage limitation (Article 5(1)(f) and Article 32). "as long as necessary"',
    '"Users must agree" is a condition of use, violating Article 7.',
    'Consent cannot be withdrawn, the right ("no opt-out") is missing, violating Section 51',
    'Profiling is hidden from people. EXPLANATION: This violates transparency (Rule 12). "profiling decides"',
    'Profiling lacks a human check EXPLANATION: people can not object (22). "Automated profiling"',
    "short one",
)
POINTS = (
    'The document names an officer, supporting accountability (Article 37). "data protection officer"',
    'Encryption protects data EXPLANATION: security of processing is kept (Article 32). "Encryption protects every database"',
    "The audit is documented, as Standard 4.2 asks.",
)
STRUCTURED = (
    'COMPLIANCE ISSUES:\\nISSUE 1: Storage has no end\\nArticle: 5(1)(e)\\nConfidence: High\\nExplanation: It is kept for ever\\nCitation: "Records are kept indefinitely"\\n\\nISSUE 2: No consent\\nArticle: Section 7\\nConfidence: low\\nExplanation: Nobody is asked\\nCitation: the data subject has the right\\n\\nCOMPLIANCE POINTS:\\nnothing',
    'COMPLIANCE ISSUES:\\n- No officer is named\\nArticle 37\\nConfidence: High\\nExplanation: none is found\\nand none is asked\\nCitation: "our project team will decide"\\n2. Second item\\nmore words\\nCOMPLIANCE POINTS:\\n* Encryption is used\\nConfidence: medium',
    "COMPLIANCE POINTS:\\n1. All good\\nExplanation: because\\nGDPR Article 6",
    "No headings at all",
)

#: Answers in JSON; << and >> stand for braces, @A and @B for statements. Good, fenced, cut off, with a comma missing, without JSON, empty, with fields missing, with odd tags.
JSON_ANSWERS = (
    '<<"issues": [<<"issue": "@A", "regulation": "Article 5(1)(e)", "confidence": "High", "explanation": "why", "citation": "words">>, <<"issue": "@B", "regulation": "Article 7", "confidence": "low", "explanation": "", "citation": null>>], "topic_tags": ["data_retention", "consent"]>>',
    'Here it is:\\n```json\\n<<"issues": [<<"issue": "@A", "regulation": "Article 17", "confidence": "Medium", "explanation": "line break", "citation": "a [b]">>],\\n "topic_tags": ["data_retention", "erasure"]>>\\n```\\nDone.',
    '<<"topic_tags": ["Data Retention", "sharing"], "issues": [<<"issue": "@A", "regulation": "Article 5", "confidence": "High", "explanation": "e", "citation": "c">>, <<"issue": "@B", "regulation": "Arti',
    '<<"issues": [<<"issue": "@A", "regulation": "Article 32", "confidence": "High", "explanation": "e", "citation": "c">> <<"issue": "@B", "confidence": "High">>], "topic_tags": ["security", "data_retention"]>>',
    "No issue stands out in this section.",
    '<<"issues": [], "topic_tags": ["data_retention"]>>',
    '<<"issues": [<<"issue": "@A">>, <<"issue": "  ", "regulation": "Article 1">>, <<"issue": "@B", "regulation": " ", "confidence": "certain", "explanation": 5>>], "topic_tags": ["consent", "data_retention"]>>',
    '<<"issues": [<<"issue": "@A", "regulation": "Article 6", "confidence": "HIGH", "explanation": "e", "citation": "c">>], "topic_tags": ["Data-Retention", "data retention", " ", "SECURITY!"]>>',
)
CLAIMS = ("Records are kept for two years", "Records are never deleted", "Consent is asked for", "Consent cannot be withdrawn", "Data goes to third parties", "No data leaves the company", "Security measures are missing", "Every table is encrypted", "Users may erase their data")


def _pick(phrases, key: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''").replace("\\n", f"' || {NL} || '") + "'"
    return f"(CASE ({key}) % {len(phrases)} " + " ".join(f"WHEN {i} THEN {quote(p)}" for i, p in enumerate(phrases)) + " END)"


def _text(text: str) -> str:
    """SQL of a text with quotes and line ends."""
    return "'" + text.replace("'", "' || chr(39) || '").replace("\n", f"' || {NL} || '") + "'"


#: Rule files of a framework for each customer: framework (and term_type), text. Each has the same rules and some of its own.
PATTERN_FILES = f"""
SELECT 'f' || CAST(c_custkey AS VARCHAR(9)) AS framework, {_text(PATTERNS)} || {NL} || {NL} || repeat('Pattern: of ' || c_mktsegment || {NL} || 'Description: found at ' || c_name || {NL}
|| 'Indicators: ' || CASE WHEN c_custkey % 2 = 0 THEN '"' || c_name || '", "x"' ELSE c_name || ', y, z' END || {NL} || 'Related Articles: Article ' || CAST(c_custkey % 9 AS VARCHAR(9)) || {NL} || {NL}, c_custkey % 4) AS text FROM {{customer}}
"""
ARTICLE_FILES = f"""
SELECT 'f' || CAST(c_custkey AS VARCHAR(9)) AS framework, {_text(ARTICLES)} || repeat('Article ' || CAST(c_custkey AS VARCHAR(9)) || ' - Duties of ' || c_name || {NL} || 'Consent and data of ' || c_mktsegment || {NL}, c_custkey % 3) AS text FROM {{customer}}
"""
TERM_FILES = f"""
SELECT 'f' || CAST(c_custkey AS VARCHAR(9)) AS framework, CASE WHEN c_custkey % 2 = 0 THEN 'data_terms' ELSE 'regulatory_keywords' END AS term_type,
CASE WHEN c_custkey % 2 = 0 THEN {_text(TERMS)} ELSE {_text(KEYWORDS)} END || '# of ' || c_name || {NL} || ' ' || c_mktsegment || {NL} || {NL} || 'phone ' || CAST(c_custkey AS VARCHAR(9)) AS text FROM {{customer}}
"""

#: doc_id, path, n_bytes, text. Headers of all kinds, blank-line paragraphs, short and long sections, texts without headers.
AUDIT_DOCS = f"""
SELECT doc_id, path, CAST(length(text) AS BIGINT) AS n_bytes, text FROM (
SELECT c_custkey AS doc_id, 'docs/set' || CAST(c_custkey % 7 AS VARCHAR(9)) || '/' || c_name || CASE c_custkey % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' ELSE '.TXT' END AS path,
CASE WHEN c_custkey % 11 = 0 THEN {_pick(COLLECTION, 'c_custkey')} || {NL} || {NL} || {_pick(CLOSING, 'c_custkey')} ELSE
CASE WHEN c_custkey % 4 = 0 THEN '' ELSE {_pick(INTROS, 'c_custkey')} || ' of ' || c_name || {NL} || {NL} END
|| '1. Data Collection' || {NL} || {_pick(COLLECTION, 'c_custkey')} || {NL} || {NL} || {_pick(COLLECTION, 'c_custkey + 2')} || {NL} || {NL}
|| repeat({_pick(RETENTION, 'c_custkey')} || {NL} || {NL}, c_custkey % 13) || {NL}
|| 'DATA USAGE' || {NL} || {_pick(CLOSING, 'c_custkey')} || {NL} || '2.1 Details are given below' || {NL} || {_pick(RETENTION, 'c_custkey + 1')} || {NL}
|| 'Final Terms:' || {NL} || repeat({_pick(CLOSING, 'c_custkey * 3')} || ' ', 1 + c_custkey % 9) || {NL} || {NL} || ' ' || {NL} || c_mktsegment
|| {NL} || '3. Notes' || {NL} || '4. Next' || {NL} || {_pick(CLOSING, 'c_custkey + 4')} END AS text
FROM {{customer}}) t
"""

#: doc_id, chunk_index, position, should_analyze, response. Fences, missing headings, repeated and empty items, odd references.
AUDIT_RESPONSES = f"""
SELECT o_custkey AS doc_id, CAST(o_orderkey AS INT) AS chunk_index, 'Section ' || CAST(o_orderkey % 5 AS VARCHAR(9)) AS position, o_orderkey % 4 <> 0 AS should_analyze,
CASE WHEN o_orderkey % 17 = 0 THEN '```' || {NL} || 'COMPLIANCE ISSUES:' || {NL} || '1. All of it is fenced in' || {NL} || '```'
WHEN o_orderkey % 19 = 0 THEN 'NO COMPLIANCE ISSUES DETECTED.' || {NL} || 'COMPLIANCE POINTS:' || {NL} || '1. ' || {_pick(POINTS, 'o_orderkey')}
WHEN o_orderkey % 23 = 0 THEN 'No headings, just words.'
ELSE 'Here it is.' || {NL} || 'COMPLIANCE ISSUES:' || {NL} || '1. ' || {_pick(ISSUES, 'o_orderkey')} || {NL} || {NL} || '2. ' || {_pick(ISSUES, 'o_orderkey * 3 + 1')} || {NL} || '3.5 is not an item' || {NL}
|| 'COMPLIANCE POINTS:' || {NL} || CASE WHEN o_orderkey % 6 = 0 THEN 'NO COMPLIANCE POINTS DETECTED.' ELSE '1. ' || {_pick(POINTS, 'o_orderkey')} || {NL} || 'and more.' END END AS response
FROM {{orders}}
"""

#: doc_id, response of the field format.
AUDIT_STRUCTURED = f"SELECT o_orderkey AS doc_id, {_pick(STRUCTURED, 'o_orderkey')} AS response FROM {{orders}}"

#: doc_id, chunk_index, position, should_analyze, response of the JSON format: documents of many sections, most of which share a tag.
AUDIT_JSON = f"""
SELECT o_custkey % 40 AS doc_id, CAST(o_orderkey AS INT) AS chunk_index, 'Section ' || CAST(o_orderkey % 9 AS VARCHAR(9)) AS position, o_orderkey % 13 <> 0 AS should_analyze,
replace(replace(replace(replace({_pick(JSON_ANSWERS, 'o_orderkey')}, '@A', {_pick(CLAIMS, 'o_orderkey * 5 + o_custkey')}), '@B', {_pick(CLAIMS, 'o_orderkey * 3 + 1')}), '<<', chr(123)), '>>', chr(125)) AS response FROM {{orders}}
"""

#: Findings with all confidences and repeated descriptions: the columns of parsed findings.
AUDIT_FINDINGS = f"""
SELECT o_custkey AS doc_id, CAST(o_orderkey AS INT) AS chunk_index, CASE WHEN o_orderkey % 3 = 0 THEN 'point' ELSE 'issue' END AS kind, 0 AS ord,
CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE {_pick(ISSUES, 'o_orderkey % 5')} END AS description,
{_pick(('Article 5(1)(e)', 'Section 51', 'Articles 15-20', 'Article 5(1)(f)', 'Unknown Regulation'), 'o_orderkey')} AS regulation,
{_pick(('Medium', 'HIGH', 'low', 'Medium', 'unsure'), 'o_orderkey * 7')} AS confidence,
{_pick(('"quote one"', 'No specific quote provided.', ''), 'o_orderkey')} AS citation, {_pick(('', 'because'), 'o_orderkey')} AS explanation,
'Section ' || CAST(o_orderkey % 5 AS VARCHAR(9)) AS section, o_orderkey % 4 <> 0 AS should_analyze
FROM {{orders}}
"""


#: Findings of chunks that hold several: the columns of parsed findings, four chunks a document.
REPORT_FINDINGS = f"SELECT doc_id, CAST(chunk_index % 4 AS INT) AS chunk_index, kind, chunk_index AS ord, description, regulation, confidence, citation, explanation, section, should_analyze FROM ({AUDIT_FINDINGS}) t"

#: The chunks of those findings.
REPORT_CHUNKS = """
SELECT c_custkey AS doc_id, i AS chunk_index, 'Section ' || CAST(i AS VARCHAR(9)) AS position, c_name || ' of ' || c_mktsegment AS text, (c_custkey + i) % 4 <> 0 AS should_analyze
FROM {customer} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) n
"""


#: Bytes of a table's file whose texts a task builds: about 10,000 customers or 20,000 orders, some 20 MB of text.
TASK_BYTES = {"customer": 200_000, "orders": 400_000}
#: Files that a task makes before it hands them on.
TASK_FILES = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A corpus table. Its long texts are built after the short rows are spread over the cores."""
    name, key = ("customer", "c_custkey") if "{customer}" in sql else ("orders", "o_orderkey")
    return spark.sql(sql, **{name: spread(table(spark, sf_dir, name), key, task_bytes=TASK_BYTES[name])})


def literal(spark: SparkSession, **columns: str) -> DataFrame:
    """One row of texts."""
    return spark.range(1).selectExpr(*("'" + v.replace("\\", "\\\\").replace("'", "\\'") + f"' AS {k}" for k, v in columns.items()))


def make_pdf(pages: list[str], packed: bool = False) -> bytes:
    """A PDF file of these texts. ``packed``: objects lie in an object stream, places in a cross-reference stream."""
    flate = lambda data, entries="": f"<< /Length {len(z := zlib.compress(data))} /Filter /FlateDecode {entries} >>\nstream\n".encode() + z + b"\nendstream"
    chars = sorted(set("".join(pages)) - {"\n"})
    codes = {c: f"{i + 1:04X}" for i, c in enumerate(chars)}
    listed = "".join(f"<{codes[c]}> <{c.encode('utf-16-be').hex()}>\n" for c in chars)
    plain = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type0 /BaseFont /F /Encoding /Identity-H /ToUnicode 4 0 R >>"}
    streams = {4: flate(f"begincmap\n{len(chars)} beginbfchar\n{listed}endbfchar\nendcmap".encode())}
    kids = []
    for i, text in enumerate(pages):
        lines = " T*\n".join("<" + "".join(codes[c] for c in line) + "> Tj" if line else "" for line in text.split("\n"))
        streams[6 + 2 * i] = flate(f"BT /F1 10 Tf 12 TL 50 800 Td\n{lines}\nET".encode() if text else b"q Q")
        plain[5 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Contents {6 + 2 * i} 0 R >>".encode()
        kids.append(f"{5 + 2 * i} 0 R")
    plain[2] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(kids)}] /Resources << /Font << /F1 3 0 R >> >> >>".encode()
    size, out, places = 5 + 2 * len(pages), bytearray(b"%PDF-1.5\n"), {}
    if packed:
        order = sorted(plain)
        starts = [sum(len(plain[n]) + 1 for n in order[:k]) for k in range(len(order))]
        head = " ".join(f"{n} {at}" for n, at in zip(order, starts)).encode() + b"\n"
        streams[size] = flate(head + b"\n".join(plain[n] for n in order), f"/Type /ObjStm /N {len(order)} /First {len(head)}")
        size += 1
    for n, body in sorted((streams if packed else {**plain, **streams}).items()):
        places[n] = len(out)
        out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
    start = len(out)
    if packed:
        places[size] = start
        entry = lambda n: bytes([1]) + places[n].to_bytes(4, "big") + b"\0\0" if n in places else bytes([2]) + (size - 1).to_bytes(4, "big") + order.index(n).to_bytes(2, "big") if n else bytes(7)
        rows = b"".join(b"\2" + bytes((a - b) & 255 for a, b in zip(entry(n), entry(n - 1) if n else bytes(7))) for n in range(size + 1))
        body = flate(rows, f"/Type /XRef /Size {size + 1} /W [1 4 2] /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 7 >>")
        out += f"{size} 0 obj\n".encode() + body + b"\nendobj\n"
    else:
        out += f"xref\n0 {size}\n0000000000 65535 f \n".encode() + b"".join(f"{places[n]:010d} 00000 n \n".encode() for n in range(1, size))
        out += f"trailer\n<< /Size {size} /Root 1 0 R >>\n".encode()
    return bytes(out + f"startxref\n{start}\n%%EOF\n".encode())


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, length, content: each conversation as a PDF file, a page for each turn; every second one is packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, TASK_FILES) for b in batches for at in range(0, len(b), TASK_FILES)):
            files = [make_pdf([t["text"] or "" for t in turns], conv % 2 == 1) for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([len(f) for f in files]), pa.array(files, pa.binary())], names=["path", "length", "content"])

    turns = F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns")
    rows = table(spark, sf_dir, "conversations").where("conv_id is not null").groupBy("conv_id").agg(turns).withColumn("path", F.concat(F.col("conv_id").cast("string"), F.lit(".pdf")))
    return rows.mapInArrow(run, "path string, length long, content binary")

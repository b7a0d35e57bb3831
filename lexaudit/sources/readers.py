"""Documents, page tables, regulation articles, term lists, violation patterns and catalogues as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.values import ARTICLE_STARTS, CONCEPTS, DEFAULT_DATA_TERMS, DEFAULT_REGULATORY_TERMS, FRAMEWORK_FILES, MODELS
from .pdf import read_pdf_pages

#: Fewer bytes are not worth a shuffle.
SPREAD_BYTES = 100_000
#: Tasks that rows are spread over at most.
MAX_TASKS = 20_000


def scanned_bytes(*tables: DataFrame) -> int | None:
    """The size of what the plans of tables read, by Spark's estimate (that of a join would be a product); None if any isn't known."""
    sizes = []
    for rows in tables:
        leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes += [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length())]
    return None if max(sizes) >= 1 << 60 else sum(sizes)


def spread(rows: DataFrame, *keys: str, task_bytes: int | None = None) -> DataFrame:
    """The rows over at least as many partitions as there are cores, each of up to ``task_bytes`` by Spark's estimate, where a scan gives fewer and their size isn't below ``SPREAD_BYTES``.

    For a few files or row groups that hold many documents, before costly work on each of them: the number of tasks grows with the table, and none of them. By default a
    task takes what a scan's does, so a table that fills the cores is left as it is; rows that become long texts want a smaller ``task_bytes``.
    """
    spark = rows.sparkSession
    cores, split = spark.sparkContext.defaultParallelism, int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = min(max(cores, -(-size // min(task_bytes or split, split))), MAX_TASKS)  # a size that isn't known counts as huge
    return rows.repartition(n, *keys) if SPREAD_BYTES <= size and n > -(-size // split) else rows


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """doc_id (the path), path, n_bytes, text of whole UTF-8 text and Markdown files. A missing path is an error of Spark."""
    rows = spark.read.text(paths, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("n_bytes"), F.col("value").alias("text"))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """doc_id, path, n_bytes, text of text, Markdown and PDF files, each read by its own extension; an error names files of other kinds."""
    kinds = {".txt": [], ".md": [], ".pdf": []}
    for path in paths:
        ext = next((e for e in kinds if path.lower().endswith(e)), None)
        if ext is None:
            raise ValueError(f"Unsupported file format: {path}")
        kinds[ext].append(path)
    found = []
    if kinds[".txt"] or kinds[".md"]:
        found.append(read_documents(spark, kinds[".txt"] + kinds[".md"]))
    if kinds[".pdf"]:
        pages = read_pdf_pages(spark, kinds[".pdf"])
        found.append(join_pages(pages, ["doc_id", "path", "n_bytes"]))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def join_pages(pages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The keys (doc_id) and text: the non-empty pages in order, each after its number and before a blank line."""
    page = F.struct("page", F.format_string("[Page %d] %s\n\n", F.col("page"), F.col("text")).alias("text"))
    full = F.sort_array(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", page)))
    return pages.groupBy(*(keys or ["doc_id"])).agg(F.array_join(F.transform(full, lambda p: p["text"]), "").alias("text"))


def concepts(text: Column) -> Column:
    """The sorted concepts that occur as whole words. They are single words, so one pass of their alternation finds each."""
    return T.distinct_words(text, CONCEPTS)


def starts_article(line: Column) -> Column:
    bare = T.strip(line)
    return bare.rlike("(?Ud)\\A(?:" + "|".join(ARTICLE_STARTS) + ")")


def parse_articles(files: DataFrame) -> DataFrame:
    """framework, art_ord, id, title, text, related_concepts from (framework, text).

    A line that looks like a heading starts an article; its first `` - `` parts id and title. Lines before the first heading are
    an article without id. Concepts of the title and of the other lines are kept per line, with repetitions.
    """
    lines = files.select("framework", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumn("starts", starts_article(F.col("line")))
    group = F.sum(F.col("starts").cast("int")).over(Window.partitionBy("framework").orderBy("line_no"))
    title = T.strip(F.coalesce(F.get(F.split("line", " - ", 2), 1), F.lit("")))
    tagged = lines.withColumn("art", group).withColumn("tags", F.when(F.col("starts"), concepts(title)).otherwise(concepts(F.col("line"))))
    rows = F.sort_array(F.collect_list(F.struct("line_no", "line", "tags")))
    out = tagged.groupBy("framework", "art").agg(
        F.coalesce(F.max(F.when(F.col("starts"), T.strip(F.split("line", " - ", 2)[0]))), F.lit("")).alias("id"),
        F.coalesce(F.max(F.when(F.col("starts"), title)), F.lit("")).alias("title"),
        rows.alias("rows"),
    )
    order = F.row_number().over(Window.partitionBy("framework").orderBy("art")) - 1
    return out.select("framework", order.cast("int").alias("art_ord"), "id", "title", F.concat(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n")).alias("text"), F.flatten(F.transform("rows", lambda r: r["tags"])).alias("related_concepts"))


def parse_terms(files: DataFrame) -> DataFrame:
    """framework, term_type, term_ord, term from (framework, term_type, text): stripped lines; blank lines and lines that start with # are left out."""
    lines = files.select("framework", "term_type", F.posexplode(F.split("text", "\r?\n", -1)).alias("term_ord", "line"))
    kept = lines.where(~F.startswith("line", F.lit("#"))).withColumn("term", T.strip(F.col("line"))).where("term <> ''")
    return kept.select("framework", "term_type", "term_ord", "term")


def terms_of(terms: DataFrame, framework: str, term_type: str, max_terms: int = 10_000) -> list[str]:
    """The list of a framework, or the default list if it has none."""
    rows = terms.where((F.col("framework") == framework) & (F.col("term_type") == term_type)).orderBy("term_ord").select("term").limit(max_terms + 1).collect()
    if len(rows) > max_terms:
        raise ValueError(f"more than {max_terms} terms: use join_terms")
    return [r.term for r in rows] or list(DEFAULT_DATA_TERMS if term_type == "data_terms" else DEFAULT_REGULATORY_TERMS if term_type == "regulatory_keywords" else ())


def parse_patterns(files: DataFrame) -> DataFrame:
    """framework, pattern_ord, pattern, description, indicators, related_refs from (framework, text).

    Blocks are separated by blank lines and have three lines or more. Indicators are the quoted phrases, or else the parts between commas.
    """
    blocks = files.select("framework", F.posexplode(F.split("text", "\n\n", -1)).alias("pattern_ord", "block"))
    lines = F.split(T.strip(F.col("block")), "\n", -1)
    blocks = blocks.withColumn("lines", lines).where(F.size("lines") >= 3)

    def field(start: str, label: str) -> Column:
        own = F.filter("lines", lambda x: F.startswith(x, F.lit(start)))
        return T.strip(F.replace(F.get(own, F.size(own) - 1), F.lit(label), F.lit("")))

    listed = field("Indicators:", "Indicators:")
    parts = lambda c: F.transform(F.split(c, ",", -1), T.strip)
    related = F.regexp_replace(field("Related", ""), r"\ARelated[^:]*:\s*", "")
    indicators = F.when(F.contains(listed, F.lit('"')), F.regexp_extract_all(listed, F.lit('"([^"]*)"'), F.lit(1))).otherwise(parts(listed))
    rows = blocks.select("framework", F.col("pattern_ord").cast("int").alias("pattern_ord"), field("Pattern:", "Pattern:").alias("pattern"), field("Description:", "Description:").alias("description"), F.coalesce(indicators, F.array().cast("array<string>")).alias("indicators"), F.coalesce(parts(related), F.array().cast("array<string>")).alias("related_refs"))
    return rows.where("pattern is not null and size(indicators) > 0")


def count_patterns(text: Column) -> Column:
    return F.regexp_count(text, F.lit("Pattern:"))


def read_frameworks(spark: SparkSession, path: str) -> DataFrame:
    """id, name, version, region, description of the frameworks in a JSON catalogue."""
    schema = "frameworks array<struct<id:string,name:string,version:string,region:string,description:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("frameworks"))


def missing_files(frameworks: DataFrame, present: DataFrame) -> DataFrame:
    """The expected files of each framework that are not in ``present`` (id, file)."""
    expected = frameworks.select("id", F.explode(F.array(*map(F.lit, FRAMEWORK_FILES))).alias("file"))
    return expected.join(present, ["id", "file"], "left_anti")


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "key string, name string, batch_size int, context_window int, temperature double, description string")

"""Readers with declared schemas.  Paths are parameters; all reading is done by Spark sources."""

from __future__ import annotations

import fnmatch
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom import schemas
from claimloom.functions import text as X
from claimloom.operators import keyed

PDF_MAGIC = "%PDF-"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def folder_name(path: Column) -> Column:
    """The folder a file lies in, without the folders above."""
    return F.regexp_extract(path, r"([^/\\\\]*)[/\\\\][^/\\\\]*$", 1)


def whole_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(path, file, value): one row per matching file below a folder, its whole text as one value."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), "value")


def catalogue_manifest_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per manifest file (folder/manifest.json, over as many lines as it likes); unreadable ones keep their text in ``_corrupt_record``."""
    files = whole_files(spark, path, "manifest.json")
    return parse_manifests(files.select(folder_name(F.col("path")).alias("folder"), F.col("value").alias("json")))


def catalogue_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of JSON-lines manifests; unreadable ones keep their text in ``_corrupt_record``."""
    raw = spark.read.schema(schemas.CATALOGUE_JSON).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return raw.withColumn("folder", file_name(F.col("_metadata.file_path")))


def parse_manifests(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """Manifest texts (folder, json) as nested columns; text that is no manifest goes to ``_corrupt_record``."""
    parsed = F.from_json(json_col, schemas.CATALOGUE_JSON, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return rows.select("folder", parsed.alias("_m")).select("folder", "_m.*")


def corpus_records(spark: SparkSession, path: str, kind: str, partition: str | None = None, one_per_file: bool = False) -> DataFrame:
    """Records stored under kind=/partition= folders, a line each or a file each; both filters prune folders, not rows."""
    rows = spark.read.text(path, wholetext=one_per_file).filter(F.col("kind") == kind)
    return rows.filter(F.col("partition") == partition) if partition else rows


#: Files of a run that hold no prediction.
RUN_REPORTS = ["run_manifest.json", "summary.json", "training_manifest.json"]


def prediction_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(path, id, json) for every JSON file below a folder that is not a run report.

    The id is the document's ``reference_id``, or the file name without its ending.
    """
    rows = whole_files(spark, path, pattern).filter(~F.col("file").isin(*RUN_REPORTS))
    given = F.nullif(X.strip(F.get_json_object("value", "$.reference_id")), F.lit(""))
    return rows.select("path", F.coalesce(given, F.regexp_replace("file", r"\.json$", "")).alias("id"), F.col("value").alias("json"))


def prediction_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, json) for every line of the JSON-lines files below a folder that are no run reports."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path)
    return rows.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file")).filter(
        ~F.col("file").isin(*RUN_REPORTS)
    ).select("path", F.col("value").alias("json"))


def manifest_csv(spark: SparkSession, path: str, schema=schemas.MANIFEST_CSV) -> DataFrame:
    """Discovery manifest: blanks are nulls, ids stay text."""
    return spark.read.schema(schema).option("header", "true").option("nullValue", "").option("escape", '"').option(
        "multiLine", "true").csv(path)


def newest_file(files: DataFrame, pattern: str = r"^discover_.*\.csv$") -> DataFrame:
    """The most recently modified matching file of a listing (path, modificationTime); '' when none."""
    hits = files.filter(file_name(F.col("path")).rlike(pattern))
    return hits.agg(F.coalesce(F.max_by("path", F.struct("modificationTime", "path")), F.lit("")).alias("path"))


def file_listing(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(path, modificationTime, length[, content]) of every file below a folder; content is not read unless asked."""
    columns = ["path", "modificationTime", "length"] + (["content"] if content else [])
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(*columns)


def literature_csv(spark: SparkSession, path: str, pattern: str = "pubmed_result*.csv") -> DataFrame:
    """(pmid, title, abstract, source): headers matched without case; ids of 5-9 digits; first row of an id wins.

    Every file has its own header: files are read together with those that have
    the same header line, under its names.  File names match without case.
    """
    wanted = F.lower(F.col("_metadata.file_name")).rlike(fnmatch.translate(pattern.lower()))
    lines = spark.read.option("recursiveFileLookup", "true").text(path).filter(wanted)
    firsts = lines.select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("_at"))
    groups: dict[str, list[str]] = defaultdict(list)
    for row in firsts.groupBy("file").agg(F.min_by("value", "_at").alias("header")).orderBy("file").toLocalIterator():
        groups[row["header"]].append(row["file"])
    parts = [_literature_rows(spark, files) for _, files in sorted(groups.items())]
    if not parts:
        return spark.createDataFrame([], "pmid string, title string, abstract string, source string")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return keyed.first_per_key(rows, ["pmid"], ["source", "_row"]).drop("_row")


def _literature_rows(spark: SparkSession, files: list[str]) -> DataFrame:
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(files)
    names: dict[str, str] = {}
    for column in raw.columns:
        names.setdefault(column.lower().strip("\ufeff "), column)
    abstract = names.get("abstract") or names.get("abstracttext")
    if "pmid" not in names:
        raise ValueError(f"no pmid column in {files[0]}")
    return raw.select(
        F.regexp_replace(X.coalesce_blank(F.col(f"`{names['pmid']}`")), "[^0-9]", "").alias("pmid"),
        (X.squeeze(F.col(f"`{names['title']}`")) if "title" in names else F.lit("")).alias("title"),
        (X.squeeze(F.col(f"`{abstract}`")) if abstract else F.lit("")).alias("abstract"),
        F.col("_metadata.file_path").alias("source"),
        F.monotonically_increasing_id().alias("_row"),
    ).filter(F.col("pmid").rlike("^[0-9]{5,9}$"))


def plain_text(value: Column) -> Column:
    """An XML element's text: where it holds inline markup, tags go and the five entities are decoded."""
    text = F.regexp_replace(value, r"</?[A-Za-z][^<>]*>", "")
    for mark, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return F.when(value.rlike(r"<[A-Za-z/][^<>]*>"), text).otherwise(value)


def article_xml(spark: SparkSession, path: str) -> DataFrame:
    """PubMed-style article records as flat metadata."""
    raw = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(schemas.ARTICLE_XML).load(path)
    article = F.col("MedlineCitation.Article")
    ids = F.col("PubmedData.ArticleIdList.ArticleId")
    date = article["Journal"]["JournalIssue"]["PubDate"]

    def identifier(kind: str) -> Column:
        return X.coalesce_blank(F.get(F.filter(ids, lambda x: F.lower(x["_IdType"]) == kind), F.lit(0))["_VALUE"])

    authors = F.filter(
        F.transform(
            F.coalesce(article["AuthorList"]["Author"],
                       F.array().cast("array<struct<LastName:string,ForeName:string>>")),
            lambda a: F.when(X.present(a["ForeName"]) & X.present(a["LastName"]),
                             F.concat_ws(" ", a["ForeName"], a["LastName"])).otherwise(X.coalesce_blank(a["LastName"])),
        ),
        lambda n: n != "",
    )
    return raw.select(
        F.col("MedlineCitation.PMID").alias("pmid"),
        F.regexp_replace(X.coalesce_blank(plain_text(article["ArticleTitle"])), r"\s+", " ").alias("title"),
        F.regexp_replace(F.array_join(F.transform(F.coalesce(article["Abstract"]["AbstractText"], X.literal_array([])), plain_text), " "), r"\s+", " ")
        .alias("abstract"),
        X.coalesce_blank(article["Journal"]["Title"]).alias("journal"),
        F.coalesce(F.nullif(date["Year"], F.lit("")), F.regexp_extract(X.coalesce_blank(date["MedlineDate"]), "^([0-9]{4})", 1))
        .alias("year"),
        identifier("doi").alias("doi"),
        X.strip_pmc(identifier("pmc")).alias("pmcid"),
        authors.alias("authors"),
    )


#: Windows-1252 is ISO-8859-1 but for these 32 code points; the five that it leaves open become the replacement character.
_C1 = bytes(range(0x80, 0xA0))
_LATIN_C1, _WINDOWS_C1 = _C1.decode("latin-1"), _C1.decode("cp1252", "replace")


def decode_text(content: Column) -> Column:
    """Bytes as text: NULs and a UTF-8 mark dropped, valid UTF-8 kept, anything else read as windows-1252."""
    hexed = F.hex(content)
    pairs = F.filter(F.regexp_extract_all(hexed, F.lit("(..)"), F.lit(1)), lambda p: p != "00")
    clean = F.when(F.contains(hexed, F.lit("00")), F.unhex(F.array_join(pairs, ""))).otherwise(content)
    marked = F.startswith(F.hex(clean), F.lit("EFBBBF"))
    body = F.when(marked, F.substring(clean, F.lit(4), F.length(clean))).otherwise(clean)
    # F.substring of BINARY is BINARY; only the invalid branch is decoded as a legacy page.
    legacy = F.translate(F.decode(body, "ISO-8859-1"), _LATIN_C1, _WINDOWS_C1)
    return F.when(F.is_valid_utf8(body.cast("string")), body.cast("string")).otherwise(legacy)


def encode_windows(text: Column) -> Column:
    """Text as windows-1252 bytes; null if a character has no place there."""
    known = [(w, c) for w, c in zip(_WINDOWS_C1, _LATIN_C1) if w != "\ufffd"]
    moved = F.translate(text, "".join(w for w, _ in known), "".join(c for _, c in known))
    fits = ~text.rlike(f"[{_LATIN_C1[0]}-{_LATIN_C1[-1]}]") & ~moved.rlike(r"[^\x00-\xFF]")
    return F.when(fits, F.encode(F.when(fits, moved), "ISO-8859-1"))


def looks_like_pdf(content: Column, length: Column | None = None, least: int = 1000) -> Column:
    magic = F.coalesce(F.substring(content, 1, 5) == F.to_binary(F.lit(PDF_MAGIC), F.lit("utf-8")), F.lit(False))
    return magic & (length > least) if length is not None else magic


def inbox_state(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Each manual request with status complete (a real PDF is in place) or pending."""
    state = files.select(F.col("path").alias("destination"), looks_like_pdf(F.col("content"), F.col("length")).alias("_ok"))
    joined = requests.join(state, "destination", "left")
    return joined.withColumn(
        "status", F.when(F.coalesce("_ok", F.lit(False)), F.lit("complete")).otherwise(F.lit("pending"))
    ).drop("_ok")


def supplements(files: DataFrame) -> DataFrame:
    return files.filter(F.col("path").rlike(r"(?i)\.(ctl|mod|txt|csv|zip)$"))


def supplement_text(files: DataFrame, group: str, max_chars: int = 80_000, salts: int = 64) -> DataFrame:
    """Text supplements per group, each under its name, in path order, cut at the limit.

    A file matters only while the text before it is shorter than the limit.
    That is tested first within (group, salt), where the running length can
    only be smaller than the true one, so a huge group is thinned by many
    tasks to at most salts * limit characters before it is put in order.
    """
    texts = files.filter(F.col("path").rlike(r"(?i)\.(ctl|mod|txt)$")).select(
        group, "path", F.concat(F.lit("--- "), file_name(F.col("path")), F.lit(" ---\n"), F.col("text")).alias("piece"),
        F.pmod(F.xxhash64("path"), F.lit(salts)).alias("_salt"),
    )
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)

    def thin(df: DataFrame, *keys: str) -> DataFrame:
        earlier = F.coalesce(F.sum(F.length("piece") + 2).over(before.partitionBy(*keys)), F.lit(0))
        return df.withColumn("_before", earlier).filter(F.col("_before") <= max_chars)

    kept = thin(thin(texts, group, "_salt"), group)
    joined = kept.groupBy(group).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "piece"))), lambda s: s["piece"]), "\n\n").alias("text")
    )
    return joined.withColumn("text", X.cap_text("text", max_chars, "\n[SUPPLEMENT TRUNCATED]"))


def training_examples(spark: SparkSession, path: str) -> DataFrame:
    """Exported JSON lines; blank lines are skipped by the source."""
    return spark.read.schema(schemas.TRAINING_JSON).json(path)


def model_lines(entries: DataFrame, text_col: str = "model_text") -> DataFrame:
    """(library_id, line_no, line) of the control stream; a missing one is an error row with a null line."""
    text = F.col(text_col)
    lines = F.when(text.isNotNull(), F.split(text, "\n")).otherwise(F.array(F.lit(None).cast("string")))
    return entries.select("library_id", F.posexplode(lines).alias("at", "line")).select(
        "library_id", (F.col("at") + 1).alias("line_no"), "line"
    )


def source_pdf(entries: DataFrame, files: DataFrame) -> DataFrame:
    """First existing PDF per entry: bundle source, then acquisition path, then inbox; '' when none.

    entries: (library_id, bundle_path, acquisition_path, inbox_path); files: (path).
    """
    candidates = F.array("bundle_path", "acquisition_path", "inbox_path")
    rows = entries.select("library_id", F.posexplode(candidates).alias("priority", "path")).filter(
        X.present("path") & F.col("path").rlike(r"(?i)\.pdf$")
    )
    hit = rows.join(files.select("path").distinct(), "path").groupBy("library_id").agg(F.min_by("path", "priority").alias("pdf"))
    return entries.select("library_id").join(hit, "library_id", "left").withColumn("pdf", X.coalesce_blank("pdf"))


def register_documents(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """Content-addressed bundles: the key is (identifier, first 16 hex digits); a known key is reused.

    incoming: (pmid, sha256, parse_ok); the registry holds (identifier, sha16).
    """
    sha16 = F.substring("sha256", 1, 16)
    keyed_rows = incoming.withColumns({
        "sha16": sha16,
        "identifier": F.when(X.present("pmid"), F.col("pmid")).otherwise(sha16),
    })
    known = registry.select("identifier", "sha16").distinct().withColumn("reused", F.lit(True))
    out = keyed_rows.join(known, ["identifier", "sha16"], "left")
    return out.withColumns({
        "reused": F.coalesce("reused", F.lit(False)),
        "fallback": ~F.coalesce("parse_ok", F.lit(False)),
        "parser": F.when(F.coalesce("parse_ok", F.lit(False)), F.lit("primary")).otherwise(F.lit("text_fallback")),
    })

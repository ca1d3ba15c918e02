"""The index as partitioned Parquet: builds by version, checks, export, migration (SNK-1..3, 7, 9, 12, SRC-15, 16, VER-1).

A build writes snippets, document frequencies and vectors of its version first and
the row of ``versions`` last. That row is the commit: readers only take versions
that have one, so a build that dies half-way is never seen, and the next build of
the version writes its partitions anew. The folder may lie on any file system
Spark can reach; properties are a table of one row (``meta``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import code as C
from quern.functions import text as T
from quern.operators.encode import Encoder, HashingEncoder

SCHEMA = "2"
TABLES = ("snippets", "vectors", "df", "versions")
#: Columns a schema added to snippets, with what older rows get.
ADDED = {"2": {"lang": "''", "identifiers": "CAST(array() AS array<string>)"}}


class NotAnIndex(ValueError):
    """The folder holds no index of this schema."""


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def check_folder(spark: SparkSession, folder: str, schema: str | None = SCHEMA) -> dict:
    """The index's properties; a missing or foreign folder is an error, and nothing is created."""
    if not exists(spark, f"{folder}/meta/_SUCCESS"):
        raise NotAnIndex(f"no index in {folder}")
    meta = spark.read.parquet(f"{folder}/meta").first().asDict()
    if schema is not None and meta["schema"] != schema:
        raise NotAnIndex(f"the index in {folder} has schema {meta['schema']}, not {schema}: migrate it")
    return meta


def _write_meta(spark: SparkSession, folder: str, meta: dict) -> None:
    spark.createDataFrame([meta], "schema string, encoder string, kind string, views array<string>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """(version, built_at, snippets) of the versions whose build came to its end."""
    return spark.read.schema("built_at timestamp, snippets bigint, version string").parquet(f"{folder}/versions")


def is_committed(spark: SparkSession, folder: str, version: str) -> bool:
    return exists(spark, f"{folder}/versions") and not committed(spark, folder).where(F.col("version") == version).isEmpty()


def build(
    spark: SparkSession, corpus: DataFrame, folder: str, version: str, kind: str = "", views: tuple[str, ...] = ("nl", "code"),
    encoder: Encoder | None = None, chunking: T.Chunking = T.Chunking(), reset: bool = False,
) -> dict:
    """Write one version of corpus (id, text): that version's partitions are replaced, others stay; vectors are made of new texts only."""
    encoder = encoder or HashingEncoder()
    if reset:
        _delete(spark, folder)
    known = check_folder(spark, folder) if exists(spark, f"{folder}/meta") else {}
    same_encoder = known.get("encoder") == encoder.signature
    if not known or not same_encoder:
        _write_meta(spark, folder, {"schema": SCHEMA, "encoder": encoder.signature, "kind": kind, "views": list(views)})
    if exists(spark, f"{folder}/versions"):
        _delete(spark, f"{folder}/versions/version={version}")  # what is written from here on is not seen before its row is back
    p = C.parsed(F.col("text"))
    rows = corpus.withColumn("p", p).withColumn("category", C.category(F.col("p")))
    rows = rows.withColumn("doc", C.enriched(F.col("text"), F.col("p"))).withColumn("views", C.views(F.col("text"), F.col("p"), F.col("category"), F.col("doc"), views))
    keyed = rows.withColumn("vkeys", F.transform_values("views", lambda k, v: T.vector_key(T.chunks(v, chunking))))
    snippets = keyed.select(
        "id", F.lit(version).alias("version"), F.col("text").alias("content"), T.content_hash(F.col("text")).alias("hash"),
        F.array_join(T.chunks(F.col("doc"), chunking), "\n").alias("enriched"), "category", F.col("p.language").alias("lang"), C.identifiers(F.col("p")).alias("identifiers"), "vkeys",
    )
    mode = {"partitionOverwriteMode": "dynamic"}
    snippets.write.mode("overwrite").options(**mode).partitionBy("version").parquet(f"{folder}/snippets")
    held = spark.read.parquet(f"{folder}/snippets").where(F.col("version") == version)
    n = held.count()
    df = held.select("version", F.explode(F.array_distinct(T.index_terms(F.col("enriched")))).alias("term")).groupBy("version", "term").agg(F.count(F.lit(1)).alias("n"))
    df.write.mode("overwrite").options(**mode).partitionBy("version").parquet(f"{folder}/df")
    texts = keyed.select(F.explode("views").alias("view_name", "v")).select("view_name", F.explode(T.chunks(F.col("v"), chunking)).alias("piece"), "v")
    texts = texts.select("view_name", T.vector_key(T.chunks(F.col("v"), chunking)).alias("hash"), F.array_join(T.chunks(F.col("v"), chunking), "\n").alias("t")).dropDuplicates(["view_name", "hash"])
    reused = 0
    if same_encoder and exists(spark, f"{folder}/vectors"):
        have = spark.read.parquet(f"{folder}/vectors").select("view_name", "hash")
        total = texts.count()
        texts = texts.join(have, ["view_name", "hash"], "left_anti")
        fresh = texts.count()
        reused = total - fresh
    vectors = texts.select("view_name", "hash", F.transform(encoder.column(F.col("t")), lambda x: x.cast("float")).alias("vector"))
    made = vectors.count()
    vectors.write.mode("append" if same_encoder else "overwrite").partitionBy("view_name").parquet(f"{folder}/vectors")
    stamp = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("built_at"), F.lit(n).cast("bigint").alias("snippets"))
    stamp.write.mode("overwrite").options(**mode).partitionBy("version").parquet(f"{folder}/versions")
    verify(spark, folder, version)
    return {"version": version, "snippets": n, "new_vectors": made, "reused_vectors": reused}


def migrate(spark: SparkSession, folder: str, out: str) -> dict:
    """A copy of an index of an older schema in the present one: its snippets get the columns that were added since."""
    meta = check_folder(spark, folder, None)
    snippets = spark.read.parquet(f"{folder}/snippets")
    for schema, columns in sorted(ADDED.items()):
        if meta["schema"] < schema:
            snippets = snippets.withColumns({c: F.expr(value) for c, value in columns.items() if c not in snippets.columns})
    snippets.write.mode("errorifexists").partitionBy("version").parquet(f"{out}/snippets")
    for name, part in (("df", "version"), ("vectors", "view_name"), ("versions", "version")):
        spark.read.parquet(f"{folder}/{name}").write.mode("errorifexists").partitionBy(part).parquet(f"{out}/{name}")
    _write_meta(spark, out, meta | {"schema": SCHEMA})
    return check_folder(spark, out)


def verify(spark: SparkSession, folder: str, version: str) -> int:
    """Rows of a version on disk against the number it was built with."""
    check_folder(spark, folder)
    n = spark.read.parquet(f"{folder}/snippets").where(F.col("version") == version).count()
    said = committed(spark, folder).where(F.col("version") == version).select("snippets").collect()
    if not said or said[0][0] != n:
        raise ValueError(f"version {version}: {n} snippets on disk, {said[0][0] if said else 'none'} recorded")
    return n


def load(spark: SparkSession, folder: str, versions: str | list[str] = "latest") -> tuple[DataFrame, DataFrame]:
    """(snippets, vectors) of the latest version by build time, of named ones, or of all."""
    check_folder(spark, folder)
    done = committed(spark, folder)
    snippets = spark.read.parquet(f"{folder}/snippets").join(F.broadcast(done.select("version")), "version", "left_semi")  # a row for each build
    vectors = spark.read.parquet(f"{folder}/vectors").dropDuplicates(["view_name", "hash"])
    if versions == "latest":
        last = done.orderBy(F.col("built_at").desc(), F.col("version").desc()).limit(1).collect()
        versions = [r["version"] for r in last]
    if versions != "all":
        snippets = snippets.where(F.col("version").isin(*([versions] if isinstance(versions, str) else versions)))
    return snippets, vectors


def referenced_vectors(snippets: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors some snippet (vkeys) refers to."""
    keys = snippets.select(F.explode("vkeys").alias("view_name", "hash")).distinct()
    return vectors.join(keys, ["view_name", "hash"], "left_semi")


def export(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Copy an index without vectors nothing refers to; returns (table_name, rows, digest), the same for equal contents."""
    snippets, vectors = load(spark, folder, "all")
    tables = {"snippets": snippets, "vectors": referenced_vectors(snippets, vectors), "df": spark.read.parquet(f"{folder}/df")}
    report = None
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{out}/{name}")
        part = digest(spark.read.parquet(f"{out}/{name}")).select(F.lit(name).alias("table_name"), "rows", "digest")
        report = part if report is None else report.unionByName(part)
    return report


def digest(rows: DataFrame) -> DataFrame:
    """(rows, digest) of a table, whatever the order of its rows and files: the sum of a hash of each row's values, each with its length."""

    def value(field) -> Column:
        plain = F.col(field.name).cast("string") if field.dataType.typeName() not in ("array", "map", "struct") else F.to_json(field.name)
        return F.coalesce(F.concat(F.length(plain).cast("string"), F.lit(":"), plain), F.lit("-"))

    line = F.sha2(F.concat_ws("|", *[value(rows.schema[c]) for c in sorted(rows.columns)]), 256)
    number = F.conv(F.substring(line, 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(number).cast("string").alias("digest"))


def recheck(spark: SparkSession, folder: str, encoder: Encoder, n: int = 100, seed: int = 0) -> DataFrame:
    """(view_name, hash, cosine) of a sample of stored vectors, encoded anew from their texts."""
    from quern.functions.vectors import cosine, normalised

    snippets, vectors = load(spark, folder, "all")
    code = snippets.select(F.lit("raw").alias("view_name"), F.col("vkeys")["raw"].alias("hash"), T.truncated(F.regexp_replace("content", r"^\s+|\s+$", ""), 512).alias("t")).where("hash IS NOT NULL").dropDuplicates(["hash"])
    some = code.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("hash")))).limit(n)
    both = some.join(vectors, ["view_name", "hash"])
    return both.select("view_name", "hash", F.round(cosine(normalised(F.col("vector")), normalised(encoder.column(F.col("t")))), 4).alias("cosine"))


def index_folder(spark: SparkSession, root: str, folder: str, version: str, all_languages: bool = False, include_vendored: bool = False, **build_options) -> tuple[dict, DataFrame]:
    """Index the files of a tree, without secrets; the build's figures and the report of what was left out."""
    from quern.sources import files

    good, report = files.scan(files.read_tree(spark, root, include_vendored), include_vendored, all_languages)
    return build(spark, good.select("id", "text"), folder, version, kind="repo", **build_options), report


def index_records(spark: SparkSession, path: str, folder: str, version: str, kind: str = "records", **build_options) -> dict:
    """Index a record file of any form ``records.read_corpus`` reads."""
    from quern.sources import records

    return build(spark, records.read_corpus(spark, path).select("id", "text"), folder, version, kind=kind, **build_options)


def index_judged(spark: SparkSession, corpus: DataFrame, queries: DataFrame, qrels: DataFrame, folder: str, version: str, limit: int | None = None, **build_options) -> dict:
    """Index the corpus of a benchmark's tables (``evaluate.judged``), as a collection of task solutions."""
    from quern.operators import evaluate

    docs, _, _ = evaluate.judged(corpus, queries, qrels, limit)
    return build(spark, docs, folder, version, kind="apps", **build_options)

"""Queries over the driver's tables: each renders a table to a raw format, indexes it, plans slices and reads them back; and the same in SQL."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import api
from .codecs import las, tiff
from .functions import io
from .session import scratch
from .sinks import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# CSV ----------------------------------------------------------------------------------------------------------------------------------

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def orders_csv(spark: SparkSession, sf_dir: str) -> str:
    d = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    path = files.write_lines(d.select(files.csv_line(*ORDERS).alias("value")), f"{scratch(spark, 'csv')}/orders.csv", header=",".join(ORDERS) + "\n")
    api.build_index(spark, "csv", path)
    return path


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders")
def csv_num_chunks_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.read(spark, "csv", orders_csv(spark, sf_dir), num_chunks=25).select(*ORDERS)


@query("SELECT o_orderstatus, count(*) AS n, CAST(round(sum(o_totalprice)) AS BIGINT) AS total, min(o_orderkey) AS first_key FROM orders GROUP BY o_orderstatus")
def csv_status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = api.read(spark, "csv", orders_csv(spark, sf_dir), columns=["o_orderkey", "o_orderstatus", "o_totalprice"], num_chunks=25)
    return d.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice")).cast("long").alias("total"), F.min("o_orderkey").alias("first_key"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_status_totals(spark, sf_dir)


LINES = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"]


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity, CAST(round(sum(l_extendedprice)) AS BIGINT) AS price FROM lineitem GROUP BY ALL")
def csv_chunk_size_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.write_lines(table(spark, sf_dir, "lineitem").select(files.csv_line(*LINES, separator=";").alias("value")), f"{scratch(spark, 'csv')}/lineitem.csv", header=";".join(LINES) + "\n")
    api.build_index(spark, "csv", path, separator=";")
    d = api.read(spark, "csv", path, "chunk_size", chunk_size=min(api.object_size(path), 100_003))
    return d.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"), F.round(F.sum("l_extendedprice")).cast("long").alias("price"))


@query("SELECT ['p_partkey', 'p_name', 'p_size', 'p_retailprice'] AS columns, ['bigint', 'string', 'bigint', 'double'] AS dtypes")
def csv_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["p_partkey", "p_name", "p_size", "p_retailprice"]
    path = files.write_lines(table(spark, sf_dir, "part").select(files.csv_line(*names).alias("value")), f"{scratch(spark, 'csv')}/part.csv", header=",".join(names) + "\n")
    api.build_index(spark, "csv", path)
    return api.attributes(spark, "csv", path)


@query(
    """WITH s AS (SELECT 9 + sum(strlen(CAST(o_orderkey AS VARCHAR)) + strlen(o_orderpriority) + 2) AS size FROM orders),
c AS (SELECT size, ceil(size / 7.0)::BIGINT AS cs FROM s)
SELECT CAST(i AS INTEGER) AS slice_id, CAST(least(cs * i, size) AS BIGINT) AS "start", CAST(least(cs * (i + 1), size) AS BIGINT) AS "end" FROM c, range(7) r(i)"""
)
def csv_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["o_orderkey", "o_orderpriority"]
    path = files.write_lines(table(spark, sf_dir, "orders").select(files.csv_line(*names).alias("value")), f"{scratch(spark, 'csv')}/keys.csv", header="key,prio\n")
    api.build_index(spark, "csv", path)
    return api.plan(spark, "csv", path, num_chunks=7)


KEY_LINE = "strlen(CAST(o_orderkey AS VARCHAR)) + strlen(CAST(o_custkey AS VARCHAR)) + strlen(o_orderstatus) + 3"


@query(
    f"""WITH o AS (SELECT o_orderkey, 13 + sum({KEY_LINE}) OVER (ORDER BY o_orderkey) - ({KEY_LINE}) AS pos, 13 + sum({KEY_LINE}) OVER () AS size FROM orders)
SELECT CAST(pos // CAST(ceil(size / 25.0) AS BIGINT) AS INTEGER) AS slice_id, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM o GROUP BY 1"""
)
def csv_slices_as_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each slice, worked out by a pandas function: a row of the file belongs to the slice that holds its first byte."""
    d = table(spark, sf_dir, "orders").orderBy("o_orderkey")
    path = files.write_lines(d.select(files.csv_line("o_orderkey", "o_custkey", "o_orderstatus").alias("value")), f"{scratch(spark, 'csv')}/keys.csv", header="key,cust,sta\n")
    api.build_index(spark, "csv", path)
    one = lambda p: p.groupby("_slice_id")["key"].agg(n="size", first_key="min", last_key="max").reset_index(names="slice_id")
    return api.map_slices(api.read(spark, "csv", path, num_chunks=25), one, "slice_id int, n long, first_key long, last_key long")


# words --------------------------------------------------------------------------------------------------------------------------------


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \\n]+')) AS w FROM documents) WHERE w <> '' GROUP BY w")
def text_whole_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.write_lines(table(spark, sf_dir, "documents").select(F.col("text").alias("value")), f"{scratch(spark, 'text')}/documents.txt")
    d = api.read(spark, "text", path, num_chunks=64).select(F.explode(F.split("text", "[ \n]+")).alias("word"))
    return d.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


# FASTA --------------------------------------------------------------------------------------------------------------------------------

SEQUENCE = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"
FASTA_SQL = f"""WITH d AS (SELECT doc_id, strlen('>doc' || doc_id || ' ' || lang) + 1 AS h, strlen({SEQUENCE}) + 1 AS s FROM documents),
o AS (SELECT doc_id, h, s, sum(h + s) OVER (ORDER BY doc_id) - h - s AS pos, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM d),
x AS (SELECT ordinal, CAST(pos AS BIGINT) AS id_offset, CAST(pos + h AS BIGINT) AS seq_offset FROM o),
z AS (SELECT CAST(sum(h + s) AS BIGINT) AS size FROM d)"""


def documents_fasta(spark: SparkSession, sf_dir: str) -> str:
    d = table(spark, sf_dir, "documents").orderBy("doc_id")
    head = F.concat(F.lit(">doc"), F.col("doc_id").cast("string"), F.lit(" "), F.col("lang"))
    path = files.write_lines(d.select(F.concat_ws("\n", head, F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))).alias("value")), f"{scratch(spark, 'fasta')}/documents.fasta")
    api.build_index(spark, "fasta", path, chunk_size=max(1, api.object_size(path) // 13))
    return path


@query(FASTA_SQL + " SELECT ordinal, id_offset, seq_offset FROM x")
def fasta_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{documents_fasta(spark, sf_dir)}.rwidx/headers.parquet").select("ordinal", "id_offset", "seq_offset")


@query(
    FASTA_SQL
    + """, b AS (SELECT i, least(i * CAST(ceil(size / 50.0) AS BIGINT), size) AS b FROM z, range(51) r(i)),
m AS (SELECT i, CASE WHEN id_offset < b AND b < seq_offset THEN id_offset ELSE b END AS b FROM b ASOF JOIN x ON b.b >= x.id_offset)
SELECT CAST(i AS INTEGER) AS slice_id, b AS "start", lead(b) OVER (ORDER BY i) AS "end" FROM m QUALIFY lead(b) OVER (ORDER BY i) IS NOT NULL"""
)
def fasta_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.plan(spark, "fasta", documents_fasta(spark, sf_dir), num_chunks=50).select("slice_id", "start", "end")


@query(f"SELECT 'doc' || doc_id AS seq_id, lang AS description, CAST(strlen({SEQUENCE}) AS BIGINT) AS n, md5({SEQUENCE}) AS digest FROM documents")
def fasta_reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = api.read(spark, "fasta", documents_fasta(spark, sf_dir), num_chunks=50)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq_offset", "is_continuation", "sequence"))), lambda s: s["sequence"]), "")
    return d.groupBy("seq_id").agg(F.max("description").alias("description"), whole.alias("whole")).select("seq_id", "description", F.length("whole").cast("long").alias("n"), F.md5("whole").alias("digest"))


# gzip and FASTQ -----------------------------------------------------------------------------------------------------------------------

EVENTS = ["event_id", "user_id", "event_type", "props"]


def events_gzip(spark: SparkSession, sf_dir: str) -> str:
    d = table(spark, sf_dir, "events").orderBy("event_id").select(files.csv_line(*EVENTS, separator="\t").alias("value"))
    path = files.write_lines(d, f"{scratch(spark, 'gzip')}/events.gz", compress=True, last_newline=False)
    api.build_index(spark, "gzip", path, span=1 << 16)
    return path


def chunk_report(d: DataFrame) -> DataFrame:
    key = F.split("line", "\t")[0].cast("long")
    return d.groupBy(F.col("_slice_id").alias("slice_id")).agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))


@query("SELECT CAST((r - 1) // 997 AS INTEGER) AS slice_id, count(*) AS n, min(r) AS first_line, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS r FROM events) GROUP BY 1")
def gzip_lines_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_report(api.read(spark, "gzip", events_gzip(spark, sf_dir), "chunk_lines", lines_per_chunk=997))


@query(
    """SELECT CAST(least((r - 1) // 997, CASE WHEN t % 997 <> 0 THEN greatest(ceil(t / 997.0) - 2, 0) ELSE t END) AS INTEGER) AS slice_id, count(*) AS n, min(r) AS first_line, min(event_id) AS first_id, max(event_id) AS last_id
FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS r, count(*) OVER () AS t FROM events) GROUP BY 1"""
)
def gzip_lines_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_report(api.read(spark, "gzip", events_gzip(spark, sf_dir), "chunk_lines", lines_per_chunk=997, rest="merge"))


@query("SELECT count(*) AS total_lines FROM events")
def gzip_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.attributes(spark, "gzip", events_gzip(spark, sf_dir)).select("total_lines")


def part_fastq(spark: SparkSession, sf_dir: str) -> str:
    d = table(spark, sf_dir, "part").orderBy("p_partkey")
    value = F.concat_ws("\n", F.concat(F.lit("@"), F.col("p_partkey").cast("string")), F.col("p_name"), F.lit("+"), F.col("p_brand"))
    path = files.write_lines(d.select(value.alias("value")), f"{scratch(spark, 'fastq')}/part.fastq.gz", compress=True)
    api.build_index(spark, "fastq", path, span=1 << 15)
    return path


READS = "SELECT r - 1 AS read_no, '@' || p_partkey AS id, p_name AS seq, p_brand AS qual, CAST({} AS INTEGER) AS slice_id FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS r, count(*) OVER () AS t FROM part)"


@query(READS.format("(r - 1) // CAST(ceil(t / 13.0) AS BIGINT)"))
def fastq_read_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = api.read(spark, "fastq", part_fastq(spark, sf_dir), num_batches=13)
    return d.select("read_no", "id", "seq", "qual", F.col("_slice_id").alias("slice_id"))


@query(READS.format("(r - 1) // 77"))
def fastq_seqs_per_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = api.read(spark, "fastq", part_fastq(spark, sf_dir), "sequences_per_chunk", seq_per_chunk=77)
    return d.select("read_no", "id", "seq", "qual", F.col("_slice_id").alias("slice_id"))


# VCF ----------------------------------------------------------------------------------------------------------------------------------

VCF_HEADER = (
    '##fileformat=VCFv4.2\n##INFO=<ID=UT,Number=.,Type=String,Description="kind, of event">\n##INFO=<ID=UI,Number=1,Type=Integer,Description="user">\n'
    "##ALT=<ID=DEL:ME:ALU,Description=\"deletion\">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n"
)


def vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    value = F.concat_ws(
        "\t", F.concat(F.lit("chr"), (F.col("user_id") % 5).cast("string")), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, F.lit(".")).otherwise(F.concat(F.lit("rs"), user)), F.lit("A"), F.when(F.col("event_id") % 2 == 0, F.lit("C,G")).otherwise(F.lit("T")),
        F.when(F.col("event_id") % 7 == 0, F.lit(".")).otherwise((F.col("event_id") % 100).cast("string")), F.lit("PASS"), F.concat(F.lit("UT="), F.col("event_type"), F.lit(";UI="), user, F.lit(";DB")), F.lit("GT:GQ"), F.concat(F.lit("0/1:"), user), F.lit("./."),
    )
    return d.select(value.alias("value"))


def events_vcf(spark: SparkSession, sf_dir: str) -> str:
    path = files.write_lines(vcf_lines(spark, sf_dir), f"{scratch(spark, 'vcf')}/events.vcf", header=VCF_HEADER)
    api.build_index(spark, "vcf", path)
    return path


@query(
    """SELECT ['CHROM','POS','ID','REF','ALT','QUAL','FILTER','INFO','FORMAT','S1','S2'] AS columns, 'VCFv4.2' AS fileformat, '.' AS number, 'kind, of event' AS description, 'DEL:ME:ALU' AS alt_id, CAST(%d AS BIGINT) AS body_offset"""
    % len(VCF_HEADER.encode())
)
def vcf_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = api.attributes(spark, "vcf", events_vcf(spark, sf_dir))
    info = F.col("structured")["INFO"][0]
    return a.select("columns", F.col("scalars")["fileformat"].alias("fileformat"), info["Number"].alias("number"), info["Description"].alias("description"), F.col("structured")["ALT"][0]["ID"].alias("alt_id"), "body_offset")


@query(
    """SELECT 'chr' || (user_id % 5) AS chrom, event_id AS pos, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'rs' || user_id END AS id, CASE WHEN event_id % 2 = 0 THEN 'C/G' ELSE 'T' END AS alt,
CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) END AS qual, '0/1:' || user_id AS s1 FROM events"""
)
def vcf_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = api.read(spark, "vcf", events_vcf(spark, sf_dir), num_chunks=40)
    return d.select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), F.col("ID").alias("id"), F.array_join("ALT", "/").alias("alt"), F.col("QUAL").alias("qual"), F.col("samples")["S1"].alias("s1"))


@query("SELECT event_type AS ut, user_id AS ui, 'true' AS db, count(*) AS n FROM events GROUP BY ALL")
def vcf_info_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = api.read(spark, "vcf", events_vcf(spark, sf_dir), num_chunks=40)
    return d.groupBy(F.col("INFO")["UT"].alias("ut"), F.col("INFO")["UI"].cast("long").alias("ui"), F.col("INFO")["DB"].alias("db")).agg(F.count("*").alias("n"))


# imzML --------------------------------------------------------------------------------------------------------------------------------


def embeddings_imzml(spark: SparkSession, sf_dir: str, continuous: bool) -> str:
    """The table streams through the driver into the two files; arrays of one row are held at a time in the parent's iterator."""
    d = table(spark, sf_dir, "embeddings").orderBy("vec_id").select("vec_id", "label", "embedding")
    spectra = ((int(r.vec_id), int(r.label), np.arange(len(r.embedding), dtype=float), np.array(r.embedding, "<f4")) for r in d.toLocalIterator(prefetchPartitions=True))
    path = files.write_imzml(f"{scratch(spark, 'imzml')}/embeddings", spectra, continuous)
    api.build_index(spark, "imzml", path)
    return path


SPECTRA = """SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS spectrum_index, CAST(vec_id AS INTEGER) AS x, CAST(len(embedding) AS BIGINT) AS n,
CAST(round(1000 * list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE)))) AS BIGINT) AS total, CAST(len(embedding) - 1 AS DOUBLE) AS last_mz FROM embeddings"""


def spectra(d: DataFrame) -> DataFrame:
    total = F.aggregate("intensity", F.lit(0.0), lambda a, x: a + x)
    return d.select("spectrum_index", "x", F.size("intensity").cast("long").alias("n"), F.round(1000 * total).cast("long").alias("total"), F.element_at("mz", -1).alias("last_mz"))


@query(SPECTRA)
def imzml_processed_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra(api.read(spark, "imzml", embeddings_imzml(spark, sf_dir, False), chunk_size=20_000))


@query(SPECTRA)
def imzml_continuous_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra(api.read(spark, "imzml", embeddings_imzml(spark, sf_dir, True), chunk_size=20_000))


@query(
    """WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, 12 * len(embedding) AS b FROM embeddings),
p(i, cur, k, b) AS (SELECT i, b, 0, b FROM s WHERE i = 0 UNION ALL SELECT s.i, CASE WHEN p.cur + s.b > 20000 THEN s.b ELSE p.cur + s.b END, p.k + CASE WHEN p.cur + s.b > 20000 THEN 1 ELSE 0 END, s.b FROM p JOIN s ON s.i = p.i + 1)
SELECT CAST(k AS INTEGER) AS slice_id, CAST(min(i) AS BIGINT) AS spectrum_start, CAST(max(i) + 1 AS BIGINT) AS spectrum_end FROM p GROUP BY k"""
)
def imzml_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.plan(spark, "imzml", embeddings_imzml(spark, sf_dir, False), chunk_size=20_000).select("slice_id", "spectrum_start", "spectrum_end")


# points -------------------------------------------------------------------------------------------------------------------------------


def events_las(spark: SparkSession, sf_dir: str) -> str:
    p = table(spark, sf_dir, "events").orderBy("event_id").select(F.floor("value").cast("int").alias("x"), F.col("user_id").cast("int").alias("y"), (F.col("event_id") % 1000).cast("int").alias("z"))
    p = p.withColumns({"intensity": F.col("z") % 100, "classification": F.col("y") % 5})
    path = files.write_las_rows(p, f"{scratch(spark, 'las')}/events.las", scales=(1.0, 1.0, 1.0))
    api.build_index(spark, "las", path, block_points=1000)
    return path


GRID = """WITH p AS (SELECT CAST(floor(value) AS DOUBLE) AS x, CAST(user_id AS DOUBLE) AS y, event_id % 1000 AS z FROM events),
b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
g AS (SELECT i, j, x0 + (x1 - x0) / 3 * i AS a, CASE WHEN i = 2 THEN x1 ELSE x0 + (x1 - x0) / 3 * (i + 1) END AS c, y0 + (y1 - y0) / 2 * j AS d, CASE WHEN j = 1 THEN y1 ELSE y0 + (y1 - y0) / 2 * (j + 1) END AS e FROM b, range(3) r(i), range(2) q(j)) """


@query(GRID + "SELECT CAST(i AS INTEGER) AS tile_x, CAST(j AS INTEGER) AS tile_y, count(*) AS n, CAST(sum(z) AS BIGINT) AS z, min(x) AS min_x, max(y) AS max_y FROM p JOIN g ON x >= a AND (x < c OR i = 2) AND y >= d AND (y < e OR j = 1) GROUP BY ALL")
def las_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = api.read(spark, "las", events_las(spark, sf_dir), num_chunks=7)
    return d.groupBy("tile_x", "tile_y").agg(F.count("*").alias("n"), F.sum("z").cast("long").alias("z"), F.min("x").alias("min_x"), F.max("y").alias("max_y"))


@query(GRID + "SELECT CAST(i * 2 + j AS INTEGER) AS slice_id, CAST(i AS INTEGER) AS tile_x, CAST(j AS INTEGER) AS tile_y, a AS min_x, c AS max_x, d AS min_y, e AS max_y FROM g")
def las_tile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.plan(spark, "las", events_las(spark, sf_dir), num_chunks=7).select("slice_id", "tile_x", "tile_y", "min_x", "max_x", "min_y", "max_y")


@query("SELECT count(*) AS n, CAST(coalesce(sum(event_id % 1000), 0) AS BIGINT) AS z FROM events WHERE floor(value) BETWEEN 10 AND 40 AND user_id BETWEEN 20 AND 60")
def las_box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box far smaller than the extent: tiles that do not meet it are not read."""
    d = api.read(spark, "las", events_las(spark, sf_dir), num_chunks=16, ranges={"x": (10, 40), "y": (20, 60)})
    return d.agg(F.count("*").alias("n"), F.coalesce(F.sum("z"), F.lit(0)).cast("long").alias("z"))


@query(
    "WITH b AS (SELECT min(floor(value)) AS x0, max(floor(value)) AS x1, CAST(min(user_id) AS DOUBLE) AS y0, CAST(max(user_id) AS DOUBLE) AS y1 FROM events) "
    "SELECT CAST(i * 3 + j AS INTEGER) AS slice_id, x0 + (x1 - x0) / 3 * i AS min_x, y0 + (y1 - y0) / 3 * j AS min_y FROM b, range(3) r(i), range(3) q(j)"
)
def copc_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.plan(spark, "copc", events_copc(spark, sf_dir), num_chunks=9).select("slice_id", "min_x", "min_y")


def events_copc(spark: SparkSession, sf_dir: str) -> str:
    e = table(spark, sf_dir, "events").agg(F.min(F.floor("value")), F.max(F.floor("value")), F.min("user_id"), F.max("user_id"), F.count("*")).first()
    path = f"{scratch(spark, 'copc')}/events.copc.laz"
    io.write_bytes(path, copc_header(*(float(v) for v in e[:4]), int(e[4])))
    api.build_index(spark, "copc", path)
    return path


def copc_header(x0: float, x1: float, y0: float, y1: float, points: int) -> bytes:
    """Header and info record of a COPC file without points."""
    import struct

    head = bytearray(375)
    head[0:4], head[24], head[25] = b"LASF", 1, 4
    struct.pack_into("<HIIBHI", head, 94, 375, 375 + 54 + 160, 1, 6 | 0x80, 30, points)
    struct.pack_into("<3d3d6d", head, 131, 1, 1, 1, 0, 0, 0, x1, x0, y1, y0, 0, 0)
    struct.pack_into("<Q", head, 247, points)
    record = struct.pack("<H16sHH32s", 0, b"copc", 1, 160, b"") + struct.pack("<5dQQ2d", 0, 0, 0, 1, 1, 589, 32, 0, 0) + bytes(88)
    return bytes(head) + record


# raster -------------------------------------------------------------------------------------------------------------------------------

WIDTH, HEIGHT = 103, 57


def events_tiff(spark: SparkSession, sf_dir: str) -> str:
    cells = table(spark, sf_dir, "events").groupBy((F.col("user_id") % HEIGHT).cast("int").alias("r"), F.pmod(F.floor("value").cast("int"), F.lit(WIDTH)).alias("c")).agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("k")).toPandas()
    pixels = np.zeros((2, HEIGHT, WIDTH), np.int32)
    pixels[0, cells.r, cells.c], pixels[1, cells.r, cells.c] = cells.n, cells.k
    path = files.write_tiff(f"{scratch(spark, 'tiff')}/events.tif", pixels, transform=[10.0, 0.0, 500000.0, 0.0, -10.0, 4000000.0], epsg=32631, tile=16, deflate=True)
    api.build_index(spark, "cog", path)
    return path


@query(
    f"""WITH k AS (SELECT i, CAST(round_even({HEIGHT} / 4.0 * i, 0) AS BIGINT) AS ro, CAST(ceil({HEIGHT} / 4.0 * (i + 1)) AS BIGINT) AS re, CAST(round_even({WIDTH} / 4.0 * i, 0) AS BIGINT) AS co, CAST(ceil({WIDTH} / 4.0 * (i + 1)) AS BIGINT) AS ce FROM range(4) r(i))
SELECT CAST(a.i * 4 + b.i AS INTEGER) AS slice_id, a.i AS block_x, b.i AS block_y, a.ro AS row_off, b.co AS col_off, a.re - a.ro AS height, b.ce - b.co AS width FROM k a, k b"""
)
def cog_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.plan(spark, "cog", events_tiff(spark, sf_dir), n_splits=4).drop("tile_key")


@query(
    f"""WITH h AS (SELECT user_id % {HEIGHT} AS r, ((CAST(floor(value) AS BIGINT) % {WIDTH}) + {WIDTH}) % {WIDTH} AS c, count(*) AS n, count(DISTINCT event_type) AS k FROM events GROUP BY ALL)
SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CAST(n AS DOUBLE) AS n, CAST(k AS DOUBLE) AS kinds FROM h"""
)
def cog_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = api.read(spark, "cog", events_tiff(spark, sf_dir), n_splits=5, exact=True)
    return d.groupBy("row", "col").agg(F.sum(F.when(F.col("band") == 1, F.col("value"))).alias("n"), F.sum(F.when(F.col("band") == 2, F.col("value"))).alias("kinds")).where("n > 0")


@query(f"SELECT CAST({WIDTH} AS BIGINT) AS width, CAST({HEIGHT} AS BIGINT) AS height, 'EPSG:32631' AS crs, 500000.0::DOUBLE AS \"left\", 4000000.0::DOUBLE - 10 * {HEIGHT} AS bottom")
def cog_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.attributes(spark, "cog", events_tiff(spark, sf_dir)).select("width", "height", "crs", F.col("bounds.left").alias("left"), F.col("bounds.bottom").alias("bottom"))


# row sets -----------------------------------------------------------------------------------------------------------------------------

PER_TIME = 7


def events_ms(spark: SparkSession, sf_dir: str) -> str:
    """Rows in the order of event_id, written by the tasks; a row's time follows from its number, so that TIME needs their count alone."""

    def encode(b: pa.RecordBatch) -> dict[str, bytes]:
        user, v = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        flags = np.packbits(np.stack([user % 2 == 0, user % 3 == 0, user % 5 == 0], 1), axis=1, bitorder="little")
        return {"DATA": np.stack([v.astype("<f4"), user.astype("<f4")], 1).tobytes(), "FLAG": flags.tobytes(), "ANTENNA": user.astype("<i4").tobytes()}

    folder, bucket, step = f"{scratch(spark, 'ms')}/events.ms", 4096, 1 << 20
    p = table(spark, sf_dir, "events").orderBy("event_id").select("user_id", F.floor("value").cast("float").alias("v"))
    n = files.write_columns(p, folder, ["DATA", "FLAG", "ANTENNA"], encode, bucket)
    with io.created(f"{folder}/TIME.bin") as out:
        for a in range(0, n, step):
            out.write((np.arange(a, min(n, a + step)) // PER_TIME).astype("<f8").tobytes())
        out.write(b"\0" * (-8 * n % bucket))
    columns = [("TIME", "double", [1]), ("DATA", "float", [2]), ("FLAG", "bool", [3]), ("ANTENNA", "int", [1])]
    io.write_bytes(f"{folder}/table.json", json.dumps({"total_rows": n, "columns": [{"name": c, "file": f"{c}.bin", "type": t, "shape": s, "bucketsize": bucket} for c, t, s in columns], "static": {"SPECTRAL_WINDOW": 1}}).encode())
    api.build_index(spark, "ms", folder)
    return folder


@query(
    f"""WITH t AS (SELECT count(*) AS total, count(*) // {PER_TIME} AS times FROM events), n AS (SELECT total, times, least(11, times) AS n FROM t),
b AS (SELECT i, total, n, {PER_TIME} * (i * (times // n) + least(i, times % n)) AS a, {PER_TIME} * ((i + 1) * (times // n) + least(i + 1, times % n)) AS z FROM n, range(11) r(i) WHERE i < n)
SELECT CAST(i AS INTEGER) AS slice_id, CAST(a AS BIGINT) AS row_0, CAST(CASE WHEN i = n - 1 THEN total ELSE z END - 1 AS BIGINT) AS row_1 FROM b"""
)
def ms_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.plan(spark, "ms", events_ms(spark, sf_dir), num_chunks=11)


@query(
    f"""SELECT r - 1 AS "row", CAST((r - 1) // {PER_TIME} AS DOUBLE) AS time, CAST(floor(value) AS DOUBLE) AS v, user_id AS antenna, user_id % 3 = 0 AS flag
FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS r FROM events)"""
)
def ms_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = api.read(spark, "ms", events_ms(spark, sf_dir), num_chunks=11)
    return d.select("row", F.col("TIME").alias("time"), F.col("DATA")[0].cast("double").alias("v"), F.col("ANTENNA").cast("long").alias("antenna"), F.col("FLAG")[1].alias("flag"))


@query("SELECT 'events.ms' AS ms_name, count(*) AS total_rows, CAST(least(7, count(*)) AS BIGINT) AS rows_per_time, 'TIME,DATA,FLAG,ANTENNA' AS columns, '8,8,1,4' AS block_sizes, 'SPECTRAL_WINDOW' AS static FROM events")
def ms_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = api.attributes(spark, "ms", events_ms(spark, sf_dir))
    files_ = lambda f: F.array_join(F.transform("mutable_files", f), ",")
    return a.select("ms_name", "total_rows", "rows_per_time", files_(lambda m: F.replace(m["file_name"], F.lit(".bin"), F.lit(""))).alias("columns"), files_(lambda m: m["block_size"].cast("string")).alias("block_sizes"), F.array_join("static_columns", ",").alias("static"))


@query(
    f"""WITH t AS (SELECT count(*) AS total, count(*) // {PER_TIME} AS times FROM events), n AS (SELECT total, times, least(5, times) AS n FROM t),
b AS (SELECT i, total, n, {PER_TIME} * (i * (times // n) + least(i, times % n)) AS a, {PER_TIME} * ((i + 1) * (times // n) + least(i + 1, times % n)) AS z FROM n, range(5) r(i) WHERE i < n),
e AS (SELECT user_id, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events)
SELECT CAST(i AS INTEGER) AS slice_id, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS antennas FROM b JOIN e ON r >= a AND (r < z OR i = n - 1) GROUP BY ALL"""
)
def ms_slices_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices written as folders by the tasks, each then indexed and read as a set of its own."""
    made = api.write_folders(spark, "ms", events_ms(spark, sf_dir), scratch(spark, "ms-slices"), num_chunks=5).collect()
    for r in made:
        api.build_index(spark, "ms", r.path)
    parts = [api.read(spark, "ms", r.path, num_chunks=1).select(F.lit(r.slice_id).cast("int").alias("slice_id"), "ANTENNA") for r in made]
    return reduce(DataFrame.unionByName, parts).groupBy("slice_id").agg(F.count("*").alias("n"), F.sum("ANTENNA").alias("antennas"))


# attributes and plans of the other formats --------------------------------------------------------------------------------------------


@query("SELECT count(*) AS num_sequences FROM documents")
def fasta_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.attributes(spark, "fasta", documents_fasta(spark, sf_dir))


@query(
    """SELECT [CAST(min(floor(value)) AS DOUBLE), CAST(min(user_id) AS DOUBLE), CAST(min(event_id % 1000) AS DOUBLE)] AS mins,
[CAST(max(floor(value)) AS DOUBLE), CAST(max(user_id) AS DOUBLE), CAST(max(event_id % 1000) AS DOUBLE)] AS maxs, count(*) AS point_count, CAST(20 AS INTEGER) AS point_format_size, CAST(227 AS BIGINT) AS offset_to_point_data FROM events"""
)
def las_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.attributes(spark, "las", events_las(spark, sf_dir))


@query(
    """SELECT count(*) AS points, 1.0::DOUBLE AS x_scale, 0.0::DOUBLE AS x_offset, CAST(max(floor(value)) AS DOUBLE) AS x_max, CAST(min(floor(value)) AS DOUBLE) AS x_min,
1.0::DOUBLE AS y_scale, 0.0::DOUBLE AS y_offset, CAST(max(user_id) AS DOUBLE) AS y_max, CAST(min(user_id) AS DOUBLE) AS y_min,
1.0::DOUBLE AS z_scale, 0.0::DOUBLE AS z_offset, 0.0::DOUBLE AS z_max, 0.0::DOUBLE AS z_min, CAST(589 AS BIGINT) AS root_offset, CAST(32 AS BIGINT) AS root_size FROM events"""
)
def copc_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.attributes(spark, "copc", events_copc(spark, sf_dir))


@query("SELECT false AS is_continuous, 'd' AS mz_precision, 'f' AS int_precision, CAST(8 AS INTEGER) AS mz_size, CAST(4 AS INTEGER) AS int_size, count(*) AS num_spectra FROM embeddings")
def imzml_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.attributes(spark, "imzml", embeddings_imzml(spark, sf_dir, False))


@query(
    """WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, 4 * len(embedding) AS b, first(8 * len(embedding)) OVER (ORDER BY vec_id) AS shared FROM embeddings),
p(i, cur, k) AS (SELECT i, shared + b, 0 FROM s WHERE i = 0 UNION ALL SELECT s.i, CASE WHEN p.cur + s.b > 20000 THEN s.shared + s.b ELSE p.cur + s.b END, p.k + CASE WHEN p.cur + s.b > 20000 THEN 1 ELSE 0 END FROM p JOIN s ON s.i = p.i + 1)
SELECT CAST(k AS INTEGER) AS slice_id, CAST(min(i) AS BIGINT) AS spectrum_start, CAST(max(i) + 1 AS BIGINT) AS spectrum_end FROM p GROUP BY k"""
)
def imzml_continuous_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.plan(spark, "imzml", embeddings_imzml(spark, sf_dir, True), chunk_size=20_000).select("slice_id", "spectrum_start", "spectrum_end")


@query("SELECT CAST((r - 1) // CAST(ceil(t / 9.0) AS BIGINT) AS INTEGER) AS slice_id, count(*) AS n, min(r) AS first_line, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS r, count(*) OVER () AS t FROM events) GROUP BY 1")
def gzip_num_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_report(api.read(spark, "gzip", events_gzip(spark, sf_dir), num_chunks=9))


@query("SELECT CAST(i AS INTEGER) AS slice_id, CAST(997 * i + 1 AS BIGINT) AS line_0, CAST(least(997 * (i + 1), t) + 1 AS BIGINT) AS line_1 FROM (SELECT count(*) AS t FROM events), range(100000) r(i) WHERE 997 * i < t")
def gzip_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.plan(spark, "gzip", events_gzip(spark, sf_dir), "chunk_lines", lines_per_chunk=997).select("slice_id", "line_0", "line_1")


@query(READS.format("least((r - 1) // 77, CASE WHEN t % 77 <> 0 THEN greatest(ceil(t / 77.0) - 2, 0) ELSE t END)"))
def fastq_seqs_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = api.read(spark, "fastq", part_fastq(spark, sf_dir), "sequences_per_chunk", seq_per_chunk=77, rest="merge")
    return d.select("read_no", "id", "seq", "qual", F.col("_slice_id").alias("slice_id"))


@query(
    """WITH s AS (SELECT CAST(sum(strlen(text) + 1) AS BIGINT) AS size FROM documents), c AS (SELECT size, CAST(ceil(size / 64.0) AS BIGINT) AS cs FROM s)
SELECT CAST(i AS INTEGER) AS slice_id, least(cs * i, size) AS "start", least(cs * (i + 1), size) AS "end" FROM c, range(64) r(i)"""
)
def text_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.write_lines(table(spark, sf_dir, "documents").select(F.col("text").alias("value")), f"{scratch(spark, 'text')}/documents.txt")
    return api.plan(spark, "text", path, num_chunks=64)


VCF_LINE = """'chr' || (user_id % 5) || '.' || event_id || '.' || CASE WHEN event_id % 3 = 0 THEN '.' ELSE 'rs' || user_id END || '.A.' || CASE WHEN event_id % 2 = 0 THEN 'C,G' ELSE 'T' END || '.' ||
CASE WHEN event_id % 7 = 0 THEN '.' ELSE CAST(event_id % 100 AS VARCHAR) END || '.PASS.UT=' || event_type || ';UI=' || user_id || ';DB.GT:GQ.0/1:' || user_id || '../.' || '.'"""


@query(
    f"""WITH s AS (SELECT CAST(sum(strlen({VCF_LINE})) AS BIGINT) AS body, CAST({len(VCF_HEADER.encode())} AS BIGINT) AS base FROM events), c AS (SELECT *, CAST(ceil(body / 40.0) AS BIGINT) AS cs FROM s)
SELECT CAST(i AS INTEGER) AS slice_id, base + least(cs * i, body) AS "start", base + least(cs * (i + 1), body) AS "end" FROM c, range(40) r(i)"""
)
def vcf_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.plan(spark, "vcf", events_vcf(spark, sf_dir), num_chunks=40)


@query(ORACLE_SQL["vcf_records"])
def vcf_gz_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.write_lines(vcf_lines(spark, sf_dir), f"{scratch(spark, 'vcf')}/events.vcf.gz", header=VCF_HEADER, compress=True)
    api.build_index(spark, "vcf_gz", path, span=1 << 16)
    d = api.read(spark, "vcf_gz", path, num_chunks=12)
    return d.select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), F.col("ID").alias("id"), F.array_join("ALT", "/").alias("alt"), F.col("QUAL").alias("qual"), F.col("samples")["S1"].alias("s1"))


@query(GRID + "SELECT CAST(i * 2 + j AS INTEGER) AS slice_id, count(*) AS n, CAST(min(x) AS DOUBLE) AS min_x, CAST(max(y) AS DOUBLE) AS max_y, CAST(max(z) AS DOUBLE) AS max_z FROM p JOIN g ON x >= a AND (x < c OR i = 2) AND y >= d AND (y < e OR j = 1) GROUP BY ALL")
def las_slices_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles as LAS files of their own; their headers tell what is in them."""

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [las.header(d.as_buffer()[:1024].to_pybytes()) for d in b.column(1)]
            values = ([h["point_count"] for h in found], [h["mins"][0] for h in found], [h["maxs"][1] for h in found], [h["maxs"][2] for h in found])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.float64() if i else pa.int64()) for i, v in enumerate(values))], ["slice_id", "n", "min_x", "max_y", "max_z"])

    made = api.slices(spark, "las", events_las(spark, sf_dir), num_chunks=7)
    return made.mapInArrow(headers, "slice_id int, n long, min_x double, max_y double, max_z double").where("n > 0")


@query(
    ORACLE_SQL["cog_windows"].replace("SELECT CAST(a.i * 4", "SELECT 500000.0::DOUBLE + 10 * b.co AS x_origin, 4000000.0::DOUBLE - 10 * a.ro AS y_origin, CAST(a.i * 4").replace("a.i AS block_x, b.i AS block_y, a.ro AS row_off, b.co AS col_off, ", "")
)
def cog_slices_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows as TIFF files of their own, with the transform moved to their corners."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [tiff.attributes(tiff.directory(lambda n, at, d=d.as_py(): d[at : at + n])) for d in b.column(1)]
            columns = [pa.array([f["transform"][2] for f in found], pa.float64()), pa.array([f["transform"][5] for f in found], pa.float64()), *(pa.array([f[k] for f in found], pa.int64()) for k in ("height", "width"))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["slice_id", "x_origin", "y_origin", "height", "width"])

    return api.slices(spark, "cog", events_tiff(spark, sf_dir), n_splits=4).mapInArrow(read, "slice_id int, x_origin double, y_origin double, height long, width long")


# the framework ------------------------------------------------------------------------------------------------------------------------


#: What each format promises: attributes with their types, strategies, and whether an object is a folder.
PROMISED = """
csv|columns array<string>, dtypes array<string>|chunk_size, num_chunks|false
text||whole_words|false
gzip|total_lines bigint, index_key string|chunk_lines, num_chunks|false
fastq|total_lines bigint, index_key string|chunk_lines, num_chunks, reads_batches, sequences_per_chunk|false
fasta|num_sequences bigint|num_chunks|false
vcf|columns array<string>, scalars map<string;string>, structured map<string;array<map<string;string>>>, body_offset bigint|num_chunks|false
vcf_gz|total_lines bigint, index_key string, columns array<string>, scalars map<string;string>, structured map<string;array<map<string;string>>>, body_offset bigint|chunk_lines, num_chunks|false
las|mins array<double>, maxs array<double>, point_count bigint, point_format_size int, offset_to_point_data bigint|square_split|false
copc|points bigint, x_scale double, x_offset double, x_max double, x_min double, y_scale double, y_offset double, y_max double, y_min double, z_scale double, z_offset double, z_max double, z_min double, root_offset bigint, root_size bigint|square_split|false
cog|width bigint, height bigint, crs string, bounds struct<left:double;bottom:double;right:double;top:double>, transform array<double>|grid|false
imzml|is_continuous boolean, mz_precision string, int_precision string, mz_size int, int_size int, num_spectra bigint|chunk_size|false
ms|ms_name string, total_rows bigint, rows_per_time bigint, mutable_files array<struct<file_name:string;real_size:bigint;bucketsize:bigint;block_size:bigint>>, static_columns array<string>|timestamps|true
"""


def promised() -> str:
    """PROMISED as SQL, a row for each attribute."""
    rows = []
    for line in PROMISED.strip().splitlines():
        name, attributes, strategies, folder = line.split("|")
        for a in attributes.split(", ") if attributes else [""]:
            key, _, kind = a.partition(" ")
            shown = [f"'{v}'" if v else "NULL" for v in (key, kind.replace(";", ","))]
            rows.append(f"('{name}', {shown[0]}, {shown[1]}, [{', '.join(repr(x) for x in strategies.split(', '))}], {folder})")
    return f'SELECT * FROM (VALUES {", ".join(rows)}) t("format", attribute, "type", strategies, folder)'


@query(promised())
def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.describe_format(spark).where(F.col("format").isin([line.split("|")[0] for line in PROMISED.strip().splitlines()]))


@query("SELECT count(*) AS rows, CAST(count(*) * 4 + sum(strlen(CAST(p_partkey AS VARCHAR)) + strlen(p_name) + strlen(p_brand) + 2) AS BIGINT) AS bytes, CAST(least(9, count(*)) AS BIGINT) AS files FROM part")
def fastq_slices_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices written as files by the tasks: together they hold the reads, byte for byte."""
    folder = scratch(spark, "slices")
    made = api.write_slices(api.slices(spark, "fastq", part_fastq(spark, sf_dir), num_batches=9), folder, ".fastq").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files")).collect()[0]
    lines = spark.read.text(f"{folder}/*.fastq")
    return lines.agg((F.count("*") / 4).cast("long").alias("rows"), F.lit(made.bytes).cast("long").alias("bytes"), F.lit(made.files).cast("long").alias("files"))

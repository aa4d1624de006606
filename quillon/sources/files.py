"""Files: directory scans, vector codecs, sidecar documents, content keys."""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.maintenance import file_format

EDGE = 64 * 1024


def scan_dir(spark: SparkSession, root: str, recursive: bool = True, exclude: list[str] = ()) -> DataFrame:
    """path, rel_path, file_name, format, file_size, mtime (ms) of image files under root.

    exclude: names or relative sub-paths, with * for any part of a name. Content is not read: only metadata columns of
    the file source are selected.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).drop("content")
    rel = F.regexp_replace("path", "^(?:[a-z0-9]+:)?/*" + _quoted(root.split(":", 1)[-1].strip("/")) + "/", "")
    out = files.withColumn("rel_path", rel).withColumn("file_name", F.element_at(F.split("rel_path", "/"), -1)).withColumn("format", file_format(F.col("file_name")))
    for pattern in exclude:
        regex = "[^/]*".join(_quoted(p) for p in pattern.strip("/").split("*"))
        out = out.where(~F.col("rel_path").rlike(f"(^|/){regex}(/|$)"))
    return out.where("format IS NOT NULL").select("path", "rel_path", "file_name", "format", F.col("length").alias("file_size"), F.unix_millis("modificationTime").alias("mtime"))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in text)


def fast_key(path: Column, size: Column, mtime: Column) -> Column:
    """Key of an unchanged file."""
    return F.sha2(F.concat_ws("|", path, size.cast("string"), mtime.cast("string")), 256)


def content_key(content: Column) -> Column:
    """Key of a file's content: digest of both ends and the length."""
    size = F.octet_length(content)
    return F.sha2(F.concat(F.substring(content, 1, EDGE), F.expr(f"substring({content._jc.toString()}, greatest(octet_length({content._jc.toString()}) - {EDGE - 1}, 1), {EDGE})"), F.encode(size.cast("string"), "UTF-8")), 256)


def encode_f16(vector: list[float] | None) -> bytes | None:
    return None if vector is None else np.asarray(vector, "<f2").tobytes()


def decode_f16(raw: bytes | None) -> list[float] | None:
    """A half-precision vector; null for a cut one."""
    return None if raw is None or len(raw) % 2 else np.frombuffer(raw, "<f2").astype(np.float32).tolist()


def parse_npy(raw: bytes) -> np.ndarray:
    """A one- or two-dimensional little-endian f2 or f4 array of a .npy file, versions 1 to 3."""
    if raw[:6] != b"\x93NUMPY" or len(raw) < 10 or raw[6] not in (1, 2, 3):
        raise ValueError("not a npy file")
    wide = raw[6] > 1
    size = struct.unpack("<I" if wide else "<H", raw[8 : 12 if wide else 10])[0]
    begin = (12 if wide else 10) + size
    header = ast.literal_eval(raw[begin - size : begin].decode("utf-8" if raw[6] == 3 else "latin-1"))
    if header["descr"] not in ("<f2", "<f4") or header["fortran_order"]:
        raise ValueError(f"unsupported array: {header}")
    flat = np.frombuffer(raw[begin:], header["descr"])
    if flat.size != int(np.prod(header["shape"], dtype=np.int64)):
        raise ValueError("the array is cut short")
    return flat.reshape(header["shape"]).astype(np.float32)


def _mapped(df: DataFrame, column: str, out: str, kind: pa.DataType, sql: str, f) -> DataFrame:
    at, names = df.columns.index(column), [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f(v) for v in b.column(at).to_pylist()], kind)], names)

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T._parse_datatype_string(sql))]))


def with_f16(df: DataFrame, vector: str, out: str) -> DataFrame:
    return _mapped(df, vector, out, pa.binary(), "binary", encode_f16)


def from_f16(df: DataFrame, raw: str, out: str) -> DataFrame:
    return _mapped(df, raw, out, pa.list_(pa.float32()), "array<float>", decode_f16)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """path, row, vector of .npy files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = np.atleast_2d(parse_npy(raw))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(len(rows)), pa.int32()), pa.array(list(rows), pa.list_(pa.float32()))], ["path", "row", "vector"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, row int, vector array<float>")


_SIDECAR = "RDF struct<Description struct<_Rating string, _Label string, _Pick string, subject struct<Bag struct<li array<string>>>, hierarchicalSubject struct<Bag struct<li array<string>>>>>"

# Names of the document's vocabularies.
_SIDECAR_HEAD = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:xmpDM="http://ns.adobe.com/xmp/1.0/DynamicMedia/" xmlns:dc="http://purl.org/dc/elements/1.1/"'


def sidecar_values(xml: Column) -> Column:
    """rating, label, pick, keywords of an XMP document; keywords fall back to the leaves of hierarchical ones.

    Prefixes are dropped first: elements are told apart by their local names.
    """
    plain = F.regexp_replace(F.regexp_replace(xml, r"(</?)[A-Za-z]+:", "$1"), r"\s[A-Za-z]+:([A-Za-z]+=)", " $1")
    parsed = F.from_xml(plain, _SIDECAR, {"rowTag": "xmpmeta"})
    d = parsed["RDF"]["Description"]
    leaves = F.transform(d["hierarchicalSubject"]["Bag"]["li"], lambda k: F.element_at(F.split(k, r"\|"), -1))
    return F.struct(d["_Rating"].try_cast("int").alias("rating"), d["_Label"].alias("label"), d["_Pick"].try_cast("int").alias("pick"), F.coalesce(d["subject"]["Bag"]["li"], leaves).alias("keywords"))


def sidecar_document(rating: Column, label: Column, pick: Column, keywords: Column) -> Column:
    """The XMP document of a photo's rating, label, pick and keywords; `sidecar_values` reads them back. What is null, and
    an empty list of keywords, is left out."""

    def quoted(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    held = [F.coalesce(F.concat(F.lit(f' {name}="'), quoted(c.cast("string")), F.lit('"')), F.lit("")) for name, c in (("xmp:Rating", rating), ("xmp:Label", label), ("xmpDM:Pick", pick))]
    items = F.concat_ws("", F.transform(keywords, lambda k: F.concat(F.lit("<rdf:li>"), quoted(k), F.lit("</rdf:li>"))))
    subject = F.when(F.size(keywords) > 0, F.concat(F.lit("<dc:subject><rdf:Bag>"), items, F.lit("</rdf:Bag></dc:subject>"))).otherwise(F.lit(""))
    return F.concat(F.lit(_SIDECAR_HEAD), *held, F.lit(">"), subject, F.lit("</rdf:Description></rdf:RDF></x:xmpmeta>"))

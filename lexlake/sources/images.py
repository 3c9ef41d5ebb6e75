"""Images inside of documents: members of packages and data URIs, within limits, with what was left out."""

from __future__ import annotations

import base64
import binascii
import hashlib
import posixpath
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexlake.sources.files import check_package, decode

#: Images of a document, and bytes of one. Fixed values.
MOST_IMAGES, MOST_BYTES = 100, 10 << 20
#: Types by extension. Fixed values.
TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp"}
OTHER = "application/octet-stream"

_DATA = re.compile(r"data:([\w.+-]+/[\w.+-]+)?(?:;[\w=.+-]+)*?;base64,([A-Za-z0-9+/=\s%]+)")
_RELATED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def type_of(name: str) -> str:
    return TYPES.get(name.rpartition(".")[2].lower(), OTHER)


def package_images(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(type, bytes) of a word-processor package's images: in the order in which its text names them, then those it doesn't, by name; each once."""
    package = check_package(data)
    names = [n for n in package.namelist() if n.startswith("word/media/")]
    targets = {}
    if "word/_rels/document.xml.rels" in package.namelist():
        for r in ElementTree.fromstring(package.read("word/_rels/document.xml.rels")):
            if r.get("Type", "").endswith("/image"):
                targets[r.get("Id")] = posixpath.normpath(posixpath.join("word", r.get("Target", ""))).lstrip("/")
    shown = []
    if targets:
        body = ElementTree.fromstring(package.read("word/document.xml"))
        shown = [targets.get(node.get(f"{_RELATED}embed")) for node in body.iter() if node.get(f"{_RELATED}embed")]
    for name in dict.fromkeys([*(n for n in shown if n in names), *sorted(names)]):
        yield type_of(name), package.read(name)


def page_images(text: str) -> Iterator[tuple[str, bytes]]:
    """(type, bytes) of the images that a page or a markdown text holds as base64 data, in order. What doesn't decode is none."""
    for m in _DATA.finditer(text):
        if m[1] and not m[1].startswith("image/"):
            continue
        try:
            yield m[1] or OTHER, base64.b64decode(re.sub(r"\s|%0[AaDd]", "", m[2]), validate=True)
        except (binascii.Error, ValueError):
            continue


def images_of(data: bytes, kind: str) -> Iterator[tuple[str, bytes]]:
    return package_images(data) if kind == "docx" else page_images(decode(data)) if kind in ("html", "htm", "md") else iter(())


def list_images(files: DataFrame) -> DataFrame:
    """(path, place, media_type, size, sha256, content, error) of files (path, kind, content): a row for each image, in place from 0.

    A damaged file has one row, with its error alone. Other kinds of file have none.
    """
    kind = files.schema["path"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "place", "media_type", "size", "sha256", "content", "error"]
        kinds = pa.int32(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()

        def packed(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((key, *kinds))], names=names)

        for batch in batches:
            key = batch.schema.field("path").type
            for path, form, data in zip(*(batch.column(c).to_pylist() for c in ("path", "kind", "content")), strict=True):
                place = 0
                try:
                    for media, raw in images_of(data or b"", form or ""):
                        yield packed([(path, place, media, len(raw), hashlib.sha256(raw).hexdigest(), raw, None)], key)
                        place += 1
                except Exception as e:  # a damaged file must not end the job
                    yield packed([(path, place, None, None, None, None, f"PARSE_FAILED: {e}"[:300])], key)

    return files.select("path", F.lower("kind").alias("kind"), "content").mapInArrow(found, f"path {kind}, place int, media_type string, size bigint, sha256 string, content binary, error string")


def collect_images(found: DataFrame, most: int = MOST_IMAGES, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(assets, warnings) of list_images: what a document keeps, and one row for each image it doesn't.

    Of images with equal bytes in a document the first counts. Then, in order: one above most_bytes is left out; of the others
    the first most are kept, as img_1, img_2, ... warnings: (path, place, reason): IMAGE_BYTES, IMAGE_COUNT, or what is wrong with
    the file. Images of equal bytes are no warning. Numbers of a document are given by a window over its rows without their bytes.
    """
    slim = found.select("path", "place", "media_type", "size", "sha256", "error")
    first = slim.filter("error IS NULL").groupBy("path", "sha256").agg(F.min(F.struct("place", "media_type", "size")).alias("f")).select("path", "sha256", "f.*")
    fits = F.col("size") <= most_bytes
    before: Column = F.coalesce(F.sum(fits.cast("int")).over(W.partitionBy("path").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # Past the limit on their number, images are left out for that, whatever their size.
    reason = F.when(before >= most, "IMAGE_COUNT").when(~fits, "IMAGE_BYTES")
    judged = first.withColumn("reason", reason).withColumn("image_id", F.concat(F.lit("img_"), (before + 1).cast("string")))
    kept = judged.filter("reason IS NULL").select("path", "place", "image_id", "media_type", "size", "sha256")
    assets = kept.join(found.select("path", "place", "content"), ["path", "place"])
    return assets, judged.filter("reason IS NOT NULL").select("path", "place", "reason").unionByName(slim.filter("error IS NOT NULL").select("path", "place", F.col("error").alias("reason")))


def read_images(spark: SparkSession, path: str, most: int = MOST_IMAGES, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Assets and warnings of the files under a path of any store."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return collect_images(list_images(files.select("path", F.regexp_extract("path", r"\.([^./]+)$", 1).alias("kind"), "content")), most, most_bytes)

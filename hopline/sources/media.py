"""Media values: ``@file:``, ``@base64:`` and ``@uri:`` texts to a URI and a MIME type.

Bytes of files and inline values become rows (blob_id, mime, content,
source) keyed by their SHA-256; their URI names that key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopline.errors import LoadError
from hopline.plans.schema import Prop

BLOB_URI = "blob://sha256/"
#: Prefix of the column with what a media property was given as, by which it is embedded.
MEDIA_KEY = "__media_"
#: What a content begins with (offset, bytes), in this order, and its type.
MAGIC = (
    (((0, b"\x89PNG\r\n\x1a\n"),), "image/png"),
    (((0, b"\xff\xd8\xff"),), "image/jpeg"),
    (((0, b"GIF87a"),), "image/gif"),
    (((0, b"GIF89a"),), "image/gif"),
    (((0, b"RIFF"), (8, b"WEBP")), "image/webp"),
    (((0, b"%PDF-"),), "application/pdf"),
    (((0, b"RIFF"), (8, b"WAVE")), "audio/wav"),
    (((0, b"ID3"),), "audio/mpeg"),
    (((4, b"ftyp"),), "video/mp4"),
)
#: File endings and their types.
ENDINGS = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "pdf": "application/pdf",
    "mp3": "audio/mpeg", "wav": "audio/wav", "mp4": "video/mp4", "m4v": "video/mp4", "mov": "video/quicktime",
}


def mime_of_bytes(content: Column) -> Column:
    out = F.lit(None).cast("string")
    for marks, mime in reversed(MAGIC):
        cond = F.lit(True)
        for at, mark in marks:
            cond &= F.substring(content, at + 1, len(mark)) == F.lit(bytearray(mark))
        if mime == "audio/mpeg":  # or frames without a head: eleven set bits
            cond |= F.hex(F.substring(content, 1, 2)).rlike("^FF[EF]")
        out = F.when(cond, F.lit(mime)).otherwise(out)
    return out


def mime_of_name(name: Column) -> Column:
    ending = F.lower(F.regexp_extract(F.regexp_replace(name, "[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for e, mime in ENDINGS.items():
        out = F.when(ending == e, F.lit(mime)).otherwise(out)
    return out


def resolve(rows: DataFrame, p: Prop, base: str | None = None, kind: str = "") -> tuple[DataFrame, DataFrame]:
    """The rows with the media property and its MIME property resolved, and the blobs they name.

    A column ``MEDIA_KEY`` + name has the stem of a file's name, or for an
    inline value its type ``kind`` and property.  Relative files are taken from ``base``.  A given MIME type must not
    contradict the content's own.
    """
    raw, mime = F.col(f"`{p.name}`"), F.nullif(F.trim(F.col(f"`{p.media}`")), F.lit(""))
    spark = rows.sparkSession
    known = raw.isNull() | raw.startswith("@file:") | raw.startswith("@base64:") | (raw.startswith("@uri:") & (F.trim(F.substring(raw, 6, 1 << 30)) != "")) | raw.startswith(BLOB_URI)
    if rows.filter(~known).limit(1).count():
        raise LoadError(f"{p.name} must be @file:, @base64: or @uri:")
    path = F.when(raw.startswith("@file:"), F.substring(raw, 7, 1 << 30))
    path = F.when(path.startswith("/") | path.contains("://"), path).otherwise(F.concat(F.lit(f"{base}/" if base else ""), path))
    rows = rows.withColumn("__path", path)
    paths = [r[0] for r in rows.select("__path").filter("__path IS NOT NULL").distinct().collect()]  # a listing, as any file scan has
    if paths:
        files = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/+", "/").alias("__read"), F.col("content").alias("__content"))
        rows = rows.join(files, F.col("__path") == F.col("__read"), "left").drop("__read")
    else:
        rows = rows.withColumn("__content", F.lit(None).cast("binary"))
    inline = F.when(raw.startswith("@base64:"), F.try_to_binary(F.substring(raw, 9, 1 << 30), F.lit("base64")))
    rows = rows.withColumn("__content", F.coalesce("__content", inline))
    found = F.coalesce(mime_of_bytes(F.col("__content")), mime_of_name(F.coalesce("__path", raw)))
    sniffed = mime_of_bytes(F.col("__content"))
    rows = rows.withColumns({"__mime": F.coalesce(mime, found), "__clash": F.coalesce(mime != sniffed, F.lit(False)), "__blob": F.sha2("__content", 256)})
    lost = raw.isNotNull() & ~raw.startswith(BLOB_URI) & ((~raw.startswith("@uri:") & F.col("__content").isNull()) | F.col("__mime").isNull() | F.col("__clash"))
    bad = rows.filter(lost).select(raw.alias("r"), "__mime", "__clash").limit(1).collect()
    if bad:
        why = "has another type than its MIME property says" if bad[0]["__clash"] else "can't be read" if bad[0]["__mime"] else "has no known type"
        raise LoadError(f"{p.name}: {bad[0]['r'][:100]} {why}")
    blobs = rows.filter("__content IS NOT NULL").select(F.col("__blob").alias("blob_id"), F.col("__mime").alias("mime"), F.col("__content").alias("content"), F.coalesce("__path", F.lit("inline")).alias("source"))
    uri = F.when(F.col("__content").isNotNull(), F.concat(F.lit(BLOB_URI), F.col("__blob"))).when(raw.startswith("@uri:"), F.trim(F.substring(raw, 6, 1 << 30))).otherwise(raw)
    columns = [uri.alias(c) if c == p.name else F.col("__mime").alias(c) if c == p.media else F.col(f"`{c}`") for c in rows.columns if not c.startswith("__") or c in ("__id", "__line", "__problem") or c.startswith(MEDIA_KEY)]
    stem = F.nullif(F.regexp_extract("__path", r"([^/]+?)(?:\.[^./]*)?$", 1), F.lit(""))
    columns.append(F.coalesce(stem, F.when(raw.startswith("@base64:"), F.lit(f"inline-base64:{kind}:{p.name}"))).alias(f"{MEDIA_KEY}{p.name}"))
    return rows.select(*columns), blobs.dropDuplicates(["blob_id"])

"""Binary model files: one language per file, or a bundle of them; little-endian, with checksums.

A file has a 256-byte header (magic, version, code, flags, corpus scalars, OOV, section table, CRC), then each
section's records and their CRC. A bundle has a header, an index of (code, offset, length), then the files. Character
positions are stored by row only, and counts not at all, so those columns are null in a model that was read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langloom import constants as K
from langloom.operators.model import Model

RECORD = np.dtype([("key", "<u4"), ("q", "<i2")])
IDF_RECORD = np.dtype([("key", "<u4"), ("q", "<u2")])
HISTS = {K.WORD_LENGTH: K.WORD_BINS, K.SENTENCE_LENGTH: K.SENTENCE_BINS}


class ModelFileError(ValueError):
    """``code``: too_short, bad_magic, bad_version, bad_checksum, bad_text, bad_section or truncated."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"model file: {code.replace('_', ' ')}{detail and f' ({detail})'}")
        self.code = code


def encode_one(lang: str, head: dict, sections: dict[int, bytes]) -> bytes:
    h = bytearray(K.HEADER_BYTES)
    h[0:6] = K.ONE_MAGIC + struct.pack("<H", K.FILE_VERSION)
    h[6:14] = lang.encode()[:8].ljust(8, b"\0")
    h[14:50] = struct.pack("<HIQQfffh", head["flags"], head["docs"], head["chars_total"], head["tokens_total"], head["avg_doc_len"], head["bm25_k1"], head["bm25_b"], head["oov_logprob_q"])
    at, body = K.HEADER_BYTES, bytearray()
    for i in range(K.SECTIONS):
        data = sections.get(i, b"")
        size = 2 if i in (*HISTS, K.CLASS_PAIR) else 6
        struct.pack_into("<III", h, K.TABLE_AT + 12 * i, at, len(data), len(data) // size)
        body += data + struct.pack("<I", zlib.crc32(data))
        at += len(data) + 4
    struct.pack_into("<I", h, 252, zlib.crc32(bytes(h[:252])))
    return bytes(h) + bytes(body)


def encode_bundle(items: list[tuple[str, bytes]]) -> bytes:
    head = bytearray(K.HEADER_BYTES)
    head[0:8] = K.MANY_MAGIC + struct.pack("<HH", K.FILE_VERSION, min(len(items), 65535))
    struct.pack_into("<I", head, 252, zlib.crc32(bytes(head[:252])))
    at, index = K.HEADER_BYTES + 16 * len(items), b""
    for lang, blob in items:
        index += lang.encode()[:8].ljust(8, b"\0") + struct.pack("<II", at, len(blob))
        at += len(blob)
    return bytes(head) + index + b"".join(b for _, b in items)


def _head(blob: bytes, magic: bytes) -> None:
    if len(blob) < K.HEADER_BYTES:
        raise ModelFileError("too_short")
    if blob[:4] != magic:
        raise ModelFileError("bad_magic")
    if struct.unpack_from("<H", blob, 4)[0] != K.FILE_VERSION:
        raise ModelFileError("bad_version")
    if struct.unpack_from("<I", blob, 252)[0] != zlib.crc32(blob[:252]):
        raise ModelFileError("bad_checksum", "header")


def parse_one(blob: bytes) -> tuple[dict, dict[int, bytes]]:
    """(header, sections) of a one-language file; every part is checked."""
    _head(blob, K.ONE_MAGIC)
    try:
        lang = blob[6:14].split(b"\0")[0].decode()
    except UnicodeDecodeError as e:
        raise ModelFileError("bad_text") from e
    names = ("flags", "docs", "chars_total", "tokens_total", "avg_doc_len", "bm25_k1", "bm25_b", "oov_logprob_q")
    head = {"lang": lang} | dict(zip(names, struct.unpack_from("<HIQQfffh", blob, 14), strict=True))
    sections = {}
    table = [struct.unpack_from("<II", blob, K.TABLE_AT + 12 * i) for i in range(K.SECTIONS)]
    for i, (at, size) in enumerate(table):
        if at + size > len(blob):
            raise ModelFileError("bad_section", str(i))
    for i, (at, size) in enumerate(table):
        data = blob[at : at + size]
        if size:
            if at + size + 4 > len(blob):
                raise ModelFileError("truncated", str(i))
            if struct.unpack_from("<I", blob, at + size)[0] != zlib.crc32(data):
                raise ModelFileError("bad_checksum", f"section {i}")
        sections[i] = data
    return head, sections


def parse_bundle(blob: bytes) -> list[bytes]:
    _head(blob, K.MANY_MAGIC)
    n = struct.unpack_from("<H", blob, 6)[0]
    if K.HEADER_BYTES + 16 * n > len(blob):
        raise ModelFileError("truncated", "index")
    out = []
    for i in range(n):
        at, size = struct.unpack_from("<II", blob, K.HEADER_BYTES + 16 * i + 8)
        if at + size > len(blob):
            raise ModelFileError("bad_section", f"file {i}")
        parse_one(blob[at : at + size])
        out.append(blob[at : at + size])
    return out


def parse_any(blob: bytes) -> list[bytes]:
    """The one-language files of a bundle or of a single file."""
    return parse_bundle(blob) if blob[:4] == K.MANY_MAGIC else [parse_one(blob) and blob]


LONG = "lang string, section int, key long, sub int, q int"
HEADER = "lang_index int, lang string, flags int, docs long, chars_total long, tokens_total long, avg_doc_len float, bm25_k1 float, bm25_b float, oov_logprob_q int"


def long_form(model: Model) -> DataFrame:
    """All tables but the header as (lang, section, key, sub, q)."""
    row = lambda df, section, key, sub: df.select("lang", F.lit(section).alias("section") if isinstance(section, int) else section, F.col(key).cast("long").alias("key"), sub.cast("int").alias("sub"), F.col("q"))
    return (
        row(model.ngrams, F.col("section").cast("int"), "key", F.lit(0))
        .unionByName(row(model.idf.withColumnRenamed("idf_q", "q"), K.TOKEN_IDF, "key", F.lit(0)))
        .unionByName(row(model.hists, F.col("section").cast("int"), "bin", F.lit(0)))
        .unionByName(row(model.charpos, K.CHAR_POSITION, "row_index", F.col("slot")))
        .unionByName(row(model.classes, K.CLASS_PAIR, "a", F.col("b")))
    )


def encode(model: Model) -> DataFrame:
    """(lang_index, lang, blob): a file per language. A language's rows are bounded by TOP_K."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows.iloc[0]
        rows = rows[rows["section"].notna()].sort_values(["section", "key", "sub"])
        sections = {}
        for section, part in rows.groupby("section"):
            if section in K.NGRAM_SECTIONS or section == K.TOKEN_IDF:
                data = np.zeros(len(part), dtype=IDF_RECORD if section == K.TOKEN_IDF else RECORD)
                data["key"], data["q"] = part["key"], part["q"]
            else:
                data = part["q"].to_numpy().astype("<i2" if section == K.CHAR_POSITION else "<u2")
            sections[int(section)] = data.tobytes()
        return pd.DataFrame({"lang_index": [head["lang_index"]], "lang": [head["lang"]], "blob": [encode_one(head["lang"], head, sections)]})

    rows = F.broadcast(model.header).join(long_form(model), "lang", "left")
    return rows.groupBy("lang").applyInPandas(pack, "lang_index int, lang string, blob binary")


def _unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for lang_index, blob in zip(frame["lang_index"], frame["blob"], strict=True):
            head, sections = parse_one(bytes(blob))
            for s, data in sections.items():
                sub: int | np.ndarray = 0
                if s in K.NGRAM_SECTIONS or s == K.TOKEN_IDF:
                    r = np.frombuffer(data, IDF_RECORD if s == K.TOKEN_IDF else RECORD)
                    key, q = r["key"], r["q"]
                elif s in HISTS:
                    q = np.frombuffer(data, "<u2")
                    key = np.arange(len(q))
                else:
                    q = np.frombuffer(data, "<i2" if s == K.CHAR_POSITION else "<u2")
                    width = 3 if s == K.CHAR_POSITION else K.CLASSES
                    key, sub = np.arange(len(q)) // width, np.arange(len(q)) % width
                yield pd.DataFrame({"lang_index": lang_index, "lang": head["lang"], "section": s, "key": np.asarray(key, np.int64), "sub": sub, "q": np.asarray(q, np.int32), "head": None}, index=range(len(q)))
            scalars = [float(x) for k, x in head.items() if k != "lang"]
            yield pd.DataFrame([{"lang_index": lang_index, "lang": head["lang"], "section": -1, "key": 0, "sub": 0, "q": 0, "head": scalars}])


def decode(blobs: DataFrame) -> Model:
    """The model of one-language files (lang_index, blob)."""
    rows = blobs.select("lang_index", "blob").mapInPandas(_unpack, f"lang_index int, {LONG}, head array<double>")
    head = rows.where("section = -1")
    cols = ["flags int", "docs long", "chars_total long", "tokens_total long", "avg_doc_len float", "bm25_k1 float", "bm25_b float", "oov_logprob_q int"]
    header = head.select("lang_index", "lang", *[F.col("head")[i].cast(c.split()[1]).alias(c.split()[0]) for i, c in enumerate(cols)])
    of = lambda *s: rows.where(F.col("section").isin(*s))
    return Model(
        header,
        of(*K.NGRAM_SECTIONS).select("lang", "section", "key", F.lit(None).cast("long").alias("cnt"), "q"),
        of(K.TOKEN_IDF).select("lang", "key", F.col("q").alias("idf_q")),
        of(*HISTS).select("lang", "section", F.col("key").cast("int").alias("bin"), "q"),
        of(K.CHAR_POSITION).select("lang", F.col("key").cast("int").alias("row_index"), F.lit(None).cast("long").alias("cp"), F.col("sub").alias("slot"), "q"),
        of(K.CLASS_PAIR).select("lang", F.col("key").cast("int").alias("a"), F.col("sub").alias("b"), "q"),
    )


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    out.write(data)
    out.close()


def write_files(model: Model, directory: str, bundle: bool = True) -> list[str]:
    """<code>.lid for each language and, unless told not to, combined.lid; files are read back and checked.

    At most a few hundred KB a language pass the driver.
    """
    spark, paths, items = model.header.sparkSession, [], []
    for r in encode(model).orderBy("lang_index").toLocalIterator():
        items.append((r["lang"], bytes(r["blob"])))
        paths.append(f"{directory.rstrip('/')}/{r['lang']}.lid")
        _put(spark, paths[-1], items[-1][1])
    for (lang, _), path in zip(items, paths, strict=True):
        back = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
        if parse_one(back)[0]["lang"] != lang.encode()[:8].decode(errors="ignore"):
            raise ModelFileError("bad_text", path)
    if bundle:
        paths.append(f"{directory.rstrip('/')}/combined.lid")
        _put(spark, paths[-1], encode_bundle(items))
    return paths


def read_file(spark: SparkSession, path: str) -> Model:
    """The model of a bundle or of a one-language file."""
    blob = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    return decode(spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(parse_any(blob))], "lang_index int, blob binary"))


def find_file(spark: SparkSession, directory: str, model: str | None = None) -> str:
    """``model``, or the directory's first bundle, or its first one-language file, known by their magic."""
    if model:
        return model
    base, fs = _fs(spark, directory)
    found: dict[bytes, str] = {}
    for status in fs.listStatus(base) if fs.exists(base) else []:
        if status.isFile() and status.getLen() >= K.HEADER_BYTES:
            stream = fs.open(status.getPath())
            magic = bytes(b & 255 for b in (stream.readByte() for _ in range(4)))
            stream.close()
            name = status.getPath().toString()
            found[magic] = min(name, found.get(magic, name))
    for magic in (K.MANY_MAGIC, K.ONE_MAGIC):
        if magic in found:
            return found[magic]
    raise FileNotFoundError(f"no model in {directory}")

"""Payload encodings and decoders.

Every decoder gives a JSON ``document``; the later steps know only that form.
All of it is row-local, so a mixed feed is decoded in one scan.
"""

from __future__ import annotations

import json
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fieldloom.functions import document as D
from fieldloom.functions.rows import keep_last, let


def payload_text(df: DataFrame) -> Column:
    """The payload as text without a byte order mark, NULL where the bytes are not UTF-8."""
    if dict(df.dtypes)["payload"] == "string":
        return F.col("payload")
    text = F.col("payload").cast("string")
    marked = F.startswith(F.col("payload"), F.lit(b"\xef\xbb\xbf"))
    bare = F.when(marked, F.substring("payload", 4, 2_147_483_647).cast("string")).otherwise(text)
    return F.when(F.is_valid_utf8(text), bare)


def payload_bytes(df: DataFrame) -> Column:
    return F.col("payload").cast("binary")


def decode_json(df: DataFrame) -> DataFrame:
    """Add ``decoded``, a struct of the ``document`` text and its parsed ``root``.

    Broken text becomes ``{"_raw": hex}``; a value that is not an object becomes ``{"value": ...}``.
    """
    raw = F.lower(F.hex(payload_bytes(df)))
    return df.withColumn("decoded", D.read_document(payload_text(df), raw))


def _element(node: ElementTree.Element):
    """One element as plain data: attributes, text and children grouped by tag."""
    groups: dict[str, list] = {}
    for child in node:
        groups.setdefault(child.tag, []).append(_element(child))
    text = (node.text or "").strip()
    if text and not groups and not node.attrib:
        return text
    head = {"@attributes": dict(node.attrib)} if node.attrib else {}
    head.update({"#text": text} if text else {})
    return {**head, **{tag: found if len(found) > 1 else found[0] for tag, found in groups.items()}}


def _xml_document(text: str | None) -> str | None:
    if text is None or "<!ENTITY" in text:
        return None
    try:
        data = _element(ElementTree.fromstring(text))
    except (ElementTree.ParseError, ValueError):
        return None
    return json.dumps(data if isinstance(data, dict) else {"_value": data}, ensure_ascii=False)


@F.pandas_udf(StringType())
def _xml_udf(texts: pd.Series) -> pd.Series:
    # Spark's XML readers need a schema and stop on broken text, hence this helper
    return texts.map(_xml_document)


def xml_document(text: Column) -> Column:
    """NULL unless the text is well-formed XML. Text that cannot be XML is not sent to Python."""
    return _xml_udf(F.when(F.ltrim(text).startswith("<"), text))


def decode_xml(df: DataFrame) -> DataFrame:
    """A8"""
    return df.withColumn("document", xml_document(payload_text(df)))


# A quote inside a quoted cell is written twice, which reads as two quoted parts side by side.
_CSV_LINE = r'((?:[^"\r\n]++|"[^"]*+")++)'
_CSV_CELL = r',((?:"[^"]*+")++|[^,]*+)'


def _csv_lines(text: Column) -> Column:
    """Lines that are not empty. Only quoted text, which may hold line ends, needs the slower pattern."""
    plain = F.filter(F.split(text, r"\r\n|\r|\n"), lambda line: line != "")
    return F.when(text.contains('"'), F.regexp_extract_all(text, F.lit(_CSV_LINE), F.lit(1))).otherwise(plain)


def _csv_cells(line: Column) -> Column:
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CSV_CELL), F.lit(1))
    return F.transform(
        cells,
        lambda c: F.when(
            c.startswith('"') & c.endswith('"') & (F.length(c) > 1),
            F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')),
        ).otherwise(c),
    )


def csv_document(text: Column) -> Column:
    """Header line and rows; one row stands for itself, else ``{rows, _count}``."""

    def build(lines: Column) -> Column:
        def row(header: Column, line: Column) -> Column:
            pairs = let(
                _csv_cells(line),
                lambda cells: F.transform(
                    header, lambda h, i: F.struct(h.alias("key"), F.get(cells, i).alias("value"))
                ),
            )
            return F.map_from_entries(keep_last(pairs, "key"))

        rows = let(
            _csv_cells(F.get(lines, F.lit(0))),
            lambda header: F.transform(
                F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), lambda line: row(header, line)
            ),
        )
        return let(
            rows,
            lambda r: F.when(F.size(r) == 1, F.to_json(F.get(r, F.lit(0)))).otherwise(
                F.to_json(F.struct(r.alias("rows"), F.size(r).alias("_count")))
            ),
        )

    return let(_csv_lines(text), build)


def decode_csv(df: DataFrame) -> DataFrame:
    """Comma only."""
    return df.withColumn("document", csv_document(payload_text(df)))


def register_document(data: Column) -> Column:
    """A10: big-endian words of 16 bits; a last single byte stands alone."""

    def words(text: Column) -> Column:
        count = F.ceil(F.length(text) / 4).cast("int")
        spots = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        values = F.transform(
            spots, lambda i: F.conv(F.substring(text, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint")
        )
        return F.to_json(F.struct(values.alias("registers"), count.alias("_count")))

    return let(F.hex(data), words)


def decode_registers(df: DataFrame) -> DataFrame:
    return df.withColumn("document", register_document(payload_bytes(df)))


def binary_document(data: Column) -> Column:
    # Spark may cut long base64 text into lines
    one_line = F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))
    return F.to_json(F.struct(F.lower(F.hex(data)).alias("raw_hex"), one_line.alias("raw_base64")))


def decode_binary(df: DataFrame) -> DataFrame:
    """A11"""
    return df.withColumn("document", binary_document(payload_bytes(df)))


def is_delimited(text: Column) -> Column:
    """A delimiter that occurs equally often, and at all, on every line."""
    lines = F.split(F.trim(text, F.lit(" \t\r\n")), "\n")

    def steady(mark: str) -> Column:
        counts = F.transform(lines, lambda line: F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit(""))))
        return let(counts, lambda c: (F.get(c, F.lit(0)) > 0) & (F.array_min(c) == F.array_max(c)))

    return steady(",") | steady(";") | steady("\t")


def classify_encoding(df: DataFrame) -> DataFrame:
    """Add ``payload_encoding``. Registers are never guessed and CBOR is not read."""
    text, data = payload_text(df), payload_bytes(df)
    first = F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("int")
    looks_protobuf = text.isNull() & (F.octet_length(data) >= 2) & first.bitwiseAND(7).isin(0, 1, 2, 5)
    return df.withColumn(
        "payload_encoding",
        F.when(F.octet_length(data) == 0, "binary")
        .when(D.is_whole_value(text), "json")
        .when(xml_document(text).isNotNull(), "xml")
        .when(F.coalesce(is_delimited(text), F.lit(False)), "csv")
        .when(looks_protobuf, "protobuf")
        .otherwise("binary"),
    )


def encoding_profile(df: DataFrame) -> DataFrame:
    return (
        classify_encoding(df)
        .groupBy("protocol", "payload_encoding")
        .agg(F.count(F.lit(1)).alias("messages"))
    )


SUPPORTED = ["json", "xml", "csv", "modbus_registers", "binary"]


def decode_messages(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decoded, quarantine). Encodings without a decoder go to the quarantine."""
    known = F.coalesce(F.col("payload_encoding").isin(SUPPORTED), F.lit(False))
    good, bad = df.filter(known), df.filter(~known)
    text, data, encoding = payload_text(df), payload_bytes(df), F.col("payload_encoding")
    raw = F.concat(F.lit('{"_raw":"'), F.lower(F.hex(data)), F.lit('"}'))
    other = (
        F.when(encoding == "xml", xml_document(F.when(encoding == "xml", text)))
        .when(encoding == "csv", csv_document(text))
        .when(encoding == "modbus_registers", register_document(data))
        .when(encoding == "binary", binary_document(data))
    )
    # JSON text goes through its own checks, the others are turned into JSON first
    payload = F.when(encoding == "json", F.coalesce(text, raw)).otherwise(F.coalesce(other, raw))
    keep = F.struct(F.col("payload"))
    decoded = decode_json(good.withColumn("_kept", keep).withColumn("payload", payload))
    decoded = decoded.withColumn("payload", F.col("_kept.payload")).drop("_kept")
    return decoded, bad.withColumn("reason", F.concat(F.lit("unsupported encoding: "), F.coalesce(encoding, F.lit("none"))))

"""Secrets in text: redaction, scanning, and failure messages without volatile values."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REDACTED = "<redacted>"
#: Kinds of credentials that a finding names, so that reports of different tools can be compared, and the
#: expressions that their definition asks for. Groups 1 and (where present) 2 stay.
SECRET_PATTERNS = (
    ("bearer-token", r"(?i)(\bbearer\s+)[^\s,;]+", "$1<redacted>"),
    ("basic-credential", r"(?i)(\bbasic\s+)[A-Za-z0-9+/=]+", "$1<redacted>"),
    ("uri-credential", r"(?i)(://[^/\s:@]+:)[^@\s]+(@)", "$1<redacted>$2"),
    ("named-secret", r"(?i)(\b(?:password|passwd|secret|token|api[_-]?key|access[_-]?key|authorization|client[_-]?secret)\b\s*[:=]\s*[\"']?)[^\s,;\"']+", "$1<redacted>"),
)
#: Words that make a member's name that of a secret, wherever they stand in it. Names are compared in lower case and
#: without anything but letters and digits, so that apiKey, api-key and API_KEY are one name.
SECRET_WORDS = ("password", "passwd", "passphrase", "secret", "token", "apikey", "accesskey", "privatekey", "signingkey", "authorization", "credential", "connectionstring", "sessioncookie")
UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
NUMBER = r"\b(0x[0-9a-fA-F]+|\d+(\.\d+)?)\b"


def redact_text(text: Column) -> Column:
    for _, pattern, kept in SECRET_PATTERNS:
        text = F.regexp_replace(text, pattern, kept)
    return text


def redact_value(key: Column, value: Column) -> Column:
    """A leaf whose key names a secret is hidden whole; other text is redacted by pattern."""
    plain = F.regexp_replace(F.lower(key), "[^a-z0-9]+", "")
    return F.when(plain.rlike("|".join(SECRET_WORDS)) & value.isNotNull(), REDACTED).otherwise(redact_text(value))


def names_secret(key: str) -> bool:
    """redact_value's test of a name, outside plans."""
    plain = "".join(c for c in key.lower() if c.isascii() and c.isalnum())
    return any(word in plain for word in SECRET_WORDS)


def scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document and kind of secret with the number of findings, never their values."""
    counts = [F.struct(F.lit(name).alias("kind"), F.regexp_count(F.col(text_col), F.lit(pattern)).alias("n")) for name, pattern, _ in SECRET_PATTERNS]
    found = df.select(F.col(id_col).alias("id"), F.explode(F.array(*counts)).alias("f"))
    return found.where("f.n > 0").select("id", F.col("f.kind").alias("kind"), F.col("f.n").cast("long").alias("findings"))


def scan_files(spark: SparkSession, path: str, max_bytes: int = 2_000_000) -> DataFrame:
    """path, member, kind, findings of the files below a folder and of the members of ZIP files there, never values.

    Files and members of more than max_bytes are not read: they have a row of kind too_large. Bytes that aren't UTF-8
    are read as they come.
    """
    patterns = [(name, p) for name, p, _ in SECRET_PATTERNS]

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import io
        import re
        import zipfile

        import pandas as pd

        def texts(name: str, size: int, content: bytes | None) -> Iterator[tuple[str | None, bytes | None]]:
            if content is None or size > max_bytes:
                yield None, None
            elif content[:4] == b"PK\x03\x04":
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for i in archive.infolist():
                            if not i.is_dir():
                                data = archive.open(i).read(max_bytes + 1)  # what it says of its size needn't be true
                                yield i.filename, data if len(data) <= max_bytes else None
                except (zipfile.BadZipFile, OSError, ValueError, RuntimeError):
                    yield None, content
            else:
                yield None, content

        for pdf in source:
            rows = []
            for name, size, content in zip(pdf["path"], pdf["length"], pdf["content"], strict=True):
                for member, data in texts(name, size, content):
                    if data is None:
                        rows.append((name, member, "too_large", 1))
                        continue
                    text = data.decode("utf-8", "replace")
                    rows += [(name, member, kind, n) for kind, p in patterns if (n := sum(1 for _ in re.finditer(p, text)))]
            yield pd.DataFrame(rows, columns=["path", "member", "kind", "findings"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    read = files.select("path", "length", F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"))
    return read.mapInPandas(run, "path string, member string, kind string, findings long")


def normalise_message(message: Column) -> Column:
    """Secrets, UUIDs and numbers become placeholders and white space one blank, so equal failures group."""
    out = F.regexp_replace(message, r"(?i)\b(password|passwd|secret|token|api[_-]?key)\s*[:=]\s*[^\s,;]+", "$1=<redacted>")
    out = F.regexp_replace(F.regexp_replace(out, UUID, "<uuid>"), NUMBER, "<number>")
    return F.trim(F.regexp_replace(out, r"\s+", " "))

"""First look at a file's bytes."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the file formats.
ZIP, COMPOUND = "504B0304", "D0CF11E0A1B11AE1"


def magic(content: Column) -> Column:
    """empty, package, compound or not_ooxml, by length and first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(content.isNull() | (F.length(content) == 0), "empty")
        .when(head.startswith(ZIP), "package")
        .when(head == COMPOUND, "compound")
        .otherwise("not_ooxml")
    )


class Unreadable(Exception):
    """A file that is no workbook package: a reason to show, and its category."""

    def __init__(self, reason: str, category: str):
        super().__init__(reason)
        self.category = category


def opened(content: bytes) -> zipfile.ZipFile:
    """The workbook package in the bytes, or Unreadable with category empty, encrypted, legacy_ole, not_ooxml, corrupt or not_workbook."""
    if not content:
        raise Unreadable("the file is empty", "empty")
    if content[:8].hex().upper() == COMPOUND:
        if "EncryptedPackage".encode("utf-16-le") in content:
            raise Unreadable("the workbook is encrypted", "encrypted")
        raise Unreadable("an old binary workbook", "legacy_ole")
    if content[:2] != b"PK":
        raise Unreadable("no workbook package", "not_ooxml")
    try:
        package = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise Unreadable("a damaged package", "corrupt") from e
    if "xl/workbook.xml" not in package.namelist():
        raise Unreadable("a package without a workbook", "not_workbook")
    return package

"""Column expressions that several corpus operators share (JVM only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
#: Characters outside of blocks in which Unicode lower-casing, of whatever version, changes A-Z alone.
_MAY_CHANGE = r"[^\x00-\x7F\u00DF-\u00FF\u2000-\u20FF\u3000-\u9FFF\uAC00-\uD7A3]"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. The two first branches are the same map by a faster way: no other letter is there to change."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain | ~text.rlike(_MAY_CHANGE), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def salt_of(doc_id: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(salts)).cast("int")

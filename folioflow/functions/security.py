"""Screens, masks and protected columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import _col, file_extension, file_name

# Sensitive-text patterns (card number, e-mail, social security number).
CARD_PATTERN = r"\b\d{16}\b"
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
SSN_PATTERN = r"\b\d{3}-\d{2}-\d{4}\b"
INPUT_PATTERNS = (CARD_PATTERN, EMAIL_PATTERN)
MASK_PATTERNS = (CARD_PATTERN, EMAIL_PATTERN, SSN_PATTERN)
MASK = "[REDACTED]"

# Limits and allowed types.
MAX_INPUT_CHARS = 1000
MAX_FILE_BYTES = 10485760
ALLOWED_TYPES = ("pdf", "txt", "doc", "docx")
MAX_URL_CHARS = 2000

# Content that marks a file as malicious, in the order it is looked for.
MALICIOUS_PATTERNS = ("<?php", "<script", "eval(", "exec(", "system(", "shell_exec(")

# URL rules.
URL_SCHEME = r"^https?://"
PRIVATE_HOST = (
    r"^https?://(localhost|127\.0\.0\.1|192\.168\.|10\.|172\.(1[6-9]|2[0-9]|3[0-1])\.)"
)


def mask_sensitive(
    c: Column | str, patterns: Sequence[str] = MASK_PATTERNS, mask: str = MASK
) -> Column:
    out = _col(c)
    for pattern in patterns:
        out = F.regexp_replace(out, pattern, mask)
    return out


def input_problem(c: Column | str, max_chars: int = MAX_INPUT_CHARS) -> Column:
    """Reason a text is refused, null if it is fine; the first failing test wins."""
    c = _col(c)
    sensitive = F.lit(False)
    for pattern in INPUT_PATTERNS:
        sensitive = sensitive | c.rlike(pattern)
    return (
        F.when(c.isNull() | (c == ""), "Input cannot be empty")
        .when(F.length(c) > max_chars, f"Input exceeds maximum length of {max_chars} characters")
        .when(sensitive, "Input contains sensitive information")
    )


def file_problem(
    size: Column | str,
    extension: Column | str,
    max_bytes: int = MAX_FILE_BYTES,
    allowed: Sequence[str] = ALLOWED_TYPES,
) -> Column:
    extension = F.lower(F.regexp_replace(_col(extension), r"^\.+", ""))
    return F.when(
        _col(size) > max_bytes, f"File size exceeds maximum of {max_bytes} bytes"
    ).when(
        ~extension.isin(*allowed),
        F.concat(F.lit("File type "), extension, F.lit(" not allowed")),
    )


def content_problem(c: Column | str, is_text_file: Column | bool = True) -> Column:
    """First sign of binary or malicious content, null if there is none."""
    c = _col(c)
    flag = F.lit(is_text_file) if isinstance(is_text_file, bool) else is_text_file
    out = F.when(flag & c.contains("\x00"), "File contains binary content")
    for pattern in MALICIOUS_PATTERNS:
        out = out.when(
            c.contains(pattern), f"File contains potentially malicious content: {pattern}"
        )
    return out


def url_problem(c: Column | str) -> Column:
    c = _col(c)
    return (
        F.when(~c.rlike(URL_SCHEME), "URL must start with http:// or https://")
        .when(c.rlike(PRIVATE_HOST), "URL cannot point to localhost or private IP")
        .when(F.length(c) > MAX_URL_CHARS, "URL exceeds maximum length")
    )


def sanitize_filename(c: Column | str, allowed: Sequence[str] = ALLOWED_TYPES) -> Column:
    """Base name with safe characters only; a type that is not allowed gets ``.txt``."""
    safe = F.regexp_replace(file_name(c), r"[^a-zA-Z0-9._-]", "")
    known = file_extension(safe).isin(*[f".{e}" for e in allowed])
    return F.when(known, safe).otherwise(F.concat(safe, F.lit(".txt")))


def encrypt(c: Column | str, key: Column) -> Column:
    """AES-GCM, base64 text."""
    return F.base64(F.aes_encrypt(_col(c).cast("string"), key, F.lit("GCM")))


def decrypt(c: Column | str, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(_col(c)), key, F.lit("GCM")).cast("string")


def pseudonym(c: Column | str) -> Column:
    return F.sha2(_col(c).cast("string"), 256)

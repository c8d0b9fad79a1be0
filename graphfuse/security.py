"""Credentials: encryption through the JVM's AES-GCM, redaction, the master key file."""

from __future__ import annotations

import base64
import os
import re
import stat

from pyspark.sql import SparkSession

from .schema import CryptoError

PREFIX = "enc:v1:"
_NONCE, _TAG = 12, 16


def _b64(raw: bytes) -> str:
    return base64.b64encode(raw).decode().rstrip("=")


def _raw(text: str) -> bytes:
    return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)


def is_encrypted(text: str) -> bool:
    return text.startswith(PREFIX) and text.count(":") == 3


def _cipher(spark: SparkSession, mode: int, key: bytes, nonce: bytes):
    jvm = spark._jvm
    cipher = jvm.javax.crypto.Cipher.getInstance("AES/GCM/NoPadding")
    cipher.init(mode, jvm.javax.crypto.spec.SecretKeySpec(key, "AES"), jvm.javax.crypto.spec.GCMParameterSpec(8 * _TAG, nonce))
    return cipher


def encrypt(spark: SparkSession, plain: str, key: bytes) -> str:
    """``enc:v1:<nonce>:<ciphertext and tag>``, base64 without padding.

    The JVM is called on the driver, so that no plan or log shows the text.
    """
    if len(key) != 32:
        raise CryptoError("the key is of 32 bytes")
    nonce = os.urandom(_NONCE)
    return f"{PREFIX}{_b64(nonce)}:{_b64(bytes(_cipher(spark, 1, key, nonce).doFinal(plain.encode())))}"


def decrypt(spark: SparkSession, text: str, key: bytes) -> str:
    if not is_encrypted(text):
        raise CryptoError("not an encrypted credential")
    _, _, nonce, body = text.split(":")
    try:
        return bytes(_cipher(spark, 2, key, _raw(nonce)).doFinal(_raw(body))).decode()
    except Exception as e:
        raise CryptoError("the credential can't be decrypted") from e


def redact(secret: str) -> str:
    return "***" if len(secret) <= 3 else secret[:3] + "***"


def redact_url(url: str) -> str:
    """A connection string without its password."""
    return re.sub(r"(://[^:/@\s]*):[^@\s]*@", r"\1:***@", re.sub(r"(password=)\S+", r"\1***", url))


def load_master_key(path: str) -> bytes:
    """32 raw bytes from a file that only its owner can read."""
    if stat.S_IMODE(os.stat(path).st_mode) & 0o077:
        raise CryptoError("the key file is open to others")
    with open(path, "rb") as f:
        key = f.read()
    if len(key) != 32:
        raise CryptoError("the key is of 32 bytes")
    return key

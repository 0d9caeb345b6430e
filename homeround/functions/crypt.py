"""Field encryption: key id, a colon, then base64 of AES-GCM with a fresh nonce."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encrypt_field(s: Column, key_id: str, key: bytes) -> Column:
    return F.concat(F.lit(key_id + ":"), F.base64(F.aes_encrypt(s, F.lit(key), F.lit("GCM"))))


def decrypt_field(s: Column, keys: dict[str, bytes]) -> Column:
    """Null where the key id is unknown, or the text does not decrypt."""
    key_id = F.substring_index(s, ":", 1)
    body = F.try_to_binary(F.substring_index(s, ":", -1), F.lit("base64"))
    out = F.lit(None).cast("binary")
    for name, key in keys.items():
        out = F.when(key_id == name, F.try_aes_decrypt(body, F.lit(key), F.lit("GCM"))).otherwise(out)
    return out.cast("string")

"""Headers of signed requests, for ingest jobs that fetch from a venue.

The signature is RSA-PSS over time, method and path with SHA-256, made by the driver's JVM: no
further library is needed, and keys never travel to executors.
"""

from __future__ import annotations

import base64
import time
from pathlib import Path

from pyspark.sql import SparkSession

_SALT = 32
#: Fixed value: the algorithm identifier of RSA keys in DER (its object identifier and a null).
_RSA = bytes.fromhex("300d06092a864886f70d0101010500")


def _tagged(tag: int, content: bytes) -> bytes:
    """A DER value: tag, length, content."""
    n = len(content)
    if n < 128:
        return bytes([tag, n]) + content
    size = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag, 128 + len(size)]) + size + content


def key_bytes(pem: str) -> bytes:
    """A private key in PKCS#8 from PEM text of either form; line breaks may be written as ``\\n``."""
    lines = pem.replace("\\n", "\n").strip().splitlines()
    if not lines or "PRIVATE KEY-----" not in lines[0] or "ENCRYPTED" in pem:
        raise ValueError("no plain private key in PEM form")
    raw = base64.b64decode("".join(line.strip() for line in lines if not line.startswith("-----")))
    if "RSA PRIVATE KEY" not in lines[0]:
        return raw
    return _tagged(0x30, _tagged(0x02, b"\0") + _RSA + _tagged(0x04, raw))


def load_key(path: str | None = None, pem: str | None = None) -> bytes | None:
    """The key of a file, else of a text; None without either."""
    if path:
        return key_bytes(Path(path.strip()).expanduser().read_text())
    return key_bytes(pem) if pem and pem.strip() else None


def _algorithm(spark: SparkSession):
    jvm = spark.sparkContext._jvm
    found = jvm.java.security.Signature.getInstance("RSASSA-PSS")
    spec = jvm.java.security.spec
    found.setParameter(spec.PSSParameterSpec("SHA-256", "MGF1", spec.MGF1ParameterSpec.SHA256, _SALT, 1))
    return found


def signature(spark: SparkSession, key: bytes, method: str, path: str, at_ms: int) -> str:
    """The signature of a request in base64; what stands behind a question mark isn't signed."""
    jvm = spark.sparkContext._jvm
    private = jvm.java.security.KeyFactory.getInstance("RSA").generatePrivate(jvm.java.security.spec.PKCS8EncodedKeySpec(bytearray(key)))
    signer = _algorithm(spark)
    signer.initSign(private)
    signer.update(bytearray(f"{at_ms}{method}{path.split('?')[0]}".encode()))
    return base64.b64encode(bytes(signer.sign())).decode("ascii")


def signed_headers(spark: SparkSession, key_id: str, key: bytes, method: str, path: str, at_ms: int | None = None) -> dict[str, str]:
    at_ms = int(time.time() * 1000) if at_ms is None else at_ms
    return {"KALSHI-ACCESS-KEY": key_id, "KALSHI-ACCESS-SIGNATURE": signature(spark, key, method, path, at_ms), "KALSHI-ACCESS-TIMESTAMP": str(at_ms)}

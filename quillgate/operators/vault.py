"""Encrypted credential records: AES-GCM by the engine, keys derived from a password."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS, KEY_BYTES = 100_000, 32


@F.pandas_udf(T.BinaryType())
def derive_key(password: pd.Series, salt: pd.Series) -> pd.Series:
    """PBKDF2-HMAC-SHA256."""
    return pd.Series([None if p is None or s is None else hashlib.pbkdf2_hmac("sha256", p.encode(), s, ROUNDS, KEY_BYTES) for p, s in zip(password, salt)])


def encrypt_vault(records: DataFrame, password: Column) -> DataFrame:
    """(role, salt, sealed) of rows (role, value): a fresh salt and vector for each row."""
    salt = F.unhex(F.substring(F.sha2(F.concat(F.expr("uuid()"), F.expr("uuid()")).cast("binary"), 256), 1, 32))
    salted = records.withColumn("salt", salt).withColumn("key", derive_key(password, F.col("salt")))
    return salted.select("role", "salt", F.aes_encrypt(F.col("value").cast("binary"), F.col("key"), F.lit("GCM")).alias("sealed"))


def decrypt_vault(vault: DataFrame, password: Column) -> DataFrame:
    """(role, value, opened): a wrong password or changed bytes open nothing."""
    opened = vault.withColumn("key", derive_key(password, F.col("salt"))).withColumn("value", F.try_aes_decrypt("sealed", "key", F.lit("GCM")).cast("string"))
    return opened.select("role", "value", F.col("value").isNotNull().alias("opened"))


def resolve(requests: DataFrame, vault: DataFrame) -> DataFrame:
    """Adds the value and missing to rows with a role; a role without a record is missing."""
    return requests.join(vault.select("role", "value"), "role", "left").withColumn("missing", F.col("value").isNull())

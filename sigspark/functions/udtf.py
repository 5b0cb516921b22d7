"""Python UDTF for inspecting the byte/entropy windows of a file.

For inspection only (one row per window); the feature hot path stays the
Arrow UDF in ``functions.bytes``.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql.functions import udtf

from .bytes import STEP, WINDOW


@udtf(returnType="start: bigint, length: bigint, hbin: int")
class ByteWindows:
    """``udtf_windows``: (start, length, entropy bin) of every 2048-byte window at
    step 1024; a file shorter than one window is a single short window."""

    def eval(self, content: bytes):
        a = np.frombuffer(content if content is not None else b"", dtype=np.uint8)
        if a.shape[0] == 0:
            return
        starts = [0] if a.shape[0] < WINDOW else range(0, a.shape[0] - WINDOW + 1, STEP)
        for s in starts:
            block = a[s:s + WINDOW]
            c = np.bincount(block >> 4, minlength=16)
            p = c.astype(np.float32) / np.float32(WINDOW)
            nz = p[c > 0]
            h = np.float32(np.sum(-nz * np.log2(nz), dtype=np.float32) * np.float32(2))
            yield int(s), int(len(block)), int(min(int(h * np.float32(2)), 15))


def register(spark) -> None:
    spark.udtf.register("byte_windows", ByteWindows)

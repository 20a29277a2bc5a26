"""MinHash signatures (D3) and LSH band parameters.

Token hashes are computed in the JVM (``md5`` → 32-bit); only the 128-way min over each
row's hashes runs in numpy, Arrow-batched through a pandas UDF.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The universal-hash family (a*h + b) mod P with the Mersenne prime 2^31-1,
# so a*h stays below 2^62 in a signed 64-bit integer.
MERSENNE_P = 2147483647
PERM_SEED = 1
EMPTY_TOKEN_PREFIX = "__empty__"
_BLOCK = 4096


def perm_params(num_perm: int = 128, seed: int = PERM_SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(seed)
    a = rng.randint(1, MERSENNE_P, size=num_perm, dtype=np.int64)
    b = rng.randint(0, MERSENNE_P, size=num_perm, dtype=np.int64)
    return a, b


def token_hashes(tokens: Column, ord_col: Column) -> Column:
    """32-bit token hashes reduced mod P; an empty set hashes a per-row marker instead."""
    toks = F.when(F.size(tokens) == 0, F.array(F.concat(F.lit(EMPTY_TOKEN_PREFIX), ord_col.cast("string")))).otherwise(tokens)
    return F.transform(toks, lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % F.lit(MERSENNE_P))


def minhash_udf(num_perm: int = 128, seed: int = PERM_SEED):
    from pyspark.sql import SparkSession

    from chatloom.session import ship_package

    active = SparkSession.getActiveSession()
    if active is not None:
        ship_package(active)
    a, b = perm_params(num_perm, seed)
    a_col, b_col = a[:, None], b[:, None]

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def _minhash(hashes: pd.Series) -> pd.Series:
        out = []
        for h in hashes:
            h = np.asarray(h, dtype=np.int64)
            sig = np.full(num_perm, MERSENNE_P, dtype=np.int64)
            for s in range(0, len(h), _BLOCK):  # bounded memory for very long texts
                blk = h[None, s:s + _BLOCK]
                sig = np.minimum(sig, ((a_col * blk + b_col) % MERSENNE_P).min(axis=1))
            out.append(sig)
        return pd.Series(out)

    return _minhash


def lsh_params(threshold: float, num_perm: int = 128, fp_weight: float = 0.5, fn_weight: float = 0.5) -> tuple[int, int]:
    """Bands ``b`` and rows ``r`` (b*r <= num_perm) minimising the weighted false-positive and
    false-negative areas under the S-curve ``1-(1-s^r)^b`` around ``threshold``."""
    best, best_err = (1, 1), float("inf")
    lo = np.linspace(0.0, threshold, 2001)
    hi = np.linspace(threshold, 1.0, 2001)
    for b in range(1, num_perm + 1):
        for r in range(1, num_perm // b + 1):
            fp = np.trapezoid(1 - (1 - lo ** r) ** b, lo)
            fn = np.trapezoid((1 - hi ** r) ** b, hi)
            err = fp_weight * fp + fn_weight * fn
            if err < best_err:
                best, best_err = (b, r), err
    return best

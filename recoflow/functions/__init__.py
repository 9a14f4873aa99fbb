"""Column-expression helpers (JVM-side built-ins only, no Python UDFs)."""

from recoflow.functions.hashing import hash_key, hash_uniform, hash_bucket
from recoflow.functions.arrays import dot, l2_norm, cosine, pad_right, pad_left, epoch_seconds

__all__ = ["hash_key", "hash_uniform", "hash_bucket", "dot", "l2_norm", "cosine",
           "pad_right", "pad_left", "epoch_seconds"]

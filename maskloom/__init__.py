"""maskloom: masked-utterance dataset engine on Spark.

Every operator is a DataFrame expression or job; randomness is a seeded md5
of stable keys, so results do not depend on partitioning and can be repeated
in plain SQL.
"""

from maskloom.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]

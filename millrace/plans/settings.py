"""Parameters of the registered queries, which their SQL twins share."""

from __future__ import annotations

from pyspark.sql import DataFrame

YEAR = 1997
PARTITIONS = 8
JACCARD = 0.055
LSH_BANDS = 100
LSH_JACCARD = 0.055
USER_BANDS = 35
EDGE_THRESHOLD = 7
SWAPPED_SUPPORT = 9
K_MEANS = 10
SAMPLE_SIZE = 100

#: The share of baskets, in thousandths, that an itemset needs.
SUPPORT_SHARE = 20

#: Frequent short words that say nothing (fixed values).
STOPWORDS = ["the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "die", "der", "und", "de", "la", "que", "el", "et", "les", "le", "|"]


def BASKET_SUPPORT(pairs: DataFrame) -> int:
    """The support of brand itemsets: a share of the baskets, rounded up."""
    n = pairs.select("basket").distinct().count()
    return max(1, -(-n * SUPPORT_SHARE // 1000))

"""Plain versions of what the operators compute, and small tables with every awkward row."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return WORD.findall(text or "")


def shingles(text, k=5):
    w = words(low(text or ""))
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []


def awkward(spark, rows, schema="doc_id bigint, text string"):
    """A documents table with columns whose names clash with what operators add."""
    df = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F

    return df.withColumns({"score": F.lit("own"), "id": F.lit("own"), "key": F.lit("own"), "n": F.lit("own"), "quality_score": F.lit("own"), "matches": F.lit("own"), "p": F.lit("own"), "tokens": F.lit("own"), "_row": F.lit("own")})


def weighted_jaccard(a, b):
    a, b = Counter(a), Counter(b)
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else 0.0

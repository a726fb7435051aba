"""Functions that SQL has none for, registered by name so that spark.sql can call them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from draftlens import vocab

SPAN = "array<struct<start:int,end:int>>"


class ScanPersonalData:
    """Rows of a text's matches: rule_id, severity, span_start, span_end."""

    def eval(self, text: str):
        import re

        for rules, severity in ((vocab.PII_STRICT, "high"), (vocab.PII_HEURISTIC, "medium")):
            for rule, pattern in rules.items():
                for m in re.finditer(pattern, text or ""):
                    if severity == "high" or not m[0].startswith(tuple(vocab.PII_NOT_NAMES)):
                        yield Row(rule_id=rule, severity=severity, span_start=m.start(), span_end=m.end())


def register(spark: SparkSession) -> list[str]:
    """Register nfc, ncd, indel_ratio, difflib_spans and the table function scan_pii; their names are returned. A null gives null."""
    import unicodedata

    from draftlens.operators.detect import compression_distance
    from draftlens.operators.diffs import changed_spans, indel_ratio
    from draftlens.session import ship_package

    ship_package(spark)

    def pairs(f, kind):
        def over(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

        return F.pandas_udf(over, kind)

    def composed(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else unicodedata.normalize("NFC", x) for x in a], dtype=object)

    spans = lambda a, b: [{"start": s, "end": e} for s, e in changed_spans(a, b)]
    made = {
        "nfc": F.pandas_udf(composed, "string"),
        "ncd": pairs(compression_distance, "double"),
        "indel_ratio": pairs(indel_ratio, "double"),
        "difflib_spans": pairs(spans, SPAN),
    }
    for name, f in made.items():
        spark.udf.register(name, f)
    spark.udtf.register("scan_pii", F.udtf(ScanPersonalData, returnType="rule_id string, severity string, span_start int, span_end int"))
    return [*made, "scan_pii"]

"""Small tables for the operators' tests."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, did long, _text string, h string"
WS = "[\x20\x09-\x0d]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return [w for w in re.split(WS, lower(text)) if w]


def docs(spark, rows, parts=3):
    """rows of (doc_id, text); other columns are null or clash with names that operators use inside."""
    return spark.createDataFrame([(i, t, None, "src0", None, 5, "clash", "clash") for i, t in rows], DOCS).repartition(parts)


def stored(df, tmp_path, name="docs"):
    path = f"{tmp_path}/{name}.parquet"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)

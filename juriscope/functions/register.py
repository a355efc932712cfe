"""SQL functions and the table function of the engine, registered on a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scalars

_INT = T.IntegerType()
PINCITE = T.StructType().add("page", _INT).add("end_page", _INT).add("footnote", _INT).add("star", T.BooleanType()).add("paragraph", _INT).add("raw", T.StringType())
DATE = T.StructType().add("iso", T.StringType()).add("year", _INT).add("month", _INT).add("day", _INT)


@F.pandas_udf(PINCITE)
def parse_pincite(text: pd.Series) -> pd.DataFrame:
    empty = dict.fromkeys(("page", "end_page", "footnote", "star", "paragraph", "raw"))
    frame = pd.DataFrame([scalars.parse_pincite(x) or empty for x in text], columns=list(empty), dtype=object)
    return frame.where(frame.notna(), None)


@F.pandas_udf(DATE)
def parse_date(text: pd.Series) -> pd.DataFrame:
    empty = dict.fromkeys(("iso", "year", "month", "day"))
    frame = pd.DataFrame([scalars.parse_date(x) or empty for x in text], columns=list(empty), dtype=object)
    return frame.where(frame.notna(), None)


@F.pandas_udf(T.StringType())
def normalize_party(name: pd.Series) -> pd.Series:
    return name.map(scalars.normalize_party)


@F.pandas_udf(T.StringType())
def normalize_court(name: pd.Series) -> pd.Series:
    return name.map(scalars.normalize_court)


@F.pandas_udf(T.StringType())
def content_hash(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else scalars.content_hash(x))


@F.pandas_udf(T.StringType())
def clean_text(text: pd.Series) -> pd.Series:
    from ..operators.cleaning import clean_text as clean

    return text.map(lambda x: None if x is None else clean(x).text)


@F.pandas_udf(T.StringType())
def find_named_code(state: pd.Series, name: pd.Series) -> pd.Series:
    from ..operators.lexicon import find_named_code as find

    return pd.Series([None if s is None or n is None else find(s, n) for s, n in zip(state, name, strict=True)], dtype=object)


@F.pandas_udf(T.StructType().add("code", T.StringType()).add("jurisdiction", T.StringType()))
def find_state_code(text: pd.Series) -> pd.DataFrame:
    from ..operators.lexicon import find_state_code as find

    return pd.DataFrame([(None, None) if x is None else find(x) for x in text], columns=["code", "jurisdiction"], dtype=object)


@F.pandas_udf(T.StringType())
def normalize_reporter(text: pd.Series) -> pd.Series:
    from ..operators.lexicon import find_reporter

    return pd.Series([None if x is None or not find_reporter(x) else find_reporter(x)[0] for x in text], dtype=object)


def register(spark: SparkSession) -> None:
    """Scalars: parse_pincite, parse_date, normalize_party, normalize_court, normalize_reporter, content_hash, clean_text,
    find_state_code, find_named_code. For LATERAL: extract_citations and tokenize, and one function for each type of
    full citation (extract_case, extract_statute, ...)."""
    from ..operators.citations import CITATION
    from .table import SINGLE, TOKEN, ExtractCitations, Tokenize, of_type

    for udf in (parse_pincite, parse_date, normalize_party, normalize_court, normalize_reporter, content_hash, clean_text, find_state_code, find_named_code):
        spark.udf.register(udf.__name__, udf)
    spark.udtf.register("extract_citations", F.udtf(ExtractCitations, returnType=CITATION))
    for name, kind in SINGLE.items():
        spark.udtf.register(name, F.udtf(of_type(kind), returnType=CITATION))
    spark.udtf.register("tokenize", F.udtf(Tokenize, returnType=TOKEN))

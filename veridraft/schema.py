"""Schemas of the lake."""

from pyspark.sql.types import BooleanType, FloatType, IntegerType, LongType, StringType, StructField, StructType

_S, _B, _I, _F = StringType(), BooleanType(), IntegerType(), FloatType()


def _table(**columns) -> StructType:
    return StructType([StructField(k, v) for k, v in columns.items()])


TROPE = _table(trope_id=_S, name=_S, category=_S, description=_S, example_phrase=_S)
SOURCE_DOCUMENT = _table(doc_id=_S, source=_S, url=_S, sha256=_S, fetched_at=_S, is_ai_generated=_B, is_synthetic=_B)
SENTENCE = _table(sentence_id=_S, doc_id=_S, ordinal=_I, char_start=_I, char_end=_I, text=_S)
SENTENCE_TROPE_LABEL = _table(sentence_id=_S, trope_id=_S, label_source=_S, confidence=_F)
SENTENCE_REWRITE = _table(rewrite_id=_S, sentence_id=_S, trope_id=_S, rewritten_text=_S, source=_S)
REWRITE_PAIRS = _table(source_text=_S, trope_name=_S, target_text=_S)
DOCUMENT = _table(doc_id=LongType(), text=_S, lang=_S, source=_S)
#: Tables laid out by a column; the tables with text are not, as that would copy the text.
PARTITIONED = {"sentence_trope_label": "trope_id", "sentence_rewrite": "trope_id", "rewrite_pairs": "trope_name"}

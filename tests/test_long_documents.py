"""Chunks of long documents: the work follows the length, whatever the number of chunks."""

import time

import pytest

from lodestone.operators import chunking

DOC = "id string, ord long, title string, text string, language string, source string, query string"
WORDS = 600_000


def seconds(spark, cut, text):
    docs = spark.createDataFrame([("d", 0, "T", text, None, None, None)], DOC)
    cut(docs.limit(0)).count()
    began = time.time()
    rows = cut(docs).select("chunk_ord", "word_count").orderBy("chunk_ord").collect()
    return time.time() - began, [r.word_count for r in rows]


def test_fixed_windows_of_a_long_document(spark):
    took, counts = seconds(spark, chunking.fixed, "word " * (60 + 45 * 26_666))
    assert counts == [60] * 26_667 and took < 15


@pytest.mark.parametrize("strategy", chunking.STRATEGIES)
def test_white_space_of_unicode_and_none_else(spark, strategy):
    """U+FEFF parts words; the separators U+001C to U+001F and U+0085, which Python's split() takes for space, do not."""
    docs = spark.createDataFrame([("d", 0, "T", "a﻿b\x1cc\x85d　e f", None, None, None), ("e", 1, "T", None, None, None, None)], DOC)
    assert [(r.doc_id, r.word_count) for r in chunking.chunk(docs, strategy).collect()] == [("d", 4)]


def test_sentences_of_a_long_document(spark):
    took, counts = seconds(spark, chunking.sentence, "Six words are in this sentence. " * (WORDS // 6))
    assert counts == [18] * (WORDS // 18) + [6] and took < 15


def test_a_long_paragraph_of_like_sentences():
    began = time.time()
    found = chunking.semantic_chunks("alpha beta gamma delta epsilon zeta. " * 40_000)
    assert len(found) == 1 and time.time() - began < 15


def test_sections_of_a_long_document(spark):
    took, counts = seconds(spark, chunking.metadata, "# Head\n" + "six words are in this line\n" * (WORDS // 6))
    assert counts == [75] * (WORDS // 75) and took < 15

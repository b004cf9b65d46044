from __future__ import annotations

import pytest

from kilnspark.operators import paths


def test_all_signs_of_the_reference_are_there():
    assert len(paths.CONTENT_SIGNS) == 43


@pytest.mark.parametrize("language, text", [
    ("go", "x := make(chan int)"),
    ("java", "import java.util.List; public static void main"),
    ("rust", "#[derive(Debug)] let mut x"),
    ("cpp", "template <class T> nullptr"),
    ("sql", "WHERE a = 1 GROUP BY b"),
    ("ruby", "puts 1\n[1].each do |x|"),
    ("typescript", "f(a: string, b: number)"),
])
def test_sources_known_by_the_added_signs(spark, language, text):
    found = paths.language_by_content(spark.createDataFrame([("f", text)], "path string, content string"))
    assert found.first().language == language

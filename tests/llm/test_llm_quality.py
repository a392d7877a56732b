"""Line rules in four languages and at every length of line."""

import brute
import pytest
from pyspark.sql import functions as F

from retail_spark.llm import quality

PROSE = "The harbour lay still that evening, and nobody on the quay spoke of the storm to come."


@pytest.fixture(scope="module")
def judge(spark):
    def run(lines):
        df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
        found = {r.n: r.fails for r in df.select("n", quality.line_fails(F.col("line")).alias("fails")).collect()}
        assert [found[i] for i in range(len(lines))] == [brute.line_fails(x) for x in lines]
        return [found[i] for i in range(len(lines))]

    return run


def test_every_phrase_removes_a_short_line_and_no_long_one(judge):
    phrases = [p for group in quality.BOILERPLATE.values() for p in group]
    assert len(quality.BOILERPLATE) == 4 and len(set(phrases)) == len(phrases) > 70
    assert all(judge([f"Now {p.capitalize()} here." for p in phrases]))
    assert not any(judge([f"{PROSE} {PROSE} Then {p} was said once." for p in phrases]))


def test_how_lines_end(judge):
    ends = ["More of this story...", "Home and garden »", "Next page >", "All the news …", "Shoes |", "Older posts → "]
    assert all(judge(ends))
    assert not any(judge([PROSE, "A title without a mark", "He stopped... and went on.", f"{PROSE} {PROSE} And so on...", "Is it so?", "« Oui. »."]))
    words = [f"item{i}" for i in range(80)]
    assert judge([" ".join(words), " ".join(words[:60]), " ".join(words) + "."]) == [True, False, False]


def test_repetition_at_every_length(judge):
    few = [" ".join(f"w{i % k}" for i in range(n)) + " ." for n, k in ((10, 1), (12, 3), (400, 60), (10_000, 80), (10_000, 1500))]
    assert judge(few) == [True, False, True, True, False]
    assert judge(["no no no no no no no no no no no no"]) == [True]


def test_documents_in_each_language_are_kept(spark):
    texts = [
        PROSE + "\nShe had waited there since noon, and would wait longer. Read more",
        "Le port était calme ce soir-là, et personne ne parlait de la tempête.\nMentions légales",
        "Der Hafen lag an diesem Abend still, und niemand sprach vom kommenden Sturm.\nWeiterlesen ...",
        "El puerto estaba tranquilo aquella tarde, y nadie hablaba de la tormenta.\nLeer más »",
    ]
    rows = quality.keep_good(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.text for r in rows} == {i: t.split("\n")[0] for i, t in enumerate(texts)}

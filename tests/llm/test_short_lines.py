"""Lines of one to four words: equal ones meet, and later ones go."""

from stepfold.llm import line_dedup
from stepfold.llm.queries import REGISTRY, table
from tests.llm import brute
from tests.llm.test_queries import SF_DIR


def test_short_lines(spark):
    docs = [(1, "Home\nAll rights reserved.\na b c d e\n\nc d"), (2, "HOME \nNews\n all  rights reserved.\na b c d\n\nd c"), (3, "News\n\n"), (None, "Home"),
            (4, "a b c d\nHome home\nc  d\na b c d e"), (5, "Home\nnew words")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "cast(length(text) as long) AS n_chars")
    got = {r.doc_id: list(zip(r.lines, ((m.doc_id, m.line) for m in r.matches))) for r in line_dedup.removed_lines(frame).collect()}
    assert got == {2: [(0, (1, 0)), (2, (1, 1))], 3: [(0, (2, 1))], 4: [(0, (2, 3)), (2, (1, 4)), (3, (1, 2))], 5: [(0, (1, 0))]}
    assert {(i, n) for i, lines in got.items() for n, _ in lines} == brute.later_lines(docs).keys()
    kept = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.deduplicated(frame).collect()}
    assert kept == {1: (docs[0][1], len(docs[0][1])), 2: ("News\na b c d\n\nd c", 17), None: ("Home", 4), 4: ("Home home", 9), 5: ("new words", 9)}


def test_query_takes_short_lines(spark):
    texts = [(r.doc_id, r.text) for r in table(spark, SF_DIR, "documents").collect()]
    got = {(r.doc_id, n) for r in REGISTRY["op9_line_dedup"](spark, SF_DIR).collect() for n in r.lines or ()}
    assert got == brute.later_lines(texts).keys()

"""What line deduplication moves: sets only to the side that names them, lines only where marks leave it open."""

from pyspark.sql import functions as F

from stepfold.llm import line_dedup


def test_sets_move_to_their_side_only(spark):
    sets = spark.createDataFrame([(d, -d, [d // 2, 7, 8, 9], 100 - d, d) for d in range(40)], "d1 long, d2 long, own array<bigint>, doc_id long, line int")
    pairs = spark.createDataFrame([(2, 3), (4, 5), (6, 9), (8, 9)], "d1 long, other long")
    assert line_dedup._named(sets, pairs.select("d1"), "d1").count() < 10
    found = {(r.d1, r.d2, r.match.doc_id, r.match.line) for r in line_dedup._verified(pairs, sets, 75).collect()}
    assert found == {(2, -2, 97, 3), (4, -4, 95, 5), (8, -8, 91, 9)}
    names, rest = pairs.select("d1"), line_dedup._named(sets, pairs.select("d1"), "d1", False)
    assert rest.join(names, "d1").isEmpty() and rest.count() > 30
    assert rest.union(line_dedup._named(sets, names, "d1")).select(F.count_distinct("d1")).first()[0] == 40

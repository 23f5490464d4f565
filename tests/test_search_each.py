"""Searches for all queries hold the rows of the searches for one."""

from pyspark.sql import functions as F

from quillmine.functions.columns import tokens
from quillmine.operators import search as S
from quillmine.operators import sequence as Q
from quillmine.plans import search_queries as R

SF = "/root/testdata/sf0.001"


def test_each_query_has_its_rows(spark):
    words = R.table(spark, SF, "benchmark").where("item_id = 0").select(tokens(F.col("text")).alias("t")).first()["t"]
    vector = list(R.vectors(spark, SF).where("id = 0").first()["embedding"])
    ones = {"bm25_search": S.bm25(R.docs(spark, SF), words, 40), "knn_search": S.knn(R.vectors(spark, SF), vector, 40), "hybrid_search": S.hybrid(R.docs(spark, SF), R.vectors(spark, SF), words, vector)}
    for name, one in ones.items():
        got, one = R.QUERIES[name](spark, SF).toPandas(), one.toPandas()
        own = got[got["query"] == 0]
        assert sorted(zip(own["id"], own["score"])) == sorted(zip(one["id"], one["score"])), name
    want = {r["id"] for r in R.vectors(spark, SF).where("id % 50 = 0").collect()}
    assert set(R.QUERIES["knn_search"](spark, SF).toPandas()["query"]) == want and len(want) > 1
    sig = R.sig(spark, SF)
    got = Q.similar_each(sig, F.col("id").isin(1, 2)).toPandas()
    for k in (1, 2):
        own = got[got["query"] == k]
        one = Q.similar_sessions(sig, k).toPandas()
        assert list(zip(own["session"], own["similarity"])) == list(zip(one["session"], one["similarity"]))

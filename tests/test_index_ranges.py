"""Dense indices and offsets over several ranges, as on tables of more than 200,000 bodies."""

import duckdb
from pyspark.sql import functions as F

from spindrift.operators import normalize
from spindrift.queries import views as v


def test_index_and_offsets_over_ranges(spark, sf, monkeypatch):
    monkeypatch.setattr(normalize, "RANGE_ROWS", 20)
    mapping = normalize.neuron_map(v.annotations(spark, sf))
    n = mapping.count()
    r = mapping.agg(F.count("*").alias("n"), F.max("neuron_index").alias("last")).first()  # only the index is asked for
    assert n > 100 and (r.n, r.last) == (n, n - 1)
    want = [x[0] for x in duckdb.sql(f"select p_partkey from '{sf}/part.parquet' where p_type <> 'PROMO' order by 1").fetchall()]
    assert [x.body_id for x in mapping.orderBy("neuron_index").collect()] == want
    edges = spark.createDataFrame([(0, 3), (1, 3), (2, n - 1), (0, 50)], "source_index int, target_index int")
    at, starts = 0, {x.node: (x.degree, x.start) for x in normalize.offsets(edges, mapping).collect()}
    for node in range(n):
        assert starts[node][1] == at
        at += starts[node][0]
    assert at == 4

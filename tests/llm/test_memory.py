"""What operators keep in a session and in workers."""

import pyarrow as pa

from cinderlake.llm import byte_bpe
from cinderlake.llm.common import BATCH_ROWS, small_batches

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Shared:
    def __init__(self, column):
        self.value = [byte_bpe._stream(pa.chunked_array([column]))]


def test_workers_keep_no_codebook():
    """A worker waits for further tasks with what its last one left in the function's state."""
    batch = pa.record_batch({"doc_id": [1, 2], "text": ["the river the", None]})
    run = byte_bpe._look_up(Shared(pa.array(["the", " the"])), ["doc_id"], r" ?\p{L}+", ["places", "rare"])
    found = pa.Table.from_batches(run(iter([batch]))).to_pylist()
    assert found == [{"doc_id": 1, "places": [0, -1, 1], "rare": [" river"]}, {"doc_id": 2, "places": [], "rare": []}]
    assert [c.cell_contents for c in run.__closure__ if isinstance(c.cell_contents, dict)] == [{}]


def test_texts_go_to_workers_by_few_rows(spark):
    before = spark.conf.get(KEY)
    try:
        for now, then in (("10000", BATCH_ROWS), ("0", BATCH_ROWS), ("7", 7)):
            spark.conf.set(KEY, now)
            small_batches(spark)
            assert int(spark.conf.get(KEY)) == then
            rows = spark.range(0, 2000, 1, 1).mapInArrow(lambda bs: (pa.record_batch([[b.num_rows]], names=["n"]) for b in bs), "n long").collect()
            assert max(r.n for r in rows) == then and sum(r.n for r in rows) == 2000
    finally:
        spark.conf.set(KEY, before)

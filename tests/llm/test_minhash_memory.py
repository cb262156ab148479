"""What a worker holds for near-duplicates: tables in single precision, sets of one piece of a batch at a time."""
import tracemalloc

import pyarrow as pa

from fieldlake.llm import minhash


def test_sampler_holds_no_table_in_double_precision():
    tracemalloc.start()
    sampler = minhash.Sampler()
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 1.1 * sum(t.nbytes for t in (sampler.r, sampler.c, sampler.beta))


def test_pieces_cover_a_batch_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(range(2 * minhash.PIECE_ROWS + 3))], names=["id"])
    parts = list(minhash._pieces(batch))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert max(p.num_rows for p in parts) == minhash.PIECE_ROWS and list(minhash._pieces(batch.slice(0, 0))) == []

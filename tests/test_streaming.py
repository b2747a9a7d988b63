"""The streaming area table equals the batch one once all files are processed."""

from __future__ import annotations

from areastats.plans.area import AreaQuery, area_table
from areastats.session import scratch_path
from areastats.sources.fixtures import Fixtures
from areastats.streaming.incremental import (read_company_stream, start_area_stream,
                                             streaming_area_table)


def test_streaming_matches_batch(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    src = scratch_path(spark, "company_stream_src")
    fx.company().repartition(4).write.parquet(src)          # four files -> four micro-batches
    q = AreaQuery(basis="sites", level="la")
    stream = streaming_area_table(read_company_stream(spark, src, max_files_per_trigger=1),
                                  fx.geography, q)
    out = scratch_path(spark, "stream_out")
    handle = start_area_stream(stream, out, scratch_path(spark, "ckpt"))
    handle.awaitTermination(300)
    got = sorted((tuple(r) for r in spark.read.parquet(f"{out}/batch=3").collect()),
                 key=lambda r: (r[0] is None, r[0]))
    want = sorted((tuple(r) for r in area_table(fx.company(), fx.geography, q).collect()),
                  key=lambda r: (r[0] is None, r[0]))
    assert got == want

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from seqloom.llm.common import read  # noqa: E402
from seqloom.llm.language import identify  # noqa: E402
from seqloom.llm.packing import ChunkEncoder, default_files  # noqa: E402
from seqloom.llm.quality import train, with_score  # noqa: E402
from seqloom.llm.secrets import find_secrets, redacted  # noqa: E402
from seqloom.llm.simhash import simhash_groups  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_have_the_columns_of_documents_and_handle_odd_rows(spark, docs, no_docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, no_docs):
            assert stage(spark, table, SF).columns == docs.columns, name


def test_run_follows_from_the_operators(spark):
    """Each decision taken again by hand, in order, and the tokens that must be left."""
    from pyspark.sql import functions as F

    docs = read(spark, SF, "documents")
    kept = {r.doc_id for r in identify(docs, F.col("text"), F.col("lang"), F.col("source")).collect() if r.lid.accepted}
    left = docs.where(F.col("doc_id").isin(list(kept)))
    model = train(left, read(spark, SF, "labels"))
    kept &= {r.id for r in with_score(left, model).collect() if r.score >= 0.7}
    groups = simhash_groups(docs.where(F.col("doc_id").isin(list(kept)))).collect()
    kept = {r.component for r in groups}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    encoder = ChunkEncoder(*default_files())
    wanted = {i: len(encoder.encode(redacted(t, find_secrets(t)[1]))) // 4 + 1 for i, t in texts.items()}
    pieces = corpus_pipeline.run(spark, SF).toPandas()
    assert pieces.groupby("doc_id").length.sum().to_dict() == wanted
    assert pieces.groupby("doc_id").doc_tokens.first().to_dict() == wanted
    by = pieces.sort_values(["sequence_id", "offset"])
    assert (by.groupby("sequence_id").length.cumsum() - by.length == by.offset).all()
    assert int(np.max(by.groupby("sequence_id").length.sum())) <= 1024
